"""Secret scan: candidates by shape, false positives removed by a random forest.

Candidates are values assigned to a name (``token = "..."``, ``"token": "..."``, ``Authorization: Bearer ...``),
parameters and passwords inside addresses, and bare strings of twelve characters and more that hold a digit or are of
a known format: addresses, numbers and identifiers stand among them. Each gets features of five kinds: length;
character transitions (changes of class, how surprising pairs of classes and characters are); coverage by words of the
corpus; the words of its path; and the words around it. Spark's random forest learns from labelled findings which
candidates are secrets; keys of a known format are secrets whatever it says.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquorum.session import cut_lineage

ASSIGNED = re.compile(
    r"""([A-Za-z][A-Za-z0-9_.-]{1,40})\\?["'`]?[ \t]{0,3}(?:[:=]=|=>|[=:])[ \t]{0,3}\\?(["'`]?)"""
    r"""(?:(?:[Bb]earer|[Bb]asic|[Tt]oken)[ \t]+)?([^\s"'`]{6,})""")
URL = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s"'`]+""")
IN_URL = re.compile(r"""//[^\s/@:?#]*:([^\s/@]{6,})@|[?&;#]([A-Za-z][A-Za-z0-9_.-]{1,40})=([^&;#]{6,})""")
#: Key formats that nothing else has. Java and Python read this pattern alike.
KNOWN = (
    r"(?:^|[^A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,}"
    r"|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|[sr]k_live_[A-Za-z0-9]{16,}"
    r"|sk-[A-Za-z0-9_-]{32,}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*)(?:$|[^A-Za-z0-9])")
#: A part of a name that says secret; tokenizer, max_tokens and secretary do not.
TELLING = (
    r"(?:^|[^a-z])(?:[a-z]*(?:password|passwd|passphrase|credential)s?|pwd|[a-z]*token|[a-z]*secret(?:key)?"
    r"|(?:api|access|private|secret|auth)[_.-]?key|authorization)(?:$|[^a-z])")
#: What a bare value is if it is no secret: an address, a mail address, a path, a number, a date, a version.
PLAIN = (
    r"^[(<\[]*(?:[A-Za-z][A-Za-z0-9+.-]*://[^?@]*|[^@/:]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+|[~.]{0,2}/[^=]*"
    r"|[vV+(-]*[0-9][0-9.,:/ ()TZ+-]*)[)>\].,;:!?]*$")
BARE = re.compile(r"""[^\s"'`]{12,}""")
HINTS = (
    "token", "password", "passwd", "pwd", "secret", "key", "api", "auth", "access", "private", "credential", "bearer",
    "id", "hash", "sha", "commit", "version", "url", "http", "example", "test", "uuid", "checksum", "session",
)
PATH_HINTS = ("env", "config", "conf", "settings", "deploy", "test", "example", "doc", "lock", "src")
#: Names of the forest's own columns, unlike those of tables.
VECTOR, PROBABILITY = "__secret_vector", "__secret_probability"
_WORD = re.compile(r"[^\W\d_]{3,}")
_KNOWN = re.compile(KNOWN)
_CLASS = re.compile(r"([a-z])|([A-Z])|([0-9])|([+/=])|([-_.])")


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """(begin, end, name) of all candidates of a whole text in order; overlapping ones are one, name may be ''."""
    text, found = text or "", {}
    for m in ASSIGNED.finditer(text):
        value = m[3].rstrip(",;.)]}>\\")
        if len(value) >= 6 and not value.startswith("//"):
            found[m.start(3)] = (m.start(3), m.start(3) + len(value), m[1].lower())
    for url in URL.finditer(text) if "://" in text else ():
        parts = [(m.start(k), m.end(k), (m[2] or "password").lower())
                 for m in IN_URL.finditer(text, url.start(), url.end()) for k in (1, 3) if m[k]]
        if parts:
            found.pop(url.start(), None)
            found.update((part[0], part) for part in parts)
    taken: list[tuple[int, int, str]] = []
    for one in sorted(found.values()):
        if not taken or taken[-1][1] <= one[0]:
            taken.append(one)
    found = {one[0]: one for one in taken}
    at = 0
    for m in BARE.finditer(text):
        if not any("0" <= c <= "9" for c in m[0]) and not _KNOWN.search(m[0]):
            continue
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if at == len(taken) or taken[at][0] >= m.end():
            found.setdefault(m.start(), (m.start(), m.end(), ""))
    return sorted(found.values())


def _classes(value: str) -> str:
    return "".join("ludsp"[m.lastindex - 1] if (m := _CLASS.match(c)) else "o" for c in value)


def features(value: str, name: str, before: str, after: str, path: str, words: frozenset) -> list[float]:
    """Numbers that describe a candidate; ``words`` is the dictionary."""
    kinds = _classes(value)
    pairs = Counter(zip(kinds, kinds[1:]))
    letters = Counter(value)
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in letters.values())
    follow = Counter(zip(value, value[1:]))
    surprise = -sum(c / (n - 1) * math.log2(c / (n - 1)) for c in follow.values()) if n > 1 else 0.0
    known = sum(len(m[0]) for m in _WORD.finditer(value) if m[0].lower() in words)
    around = f"{before} {after}".lower()
    low_path = path.lower()
    return [
        float(n), math.log(n), entropy, surprise, float(sum(a != b for a, b in zip(kinds, kinds[1:]))) / n,
        *(kinds.count(c) / n for c in "ludspo"), *(pairs[a, b] / n for a in "lud" for b in "lud"),
        float(bool(re.fullmatch(r"[0-9a-f]+", value))), float(n % 4 == 0), known / n,
        float(value.lower() in words), float(bool(name)),
        *(float(h in name) for h in HINTS), *(float(h in around) for h in HINTS),
        *(float(h in low_path) for h in PATH_HINTS),
    ]


def dictionary(docs: DataFrame, text: str = "text", documents: int = 5, most: int = 50_000) -> frozenset[str]:
    """The words that stand in most documents of the corpus, in ``documents`` at least: as many classes of equally frequent
    words as together stay within ``most``.

    The classes' sizes come first, so that only the words of the dictionary reach the driver.
    """
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for frame in frames:
            for t in frame["text"]:
                held.update({w.lower() for w in _WORD.findall(t or "")})
                if len(held) > 200_000:
                    yield pd.DataFrame(list(held.items()), columns=["word", "n"])
                    held = Counter()
        yield pd.DataFrame(list(held.items()), columns=["word", "n"])

    counts = docs.select(F.col(text).alias("text")).mapInPandas(count, "word string, n long").filter("length(word) <= 40")
    top = cut_lineage(counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= documents))
    least, room = None, most
    for row in sorted(top.groupBy("n").count().collect(), key=lambda r: -r["n"]):
        room -= row["count"]
        if room < 0:
            break
        least = row["n"]
    return frozenset() if least is None else frozenset(
        r["word"] for r in top.filter(F.col("n") >= least).select("word").collect())


def candidates(docs: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """One row per candidate: the columns of the input without the text, ``value, begin, end, name, features``.

    Null and empty texts give no rows, a null path is an empty one. Repeated rows give repeated candidates. Columns of
    the input with the names of the new ones are replaced.
    """
    known = docs.sparkSession.sparkContext.broadcast(dictionary(docs, text))

    @F.pandas_udf("array<struct<value:string,begin:int,end:int,name:string,features:array<double>>>")
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, paths in batches:
            out = []
            for t, p in zip(texts, paths):
                at = spans(t)
                out.append([
                    (t[b:e], b, e, name, features(t[b:e], name, t[max(0, b - 40):b], t[e:e + 20], p or "", known.value))
                    for b, e, name in at])
            yield pd.Series(out, dtype=object)

    keep = [c for c in docs.columns if c not in (text, "value", "begin", "end", "name", "features")]
    found = docs.withColumn("__found", F.explode(find(F.col(text), F.col(path).cast("string"))))
    return found.select(*keep, "__found.*")


def evidence(found: DataFrame) -> DataFrame:
    """Candidates with a 0/1 ``label`` where something tells it: a known format, the name, or a bare value's own shape.

    Bare values that nothing tells are left out, as they may be secrets. Every value labelled by its name stands
    here a second time without name and surroundings, so that its own shape is learnt as well.
    """
    format_, name = F.col("value").rlike(KNOWN), F.col("name")
    label = F.when(format_ | name.rlike(TELLING), 1).when(name != "", 0).when(F.col("value").rlike(PLAIN), 0)
    told = found.withColumn("label", label).filter("label is not null")
    begin = len(features("x", "", "", "", "", frozenset())) - len(PATH_HINTS) - 2 * len(HINTS) - 1
    blind = F.transform("features", lambda x, i: F.when(
        (i >= begin) & (i <= begin + 2 * len(HINTS)), F.lit(0.0)).otherwise(x))
    return told.union(told.filter(name != "").withColumn("name", F.lit("")).withColumn("features", blind))


def fit(labelled: DataFrame, label: str = "label", most: int = 20_000, trees: int = 30, depth: int = 8,
        seed: int = 3) -> RandomForestClassificationModel | None:
    """A forest from labelled candidates (``features`` and a 0/1 label), about ``most`` of either label, drawn by a hash
    below the share that these are of all. None if there are no labels of both kinds; ``scan`` then keeps every
    candidate.
    """
    share = (F.xxhash64("value", "name", "features").bitwiseAND(F.lit(2**31 - 1)) / float(2**31)).alias("draw")
    known = labelled.filter(F.col(label).isin(0, 1)).select("features", F.col(label).cast("double").alias("label"), share)
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    kept = F.when(F.col("label") == 1, most / sizes[1.0]).otherwise(most / sizes[0.0])
    rows = known.filter(F.col("draw") < kept).select(array_to_vector("features").alias(VECTOR), "label")
    return RandomForestClassifier(
        featuresCol=VECTOR, labelCol="label", probabilityCol=PROBABILITY, rawPredictionCol="", predictionCol="",
        numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def scan(found: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """``found`` with ``probability`` of being a secret, and ``secret``: whether it is at least a half, or the value
    is of a known key format. Columns of these two names are replaced, others stay."""
    if model is None:
        return found.withColumns({"probability": F.lit(None).cast("double"), "secret": F.lit(True)}).drop("features")
    scored = model.transform(found.withColumn(VECTOR, array_to_vector("features")))
    return scored.withColumn("probability", vector_to_array(PROBABILITY)[1]).withColumn(
        "secret", (F.col("probability") >= 0.5) | F.col("value").rlike(KNOWN)
    ).drop("features", VECTOR, PROBABILITY)

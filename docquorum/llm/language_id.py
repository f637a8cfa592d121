"""Language identification by Bayesian fusion of text, markup, address and host.

*Text.* Documents of known language give smoothed counts of byte trigrams, hashed to a fixed number of slots and summed
over all documents. A text's log-likelihood is tempered by the square root of its length, since neighbouring trigrams
repeat each other's evidence.

*Priors.* Text alone gives every row a first posterior. Grouped sums of these posteriors give the share of languages
of every host, of every domain (the last two labels), of every address suffix (the last label) and of all rows. Each
level is smoothed by the one above: ``(own sum + strength * share above) / (own weight + strength)``. What a row itself
brought is taken out again before it meets its prior. The same sums give how often a language is declared in markup.

*Fusion.* The posterior is the normalised product of host prior, probability of the declared language, and tempered
likelihood. Missing evidence is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquorum.session import cut_lineage

SLOTS = 1 << 14
_HIDDEN = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z#0-9]+;")


def visible(html: str | None) -> str:
    """Text of a page without scripts, styles, comments, tags and entities."""
    return _HIDDEN.sub(" ", html or "")


def trigram_slots(text: str) -> np.ndarray:
    """Slots of the byte trigrams of a lower-cased text; digits and symbols count as one blank."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    letters = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    raw = np.where(letters, raw, 32).astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, np.int64)
    mixed = (raw[:-2] * np.uint32(0x9E3779B1)) ^ (raw[1:-1] * np.uint32(0x85EBCA77)) ^ (raw[2:] * np.uint32(0xC2B2AE3D))
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    slots = (mixed >> np.uint32(18)).astype(np.int64)
    return slots[~((raw[:-2] == 32) & (raw[1:-1] == 32))]


class TextModel:
    """Log-probabilities of the slots by language."""

    def __init__(self, languages: list[str], counts: np.ndarray, smoothing: float = 0.5):
        self.languages = languages
        total = counts.sum(axis=1, keepdims=True) + smoothing * SLOTS
        self.log = np.log((counts + smoothing) / total)

    def likelihood(self, text: str) -> np.ndarray:
        slots = trigram_slots(text)
        if not len(slots) or not self.languages:
            return np.zeros(len(self.languages))
        value = self.log[:, slots].sum(axis=1) / np.sqrt(len(slots))
        return value - value.max()


def fit_text(docs: DataFrame, text: str = "text", lang: str = "lang") -> TextModel:
    """Count all documents of known language. What reaches the driver is one table of languages by slots."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for frame in frames:
            for language, part in frame.groupby("lang")["text"]:
                total = totals.setdefault(language, np.zeros(SLOTS, np.int64))
                for t in part:
                    total += np.bincount(trigram_slots(t), minlength=SLOTS)
        for language, total in totals.items():
            slots = np.flatnonzero(total)
            yield pd.DataFrame({"lang": language, "slot": slots.astype(np.int32), "n": total[slots]})

    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"))
    cells = known.mapInPandas(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    sums = cells.groupBy("lang").agg(F.collect_list("slot").alias("slots"), F.collect_list("n").alias("ns")).collect()
    sums.sort(key=lambda r: r["lang"])
    counts = np.zeros((len(sums), SLOTS))
    for i, row in enumerate(sums):
        counts[i, row["slots"]] = row["ns"]
    return TextModel([r["lang"] for r in sums], counts)


def declared_language(html: Column) -> Column:
    """First part of the ``lang`` attribute of the ``html`` element, lower case, null if there is none."""
    found = F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)
    return F.when(found != "", F.lower(found))


def identify(rows: DataFrame, model: TextModel, strength: float = 8.0, trust: float = 0.5) -> DataFrame:
    """``lang, probability, text_lang`` added to rows of ``text, host, declared`` (all may be null), without the text.

    ``host`` may be any name of an origin. Rows without text, host and markup get the language that all rows share
    most. Ties go to the first language by code point. Without languages, ``lang`` is null. An empty table gives an
    empty result. ``trust`` smooths the declared languages. A hot host is folded to one row of sums before any join.
    Texts are read whole, repeated rows are judged alike. Columns of the input with the three names are replaced, all
    others stay, whatever their names.
    """
    added = ("lang", "probability", "text_lang")
    others = [c for c in rows.columns if c not in ("text", "host", "declared", *added)]
    packed = rows.select("text", "host", "declared", (F.struct(*others) if others else F.lit(None)).alias("__others"))
    found = _identified(packed, model, strength, trust)
    kept = [c for c in rows.columns if c != "text" and c not in added]
    return found.select(*(F.col(f"__others.{c}" if c in others else c).alias(c) for c in kept), *added)


def _identified(rows: DataFrame, model: TextModel, strength: float, trust: float) -> DataFrame:
    languages = model.languages
    k = len(languages)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def likelihood(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.likelihood(t or "") for t in texts], dtype=object)

    if not k:
        none = F.lit(None).cast("string")
        return rows.drop("text").withColumns({"lang": none, "probability": F.lit(None).cast("double"), "text_lang": none})
    labels = F.split(F.col("host"), r"\.")
    read = rows.withColumns({
        "log": likelihood(F.col("text")),
        "suffix": F.element_at(labels, -1),
        "domain": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."),
    }).drop("text")
    read = cut_lineage(read)
    weights = F.transform("log", F.exp)
    read = read.withColumn("w", weights).withColumn(
        "own", F.transform("w", lambda x: x / F.aggregate("w", F.lit(0.0), lambda s, y: s + y)))
    sums = [F.sum(F.element_at("own", i + 1)).alias(f"s{i}") for i in range(k)]

    def by(name: str) -> DataFrame:
        grouped = read.filter(F.col(name).isNotNull()).groupBy(name).agg(*sums)
        return cut_lineage(grouped.select(
            F.col(name).alias(f"_{name}"), F.array(*(f"s{i}" for i in range(k))).alias(f"{name}_sums")))

    everything = read.agg(*sums).first()
    total = [float(everything[f"s{i}"] or 0) for i in range(k)]
    out = read
    for name in ("host", "domain", "suffix", "declared"):
        out = out.join(by(name), F.col(name) == F.col(f"_{name}"), "left").drop(f"_{name}")
    n = sum(total)

    def each(function) -> Column:
        return F.array(*(function(i) for i in range(k)))

    def less_own(column: str, i: int) -> Column:
        return F.greatest(F.element_at(column, i + 1) - F.element_at("own", i + 1), F.lit(0.0))

    share = each(lambda i: (F.lit(total[i]) - F.element_at("own", i + 1) + 1.0) / F.lit(n - 1 + k))
    out = out.withColumn("share", share)
    for name in ("suffix", "domain", "host"):
        mass = F.aggregate(F.col(f"{name}_sums"), F.lit(0.0), lambda s, x: s + x) - 1.0
        out = out.withColumn("share", F.when(F.col(f"{name}_sums").isNull(), F.col("share")).otherwise(each(
            lambda i: (less_own(f"{name}_sums", i) + strength * F.element_at("share", i + 1))
            / (F.greatest(mass, F.lit(0.0)) + strength))))
    declared = each(lambda i: F.when(F.col("declared_sums").isNull(), F.lit(0.0)).otherwise(F.log(
        (less_own("declared_sums", i) + trust) / F.lit(total[i] + k * trust))))
    out = out.withColumn("said", declared)
    out = out.withColumn("post", each(
        lambda i: F.element_at("log", i + 1) + F.log(F.element_at("share", i + 1)) + F.element_at("said", i + 1)))
    top = F.array_max("post")
    names = F.array(*map(F.lit, languages))
    return out.withColumns({
        "lang": F.element_at(names, F.array_position("post", top).cast("int")),
        "probability": 1 / F.aggregate(F.transform("post", lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x),
        "text_lang": F.element_at(names, F.array_position("log", F.array_max("log")).cast("int")),
    }).drop("w", "own", "log", "share", "said", "post", "suffix", "domain",
            *(f"{name}_sums" for name in ("host", "domain", "suffix", "declared")))

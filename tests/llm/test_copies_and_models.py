"""N-gram join and decontamination against brute force; the learnt operators by held-out accuracy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquorum.llm import decontaminate, language_id, ngram_join, quality_mil, secrets, toxicity
from docquorum.llm.components import components


def plain_sets(rows, n):
    out = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        out[i] = {tuple(words[k:k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()
    return out


def plain_groups(sets, percent):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            common = len(sets[i] & sets[j])
            if i < j and common and 100 * common >= percent * len(sets[i] | sets[j]):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_groups_equal_all_pairs(docs, n, percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 7)  # so that tiles are compared in several blocks
    r = random.Random(n)
    base = [[f"w{r.randint(0, 400)}" for _ in range(size)] for size in (2, 9, 10, 11, 25, 60, 61, 150, 400)]
    rows = []
    for i in range(220):
        words = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 4, 9])):
            at = r.randrange(len(words))
            words[at:at + r.randint(0, 2)] = [f"new{r.randint(0, 9)}"] * r.randint(0, 2)
            words = words or ["end"]
        rows.append((i, r.choice([" ", "\n", "\t "]).join(words) if r.random() < 0.9 else " ".join(words).upper()))
    found = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.near_groups(docs(rows), n, percent).collect()}
    assert found == plain_groups(plain_sets(rows, n), percent)


def test_tiles_lose_no_pair():
    r = np.random.default_rng(1)
    for _ in range(300):
        size = int(r.choice([r.integers(9, 600), r.integers(2000, 2100)]))
        left = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
        differ = int((2 * len(left)) * 0.1 / 1.9)
        gone = int(r.integers(0, differ + 1))
        right = np.unique(np.r_[left[gone:], r.integers(0, 2**63, differ - gone).astype(np.uint64)])
        common = len(np.intersect1d(left, right))
        assert ngram_join.reaches(common, len(left) + len(right), 90) is not None
        if 100 * common >= 90 * (len(left) + len(right) - common):
            keys = [set(ngram_join.tile_keys(x, 90, {}).tolist()) for x in (left, right)]
            assert keys[0] & keys[1] or np.array_equal(left, right)
            a, b = ngram_join.bitmap(left), ngram_join.bitmap(right)
            a, b = ngram_join.folded(a, min(len(a), len(b))), ngram_join.folded(b, min(len(a), len(b)))
            bits = np.bitwise_count((a ^ b).view(np.uint64)).sum()
            assert bits <= len(left) + len(right) - 2 * common


def test_odd_rows(odd, nothing):
    groups = {(x["doc_id"], x["n_shingles"]): x["component_id"] for x in ngram_join.near_groups(odd, 3, 90).collect()}
    assert groups[1, 0] == 1 and groups[2, 0] == 2 and groups[None, 0] is None
    assert groups[5, 1] == groups[6, 1] == 5 and groups[None, 6] is None
    kept = ngram_join.drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(x["doc_id"] or 0 for x in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 7, 8]
    assert ngram_join.near_groups(nothing).count() == 0 and ngram_join.drop_near_copies(nothing).count() == 0


@pytest.mark.parametrize("few", [0, 1000])
def test_components(spark, few):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 100), (7, 7), (200, 300), (300, 200)]
    found = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long"), few).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 300: 200}


def prose(r, n, words):
    return " ".join(r.choice(words) + ("." if k % 9 == 8 else "") for k in range(n))


def test_leaks(docs, odd, nothing, spark):
    r = random.Random(4)
    words = "the of and to in is for on with as".split() * 40 + [f"term{k}" for k in range(900)]
    items = [(i, prose(r, r.randint(15, 60), words)) for i in range(25)] + [(90, None), (91, "")]
    rows = [(i, prose(r, r.randint(30, 400), words)) for i in range(200)]
    leaks = set()
    for i in range(0, 200, 4):
        item = r.choice(items[:25])
        inside = item[1].split()
        if i % 8:  # a paraphrase: some words replaced
            for k in range(0, len(inside), 8):
                inside[k] = f"other{r.randint(0, 300)}"
        own = rows[i][1].split()
        at = r.randrange(len(own))
        rows[i] = (i, " ".join(own[:at] + inside + own[at:]))
        leaks.add((i, item[0]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(docs(rows), bench).collect()}
    assert len(found & leaks) >= 0.95 * len(leaks) and len(found - leaks) <= 2
    clean = {x["doc_id"] for x in decontaminate.decontaminate(docs(rows), bench).collect()}
    assert clean == set(range(200)) - {i for i, _ in found}
    assert decontaminate.decontaminate(odd, bench).count() == odd.count()
    assert decontaminate.find_leaks(nothing, bench).count() == 0
    assert decontaminate.find_leaks(odd, bench.limit(0)).count() == 0


def test_lcs():
    r = random.Random(5)
    for _ in range(100):
        a, b = ([r.choice([b"a", b"b", b"c", b"d"]) for _ in range(r.randint(0, 20))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.lcs(a, b) == table[-1][-1]


def test_toxicity_learns_gapped_insults(docs, odd, nothing):
    r = random.Random(6)
    plain = [a + b for a in "ber ton las mir ove ent qua sil".split() for b in "da ri so une el or ist am".split()]
    rows, labels = [], {}
    for i in range(400):
        words = [r.choice(plain) for _ in range(r.randint(10, 60))]
        labels[i] = int(r.random() < 0.4)
        if labels[i]:
            words[r.randrange(len(words))] = r.choice(["grobnik", "flugzap", "grobnikel"])
        rows.append((i, " ".join(words)))
    frame = docs(rows).withColumn("toxic", F.when(F.col("doc_id") < 300, F.element_at(F.array(*(F.lit(labels[i]) for i in range(300))), (F.least("doc_id", F.lit(299)) + 1).cast("int"))))
    model = toxicity.fit(frame.filter("doc_id < 300"))
    scores = {x["doc_id"]: x["toxic_score"] for x in toxicity.score_toxicity(docs(rows), model).collect()}
    right = [(scores[i] >= 0.5) == bool(labels[i]) for i in range(300, 400)]
    assert sum(right) >= 97
    spelt = docs([(1, "berda g r o b n i k tonri"), (2, "berda gro-b.nik tonri"), (3, "berda grobxnik tonri"), (4, "berda tonri lasso")])
    got = [x["toxic_score"] >= 0.5 for x in toxicity.score_toxicity(spelt, model).orderBy("doc_id").collect()]
    assert got == [True, True, True, False]
    assert all(0 <= x["toxic_score"] <= 1 for x in toxicity.score_toxicity(odd, model).collect())
    assert toxicity.score_toxicity(nothing, model).count() == 0
    lone = toxicity.fit(frame.filter("doc_id < 0"))
    assert all(x["toxic_score"] == pytest.approx(0.5) for x in toxicity.score_toxicity(odd, lone).collect())


def test_quality_learns_from_passages(docs, odd, nothing):
    r = random.Random(7)
    words = [a + b for a in "ber ton las mir ove".split() for b in "da ri so une el".split()]
    rows = []
    for i in range(160):
        text = " ".join(prose(r, r.randint(20, 300), words).split())
        rows.append((i, text if i % 3 else " ### ".join(text.upper().split())))
    frame = docs(rows).withColumn("quality", (F.col("doc_id") % 3 != 0).cast("int"))
    model = quality_mil.fit(frame.filter("doc_id < 100"))
    found = quality_mil.score_quality(frame, model).collect()
    assert all((x["quality_mil"]["score"] >= 0.5) == (x["quality"] == 1) for x in found)
    assert all(math.isclose(sum(x["quality_mil"]["attention"]), 1, abs_tol=1e-4) for x in found)
    assert all(0 <= x["quality_mil"]["score"] <= 1 for x in quality_mil.score_quality(odd, model).collect())
    assert quality_mil.score_quality(nothing, model).count() == 0


def test_attention_gradients():
    r = np.random.default_rng(8)
    bags = [r.normal(size=(k, quality_mil.FEATURES)) for k in (1, 3, 2)]
    x, begins, y = np.concatenate(bags), np.array([0, 1, 4, 6]), np.array([1.0, 0, 1])
    p = quality_mil.train(bags, y, steps=3).p

    def loss(p):
        q = quality_mil._forward(p, x, begins)["probability"]
        return -(y * np.log(q) + (1 - y) * np.log(1 - q)).mean() + 5e-5 * sum((np.asarray(v) ** 2).sum() for v in p.values())

    slopes = quality_mil._gradients(p, x, begins, y)
    for name in p:
        nudged, at = {k: np.array(v, float) for k, v in p.items()}, (0,) * np.ndim(p[name])
        nudged[name][at] += 1e-5
        assert (loss(nudged) - loss(p)) / 1e-5 == pytest.approx(np.asarray(slopes[name])[at], abs=1e-4)


def test_language_fuses_evidence(docs, spark):
    known = [(i, t, lang, "s", 0) for i, (t, lang) in enumerate(
        [("the house is on the hill and the dog sleeps", "en"), ("das haus steht auf dem berg und der hund schläft", "de")] * 20)]
    model = language_id.fit_text(docs([*known, (99, None, "en", "s", 0), (98, "x", None, "s", 0)]))
    assert model.languages == ["de", "en"]
    rows = [("der hund und das haus", "a.de", "de")] * 30 + [("the dog and the house", "b.com", None)] * 30
    rows += [("", "a.de", None), (None, None, "de"), (None, None, None), ("the hill", "a.de", None)]
    frame = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "page_id int, text string, host string, declared string")
    found = {x["page_id"]: x for x in language_id.identify(frame, model).collect()}
    assert len(found) == len(rows) and all(0.5 <= x["probability"] <= 1 for x in found.values())
    assert [found[i]["lang"] for i in (0, 30, 60, 61)] == ["de", "en", "de", "de"]
    assert language_id.identify(frame.limit(0), model).count() == 0
    empty = language_id.fit_text(docs([]))
    assert language_id.identify(frame, empty).filter("lang is not null").count() == 0
    assert language_id.visible('<html lang="de"><script>x</script><p>a&amp;b</p><!-- c --></html>').split() == ["a", "b"]
    assert language_id.visible(None) == ""


def test_secrets(docs, odd, nothing, spark):
    r = random.Random(9)

    def digits(n):
        return "".join(r.choice("0123456789abcdef") for _ in range(n))

    rows = []
    for i in range(120):
        line = {0: f'token = "{digits(40)}"', 1: f"password={digits(12)}x", 2: f"see commit {digits(40)} today",
                3: f"mail some.one{i}@mail.example.com", 4: "nothing to see here"}[i % 5]
        rows.append((i, f"some words before\n{line}\nsome words after", "en", "src/config.py", 0))
    found = secrets.candidates(docs(rows).withColumn("value", F.lit("mine")), path="source")
    assert found.count() == 96
    labelled = found.withColumn("label", F.col("name").isin("token", "password").cast("int"))
    model = secrets.fit(labelled.filter("doc_id < 60"))
    assert all(x["secret"] == (x["doc_id"] % 5 < 2) for x in secrets.scan(found, model).collect())
    for x in found.collect():
        assert rows[x["doc_id"]][1][x["begin"]:x["end"]] == x["value"]
    assert secrets.fit(labelled.filter("label = 1")) is None
    assert secrets.scan(found, None).filter("secret").count() == 96
    assert secrets.candidates(odd, path="source").count() == 0 and secrets.candidates(nothing, path="source").count() == 0


def test_packed_tiles_come_back():
    rng = np.random.default_rng(3)
    keys = rng.integers(-2**63, 2**63 - 1, 500)
    keys[:20] = keys[20:40]
    back = []
    for ranges in (1, 7, 64, 5000):
        rows = ngram_join.packed(keys, ranges)
        assert len({r for r, _ in rows}) == len(rows) <= ranges
        found, row = ngram_join.unpacked(np.array([r for r, _ in rows]), [k for _, k in rows])
        assert len(found) == 500 and len(set(found.tolist())) == 480
        low = {int(k) & (1 << ngram_join.LOW_BITS) - 1 for k in keys}
        assert {int(k) & (1 << ngram_join.LOW_BITS) - 1 for k in found} == low
        back.append(len(row))
    assert ngram_join.packed(np.empty(0, np.int64), 64) == [] and back == [500] * 4


def test_bulk_comparison_marks_what_pairs_mark():
    """Tiles of several sizes, sets of several widths: the same marks as one pair after the other."""
    rng = np.random.default_rng(4)
    sets, begins, inside = [], [], []
    for size in (1, 2, 5, 40, 3):
        begins.append(len(sets))
        base = rng.integers(0, 2**63, int(rng.integers(20, 900)), dtype=np.uint64)
        for _ in range(size):
            kept = base[rng.random(len(base)) < rng.choice([0.5, 0.93])]
            sets.append(np.unique(np.r_[kept, rng.integers(0, 2**63, len(base) // 30, dtype=np.uint64)]))
            inside.append(int(rng.integers(0, 4)))
    bits = np.empty(len(sets), object)
    bits[:] = [ngram_join.bitmap(s) for s in sets]
    sizes, inside = np.array([len(s) for s in sets]), np.array(inside)
    marked = ngram_join.near_rows(bits, sizes, inside, np.array(begins), 80)
    want = np.zeros(len(sets), bool)
    for begin, end in zip(begins, [*begins[1:], len(sets)]):
        width = min(len(b) for b in bits[begin:end])
        for i in range(begin, end):
            for j in range(i + 1, end):
                a, b = (ngram_join.folded(bits[k].view(np.uint64), width) for k in (i, j))
                total, differ = sizes[i] + sizes[j], int(np.bitwise_count(a ^ b).sum())
                if inside[i] != inside[j] and 100 * (total - differ) / 2 >= 80 * (total - (total - differ) / 2):
                    want[i] = want[j] = True
    assert (marked == want).all() and 0 < want.sum() < len(want)


def test_kernel_against_plain_subsequences():
    """Cosines of the hashed features are those of all subsequences of three characters within the span."""
    def plain(s):
        out = {}
        for i in range(len(s)):
            for j in range(i + 1, min(i + toxicity.SPAN, len(s))):
                for k in range(j + 1, min(i + toxicity.SPAN, len(s))):
                    key = s[i] + s[j] + s[k]
                    out[key] = out.get(key, 0.0) + 0.5 ** (k - i + 1 - 3)
        return out

    many = ["^idiot$", "^idiiot$", "^xixdxixoxtx$", "^fool$", "^aaaaa$", "^łódź$"]
    row, slot, weight = toxicity.Features(0.5)(many)
    vectors = np.zeros((len(many), toxicity.SLOTS))
    vectors[row, slot] = weight
    for i, a in enumerate(map(plain, many)):
        for k, b in enumerate(map(plain, many)):
            dot = sum(v * b.get(key, 0.0) for key, v in a.items())
            cosine = dot / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
            assert abs(vectors[i] @ vectors[k] - cosine) < 1e-5
    assert vectors[0] @ vectors[1] > 0.5 > vectors[0] @ vectors[3]


def test_copies_are_folded_before_strings_are_counted():
    rng = random.Random(2)
    bags = [{f"w{rng.randrange(10_000)}" for _ in range(60)} for _ in range(50)]
    copy = set(bags[3])
    near = set(sorted(bags[4])[:-3]) | {"new"}
    found = toxicity.first_of_copies([*bags, copy, near, set(), set()])
    assert found[:50] == bags and found[50] is None and found[51] is None and found[52:] == [set(), set()]


def test_strings_beyond_chance():
    counts = np.array([[0, 0, 500, 40, 3], [30, 2, 60, 4, 40]], float)
    assert toxicity.beyond_chance(counts, np.array([4000, 500])).tolist() == [True, False, False, False, True]


def test_boundary_stands_between_held_out_documents():
    highest, labels = np.array([-1.0, -0.5, 0.1, 0.9, 1.1, 1.2]), np.array([0, 0, 0, 1, 1, 1])
    assert 0.1 < toxicity._boundary(highest, labels) < 0.9


def test_secret_scan_keeps_columns_of_its_own_names(docs, spark):
    rows = docs([(i, f"token = 'a{i}B7xQ9zK4mW2pL8vN{i}' and version = 1.2.{i}00000 of word{i % 3} again again") for i in range(60)])
    found = secrets.candidates(rows.withColumn("path", F.lit("p"))).withColumns(
        {c: F.lit(c) for c in ("prediction", "rawPrediction", "probability", "vector", "draw", "count")})
    model = secrets.fit(secrets.evidence(found))
    judged = secrets.scan(found, model)
    row = judged.first()
    assert (row["prediction"], row["rawPrediction"], row["vector"], row["draw"]) == ("prediction", "rawPrediction", "vector", "draw")
    assert 0 <= row["probability"] <= 1 and judged.filter("secret").count() >= 60


def test_dictionary_takes_whole_classes_of_frequency(docs):
    rows = docs([(0, "often often twice onea"), (1, "often twice oneb"), (2, "often onec")])
    assert secrets.dictionary(rows, documents=1, most=2) == {"often", "twice"}
    assert secrets.dictionary(rows, documents=1, most=4) == {"often", "twice"}
    assert secrets.dictionary(rows, documents=1, most=9) == {"often", "twice", "onea", "oneb", "onec"}
    assert secrets.dictionary(rows, documents=100) == frozenset()


def plain_posterior(rows, model, strength=8.0, trust=0.5):
    """(language, probability) of (text, host, declared) rows: likelihood, priors by host and its parts, markup."""
    k = len(model.languages)
    logs = [np.asarray(model.likelihood(t or ""), float) for t, _, _ in rows]
    own = [np.exp(x) / np.exp(x).sum() for x in logs]
    total = np.sum(own, axis=0)

    def names(host, declared):
        parts = host.split(".") if host is not None else None
        return {"host": host, "domain": ".".join(parts[-2:]) if parts else None, "suffix": parts[-1] if parts else None,
                "declared": declared}

    keys = [names(h, d) for _, h, d in rows]
    sums = {}
    for key, x in zip(keys, own):
        for name, value in key.items():
            if value is not None:
                sums[name, value] = sums.get((name, value), 0) + x
    out = []
    for key, log, x in zip(keys, logs, own):
        share = (total - x + 1) / (total.sum() - 1 + k)
        for name in ("suffix", "domain", "host"):
            if key[name] is not None:
                held = sums[name, key[name]]
                share = (np.maximum(held - x, 0) + strength * share) / (max(held.sum() - 1, 0) + strength)
        said = 0.0
        if key["declared"] is not None:
            said = np.log((np.maximum(sums["declared", key["declared"]] - x, 0) + trust) / (total + k * trust))
        post = log + np.log(share) + said
        p = np.exp(post - post.max()) / np.exp(post - post.max()).sum()
        out.append((model.languages[int(np.argmax(p))], float(p.max())))
    return out


def test_language_posterior_and_clashing_names(docs, spark):
    known = [(i, t, lang, "s", 0) for i, (t, lang) in enumerate(
        [("the house on the hill", "en"), ("das haus auf dem berg", "de"), ("la casa en la colina", "es")] * 9)]
    model = language_id.fit_text(docs(known))
    rng = random.Random(6)
    words = "the das la house haus casa hill berg on auf en zzz".split()
    rows = [(" ".join(rng.choices(words, k=rng.randrange(5))) or None, rng.choice(["a.b.de", "x.de", "c.com", "b.de", "lone", None]),
             rng.choice(["de", "en", "xx", None])) for _ in range(120)]
    rows += [rows[0]] * 40 + [("berg haus " * 20_000, "x.de", "de")]
    own = ("w", "own", "log", "share", "said", "post", "suffix", "domain", "host_sums", "_host", "s0")
    frame = spark.createDataFrame([(i, *x, "old") for i, x in enumerate(rows)],
                                  "page_id int, text string, host string, declared string, lang string").withColumns(
        {c: F.lit(f"own {c}") for c in own})
    found = language_id.identify(frame, model)
    assert found.columns == ["page_id", "host", "declared", *own, "lang", "probability", "text_lang"]
    got = {r["page_id"]: r for r in found.collect()}
    for i, (language, probability) in enumerate(plain_posterior(rows, model)):
        assert abs(got[i]["probability"] - probability) < 1e-9 and all(got[i][c] == f"own {c}" for c in own)
        assert got[i]["lang"] == language or abs(probability - 0.5) < 1e-9

"""Quality rules, line dedup, mixing and URL filter against plain Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docquorum.llm import line_dedup, mixing, quality_rules, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered), failed)


def test_base_counts(odd, docs):
    r = random.Random(1)
    made = [(100 + i, "\n".join(" ".join(r.choice("a b c dd # ee* f| ggg").replace(" ", "x") for _ in range(r.randint(0, 30)))
                                for _ in range(r.randint(1, 8)))) for i in range(60)]
    for frame in (odd, docs(made)):
        found = quality_rules.clean(frame).select(
            "text", *(f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")))
        for row in found.collect():
            assert tuple(row)[1:] == base_counts(row["text"])


def test_line_rules(docs, nothing):
    prose = " ".join(f"w{i}, said he." for i in range(30))
    text = "\n".join([prose, "a | b | c | d", "HEY!! YOU!! THERE!!", "Read more", "All rights reserved.", "", "un mot"])
    quality = quality_rules.clean(docs([(1, text)])).first()["quality"]
    assert quality["clean_text"] == "\n".join([prose, "", "un mot"]) and quality["kept"]
    assert quality["failed"].asDict() == {
        "symbols": 1, "shouting": 1, "navigation": 1, "boilerplate": 1, "repetition": 0, "punctuation": 0}
    junk = "\n".join([" ".join(f"x{i} |" for i in range(40)), " ".join(f"y{i}." for i in range(20))])
    assert not quality_rules.clean(docs([(1, junk)])).first()["quality"]["kept"]
    assert quality_rules.clean(nothing).count() == 0
    clash = docs([(1, prose)]).withColumn("quality", F.lit("mine")).withColumn("quality_lines", F.lit(1))
    assert quality_rules.clean(clash).first()["quality"]["kept"]


def repeated(rows, least):
    """Lines in a run of enough words that occurred before, by comparing all runs; blank lines inside go along."""
    seen, out = set(), {}
    table = {}
    for doc in sorted(rows, key=lambda d: (d[0] is not None, d[0])):
        table[doc[0]] = [(i, x.strip(" \t\x0b\x0c\r"), len(WORD.findall(x))) for i, x in enumerate((doc[1] or "").split("\n")) if WORD.search(x)]
    for name, lines in table.items():
        gone = set()
        first_here = {}
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(n for _, _, n in lines[a:b + 1]) < least:
                    continue
                key = tuple(x for _, x, _ in lines[a:b + 1])
                if key in seen:
                    gone |= set(range(lines[a][0], lines[b][0] + 1))
                elif key in first_here:
                    gone |= set(range(max(lines[a][0], first_here[key] + 1), lines[b][0] + 1))
                else:
                    first_here[key] = lines[b][0]
        seen |= first_here.keys()
        if gone:
            out[name] = sorted(gone)
    return out


def test_line_dedup_equals_all_runs(docs):
    r = random.Random(2)
    pool = [" ".join(f"{c}{k}" for k in range(n)) for c, n in zip("abcdefgh", (1, 3, 4, 5, 6, 9, 12, 2))]
    runs = [[r.choice(pool) for _ in range(r.randint(1, 6))] for _ in range(5)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(r.randint(0, 4)):
            lines += r.choice(runs) if r.random() < 0.6 else [" ".join(f"u{i}{r.random()}" for _ in range(r.randint(1, 12)))]
            if r.random() < 0.3:
                lines.append("")
        rows.append((i, "\n".join(lines)))
    found = line_dedup.repeated_lines(docs(rows), min_words=10, shingle_words=5)
    assert {x["doc_id"]: x["repeated"] for x in found.collect()} == repeated(rows, 10)


def test_line_dedup_deletes_long_passages(docs, odd, nothing):
    passage = " ".join(f"shared{i}" for i in range(51))
    rows = [(i, f"own line {i}\n{passage}\nlast line {i}") for i in range(30)]
    found = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(rows)).collect()}
    assert found[0] == rows[0][1]
    assert all(found[i] == f"own line {i}\nlast line {i}" for i in range(1, 30))
    same = line_dedup.dedup_lines(odd.withColumn("repeated", F.lit("x")))
    assert sorted(map(str, same.select("doc_id", "text").collect())) == sorted(map(str, odd.select("doc_id", "text").collect()))
    assert same.columns == odd.columns + ["repeated"] and line_dedup.dedup_lines(nothing).count() == 0


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    capped = set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and left * weight[s] >= most * sizes[s] * free}
        if not over:
            return {s: float(most * sizes[s]) if s in capped else left * weight[s] / free for s in names}
        capped |= over


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_meets_its_targets(docs, odd, seed):
    r = random.Random(seed)
    rows = [(i, " ".join(["w"] * r.randint(0, 40)), "en", r.choice(["a", "a", "a", "B", "é", "zz", None]), 0) for i in range(300)]
    for frame in (docs(rows), odd):
        found = [(x["source"], *x["mix"]) for x in mixing.mix(frame).collect()]
        again = [(x["source"], *x["mix"]) for x in mixing.mix(frame.repartition(3)).collect()]
        assert sorted(found, key=str) == sorted(again, key=str)
        sizes = Counter()
        for source, size, *_ in found:
            sizes[source] += size
        want = plain_targets(sizes)
        for name in sizes:
            mine = [x for x in found if x[0] == name]
            assert all(x[2] == sizes[name] and x[3] == pytest.approx(want[name]) and 0 <= x[4] <= 3 * x[1] for x in mine)
            ties = len(mine) - len({x[1:] for x in mine})
            assert abs(sum(x[4] for x in mine) - want[name]) <= 1 + ties


def test_mix_of_nothing(nothing, docs):
    assert mixing.mix(nothing).count() == 0
    assert [tuple(x["mix"])[3] for x in mixing.mix(docs([(1, None), (2, "")])).collect()] == [0, 0]


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
         ("block", "com", "/de/"), ("allow", "a.b.com", "/de/x"), ("block", "a.b.com", "/de/x")]


def plain_verdict(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fits = [(h.count("."), len(p), v == "block", h + p, v) for v, h, p in RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


def test_url_filter(spark):
    r = random.Random(3)
    urls = [None, "", "no scheme", "http://", "HTTP://X.Example.ORG/en/12?q=/es/", "a://b://c.org/x", "http://org", "http://org/"]
    for _ in range(300):
        urls.append("https://" + r.choice(["", "m.", "x.y."]) + r.choice(["example.org", "com", "a.b.com", "notexample.org", "org.net", "B.com"])
                    + r.choice(["", "/", "/es", "/es/", "/es/a", "/en/1", "/en/10/x", "/en/2", "/fr/", "/de/", "/de/x", "/de/xy/z", "//de/"])
                    + r.choice(["", "?a=/de/", "#/de/"]))
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, url_filter string")
    rules = [url_filter.Rule(*x) for x in RULES]
    for size in (url_filter.MAX_BYTES, 100):  # in one trie, and cut into several
        found = {x["page_id"]: tuple(x["url_filter"]) for x in url_filter.judge(pages, rules, max_bytes=size).collect()}
        assert found == {i: plain_verdict(u) for i, u in enumerate(urls)}
    assert url_filter.judge(pages.limit(0), rules).count() == 0

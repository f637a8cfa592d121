"""The manifest against a plain recomputation; proofs of single leaves; odd rows."""

import hashlib

from pyspark.sql import functions as F

from docquorum.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def frame(value):
    return "-" if value is None else f"{len(str(value).encode('utf-8'))}:{value}"


def climb(digests):
    """(root, proof as (left, right) per level for every leaf) of a run of digests."""
    nodes, paths, at = list(digests), [[] for _ in digests], list(range(len(digests)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = nodes[i // 16 * 16:i // 16 * 16 + 16]
            paths[leaf].append(("".join(run[:i % 16]), "".join(run[i % 16 + 1:])))
        nodes = [sha("".join(nodes[i:i + 16])) for i in range(0, len(nodes), 16)]
        at = [i // 16 for i in at]
    return nodes[0], paths


def expected(rows, tamper):
    """Sorted (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows like documents."""
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf = sha("".join(map(frame, (doc_id, source, lang, n_chars, text))))
        shown = sha("".join(map(frame, (doc_id, source, lang, n_chars, tamper(doc_id, text)))))
        groups.setdefault(source, []).append((doc_id, leaf, shown))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode("utf-8")))
    for group in groups.values():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {s: climb([leaf for _, leaf, _ in groups[s]]) for s in order}
    root, tops = climb([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for (doc_id, leaf, shown), path in zip(groups[s], trees[s][1]):
            whole = path + top
            for left, right in whole:
                shown = sha(left + shown + right)
            out.append((doc_id, leaf, trees[s][0], root, sha("".join(a + b for a, b in whole)), shown, shown == root))
    return sorted(out, key=repr)


def lowered(doc_id, text):
    return text if text is None or doc_id is None or doc_id % 3 else "".join(
        c.lower() if "A" <= c <= "Z" else c for c in text)


def found(docs):
    tampered = F.when(F.col("doc_id") % 3 == 0, F.translate(
        "text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    return sorted(map(tuple, merkle.verify(docs, tampered).collect()), key=repr)


def test_against_brute_force(docs):
    """Groups of 1, 16, 17, 256, 257 and 600 leaves, and more than 16 groups, so that depths differ."""
    rows, n = [], 0
    for group, size in (("a", 1), ("b", 16), ("c", 17), (None, 256), ("ü", 257), ("z", 600), *((f"s{i}", i) for i in range(1, 15))):
        for _ in range(size):
            n += 1
            rows.append((n * 7 % 10_007, f"Text {n} É" + "x" * (n % 50), "en", group, n))
    assert found(docs(rows)) == expected(rows, lowered)


def test_odd_rows(odd, docs):
    rows = [tuple(r) for r in odd.collect()]
    assert found(odd) == expected(rows, lowered)
    crowded = odd.select("*", *(F.lit(1).alias(c) for c in ("key", "rank", "digest", "order", "leaf", "n", "at", "path")))
    assert found(crowded) == found(odd)


def test_repeated_rows_and_one_row(docs):
    rows = [(5, "Same", "en", "s", 4)] * 700 + [(6, "Other", "en", "s", 5)]
    assert found(docs(rows)) == expected(rows, lowered)
    assert found(docs(rows[-1:])) == expected(rows[-1:], lowered)


def test_empty_table(nothing):
    result = merkle.verify(nothing)
    assert result.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert result.collect() == []


def test_single_requests_and_stored_records(docs):
    rows = [(i, f"text {i}", "en", "big" if i < 300 else f"s{i}", i) for i in range(320)]
    manifest = merkle.build(merkle.document_leaves(docs(rows)))
    asked = manifest.leaves.filter("order in (0, 17, 299, 310)").select(
        "key", "rank", "digest", F.lit("kept").alias("children")).withColumnRenamed("digest", "mine")
    absent = asked.limit(1).withColumns({"key": F.lit("sbig"), "rank": F.lit(300).cast("long")})
    proven = merkle.prove(manifest, asked.union(absent)).withColumn("root", merkle.folded(F.col("mine"), F.col("path"))).collect()
    assert len(proven) == 4 and {r["root"] for r in proven} == {manifest.root}
    assert all(r["digest"] == r["mine"] and r["children"] == "kept" for r in proven)
    records = manifest.records(merkle.GROUPS, 1).collect()
    assert all(r["digest"] == sha("".join(r["children"])) for r in records)
    assert len({r["digest"] for r in records}) == len(records) == 19
    assert merkle.prove(manifest, asked.limit(0)).collect() == []

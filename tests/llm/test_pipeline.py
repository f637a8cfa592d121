"""The stages on a small corpus with planted cases, and the registered queries on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docquorum.llm.catalogue import QUERIES

SF_DIR = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the driver's tables")


def words(tag, n):
    return " ".join(f"{tag}{k}" + ("." if k % 10 == 9 else "") for k in range(n))


def test_stages_act(spark, docs, tmp_path):
    item = words("item", 40)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    passage, near = words("passage", 60), words("near", 200)
    rows = [
        (1, words("clean", 120)), (2, "too short"), (3, " | ".join(words("table", 120).split())), (4, None),
        (5, words("fifth", 80) + "\n" + passage), (6, words("sixth", 80) + "\n" + passage),
        (7, near), (8, near.replace("near55 ", "far55 ")), (9, words("ninth", 70) + " " + item), (10, words("clean", 120)),
    ]
    at, kept = docs(rows), {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        kept[name] = {x["doc_id"]: x["text"] for x in at.collect()}
        if name != "mixing":
            assert at.columns == docs([]).columns
    assert set(kept["quality_rules"]) == {1, 5, 6, 7, 8, 9, 10}
    assert set(kept["line_dedup"]) == {1, 5, 6, 7, 8, 9} and passage not in kept["line_dedup"][6]
    assert set(kept["ngram_join"]) == {1, 5, 6, 7, 9}
    assert set(kept["decontamination"]) == {1, 5, 6, 7}
    assert set(kept["mixing"]) <= {1, 5, 6, 7}


def test_stages_of_nothing(spark, nothing, odd, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0
        assert stage(spark, odd, str(tmp_path)).count() <= odd.count()


def test_stages_keep_columns_of_the_operators_names(spark, docs, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = ("repeated", "quality", "size", "taken", "mix", "target", "doc", "node", "key", "row", "copies", "label", "bits", "first")
    plain = docs([(i, words(f"w{i}x", 120)) for i in range(8)])
    crowded = plain.drop("n_chars").withColumns({c: F.lit(f"own {c}") for c in names})
    for name, stage in corpus_pipeline.STAGES:
        want = {r["doc_id"]: r["text"] for r in stage(spark, plain, str(tmp_path)).collect()}
        got = stage(spark, crowded, str(tmp_path))
        assert len(set(got.columns)) == len(got.columns)
        rows = got.collect()
        assert {r["doc_id"]: r["text"] for r in rows} == want and len(want) > 0
        if name != "mixing":
            assert got.columns == crowded.columns and all(r[c] == f"own {c}" for r in rows for c in names)
        else:
            assert all(r["repeated"] == "own repeated" and r["size"] == 120 for r in rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, plain.select("doc_id", "text", "source"), str(tmp_path)).count() > 0


@tables
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() >= (0 if name in ("op2_secret_scan", "op4_decontamination") else 1)

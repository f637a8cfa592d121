"""Reply chunks, long files, batches, dependency graphs and streams."""

import json
import random

import pytest
from rows import column
from pyspark.sql import functions as F

from docquorum.operators import chunks as ch
from docquorum.operators import graph as g
from docquorum.operators import relationships as rel
from docquorum.operators import state as s
from docquorum.sources.state_store import StateStore
from docquorum.streaming import arrivals

LINES = "request_id long, seq long, line string"


def data(token):
    return "data: " + json.dumps({"choices": [{"delta": {"content": token}}]})


def texts(df):
    return {r["request_id"]: r["text"] for r in df.collect()}


def test_data_style(spark):
    rows = [
        (1, 0, data("a")), (1, 1, ": ping"), (1, 2, "data: {broken"), (1, 3, data("b")), (1, 4, "data: [DONE]"), (1, 5, data("late")),
        (2, 0, data("")), (2, 1, 'data: {"choices": []}'), (2, 2, data("x") + " y"), (2, 3, data("ok")), (3, 0, ""), (4, 1, "data:  [DONE] "), (4, 2, data("z")),
    ]
    random.Random(1).shuffle(rows)
    assert texts(ch.decode_chunks(spark.createDataFrame(rows, LINES), "data")) == {1: "ab", 2: "ok", 3: "", 4: ""}


def test_line_style(spark):
    def line(token, done=False):
        return json.dumps({"message": {"content": token}, "done": done})

    rows = [(1, 0, line("a")), (1, 1, "junk"), (1, 2, line("b", True)), (1, 3, line("late")), (2, 0, '{"done": false}'), (2, 1, line("c"))]
    assert texts(ch.decode_chunks(spark.createDataFrame(rows, LINES), "lines")) == {1: "ab", 2: "c"}
    with pytest.raises(ValueError):
        ch.parse_chunks(spark.createDataFrame(rows, LINES), "other")


@pytest.mark.parametrize("block", [1, 3, 64, 4096])
def test_one_request_with_most_chunks(spark, block):
    rows = [(7, i, data(f"{i},")) for i in range(400)] + [(7, 300, "data: [DONE]")] + [(i, 0, data("x")) for i in range(20) if i != 7]
    rows.remove((7, 300, data("300,")))
    random.Random(2).shuffle(rows)
    found = texts(ch.decode_chunks(spark.createDataFrame(rows, LINES).repartition(6), "data", block))
    assert found.pop(7) == "".join(f"{i}," for i in range(300))
    assert set(found.values()) == {"x"} and len(found) == 19


def test_complete_reply(spark):
    rows = spark.createDataFrame([('{"message": {"content": "hi"}}', '{"choices": [{"message": {"content": "yo"}}]}')], "l string, d string")
    assert tuple(rows.select(ch.complete_reply(F.col("l"), "lines"), ch.complete_reply(F.col("d"), "data")).first()) == ("hi", "yo")


def test_streamed_chunks_match_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i % 5, i, data(f"t{i} ") if i < 40 else "data: [DONE]") for i in range(50)], LINES)
    for n in range(3):
        rows.filter(F.col("seq") % 3 == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    arrivals.stream_chunks(stream, "data", str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    assert texts(arrivals.streamed_replies(spark, str(tmp_path / "out"))) == texts(ch.decode_chunks(rows, "data"))


def test_arrivals_are_tracked_once(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "state"))
    store.commit(s.pending_rows(spark.createDataFrame([("a",)], "path string")))
    for names in (["a", "b"], ["b", "c"]):
        spark.createDataFrame([(n,) for n in names], "path string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema("path string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        arrivals.track_arrivals(stream, store, str(tmp_path / "progress"), compact_every=1).awaitTermination()
    assert sorted(column(store.jobs(), "file_path")) == ["a", "b", "c"]


@pytest.mark.parametrize("n, size, overlap", [(1, 4, 1), (4, 4, 1), (5, 4, 1), (10, 4, 1), (11, 4, 3), (9, 3, 0), (2, 5, 4)])
def test_line_chunks_cover_the_text(spark, n, size, overlap):
    lines = [f"l{i}" for i in range(n)]
    rows = g.chunk_lines(spark.createDataFrame([("p", "\n".join(lines))], "path string, text string"), size, overlap).orderBy("chunk_no").collect()
    rebuilt = []
    for row in rows:
        part = row["text"].split("\n")
        assert len(part) == row["n_lines"] <= size and part == lines[row["first_line"] - 1:][:len(part)]
        rebuilt += part if not rebuilt else part[overlap:]
    assert rebuilt == lines
    with pytest.raises(ValueError):
        g.chunk_lines(None, 3, 3)


def test_merged_chunk_records(spark):
    first = {"purpose": "", "imports": ["os", "re"], "key_functions": [{"name": "f", "purpose": "x"}], "dependencies": {"imports_from": ["m"]}}
    second = {"purpose": "reads", "imports": ["re", "io"], "key_functions": [{"name": "f", "purpose": "x"}, {"name": "g", "purpose": "y"}], "side_effects": "none"}
    rows = spark.createDataFrame([("p", 1, json.dumps(second)), ("p", 0, json.dumps(first)), ("q", 0, "{}")], "path string, chunk_no int, result string")
    merged = {r["path"]: r for r in g.merge_chunk_records(rows).collect()}
    row = merged["p"]
    assert (row["purpose"], row["imports"], row["side_effects"]) == ("reads", ["os", "re", "io"], "none")
    assert [f["name"] for f in row["key_functions"]] == ["f", "g"] and row["dependencies"]["imports_from"] == ["m"]
    assert set(merged) == {"p", "q"} and merged["q"]["imports"] == []


def test_batches_of_a_dominant_module(spark):
    names = [f"big/f{i:05d}" for i in range(3000)] + [f"m{i}/x" for i in range(30)] + ["root.txt"]
    rows = spark.createDataFrame([(n, "t" * 8) for n in names], "path string, text string").repartition(9)
    found = {}
    for r in rel.module_batches(rows, 50).collect():
        found.setdefault((r["module"], r["batch"]), []).append(r["path"])
    big = sorted(n for n in names if n.startswith("big/"))
    assert [sorted(found[("big", b)]) for b in range(60)] == [big[i:i + 50] for i in range(0, 3000, 50)]
    assert found[(".", 0)] == ["root.txt"] and sum(map(len, found.values())) == len(names)
    sizes = rel.batch_sizes(rel.module_batches(rows, 50)).filter("module = 'big'").collect()
    assert {r["files"] for r in sizes} == {50} and {r["tokens"] for r in sizes} == {100}


def test_relationship_prompts(spark):
    rows = spark.createDataFrame([(f"m/f{i}", f"text {i}") for i in (2, 0, 1)], "path string, text string")
    prompts = rel.relationship_prompts(rows, None, 2).orderBy("batch").collect()
    assert len(prompts) == 2 and prompts[0]["prompt"].endswith("text 0\ntext 1") and prompts[1]["prompt"].endswith("text 2")


@pytest.mark.parametrize("hot_rows", [10, 10**9])
def test_edges_with_a_popular_import(spark, hot_rows):
    rows = [("lib/util.py", []), ("pkg/__init__.py", ["./lib/util.py"])] + [(f"m{i % 7}/f{i}.py", ["lib.util", "numpy", "pkg"]) for i in range(300)]
    edges = g.dependency_edges(spark.createDataFrame(rows, "path string, imports_from array<string>"), hot_rows).collect()
    assert len(edges) == 1 + 900
    target = {"lib.util": "lib/util.py", "./lib/util.py": "lib/util.py", "pkg": "pkg/__init__.py", "numpy": None}
    assert all(e["dst_path"] == target[e["target"]] for e in edges)
    assert all(e["cross_module"] == (e["dst_path"] is not None) for e in edges)
    counts = {(r["src_module"], r["dst_module"]): r["edges"] for r in g.module_imports(
        g.dependency_edges(spark.createDataFrame(rows, "path string, imports_from array<string>"), hot_rows)).collect()}
    assert counts[("pkg", "lib")] == 1 and counts[("m0", "lib")] == 43


def on_cycles(edges):
    reach = {}
    nodes = {n for e in edges for n in e}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            at = todo.pop()
            for a, b in edges:
                if a == at and b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[n] = seen
    return {n: min(m for m in reach[n] if n in reach[m]) for n in nodes if n in reach[n]}


@pytest.mark.parametrize("edges", [
    [("a", "b"), ("b", "c")],
    [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("x", "a")],
    [("b", "z"), ("z", "b"), ("z", "a"), ("a", "c"), ("c", "d"), ("d", "c")],
    [("s", "s"), ("s", "t")],
])
def test_cycles(spark, edges):
    found = g.circular_dependencies(spark.createDataFrame(edges, "src string, dst string"))
    assert {r["node"]: r["cycle_id"] for r in found.collect()} == on_cycles(edges)


@pytest.mark.parametrize("seed, hot_rows", [(0, 10**6), (1, 3)])
def test_cycles_of_random_graphs(spark, seed, hot_rows):
    """The second graph has a hub with a third of all edges, treated as hot."""
    rng = random.Random(seed)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(40)]
    edges += [(7, rng.randrange(40)) for _ in range(20 * seed)]
    found = g.circular_dependencies(spark.createDataFrame(edges, "src long, dst long"), hot_rows)
    assert {r["node"]: r["cycle_id"] for r in found.collect()} == on_cycles(edges)


def test_changed_files(spark):
    def content(**files):
        return spark.createDataFrame([(k, bytearray(v.encode())) for k, v in files.items()], "path string, content binary")

    before = content(a="1", b="2").select("path", F.sha2("content", 256).alias("content_hash"))
    found = {r["path"]: r["change"] for r in g.changed_files(before, content(a="1", b="3", c="4")).collect()}
    assert found == {"b": "changed", "c": "new"}


def test_flagged_prompts(spark):
    rows = spark.createDataFrame(
        [("a", "flagged", '{"x":1}', None, None, "why"), ("b", "complete", None, None, None, None)],
        "file_path string, status string, pass1_result string, pass2_result string, quorum_result string, error_log string",
    )
    prompt = g.flagged_prompts(rows).collect()
    assert len(prompt) == 1 and "why" in prompt[0]["prompt"] and '{"x":1}' in prompt[0]["prompt"] and "Second" not in prompt[0]["prompt"]


def test_long_rings_take_few_rounds(spark, monkeypatch):
    """A ring of 1,000 nodes with a long detour and a tail: rounds follow the digits of the length, tables are removed."""
    from docquorum import session

    writes, drops = [], []
    write, drop = session.Scratch.write, session.Scratch.drop
    monkeypatch.setattr(session.Scratch, "write", lambda self, df: writes.append(1) or write(self, df))
    monkeypatch.setattr(session.Scratch, "drop", lambda self, *tables: drops.extend(tables) or drop(self, *tables))
    ring = [(i, (i + 1) % 1000) for i in range(1000)]
    detour = [(10, 2000), *((i, i + 1) for i in range(2000, 2300)), (2300, 500)]
    apart = [(5000 + i, 5000 + (i + 1) % 37) for i in range(37)]
    tail = [(7, 9000), *((i, i + 1) for i in range(9000, 9005))]
    edges = ring + detour + apart + tail
    found = g.circular_dependencies(spark.createDataFrame(edges, "src long, dst long").repartition(4))
    want = {**{i: 0 for i in range(1000)}, **{i: 0 for i in range(2000, 2301)}, **{5000 + i: 5000 for i in range(37)}}
    assert {r["node"]: r["cycle_id"] for r in found.collect()} == want
    assert len(writes) <= 45 and len(drops) >= len(writes) - 12

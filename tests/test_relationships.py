"""Batches under a token bound, imports of every kind, and the tree of prompts."""

import json
import random
import re
import sys

import pytest
from pyspark import cloudpickle

from docquorum.operators import graph as g
from docquorum.operators import relationships as rel

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def greedy(rows, files, most):
    """{order: batch} of sorted (order, tokens) rows."""
    out, batch, held, count = {}, 0, 0, 0
    for n, (order, tokens) in enumerate(sorted(rows)):
        if n and (count >= files or held + tokens > most):
            batch, held, count = batch + 1, 0, 0
        out[order], held, count = batch, held + tokens, count + 1
    return out


@pytest.mark.parametrize("seed, block_rows, together", [(0, 10_000, 1_000), (1, 9, 2), (2, 7, 3), (3, 50, 1_000)])
def test_packing_across_blocks(spark, seed, block_rows, together):
    """A group of two thirds of all rows, tiny groups, rows above the bound; blocks so small that levels are needed."""
    rng = random.Random(seed)
    sizes = {"big": 300, "mid": 60, "one": 1, "two": 2, "edge": block_rows if block_rows < 100 else 5}
    rows = [(m, f"f{i:04d}", rng.choice([0, 1, 3, 10, 40])) for m, n in sizes.items() for i in range(n)]
    table = spark.createDataFrame(rows, "module string, path string, tokens long").repartition(5)
    found = rel.packed_batches(table, "module", "path", 6, 30, block_rows, together).collect()
    assert len(found) == len(rows)
    for module in sizes:
        own = {r["path"]: r["batch"] for r in found if r["module"] == module}
        assert own == greedy([(p, t) for m, p, t in rows if m == module], 6, 30)


def test_packing_nothing(spark):
    none = spark.createDataFrame([], "module string, path string, tokens long")
    assert rel.packed_batches(none, "module", "path").collect() == []


FILES = [
    ("src/pkg/mod.py", ["./util", "..top", ".util", "other.thing", "pkg.deep.leaf", "json", "util"]),
    ("src/pkg/util.py", ["../top", "../../lib/a", "../../../out", "src.pkg.mod", "pkg.mod.func", "mod.func"]),
    ("src/top.py", ["pkg", "pkg.util", "helpers", "twice.same", "pkg/mod.py"]),
    ("src/pkg/__init__.py", [None, "", "."]), ("src/pkg/deep/leaf.py", ["...top", "..util.read"]), ("lib/a.js", ["./b", "./b.js"]),
    ("lib/b.js", []), ("other/thing.py", []), ("x/twice/same.py", []), ("y/twice/same.py", []), ("a/helpers.py", []),
]
RESOLVED = {
    ("src/pkg/mod.py", "./util"): "src/pkg/util.py", ("src/pkg/mod.py", ".util"): "src/pkg/util.py",
    ("src/pkg/mod.py", "..top"): "src/top.py", ("src/pkg/mod.py", "other.thing"): "other/thing.py",
    ("src/pkg/mod.py", "pkg.deep.leaf"): "src/pkg/deep/leaf.py",  # below a source folder
    ("src/pkg/mod.py", "json"): None, ("src/pkg/mod.py", "util"): "src/pkg/util.py",  # beside the importing file
    ("src/pkg/util.py", "../top"): "src/top.py", ("src/pkg/util.py", "../../lib/a"): "lib/a.js",
    ("src/pkg/util.py", "../../../out"): None,  # leads out of the tree
    ("src/pkg/util.py", "src.pkg.mod"): "src/pkg/mod.py", ("src/pkg/util.py", "pkg.mod.func"): "src/pkg/mod.py",
    ("src/pkg/util.py", "mod.func"): "src/pkg/mod.py", ("src/top.py", "pkg"): "src/pkg/__init__.py",
    ("src/top.py", "pkg.util"): "src/pkg/util.py", ("src/top.py", "helpers"): None,  # one part is no end of a path
    ("src/top.py", "twice.same"): None, ("src/top.py", "pkg/mod.py"): "src/pkg/mod.py",
    ("src/pkg/__init__.py", ""): None, ("src/pkg/__init__.py", "."): "src/pkg/__init__.py",
    ("src/pkg/deep/leaf.py", "...top"): "src/top.py", ("src/pkg/deep/leaf.py", "..util.read"): "src/pkg/util.py",
    ("lib/a.js", "./b"): "lib/b.js", ("lib/a.js", "./b.js"): "lib/b.js",
}


@pytest.mark.parametrize("hot_rows", [2, 10**9])
def test_imports(spark, hot_rows):
    rows = spark.createDataFrame(FILES, "path string, imports_from array<string>")
    found = g.dependency_edges(rows, hot_rows).collect()
    assert {(r["src_path"], r["target"]): r["dst_path"] for r in found} == RESOLVED and len(found) == len(RESOLVED)
    assert all(r["cross_module"] == (r["dst_path"] is not None and r["src_path"].split("/")[0] != r["dst_path"].split("/")[0])
               for r in found)


def test_prompts_list_imports_and_keep_the_bound(spark):
    rows = spark.createDataFrame([(f"m{i % 3}/f{i:03d}.py", "word " * (i % 9 * 40)) for i in range(90)], "path string, text string")
    imports = spark.createDataFrame(
        [(f"m{i % 3}/f{i:03d}.py", [f"m{(i + 1) % 3}.f{i + 1:03d}", f"m{i % 3}.f{i + 3:03d}"]) for i in range(80)],
        "path string, imports_from array<string>").union(rows.filter("path >= 'm2/f080'").selectExpr("path", "array()"))
    every = rows.join(imports.groupBy("path").agg({"imports_from": "first"}), "path", "left").selectExpr(
        "path", "coalesce(`first(imports_from)`, array()) imports_from")
    edges = g.dependency_edges(every)
    prompts = rel.relationship_prompts(rows, edges, 20, 700).collect()
    for r in prompts:
        assert rel.estimate(r["prompt"]) <= 700
    text = "".join(r["prompt"] for r in prompts)
    assert text.count(" -> ") == edges.filter("cross_module").count() == 80
    for r in prompts:
        listed = re.findall(r"- (\S+) -> (\S+)", r["prompt"])
        assert all(src.split("/")[0] == r["module"] != dst.split("/")[0] for src, dst in listed)


def counting():
    def chat(system, user):
        assert system == rel.SUMMARY_SYSTEM and rel.estimate(system) + rel.estimate(user) <= 400
        if user.startswith("# Module garbled"):
            return "no object"
        own = len(re.findall("(?m)^file ", user))
        return json.dumps({"summary": f"{own + sum(map(int, re.findall('(?m)^([0-9]+) files', user)))} files " + "x" * 300})
    return chat


def forbidden():
    def chat(system, user):
        raise AssertionError("asked again")
    return chat


def test_the_tree_of_prompts_ends_in_one(spark, tmp_path):
    names = [f"m{i % 40:02d}/f{i}" for i in range(120)] + ["garbled/a"]
    rows = spark.createDataFrame([(n, f"file {n}") for n in names], "path string, text string")
    found = rel.relationship_map(rows, None, str(tmp_path / "log"), counting, 50, 400).collect()
    levels = sorted({r["level"] for r in found})
    counts = [sum(r["level"] == n for r in found) for n in levels]
    assert len(levels) >= 3 and counts[0] == 41 and counts[-1] == 1 and counts == sorted(counts, reverse=True)
    top = next(r["summary"] for r in found if r["level"] == levels[-1])
    assert top.startswith("120 files ")
    assert {r["summary"] for r in found if r["name"].startswith("garbled")} == {rel.NO_SUMMARY}
    again = rel.relationship_map(rows, None, str(tmp_path / "log"), forbidden, 50, 400).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))

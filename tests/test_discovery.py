"""Profiles, ignore rules, file selection and the two tree connectors."""

import json
import os

import pytest
from rows import column
from pyspark.sql import functions as F

from docquorum.operators import state
from docquorum.operators import discover as d
from docquorum.sources import profiles as p
from docquorum.sources import text_tree as tt
from docquorum.sources.file_tree import read_tree
from docquorum.sources.ignore import ignore_rules, ignore_table, ignored

TREE = {
    "main.py": b"print(1)\n", "utils.py": b"x = 1\n", "setup.py": b"setup()\n", "requirements.txt": b"a\n", "lib/core.py": b"pass\n",
    "lib/__init__.py": b"", "config.yaml": b"a: 1\n", "script.js": b"f()\n", "image.png": b"\x89PNG\x00", "data.py": b"a\x00b",
    ".git/config": b"x", "__pycache__/a.pyc": b"\x00", ".gitignore": b"*.log\nbuild/\n", "debug.log": b"x", "build/output.py": b"x",
    "notes.txt": b"n\n", "big.py": b"y = 1\n" * 300, ".github/workflows/ci.yml": b"on: push\n", "src/_private.py": b"p\n",
}


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "repo"
    for name, content in TREE.items():
        target = root / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content)
    return str(root)


def test_tree_has_every_file(spark, tree):
    os.symlink(os.path.join(tree, "lib"), os.path.join(tree, "linked"))
    os.symlink(os.path.join(tree, "main.py"), os.path.join(tree, "alias.py"))
    os.symlink(os.path.join(tree, "nowhere"), os.path.join(tree, "dangling.py"))
    rows = {r["path"]: r for r in read_tree(spark, tree).collect()}
    assert set(rows) == {*TREE, "alias.py", "dangling.py"}
    assert all(bytes(rows[n]["content"]) == c and rows[n]["size"] == len(c) for n, c in TREE.items())
    assert rows["dangling.py"]["size"] is None and rows["dangling.py"]["content"] is None
    bare = read_tree(spark, tree, withContent="none", pruneDirs=".git,lib")
    assert bare.filter("content IS NOT NULL").isEmpty()
    assert not any(x.startswith((".git/", "lib/")) for x in column(bare, "path"))


@pytest.mark.parametrize("target", ["1", "3", "500"])
def test_partitioning_does_not_change_the_listing(spark, tmp_path, target):
    names = {f"d{i % 5}/e{i % 3}/f{i}.txt" for i in range(120)} | {f"wide{i}.txt" for i in range(40)}
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    found = column(read_tree(spark, str(tmp_path), targetPartitions=target), "path")
    assert sorted(found) == sorted(names)


def test_one_huge_nested_folder_fills_all_tasks(spark, tmp_path):
    deep = tmp_path / "a/b/c/d"
    deep.mkdir(parents=True)
    for i in range(200):
        (deep / f"f{i}").write_text("x")
    rows = read_tree(spark, str(tmp_path), withContent="none", targetPartitions=8)
    per_task = rows.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in per_task) == 200 and len(per_task) == 8 and max(r["count"] for r in per_task) < 60


def test_every_folder_is_listed_once(spark, tmp_path, monkeypatch):
    from docquorum.sources import file_tree

    for name in ("a/x", "a/b/y", "c/z", "w"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    monkeypatch.setattr(file_tree, "LISTED_ROWS", 1)
    listed = file_tree.list_tree(spark, str(tmp_path)).collect()
    assert sorted((r["path"], r["kind"]) for r in listed) == [("a/b/y", "file"), ("a/x", "file"), ("c/z", "file"), ("w", "file")]
    assert file_tree.list_tree(spark, str(tmp_path), frozenset(["a", "c"])).count() == 1
    with pytest.raises(FileNotFoundError):
        read_tree(spark, str(tmp_path / "nowhere"))


def found_in(spark, tree, rules=None, **kw):
    files = read_tree(spark, tree)
    rules = rules or p.resolve_profiles(files)
    lines = TREE[".gitignore"].decode().splitlines()
    rows = d.discover(files, rules, ignore_rules(lines), **kw).collect()
    return [r["path"] for r in rows if r["selected"]], {r["path"]: r["skip_reason"] for r in rows if r["skip_reason"]}


def test_detected_walk(spark, tree):
    selected, skipped = found_in(spark, tree, max_file_size=1_000)
    assert selected == sorted(selected)
    assert set(selected) == {
        "main.py", "utils.py", "setup.py", "requirements.txt", "lib/core.py", "config.yaml", "big.py",
        ".github/workflows/ci.yml", "src/_private.py",
    }
    assert skipped == {
        "image.png": "binary file", "data.py": "binary file", "lib/__init__.py": "empty file",
        "big.py": "large file (1,800 bytes) — will be chunked",
    }


def test_all_text_and_named_profiles(spark, tree):
    files = read_tree(spark, tree)
    everything, _ = found_in(spark, tree, p.resolve_profiles(files, all_text_files=True))
    assert {"notes.txt", "script.js", ".gitignore"} <= set(everything) and "debug.log" not in everything
    named = p.resolve_profiles(files, "javascript, sql")
    assert found_in(spark, tree, named)[0] == ["script.js"]
    mixed = p.resolve_profiles(files, "python", all_text_files=True)
    assert mixed.all_text and "__pycache__" in mixed.exclude_dirs
    excluded, _ = found_in(spark, tree, p.resolve_profiles(files, "python"), extra_excludes=("lib/*", "main*"))
    assert "lib/core.py" not in excluded and "main.py" not in excluded and "utils.py" in excluded


def test_profile_resolution(spark):
    paths = spark.createDataFrame([("x.txt",), ("sub/setup.py",)], "path string")
    assert p.resolve_profiles(paths).names == [p.ALL_TEXT_FALLBACK]
    assert p.resolve_profiles(paths, all_text_files=True).names == [p.ALL_TEXT]
    with pytest.raises(ValueError, match="Unknown profiles: nope, bad"):
        p.resolve_profiles(paths, "python,nope,bad")
    rooted = paths.unionByName(spark.createDataFrame([("Dockerfile",), ("go.mod",)], "path string"))
    assert column(p.detect_profiles(rooted), "name") == ["config", "devops", "go", "web"]
    assert p.profiles_table(spark).count() == 12 and len(p.bundled_profiles()) == 12


def test_custom_profiles(spark, tmp_path):
    (tmp_path / "mine.yaml").write_text("name: python\nextensions: [.foo]\nmarkers: [root.foo]\n")
    (tmp_path / "bare.yaml").write_text("name: bare\n")
    custom = p.profiles_from_yaml(str(tmp_path / "mine.yaml"), str(tmp_path / "bare.yaml"))
    assert custom["bare"] == p.Profile("bare", [], [], [], [])
    paths = spark.createDataFrame([("root.foo",)], "path string")
    rules = p.resolve_profiles(paths, custom=custom)
    assert rules.names == ["config", "devops", "python", "web"] and ".foo" in rules.extensions and ".py" not in rules.extensions
    merged = p.merge_profiles(["java", "javascript"], p.bundled_profiles())
    assert merged.exclude_dirs.count("build") == 1 and merged.include_patterns[0] == "pom.xml"


@pytest.mark.parametrize("lines, path, hit", [
    (["*.log"], "a.log", True), (["*.log"], "x/a.log", True), (["*.log"], "a.log.txt", False), (["*.log"], "d.log/x", True),
    (["build/"], "build/x", True), (["build/"], "a/build/x", True), (["build/"], "build", False),
    (["/build"], "build/x", True), (["/build"], "a/build/x", False), (["a/b"], "a/b/c", True), (["a/b"], "x/a/b", False),
    (["**/c"], "a/b/c", True), (["**/c"], "c", True), (["a/**"], "a/x/y", True), (["a/**"], "a", False), (["a/**/z"], "a/z", True),
    (["a/**/z"], "a/b/c/z", True), (["a/*/z"], "a/b/c/z", False), (["doc?.txt"], "doc1.txt", True), (["doc?.txt"], "doc12.txt", False),
    (["[ab].c"], "a.c", True), (["[!ab].c"], "a.c", False), (["*.log", "!keep.log"], "keep.log", False), (["*.log", "!keep.log"], "x.log", True),
    (["!keep.log", "*.log"], "keep.log", True), (["build/", "!build/keep"], "build/keep", True), (["build/*", "!build/keep"], "build/keep", False),
    (["# *.py", "", "   "], "a.py", False), (["\\#x"], "#x", True), (["\\!x"], "!x", True), (["a b "], "a b", True), (["x\\ "], "x ", True), (["a.c"], "abc", False),
])
def test_ignore_rules(spark, lines, path, hit):
    row = spark.createDataFrame([(path,)], "path string")
    assert row.select(ignored(F.col("path"), ignore_rules(lines))).first()[0] is hit


def test_ignore_table(spark):
    table = ignore_table(spark, ignore_rules(["*.log", "!a.log", "d/"]))
    assert [(r["seq"], r["negated"], r["dir_only"]) for r in table.orderBy("seq").collect()] == [(0, False, False), (1, True, False), (2, False, True)]


def test_written_trees(spark, tmp_path):
    out = str(tmp_path / "out")
    record = json.dumps({"purpose": "p", "type": "module"})
    done = spark.createDataFrame([("src/a.py", record), ("b", record)], "path string, final_description string")
    tt.write_markdown(done, out)
    text = (tmp_path / "out/files/src/a.py.md").read_text()
    assert text.startswith("# src/a.py\n") and (tmp_path / "out/files/b.md").exists()
    jobs = spark.createDataFrame(
        [("src/a.py", "flagged", 3, '{"x": 1}', None, "broken", "why"), ("b", "complete", 0, None, None, None, None)],
        "file_path string, status string, retry_count int, pass1_result string, pass2_result string, quorum_result string, error_log string",
    )
    tt.write_flagged(jobs, out)
    history = json.loads((tmp_path / "out/flagged/src/a.py.json").read_text())
    assert history == {
        "file_path": "src/a.py", "status": "flagged", "retry_count": 3, "pass1_result": {"x": 1}, "pass2_result": None,
        "quorum_result": None, "error_log": "why",
    }
    assert list(history) == ["file_path", "status", "retry_count", "pass1_result", "pass2_result", "quorum_result", "error_log"]
    assert not (tmp_path / "out/flagged/b.json").exists()
    lines = spark.createDataFrame([(1, "b", "three"), (0, "01", "two"), (0, "00", "one")], "section int, position string, line string")
    tt.write_report(lines, f"{out}/run_report.md")
    assert (tmp_path / "out/run_report.md").read_text() == "one\ntwo\nthree\n"
    many = spark.range(5_000).selectExpr("1 section", "format_string('%05d', id) position", "concat('line ', id) line").repartition(7)
    tt.write_report(many, f"{out}/run_report.md")
    assert (tmp_path / "out/run_report.md").read_text() == "".join(f"line {i}\n" for i in range(5_000))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if "report" in p.name and not p.name.startswith(".")) == ["run_report.md"]


@pytest.mark.parametrize("path", ["../x", "/etc/x", "a/../../x", "a//b"])
def test_unsafe_targets(path):
    with pytest.raises(ValueError):
        tt.safe_target("/out", path)


def test_unreadable_folders_are_told_and_faults_raised(monkeypatch, tmp_path):
    import os

    from docquorum.sources import file_tree

    (tmp_path / "a/shut").mkdir(parents=True)
    (tmp_path / "a/x.py").write_text("x")
    real = os.scandir

    def scandir(folder, fault=PermissionError):
        if str(folder).endswith("shut"):
            raise fault(str(folder))
        return real(folder)

    monkeypatch.setattr(file_tree.os, "scandir", scandir)
    assert sorted(file_tree._entries(str(tmp_path), "a", frozenset())) == [("a/shut", "folder"), ("a/x.py", "file")]
    assert list(file_tree._entries(str(tmp_path), "a/shut", frozenset())) == [("a/shut/", "unreadable")]
    monkeypatch.setattr(file_tree.os, "scandir", lambda folder: scandir(folder, OSError))
    with pytest.raises(OSError):
        list(file_tree._entries(str(tmp_path), "a/shut", frozenset()))
    assert list(file_tree._entries(str(tmp_path), "a/gone", frozenset())) == []


def test_jobs_below_unreadable_folders_are_found(spark):
    jobs = spark.createDataFrame([("a/shut/x.py",), ("a/shut/deep/y.py",), ("a/shutter/z.py",), ("top.py",)], "file_path string")
    found = state.below_folders(jobs, spark.createDataFrame([("a/shut/",)], "path string"))
    assert {r["path"] for r in found.collect()} == {"a/shut/x.py", "a/shut/deep/y.py"}

"""Path, language, JSON and rendering expressions."""

import fnmatch
import json
import os.path

import pytest
from pyspark.sql import functions as F

from docquorum.functions import jsonx, language, paths, prompts, render


def evaluate(spark, values, expression):
    """Apply an expression over a one-column table, in input order."""
    rows = spark.createDataFrame(list(enumerate(values)), "n int, v string").coalesce(1)
    return [r["out"] for r in rows.select("n", expression(F.col("v")).alias("out")).orderBy("n").collect()]


def test_extension_follows_splitext(spark):
    names = ["a.py", "a.tar.gz", ".bashrc", "dir.d/file", "x/.env.example", "a.", "..a.B", "Makefile", "p/q.TSX", "a.b/.c"]
    expected = [os.path.splitext(name)[1].lower() for name in names]
    assert evaluate(spark, names, paths.extension) == expected


def test_basename_and_norm_path(spark):
    assert evaluate(spark, ["a/b/c.py", "c.py"], paths.basename) == ["c.py", "c.py"]
    assert evaluate(spark, ["./a/b", "a/./b", ".a"], paths.norm_path) == ["a/b", "a/./b", ".a"]
    assert evaluate(spark, [".\\a\\b"], lambda c: paths.norm_path(c, "\\")) == ["a/b"]


@pytest.mark.parametrize("pattern", [
    "*.py", "requirements*.txt", "?.c", "[abc]x", "[!abc]x", "[]x]", "[a-c]*", "a.b", "*", "[", "a[b", "*.egg-info",
    ".github/workflows/*.yml", "x+(y)", "a&&b", "[&]", "[^a]", "\\d",
])
def test_glob_follows_fnmatch(spark, pattern):
    names = [
        "a.py", "b/a.py", "requirements-dev.txt", "x.c", "ax", "dx", "]x", "bcd", "a.b", "aXb", "", "[", "a[b",
        "p.egg-info", ".github/workflows/ci.yml", ".github/workflows/x/ci.yml", "x+(y)", "a\nb", "a.py\n", "a&&b", "&", "^", "a", "\\d", "5",
    ]
    expected = [fnmatch.fnmatchcase(name, pattern) for name in names]
    assert evaluate(spark, names, lambda c: paths.glob_match(c, pattern)) == expected


def test_under_directory(spark):
    names = ["venv/a.py", "a/venv/b", "venv", "a/venvx/b", "a/x.egg-info/b", "x.egg-info"]
    hits = evaluate(spark, names, lambda c: paths.under_directory(c, "venv", "*.egg-info"))
    assert hits == [True, True, False, False, True, False]


def test_binary_checks(spark):
    assert evaluate(spark, ["a.PNG", "a.py", ".DS_Store", "x.tar.gz"], paths.is_binary_name) == [True, False, False, True]
    head = "a" * 8191
    values = ["plain", "nul\0here", head + "\0", head + "a\0", None]
    assert evaluate(spark, values, lambda c: paths.has_nul(c.cast("binary"))) == [False, True, True, False, True]


def test_decode_text(spark):
    rows = spark.createDataFrame([(bytearray(b"a\r\nb\rc\nd\xff\xc3"),), (None,)], "content binary")
    decoded = [r["t"] for r in rows.select(paths.decode_text(F.col("content")).alias("t")).collect()]
    assert decoded == [b"a\nb\nc\nd\xff\xc3".decode(errors="replace"), None]


@pytest.mark.parametrize("path, text, expected", [
    ("a.py", "", "Python"), ("a.JSX", "", "JavaScript"), ("x/a.ts", "", "TypeScript"), ("a.h", "", "C"),
    ("q.sql", "", "SQL"), ("a.R", "", "R"), ("Dockerfile", "", "Dockerfile"), ("x/Makefile", "", "Shell"),
    ("Jenkinsfile", "", "Groovy"), ("Rakefile", "", "Ruby"), ("run", "#!/usr/bin/env python3\nx", "Python"),
    ("run", "#!/bin/bash", "Shell"), ("run", "#!/usr/share/php", "Shell"), ("run", "#!/usr/bin/perl", "Perl"),
    ("run", "#!/usr/bin/env node\n", "JavaScript"), ("run", "x\n#!/bin/bash", "Unknown"), ("README", "text", "Unknown"),
    ("run", "#!/usr/bin/awk", "Unknown"), ("run", "", "Unknown"),
])
def test_detect_language(spark, path, text, expected):
    rows = spark.createDataFrame([(path, text)], "path string, text string")
    assert rows.select(language.detect_language(F.col("path"), F.col("text"))).first()[0] == expected


def test_hints(spark):
    keys = evaluate(spark, ["Kotlin", "TypeScript", "XML", "Rust", "Unknown"], language.hint_key)
    assert keys == ["java", "javascript", "config", "", ""]
    assert evaluate(spark, ["SQL", "Rust"], language.hint_text) == [language.HINTS["sql"], ""]
    assert language.snippets(spark).count() == len(set(language.HINT_KEY_OF_LANGUAGE.values()))


JSON_CASES = [
    ('{"a": 1}', {"a": 1}),
    ('```json\n{"a": 1}\n```', {"a": 1}),
    ('```\n{"a": 1}\n```', {"a": 1}),
    ('Sure!\n```json\n{"a": 1}\n```\nBye {"b": 2}', {"a": 1}),
    ('Here: {"a": {"b": [1, 2]}} done }', {"a": {"b": [1, 2]}}),
    ('{"a": "quote \\" and } brace"} tail', {"a": 'quote " and } brace'}),
    ('{"a": "fence ``` inside"}', {"a": "fence ``` inside"}),
    ('{"a": 1, "a": 2}', {"a": 2}),
    ('``````{"a": 1}', None),
    ('```no object```{"a": 1}', None),
    ("no json", None), ("", None), ('{"a": 1', None), ("{'a': 1}", None), ('{"a": [1,]}', None), ("[1, 2]", None), ("{}", {}),
]


@pytest.mark.parametrize("text, expected", JSON_CASES)
def test_extract_json(spark, text, expected):
    found = evaluate(spark, [text], lambda c: F.to_json(jsonx.extract_json(c)))[0]
    assert (json.loads(found) if found is not None else None) == expected


def test_parse_field(spark):
    values = ['{"a": 1}', "", None, "nope", '{"a": 1} x', '{"a": 1},{"b": 2}', "[1]", "3", '{"a": 1}, 0] junk',
              '{"a": 1}, "0"]', "1]", '"a", "b"', '"b"']
    found = evaluate(spark, values, lambda c: F.to_json(jsonx.parse_field(c)))
    assert found == ['{"a":1}', None, None, None, None, None, "[1]", "3", None, None, None, None, '"b"']


def test_truthiness_and_keys(spark):
    values = ["true", "false", "null", "0", "0.0", "1", '""', '"false"', "[]", "{}", "[0]", '{"a":0}']
    found = evaluate(spark, values, lambda c: jsonx.truthy(F.try_parse_json(c)))
    assert found == [bool(json.loads(v)) for v in values]
    keys = evaluate(spark, ['{"agree": null}', '{"x": 1}'], lambda c: jsonx.has_key(F.try_parse_json(c), "agree"))
    assert keys == [True, False]


def test_prompts(spark):
    rows = spark.createDataFrame([("a.py", "print(1)")], "path string, text string")
    row = prompts.with_analysis_prompt(rows).first()
    assert "Python" in row["system_prompt"] and language.HINTS["python"] in row["system_prompt"]
    assert "a.py" in row["user_prompt"] and "print(1)" in row["user_prompt"]
    pair = spark.createDataFrame([("a.py", '{"x": 1}', '{"y": 2}')], "path string, pass1 string, pass2 string")
    judge = prompts.with_judge_prompt(pair).first()
    assert '{"x":1}' in judge["user_prompt"] and '{"y":2}' in judge["user_prompt"] and "agree" in judge["system_prompt"]


def rendered(spark, record):
    rows = spark.createDataFrame([("src/a.py", json.dumps(record))], "path string, final_description string")
    return render.render_markdown(rows).first()["text"]


def test_full_markdown(spark):
    text = rendered(spark, {
        "purpose": "Reads rows.", "type": "module", "language": "Python",
        "key_classes": [{"name": "A", "purpose": "base", "methods": ["x", "y"]}, {"name": "B", "purpose": "other"}],
        "key_functions": [{"name": "f", "purpose": "does"}],
        "dependencies": {"imports_from": ["m", "n"], "imported_by_hint": "routes"},
        "side_effects": "opens a socket", "language_specific_notes": "typed", "complexity_notes": "deep",
    })
    assert text == "\n".join([
        "# src/a.py", "", "**Type:** module | **Language:** Python", "", "## Purpose", "", "Reads rows.", "",
        "## Key Classes", "", "- **A**: base", "  - Methods: x, y", "- **B**: other", "",
        "## Key Functions", "", "- **f**: does", "",
        "## Dependencies", "", "- **Imports from:** m, n", "- **Imported by (hint):** routes", "",
        "## Side Effects", "", "opens a socket", "", "## Language-Specific Notes", "", "typed", "",
        "## Complexity Notes", "", "deep", "",
    ])


def test_empty_sections_vanish(spark):
    text = rendered(spark, {"purpose": "", "key_classes": [], "side_effects": "None", "complexity_notes": "N/A",
                            "dependencies": {"imports_from": [], "imported_by_hint": ""}})
    assert text == "# src/a.py\n\n**Type:** unknown | **Language:** Unknown\n"

"""Markdown text of an analysis record, as one expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquorum.functions.jsonx import typed_analysis

# Note texts that mean "nothing to report".
EMPTY_NOTES = ("none", "n/a", "")


def _section(title: str, body: Column, keep: Column) -> Column:
    """Heading, blank line, body, blank line; null (hence dropped) when not kept."""
    return F.when(keep, F.concat(F.lit(f"## {title}\n\n"), body, F.lit("\n")))


def header(path: Column, record: Column) -> Column:
    kind = F.coalesce(record["type"], F.lit("unknown"))
    language = F.coalesce(record["language"], F.lit("Unknown"))
    return F.concat(
        F.lit("# "), path, F.lit("\n\n**Type:** "), kind,
        F.lit(" | **Language:** "), language, F.lit("\n"),
    )


def purpose_section(record: Column) -> Column:
    return _section("Purpose", record["purpose"], record["purpose"] != "")


def _bullet(item: Column) -> Column:
    name = F.coalesce(item["name"], F.lit(""))
    purpose = F.coalesce(item["purpose"], F.lit(""))
    return F.concat(F.lit("- **"), name, F.lit("**: "), purpose)


def _class_lines(item: Column) -> Column:
    methods = F.when(
        F.size(item["methods"]) > 0,
        F.concat(F.lit("\n  - Methods: "), F.array_join(item["methods"], ", ")),
    )
    return F.concat(_bullet(item), F.coalesce(methods, F.lit("")))


def classes_section(record: Column) -> Column:
    lines = F.array_join(F.transform(record["key_classes"], _class_lines), "\n")
    return _section("Key Classes", lines, F.size(record["key_classes"]) > 0)


def functions_section(record: Column) -> Column:
    lines = F.array_join(F.transform(record["key_functions"], _bullet), "\n")
    return _section("Key Functions", lines, F.size(record["key_functions"]) > 0)


def dependencies_section(record: Column) -> Column:
    sources = record["dependencies"]["imports_from"]
    users = record["dependencies"]["imported_by_hint"]
    from_line = F.when(
        F.size(sources) > 0,
        F.concat(F.lit("- **Imports from:** "), F.array_join(sources, ", ")),
    )
    by_line = F.when(users != "", F.concat(F.lit("- **Imported by (hint):** "), users))
    lines = F.concat_ws("\n", from_line, by_line)
    return _section("Dependencies", lines, lines != "")


def note_section(title: str, note: Column) -> Column:
    return _section(title, note, ~F.lower(note).isin(*EMPTY_NOTES))


def markdown(path: Column, record: Column) -> Column:
    """Whole document; empty sections vanish. Section titles and their order are fixed values."""
    return F.concat_ws(
        "\n",
        header(path, record),
        purpose_section(record),
        classes_section(record),
        functions_section(record),
        dependencies_section(record),
        note_section("Side Effects", record["side_effects"]),
        note_section("Language-Specific Notes", record["language_specific_notes"]),
        note_section("Complexity Notes", record["complexity_notes"]),
    )


def render_markdown(records: DataFrame, json_col: str = "final_description") -> DataFrame:
    """(path, text) documents from rows of (path, analysis JSON text)."""
    typed = records.select("path", typed_analysis(F.col(json_col)).alias("record"))
    return typed.select("path", markdown(F.col("path"), F.col("record")).alias("text"))

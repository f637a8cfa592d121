"""JSON found inside free-form replies, and typed access to it.

Validity is decided by Spark's VARIANT parser, which is strict about quotes, control
characters and trailing commas. Set ``spark.sql.variant.allowDuplicateKeys=true`` to let a
repeated key take its last value instead of failing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: shape of an analysis record.
ANALYSIS_DDL = """
purpose STRING, type STRING, language STRING, imports ARRAY<STRING>, exports ARRAY<STRING>,
key_classes ARRAY<STRUCT<name: STRING, purpose: STRING, methods: ARRAY<STRING>>>,
key_functions ARRAY<STRUCT<name: STRING, purpose: STRING>>,
dependencies STRUCT<imports_from: ARRAY<STRING>, imported_by_hint: STRING>,
language_specific_notes STRING, side_effects STRING, complexity_notes STRING
"""
FENCE = "```"
TO_END = 2**31 - 1


def fenced_or_whole(reply: Column) -> Column:
    """Content of the first closed code fence, or the whole text when there is none.

    A ``json`` tag stays in front of the content; it cannot contain a brace.
    """
    to_second_fence = F.substring_index(reply, FENCE, 2)
    closed = F.octet_length(to_second_fence) < F.octet_length(reply)
    return F.when(closed, F.substring_index(to_second_fence, FENCE, -1)).otherwise(reply)


def object_text(reply: Column) -> Column:
    """Text from the first opening brace on; null when there is none."""
    body = fenced_or_whole(reply)
    first_brace = F.nullif(F.instr(body, "{"), F.lit(0))
    return F.substring(body, first_brace, F.lit(TO_END))


def parse_prefix(text: Column) -> Column:
    """VARIANT of the JSON value a text starts with; what follows the value is ignored."""
    return F.try_parse_json(text)


def extract_json(reply: Column) -> Column:
    """VARIANT of the JSON object in a reply; null when there is none or it is broken."""
    return parse_prefix(object_text(reply))


def strict_array(text: Column) -> Column:
    """VARIANT of the array [value, sentinel] for a text that is one JSON value and nothing else, else null.

    The parser stops at the end of a value, so the value goes into an array with a sentinel behind it: the hash of
    the text, which no text can hold. Text that closes the array early, or adds elements, moves the sentinel away.
    """
    sentinel = F.sha2(text, 256)
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit(', "'), sentinel, F.lit('"]')))
    return F.when(F.try_variant_get(wrapped, "$[1]", "string") == sentinel, wrapped)


def parse_field(text: Column) -> Column:
    """VARIANT of a stored JSON field; null for null, empty, broken or trailing text."""
    return F.try_variant_get(strict_array(text), "$[0]", "variant")


def member(value: Column, path: str, as_type: str = "variant") -> Column:
    """Member of a VARIANT under a JSON path, null when absent."""
    return F.try_variant_get(value, path, as_type)


def has_key(value: Column, key: str) -> Column:
    """Key presence; a key holding JSON null is present."""
    return F.coalesce(member(value, f"$.{key}").isNotNull(), F.lit(False))


def truthy(value: Column) -> Column:
    """False for null, false, zero, and empty string, list or object; true otherwise."""
    text = F.to_json(value)
    empty = text.isin("null", "false", '""', "[]", "{}") | text.rlike(r"\A-?0(\.0*)?([eE].*)?\z")
    return F.coalesce(~empty, F.lit(False))


def json_null_as_missing(value: Column) -> Column:
    return F.when(~F.is_variant_null(value), value)


def store_json(value: Column) -> Column:
    """Serialised form for state columns; SQL NULL stays NULL."""
    return F.to_json(value)


def typed_analysis(text: Column) -> Column:
    """Analysis record as a struct; null on broken input."""
    return F.from_json(text, ANALYSIS_DDL, {"allowSingleQuotes": "false"})

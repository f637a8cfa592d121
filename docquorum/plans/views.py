"""Annotation inputs derived from the driver tables.

Every view keeps all rows of its tables. Column expressions are written once in SQL that
Spark and DuckDB read alike; views are assembled by the DataFrame API here and as WITH
clauses for the checking SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATH_SQL = """CASE doc_id WHEN 4 THEN 'setup.py' WHEN 8 THEN 'package.json' ELSE concat(source, '/', lang, '/',
  CASE doc_id % 7 WHEN 3 THEN '__pycache__/' WHEN 5 THEN 'build/' WHEN 6 THEN '.git/' ELSE '' END,
  'd', doc_id, '/',
  CASE doc_id % 20 WHEN 0 THEN 'main.py' WHEN 1 THEN 'App.TSX' WHEN 2 THEN 'conf.yaml' WHEN 3 THEN 'logo.PNG'
    WHEN 4 THEN 'Dockerfile' WHEN 5 THEN 'Makefile' WHEN 6 THEN '__init__.py' WHEN 7 THEN '.env.example'
    WHEN 8 THEN '.bashrc' WHEN 9 THEN 'a.tar.gz' WHEN 10 THEN 'run' WHEN 11 THEN 'README' WHEN 12 THEN 'lib.rs'
    WHEN 13 THEN 'tool' WHEN 14 THEN 'q.sql' WHEN 15 THEN 'docker-compose.dev.yml' WHEN 16 THEN 'requirements-dev.txt'
    WHEN 17 THEN 'debug.log' WHEN 18 THEN 'net.tf' ELSE 'page.html' END) END"""
TEXT_SQL = """CASE WHEN doc_id % 33 = 6 THEN '' WHEN doc_id % 37 = 5 THEN concat('bin', chr(0), text)
  WHEN doc_id % 20 = 10 THEN concat('#!/bin/bash', chr(10), text)
  WHEN doc_id % 20 = 13 THEN concat('#!/usr/bin/env python3', chr(10), text) ELSE text END"""

HASH_SQL = "(doc_id * 31 + attempt * 17 + sn * 7 + call_no) % 23"
RAW_SQL = """CASE WHEN h < 4 THEN 'no object here'
  WHEN stage = 'judge' AND h = 4 THEN '{"confidence": "high"}'
  WHEN stage = 'judge' AND h % 3 = 0 THEN '{"agree": true, "confidence": "high", "merged_result": {"purpose": "merged", "type": "module"}, "disagreements": []}'
  WHEN stage = 'judge' AND h % 3 = 1 THEN concat('Verdict:', chr(10), '```json', chr(10), '{"agree": false, "confidence": "low", "disagreements": ["purpose", "type"]}', chr(10), '```')
  WHEN stage = 'judge' THEN '{"agree": false, "disagreements": ["type"], "confidence": "medium"} trailing words'
  WHEN h % 2 = 0 THEN concat('Here it is: {"purpose": "', stage, ' of ', path, '", "type": "util", "imports": ["a", "b"]}')
  ELSE concat('```json', chr(10), '{"purpose": "', stage, ' {brace} ', CAST(h AS STRING), '", "type": "module"}', chr(10), '```') END"""

STATUS_SQL = """CASE doc_id % 12 WHEN 0 THEN 'pending' WHEN 1 THEN 'pass1_done' WHEN 2 THEN 'pass2_done' WHEN 3 THEN 'quorum_pass'
  WHEN 4 THEN 'quorum_fail' WHEN 5 THEN 'retry_1' WHEN 6 THEN 'retry_2' WHEN 7 THEN 'retry_3' WHEN 8 THEN 'complete'
  WHEN 9 THEN 'flagged' WHEN 10 THEN 'error' ELSE 'removed' END"""
JOB_COLUMNS = {
    "file_path": "path",
    "status": STATUS_SQL,
    "retry_count": "CAST((doc_id - doc_id % 12) / 12 AS INT) % 4",
    "pass1_result": """CASE WHEN doc_id % 12 >= 8 AND doc_id % 4 <> 2 THEN concat('{"purpose": "one ', path, '", "type": "module"}') END""",
    "pass2_result": """CASE WHEN doc_id % 12 >= 8 AND doc_id % 5 <> 2 THEN concat('{"purpose": "two ', path, '", "type": "util"}') END""",
    "quorum_result": """CASE WHEN doc_id % 12 = 9 AND doc_id % 2 = 1 AND doc_id % 5 <> 0 THEN '{"agree": false, "disagreements": ["a", "b", "c", "d"]}' END""",
    "error_log": "CASE WHEN doc_id % 12 IN (9, 10) AND doc_id % 7 <> 0 THEN text END",
}

RECORD_SQL = """concat('{"purpose": "', CASE WHEN doc_id % 9 = 2 THEN '' ELSE concat('Holds ', lang, ' text ', doc_id) END,
  '", "type": "', CASE doc_id % 3 WHEN 0 THEN 'module' WHEN 1 THEN 'script' ELSE 'util' END,
  CASE WHEN doc_id % 8 = 3 THEN '"' ELSE concat('", "language": "', lang, '"') END,
  ', "imports": ["os", "', source, '"], "exports": ["f', doc_id, '", "g"], "key_classes": ',
  CASE doc_id % 4 WHEN 0 THEN '[]' WHEN 1 THEN concat('[{"name": "C', doc_id, '", "purpose": "keeps rows", "methods": ["get", "put"]}]')
    ELSE concat('[{"name": "A", "purpose": "base", "methods": []}, {"name": "B', doc_id, '", "purpose": "derived", "methods": ["run"]}]') END,
  ', "key_functions": ', CASE WHEN doc_id % 5 < 2 THEN '[]' ELSE concat('[{"name": "load_', source, '", "purpose": "reads"}, {"name": "save", "purpose": "writes"}]') END,
  ', "dependencies": {"imports_from": ', CASE WHEN doc_id % 6 = 0 THEN '[]' ELSE concat('["common", "', source, '.util"]') END,
  ', "imported_by_hint": "', CASE WHEN doc_id % 4 = 1 THEN 'route table' ELSE '' END,
  '"}, "side_effects": "', CASE doc_id % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'N/A' WHEN 2 THEN '' ELSE 'opens a socket' END,
  '", "language_specific_notes": "', CASE WHEN doc_id % 3 = 0 THEN 'typed' ELSE 'none' END, '"',
  CASE WHEN doc_id % 2 = 0 THEN ', "complexity_notes": "deep nesting"' ELSE '' END, '}')"""

CHUNK_SQL = """CASE WHEN turn = 5 THEN 'data: [DONE]' WHEN turn = 2 AND conv_id % 4 = 0 THEN ': keep-alive'
  WHEN turn = 3 AND conv_id % 5 = 0 THEN 'data: {"choices": [{"delta": {"content": "cut off'
  WHEN turn = 1 AND conv_id % 7 = 0 THEN 'data: {"choices": [{"delta": {"content": "x"}}]}, 0] junk'
  ELSE concat('data: {"choices": [{"delta": {"content": "', role, '-', CAST(turn AS STRING), ' "}}]}') END"""
NDJSON_SQL = """CASE WHEN turn = 2 AND conv_id % 4 = 0 THEN '{"message": {"content": '
  WHEN turn = 3 AND conv_id % 5 = 0 THEN '{"message": {"content": "x"}}, 0] junk'
  WHEN turn = 4 THEN concat('{"message": {"content": "', role, '-end"}, "done": true}')
  ELSE concat('{"message": {"content": "', role, '-', CAST(turn AS STRING), ' "}, "done": false}') END"""

# Every document depends on its parent in a tree, and every seventh parent on its child.
PARENT_SQL = "CAST((doc_id - doc_id % 10) / 10 AS BIGINT)"
BACK_SQL = (
    f"CASE WHEN doc_id % 7 = 3 THEN {PARENT_SQL} ELSE doc_id END",
    f"CASE WHEN doc_id % 7 = 3 THEN doc_id ELSE {PARENT_SQL} END",
)

VIEWS = {
    "corpus": f"SELECT doc_id, lang, source, {PATH_SQL} AS path, {TEXT_SQL} AS text FROM documents",
    "responses": f"""SELECT path, attempt, stage, call_no, {RAW_SQL} AS raw
FROM (SELECT path, attempt, stage, call_no, {HASH_SQL} AS h
  FROM corpus CROSS JOIN (VALUES (0),(1),(2),(3)) a(attempt)
  CROSS JOIN (VALUES ('pass1',0),('pass2',1),('judge',2)) s(stage,sn)
  CROSS JOIN (VALUES (1),(2),(3)) c(call_no)) x""",
    "jobs": "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in JOB_COLUMNS.items()) + " FROM corpus",
    "walked": """SELECT path FROM corpus WHERE text <> '' AND NOT contains(text, chr(0))
UNION ALL SELECT concat('pages/p', page_id, '.html') AS path FROM pages""",
    "chunks": f"SELECT conv_id AS request_id, turn AS seq, {CHUNK_SQL} AS line FROM conversations",
    "ndjson": f"SELECT conv_id AS request_id, turn AS seq, {NDJSON_SQL} AS line FROM conversations",
    "meta": """SELECT concat('u', CAST(user_id AS STRING), '.', event_type) AS key, CAST(event_id AS STRING) AS value,
  ts AS updated_at FROM events""",
    "records": f"SELECT doc_id, path, text, {RECORD_SQL} AS result FROM corpus",
    "deps": f"""SELECT doc_id AS src, {PARENT_SQL} AS dst FROM documents
UNION SELECT {BACK_SQL[0]} AS src, {BACK_SQL[1]} AS dst FROM documents""",
    # Replies cut to their JSON object, the way a reader of the log would: fence first, then braces.
    "replies": """SELECT path, attempt, stage, call_no, raw,
  CASE WHEN strpos(body, '{') > 0 THEN substr(body, strpos(body, '{'), length(body) - strpos(reverse(body), '}') - strpos(body, '{') + 2) END AS body
FROM (SELECT *, CASE WHEN len(string_split(raw, '```')) >= 3 THEN string_split(raw, '```')[2] ELSE raw END AS body FROM responses) r""",
    "usable": """SELECT path, attempt, stage, call_no, raw,
  CASE WHEN body IS NOT NULL AND json_valid(body) AND (stage <> 'judge' OR json_exists(body, '$.agree')) THEN body END AS body
FROM replies""",
    "stage_best": """SELECT path, attempt, stage, arg_min(body, call_no) FILTER (WHERE body IS NOT NULL) AS body,
  min(call_no) FILTER (WHERE body IS NOT NULL) AS call_no, arg_max(raw, call_no) AS last_raw
FROM usable GROUP BY path, attempt, stage""",
    "attempts": """SELECT path, attempt, p1, p2, j, r1, r2, rj,
  CASE WHEN p1 IS NULL THEN 'pass1' WHEN p2 IS NULL THEN 'pass2' WHEN j IS NULL THEN 'judge' END AS failed_stage,
  CASE WHEN p1 IS NULL OR p2 IS NULL OR j IS NULL THEN 'error'
    WHEN json_extract_string(j, '$.agree') = 'true' THEN 'agree' ELSE 'disagree' END AS outcome
FROM (SELECT path, attempt,
  max(body) FILTER (WHERE stage = 'pass1') AS p1, max(body) FILTER (WHERE stage = 'pass2') AS p2, max(body) FILTER (WHERE stage = 'judge') AS j,
  max(last_raw) FILTER (WHERE stage = 'pass1') AS r1, max(last_raw) FILTER (WHERE stage = 'pass2') AS r2, max(last_raw) FILTER (WHERE stage = 'judge') AS rj
  FROM stage_best GROUP BY path, attempt) s""",
    "resolved": """SELECT path, CASE WHEN outcome = 'agree' THEN 'complete' ELSE 'flagged' END AS status,
  CAST(CASE WHEN outcome = 'disagree' THEN 3 ELSE attempt END AS INT) AS retry_count,
  CASE WHEN outcome <> 'error' THEN p1 END AS pass1_result,
  CASE WHEN outcome <> 'error' THEN p2 END AS pass2_result,
  CASE WHEN outcome <> 'error' THEN j END AS quorum_result,
  CASE WHEN outcome = 'agree' THEN coalesce(CAST(json_extract(j, '$.merged_result') AS VARCHAR), p1) END AS merged_result,
  CASE WHEN failed_stage = 'judge' THEN 'Quorum judge JSON failure after 3 attempts'
    WHEN outcome = 'error' THEN 'JSON parse failure after 3 attempts'
    WHEN outcome = 'disagree' THEN 'Quorum disagreement after 4 attempts' END AS error,
  CASE failed_stage WHEN 'pass1' THEN r1 WHEN 'pass2' THEN r2 WHEN 'judge' THEN rj END AS raw_output
FROM (SELECT *, row_number() OVER (PARTITION BY path
    ORDER BY CASE WHEN outcome <> 'disagree' THEN attempt ELSE 100 - attempt END) AS rn FROM attempts) a WHERE rn = 1""",
}
_DEPENDS = {
    "responses": ("corpus",), "jobs": ("corpus",), "walked": ("corpus",), "records": ("corpus",),
    "replies": ("responses",), "usable": ("replies",), "stage_best": ("usable",),
    "attempts": ("stage_best",), "resolved": ("attempts",),
}


def with_views(sql: str, needs: tuple[str, ...]) -> str:
    """Put the WITH clauses a statement needs in front of it."""
    wanted: set[str] = set()
    todo = list(needs)
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo.extend(_DEPENDS.get(name, ()))
    clauses = [f"{name} AS ({body})" for name, body in VIEWS.items() if name in wanted]
    body = sql.strip()
    if not clauses:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(clauses) + ",\n" + body[len("WITH RECURSIVE "):]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(clauses) + ",\n" + body[len("WITH "):]
    return "WITH " + ",\n".join(clauses) + "\n" + body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", F.expr(PATH_SQL).alias("path"), F.expr(TEXT_SQL).alias("text")
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as discovery input: path, size in bytes, content."""
    return corpus(spark, sf_dir).select(
        "path", F.octet_length("text").cast("bigint").alias("size"), F.col("text").cast("binary").alias("content")
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = F.array(*[
        F.struct(F.lit(name).alias("stage"), F.lit(n).alias("sn"))
        for n, name in enumerate(("pass1", "pass2", "judge"))
    ])
    # Spread the narrow rows before each becomes 36 replies.
    spread = corpus(spark, sf_dir).select("doc_id", "path").repartition(
        int(spark.conf.get("spark.sql.shuffle.partitions")), "path"
    )
    return (
        spread.select("doc_id", "path", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("attempt"))
        .select("*", F.inline(stages))
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("call_no"))
        .withColumn("h", F.expr(HASH_SQL))
        .select("path", "attempt", "stage", "call_no", F.expr(RAW_SQL).alias("raw"))
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select(*[F.expr(sql).alias(name) for name, sql in JOB_COLUMNS.items()])


def walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = corpus(spark, sf_dir).filter("text <> '' AND NOT contains(text, chr(0))").select("path")
    pages = table(spark, sf_dir, "pages").select(F.expr("concat('pages/p', page_id, '.html')").alias("path"))
    return kept.unionByName(pages)


def chunks(spark: SparkSession, sf_dir: str, line_sql: str = CHUNK_SQL) -> DataFrame:
    return chunk_lines_of(table(spark, sf_dir, "conversations"), line_sql)


def chunk_lines_of(conversations: DataFrame, line_sql: str = CHUNK_SQL) -> DataFrame:
    return conversations.select(
        F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"), F.expr(line_sql).alias("line")
    )


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.expr("concat('u', CAST(user_id AS STRING), '.', event_type)").alias("key"),
        F.col("event_id").cast("string").alias("value"), F.col("ts").alias("updated_at"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", "path", "text", F.expr(RECORD_SQL).alias("result"))


def deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    up = documents.select(F.col("doc_id").alias("src"), F.expr(PARENT_SQL).alias("dst"))
    back = documents.select(*[F.expr(sql).alias(name) for sql, name in zip(BACK_SQL, ("src", "dst"))])
    return up.unionByName(back)

"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from docquorum.session import cut_lineage

from . import (
    decontaminate, html_text, language_id, line_dedup, merkle, mixing, ngram_join, quality_mil, quality_rules, secrets, toxicity,
    url_filter, whitening,
)
from .registry import QUERIES, SQL, registered, table

__all__ = ["QUERIES", "SQL"]

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP3_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len({WORDS})::BIGINT AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, '-') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
placed AS (
  SELECT *, 3 * source_size AS cap,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sources),
ranked AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
    coalesce(sum(cap) OVER before, 0) AS caps_before, coalesce(sum(weight) OVER before, 0) AS weights_before
  FROM placed
  WINDOW before AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (
  SELECT *, cap::HUGEINT * (weights - weights_before) <= (total - caps_before)::HUGEINT * weight AS is_capped FROM ranked),
levels AS (
  SELECT any_value(total) - coalesce(sum(cap) FILTER (WHERE is_capped), 0) AS rest,
    any_value(weights) - coalesce(sum(weight) FILTER (WHERE is_capped), 0) AS rest_weight
  FROM capped),
targets AS (
  SELECT source, source_size,
    CASE WHEN is_capped THEN cap::DOUBLE ELSE rest::DOUBLE * weight / rest_weight::DOUBLE END AS target
  FROM capped, levels),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs,
    round(target)::BIGINT AS budget
  FROM targets),
ordered AS (
  SELECT s.*, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS last,
    sum(size) OVER (PARTITION BY s.source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(size) OVER (PARTITION BY s.source, key) AS same, count(*) OVER (PARTITION BY s.source, key) AS ties
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + CASE WHEN upto <= last THEN size
    WHEN upto - same <= last THEN (last - (upto - same)) // ties ELSE 0 END)::BIGINT AS taken
FROM ordered
"""

OP5_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]

OP5_SQL = """
WITH parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
found AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
  END AS rule FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM found
"""


# Words, lines and the rules of a line, each restated in SQL.
OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line,
    regexp_extract_all(string_split(coalesce(text, ''), chr(10))[i], '[^\x20\x09-\x0D]+') AS words
  FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS u(i)),
judged AS (
  SELECT *, len(words) AS n, len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols,
    CASE WHEN len(words) = 0 THEN NULL
      WHEN 100 * len(regexp_extract_all(line, '[#*$%&|<>]')) > 25 * len(words) THEN 'symbols'
      WHEN len(words) >= 3 AND 100 * len(regexp_extract_all(line, '!')) > 50 * len(words) THEN 'shouting'
      WHEN len(words) <= 12 AND regexp_matches(lower(line), '^\PL*(home|next|previous|back to top|skip to content|read more|click here|sign in|log in|sign up|subscribe|share this|menu|search|site map|contact us)\PL*$') THEN 'navigation'
      WHEN len(words) <= 12 AND regexp_matches(lower(line), 'all rights reserved|privacy policy|terms of use|terms of service|cookie|javascript|lorem ipsum|powered by|unsubscribe|copyright ©|\(c\) copyright') THEN 'boilerplate'
      WHEN len(words) >= 40 AND 100 * len(list_distinct(words)) < 25 * len(words) THEN 'repetition'
      WHEN len(words) >= 40 AND NOT regexp_matches(line, '[.,;:!?…]') THEN 'punctuation' END AS failure
  FROM lines),
per_line AS (
  SELECT doc_id, sum(symbols)::BIGINT AS n_symbols, count(*) FILTER (WHERE n > 0) AS n_lines,
    (count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0))::BIGINT AS n_dup_lines,
    coalesce(sum(n) FILTER (WHERE failure IS NULL), 0)::BIGINT AS kept_words
  FROM judged GROUP BY doc_id),
tokens AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS t
  FROM tokens, unnest(range(1, len(w) - 1)) AS u(p)),
twice AS (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS times FROM windows),
covered AS (
  SELECT doc_id, count(DISTINCT p + o)::BIGINT AS n_repeat_words
  FROM twice, unnest([0, 1, 2]) AS v(o) WHERE times > 1 GROUP BY doc_id),
base AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words,
    coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars, n_symbols, n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, n_lines, kept_words
  FROM tokens t JOIN per_line USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * kept_words >= 50 * n_words AS kept,
  n_lines, kept_words
FROM base
"""


# Trees by levels, then every leaf climbs: through its group's nodes, then through those over the groups' roots.
OP12_SQL = r"""
WITH RECURSIVE
table256 AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
shown AS (
  SELECT *, CASE WHEN xor(list_reduce(
      list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0
    THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS tampered
  FROM documents, table256),
hashed AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS key,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS body, coalesce(strlen(tampered) || ':' || tampered, '-') AS other
  FROM shown),
leaves AS (
  SELECT doc_id, key, digest, presented, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, digest) - 1 AS rank,
    count(*) OVER (PARTITION BY key) AS n
  FROM (SELECT *, sha256(head || body) AS digest, sha256(head || other) AS presented FROM hashed) h),
nodes AS (
  SELECT key, 0 AS level, rank AS idx, digest, n FROM leaves
  UNION ALL
  SELECT key, level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (n + 15) // 16
  FROM nodes WHERE n > 1 GROUP BY key, level, idx // 16, n),
subroots AS (
  SELECT key, digest, row_number() OVER (ORDER BY key) - 1 AS number, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT '' AS key, 0 AS level, number AS idx, digest, n FROM subroots
  UNION ALL
  SELECT key, level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (n + 15) // 16
  FROM tops WHERE n > 1 GROUP BY key, level, idx // 16, n),
beside AS (
  SELECT key, level, idx, n, coalesce(string_agg(digest, '') OVER below, '') AS lefts,
    coalesce(string_agg(digest, '') OVER above, '') AS rights
  FROM (SELECT * FROM nodes UNION ALL SELECT * FROM tops) a
  WINDOW below AS (PARTITION BY key, level, idx // 16 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    above AS (PARTITION BY key, level, idx // 16 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
climb AS (
  SELECT key AS grp, rank, key, 0 AS level, rank AS idx, presented AS digest, '' AS proof FROM leaves
  UNION ALL
  SELECT c.grp, c.rank, CASE WHEN b.n > 1 THEN c.key ELSE '' END, CASE WHEN b.n > 1 THEN c.level + 1 ELSE 0 END,
    CASE WHEN b.n > 1 THEN c.idx // 16 ELSE s.number END,
    CASE WHEN b.n > 1 THEN sha256(b.lefts || c.digest || b.rights) ELSE c.digest END,
    CASE WHEN b.n > 1 THEN c.proof || b.lefts || b.rights ELSE c.proof END
  FROM climb c JOIN beside b ON b.key = c.key AND b.level = c.level AND b.idx = c.idx
  LEFT JOIN subroots s ON s.key = c.key
  WHERE b.n > 1 OR c.key <> ''),
ended AS (
  SELECT c.* FROM climb c JOIN tops t ON t.key = c.key AND t.level = c.level AND t.idx = c.idx AND t.n = 1)
SELECT l.doc_id, l.digest AS leaf, s.digest AS subroot, t.digest AS root, sha256(e.proof) AS proof_sha256,
  e.digest AS folded_root, e.digest = t.digest AS verified
FROM ended e JOIN leaves l ON l.key = e.grp AND l.rank = e.rank JOIN subroots s ON s.key = l.key
JOIN tops t ON t.n = 1
"""


@registered("op3_mixing", OP3_SQL)
def op3_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


@registered("op5_url_filter", OP5_SQL)
def op5_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), OP5_RULES).select("page_id", "url_filter.*")


@registered("op7_line_dedup")
def op7_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "text", F.size("repeated").cast("long").alias("n_removed"), "repeated")


@registered("op9_quality_rules", OP9_SQL)
def op9_quality_rules(spark, sf_dir):
    return quality_rules.clean(table(spark, sf_dir, "documents")).select(
        "doc_id", *(f"quality.{c}" for c in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
            "n_lines", "kept_words")))


@registered("op1_ngram_join")
def op1_ngram_join(spark, sf_dir):
    return ngram_join.near_groups(table(spark, sf_dir, "documents"), n=3, percent=90).select(
        "doc_id", F.col("n_shingles"), "component_id")


@registered("op4_decontamination")
def op4_decontamination(spark, sf_dir):
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", "overlap", "answer_found", "cosine", "at")


@registered("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity.held_out(F.col("doc_id"), 5, 0)
    model = toxicity.fit(toxicity.labelled_sample(docs, labels.filter(~out), "toxic", zeros=toxicity.ZEROS))
    return toxicity.score_toxicity(docs, model).select(
        "doc_id", out.alias("held_out"), F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


@registered("op6_quality_classifier")
def op6_quality_classifier(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity.held_out(F.col("doc_id"), 3, 1)
    model = quality_mil.fit(toxicity.labelled_sample(docs, labels.filter(~out), "quality"))
    return quality_mil.score_quality(docs, model).select(
        "doc_id", out.alias("held_out"), F.col("quality_mil.score").alias("score"),
        (F.col("quality_mil.score") >= 0.5).cast("int").alias("predicted"))


@registered("op10_language_id")
def op10_language_id(spark, sf_dir):
    """Pages by text, markup and address; documents by text and source. ``page_id`` or ``doc_id`` is null."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")

    @F.pandas_udf("string")
    def shown(html: pd.Series) -> pd.Series:
        return html.map(language_id.visible)

    rows = pages.select(
        F.lit(None).cast("long").alias("doc_id"), "page_id", shown("html").alias("text"),
        F.nullif(url_filter.host(F.col("url")), F.lit("")).alias("host"),
        language_id.declared_language(F.col("html")).alias("declared"),
    ).union(docs.select(
        "doc_id", F.lit(None).cast("long"), "text", F.concat(F.col("source"), F.lit(".source")),
        F.lit(None).cast("string")))
    found = language_id.identify(rows, language_id.fit_text(docs))
    return found.select("doc_id", "page_id", "lang", "probability", "text_lang", "declared")


@registered("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@registered("op2_secret_scan")
def op2_secret_scan(spark, sf_dir):
    """Candidates of all documents. The tables hold no labelled findings, so those of one part of the documents are
    labelled by what tells them; the forest then judges all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("path"))
    found = cut_lineage(secrets.candidates(docs))
    learnt = ~toxicity.held_out(F.col("doc_id"), 3, 1)
    return secrets.scan(found, secrets.fit(secrets.evidence(found.filter(learnt)))).select(
        "doc_id", "begin", "end", "name", "value", "probability", "secret")


@registered("op13_html_extraction")
def op13_html_extraction(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


@registered("op12_merkle_manifest", OP12_SQL)
def op12_merkle_manifest(spark, sf_dir):
    text = F.col("text")
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(toxicity.held_out(F.col("doc_id"), 5, 0), lowered).otherwise(text)
    return merkle.verify(table(spark, sf_dir, "documents"), tampered)


@registered("op11_embedding_whitening")
def op11_embedding_whitening(spark, sf_dir):
    whitened = whitening.whiten(table(spark, sf_dir, "embeddings"), "embedding", 16)
    return whitened.select(
        "vec_id", "whitening.*").select(
        "vec_id", "n", "deviation", "identity_error",
        F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"),
        F.col("c.explained").alias("explained"), "identity_error")

"""Queries over long files, modules, prompts for later stages, and dependencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquorum.functions.language import detect_language
from docquorum.functions.render import render_markdown
from docquorum.operators import graph as g
from docquorum.operators import relationships as rel
from docquorum.operators import state
from docquorum.plans import views
from docquorum.plans.annotation import MARKDOWN_SQL
from docquorum.plans.discovery import LANGUAGES_SQL
from docquorum.plans.registry import registered
from docquorum.plans.state import SUMMARY_SQL
from docquorum.session import scratch_dir

MODULE_SQL = "CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '.' END"
BATCH, TOKENS, PROMPT_TOKENS = 20, 6_000, 1_500
LINES, OVERLAP = 10, 3
_SOURCE = (
    "bash|c|cc|cfg|cjs|clj|cljs|conf|cpp|cs|css|cxx|dart|dockerfile|ejs|erb|erl|ex|exs|"
    "gemspec|go|h|hbs|hpp|hrl|hs|htm|html|ini|java|jinja|jinja2|js|json|jsx|kt|kts|"
    "less|lua|mako|md|mjs|php|pl|pm|pug|pxd|py|pyx|r|rake|rb|rs|rst|sass|scala|scss|"
    "sh|sql|svelte|swift|tf|toml|ts|tsx|vue|xml|yaml|yml|zsh"
)


def _key_sql(name: str) -> str:
    bare = rf"regexp_replace(regexp_replace({name}, '^(\./)+', ''), '\.({_SOURCE})$', '')"
    return rf"regexp_replace(replace({bare}, '/', '.'), '\.__init__$', '')"


@registered("line_chunks", needs=("corpus",), sql=f"""
WITH cut AS (SELECT path, string_split(text, chr(10)) AS lines FROM corpus),
starts AS (SELECT path, lines, unnest(range(1, greatest(len(lines) - {OVERLAP}, 1) + 1, {LINES - OVERLAP})) AS first_line FROM cut)
SELECT path, CAST((first_line - 1) // {LINES - OVERLAP} AS INT) AS chunk_no, CAST(first_line AS INT) AS first_line,
  CAST(len(lines[first_line:first_line + {LINES - 1}]) AS INT) AS n_lines, array_to_string(lines[first_line:first_line + {LINES - 1}], chr(10)) AS text FROM starts""")
def _(spark, sf):
    return g.chunk_lines(views.corpus(spark, sf).select("path", "text"), LINES, OVERLAP)


# What a model might say of one chunk: its first word is the purpose, its long words are exported, its last is a function.
CHUNKS_SQL = f"""
cut AS (SELECT path, string_split(text, chr(10)) AS lines FROM corpus),
starts AS (SELECT path, lines, unnest(range(1, greatest(len(lines) - {OVERLAP}, 1) + 1, {LINES - OVERLAP})) AS first_line FROM cut),
pieces AS (SELECT path, (first_line - 1) // {LINES - OVERLAP} AS chunk_no, array_to_string(lines[first_line:first_line + {LINES - 1}], chr(10)) AS text FROM starts)"""


@registered("merged_chunk_records", needs=("corpus",), sql=f"""
WITH {CHUNKS_SQL},
words AS (SELECT path, chunk_no, regexp_extract(text, '[a-z]+') AS first, regexp_extract(text, '([a-z]+)[^a-z]*$', 1) AS last,
  regexp_extract_all(text, '[a-z]{{9,}}') AS long FROM pieces),
items AS (SELECT path, 'e' AS field, chunk_no, generate_subscripts(long, 1) AS nth, unnest(long) AS item FROM words
  UNION ALL SELECT path, 'f', chunk_no, 1, last FROM words),
firsts AS (SELECT path, field, item, min((chunk_no, nth)) AS place FROM items GROUP BY ALL)
SELECT w.path, coalesce(arg_min(first, chunk_no) FILTER (WHERE first <> ''), '') AS purpose,
  coalesce(any_value(e.names), '') AS exports, any_value(f.names) AS functions
FROM words w
LEFT JOIN (SELECT path, string_agg(item, ',' ORDER BY place) AS names FROM firsts WHERE field = 'e' GROUP BY path) e ON e.path = w.path
LEFT JOIN (SELECT path, string_agg(item, ',' ORDER BY place) AS names FROM firsts WHERE field = 'f' GROUP BY path) f ON f.path = w.path
GROUP BY w.path""")
def _(spark, sf):
    """The records of each file's own line chunks, merged per file."""
    pieces = g.chunk_lines(views.corpus(spark, sf).select("path", "text"), LINES, OVERLAP)
    name = F.struct(
        F.regexp_extract("text", r"([a-z]+)[^a-z]*\z", 1).alias("name"), F.lit("ends").alias("purpose")
    )
    record = F.to_json(F.struct(
        F.regexp_extract("text", "[a-z]+", 0).alias("purpose"),
        F.regexp_extract_all("text", F.lit("[a-z]{9,}"), 0).alias("exports"), F.array(name).alias("key_functions"),
    ))
    names = F.array_join(F.transform("key_functions", lambda f: f["name"]), ",")
    return g.merge_chunk_records(pieces.select("path", "chunk_no", record.alias("result"))).select(
        "path", "purpose", F.array_join("exports", ",").alias("exports"), names.alias("functions"),
    )


@registered("module_rollup", needs=("corpus",), sql=f"""
WITH {LANGUAGES_SQL}
SELECT {MODULE_SQL.replace('path', 'c.path')} AS module, count(*) AS files, count(DISTINCT d.language) AS languages,
  CAST(sum((length(c.text) + 3) // 4) AS BIGINT) AS tokens FROM corpus c JOIN detected_language d ON d.path = c.path GROUP BY 1""")
def _(spark, sf):
    corpus = views.corpus(spark, sf)
    return g.module_rollup(corpus.withColumn("language", detect_language(F.col("path"), F.col("text"))))


@registered("flagged_prompts", needs=("jobs",), sql=f"""
SELECT file_path, concat('# ', file_path, chr(10), chr(10), '{g.FLAGGED_INTRO.strip()}', chr(10),
  chr(10), '## Points in conflict', chr(10), chr(10), {SUMMARY_SQL}, chr(10),
  CASE WHEN pass1_result IS NOT NULL THEN chr(10) || '## First description' || chr(10) || chr(10) || pass1_result || chr(10) END,
  CASE WHEN pass2_result IS NOT NULL THEN chr(10) || '## Second description' || chr(10) || chr(10) || pass2_result || chr(10) END) AS prompt
FROM jobs WHERE status = 'flagged'""")
def _(spark, sf):
    return g.flagged_prompts(views.jobs(spark, sf))


# Each file imports a name that nobody has and one other file, which is named in one of five ways.
IMPORTS_SQL = f"""imports AS (
  SELECT c.path AS src_path, CASE c.doc_id % 5 WHEN 0 THEN t.path WHEN 1 THEN replace(t.path, '/', '.')
      WHEN 2 THEN CASE WHEN contains(c.path, '/') THEN repeat('../', len(string_split(c.path, '/')) - 1) ELSE './' END || t.path
      WHEN 3 THEN CASE WHEN contains(t.path, '/') THEN regexp_replace({_key_sql('t.path')}, '^[^.]*\\.', '') ELSE {_key_sql('t.path')} END
      ELSE CASE WHEN contains({_key_sql('t.path')}, '..') THEN t.path ELSE repeat('.', len(string_split(c.path, '/'))) || {_key_sql('t.path')} || '.thing' END END AS target, {_key_sql('t.path')} AS key
  FROM corpus c JOIN corpus t ON t.doc_id = (c.doc_id * 3 + 1) % (SELECT count(*) FROM corpus)
  UNION ALL SELECT path, 'common', NULL FROM corpus),
owners AS (SELECT {_key_sql('path')} AS key, min(path) AS dst_path FROM corpus GROUP BY 1),
edges AS (SELECT i.src_path, i.target, o.dst_path, {MODULE_SQL.replace('path', 'i.src_path')} AS src_module,
  CASE WHEN o.dst_path IS NOT NULL THEN {MODULE_SQL.replace('path', 'o.dst_path')} END AS dst_module
  FROM (SELECT DISTINCT * FROM imports) i LEFT JOIN owners o ON o.key = i.key)"""


def _import_records(spark, sf):
    """Every file imports one common name and one other file: by path, dotted, from its own folder by path or by dots, or
    without the top folder."""
    corpus = views.corpus(spark, sf).select("doc_id", "path")
    n = corpus.count()
    other = corpus.select(F.col("doc_id").alias("other_id"), F.col("path").alias("other"))
    pairs = corpus.join(other, F.col("other_id") == (F.col("doc_id") * 3 + 1) % n)
    way, depth, key = F.col("doc_id") % 5, F.size(F.split("path", "/")), g.import_key(F.col("other"))
    up = F.when(depth > 1, F.repeat(F.lit("../"), depth - 1)).otherwise("./")
    name = (
        F.when(way == 0, F.col("other")).when(way == 1, F.translate("other", "/", "."))
        .when(way == 2, F.concat(up, "other"))
        .when(way == 3, F.when(F.col("other").contains("/"), F.regexp_replace(key, r"\A[^.]*\.", "")).otherwise(key))
        .when(key.contains(".."), F.col("other"))  # hidden folders have no dotted name
        .otherwise(F.concat(F.repeat(F.lit("."), depth), key, F.lit(".thing")))
    )
    return pairs.select("path", F.array(F.lit("common"), name).alias("imports_from"))


@registered("dependency_edges", needs=("corpus",), sql=f"""
WITH {IMPORTS_SQL} SELECT *, coalesce(src_module <> dst_module, false) AS cross_module FROM edges""")
def _(spark, sf):
    return g.dependency_edges(_import_records(spark, sf))


def _packed_sql(rows: str, group: str, order: str, files: int, most: int) -> str:
    """Greedy batches, one row after the other: rows are (group, order, tokens)."""
    full = f"p.files >= {files} OR p.held + x.tokens > {most}"
    return f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS n FROM ({rows}) r),
packed AS (SELECT {group}, {order}, tokens, n, 0 AS batch, 1 AS files, tokens AS held FROM numbered WHERE n = 1
  UNION ALL SELECT x.{group}, x.{order}, x.tokens, x.n, CASE WHEN {full} THEN p.batch + 1 ELSE p.batch END,
    CASE WHEN {full} THEN 1 ELSE p.files + 1 END, CASE WHEN {full} THEN x.tokens ELSE p.held + x.tokens END
  FROM packed p JOIN numbered x ON x.{group} = p.{group} AND x.n = p.n + 1)"""


BATCHES_SQL = _packed_sql(
    f"SELECT {MODULE_SQL} AS module, path, (length(text) + 3) // 4 AS tokens FROM corpus", "module", "path", BATCH, TOKENS)


@registered("module_batches", needs=("corpus",), sql=f"WITH RECURSIVE {BATCHES_SQL} SELECT module, batch, path, tokens FROM packed")
def _(spark, sf):
    return rel.module_batches(views.corpus(spark, sf), BATCH, TOKENS)


@registered("batch_sizes", needs=("corpus",), sql=f"""
WITH RECURSIVE {BATCHES_SQL} SELECT module, batch, count(*) AS files, CAST(sum(tokens) AS BIGINT) AS tokens FROM packed GROUP BY ALL""")
def _(spark, sf):
    return rel.batch_sizes(rel.module_batches(views.corpus(spark, sf), BATCH, TOKENS))


PROMPTS_SQL = f"""{IMPORTS_SQL}, described AS ({MARKDOWN_SQL}),
linked AS (SELECT src_path AS path, string_agg(line, chr(10) ORDER BY line) AS links FROM (
  SELECT DISTINCT src_path, '- ' || src_path || ' -> ' || dst_path AS line FROM edges WHERE src_module <> dst_module) l GROUP BY 1),
whole AS (SELECT d.path, d.text, l.links, {MODULE_SQL.replace('path', 'd.path')} AS module,
  (length(d.text) + 3) // 4 + coalesce((length(l.links) + 3) // 4, 0) AS tokens FROM described d LEFT JOIN linked l ON l.path = d.path),
{_packed_sql("SELECT module, path, tokens FROM whole", "module", "path", BATCH, PROMPT_TOKENS - rel.HEAD_TOKENS)}"""


@registered("relationship_prompts", needs=("records",), sql=f"""
WITH RECURSIVE {PROMPTS_SQL}
SELECT p.module, p.batch, '# Module ' || p.module || chr(10) || chr(10) || '{rel.PROMPT_INTRO.strip()}' || chr(10) || chr(10)
  || string_agg(w.text, chr(10) ORDER BY p.path)
  || coalesce(chr(10) || '## Imports from other modules' || chr(10) || chr(10) || string_agg(w.links, chr(10) ORDER BY p.path), '') AS prompt
FROM packed p JOIN whole w ON w.path = p.path GROUP BY p.module, p.batch""")
def _(spark, sf):
    described = render_markdown(views.records(spark, sf), "result")
    return rel.relationship_prompts(described, g.dependency_edges(_import_records(spark, sf)), BATCH, PROMPT_TOKENS)


def _counting_client():
    """Counts the described files, and adds up the counts of summaries."""
    import json
    import re

    def chat(system: str, user: str) -> str:
        if user.startswith("# Module "):
            return json.dumps({"summary": f"{len(re.findall('(?m)^# ', user)) - 1} files in 1 batches"})
        counts = re.findall("(?m)^([0-9]+) files in ([0-9]+) batches$", user)
        return json.dumps({"summary": f"{sum(int(a) for a, _ in counts)} files in {sum(int(b) for _, b in counts)} batches"})

    return chat


@registered("relationship_map", needs=("records",), sql=f"""
WITH RECURSIVE {PROMPTS_SQL},
batches AS (SELECT module, batch, count(*) AS files FROM packed GROUP BY ALL)
SELECT printf('%s#%06d', module, batch) AS name, printf('%d files in 1 batches', files) AS summary FROM batches
UNION ALL SELECT 'all', printf('%d files in %d batches', CAST(sum(files) AS BIGINT), count(*)) FROM batches""")
def _(spark, sf):
    """Module prompts, then prompts over their summaries until one is left; level 0 and the last one."""
    found = rel.relationship_map(
        render_markdown(views.records(spark, sf), "result"), g.dependency_edges(_import_records(spark, sf)),
        scratch_dir(spark, "map"), _counting_client, BATCH, PROMPT_TOKENS)
    top = found.agg(F.max_by("summary", "level").alias("summary")).select(F.lit("all").alias("name"), "summary")
    return found.filter("level = 0").select("name", "summary").unionByName(top)


@registered("module_imports", needs=("corpus",), sql=f"""
WITH {IMPORTS_SQL} SELECT src_module, dst_module, count(*) AS edges FROM edges WHERE src_module <> dst_module GROUP BY ALL""")
def _(spark, sf):
    return g.module_imports(g.dependency_edges(_import_records(spark, sf)))


@registered("circular_dependencies", needs=("deps",), sql="""
WITH RECURSIVE reach AS (SELECT src, dst FROM deps UNION SELECT r.src, d.dst FROM reach r JOIN deps d ON d.src = r.dst)
SELECT a.src AS node, min(b.src) AS cycle_id FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src""")
def _(spark, sf):
    return g.circular_dependencies(views.deps(spark, sf))


@registered("changed_files", needs=("corpus",), sql="""
SELECT c.path, CASE WHEN l.doc_id IS NULL THEN 'new' ELSE 'changed' END AS change, sha256(c.text) AS content_hash
FROM corpus c LEFT JOIN labels l ON l.doc_id = c.doc_id WHERE l.doc_id IS NULL OR l.quality = 0""")
def _(spark, sf):
    """Labelled documents were seen before; those of low quality with another text."""
    corpus = views.corpus(spark, sf)
    labels = views.table(spark, sf, "labels")
    old_text = F.when(F.col("quality") == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))
    previous = corpus.join(labels, "doc_id").select("path", F.sha2(old_text, 256).alias("content_hash"))
    return g.changed_files(previous, corpus.select("path", F.col("text").cast("binary").alias("content")))


@registered("reannotated_files", needs=("corpus",), sql="""
SELECT c.path AS file_path, 'pending' AS status, sha256(c.text) AS content_hash
FROM corpus c JOIN labels l ON l.doc_id = c.doc_id WHERE l.quality = 0""")
def _(spark, sf):
    """Labelled documents are finished jobs; those of low quality were annotated with another text."""
    corpus, labels = views.corpus(spark, sf), views.table(spark, sf, "labels")
    old_text = F.when(F.col("quality") == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))
    done = state.add_jobs(state.empty_jobs(spark), corpus.join(labels, "doc_id", "left_semi").select("path"))
    hashed = corpus.join(labels, "doc_id").select(F.col("path").alias("file_path"), F.sha2(old_text, 256).alias("old"))
    done = done.join(hashed, "file_path").withColumns({"status": F.lit("complete"), "content_hash": F.col("old")})
    present = corpus.select("path", F.sha2("text", 256).alias("content_hash"))
    return state.reopen_changed(done.drop("old"), present).select("file_path", "status", "content_hash")

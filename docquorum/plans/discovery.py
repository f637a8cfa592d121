"""Queries over paths, languages, profiles and file selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquorum.functions import language as lang
from docquorum.functions import paths as p
from docquorum.operators import discover as d
from docquorum.plans import views
from docquorum.plans.registry import registered
from docquorum.session import posix_path, scratch_dir
from docquorum.sources import profiles as prof
from docquorum.sources.file_tree import read_tree
from docquorum.sources.ignore import ignore_rules, ignored
from docquorum.sources.text_tree import write_tree

IGNORE_LINES = ("# build products", "*.log", "build/", "", "/src3/en/", "run", "!src10/de/**/run")
GLOBS = ("requirements*.txt", "docker-compose*.yml", "src?/en/*.html", "[!a-m]ain.py", "*/d1*/tool")


def _quoted(values) -> str:
    return ", ".join("'" + value.replace("'", "''") + "'" for value in values)


EXT_SQL = r"lower(regexp_extract(path, '[^./][^/]*(\.[^./]*)$', 1))"
NAME_SQL = "string_split(path, '/')[-1]"
DIRS_SQL = "string_split(path, '/')[:-2]"
NUL_SQL = f"(contains(text, chr(0)) AND strlen(string_split(text, chr(0))[1]) < {p.SNIFF_BYTES})"
BINARY_SQL = f"({EXT_SQL} IN ({_quoted(p.BINARY_EXTENSIONS)}) OR {NUL_SQL})"
IGNORED_SQL = (
    "(path LIKE '%/build/%' OR path LIKE 'src3/en/%' OR path LIKE '%.log' "
    f"OR ({NAME_SQL} = 'run' AND path NOT LIKE 'src10/de/%'))"
)


def _match_sql(profiles) -> str:
    extensions = [ext for profile in profiles for ext in profile.extensions]
    patterns = [glob for profile in profiles for glob in profile.include_patterns]
    globs = " OR ".join(f"{NAME_SQL} GLOB '{g}' OR path GLOB '{g}'" for g in patterns)
    return f"({EXT_SQL} IN ({_quoted(extensions)}) OR {globs})"


def _pruned_sql(profiles) -> str:
    globs = [".git", *(glob for profile in profiles for glob in profile.exclude_dirs if "/" not in glob)]
    tests = " OR ".join(f"g GLOB '{glob}'" for glob in globs)
    return f"(len(list_filter({DIRS_SQL}, lambda g: {tests})) > 0)"


def _reason_sql(limit: int) -> str:
    return f"""CASE WHEN {BINARY_SQL} THEN 'binary file' WHEN strlen(text) = 0 THEN 'empty file'
  WHEN strlen(text) > {limit} THEN format('large file ({{:,}} bytes) — will be chunked', strlen(text)) END"""


DETECTED = [prof.bundled_profiles()[n] for n in ("config", "devops", "javascript", "python", "web")]
LIMIT = 8_000


@registered("normalised_paths", needs=("corpus",), sql="SELECT doc_id, path AS norm FROM corpus")
def _(spark, sf):
    windows = F.concat(F.lit(".\\"), F.replace("path", F.lit("/"), F.lit("\\")))
    return views.corpus(spark, sf).select("doc_id", p.norm_path(windows, "\\").alias("norm"))


@registered("extension_and_name", needs=("corpus",), sql=f"SELECT doc_id, {EXT_SQL} AS ext, {NAME_SQL} AS name FROM corpus")
def _(spark, sf):
    path = F.col("path")
    return views.corpus(spark, sf).select("doc_id", p.extension(path).alias("ext"), p.basename(path).alias("name"))


@registered("glob_match", needs=("corpus",), sql=f"""
SELECT path, {NAME_SQL} GLOB 'requirements*.txt' OR {NAME_SQL} GLOB 'docker-compose*.yml' OR path GLOB 'src?/en/*.html'
  OR regexp_matches({NAME_SQL}, '^[^a-m]ain\\.py$') OR path GLOB '*/d1*/tool' AS hit FROM corpus""")
def _(spark, sf):
    return views.corpus(spark, sf).select("path", p.name_or_path_match(F.col("path"), *GLOBS).alias("hit"))


@registered("binary_by_extension", needs=("corpus",), sql=f"""
SELECT path, {EXT_SQL} IN ({_quoted(p.BINARY_EXTENSIONS)}) AS is_binary FROM corpus""")
def _(spark, sf):
    return views.corpus(spark, sf).select("path", p.is_binary_name(F.col("path")).alias("is_binary"))


@registered("binary_by_content", needs=("corpus",), sql=f"SELECT path, {NUL_SQL} AS is_binary FROM corpus")
def _(spark, sf):
    return views.files(spark, sf).select("path", p.has_nul(F.col("content")).alias("is_binary"))


@registered("decoded_text", needs=("corpus",), sql="""
SELECT doc_id, replace(text, chr(13), chr(10)) || chr(65533) || chr(10) || 'end' AS decoded FROM corpus""")
def _(spark, sf):
    windows = F.replace("text", F.lit("\n"), F.lit("\r\n")).cast("binary")
    content = F.concat(windows, F.lit(bytearray(b"\xff\rend")))
    return views.corpus(spark, sf).select("doc_id", p.decode_text(content).alias("decoded"))


RUBY = "'vendor/bundle/' || path"


@registered("pruned_directories", needs=("corpus",), sql=f"""
SELECT path FROM corpus WHERE {_pruned_sql(DETECTED)}
UNION ALL SELECT {RUBY} FROM corpus WHERE len(list_filter({DIRS_SQL}, lambda g: g IN ('.git', '.bundle'))) > 0""")
def _(spark, sf):
    """A rule with a slash in it names no single directory, so files below ``vendor/bundle`` stay."""
    corpus, known = views.corpus(spark, sf).select("path"), prof.bundled_profiles()
    dirs = prof.merge_profiles([x.name for x in DETECTED], known).exclude_dirs
    plain = corpus.filter(p.under_directory(F.col("path"), d.ALWAYS_PRUNED, *dirs))
    below = corpus.select(F.concat(F.lit("vendor/bundle/"), "path").alias("path"))
    return plain.union(below.filter(p.under_directory(F.col("path"), d.ALWAYS_PRUNED, *known["ruby"].exclude_dirs)))


@registered("ignored_paths", needs=("corpus",), sql=f"SELECT path, {IGNORED_SQL} AS ignored FROM corpus")
def _(spark, sf):
    rules = ignore_rules(IGNORE_LINES)
    return views.corpus(spark, sf).select("path", ignored(F.col("path"), rules).alias("ignored"))


@registered("profile_match", needs=("corpus",), sql=f"SELECT path, {_match_sql(DETECTED)} AS matched FROM corpus")
def _(spark, sf):
    rules = prof.merge_profiles([x.name for x in DETECTED], prof.bundled_profiles())
    return views.corpus(spark, sf).select("path", d.matches_profile(F.col("path"), rules).alias("matched"))


_MARKERS = ", ".join(f"('{x.name}', '{m}')" for x in prof.BUNDLED for m in x.markers)
_DETECT_SQL = f"""hits AS (SELECT DISTINCT m.name FROM corpus c JOIN (VALUES {_MARKERS}) m(name, entry)
  ON string_split(c.path, '/')[1] = m.entry),
detected AS (SELECT name FROM hits UNION SELECT unnest(['config', 'devops', 'web']) FROM hits)"""


@registered("detected_profiles", needs=("corpus",), sql=f"WITH {_DETECT_SQL} SELECT name FROM detected ORDER BY name")
def _(spark, sf):
    return prof.detect_profiles(views.corpus(spark, sf))


_EXTS = ", ".join(f"('{x.name}', '{e}')" for x in prof.BUNDLED for e in x.extensions)


@registered("merged_profile_extensions", needs=("corpus",), sql=f"""
WITH {_DETECT_SQL}, merged AS (SELECT DISTINCT e.ext FROM detected t JOIN (VALUES {_EXTS}) e(name, ext) ON t.name = e.name)
SELECT m.ext, count(c.path) AS files FROM merged m LEFT JOIN (SELECT path, {EXT_SQL} AS ext FROM corpus) c ON c.ext = m.ext GROUP BY m.ext""")
def _(spark, sf):
    corpus = views.corpus(spark, sf)
    rules = prof.resolve_profiles(corpus)
    merged = spark.createDataFrame([(ext,) for ext in rules.extensions], "ext string")
    used = corpus.select(p.extension(F.col("path")).alias("ext")).groupBy("ext").agg(F.count(F.lit(1)).alias("files"))
    return F.broadcast(merged).join(used, "ext", "left").select("ext", F.coalesce("files", F.lit(0)).alias("files"))


@registered("discovered_files", needs=("corpus",), sql=f"""
SELECT path, CAST(strlen(text) AS BIGINT) AS size, NOT coalesce({BINARY_SQL} OR strlen(text) = 0, false) AS selected,
  {_reason_sql(LIMIT)} AS skip_reason
FROM corpus WHERE NOT {_pruned_sql(DETECTED)} AND NOT {IGNORED_SQL}
  AND ({BINARY_SQL} OR strlen(text) = 0 OR {_match_sql(DETECTED)})""")
def discovered_files(spark, sf, ordered=True):
    files = views.files(spark, sf)
    return d.discover(files, prof.resolve_profiles(files), ignore_rules(IGNORE_LINES), LIMIT, ordered=ordered)


@registered("named_profiles_all_text", needs=("corpus",), sql=f"""
SELECT path, CAST(strlen(text) AS BIGINT) AS size, NOT ({BINARY_SQL} OR strlen(text) = 0) AS selected, {_reason_sql(100_000)} AS skip_reason
FROM corpus WHERE NOT {_pruned_sql([prof.bundled_profiles()['python'], prof.bundled_profiles()['sql']])}""")
def _(spark, sf):
    files = views.files(spark, sf)
    return d.discover(files, prof.resolve_profiles(files, "python, sql", all_text_files=True))


@registered("extra_excludes", needs=("corpus",), sql=f"""
SELECT path, NOT ({BINARY_SQL} OR strlen(text) = 0) AS selected
FROM corpus WHERE NOT list_contains({DIRS_SQL}, '.git') AND path NOT GLOB 'src1*/*' AND {NAME_SQL} NOT GLOB '*.env*'""")
def _(spark, sf):
    files = views.files(spark, sf)
    rules = prof.resolve_profiles(files, all_text_files=True)
    return d.discover(files, rules, extra_excludes=("src1*/*", "*.env*")).select("path", "selected")


@registered("skip_ledger", needs=("corpus",), sql=f"""
SELECT path, {_reason_sql(LIMIT)} AS skip_reason FROM corpus
WHERE NOT {_pruned_sql(DETECTED)} AND NOT {IGNORED_SQL} AND {_reason_sql(LIMIT)} IS NOT NULL
  AND ({BINARY_SQL} OR strlen(text) = 0 OR {_match_sql(DETECTED)})""")
def _(spark, sf):
    return d.skip_ledger(discovered_files(spark, sf, ordered=False))


@registered("unreadable_files", needs=("corpus",), sql=f"""
SELECT c.path, CASE WHEN {BINARY_SQL.replace('path', 'c.path').replace('text', 'c.text')} THEN 'binary file'
  ELSE 'unable to stat' END AS skip_reason
FROM corpus c JOIN labels l ON l.doc_id = c.doc_id WHERE l.quality = 0 AND NOT list_contains({DIRS_SQL.replace('path', 'c.path')}, '.git')""")
def _(spark, sf):
    """Labelled documents of low quality stand for files whose size could not be read."""
    low = views.table(spark, sf, "labels").filter("quality = 0").select("doc_id")
    paths = views.corpus(spark, sf).join(low, "doc_id", "left_semi").select("path")
    files = views.files(spark, sf).join(paths, "path", "left_semi").withColumn("size", F.lit(None).cast("bigint"))
    rules = prof.resolve_profiles(files, all_text_files=True)
    return d.skip_ledger(d.discover(files, rules, ordered=False))


@registered("skip_count", needs=("corpus",), sql=f"""
SELECT count(*) AS skipped FROM corpus
WHERE NOT {_pruned_sql(DETECTED)} AND NOT {IGNORED_SQL} AND {_reason_sql(LIMIT)} IS NOT NULL
  AND ({BINARY_SQL} OR strlen(text) = 0 OR {_match_sql(DETECTED)})""")
def _(spark, sf):
    return d.skip_count(discovered_files(spark, sf, ordered=False))


# The expected values are written out, so that a wrong entry of the code under test shows.
_LANG_OF_EXT = """
('.py', 'Python'), ('.pyx', 'Python'), ('.pxd', 'Python'), ('.js', 'JavaScript'), ('.jsx', 'JavaScript'),
('.mjs', 'JavaScript'), ('.cjs', 'JavaScript'), ('.ts', 'TypeScript'), ('.tsx', 'TypeScript'), ('.java',
'Java'), ('.kt', 'Kotlin'), ('.kts', 'Kotlin'), ('.go', 'Go'), ('.rb', 'Ruby'), ('.rake', 'Ruby'),
('.gemspec', 'Ruby'), ('.rs', 'Rust'), ('.php', 'PHP'), ('.c', 'C'), ('.h', 'C'), ('.cpp', 'C++'), ('.cxx',
'C++'), ('.cc', 'C++'), ('.hpp', 'C++'), ('.cs', 'C#'), ('.swift', 'Swift'), ('.scala', 'Scala'), ('.r', 'R'),
('.lua', 'Lua'), ('.pl', 'Perl'), ('.pm', 'Perl'), ('.ex', 'Elixir'), ('.exs', 'Elixir'), ('.erl', 'Erlang'),
('.hrl', 'Erlang'), ('.hs', 'Haskell'), ('.clj', 'Clojure'), ('.cljs', 'Clojure'), ('.dart', 'Dart'), ('.vue',
'Vue'), ('.svelte', 'Svelte'), ('.sh', 'Shell'), ('.bash', 'Shell'), ('.zsh', 'Shell'), ('.sql', 'SQL'),
('.yaml', 'YAML'), ('.yml', 'YAML'), ('.json', 'JSON'), ('.toml', 'TOML'), ('.ini', 'INI'), ('.cfg', 'INI'),
('.conf', 'INI'), ('.xml', 'XML'), ('.html', 'HTML'), ('.htm', 'HTML'), ('.css', 'CSS'), ('.scss', 'SCSS'),
('.sass', 'SASS'), ('.less', 'LESS'), ('.md', 'Markdown'), ('.rst', 'reStructuredText'), ('.dockerfile',
'Dockerfile'), ('.tf', 'Terraform'), ('.jinja', 'Jinja'), ('.jinja2', 'Jinja'), ('.mako', 'Mako'), ('.ejs',
'EJS'), ('.hbs', 'Handlebars'), ('.pug', 'Pug'), ('.erb', 'ERB')
"""
_LANG_OF_NAME = """
('Dockerfile', 'Dockerfile'), ('Makefile', 'Shell'), ('Jenkinsfile', 'Groovy'), ('Gemfile', 'Ruby'),
('Rakefile', 'Ruby'), ('Vagrantfile', 'Ruby')
"""
_SHEBANG = " ".join(f"WHEN contains(first, '{w}') THEN '{v}'" for w, v in lang.SHEBANG_ORDER)
LANGUAGES_SQL = f"""languages AS (
SELECT c.path, e.language AS by_extension, n.language AS by_name,
  CASE WHEN starts_with(first, '#!') THEN CASE {_SHEBANG} END END AS by_shebang
FROM (SELECT path, string_split(text, chr(10))[1] AS first FROM corpus) c
LEFT JOIN (VALUES {_LANG_OF_EXT}) e(ext, language) ON {EXT_SQL.replace('path', 'c.path')} = e.ext
LEFT JOIN (VALUES {_LANG_OF_NAME}) n(name, language) ON {NAME_SQL.replace('path', 'c.path')} = n.name),
detected_language AS (SELECT path, coalesce(by_extension, by_name, by_shebang, 'Unknown') AS language FROM languages)"""


@registered("detected_languages", needs=("corpus",), sql=f"""
WITH {LANGUAGES_SQL} SELECT *, coalesce(by_extension, by_name, by_shebang, 'Unknown') AS language FROM languages""")
def _(spark, sf):
    path, text = F.col("path"), F.col("text")
    return views.corpus(spark, sf).select(
        "path", lang.language_by_extension(path).alias("by_extension"), lang.language_by_name(path).alias("by_name"),
        lang.language_by_shebang(text).alias("by_shebang"), lang.detect_language(path, text).alias("language"),
    )


_KEY_OF = ", ".join(f"('{k}', '{v}')" for k, v in lang.HINT_KEY_OF_LANGUAGE.items())
_HINT_OF = ", ".join(f"('{k}', {_quoted([v])})" for k, v in lang.HINTS.items())


@registered("prompt_snippets", needs=("corpus",), sql=f"""
WITH {LANGUAGES_SQL} SELECT d.path, d.language, coalesce(k.key, '') AS hint_key, coalesce(h.hint, '') AS snippet
FROM detected_language d LEFT JOIN (VALUES {_KEY_OF}) k(language, key) ON k.language = d.language
LEFT JOIN (VALUES {_HINT_OF}) h(key, hint) ON h.key = k.key""")
def _(spark, sf):
    named = views.corpus(spark, sf).select("path", lang.detect_language(F.col("path"), F.col("text")).alias("language"))
    keyed = named.withColumn("hint_key", lang.hint_key(F.col("language")))
    table = F.broadcast(lang.snippets(spark).withColumnRenamed("key", "hint_key"))
    return keyed.join(table, "hint_key", "left").select(
        "path", "language", "hint_key", F.coalesce("snippet", F.lit("")).alias("snippet")
    )


@registered("written_and_read_tree", needs=("corpus",), sql="""
SELECT path, CAST(strlen(text) AS BIGINT) AS size, contains(text, chr(0)) AS is_binary, length(text) AS chars FROM corpus""")
def _(spark, sf):
    root = posix_path(scratch_dir(spark, "tree"))
    write_tree(views.corpus(spark, sf), root)
    content = F.col("content")
    return read_tree(spark, root).select(
        "path", "size", p.has_nul(content).alias("is_binary"),
        F.length(p.decode_text(content)).cast("bigint").alias("chars"),
    )

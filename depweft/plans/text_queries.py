"""Queries over the texts of files, pages and logs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweft.functions import fixed, keys
from depweft.functions.projects import is_binary_name, project_id
from depweft.functions.text import digest_norm
from depweft.operators import classify as cls
from depweft.operators import extract, monitor
from depweft.operators.index import text_references
from depweft.operators.notes import has_secrets
from depweft.operators.resolve import expanded, resolved
from depweft.plans.core_problems import node_states
from depweft.session import cut, tables
from depweft.sources.git import clipped_ranges, deployments_of, same_deployment, valid_path


def file_texts(spark: SparkSession, d: str) -> DataFrame:
    """path, text of the files whose content is known."""
    (documents,) = tables(spark, d, "documents")
    return documents.where(F.col("node_key").startswith("file:")).select(keys.relative(F.col("node_key")).alias("path"), "text")


def refs_static(spark, d):
    return extract.static_references(file_texts(spark, d))


def refs_web(spark, d):
    return extract.web_references(file_texts(spark, d))


def refs_python_streamed(spark, d):
    return extract.python_streamed(file_texts(spark, d))


def refs_python_parsed(spark, d):
    return extract.parsed_references(file_texts(spark, d))[0]


def python_failures(spark, d):
    return extract.parsed_references(file_texts(spark, d))[1]


def refs_semantic(spark, d):
    return extract.semantic_references(file_texts(spark, d))


def resolved_edges(spark, d):
    """Edges of the references that all extractors find, against all known files."""
    (nodes,) = tables(spark, d, "nodes")
    inventory = nodes.where(F.col("key").startswith("file:")).select(keys.relative(F.col("key")).alias("path")).distinct()
    refs = cut(text_references(file_texts(spark, d).where(F.col("text").isNotNull()))[0])
    return resolved(refs, inventory).unionByName(expanded(refs, inventory)).distinct()


def text_digests(spark, d):
    (documents,) = tables(spark, d, "documents")
    return documents.where(F.col("text").isNotNull()).select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


def text_copies(spark, d):
    """Texts that occur more than once: digest, copies, first id."""
    (documents,) = tables(spark, d, "documents")
    return documents.where(F.col("text").isNotNull()).groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def digest_checks(spark, d):
    """Digests of file texts against those the nodes record."""
    documents, nodes = tables(spark, d, "documents", "nodes")
    current = node_states(nodes).select(F.col("key").alias("node_key"), digest_norm(F.col("digest")).alias("expected"))
    rows = documents.where(F.col("node_key").isNotNull() & F.col("text").isNotNull()).select("doc_id", "node_key", F.sha2("text", 256).alias("actual")).join(current, "node_key")
    return rows.select("doc_id", monitor.verdict(F.col("actual"), F.col("expected"), F.lit("sha256")).alias("verdict"))


def secret_files(spark, d):
    (documents,) = tables(spark, d, "documents")
    path = F.coalesce(keys.relative(F.col("node_key")), F.lit(""))
    return documents.where(F.col("text").isNotNull() & has_secrets(path, F.col("text"))).select("doc_id")


def safe_files(spark, d):
    (nodes,) = tables(spark, d, "nodes")
    path = keys.relative(F.col("key"))
    return nodes.where(F.col("key").startswith("file:")).select("key").distinct().where(monitor.safe_source(path))


def visible_pages(spark, d):
    (documents,) = tables(spark, d, "documents")
    pages = documents.where(F.lower(F.replace(F.trim("source"), F.lit("_"), F.lit("-"))) == "web-page").where(F.col("text").isNotNull())
    return pages.select("doc_id", monitor.visible_by_pattern(F.col("text")).alias("visible"))


def visible_pages_parsed(spark, d):
    (documents,) = tables(spark, d, "documents")
    pages = documents.where(F.lower(F.replace(F.trim("source"), F.lit("_"), F.lit("-"))) == "web-page")
    return monitor.visible_text(pages.select("doc_id", F.col("text").alias("body"), F.lit("text/html").alias("type"))).select("doc_id", "visible")


def excerpts(spark, d):
    (documents,) = tables(spark, d, "documents")
    t = F.col("text")
    return documents.where(t.isNotNull()).select("doc_id", F.left(t, F.lit(350)).alias("short"), F.length(F.left(t, F.lit(1600))).alias("sample_chars"), (F.length(t) > 12_000).alias("truncated"))


def wrapped_lines(spark, d):
    """The twelve-word lines of each whole text."""
    (documents,) = tables(spark, d, "documents")
    rows = monitor.wrapped_words(F.regexp_replace("text", r"[ \t\n\r\f]+", " "))
    return documents.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(rows).alias("n", "line"))


def commit_lines(spark, d):
    """Commits named in commit logs: short sha, kind and message."""
    (documents,) = tables(spark, d, "documents")
    logs = documents.where(F.lower(F.replace(F.trim("source"), F.lit("_"), F.lit("-"))) == "commit-log")
    lines = logs.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    form = r"^([0-9a-f]{7,40}) ([a-z]+): (.*)$"
    return lines.where(F.col("line").rlike(form)).select("doc_id", F.regexp_extract("line", form, 1).alias("sha"), F.regexp_extract("line", form, 2).alias("kind"), F.left(F.regexp_extract("line", form, 3), F.lit(250)).alias("message")).distinct()


def _hunks(spark, d) -> DataFrame:
    (documents,) = tables(spark, d, "documents")
    form = r"@@ -\d+,\d+ \+(\d+),(\d+) @@"
    found = documents.where(F.col("text").isNotNull()).select("doc_id", F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(form), 1).alias("a"), F.regexp_extract_all("text", F.lit(form), 2).alias("n"))).alias("h"))
    return found.select("doc_id", F.col("h.a").cast("int").alias("start"), (F.col("h.a").cast("int") + F.col("h.n").cast("int") - 1).alias("end"))


def hunk_ranges(spark, d):
    """Changed line ranges of diffs, cut to the wanted lines 10 to 60."""
    hunks = _hunks(spark, d)
    wanted = hunks.select("doc_id").distinct().select("doc_id", F.lit(10).alias("want_start"), F.lit(60).alias("want_end"))
    return clipped_ranges(hunks, wanted, "doc_id").distinct()


def diff_paths(spark, d):
    """Files named in diffs, and whether the name is a valid path."""
    (documents,) = tables(spark, d, "documents")
    names = documents.where(F.col("text").isNotNull()).select(F.explode(F.regexp_extract_all("text", F.lit(r"diff --git a/(\S+) b/"), 1)).alias("path")).distinct()
    return names.select("path", valid_path(F.col("path")).alias("valid"))


def page_addresses(spark, d):
    """Canonical addresses of monitored pages; null where an address is not public."""
    (targets,) = tables(spark, d, "targets")
    return targets.where(F.col("target").isNotNull()).select("target").distinct().select("target", monitor.target_address(F.col("target")).alias("address"))


def page_deployments(spark, d):
    """Monitored pages and the deployments whose base address covers them; each page's own first folder counts as deployed."""
    (targets,) = tables(spark, d, "targets")
    pages = targets.where(F.col("kind") == "web").select(F.col("target").alias("url")).distinct()
    made = pages.select(F.xxhash64("url").alias("deployment_id"), F.sha2("url", 256).alias("sha"), F.regexp_extract("url", r"^(https://[^/]+/[^/]*)", 1).alias("environment_url"), F.lit("success").alias("state"), F.lit("2026-01-01").alias("created_at"))
    return deployments_of(pages, made).where(same_deployment(F.col("url"), F.col("environment_url"))).select("url", "environment_url", "sha")


def classified(spark, d):
    """Language and category of all known files, by name, with the catalogue that typed files show."""
    nodes, file_types = tables(spark, d, "nodes", "file_types")
    files = nodes.where(F.col("key").startswith("file:")).select(keys.relative(F.col("key")).alias("path"), F.lit(None).cast("binary").alias("header")).distinct()
    out = cls.classify(files, cls.merged_catalogue(cls.built_in(spark), cls.learned_catalogue(file_types)))
    return out.select("path", "language", "category", "evidence")


def catalogue_status(spark, d):
    (file_types,) = tables(spark, d, "file_types")
    return cls.learned_catalogue(file_types).agg(F.countDistinct("ending").alias("n_endings"), F.countDistinct("language").alias("n_languages"), F.countDistinct(F.when(F.col("analyzer") != "inventory", F.col("analyzer"))).alias("n_analyzers"))


def project_ids(spark, d):
    """Ids of the projects that documents name."""
    (documents,) = tables(spark, d, "documents")
    rows = documents.where(F.col("project").isNotNull()).select("project").distinct()
    return rows.select("project", project_id(F.col("project"), F.concat(F.lit("/srv/"), "project"), F.lit(None).cast("string")).alias("id"))


def binary_names(spark, d):
    """Known files whose name is that of a binary."""
    (nodes,) = tables(spark, d, "nodes")
    return nodes.where(F.col("key").startswith("file:")).select("key").distinct().where(is_binary_name(keys.relative(F.col("key"))))


_ALL = (
    refs_static, refs_web, refs_python_streamed, refs_python_parsed, python_failures, refs_semantic, resolved_edges, text_digests, text_copies, digest_checks, secret_files, safe_files, visible_pages, visible_pages_parsed, excerpts, wrapped_lines, commit_lines,
    hunk_ranges, diff_paths, page_addresses, page_deployments, classified, catalogue_status, project_ids, binary_names,
)
QUERIES = {f.__name__: f for f in _ALL}

# ---- SQL ----

_FILES = """files AS (SELECT substr(node_key, 6) AS path, text, lower(regexp_extract(regexp_extract(node_key, '[^/]*$'), '^.+(\\.[^.]+)$', 1)) AS ending FROM documents WHERE starts_with(node_key, 'file:') AND text IS NOT NULL)"""


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _patterns(table: list[tuple]) -> str:
    parts = []
    for endings, relation, evidence, mode, pattern in table:
        p = "(?m)" + pattern if not pattern.startswith("(?i)") else "(?im)" + pattern[4:]
        ends = ", ".join(_q(e) for e in endings)
        parts.append(f"SELECT path, trim(unnest(regexp_extract_all(text, {_q(p)}, 1)), ' ') AS spec, {_q(relation)} AS relation, {_q(evidence)} AS evidence, {_q(mode)} AS mode FROM files WHERE ending IN ({ends})")
    return " UNION ALL ".join(parts)


_SUFFIX = "lower(regexp_extract(regexp_extract({0}, '[^/]*$'), '^.+(\\.[^.]+)$', 1))"
_SOURCE = "lower(replace(trim(source), '_', '-'))"
_NORM = "regexp_replace(lower(trim(digest)), '^sha256:', '')"
_CATALOGUE = """counted AS (SELECT regexp_extract(evidence, '^extension:(\\..+)$', 1) AS ending, language, lower(trim(category)) AS category, analyzer, count(*) AS n FROM file_types WHERE language IS NOT NULL AND analyzer IS NOT NULL GROUP BY ALL),
learned AS (SELECT ending, language, category, analyzer FROM (SELECT *, row_number() OVER (PARTITION BY ending, language ORDER BY n DESC, category DESC, analyzer DESC) AS rn FROM counted WHERE ending <> '') WHERE rn = 1)"""
_CUT = "trim(split_part(split_part(spec, '?', 1), '#', 1))"
_VALUE = f"CASE WHEN contains({_CUT}, '%') THEN url_decode({_CUT}) ELSE {_CUT} END"
_ENDINGS = ", ".join(f"({_q(e)}, {_q(a)}, {_q(b)}, {_q(c)}, {i})" for i, (a, b, c, ends) in enumerate(fixed.ANALYZED) for e in ends.split())
_NAMED = ", ".join(f"({_q(n)}, {_q(a)}, {_q(b)})" for n, a, b, _ in fixed.FILE_NAMES)
_FORM = "^[hH][tT][tT][pP][sS]?://([^/?#\\\\@:\\s]+)(?::(\\d+))?(/[^?#]*)?(\\?[^#]*)?(?:#.*)?$"

SQL = {
    "refs_static": f"""WITH {_FILES}, refs AS ({_patterns(fixed.PATTERNS)})
SELECT DISTINCT * FROM refs WHERE spec <> '' AND NOT (relation IN ('static-import', 'module-source') AND (contains(spec, '$') OR contains(spec, '{{') OR length(spec) > 700))""",
    "refs_web": f"""WITH {_FILES}, refs AS ({_patterns(fixed.WEB_PATTERNS)})
SELECT DISTINCT * FROM refs WHERE spec <> '' AND (mode <> 'resource' OR {_SUFFIX.format("split_part(spec, '?', 1)")} IN ({", ".join(_q(s) for s in fixed.RESOURCE_SUFFIXES)}))""",
    "refs_python_streamed": f"WITH {_FILES}, refs AS ({_patterns([(['.py', '.pyi'], 'python-import', 'heuristic', 'python', p) for p in fixed.STREAM_PYTHON])}) SELECT DISTINCT * FROM refs WHERE spec <> ''",
    "refs_semantic": f"""WITH {_FILES}, refs AS ({_patterns(fixed.SEMANTIC_PATTERNS)}),
one AS (SELECT path, trim(unnest(CASE WHEN mode = 'srcset' THEN list_transform(string_split(spec, ','), lambda x: split_part(trim(x), ' ', 1)) ELSE [spec] END)) AS spec, relation, evidence, mode FROM refs WHERE spec <> ''),
v AS (SELECT *, {_VALUE} AS val, contains(spec, '${{') AS templated FROM one WHERE spec <> ''),
ok AS (SELECT *, {_SUFFIX.format("val")} AS vend FROM v WHERE val <> '' AND NOT regexp_matches(val, '^(//|https?:|data:|javascript:|mailto:|node:)') AND NOT contains(val, '://') AND NOT contains(val, '\\') AND length(spec) <= 1200)
SELECT DISTINCT path, spec, relation, CASE WHEN templated OR (mode = 'read' AND NOT regexp_matches(spec, '^(\\.|/|@|src/|public/)')) THEN 'inferred' ELSE evidence END AS evidence, CASE WHEN templated THEN 'glob' WHEN mode = 'read' THEN 'read' ELSE 'semantic' END AS mode
FROM ok WHERE templated OR mode IN ('semantic', 'read') OR vend IN ({", ".join(_q(x) for x in fixed.ASSET_SUFFIXES)})""",
    "classified": f"""WITH {_CATALOGUE}, built(ending, language, category, analyzer, o) AS (VALUES {_ENDINGS}), named(name, language, category) AS (VALUES {_NAMED}),
merged AS (SELECT ending, language, category, analyzer, 0 AS src, o FROM built UNION ALL SELECT ending, language, category, analyzer, 1, 0 FROM learned l WHERE NOT EXISTS (SELECT 1 FROM built b WHERE b.ending = l.ending AND b.language = l.language)),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ending ORDER BY analyzer = 'inventory', src, o, language) AS rn FROM merged) WHERE rn = 1),
f AS (SELECT DISTINCT substr(key, 6) AS path, regexp_extract(key, '[^/:]*$') AS name FROM nodes WHERE starts_with(key, 'file:')),
hit AS (SELECT f.path, c.ending, c.language, c.category, row_number() OVER (PARTITION BY f.path ORDER BY length(c.ending) DESC) AS rn FROM f JOIN chosen c ON suffix(lower(f.name), c.ending))
SELECT f.path, coalesce(n.language, h.language, 'Unknown') AS language, coalesce(n.category, h.category, 'unknown') AS category, CASE WHEN n.name IS NOT NULL THEN 'filename' WHEN h.path IS NOT NULL THEN 'extension:' || h.ending ELSE 'unrecognized' END AS evidence
FROM f LEFT JOIN named n ON n.name = f.name LEFT JOIN hit h ON h.path = f.path AND h.rn = 1""",
    "text_digests": "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents WHERE text IS NOT NULL",
    "text_copies": "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "digest_checks": f"""WITH cur AS (SELECT key, {_NORM} AS expected FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY updated DESC NULLS LAST, loaded_at DESC NULLS LAST) AS rn FROM nodes) WHERE rn = 1)
SELECT doc_id, CASE WHEN expected IS NULL OR NOT regexp_full_match(expected, '[0-9a-f]{{64}}') THEN 'malformed' WHEN expected = sha256(text) THEN 'matches' ELSE 'differs' END AS verdict FROM documents JOIN cur ON key = node_key WHERE text IS NOT NULL""",
    "secret_files": "SELECT doc_id FROM documents WHERE text IS NOT NULL AND ("
    + f"regexp_matches(CASE WHEN starts_with(node_key, 'file:') THEN substr(node_key, 6) ELSE '' END, {_q(fixed.SECRET_NAMES)}) OR "
    + " OR ".join(f"regexp_matches(text, {_q(p)})" for p in fixed.SECRET_HINTS)
    + ")",
    "safe_files": f"""WITH k AS (SELECT DISTINCT key, string_split(substr(key, 6), '/') AS parts, string_split(lower(substr(key, 6)), '/') AS low FROM nodes WHERE starts_with(key, 'file:'))
SELECT key FROM k WHERE len(list_filter(low, lambda p: starts_with(p, '.env') OR p IN ({", ".join(_q(x) for x in fixed.UNSAFE_NAMES)}))) = 0
  AND {_SUFFIX.format("key")} NOT IN ({", ".join(_q(x) for x in fixed.UNSAFE_SUFFIXES)}) AND len(list_filter(parts, lambda p: p IN ({", ".join(_q(x) for x in fixed.UNSAFE_FOLDERS)}) OR starts_with(p, '{fixed.UNSAFE_FOLDER_START}'))) = 0""",
    "visible_pages": "SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace("
    + "regexp_replace(" * 4
    + "text"
    + "".join(f", '(?is)<{t}[^>]*>.*?</{t}>', ' ', 'g')" for t in fixed.HIDDEN_TAGS)
    + f", '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ') AS visible FROM documents WHERE {_SOURCE} = 'web-page' AND text IS NOT NULL",
    "excerpts": "SELECT doc_id, left(text, 350) AS short, length(left(text, 1600))::INT AS sample_chars, length(text) > 12000 AS truncated FROM documents WHERE text IS NOT NULL",
    "wrapped_lines": """WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' '), lambda x: x <> '')[1:2400] AS ws FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, ws, unnest(range(0, (len(ws) + 11) // 12)) AS n FROM w)
SELECT doc_id, n::INT AS n, array_to_string(ws[n * 12 + 1:n * 12 + 12], ' ') AS line FROM k""",
    "commit_lines": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE {_SOURCE} = 'commit-log')
SELECT DISTINCT doc_id, regexp_extract(line, '^([0-9a-f]{{7,40}}) ([a-z]+): (.*)$', 1) AS sha, regexp_extract(line, '^([0-9a-f]{{7,40}}) ([a-z]+): (.*)$', 2) AS kind, left(regexp_extract(line, '^([0-9a-f]{{7,40}}) ([a-z]+): (.*)$', 3), 250) AS message
FROM l WHERE regexp_matches(line, '^([0-9a-f]{{7,40}}) ([a-z]+): (.*)$')""",
    "hunk_ranges": """WITH h AS (SELECT doc_id, unnest(regexp_extract_all(text, '@@ -\\d+,\\d+ \\+(\\d+),(\\d+) @@', 1))::INT AS s, unnest(regexp_extract_all(text, '@@ -\\d+,\\d+ \\+(\\d+),(\\d+) @@', 2))::INT AS n FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT doc_id, greatest(s, 10)::INT AS start, least(s + n - 1, 60)::INT AS "end" FROM h WHERE s <= 60 AND s + n - 1 >= 10""",
    "diff_paths": """WITH p AS (SELECT DISTINCT unnest(regexp_extract_all(text, 'diff --git a/(\\S+) b/', 1)) AS path FROM documents WHERE text IS NOT NULL)
SELECT path, length(path) BETWEEN 1 AND 400 AND NOT starts_with(path, '/') AND NOT contains(path, '\\') AND len(list_filter(string_split(path, '/'), lambda x: x IN ('', '.', '..'))) = 0 AS valid FROM p""",
    "page_addresses": f"""WITH t AS (SELECT DISTINCT target, lower(regexp_extract(target, '{_FORM}', 1)) AS host, regexp_extract(target, '{_FORM}', 2) AS port, regexp_extract(target, '{_FORM}', 3) AS path, regexp_extract(target, '{_FORM}', 4) AS query,
  lower(split_part(target, '://', 1)) AS scheme, regexp_matches(target, '{_FORM}') AS ok FROM targets WHERE target IS NOT NULL)
SELECT target, CASE WHEN ok AND NOT (host IN ('', 'localhost') OR {" OR ".join(f"suffix(host, '{e}')" for e in fixed.BLOCKED_HOST_ENDS)} OR regexp_matches(host, '^(0|10|127)\\.|^169\\.254\\.|^192\\.168\\.|^\\d+$')) AND port IN ('', '80', '443')
  THEN scheme || '://' || host || CASE WHEN port <> '' THEN ':' || port ELSE '' END || CASE WHEN path = '' THEN '/' ELSE path END || query END AS address FROM t""",
    "page_deployments": """WITH p AS (SELECT DISTINCT target AS url FROM targets WHERE kind = 'web'), e AS (SELECT url AS own, regexp_extract(url, '^(https://[^/]+/[^/]*)', 1) AS env, sha256(url) AS sha FROM p)
SELECT url, env AS environment_url, sha FROM p JOIN e ON split_part(url, '/', 3) = split_part(env, '/', 3) AND (url = rtrim(env, '/') OR starts_with(url, rtrim(env, '/') || '/'))""",
    "project_ids": """SELECT DISTINCT project, CASE WHEN s = '' THEN 'project' ELSE s END || '-' || left(sha256(encode(lower('/srv/' || project)) || '\\x00'::BLOB), 12) AS id
FROM (SELECT project, left(lower(regexp_replace(regexp_replace(project, '[^a-zA-Z0-9_-]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g')), 48) AS s FROM documents WHERE project IS NOT NULL)""",
    "binary_names": f"SELECT DISTINCT key FROM nodes WHERE starts_with(key, 'file:') AND {_SUFFIX.format('key')} IN ({', '.join(_q(x) for x in fixed.BINARY_SUFFIXES)})",
    "catalogue_status": f"WITH {_CATALOGUE} SELECT count(DISTINCT ending) AS n_endings, count(DISTINCT language) AS n_languages, count(DISTINCT CASE WHEN analyzer <> 'inventory' THEN analyzer END) AS n_analyzers FROM learned",
}

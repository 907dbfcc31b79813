"""Queries of bounded walks, notes and answers, contents, names of changes and projects, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from depweft.functions import fixed, keys
from depweft.operators import classify as cls
from depweft.operators import export, graph, monitor, notes
from depweft.operators.snapshots import target_changes
from depweft.plans.core_problems import SQL as CORE_SQL
from depweft.plans.graph_queries import _IMPACT, _WITH, SETTINGS, load
from depweft.plans.graph_queries import SQL as GRAPH_SQL
from depweft.plans.monitor_queries import _NOTES, _latest_notes
from depweft.plans.text_queries import _ENDINGS, _FILES, _NAMED, _q, file_texts
from depweft.session import tables

BOUND, CAP, MARKED = 100, 12_000, 2_000


def impact_bounded(spark, d):
    """Consumers up to the level in which a bound on nodes is reached."""
    return graph.impact(load(spark, d)[1], SETTINGS, max_nodes=BOUND)[0].select("key", "distance", "certainty")


def prepared_notes(spark, d):
    """What a model would be given of each file: characters, whether they are cut, and references."""
    _, edges = load(spark, d)
    rows = notes.prepared(file_texts(spark, d), edges, CAP)
    return rows.select("path", F.length("code").alias("chars"), "truncated", F.size("references").alias("n_references"))


def note_answers(spark, d):
    """Fields of the notes, decoded as a model would answer with them."""
    v = _latest_notes(spark, d).where(F.col("note_json").isNotNull())
    note = notes.decode_answer(F.concat(F.lit("```json\n"), "note_json", F.lit("\n```")))
    return v.select("key", note.alias("n")).where(F.col("n").isNotNull()).select("key", F.col("n.summary").alias("summary"), F.size("n.responsibilities").alias("n_responsibilities"))


def file_markers(spark, d):
    """What a manifest holds of each text, if texts above a bound have no digest."""
    (documents,) = tables(spark, d, "documents")
    size = F.length("text").cast("bigint")
    return documents.where(F.col("text").isNotNull()).select("doc_id", monitor.marker(size, F.lit(0).cast("bigint"), F.sha2("text", 256), largest=MARKED).alias("marker"))


def classified_contents(spark, d):
    """Language of the files whose text is known, by name, interpreter line, ending and content, with the built-in catalogue."""
    files = file_texts(spark, d).where(F.col("text").isNotNull()).select("path", F.encode(F.left("text", F.lit(4096)), "UTF-8").alias("header")).dropDuplicates(["path"])
    return cls.classify(files, cls.built_in(spark)).select("path", "language", "category", "evidence")


def change_names(spark, d):
    """The first 30 names of each kind of change of a target, and the count of all."""
    (targets,) = tables(spark, d, "targets")
    return monitor.change_names(target_changes(targets).distinct())


def projects(spark, d):
    """Projects by name, without regard to case."""
    (documents,) = tables(spark, d, "documents")
    return documents.where(F.col("project").isNotNull()).select("project").distinct().orderBy(F.lower("project"), "project")


def first_imports(spark, d):
    """Modules that a Python file imports, in the order in which they first occur."""
    files = file_texts(spark, d).where((keys.suffix(F.col("path")) == ".py") & F.col("text").isNotNull())
    rows = files.select("path", F.posexplode(F.regexp_extract_all("text", F.lit("(?m)" + fixed.STREAM_PYTHON[0]), 1)).alias("n", "module"))
    return monitor.first_seen(rows, "n", "path", "module")


def audit_export(spark, d):
    return export.audit_records(*load(spark, d))


def shown_targets(spark, d):
    """Rows of targets as others see them."""
    (targets,) = tables(spark, d, "targets")
    return monitor.shown(targets).select("snap_no", "id", "target", "last_sha", "last_state").distinct()


_ALL = (impact_bounded, prepared_notes, note_answers, file_markers, classified_contents, change_names, projects, first_imports, audit_export, shown_targets)
QUERIES = {f.__name__: f for f in _ALL}

_RUN = " ".join(f"WHEN regexp_matches(first, '(?:/|\\s){i}(?:[0-9.\\s]|$)') THEN {_q(lang)}" for i, lang, _ in fixed.INTERPRETERS)
SQL = {
    "impact_bounded": f"""{_IMPACT}, levels AS (SELECT distance, sum(count(*)) OVER (ORDER BY distance) + 1 AS n FROM consumers WHERE key <> '{SETTINGS}' GROUP BY distance)
SELECT * FROM consumers WHERE key <> '{SETTINGS}' AND distance <= coalesce((SELECT min(distance) FROM levels WHERE n >= {BOUND}), 25)""",
    "prepared_notes": f"""{_WITH}, t AS (SELECT substr(node_key, 6) AS path, text FROM documents WHERE starts_with(node_key, 'file:') AND text IS NOT NULL), r AS (SELECT source, least(count(*), 100) AS n FROM e GROUP BY source)
SELECT path, least(length(text), {CAP})::INT AS chars, length(text) > {CAP} AS truncated, coalesce(r.n, 0)::INT AS n_references FROM t LEFT JOIN r ON r.source = 'file:' || path
WHERE NOT regexp_matches(path, {_q(fixed.SECRET_NAMES)}) AND NOT ({" OR ".join(f"regexp_matches(text, {_q(p)})" for p in fixed.SECRET_HINTS)})""",
    "note_answers": f"""WITH {_NOTES}, s AS (SELECT node_key AS key, trim(json_extract_string(note_json, '$.summary'), ' ') AS summary, note_json FROM notes WHERE note_json IS NOT NULL)
SELECT key, left(summary, 1800) AS summary, least(coalesce(json_array_length(note_json, '$.responsibilities'), 0), 15)::INT AS n_responsibilities FROM s WHERE summary <> ''""",
    "file_markers": f"SELECT doc_id, CASE WHEN length(text) > {MARKED} THEN 'metadata-only:' || length(text) || ':0' ELSE 'sha256:' || sha256(text) END AS marker FROM documents WHERE text IS NOT NULL",
    "classified_contents": f"""WITH {_FILES}, built(ending, language, category, analyzer, o) AS (VALUES {_ENDINGS}), named(name, language, category) AS (VALUES {_NAMED}),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ending ORDER BY analyzer = 'inventory', o, language) AS rn FROM built) WHERE rn = 1),
f AS (SELECT path, any_value(regexp_extract(path, '[^/]*$')) AS name, any_value(lower(split_part(left(text, 256), chr(10), 1))) AS first FROM files GROUP BY path),
run AS (SELECT path, name, CASE WHEN starts_with(first, '#!') THEN CASE {_RUN} END END AS lang FROM f),
hit AS (SELECT f.path, c.ending, c.language, c.category, row_number() OVER (PARTITION BY f.path ORDER BY length(c.ending) DESC) AS rn FROM f JOIN chosen c ON suffix(lower(f.name), c.ending))
SELECT r.path, coalesce(n.language, r.lang, h.language, 'Unknown') AS language, CASE WHEN n.name IS NOT NULL THEN n.category WHEN r.lang IS NOT NULL THEN 'programming' ELSE coalesce(h.category, 'unknown') END AS category,
  CASE WHEN n.name IS NOT NULL THEN 'filename' WHEN r.lang IS NOT NULL THEN 'shebang' WHEN h.path IS NOT NULL THEN 'extension:' || h.ending ELSE 'unrecognized' END AS evidence
FROM run r LEFT JOIN named n ON n.name = r.name LEFT JOIN hit h ON h.path = r.path AND h.rn = 1""",
    "change_names": f"SELECT snap_no, target_id, change_kind, count(*) AS n, list_sort(list(file_path))[1:30] AS names FROM ({CORE_SQL['p2_found']}) WHERE file_path <> '' GROUP BY ALL",
    "projects": "SELECT DISTINCT project FROM documents WHERE project IS NOT NULL",
    "first_imports": f"""WITH {_FILES}, m AS (SELECT path, regexp_extract_all(text, {_q("(?m)" + fixed.STREAM_PYTHON[0])}, 1) AS ms FROM files WHERE ending = '.py'), u AS (SELECT path, unnest(ms) AS module, unnest(range(0, len(ms))) AS n FROM m)
SELECT path, module, min(n)::INT AS n FROM u GROUP BY path, module""",
    "audit_export": GRAPH_SQL["audit_categories"],
    "shown_targets": "SELECT DISTINCT snap_no, id, target, last_sha, last_state FROM targets",
}

"""Queries of the change monitor and of the notes over targets, change_events and ai_notes, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweft.functions.text import digest_norm, instant_us, month_of_us, posix_path
from depweft.operators import monitor
from depweft.operators.incremental import latest_by
from depweft.operators.notes import NOTE, fresh_notes, plan_run
from depweft.operators.snapshots import latest_deliveries, snapshot_order, target_changes
from depweft.plans.core_problems import _CURRENT, _UTC, node_states, run_in_force
from depweft.plans.core_problems import SQL as CORE_SQL
from depweft.session import tables

NOW = "2026-06-16T12:00:00+00:00"
LAST = 100


def valid_targets(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each snapshot's latest delivery."""
    (targets,) = tables(spark, d, "targets")
    return latest_deliveries(targets).where(F.col("id").isNotNull())


def current_targets(spark: SparkSession, d: str) -> DataFrame:
    """Targets of the last snapshot, one row each: the small columns."""
    (targets,) = tables(spark, d, "targets")
    rows = latest_deliveries(targets, snapshot_order(targets, "snap_no", "delivered_at")[-1:]).where(F.col("id").isNotNull())
    names = ("target", "kind", "interval_seconds", "next_check", "checked_at", "last_state", "algorithm")
    return rows.groupBy("id").agg(F.max(F.struct(*names)).alias("t")).select("id", *(f"t.{n}" for n in names))


def monitor_replay(spark, d):
    """State of each target at each snapshot, taken as a series of checks."""
    v = valid_targets(spark, d).select("id", "snap_no", "kind", "algorithm", "last_sha", "last_semantic", "last_state").distinct()
    checks = v.select(
        F.col("id").alias("target"), F.col("snap_no").alias("seq"), "kind", "algorithm", F.col("last_sha").alias("sha"), F.col("last_semantic").alias("semantic"), (F.col("last_state") == "error").alias("failed"), F.lit(False).alias("not_modified")
    )
    return monitor.check_states(checks).select("target", "seq", "state")


def logged_states(spark, d):
    return monitor.logged_events(monitor_replay(spark, d)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def change_counts(spark, d):
    """Per snapshot and kind the number of changes."""
    (targets,) = tables(spark, d, "targets")
    return target_changes(targets).groupBy("snap_no", "change_kind").agg(F.count(F.lit(1)).alias("n"))


def changed_files(spark, d):
    """Per snapshot and target: counts of added, removed and modified files."""
    (targets,) = tables(spark, d, "targets")
    files = target_changes(targets).where("file_path <> ''")
    kinds = [F.count_if(F.col("change_kind") == k).alias(k) for k in ("added", "removed", "modified")]
    return files.groupBy("snap_no", "target_id").agg(*kinds)


def unchanged_files(spark, d):
    """Files with the same marker in the first and the last snapshot."""
    (targets,) = tables(spark, d, "targets")
    order = snapshot_order(targets, "snap_no", "delivered_at")

    def entries(delivery: tuple) -> DataFrame:
        return latest_deliveries(targets, [delivery]).select("id", F.explode("last_manifest").alias("path", "marker")).select("id", posix_path(F.col("path")).alias("path"), F.lower("marker").alias("marker")).distinct()

    if not order:
        return targets.limit(0).select("id", F.lit("").alias("path"), F.lit("").alias("marker"))
    return entries(order[0]).intersect(entries(order[-1]))


def manifest_hashes(spark, d):
    """Digest of each manifest's canonical JSON, by SHA-256."""
    v = valid_targets(spark, d).where(F.col("last_manifest").isNotNull())
    return v.select("snap_no", "id", F.sha2(monitor.manifest_json(F.col("last_manifest")), 256).alias("manifest_sha")).distinct()


def manifest_markers(spark, d):
    """Manifest entries by what their marker is made of."""
    v = valid_targets(spark, d)
    rows = v.select("snap_no", F.explode("last_manifest").alias("path", "marker"))
    return rows.groupBy("snap_no", F.lower(F.split_part("marker", F.lit(":"), F.lit(1))).alias("algorithm")).agg(F.count(F.lit(1)).alias("n"))


def last_events(spark, d):
    """The last events with their targets, newest first; one row per event id."""
    (events,) = tables(spark, d, "change_events")
    one = events.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.struct("target_id", "at", "type", "summary")).alias("e")).select("id", "e.*")
    return one.join(current_targets(spark, d).select(F.col("id").alias("target_id"), "target"), "target_id").orderBy(F.desc("id")).select("id", "at", "type", "summary", "target").limit(LAST)


def event_months(spark, d):
    (events,) = tables(spark, d, "change_events")
    one = events.where(F.col("id").isNotNull()).select("id", "type", "at").distinct()
    return one.groupBy(month_of_us(instant_us(F.col("at"))).alias("month"), "type").agg(F.countDistinct("id").alias("n"))


def cascaded_events(spark, d):
    """Events that stay after the targets that are gone take theirs with them."""
    (events,) = tables(spark, d, "change_events")
    return events.select("id", "target_id", "type").distinct().join(current_targets(spark, d).select(F.col("id").alias("target_id")), "target_id", "left_semi")


def event_algorithms(spark, d):
    """Algorithm named in each event's details."""
    (events,) = tables(spark, d, "change_events")
    return events.select("id", F.get_json_object("details", "$.algorithm").alias("algorithm")).distinct()


def due_targets(spark, d):
    now = F.lit(NOW)
    rows = current_targets(spark, d).select("id", instant_us(F.col("next_check")).alias("next_us"))
    return monitor.due(rows, instant_us(now)).select("id")


def next_checks(spark, d):
    """When each target is checked again: its last check and its interval."""
    t = current_targets(spark, d)
    return t.select("id", (instant_us(F.col("checked_at")) + F.col("interval_seconds").cast("bigint") * 1_000_000).alias("next_us"))


def target_states(spark, d):
    return current_targets(spark, d).groupBy("kind", "last_state").agg(F.count(F.lit(1)).alias("n"))


def _latest_notes(spark, d) -> DataFrame:
    (notes,) = tables(spark, d, "ai_notes")
    fields = {n: F.col(n) for n in ("source_sha256", "settings_hash", "state", "note_json", "provider", "model", "language")}
    v = latest_by(notes.where(F.col("node_key").isNotNull()), F.col("node_key"), [instant_us(F.col("updated_at"))], fields)
    return v.withColumn("version", digest_norm(F.col("source_sha256")))


def _versions(spark, d) -> DataFrame:
    (nodes,) = tables(spark, d, "nodes")
    return node_states(nodes).withColumn("version", digest_norm(F.col("digest")))


def note_states(spark, d):
    return _latest_notes(spark, d).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def note_models(spark, d):
    return _latest_notes(spark, d).groupBy("provider", "model", "language").agg(F.count(F.lit(1)).alias("n"))


def fresh_note_keys(spark, d):
    return fresh_notes(_versions(spark, d), _latest_notes(spark, d)).where(F.col("note_json").isNotNull()).select("key")


def note_run_plan(spark, d):
    """Keys of a run that tries failed notes again, under the settings and the bound of files (0: none) of the run in force."""
    (runs,) = tables(spark, d, "note_runs")
    force = run_in_force(runs, "settings_hash", "max_files")
    todo = _versions(spark, d).where((F.col("kind") == "file") & (F.col("status") == "done") & F.col("version").isNotNull()).select("id", "key", "depth", "version")
    return plan_run(todo, _latest_notes(spark, d), force and force["settings_hash"], retry_failed=True, max_files=(force and force["max_files"]) or 0).select("id", "key")


def note_fields(spark, d):
    """Summary length and number of responsibilities of each valid note."""
    v = _latest_notes(spark, d).where(F.col("note_json").isNotNull())
    note = F.from_json("note_json", NOTE)
    return v.select("key", F.length(note["summary"]).alias("summary_chars"), F.coalesce(F.size(note["responsibilities"]), F.lit(0)).alias("n_responsibilities"))


def registration_events(spark, d):
    """Algorithm switches, if the targets of the first snapshot are registered anew as they stand in the last."""
    order = snapshot_order(tables(spark, d, "targets")[0], "snap_no", "delivered_at")
    v = valid_targets(spark, d).select("snap_no", "target", "algorithm", "record_diffs", "last_sha").distinct()
    ends = (order[0][0], order[-1][0]) if order else (None, None)
    first, last = (v.where(F.col("snap_no") == F.lit(s)).drop("snap_no") for s in ends)
    return monitor.registered(first, last.drop("last_sha"))[1]


_ALL = (
    monitor_replay, logged_states, change_counts, changed_files, unchanged_files, manifest_hashes, manifest_markers, last_events, event_months, cascaded_events, event_algorithms, due_targets, next_checks, target_states, note_states, note_models, fresh_note_keys,
    note_run_plan, note_fields, registration_events,
)
QUERIES = {f.__name__: f for f in _ALL}

# ---- SQL ----

_VALID = """snaps AS (SELECT snap_no, max(delivered_at) AS delivered_at FROM targets GROUP BY snap_no), v AS (SELECT t.* FROM targets t JOIN snaps USING (snap_no, delivered_at) WHERE t.id IS NOT NULL)"""
_NOW = f"""{_VALID}, cur AS (SELECT DISTINCT id, target, kind, interval_seconds, next_check, checked_at, last_state, algorithm FROM v WHERE snap_no = (SELECT max(snap_no) FROM targets))"""
_REPLAY = f"""{_VALID}, c AS (SELECT DISTINCT id, snap_no, kind, algorithm, lower(last_sha) AS sha, lower(last_semantic) AS sem, coalesce(last_state = 'error', FALSE) AS failed FROM v),
s AS (SELECT *, lag(algorithm) OVER w AS earlier, lag(snap_no) OVER w IS NOT NULL AS has_earlier, NOT failed AND sha IS NOT NULL AS good FROM c WINDOW w AS (PARTITION BY id ORDER BY snap_no)),
k AS (SELECT *, has_earlier AND algorithm IS DISTINCT FROM earlier AS switched FROM s),
l AS (SELECT *, last_value(CASE WHEN good OR switched THEN struct_pack(g := good, sha := sha, sem := sem) END IGNORE NULLS) OVER (PARTITION BY id ORDER BY snap_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM k),
replay AS (SELECT id AS target, snap_no AS seq, CASE WHEN failed OR sha IS NULL THEN 'error' WHEN switched OR NOT coalesce(b.g, FALSE) THEN 'baseline' WHEN sha = b.sha THEN 'unchanged' WHEN kind = 'local' THEN 'files' WHEN sem IS NOT DISTINCT FROM b.sem THEN 'technical' ELSE 'content' END AS state FROM l)"""
_NOTES = f"""notes AS (SELECT node_key, regexp_replace(lower(trim(source_sha256)), '^sha256:', '') AS version, settings_hash, state, note_json, provider, model, language FROM (
  SELECT *, row_number() OVER (PARTITION BY node_key ORDER BY {_UTC.format("updated_at")} DESC NULLS LAST, source_sha256 DESC NULLS LAST, settings_hash DESC, state DESC) AS rn FROM ai_notes WHERE node_key IS NOT NULL) WHERE rn = 1)"""
_VERSIONS = f"{_CURRENT}, ver AS (SELECT id, key, kind, status, depth, regexp_replace(lower(trim(digest)), '^sha256:', '') AS version FROM current_nodes), {_NOTES}"
_CHANGES = CORE_SQL["p2_found"]
_POSIX = "regexp_replace(replace({0}, '\\', '/'), '^(\\./)+', '')"
_ENTRIES = f"""{_VALID}, m0 AS (SELECT snap_no, id, unnest(map_keys(last_manifest)) AS p, unnest(map_values(last_manifest)) AS mark FROM v), m AS (SELECT DISTINCT snap_no, id, {_POSIX.format("p")} AS path, lower(mark) AS marker FROM m0)"""

SQL = {
    "monitor_replay": f"WITH {_REPLAY} SELECT target, seq, state FROM replay",
    "logged_states": f"WITH {_REPLAY} SELECT state, count(*) AS n FROM replay WHERE state <> 'unchanged' GROUP BY state",
    "change_counts": f"SELECT snap_no, change_kind, count(*) AS n FROM ({_CHANGES}) GROUP BY snap_no, change_kind",
    "changed_files": f"SELECT snap_no, target_id, count(*) FILTER (change_kind = 'added') AS added, count(*) FILTER (change_kind = 'removed') AS removed, count(*) FILTER (change_kind = 'modified') AS modified FROM ({_CHANGES}) WHERE file_path <> '' GROUP BY ALL",
    "unchanged_files": f"WITH {_ENTRIES} SELECT id, path, marker FROM m WHERE snap_no = (SELECT min(snap_no) FROM targets) INTERSECT SELECT id, path, marker FROM m WHERE snap_no = (SELECT max(snap_no) FROM targets)",
    "manifest_hashes": f"""WITH {_VALID}, e AS (SELECT DISTINCT snap_no, id, unnest(map_keys(last_manifest)) AS p, unnest(map_values(last_manifest)) AS mark FROM v)
SELECT snap_no, id, sha256('{{' || string_agg('"' || replace(p, '\\', '\\\\') || '":"' || mark || '"', ',' ORDER BY p) || '}}') AS manifest_sha FROM e GROUP BY snap_no, id""",
    "manifest_markers": f"WITH {_VALID}, e AS (SELECT snap_no, unnest(map_values(last_manifest)) AS mark FROM v) SELECT snap_no, lower(split_part(mark, ':', 1)) AS algorithm, count(*) AS n FROM e GROUP BY ALL",
    "last_events": f"""WITH {_NOW}, e AS (SELECT id, max(struct_pack(target_id := target_id, "at" := "at", type := type, summary := summary)) AS s FROM change_events WHERE id IS NOT NULL GROUP BY id)
SELECT e.id, e.s."at" AS "at", e.s.type AS type, e.s.summary AS summary, cur.target FROM e JOIN cur ON cur.id = e.s.target_id ORDER BY e.id DESC LIMIT {LAST}""",
    "event_months": f"""SELECT strftime({_UTC.format('"at"')}, '%Y-%m') AS month, type, count(DISTINCT id) AS n FROM change_events WHERE id IS NOT NULL GROUP BY 1, 2""",
    "cascaded_events": f"WITH {_NOW} SELECT DISTINCT id, target_id, type FROM change_events WHERE target_id IN (SELECT id FROM cur)",
    "event_algorithms": "SELECT DISTINCT id, json_extract_string(details, '$.algorithm') AS algorithm FROM change_events",
    "due_targets": f"WITH {_NOW} SELECT id FROM cur WHERE {_UTC.format('next_check')} <= TIMESTAMP '2026-06-16 12:00:00' ORDER BY {_UTC.format('next_check')}, id LIMIT 10",
    "next_checks": f"WITH {_NOW} SELECT id, epoch_us({_UTC.format('checked_at')}) + interval_seconds::BIGINT * 1000000 AS next_us FROM cur",
    "target_states": f"WITH {_NOW} SELECT kind, last_state, count(*) AS n FROM cur GROUP BY ALL",
    "registration_events": f"""WITH {_VALID}, a AS (SELECT DISTINCT target, algorithm FROM v WHERE snap_no = (SELECT min(snap_no) FROM targets)), b AS (SELECT DISTINCT target, algorithm FROM v WHERE snap_no = (SELECT max(snap_no) FROM targets))
SELECT a.target, 'algorithm' AS type, a.algorithm AS "from", b.algorithm AS "to" FROM a JOIN b ON a.target = b.target WHERE a.algorithm <> b.algorithm""",
    "note_states": f"WITH {_NOTES} SELECT state, count(*) AS n FROM notes GROUP BY state",
    "note_models": f"WITH {_NOTES} SELECT provider, model, language, count(*) AS n FROM notes GROUP BY ALL",
    "fresh_note_keys": f"WITH {_VERSIONS} SELECT key FROM ver JOIN notes n ON n.node_key = key AND n.version = ver.version WHERE n.state = 'done' AND note_json IS NOT NULL",
    "note_run_plan": f"""WITH {_VERSIONS} SELECT id, key FROM ver WHERE kind = 'file' AND status = 'done' AND version IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM notes n WHERE n.node_key = key AND n.version = ver.version AND n.state = 'done' AND n.settings_hash = (SELECT settings_hash FROM note_runs ORDER BY run_id DESC LIMIT 1)) ORDER BY depth DESC, id LIMIT 500""",
    "note_fields": f"WITH {_NOTES} SELECT node_key AS key, length(json_extract_string(note_json, '$.summary'))::INT AS summary_chars, coalesce(json_array_length(note_json, '$.responsibilities'), 0)::INT AS n_responsibilities FROM notes WHERE note_json IS NOT NULL",
}

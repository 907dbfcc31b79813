"""Queries p1, p2, p4 and p5 over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from depweft.functions.text import digest_norm, instant_us, month_of_us, ntz_us
from depweft.operators.eager_join import distinct_per_key, eager_join_rollup
from depweft.operators.incremental import latest_by, pending
from depweft.operators.refcheck import exact_late_counts, orphan_states, reference_groups
from depweft.operators.snapshots import of_delivery, snapshot_order, target_changes
from depweft.session import cut, tables

#: A target is hot if it holds one of so many parts of all rows (2.5 %), in whole numbers so that the border is exact.
HOT_PARTS = 40


def node_states(nodes: DataFrame) -> DataFrame:
    """The current row of each key: the greatest updated (null first), then the greatest loaded_at."""
    fields = {n: F.col(n) for n in ("id", "kind", "status", "depth", "digest", "error", "updated", "loaded_at")}
    return latest_by(nodes.where(F.col("key").isNotNull()), F.col("key"), [F.col("updated"), F.col("loaded_at")], fields)


def deleted_keys(nodes: DataFrame, removals: DataFrame) -> DataFrame:
    """Keys whose last removal is later than the greatest updated of their nodes rows."""
    last = removals.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("removed_at").alias("removed_at"))
    seen = nodes.groupBy("key").agg(F.max("updated").alias("updated"))
    return last.join(seen, "key").where(F.col("updated").isNull() | (F.col("removed_at") > F.col("updated"))).select("key")


# ---- problem 1 ----------------------------------------------------------------------------------------------------


def target_totals(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per non-null target: rows of edges that name it and status of its node. Both sides are reduced to a state per key below
    the join."""
    current = node_states(nodes)
    return eager_join_rollup(edges.where(F.col("target").isNotNull()), current, F.col("target"), F.col("key"), right_groups={"kind": F.col("kind"), "status": F.col("status")}, how="left", by_key="target_key", count="n_edges")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    edges, nodes = tables(spark, d, "edges", "nodes")
    total = edges.count()
    return target_totals(edges, nodes).where(F.col("n_edges") * HOT_PARTS >= F.lit(total)).select("target_key")


def p1_target_stats(spark: SparkSession, d: str) -> DataFrame:
    edges, nodes = tables(spark, d, "edges", "nodes")
    sources = distinct_per_key(edges, F.col("target"), F.col("source"), "target_key", "n_sources")
    return target_totals(edges, nodes).join(sources, "target_key", "left").withColumn("n_sources", F.coalesce("n_sources", F.lit(0).cast("bigint")))


def p1_two_hop_relations(spark: SparkSession, d: str) -> DataFrame:
    """Number of two-hop paths a -> b -> c by the two relations, over all rows of edges, without forming a path."""
    (edges,) = tables(spark, d, "edges")
    return eager_join_rollup(edges, edges, F.col("target"), F.col("source"), left_groups={"first_relation": F.col("relation")}, right_groups={"second_relation": F.col("relation")}, count="n_paths")


# ---- problem 2 ----------------------------------------------------------------------------------------------------


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    (targets,) = tables(spark, d, "targets")
    return target_changes(targets).distinct()


# ---- problem 4 ----------------------------------------------------------------------------------------------------


def key_references(edges: DataFrame, file_types: DataFrame, notes: DataFrame) -> DataFrame:
    """All references to nodes: field, key, us, month."""

    def part(df: DataFrame, field: str, key: str, us) -> DataFrame:
        return df.select(F.lit(field).alias("field"), F.col(key).alias("key"), us.alias("us"))

    loaded = ntz_us(F.col("loaded_at"))
    # Both ends of an edge in one scan.
    ends = F.explode(F.array(F.struct(F.lit("edges.target").alias("field"), F.col("target").alias("key")), F.struct(F.lit("edges.source").alias("field"), F.col("source").alias("key"))))
    both = edges.select(ends.alias("e"), loaded.alias("us")).select("e.field", "e.key", "us")
    refs = both.unionByName(part(file_types, "file_types.key", "key", loaded)).unionByName(part(notes, "ai_notes.node_key", "node_key", instant_us(F.col("updated_at"))))
    return refs.where(F.col("key").isNotNull() & ~F.col("key").startswith("dir:")).withColumn("month", month_of_us(F.col("us")))


def node_parents(nodes: DataFrame, removals: DataFrame) -> DataFrame:
    seen = nodes.where(F.col("key").isNotNull()).groupBy("key").agg(F.min(ntz_us(F.col("loaded_at"))).alias("known_us"), F.max("updated").alias("updated"))
    last = removals.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("removed_at").alias("removed_at"))
    gone = F.col("removed_at").isNotNull() & (F.col("updated").isNull() | (F.col("removed_at") > F.col("updated")))
    return seen.join(last, "key", "left").select("key", "known_us", gone.alias("gone"))


def event_references(events: DataFrame) -> DataFrame:
    at = instant_us(F.col("at"))
    return events.where(F.col("target_id").isNotNull()).select(F.lit("change_events.target_id").alias("field"), F.col("target_id").cast("string").alias("key"), at.alias("us"), month_of_us(at).alias("month"))


def target_parents(targets: DataFrame) -> DataFrame:
    """Ids of targets; gone are those not in the latest delivery of the last snapshot."""
    rows = targets.where(F.col("id").isNotNull()).groupBy(F.col("id").cast("string").alias("key")).agg(F.max(F.struct("snap_no", "delivered_at")).alias("last"))
    order = snapshot_order(targets, "snap_no", "delivered_at")
    if not order:
        return rows.select("key", F.lit(None).cast("bigint").alias("known_us"), F.lit(True).alias("gone"))
    there = of_delivery(order[-1], F.col("last.snap_no"), F.col("last.delivered_at"))
    return rows.select("key", F.lit(None).cast("bigint").alias("known_us"), (~F.coalesce(there, F.lit(False))).alias("gone"))


def orphans(spark: SparkSession, d: str) -> DataFrame:
    edges, nodes, file_types, notes, removals, targets, events = tables(spark, d, "edges", "nodes", "file_types", "ai_notes", "node_removals", "targets", "change_events")
    of_nodes = orphan_states(reference_groups(key_references(edges, file_types, notes)), node_parents(nodes, removals))
    of_targets = orphan_states(reference_groups(event_references(events)), target_parents(targets))
    return of_nodes.unionByName(of_targets)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans(spark, d).select(F.col("field").alias("ref_field"), F.col("key").alias("ref_key"), F.col("month").alias("ref_month"), F.col("state").alias("ref_state")).distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Per field, month and state: orphaned keys and the references to them; of late keys only the references that came too early."""
    edges, file_types, notes = tables(spark, d, "edges", "file_types", "ai_notes")
    exact = exact_late_counts(cut(orphans(spark, d)), key_references(edges, file_types, notes))
    return exact.groupBy(F.col("field").alias("ref_field"), F.col("month").alias("ref_month"), F.col("state").alias("ref_state")).agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n_refs").alias("n_refs"))


# ---- problem 5 ----------------------------------------------------------------------------------------------------


def run_in_force(runs: DataFrame, *columns: str) -> Row | None:
    """run_id and the given columns of the run with the greatest run_id; None if there is no run."""
    return runs.where(F.col("run_id").isNotNull()).agg(F.max(F.struct("run_id", *columns)).alias("m")).first()["m"]


def settings_in_force(runs: DataFrame) -> str | None:
    """The settings of the greatest run_id; null if there is no run."""
    row = run_in_force(runs, "settings_hash")
    return row and row["settings_hash"]


def notes_to_do(nodes: DataFrame, removals: DataFrame, notes: DataFrame, runs: DataFrame) -> DataFrame:
    """Source rows (key, digest) that the notes, taken as the target of the incremental run, do not hold.

    The target's version of a key is its latest note; it holds the source row if its digest is the same, the settings are
    those in force and its state is done or skipped. Without runs nothing is in force and all is to do.
    """
    source = node_states(nodes).where((F.col("kind") == "file") & (F.col("status") == "done") & F.col("digest").isNotNull() & (F.trim("digest") != ""))
    source = source.join(deleted_keys(nodes, removals), "key", "left_anti").select("key", digest_norm(F.col("digest")).alias("version"))
    fields = {n: F.col(n) for n in ("source_sha256", "settings_hash", "state")}
    valid = latest_by(notes.where(F.col("node_key").isNotNull()), F.col("node_key"), [instant_us(F.col("updated_at"))], fields)
    force = settings_in_force(runs)
    held = valid.where(F.col("state").isin("done", "skipped") & (F.col("settings_hash") == F.lit(force))).select("key", digest_norm(F.col("source_sha256")).alias("version"))
    return pending(source, held, ["key", "version"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    nodes, removals, notes, runs = tables(spark, d, "nodes", "node_removals", "ai_notes", "note_runs")
    return notes_to_do(nodes, removals, notes, runs).select(F.col("key").alias("node_key"))


# ---- SQL ----------------------------------------------------------------------------------------------------------

_DELETED = """
last_removal AS (SELECT key, max(removed_at) AS removed_at FROM node_removals GROUP BY key),
seen AS (SELECT key, max(updated) AS updated, min(loaded_at) AS known_at FROM nodes GROUP BY key),
gone AS (SELECT s.key FROM seen s JOIN last_removal r ON r.key = s.key WHERE s.updated IS NULL OR r.removed_at > s.updated)"""

_CURRENT = """
current_nodes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY updated DESC NULLS LAST, loaded_at DESC NULLS LAST) AS rn FROM nodes) WHERE rn = 1)"""

_UTC = "(CASE WHEN regexp_matches({0}, '([zZ]|[+-][0-9]{{2}}:?[0-9]{{2}})$') THEN {0} ELSE {0} || 'Z' END)::TIMESTAMPTZ AT TIME ZONE 'UTC'"

_ORPHANS = f"""
WITH {_DELETED},
refs AS (
  SELECT 'edges.target' AS f, target AS k, loaded_at AS t FROM edges
  UNION ALL SELECT 'edges.source', source, loaded_at FROM edges
  UNION ALL SELECT 'file_types.key', key, loaded_at FROM file_types
  UNION ALL SELECT 'ai_notes.node_key', node_key, {_UTC.format("updated_at")} FROM ai_notes),
node_orphans AS (
  SELECT f, k, strftime(t, '%Y-%m') AS m, CASE WHEN s.key IS NULL THEN 'missing' WHEN g.key IS NOT NULL THEN 'deleted' WHEN min(t) < s.known_at THEN 'late' END AS st, CASE WHEN s.key IS NOT NULL AND g.key IS NULL THEN count(*) FILTER (t < s.known_at) ELSE count(*) END AS n
  FROM refs LEFT JOIN seen s ON s.key = k LEFT JOIN gone g ON g.key = k
  WHERE k IS NOT NULL AND NOT starts_with(k, 'dir:')
  GROUP BY f, k, strftime(t, '%Y-%m'), s.key, g.key, s.known_at),
newest AS (SELECT snap_no, max(delivered_at) AS delivered_at FROM targets WHERE snap_no = (SELECT max(snap_no) FROM targets) GROUP BY snap_no),
live AS (SELECT DISTINCT t.id FROM targets t JOIN newest USING (snap_no, delivered_at)),
event_orphans AS (
  SELECT 'change_events.target_id' AS f, e.target_id::VARCHAR AS k, strftime({_UTC.format('e."at"')}, '%Y-%m') AS m,
    CASE WHEN e.target_id NOT IN (SELECT id FROM targets) THEN 'missing' WHEN e.target_id NOT IN (SELECT id FROM live) THEN 'deleted' END AS st, count(*) AS n
  FROM change_events e WHERE e.target_id IS NOT NULL GROUP BY 1, 2, 3, 4),
orphans AS (SELECT * FROM node_orphans WHERE st IS NOT NULL UNION ALL SELECT * FROM event_orphans WHERE st IS NOT NULL)
"""

QUERIES = {f.__name__: f for f in (p1_found, p1_target_stats, p1_two_hop_relations, p2_found, p4_found, p4_report, p5_found)}

SQL = {
    "p1_found": "SELECT target AS target_key FROM edges WHERE target IS NOT NULL GROUP BY target HAVING count(*) >= 0.025 * (SELECT count(*) FROM edges)",
    "p1_target_stats": f"""
WITH {_CURRENT}
SELECT e.target AS target_key, n.kind, n.status, count(*) AS n_edges, count(DISTINCT e.source) AS n_sources
FROM edges e LEFT JOIN current_nodes n ON n.key = e.target WHERE e.target IS NOT NULL GROUP BY e.target, n.kind, n.status""",
    "p1_two_hop_relations": "SELECT a.relation AS first_relation, b.relation AS second_relation, count(*) AS n_paths FROM edges a JOIN edges b ON a.target = b.source GROUP BY a.relation, b.relation",
    "p2_found": r"""
WITH latest AS (SELECT snap_no, max(delivered_at) AS delivered_at FROM targets GROUP BY snap_no),
snaps AS (SELECT snap_no, delivered_at, row_number() OVER (ORDER BY snap_no) AS o FROM latest),
v AS (SELECT DISTINCT s.o, s.snap_no, t.id, t.kind, t.algorithm, lower(t.last_sha) AS sha, lower(t.last_semantic) AS sem, t.last_manifest FROM targets t JOIN snaps s USING (snap_no, delivered_at)),
pairs AS (
  SELECT b.o, b.snap_no, b.id, a.id IS NOT NULL AS has_a, TRUE AS has_b, a.algorithm AS aa, b.algorithm AS ba, a.sha AS asha, b.sha AS bsha, a.sem AS asem, b.sem AS bsem, b.kind
  FROM v b LEFT JOIN v a ON a.id = b.id AND a.o = b.o - 1 WHERE b.o > 1
  UNION ALL
  SELECT a.o + 1, s.snap_no, a.id, TRUE, FALSE, a.algorithm, NULL, a.sha, NULL, a.sem, NULL, a.kind
  FROM v a JOIN snaps s ON s.o = a.o + 1 LEFT JOIN v b ON b.id = a.id AND b.o = a.o + 1 WHERE b.id IS NULL),
heads AS (
  SELECT snap_no, id, CASE WHEN NOT has_a THEN 'target added' WHEN NOT has_b THEN 'target removed' WHEN aa IS DISTINCT FROM ba THEN 'algorithm'
    WHEN asha IS NULL AND bsha IS NOT NULL THEN 'baseline'
    WHEN kind = 'web' AND asha IS DISTINCT FROM bsha THEN CASE WHEN asem IS DISTINCT FROM bsem THEN 'content' ELSE 'technical' END END AS c FROM pairs),
m0 AS (SELECT o, id, unnest(map_keys(last_manifest)) AS p, unnest(map_values(last_manifest)) AS mark FROM v),
m AS (SELECT DISTINCT o, id, regexp_replace(replace(p, '\', '/'), '^(\./)+', '') AS p, lower(mark) AS mark FROM m0),
local_pairs AS (SELECT * FROM pairs WHERE has_a AND has_b AND kind = 'local' AND aa IS NOT DISTINCT FROM ba AND asha IS NOT NULL),
now_files AS (SELECT l.snap_no, l.id, m.p, m.mark FROM local_pairs l JOIN m ON m.id = l.id AND m.o = l.o),
old_files AS (SELECT l.snap_no, l.id, m.p, m.mark FROM local_pairs l JOIN m ON m.id = l.id AND m.o = l.o - 1),
files AS (
  SELECT coalesce(n.snap_no, o.snap_no) AS snap_no, coalesce(n.id, o.id) AS id, coalesce(n.p, o.p) AS p,
    CASE WHEN o.p IS NULL THEN 'added' WHEN n.p IS NULL THEN 'removed' WHEN n.mark IS DISTINCT FROM o.mark THEN 'modified' END AS c
  FROM now_files n FULL JOIN old_files o ON n.snap_no = o.snap_no AND n.id = o.id AND n.p = o.p)
SELECT DISTINCT snap_no::INT AS snap_no, id AS target_id, '' AS file_path, c AS change_kind FROM heads WHERE c IS NOT NULL
UNION ALL SELECT DISTINCT snap_no::INT, id, p, c FROM files WHERE c IS NOT NULL""",
    "p4_found": _ORPHANS + "SELECT DISTINCT f AS ref_field, k AS ref_key, m AS ref_month, st AS ref_state FROM orphans",
    "p4_report": _ORPHANS + "SELECT f AS ref_field, m AS ref_month, st AS ref_state, count(*) AS n_keys, sum(n)::BIGINT AS n_refs FROM orphans GROUP BY f, m, st",
    "p5_found": f"""
WITH {_DELETED}, {_CURRENT},
src AS (SELECT key, regexp_replace(lower(digest), '^sha256:', '') AS dg FROM current_nodes WHERE kind = 'file' AND status = 'done' AND digest IS NOT NULL AND key NOT IN (SELECT key FROM gone)),
valid AS (SELECT node_key, arg_max(struct_pack(dg := regexp_replace(lower(source_sha256), '^sha256:', ''), st := state, sh := settings_hash), {_UTC.format("updated_at")}) AS n FROM ai_notes GROUP BY node_key)
SELECT s.key AS node_key FROM src s WHERE NOT EXISTS (
  SELECT 1 FROM valid v WHERE v.node_key = s.key AND v.n.dg = s.dg AND v.n.st IN ('done', 'skipped')
    AND v.n.sh = (SELECT settings_hash FROM note_runs ORDER BY run_id DESC LIMIT 1))""",
}

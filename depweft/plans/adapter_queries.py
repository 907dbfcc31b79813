"""Queries of operators that need code, storage or a stream: diffs, trees, runs and the streaming monitor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweft.functions.text import digest_norm, posix_path
from depweft.operators import export, graph, monitor
from depweft.operators.incremental import VersionedTarget, refresh_once, run_once
from depweft.operators.snapshots import deliveries
from depweft.plans.core_problems import _CURRENT, _DELETED, deleted_keys, node_states
from depweft.plans.graph_queries import _WITH, load
from depweft.plans.graph_queries import SQL as GRAPH_SQL
from depweft.plans.monitor_queries import _VERSIONS, _latest_notes, _versions, valid_targets
from depweft.plans.monitor_queries import SQL as MONITOR_SQL
from depweft.plans.text_queries import file_texts
from depweft.session import checkpoint_dir, tables
from depweft.sources.tree import read_tree
from depweft.streaming.monitor import run_available

CUTOFF = "2026-05-01"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors reach."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def text_diffs(spark, d):
    """Unified diffs of the texts that consecutive snapshots of a target keep of the same file."""
    (targets,) = tables(spark, d, "targets")
    order = deliveries(targets)
    following = F.broadcast(order.select("snap_no", (F.col("ord") + 1).alias("ord")).join(order.select("ord", F.col("snap_no").alias("next_no")), "ord").drop("ord"))
    texts = valid_targets(spark, d).where("record_diffs").select("id", "snap_no", F.explode("last_texts").alias("path", "text"), (F.col("kind") == "web").alias("web"))
    rows = texts.select("id", "snap_no", posix_path(F.col("path")).alias("path"), "text", "web").distinct()
    before = rows.join(following, "snap_no").select("id", "path", F.col("next_no").alias("snap_no"), F.col("text").alias("before"))
    pairs = before.join(rows.withColumnRenamed("text", "after"), ["id", "path", "snap_no"]).where("before <> after")
    return monitor.diffs(pairs).select("id", "path", "snap_no", "diff")


def tree_files(spark, d):
    """The folder of tables read as a project tree."""
    return read_tree(spark, d, maxContent="0").select("path", "size", "seeded", "digest")


def incremental_current(spark, d):
    """The newest rows of a target after three runs: over the nodes loaded by a day, over all, and over all but the deleted ones."""
    nodes, removals = tables(spark, d, "nodes", "node_removals")

    def source(df: DataFrame) -> DataFrame:
        return node_states(df).where(F.col("kind") == "file").select("key", digest_norm(F.col("digest")).alias("version"))

    target = VersionedTarget(spark, shared_folder(spark, "target"), "key string, version string, chars int, gone boolean")
    work = lambda df: df.withColumn("chars", F.length("key"))
    refresh_once(source(nodes.where(F.col("loaded_at") < F.lit(CUTOFF).cast("timestamp_ntz"))), target, "key", "version", work)
    refresh_once(source(nodes), target, "key", "version", work)
    return refresh_once(source(nodes).join(deleted_keys(nodes, removals), "key", "left_anti"), target, "key", "version", work)[1].select("key", "version", "chars")


def incremental_runs(spark, d):
    """A target after two runs: over the nodes loaded by a day, then over all; each version of a key is made once."""
    (nodes,) = tables(spark, d, "nodes")

    def source(df: DataFrame) -> DataFrame:
        rows = node_states(df).where((F.col("kind") == "file") & (F.col("status") == "done") & F.col("digest").isNotNull())
        return rows.select("key", digest_norm(F.col("digest")).alias("version"))

    target = VersionedTarget(spark, shared_folder(spark, "target"), "key string, version string, chars int")
    work = lambda df: df.withColumn("chars", F.length("key"))
    early = nodes.where(F.col("loaded_at") < F.lit(CUTOFF).cast("timestamp_ntz"))
    run_once(source(early), target, ["key", "version"], work)
    return run_once(source(nodes), target, ["key", "version"], work)[1]


def monitor_stream(spark, d):
    """Events of the streaming monitor over the snapshots, taken as checks."""
    v = valid_targets(spark, d).select("id", "snap_no", "kind", "algorithm", "last_sha", "last_semantic", "last_state").distinct()
    checks = v.select(
        F.col("id").alias("target"), F.col("snap_no").cast("bigint").alias("seq"), "kind", "algorithm", F.col("last_sha").alias("sha"), F.col("last_semantic").alias("semantic"), F.coalesce(F.col("last_state") == "error", F.lit(False)).alias("failed"),
        F.lit(False).alias("not_modified"),
    )
    folder = shared_folder(spark, "stream")
    checks.write.parquet(f"{folder}/in")
    query = run_available(spark.readStream.schema(checks.schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint")
    query.awaitTermination()
    return spark.read.schema("target bigint, seq bigint, state string, algorithm string").parquet(f"{folder}/out").select("target", F.col("seq").cast("int").alias("seq"), "state")


def export_nodes(spark, d):
    """Exported node records, the usage struct laid flat."""
    nodes, edges = load(spark, d)
    records = export.node_records(nodes, edges)
    return records.select("id", "type", "status", "depth", "sha256", "error", F.col("usage.status").alias("usage"), F.col("usage.declared_incoming").alias("declared_incoming"), F.col("usage.inferred_incoming").alias("inferred_incoming"), F.col("usage.producers").alias("producers"))


def export_edges(spark, d):
    return export.edge_records(load(spark, d)[1])


def export_note_lines(spark, d):
    """Number of lines of each node's Markdown note, by section."""
    nodes, edges = load(spark, d)
    return export.note_lines(nodes, edges).groupBy("section").agg(F.count(F.lit(1)).alias("n"))


def export_manifest(spark, d):
    files = file_texts(spark, d).where(F.col("text").isNotNull()).select("path", F.encode("text", "UTF-8").alias("content"))
    return export.file_manifest(files)


def leak_check(spark, d):
    files = file_texts(spark, d).where(F.col("text").isNotNull()).select(F.col("path").alias("name"), "text")
    return export.leaks(files)


def adjacency(spark, d):
    """Per node the number of uses in either direction, and of what produces it."""
    _, edges = load(spark, d)
    return graph.degrees(edges).where("incoming > 0 AND outgoing > 0")


def adjacency_views(spark, d):
    """The incoming, outgoing and production edges of every key."""
    return graph.adjacency(load(spark, d)[1])


def node_edges(spark, d):
    """The first edges of each node either way."""
    return graph.first_edges(*load(spark, d))


def node_facts(spark, d):
    """Per node its file type with evidence and candidates, and the valid note on its present content."""
    (types,) = tables(spark, d, "file_types")
    fields = ("category", "language", "analyzer", "evidence", "candidates")
    last = F.max(F.struct("loaded_at", *(F.lower(F.trim(c)).alias(c) if c == "category" else c for c in fields))).alias("t")
    typed = types.where(F.col("key").isNotNull()).groupBy("key").agg(last).select("key", "t.category", F.col("t.language").alias("language"), "t.analyzer", F.col("t.evidence").alias("type_evidence"), "t.candidates")
    done = _latest_notes(spark, d).where((F.col("state") == "done") & F.col("note_json").isNotNull())
    notes = done.select("key", "version", "note_json", F.col("model").alias("note_model"), F.col("language").alias("note_language"))
    return _versions(spark, d).select("key", "version").join(typed, "key", "left").join(notes, ["key", "version"], "left").drop("version")


_ALL = (text_diffs, tree_files, incremental_runs, incremental_current, monitor_stream, export_nodes, export_edges, export_note_lines, export_manifest, leak_check, adjacency, adjacency_views, node_edges, node_facts)
QUERIES = {f.__name__: f for f in _ALL}

_SOURCE = "SELECT key, regexp_replace(lower(trim(digest)), '^sha256:', '') AS version FROM {0} WHERE kind = 'file' AND status = 'done' AND digest IS NOT NULL"
_EARLY = f"early AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY updated DESC NULLS LAST, loaded_at DESC NULLS LAST) AS rn FROM nodes WHERE loaded_at < TIMESTAMP '{CUTOFF}') WHERE rn = 1)"
_USE = "relation NOT IN ('contains')"
SQL = {
    "export_nodes": "SELECT n.key AS id, n.kind AS type, n.status, n.depth, n.digest AS sha256, n.error, u.usage, u.declared_incoming, u.inferred_incoming, u.producers FROM (" + f"{_WITH} SELECT * FROM current_nodes" + ") n JOIN (" + GRAPH_SQL["usage_labels"] + ") u ON u.key = n.key",
    "incremental_runs": f"WITH {_CURRENT}, {_EARLY}, u AS ({_SOURCE.format('early')} UNION {_SOURCE.format('current_nodes')}) SELECT key, version, length(key)::INT AS chars FROM u",
    "incremental_current": f"WITH {_DELETED}, {_CURRENT} SELECT key, regexp_replace(lower(trim(digest)), '^sha256:', '') AS version, length(key)::INT AS chars FROM current_nodes WHERE kind = 'file' AND key NOT IN (SELECT key FROM gone)",
    "monitor_stream": MONITOR_SQL["monitor_replay"].replace("SELECT target, seq, state FROM replay", "SELECT target, seq, state FROM replay WHERE state <> 'unchanged'"),
    "export_edges": f'{_WITH} SELECT source AS "from", target AS "to", relation, coalesce(evidence, \'unknown\') AS evidence FROM e',
    "export_note_lines": f"""{_WITH} SELECT 0 AS section, (SELECT count(*) FROM current_nodes) * 5 AS n UNION ALL SELECT 1, (SELECT count(*) FROM current_nodes) UNION ALL SELECT 3, (SELECT count(*) FROM current_nodes)
UNION ALL SELECT 2, (SELECT count(*) FROM e WHERE {_USE}) UNION ALL SELECT 4, (SELECT count(*) FROM e WHERE {_USE})""",
    "export_manifest": "SELECT substr(node_key, 6) AS path, sha256(text) AS sha256 FROM documents WHERE starts_with(node_key, 'file:') AND text IS NOT NULL",
    "leak_check": "SELECT substr(node_key, 6) AS name FROM documents WHERE starts_with(node_key, 'file:') AND regexp_matches(text, '(?i)(?:[A-Za-z]:\\\\(?:Users|Usuarios)\\\\|-----BEGIN (?:RSA |OPENSSH )?PRIVATE KEY-----)')",
    "adjacency": f"{_WITH}, d AS (SELECT key, sum(i)::BIGINT AS incoming, sum(o)::BIGINT AS outgoing, sum(p)::BIGINT AS produced FROM (SELECT target AS key, CASE WHEN relation NOT IN ('contains', 'generates', 'produces', 'writes-output') THEN 1 ELSE 0 END AS i, 0 AS o, CASE WHEN relation IN ('generates', 'produces', 'writes-output') THEN 1 ELSE 0 END AS p FROM e UNION ALL SELECT source, 0, CASE WHEN relation NOT IN ('contains', 'generates', 'produces', 'writes-output') THEN 1 ELSE 0 END, 0 FROM e) GROUP BY key) SELECT * FROM d WHERE incoming > 0 AND outgoing > 0",
    "adjacency_views": f"""{_WITH}, u AS (SELECT source, target, relation, coalesce(evidence, 'unknown') AS evidence, relation IN ('generates', 'produces', 'writes-output') AS made FROM e WHERE relation <> 'contains')
SELECT target AS key, CASE WHEN made THEN 'production' ELSE 'incoming' END AS view, source AS other, relation, evidence FROM u WHERE made OR (source <> '' AND target <> '') UNION ALL SELECT source, 'outgoing', target, relation, evidence FROM u WHERE NOT made AND source <> '' AND target <> ''""",
    "node_edges": f"""{_WITH}, w AS (SELECT source AS key, 'outgoing' AS direction, target AS other, relation, evidence FROM e UNION ALL SELECT target, 'incoming', source, relation, evidence FROM e)
SELECT * FROM (SELECT key, direction, row_number() OVER (PARTITION BY key, direction ORDER BY other, relation) AS n, other, relation, evidence FROM w WHERE key IN (SELECT key FROM current_nodes)) WHERE n <= 200""",
    "node_facts": f"""WITH {_VERSIONS}, typed AS (SELECT * FROM (SELECT key, lower(trim(category)) AS category, language, analyzer, evidence, candidates,
  row_number() OVER (PARTITION BY key ORDER BY loaded_at DESC NULLS LAST, lower(trim(category)) DESC NULLS LAST, language DESC NULLS LAST, analyzer DESC NULLS LAST, evidence DESC NULLS LAST, candidates DESC NULLS LAST) AS rn FROM file_types) WHERE rn = 1)
SELECT ver.key, t.category, t.language, t.analyzer, t.evidence AS type_evidence, t.candidates, n.note_json, n.model AS note_model, n.language AS note_language
FROM ver LEFT JOIN typed t ON t.key = ver.key LEFT JOIN notes n ON n.node_key = ver.key AND n.version = ver.version AND n.state = 'done' AND n.note_json IS NOT NULL""",
}

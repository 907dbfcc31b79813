"""Queries of the dependency graph over nodes, edges and file_types, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweft.functions import fixed, keys
from depweft.operators import graph
from depweft.plans.core_problems import _CURRENT, node_states
from depweft.session import tables

#: Reference points of the walks: a shared module, the graph's hottest file, and a folder.
SHARED = "file:atlas-core/src/shared/types.ts"
SETTINGS = "file:atlas-core/src/shared/settings.json"
FOLDER = "atlas-core/src/shared"
VIEW_NODES, VIEW_EDGES, PAGE = 2200, 18000, 100


def load(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = tables(spark, d, "nodes", "edges")
    return node_states(nodes), graph.current_edges(edges)


def one_row(*rows: DataFrame) -> DataFrame:
    """One-row tables side by side, without a join."""
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out.agg(*(F.max(c).alias(c) for c in out.columns))


def status_counts(spark, d):
    return load(spark, d)[0].groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def relation_counts(spark, d):
    return load(spark, d)[1].groupBy("relation").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "relation")


def graph_totals(spark, d):
    nodes, edges = load(spark, d)
    kinds = edges.agg(
        F.count_if(~graph.structural() & ~graph.production()).alias("semantic_edges"), F.count_if(graph.production()).alias("production_edges"), F.count_if(graph.structural()).alias("structural_edges"), F.count(F.lit(1)).alias("edges")
    )
    return one_row(nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("key").startswith("file:")).alias("files")), kinds)


def usage_labels(spark, d):
    nodes, edges = load(spark, d)
    return graph.usage_labels(nodes, edges)


def degrees(spark, d):
    return graph.degrees(load(spark, d)[1])


def audit_categories(spark, d):
    nodes, edges = load(spark, d)
    return graph.audit_classes(nodes, edges)


def audit_counts(spark, d):
    nodes, edges = load(spark, d)
    return graph.audit_classes(nodes, edges).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def top_unresolved(spark, d):
    _, edges = load(spark, d)
    used = edges.where(~graph.structural() & ~graph.production() & F.col("target").startswith("external:"))
    return used.groupBy("target").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "target").limit(250)


def folder_rollup(spark, d):
    return graph.folder_rollup(load(spark, d)[0])


def folder_children(spark, d):
    """Children of one virtual folder, the first 200 by key, with the most pressing status."""
    nodes, _ = load(spark, d)
    prefix = f"file:{FOLDER.rsplit('/', 1)[0]}/"
    rest = F.substring("key", len(prefix) + 1, 1_000_000)
    inside = nodes.where((F.col("kind") == "file") & F.col("key").startswith(prefix)).select("key", "status", rest.alias("rest"))
    child = F.when(F.contains("rest", F.lit("/")), F.concat(F.lit(f"dir:{prefix[5:]}"), F.split_part("rest", F.lit("/"), F.lit(1)))).otherwise(F.col("key"))
    per = inside.groupBy(child.alias("child")).agg(F.min(keys.rank_of(F.col("status"), fixed.ROLLUP_RANK)).alias("rank"), F.count(F.lit(1)).alias("n_files"))
    return per.select("child", keys.status_of(F.col("rank"), fixed.ROLLUP_RANK).alias("status"), "n_files").orderBy("child").limit(200)


def tree_root(spark, d):
    return graph.tree_level(load(spark, d)[0], "")


def tree_level(spark, d):
    return graph.tree_level(load(spark, d)[0], "atlas-core/src")


def section_groups(spark, d):
    nodes, _ = load(spark, d)
    section = keys.section_name(F.col("key")).alias("section")
    counts = [F.count_if(F.col("status") == s).alias(s) for s in fixed.STATUSES]
    return nodes.groupBy(section).agg(F.count(F.lit(1)).alias("n_nodes"), *counts).orderBy(F.desc("n_nodes"), "section")


def structure_edges(spark, d):
    nodes, edges = load(spark, d)
    return graph.structure_edges(nodes, edges)


def scope_dependencies(spark, d):
    nodes, edges = load(spark, d)
    return graph.reach(nodes, edges, graph.scope_seed(FOLDER), "dependencies").orderBy("key")


def scope_dependents(spark, d):
    nodes, edges = load(spark, d)
    return graph.reach(nodes, edges, graph.scope_seed(SHARED), "dependents").orderBy("key")


def scope_both(spark, d):
    nodes, edges = load(spark, d)
    return graph.reach(nodes, edges, graph.scope_seed(SHARED), "both").orderBy("key")


def scope_page(spark, d):
    """Second page of a scope: 200 keys."""
    nodes, edges = load(spark, d)
    return graph.reach(nodes, edges, graph.scope_seed(SHARED), "dependents").orderBy("key").offset(200).limit(200)


def impact_consumers(spark, d):
    return graph.impact(load(spark, d)[1], SETTINGS, max_nodes=None)[0].select("key", "distance", "certainty")


def impact_summary(spark, d):
    _, edges = load(spark, d)
    consumers, truncated = graph.impact(edges, SETTINGS, max_nodes=None)
    direct = edges.where((F.col("target") == SETTINGS) & ~graph.structural() & ~graph.production()).agg(F.count_if(~graph.low()).alias("direct_declared"), F.count_if(graph.low()).alias("direct_inferred"))
    total = consumers.agg(F.count(F.lit(1)).alias("transitive"), F.count_if(F.col("certainty") == "possible").alias("possible_paths"), F.max("distance").alias("depth"))
    return one_row(total, direct).withColumn("truncated", F.lit(truncated))


def impact_entry_chains(spark, d):
    return graph.entry_chains(graph.impact(load(spark, d)[1], SETTINGS, max_nodes=None)[0])


def two_hop(spark, d):
    return graph.two_hop(load(spark, d)[1], "file:atlas-core/public/img/logo.svg")


def induced_edges(spark, d):
    nodes, edges = load(spark, d)
    return graph.induced(edges, nodes.where(F.col("status") == "done"))


def edge_upsert(spark, d):
    return load(spark, d)[1]


def edge_replacement(spark, d):
    """Edges after a run that analysed the files loaded last: those of re-analysed sources are replaced."""
    nodes, edges = tables(spark, d, "nodes", "edges")
    cutoff = "2026-05-01"
    old = graph.current_edges(edges.where(F.col("loaded_at") < F.lit(cutoff).cast("timestamp_ntz")))
    new = graph.current_edges(edges.where(F.col("loaded_at") >= F.lit(cutoff).cast("timestamp_ntz")))
    done = node_states(nodes).where(F.col("status") == "done").select(F.col("key").alias("source"))
    analysed = new.select("source").distinct().join(done, "source", "left_semi")
    return graph.replace_edges(old, new.join(done, "source", "left_semi"), analysed)


def live_edges(spark, d):
    """Edges between the first nodes of a view."""
    nodes, edges = load(spark, d)
    shown = nodes.select("id", "key").orderBy("id", "key").limit(VIEW_NODES)
    a = shown.select(F.col("id").alias("a_id"), F.col("key").alias("source"))
    b = shown.select(F.col("key").alias("target"))
    return edges.join(F.broadcast(a), "source").join(F.broadcast(b), "target").orderBy("a_id", "source", "target", "relation").limit(VIEW_EDGES).select("source", "target", "relation", "evidence")


def node_page(spark, d):
    return load(spark, d)[0].select("id", "key", "kind", "status", "depth").orderBy("id").offset(PAGE).limit(PAGE)


def search_nodes(spark, d):
    nodes, _ = load(spark, d)
    return nodes.where(F.ilike(F.col("key"), F.lit("%" + keys.like_escape("_pb2") + "%"), F.lit("\\"))).select("id", "key", "status").orderBy("id").limit(PAGE)


def search_total(spark, d):
    nodes, _ = load(spark, d)
    return nodes.where(F.ilike(F.col("key"), F.lit("%" + keys.like_escape("_pb2") + "%"), F.lit("\\"))).agg(F.count(F.lit(1)).alias("n"))


def queue_pick(spark, d):
    """The pending node that is analysed next: the deepest, then the least id."""
    return load(spark, d)[0].where(F.col("status") == "pending").orderBy(F.desc("depth"), "id").select("key", "depth").limit(1)


def failed_nodes(spark, d):
    return load(spark, d)[0].where(F.col("status") == "failed").orderBy("id").select("key", "error").limit(15)


def pending_nodes(spark, d):
    return load(spark, d)[0].where(F.col("status").isin("pending", "running")).select("key", "status")


def entry_points(spark, d):
    return load(spark, d)[0].where(keys.likely_entrypoint(F.col("key"))).select("key")


def key_parts(spark, d):
    """Kind, initial status, folder, name and ending of every key."""
    nodes, _ = load(spark, d)
    path = F.coalesce(keys.relative(F.col("key")), F.lit(""))
    return nodes.select("key", keys.kind_of(F.col("key")).alias("kind"), keys.initial_status(F.col("key")).alias("initial_status"), keys.parent(path).alias("folder"), keys.base_name(path).alias("name"), keys.suffix(path).alias("ending"))


def note_names(spark, d):
    nodes, _ = load(spark, d)
    return nodes.select("key", keys.note_name(F.col("key")).alias("note"))


def public_nodes(spark, d):
    nodes, edges = load(spark, d)
    allowed = nodes.where((F.col("kind") == "file") & ~F.lower("key").rlike(fixed.SECRET_NAMES)).select(keys.relative(F.col("key")).alias("path"))
    return graph.public_snapshot(nodes, edges, allowed)[0]


def public_edges(spark, d):
    nodes, edges = load(spark, d)
    allowed = nodes.where(F.col("key").startswith("file:atlas-core/")).select(keys.relative(F.col("key")).alias("path"))
    return graph.public_snapshot(nodes, edges, allowed)[1]


def node_details(spark, d):
    """Per node its type, edge counts, the least key either way, and its folder; node_edges and node_facts have the rest."""
    nodes, edges = load(spark, d)
    (types,) = tables(spark, d, "file_types")
    typed = types.where(F.col("key").isNotNull()).groupBy("key").agg(F.max(F.struct("loaded_at", F.lower(F.trim("category")).alias("category"), "language")).alias("t")).select("key", "t.category", "t.language")
    out = edges.groupBy(F.col("source").alias("key")).agg(F.count(F.lit(1)).alias("n_out"), F.min("target").alias("first_out"))
    into = edges.groupBy(F.col("target").alias("key")).agg(F.count(F.lit(1)).alias("n_in"), F.min("source").alias("first_in"))
    zero = F.lit(0).cast("bigint")
    joined = nodes.select("key", "status").join(typed, "key", "left").join(out, "key", "left").join(into, "key", "left")
    path = keys.relative(F.col("key"))
    folder = F.when(path.isNotNull(), F.concat(F.lit("dir:"), F.when(keys.parent(path) == "", ".").otherwise(keys.parent(path))))
    return joined.select("key", "status", "category", "language", F.coalesce("n_out", zero).alias("n_out"), "first_out", F.coalesce("n_in", zero).alias("n_in"), "first_in", folder.alias("folder"))


_NAMES = (
    status_counts, relation_counts, graph_totals, usage_labels, degrees, audit_categories, audit_counts, top_unresolved, folder_rollup, folder_children, tree_root, tree_level, section_groups, structure_edges, scope_dependencies, scope_dependents, scope_both,
    scope_page, impact_consumers, impact_summary, impact_entry_chains, two_hop, induced_edges, edge_upsert, edge_replacement, live_edges, node_page, search_nodes, search_total, queue_pick, failed_nodes, pending_nodes, entry_points, key_parts, note_names,
    public_nodes, public_edges, node_details,
)
QUERIES = {f.__name__: f for f in _NAMES}


def _list(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _edges(source: str = "edges", name: str = "e", where: str = "TRUE") -> str:
    return f"""{name} AS (SELECT source, target, relation, evidence FROM (
  SELECT source, target, relation, lower(trim(evidence)) AS evidence, row_number() OVER (PARTITION BY source, target, relation ORDER BY loaded_at DESC NULLS LAST, lower(trim(evidence)) DESC NULLS LAST) AS rn
  FROM {source} WHERE source IS NOT NULL AND target IS NOT NULL AND relation IS NOT NULL AND {where}) WHERE rn = 1)"""


_WITH = f"WITH RECURSIVE {_CURRENT}, {_edges()}"
_STR, _PROD, _LOW = _list(fixed.STRUCTURAL), _list(fixed.PRODUCTION), _list(fixed.LOW_CONFIDENCE)
_USE = f"relation NOT IN {_STR} AND relation NOT IN {_PROD}"
_LOWE = f"coalesce(evidence IN {_LOW}, FALSE)"
_REL = "substr(key, 6)"
_NAME = "regexp_extract({0}, '[^/]*$')"
_SUFFIX = "lower(regexp_extract(regexp_extract({0}, '[^/]*$'), '^.+(\\.[^.]+)$', 1))"


def _starts(path: str, prefixes: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({path}, '{p}')" for p in prefixes) + ")"


_ENTRY = f"(starts_with(key, 'file:') AND (lower({_NAME.format(_REL)}) IN {_list(fixed.ENTRY_FILES)} OR {_SUFFIX.format(_REL)} IN {_list(fixed.ENTRY_SUFFIXES)} OR {_starts(_REL, fixed.ENTRY_PREFIXES)}))"


def _rank(status: str, order: list[str], unknown: int = 2) -> str:
    return "CASE " + " ".join(f"WHEN {status} = '{s}' THEN {i}" for i, s in enumerate(order)) + f" ELSE {unknown} END"


def _unrank(rank: str, order: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {rank} = {i} THEN '{'pending' if s == 'running' else s}'" for i, s in enumerate(order)) + " END"


_DEGREES = f"""deg AS (SELECT key, sum(i)::BIGINT AS incoming, sum(o)::BIGINT AS outgoing, sum(p)::BIGINT AS produced FROM (
  SELECT target AS key, CASE WHEN {_USE} THEN 1 ELSE 0 END AS i, 0 AS o, CASE WHEN relation IN {_PROD} THEN 1 ELSE 0 END AS p FROM e
  UNION ALL SELECT source, 0, CASE WHEN {_USE} THEN 1 ELSE 0 END, 0 FROM e) GROUP BY key)"""
_AUDIT = f"""{_WITH}, {_DEGREES}, cls AS (
  SELECT n.key, coalesce(incoming, 0) AS i, coalesce(produced, 0) AS p,
    CASE WHEN coalesce(incoming, 0) > 0 THEN 'referenced_by_other_files'
      WHEN lower({_NAME.format("substr(n.key, 6)")}) IN {_list(fixed.AUDIT_ENTRY_NAMES)} OR {_starts("substr(n.key, 6)", fixed.AUDIT_ENTRY_PREFIXES)} THEN 'possible_entrypoints'
      WHEN starts_with(substr(n.key, 6), 'public/') THEN 'unreferenced_public_assets' WHEN {_SUFFIX.format("substr(n.key, 6)")} IN {_list(fixed.MEDIA)} THEN 'unreferenced_media' ELSE 'requires_review' END AS c
  FROM current_nodes n LEFT JOIN deg ON deg.key = n.key WHERE starts_with(n.key, 'file:')),
audit AS (SELECT key, c AS class FROM cls UNION ALL SELECT key, 'produced_but_no_consumers_detected' FROM cls WHERE p > 0 AND i = 0)"""
_FILES = f"""{_WITH}, files AS (SELECT key, status, string_split(replace({_REL}, '\\', '/'), '/') AS parts FROM current_nodes WHERE starts_with(key, 'file:') AND {_REL} <> ''),
plain AS (SELECT * FROM files WHERE NOT list_contains(parts, '') AND NOT list_contains(parts, '.') AND NOT list_contains(parts, '..')),
ups AS (SELECT key, status, parts, unnest(range(0, len(parts))) AS k FROM plain)"""


def _tree(prefix: str) -> str:
    stem = f"file:{prefix}/" if prefix else "file:"
    return f"""{_WITH}, rows AS (SELECT key, status, substr(key, {len(stem) + 1}) AS rest FROM current_nodes WHERE starts_with(lower(key), '{stem.lower()}') AND length(key) > {len(stem)}),
per AS (SELECT split_part(rest, '/', 1) AS name, bool_or(contains(rest, '/') OR (NOT contains(rest, '/') AND regexp_matches(lower(rest), '\\.(iso|zip|jar|whl)$'))) AS directory, min(CASE WHEN NOT contains(rest, '/') THEN key END) AS key,
  min({_rank("status", fixed.TREE_RANK, 5)}) AS r, count(*) AS n FROM rows GROUP BY 1)
SELECT name, directory, key, {_unrank("r", fixed.TREE_RANK)} AS status, n FROM per ORDER BY directory DESC, lower(name), name LIMIT 2000"""


def _reach(seed: str, direction: str) -> str:
    steps = {"dependencies": "SELECT source AS a, target AS b FROM e", "dependents": "SELECT target AS a, source AS b FROM e", "both": "SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e"}[direction]
    return f"{_WITH}, steps AS ({steps}), reach(key) AS (SELECT key FROM current_nodes WHERE {seed} UNION SELECT s.b FROM steps s JOIN reach r ON s.a = r.key)"


_IMPACT = f"""{_WITH}, uses AS (SELECT source, target, CASE WHEN {_LOWE} THEN 1 ELSE 0 END AS low FROM e WHERE {_USE}),
walk(key, d, unc) AS (SELECT '{SETTINGS}', 0, 0 UNION SELECT u.source, w.d + 1, greatest(w.unc, u.low) FROM walk w JOIN uses u ON u.target = w.key WHERE w.d < 25),
best AS (SELECT key, min(d * 10 + unc) AS m FROM walk GROUP BY key),
consumers AS (SELECT key, (m // 10)::INT AS distance, CASE WHEN m % 10 = 1 THEN 'possible' ELSE 'declared' END AS certainty FROM best WHERE m >= 10)"""
_PUBLIC = """CASE WHEN evidence IN ('declared', 'inferred', 'heuristic', 'observed') THEN evidence ELSE 'inferred' END"""
_SECTION = """CASE WHEN starts_with(key, 'external:') THEN 'external dependencies' WHEN starts_with(key, 'iso:') OR starts_with(key, 'zip:') THEN left(split_part(key, '!/', 1), 55) || ' / content'
  WHEN key = 'dir:.' THEN 'project root' WHEN starts_with(key, 'dir:') THEN array_to_string(string_split(substr(key, 5), '/')[1:2], '/') WHEN NOT starts_with(key, 'file:') THEN 'other'
  WHEN len(string_split(substr(key, 6), '/')) < 2 THEN 'project root'
  WHEN (split_part(substr(key, 6), '/', 1) = 'src' AND split_part(substr(key, 6), '/', 2) IN ('assets', 'content', 'pages', 'components')) OR (split_part(substr(key, 6), '/', 1) = 'public' AND split_part(substr(key, 6), '/', 2) = 'images')
    THEN array_to_string(string_split(substr(key, 6), '/')[1:least(3, len(string_split(substr(key, 6), '/')) - 1)], '/')
  ELSE array_to_string(string_split(substr(key, 6), '/')[1:2], '/') END"""
_PREFIX = f"file:{FOLDER.rsplit('/', 1)[0]}/"
_HOP = "file:atlas-core/public/img/logo.svg"

SQL = {
    "status_counts": f"{_WITH} SELECT status, count(*) AS n FROM current_nodes GROUP BY status",
    "relation_counts": f"{_WITH} SELECT relation, count(*) AS n FROM e GROUP BY relation",
    "graph_totals": f"""{_WITH} SELECT (SELECT count(*) FROM current_nodes) AS nodes, (SELECT count(*) FROM current_nodes WHERE starts_with(key, 'file:')) AS files,
  count(*) FILTER ({_USE}) AS semantic_edges, count(*) FILTER (relation IN {_PROD}) AS production_edges, count(*) FILTER (relation IN {_STR}) AS structural_edges, count(*) AS edges FROM e""",
    "usage_labels": f"""{_WITH}, c AS (SELECT target, count(*) FILTER ({_USE} AND NOT {_LOWE}) AS dec, count(*) FILTER ({_USE} AND {_LOWE}) AS inf, count(*) FILTER (relation IN {_PROD}) AS prod FROM e GROUP BY target)
SELECT key, CASE WHEN coalesce(dec, 0) > 0 THEN 'referenced' WHEN coalesce(inf, 0) > 0 THEN 'possibly-referenced' WHEN {_ENTRY} THEN 'entrypoint' ELSE 'unresolved' END AS usage,
  coalesce(dec, 0) AS declared_incoming, coalesce(inf, 0) AS inferred_incoming, coalesce(prod, 0) AS producers, NULL::BOOLEAN AS safe_to_delete FROM current_nodes LEFT JOIN c ON c.target = key""",
    "degrees": f"{_WITH}, {_DEGREES} SELECT * FROM deg",
    "audit_categories": f"{_AUDIT} SELECT key, class FROM audit",
    "audit_counts": f"{_AUDIT} SELECT class, count(*) AS n FROM audit GROUP BY class",
    "top_unresolved": f"{_WITH} SELECT target, count(*) AS n FROM e WHERE {_USE} AND starts_with(target, 'external:') GROUP BY target ORDER BY n DESC, target LIMIT 250",
    "folder_rollup": f"""{_FILES}, r AS (SELECT CASE WHEN k = 0 THEN '.' ELSE array_to_string(parts[1:k], '/') END AS dir, k, least({_rank("status", fixed.ROLLUP_RANK)}, 4) AS rk FROM ups)
SELECT 'dir:' || dir AS dir, min(k)::INT AS depth, {_unrank("min(rk)", fixed.ROLLUP_RANK)} AS status, count(*) AS n_files FROM r GROUP BY dir""",
    "folder_children": f"""{_WITH}, inside AS (SELECT key, status, substr(key, {len(_PREFIX) + 1}) AS rest FROM current_nodes WHERE kind = 'file' AND starts_with(key, '{_PREFIX}')),
per AS (SELECT CASE WHEN contains(rest, '/') THEN 'dir:{_PREFIX[5:]}' || split_part(rest, '/', 1) ELSE key END AS child, min({_rank("status", fixed.ROLLUP_RANK)}) AS r, count(*) AS n_files FROM inside GROUP BY 1)
SELECT child, {_unrank("r", fixed.ROLLUP_RANK)} AS status, n_files FROM per ORDER BY child LIMIT 200""",
    "tree_root": _tree(""),
    "tree_level": _tree("atlas-core/src"),
    "section_groups": f"{_WITH} SELECT {_SECTION} AS section, count(*) AS n_nodes, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in fixed.STATUSES) + " FROM current_nodes GROUP BY 1",
    "structure_edges": f"""{_FILES}, made AS (SELECT DISTINCT CASE WHEN k = 0 THEN 'dir:.' ELSE 'dir:' || array_to_string(parts[1:k], '/') END AS source,
  CASE WHEN k = len(parts) - 1 THEN key ELSE 'dir:' || array_to_string(parts[1:k + 1], '/') END AS target, 'contains' AS relation, 'filesystem' AS evidence FROM ups)
SELECT * FROM made m WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.source = m.source AND e.target = m.target AND e.relation = 'contains')""",
    "scope_dependencies": _reach(f"starts_with(lower(key), 'file:{FOLDER}/')", "dependencies") + " SELECT key FROM reach",
    "scope_dependents": _reach(f"key = '{SHARED}'", "dependents") + " SELECT key FROM reach",
    "scope_both": _reach(f"key = '{SHARED}'", "both") + " SELECT key FROM reach",
    "scope_page": _reach(f"key = '{SHARED}'", "dependents") + " SELECT key FROM reach ORDER BY key LIMIT 200 OFFSET 200",
    "impact_consumers": f"{_IMPACT} SELECT * FROM consumers WHERE key <> '{SETTINGS}'",
    "impact_summary": f"""{_IMPACT} SELECT count(*) AS transitive, count(*) FILTER (certainty = 'possible') AS possible_paths, max(distance) AS depth,
  (SELECT count(*) FROM uses WHERE target = '{SETTINGS}' AND low = 0) AS direct_declared, (SELECT count(*) FROM uses WHERE target = '{SETTINGS}' AND low = 1) AS direct_inferred, FALSE AS truncated FROM consumers WHERE key <> '{SETTINGS}'""",
    "two_hop": f"""{_WITH}, both_ways AS (SELECT source AS a, target AS b FROM e WHERE source <> target UNION SELECT target, source FROM e WHERE source <> target),
one AS (SELECT DISTINCT b AS key FROM both_ways WHERE a = '{_HOP}' ORDER BY key LIMIT 24),
two AS (SELECT DISTINCT b AS key FROM both_ways WHERE a IN (SELECT key FROM one) AND b <> '{_HOP}' AND b NOT IN (SELECT key FROM one) ORDER BY key LIMIT 46)
SELECT key, 1 AS hop FROM one UNION ALL SELECT key, 2 FROM two""",
    "induced_edges": f"{_WITH} SELECT * FROM e WHERE source IN (SELECT key FROM current_nodes WHERE status = 'done') AND target IN (SELECT key FROM current_nodes WHERE status = 'done')",
    "edge_upsert": f"{_WITH} SELECT * FROM e",
    "edge_replacement": f"""WITH {_CURRENT}, {_edges(name="old", where="loaded_at < TIMESTAMP '2026-05-01'")}, {_edges(name="new", where="loaded_at >= TIMESTAMP '2026-05-01'")},
fresh AS (SELECT * FROM new WHERE source IN (SELECT key FROM current_nodes WHERE status = 'done'))
SELECT * FROM old WHERE source NOT IN (SELECT source FROM fresh) UNION ALL SELECT * FROM fresh""",
    "live_edges": f"""{_WITH}, shown AS (SELECT id, key FROM current_nodes ORDER BY id, key LIMIT {VIEW_NODES})
SELECT e.source, e.target, e.relation, e.evidence FROM e JOIN shown a ON a.key = e.source JOIN shown b ON b.key = e.target ORDER BY a.id, e.source, e.target, e.relation LIMIT {VIEW_EDGES}""",
    "node_page": f"{_WITH} SELECT id, key, kind, status, depth FROM current_nodes ORDER BY id LIMIT {PAGE} OFFSET {PAGE}",
    "search_nodes": f"{_WITH} SELECT id, key, status FROM current_nodes WHERE contains(lower(key), '_pb2') ORDER BY id LIMIT {PAGE}",
    "search_total": f"{_WITH} SELECT count(*) AS n FROM current_nodes WHERE contains(lower(key), '_pb2')",
    "queue_pick": f"{_WITH} SELECT key, depth FROM current_nodes WHERE status = 'pending' ORDER BY depth DESC, id LIMIT 1",
    "failed_nodes": f"{_WITH} SELECT key, error FROM current_nodes WHERE status = 'failed' ORDER BY id LIMIT 15",
    "pending_nodes": f"{_WITH} SELECT key, status FROM current_nodes WHERE status IN ('pending', 'running')",
    "entry_points": f"{_WITH} SELECT key FROM current_nodes WHERE {_ENTRY}",
    "key_parts": f"""{_WITH}, p AS (SELECT key, CASE WHEN starts_with(key, 'file:') THEN {_REL} ELSE '' END AS path FROM current_nodes)
SELECT key, CASE WHEN starts_with(key, 'external:') THEN 'external' WHEN starts_with(key, 'iso:') THEN 'iso' WHEN starts_with(key, 'zip:') THEN 'zip' ELSE 'file' END AS kind,
  CASE WHEN starts_with(key, 'external:') THEN 'external' ELSE 'pending' END AS initial_status, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS folder, {_NAME.format("path")} AS name, {_SUFFIX.format("path")} AS ending FROM p""",
    "note_names": f"""{_WITH}, s AS (SELECT key, replace(replace(translate({_NAME.format("key")}, '|\\:#', '----'), '[', ''), ']', '') AS short FROM current_nodes)
SELECT key, CASE WHEN short = '' THEN 'unknown' ELSE left(short, 65) END || '-' || left(sha256(key), 12) AS note FROM s""",
    "public_nodes": f"""{_WITH} SELECT key, CASE WHEN status IN {_list(fixed.STATUSES)} THEN status ELSE 'pending' END AS status, (len(string_split({_REL}, '/')) - 1)::INT AS depth FROM current_nodes
WHERE kind = 'file' AND starts_with(key, 'file:') AND NOT regexp_matches(lower(key), '{fixed.SECRET_NAMES}')""",
    "public_edges": f"""{_WITH}, f AS (SELECT key FROM current_nodes WHERE starts_with(key, 'file:atlas-core/'))
SELECT source, target, relation, {_PUBLIC} AS evidence FROM e WHERE source IN (SELECT key FROM f) AND target IN (SELECT key FROM f) AND regexp_matches(relation, '{fixed.RELATION_NAME}')""",
    "node_details": f"""{_WITH}, typed AS (SELECT key, category, language FROM (SELECT key, lower(trim(category)) AS category, language, row_number() OVER (PARTITION BY key ORDER BY loaded_at DESC NULLS LAST, lower(trim(category)) DESC NULLS LAST, language DESC NULLS LAST) AS rn FROM file_types) WHERE rn = 1),
o AS (SELECT source, count(*) AS n_out, min(target) AS first_out FROM e GROUP BY source), i AS (SELECT target, count(*) AS n_in, min(source) AS first_in FROM e GROUP BY target)
SELECT n.key, n.status, t.category, t.language, coalesce(n_out, 0) AS n_out, first_out, coalesce(n_in, 0) AS n_in, first_in,
  CASE WHEN starts_with(n.key, 'file:') THEN 'dir:' || CASE WHEN contains(substr(n.key, 6), '/') THEN regexp_replace(substr(n.key, 6), '/[^/]*$', '') ELSE '.' END END AS folder
FROM current_nodes n LEFT JOIN typed t ON t.key = n.key LEFT JOIN o ON o.source = n.key LEFT JOIN i ON i.target = n.key""",
}

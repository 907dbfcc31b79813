"""The dependency graph: current tables, labels, audits, reachability and impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweft.functions import fixed, keys
from depweft.session import cut, cut_counted


def structural() -> Column:
    return F.col("relation").isin(fixed.STRUCTURAL)


def production() -> Column:
    return F.col("relation").isin(fixed.PRODUCTION)


def low() -> Column:
    return F.coalesce(F.col("evidence").isin(fixed.LOW_CONFIDENCE), F.lit(False))


def current_edges(edges: DataFrame) -> DataFrame:
    """One row per (source, target, relation): the evidence delivered last, in lower case, else the greatest. Rows without source,
    target or relation are no edges."""
    whole = edges.where(F.col("source").isNotNull() & F.col("target").isNotNull() & F.col("relation").isNotNull())
    last = F.max(F.struct("loaded_at", F.lower(F.trim("evidence")).alias("evidence"))).alias("last")
    return whole.groupBy("source", "target", "relation").agg(last).select("source", "target", "relation", "last.evidence")


def usage_labels(node_keys: DataFrame, edges: DataFrame) -> DataFrame:
    """key, usage, declared_incoming, inferred_incoming, producers, safe_to_delete (always null) for every key.

    Unknown evidence counts as declared. Counting happens per target before the join, so hot targets are no burden.
    """
    is_use = ~structural() & ~production()
    counts = edges.groupBy(F.col("target").alias("key")).agg(
        F.count_if(is_use & ~low()).alias("declared_incoming"), F.count_if(is_use & low()).alias("inferred_incoming"), F.count_if(production()).alias("producers")
    )
    zero = F.lit(0).cast("bigint")
    out = node_keys.select("key").join(counts, "key", "left").select("key", *(F.coalesce(c, zero).alias(c) for c in ("declared_incoming", "inferred_incoming", "producers")))
    usage = F.when(F.col("declared_incoming") > 0, "referenced").when(F.col("inferred_incoming") > 0, "possibly-referenced").when(keys.likely_entrypoint(F.col("key")), "entrypoint").otherwise("unresolved")
    return out.select("key", usage.alias("usage"), "declared_incoming", "inferred_incoming", "producers", F.lit(None).cast("boolean").alias("safe_to_delete"))


def degrees(edges: DataFrame) -> DataFrame:
    """key, incoming, outgoing, produced: semantic degrees and production in-degree of every key that has any."""
    is_use = ~structural() & ~production()
    ends = F.explode(
        F.array(
            F.struct(F.col("target").alias("key"), is_use.cast("int").alias("i"), F.lit(0).alias("o"), production().cast("int").alias("p")),
            F.struct(F.col("source").alias("key"), F.lit(0).alias("i"), is_use.cast("int").alias("o"), F.lit(0).alias("p")),
        )
    )
    return edges.select(ends.alias("e")).groupBy("e.key").agg(F.sum("e.i").alias("incoming"), F.sum("e.o").alias("outgoing"), F.sum("e.p").alias("produced"))


def adjacency(edges: DataFrame) -> DataFrame:
    """key, view, other, relation, evidence: each use as incoming of its target and outgoing of its source, and what produces a key
    as its production. Unknown evidence is called unknown."""

    def row(view: str, key: str, other: str) -> Column:
        return F.struct(F.col(key).alias("key"), F.lit(view).alias("view"), F.col(other).alias("other"))

    use = (F.col("source") != "") & (F.col("target") != "")
    uses = F.array(row("incoming", "target", "source"), row("outgoing", "source", "target"))
    views = F.when(production(), F.array(row("production", "target", "source"))).when(use, uses)
    return edges.where(~structural()).select(F.explode(views).alias("v"), "relation", F.coalesce("evidence", F.lit("unknown")).alias("evidence")).select("v.*", "relation", "evidence")


def first_edges(node_keys: DataFrame, edges: DataFrame, most: int = 200) -> DataFrame:
    """key, direction, n, other, relation, evidence: the first edges of each node either way by the other end and relation, counted
    from 1, at most so many each way. Tasks keep no more of a key before it is gathered, so hot targets are no burden."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy("other", "relation"))

    def way(direction: str, key: str, other: str) -> DataFrame:
        own = edges.select(F.col(key).alias("key"), F.lit(direction).alias("direction"), F.col(other).alias("other"), "relation", "evidence")
        return own.withColumn("n", rank).where(F.col("n") <= most).join(node_keys.select("key").distinct(), "key", "left_semi")

    return way("outgoing", "source", "target").unionByName(way("incoming", "target", "source")).select("key", "direction", "n", "other", "relation", "evidence")


def audit_classes(node_keys: DataFrame, edges: DataFrame) -> DataFrame:
    """key, class of every file. Produced files without consumers have a class for that besides their own."""
    d = node_keys.where(F.col("key").startswith("file:")).select("key").join(degrees(edges), "key", "left")
    incoming, produced = F.coalesce("incoming", F.lit(0)), F.coalesce("produced", F.lit(0))
    rel = keys.relative(F.col("key"))
    entry = F.lower(keys.base_name(rel)).isin(fixed.AUDIT_ENTRY_NAMES) | keys.any_of(*(rel.startswith(p) for p in fixed.AUDIT_ENTRY_PREFIXES))
    own = F.when(incoming > 0, "referenced_by_other_files").when(entry, "possible_entrypoints").when(rel.startswith("public/"), "unreferenced_public_assets").when(keys.suffix(rel).isin(fixed.MEDIA), "unreferenced_media").otherwise("requires_review")
    extra = F.when((produced > 0) & (incoming == 0), "produced_but_no_consumers_detected")
    return d.select("key", F.explode(F.array_compact(F.array(extra, own))).alias("class"))


#: Keys of a frontier up to which it is broadcast to the edges; beyond, both sides are shuffled and hot keys are split at run time.
BROADCAST_FRONTIER = 500_000


#: Levels after which the union of what a walk has seen is written anew.
MERGED = 16


def merged(seen: DataFrame, level: int) -> DataFrame:
    """The union of the levels seen, as one table whenever it has grown by MERGED of them."""
    return seen if level % MERGED else cut(seen)


def _to_edges(frontier: DataFrame, n: int, most: int = BROADCAST_FRONTIER) -> DataFrame:
    """The frontier for a join with edges, whose number of rows n is known: broadcast while that is small, so that the edges of a hub stay
    spread as they are."""
    return F.broadcast(frontier) if n <= most else frontier


def reach(nodes: DataFrame, edges: DataFrame, seed: Column, direction: str = "both") -> DataFrame:
    """Keys reachable from the nodes that satisfy seed, themselves included, along dependencies, dependents or both.

    Level by level until a level is empty: the frontier meets the edges, what was seen is taken off by an anti-join, and each level
    is written to the checkpoint folder. What was seen is a union of the levels, written anew as one table every MERGED levels, so that
    plan and lineage stay bounded however deep the graph is. No relation is left out.
    """
    if direction not in ("dependencies", "dependents", "both"):
        raise ValueError("direction is dependencies, dependents or both")
    forward = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    steps = {"dependencies": forward, "dependents": forward.select(F.col("b").alias("a"), F.col("a").alias("b")), "both": forward.unionByName(forward.select(F.col("b").alias("a"), F.col("a").alias("b")))}[direction]
    steps = cut(steps.distinct())
    frontier, n = cut_counted(nodes.where(seed).select("key").distinct())
    seen, level = frontier, 0
    while n:
        level += 1
        met = steps.join(_to_edges(frontier.withColumnRenamed("key", "a"), n), "a").select(F.col("b").alias("key")).distinct()
        frontier, n = cut_counted(met.join(seen, "key", "left_anti"))
        seen = merged(seen.unionByName(frontier), level) if n else seen
    return seen


def scope_seed(reference: str) -> Column:
    """Seed of reach for a key, or for all files below a folder (case of ASCII letters aside)."""
    if reference.startswith(("file:", "iso:", "external:")):
        return F.col("key") == reference
    folder = reference.replace("\\", "/").strip("/")
    if not folder or ".." in folder.split("/"):
        raise ValueError("invalid folder")
    return F.ilike(F.col("key"), F.lit(keys.like_escape(f"file:{folder}/") + "%"), F.lit("\\"))


def impact(edges: DataFrame, key: str, max_depth: int = 25, max_nodes: int | None = 10_000) -> tuple[DataFrame, bool]:
    """Consumers of key over reversed edges: key, distance, certainty, relation, chain (from the consumer to key); and whether a
    bound cut the walk short.

    Structural and production edges play no part. A consumer is declared if one of its shortest paths has no low-confidence
    evidence. Bounds are clamped to 1..50 levels and 100..20000 nodes, or no bound on nodes if max_nodes is None; the level in
    which the node bound is reached is still whole.
    """
    max_depth = min(max(1, max_depth), 50)
    most = float("inf") if max_nodes is None else min(max(100, max_nodes), 20_000)
    uses = cut(edges.where(~structural() & ~production()).select("source", "target", "relation", low().alias("low")))
    spark = edges.sparkSession
    start = spark.createDataFrame([(key, 0, False, "", [key])], "key string, distance int, possible boolean, relation string, chain array<string>")
    frontier = seen = cut(start)
    n, found, truncated = 1, 1, False
    for level in range(1, max_depth + 1):
        at = frontier.select(F.col("key").alias("target"), "possible", "chain")
        met = uses.join(_to_edges(at, found), "target")
        row = F.struct((F.col("possible") | F.col("low")).alias("possible"), "relation", F.concat(F.array("source"), F.col("chain")).alias("chain"))
        best = met.select(F.col("source").alias("key"), row.alias("row")).groupBy("key").agg(F.min("row").alias("row"))
        new = best.join(seen.select("key"), "key", "left_anti").select("key", F.lit(level).alias("distance"), "row.possible", "row.relation", "row.chain")
        frontier, found = cut_counted(new)
        if max_nodes is not None:
            found = frontier.count()
        if not found:
            break
        seen, n = merged(seen.unionByName(frontier), level), n + found
        if n >= most or level == max_depth:
            last = _to_edges(frontier.select(F.col("key").alias("target")), found)
            truncated = not uses.join(last, "target").select(F.col("source").alias("key")).join(seen.select("key"), "key", "left_anti").isEmpty()
            break
    out = seen.where(F.col("distance") > 0)
    return out.select("key", "distance", F.when(F.col("possible"), "possible").otherwise("declared").alias("certainty"), "relation", "chain"), truncated


def entry_chains(consumers: DataFrame, most: int = 50) -> DataFrame:
    """Entry points among the consumers with their chains: shortest first, then by key."""
    return consumers.where(keys.likely_entrypoint(F.col("key"))).select(F.col("key").alias("entry"), "chain").orderBy(F.size("chain"), "entry").limit(most)


def ancestors(path: Column) -> Column:
    """Folders above a path: '.' and every proper prefix."""
    parts = F.split(path, "/")
    deeper = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit(".")), deeper)


def plain_files(nodes: DataFrame) -> DataFrame:
    """key, status, path of files with a plain relative path."""
    path = F.replace(keys.relative(F.col("key")), F.lit("\\"), F.lit("/"))
    odd = F.exists(F.split("path", "/"), lambda s: s.isin("", ".", ".."))
    return nodes.where(F.col("key").startswith("file:")).select("key", "status", path.alias("path")).where((F.col("path") != "") & ~odd)


def folder_rollup(nodes: DataFrame) -> DataFrame:
    """dir, depth, status, n_files of every folder above a file; status is the most pressing of what lies below."""
    rank = F.least(keys.rank_of(F.col("status"), fixed.ROLLUP_RANK), F.lit(fixed.ROLLUP_RANK.index("done")))
    up = plain_files(nodes).select(F.explode(ancestors(F.col("path"))).alias("dir"), rank.alias("rank"))
    out = up.groupBy("dir").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n_files"))
    depth = F.when(F.col("dir") == ".", 0).otherwise(F.size(F.split("dir", "/")))
    return out.select(F.concat(F.lit("dir:"), "dir").alias("dir"), depth.alias("depth"), keys.status_of(F.col("rank"), fixed.ROLLUP_RANK).alias("status"), "n_files")


def structure_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Containment of folders and files that edges do not hold: source, target, relation, evidence."""
    up = ancestors(F.col("path"))
    chain = F.concat(F.transform(up, lambda d: F.concat(F.lit("dir:"), d)), F.array("key"))
    pairs = F.explode(F.transform(F.sequence(F.lit(1), F.size(chain) - 1), lambda i: F.struct(F.element_at(chain, i).alias("source"), F.element_at(chain, i + 1).alias("target"))))
    made = plain_files(nodes).select(pairs.alias("p")).select("p.source", "p.target", F.lit("contains").alias("relation"), F.lit("filesystem").alias("evidence")).distinct()
    return made.join(edges.select("source", "target", "relation"), ["source", "target", "relation"], "left_anti")


def tree_level(nodes: DataFrame, prefix: str, most: int = 2000) -> DataFrame:
    """Children of a folder (or of an iso:/zip: prefix): name, directory, key, status, n; folders first, then by name."""
    inside = prefix.startswith(("iso:", "zip:"))
    clean = prefix.rstrip("/") + "/" if prefix else ""
    stem = clean if inside else f"file:{clean}"
    rest = F.substring(F.col("key"), F.lit(len(stem) + 1), F.length("key"))
    rows = nodes.where(F.ilike(F.col("key"), F.lit(keys.like_escape(stem) + "%"), F.lit("\\"))).select("key", "status", rest.alias("rest")).where(F.col("rest") != "")
    name, nested = F.split_part("rest", F.lit("/"), F.lit(1)), F.contains("rest", F.lit("/"))
    archive = F.col("key").startswith("file:") & ~nested & F.lower(name).rlike(r"\.(iso|zip|jar|whl)$")
    rank = keys.rank_of(F.col("status"), fixed.TREE_RANK, 5)
    per = rows.select(name.alias("name"), nested.alias("nested"), archive.alias("archive"), rank.alias("rank"), "key").groupBy("name").agg(
        F.max(F.col("nested") | F.col("archive")).alias("directory"), F.min(F.when(~F.col("nested"), F.col("key"))).alias("key"), F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n")
    )
    return per.select("name", "directory", "key", keys.status_of(F.col("rank"), fixed.TREE_RANK).alias("status"), "n").orderBy(F.desc("directory"), F.lower("name"), "name").limit(most)


def two_hop(edges: DataFrame, key: str, first: int = 24, second: int = 46) -> DataFrame:
    """Undirected neighbourhood: key, hop (1 or 2); each hop is cut to its first keys in order."""
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b"))).where(F.col("a") != F.col("b"))
    one = both.where(F.col("a") == key).select(F.col("b").alias("key")).distinct().orderBy("key").limit(first)
    two = both.join(F.broadcast(one.withColumnRenamed("key", "a")), "a").select(F.col("b").alias("key")).distinct().where(F.col("key") != key).join(one, "key", "left_anti").orderBy("key").limit(second)
    return one.withColumn("hop", F.lit(1)).unionByName(two.withColumn("hop", F.lit(2)))


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges both ends of which are kept (column key)."""
    k = kept.select("key").distinct()
    return edges.join(k.withColumnRenamed("key", "source"), "source", "left_semi").join(k.withColumnRenamed("key", "target"), "target", "left_semi")


def public_snapshot(nodes: DataFrame, edges: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges fit for publication: only allowed paths (column path), known statuses and evidence, well-formed relations."""
    rel = keys.relative(F.col("key"))
    files = nodes.where(F.col("key").startswith("file:")).select("key", "status", rel.alias("path")).join(allowed.select("path").distinct(), "path", "left_semi")
    depth = F.size(F.split("path", "/")) - 1
    clean = files.select("key", F.when(F.col("status").isin(fixed.STATUSES), F.col("status")).otherwise("pending").alias("status"), depth.alias("depth"))
    kept = induced(edges.where(F.col("relation").rlike(fixed.RELATION_NAME)), clean)
    evidence = F.when(F.col("evidence").isin("declared", "inferred", "heuristic", "observed"), F.col("evidence")).otherwise("inferred")
    return clean, kept.select("source", "target", "relation", evidence.alias("evidence"))


def replace_edges(old: DataFrame, new: DataFrame, analysed: DataFrame) -> DataFrame:
    """Edges after a run: those of analysed sources (column source) are replaced by new ones, all others stay."""
    return old.join(analysed.select("source").distinct(), "source", "left_anti").unionByName(new.select(*old.columns))

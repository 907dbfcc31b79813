"""From files to the graph: extraction, resolution and discovery, set by set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweft.functions import fixed, keys
from depweft.operators import extract, graph
from depweft.operators.incremental import VersionedTarget
from depweft.operators.resolve import expanded, resolved
from depweft.session import cut, cut_counted
from depweft.sources.binaries import binary_references
from depweft.sources.blobs import COLUMNS, text_pieces
from depweft.sources.containers import encryption_reasons, iso_edges, iso_files

#: Texts above this many bytes are scanned by patterns instead of being parsed.
TEXT_LIMIT = 4 * 1024 * 1024
#: Name endings of the texts that any pattern is for.
PATTERN_ENDINGS = sorted({e for table in (fixed.PATTERNS, fixed.WEB_PATTERNS, fixed.SEMANTIC_PATTERNS) for endings, *_ in table for e in endings} | {".py", ".pyi"})
EDGES = "source string, target string, relation string, evidence string"


def aliases_of(files: DataFrame) -> dict[str, str]:
    """Import prefixes that a project's own configuration files declare; few files, each read whole."""
    config = files.where(F.col("path").isin("astro.config.mjs", "tsconfig.json", "jsconfig.json") & (F.length("text") < 400_000))
    astro = config.where(F.col("path") == "astro.config.mjs").select(F.explode(F.regexp_extract_all("text", F.lit(r"""["'](@[\w/-]+)["']\s*:\s*["']/src(?:/[\w.-]+)*["']"""), 0)).alias("m"))
    pairs = astro.select(F.regexp_extract("m", r"""^["'](@[\w/-]+)["']""", 1).alias("k"), F.regexp_extract("m", r"""["']/?([^"']*)["']$""", 1).alias("v"))
    ts = config.where(F.col("path") != "astro.config.mjs").select(F.explode(F.regexp_extract_all("text", F.lit(r'"(@[^"]+/)\*"\s*:\s*\[\s*"([^"]+/)\*"'), 0)).alias("m"))
    more = ts.select(F.regexp_extract("m", r'^"(@[^"]+)/\*"', 1).alias("k"), F.regexp_extract("m", r'\[\s*"(?:\./)?([^"]+)/\*"$', 1).alias("v"))
    return {r["k"].rstrip("/") + "/": r["v"].strip("/") + "/" for r in pairs.unionByName(more).collect()}


def file_references(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References of all texts (extract.REFS), and path, error of those that can't be parsed.

    files: path string, content binary, and location of those whose content is not held. Small texts are parsed; large ones are
    scanned piece by piece.
    """
    held = files.where(F.col("content").isNotNull()).select("path", extract.decoded(F.col("content")).alias("text"), F.length("content").alias("size"))
    texts = cut(held)
    small, large = texts.where(F.col("size") <= TEXT_LIMIT).select("path", "text"), texts.where(F.col("size") > TEXT_LIMIT).select("path", "text")
    pieces = cut(text_pieces(files.where(keys.suffix(F.col("path")).isin(PATTERN_ENDINGS))))
    return text_references(small, large.unionByName(pieces))


def text_references(texts: DataFrame, pieces: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """References of texts (path, text) by every extractor, and path, error of those that can't be parsed; pieces of larger texts are only
    scanned by patterns."""
    refs, errors = extract.parsed_references(texts)
    refs = refs.unionByName(extract.package_json(texts)).unionByName(extract.manifest_lines(texts))
    scanned = texts if pieces is None else texts.unionByName(pieces)
    for extractor in (extract.static_references, extract.web_references, extract.semantic_references, extract.template_imports, extract.literal_writes):
        refs = refs.unionByName(extractor(scanned))
    return (refs if pieces is None else refs.unionByName(extract.python_streamed(pieces))).distinct(), errors


DONE = "path string, digest string, spec string, relation string, evidence string, mode string, error string"


def references_in_portions(files: DataFrame, done: VersionedTarget, portions: int = 16, cancelled: Callable[[], bool] = lambda: False) -> bool:
    """References of the files that done (schema DONE) does not hold yet under their digest, extracted and published portion by portion.

    Returns whether all is done; cancelled is asked before each portion. A run that is cancelled or fails keeps the portions it has
    published, and the next run takes up the files that are left. A file without references has one row without spec.
    """
    held = done.read().select("path", "digest").distinct()
    left = cut(with_bytes(files).where(F.col("error").isNull()).join(held, ["path", "digest"], "left_anti"))
    for n in range(portions):
        if cancelled():
            return False
        part = left.where(F.pmod(F.xxhash64("path"), F.lit(portions)) == n)
        refs, errors = file_references(part)
        rows = part.select("path", "digest").join(refs, "path", "left").join(errors, "path", "left").select(*(c.split()[0] for c in DONE.split(", ")))
        done.publish(rows, done.version())
    return True


def file_edges(files: DataFrame, inventory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of all files, and path, error of those that failed.

    files: path string, content binary, and location and header of those whose content is not held. inventory: path of every file that
    may be referred to, skipped folders included.
    """
    refs, errors = file_references(files)
    refs = cut(refs)
    texts = files.where(F.col("content").isNotNull()).select("path", extract.decoded(F.col("content")).alias("text"))
    aliases = aliases_of(texts)
    known = inventory.select("path").distinct()
    edges = resolved(refs, known, aliases).unionByName(expanded(refs, known, aliases)).unionByName(extract.paired_content(known)).unionByName(extract.generated_posts(texts, known))
    libraries = binary_references(files)
    local = libraries.withColumn("mode", F.lit("path"))
    found = resolved(local, known).withColumn("target", F.regexp_replace("target", "^external:path:", "external:binary:")).withColumn("evidence", F.when(F.col("evidence") == "probable", "heuristic").otherwise(F.col("evidence")))
    images = files.where(F.lower("path").endswith(".iso"))
    every = edges.unionByName(found).unionByName(iso_edges(images))
    return every.join(errors.select(F.concat(F.lit("file:"), "path").alias("source")), "source", "left_anti").distinct(), errors


def with_bytes(files: DataFrame) -> DataFrame:
    """files with the columns location, header and error, null where they are missing."""
    return files.withColumns({n: F.lit(None).cast(t) for n, t in (COLUMNS | {"error": "string"}).items() if n not in files.columns})


def index_files(files: DataFrame, seeds: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes (key, kind, status, depth, digest, error) and edges of a project.

    files: path, seeded boolean, digest, content, location, header, error (as the tree source gives them; the last three may be
    missing). seeds: path; all seeded files if null. Nodes are the seeds and what they lead to; depth is the least number
    of steps from a seed. Encrypted and unreadable files have no edges; unreadable ones are failed.
    """
    files = cut(with_bytes(files))
    inventory = files.select("path")
    locked = encryption_reasons(files)
    edges, unparsed = file_edges(files.join(locked, "path", "left_anti"), inventory)
    errors = unparsed.unionByName(files.where(F.col("error").isNotNull()).select("path", "error"))
    edges = cut(edges)
    start = (seeds if seeds is not None else files.where("seeded")).select(F.concat(F.lit("file:"), "path").alias("key")).distinct()
    frontier = seen = cut(start.withColumn("depth", F.lit(0)))
    level = 0
    while True:
        level += 1
        met = edges.join(frontier.select(F.col("key").alias("source")), "source", "left_semi").select(F.col("target").alias("key")).distinct()
        frontier, n = cut_counted(met.join(seen, "key", "left_anti").withColumn("depth", F.lit(level)))
        if not n:
            break
        seen = graph.merged(seen.unionByName(frontier), level)
    path = keys.relative(F.col("key"))
    inner = iso_files(files.where(F.lower("path").endswith(".iso"))).where(F.col("inner").isNotNull()).select(F.concat(F.lit("iso:"), "path", F.lit("!/"), "inner").alias("key"), F.col("digest").alias("iso_digest"))
    facts = files.select("path", "digest").join(locked, "path", "left").join(errors, "path", "left")
    rows = seen.withColumn("path", path).join(facts, "path", "left").join(inner, "key", "left")
    problem = F.left(F.coalesce("reason", "error"), F.lit(450))
    status = F.when(F.col("key").startswith("external:"), "external").when(F.col("reason").isNotNull(), "encrypted").when(F.col("error").isNotNull(), "failed").otherwise("done")
    nodes = rows.select("key", keys.kind_of(F.col("key")).alias("kind"), status.alias("status"), "depth", F.coalesce("digest", "iso_digest").alias("digest"), problem.alias("error"))
    return nodes, edges.join(seen.select(F.col("key").alias("source")), "source", "left_semi")


def refreshed(old_nodes: DataFrame, old_edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph after another run: nodes that were analysed replace their edges; those that failed or are encrypted keep the edges and
    the digest they had, and take only status and error."""
    fields = ["kind", "status", "depth", "digest", "error"]
    o, n = (d.select("key", F.struct(*fields).alias(a)) for d, a in ((old_nodes, "o"), (new_nodes, "n")))
    both = o.join(n, "key", "full_outer")
    kept = F.col("n.status").isin("failed", "encrypted")
    pick = {f: F.coalesce(F.col(f"n.{f}"), F.col(f"o.{f}")) for f in ("kind", "status", "depth")}
    digest = F.when(kept, F.coalesce("o.digest", "n.digest")).otherwise(F.coalesce("n.digest", "o.digest"))
    nodes = both.select("key", *(c.alias(f) for f, c in pick.items()), digest.alias("digest"), F.when(F.col("n").isNotNull(), F.col("n.error")).otherwise(F.col("o.error")).alias("error"))
    analysed = new_nodes.where(F.col("status") == "done").select(F.col("key").alias("source"))
    return nodes, graph.replace_edges(old_edges, new_edges.join(analysed, "source", "left_semi"), analysed)

"""References to files: an ordered list of candidates per reference, of which the first that exists counts.

Instead of trying 128 candidates for every reference, the inventory is indexed the other way round: each path is listed under every stem
from which an ending of the rule leads to it, with the ending's rank. A reference then needs one row per base folder and one equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweft.functions import fixed, keys
from depweft.operators.extract import normal_reference

#: Endings that may follow a stem, in order of preference, by family of rules.
FAMILIES: dict[str, list[str]] = {
    "source": [e + v for e in fixed.SOURCE_EXTENSIONS for v in fixed.SOURCE_VARIANTS],
    "web": [e + v for e in fixed.COMPONENT_EXTENSIONS for v in fixed.COMPONENT_VARIANTS],
    "semantic": ["", *fixed.SEMANTIC_INDEXES, *fixed.SEMANTIC_SUFFIXES[1:]],
    "lua": [".lua", "/init.lua"],
    "ruby": ["", ".rb"],
    "perl": [".pm"],
    "exact": [""],
}
FAMILY_OF = {
    "path": "source", "python": "source", "system-header": "source", "java": "source", "dotnet": "source", "go": "source", "rust": "source", "lua": "lua", "ruby": "ruby", "ruby-relative": "ruby", "perl-module": "perl", "module": "exact", "file": "exact",
    "terraform": "exact", "package": "web", "web": "web", "resource": "web", "semantic": "semantic", "read": "semantic", "literal": "exact",
}
ALIASES = {"@/": "src/", "~/": "src/"}


def stems(inventory: DataFrame) -> DataFrame:
    """family, stem, target, rank: every path under the stems that lead to it.

    A path can end in four ways that a rule knows: anyhow, in its own ending, in its name below a folder, and in that below a folder with
    an ending. These meet the small table of all endings by a broadcast join.
    """
    rows = [(f, e, i) for f, es in FAMILIES.items() for i, e in enumerate(es)]
    ends = F.broadcast(inventory.sparkSession.createDataFrame(rows, "family string, end string, rank int"))
    path, ending = F.col("path"), r"\.[^./]+$"
    below = F.concat(F.lit("/"), keys.base_name(path))
    own = F.array_distinct(F.array(F.lit(""), F.regexp_extract(path, ending, 0), below, F.concat(F.regexp_extract(keys.parent(path), ending, 0), below)))
    fitting = inventory.select("path").distinct().select("path", F.explode(own).alias("end")).join(ends, "end").where(F.length("path") > F.length("end"))
    return fitting.select("family", F.substring(path, F.lit(1), F.length("path") - F.length("end")).alias("stem"), path.alias("target"), "rank")


def _case(column: Column, pairs: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in pairs.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def _under(folder: Column, spec: Column) -> Column:
    return F.concat_ws("/", folder, spec)


def bases(aliases: dict[str, str]) -> Column:
    """Array of stems of a reference, in order of preference; null elements are no candidates."""
    here, spec, mode = keys.parent(F.col("path")), F.col("spec"), F.col("mode")
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    module = F.replace(F.regexp_replace(spec, r"^\.+", ""), F.lit("."), F.lit("/"))
    up = F.concat_ws("/", here, F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))))
    python = F.when(dots > 0, F.array(_under(up, module), _under(F.lit(""), module))).otherwise(F.array(_under(F.lit(""), module), _under(here, module)))
    source = F.when(F.length(spec) <= 512, F.array(_under(here, spec), _under(F.lit(""), spec)))
    perl = F.replace(spec, F.lit("::"), F.lit("/"))
    lua = F.replace(spec, F.lit("."), F.lit("/"))
    value = normal_reference(spec)
    aliased = F.lit(None).cast("string")
    for prefix, folder in sorted(aliases.items(), key=lambda a: len(a[0])):
        aliased = F.when(value.startswith(prefix), F.concat(F.lit(folder), F.substring(value, F.lit(len(prefix) + 1), F.length(value)))).otherwise(aliased)
    rooted = F.regexp_replace(value, "^/+", "")
    plain = value.startswith("src/") | value.startswith("public/")
    web = (
        F.when(value.startswith("/"), F.array(_under(F.lit("public"), rooted), _under(F.lit(""), rooted)))
        .when(aliased.isNotNull(), F.array(_under(F.lit(""), aliased)))
        .when(value.startswith("."), F.array(_under(here, value)))
        .when(plain & (mode != "package"), F.array(_under(F.lit(""), value)))
        .when(mode == "read", F.array(_under(here, value), _under(F.lit(""), value)))
        .otherwise(F.array().cast("array<string>"))
    )
    options = (
        F.when(mode == "python", python)
        .when(mode.isin("package", "web", "resource", "semantic", "read"), web)
        .when(mode == "perl-module", F.array(_under(here, perl)))
        .when(mode == "lua", F.array(_under(here, lua)))
        .when(mode.isin("module", "file", "terraform", "ruby", "ruby-relative", "literal"), F.when(~spec.rlike(r"^[/\\]"), F.array(_under(here, spec))))
        .when(mode.isin("npm", "pip", "cargo"), F.array().cast("array<string>"))
        .otherwise(source)
    )
    # Normalised once, whatever the mode: the plan holds the walk over path segments a single time.
    return F.transform(options, keys.normal_path)


def resolved(refs: DataFrame, inventory: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Edges of references: source, target, relation, evidence.

    refs: path, spec, relation, evidence, mode (see extract). inventory: path. A reference to no file becomes an external key where its
    mode has one, and nothing otherwise; a heuristic one becomes probable. Web addresses are network references.
    """
    refs = refs.where(F.col("path").isNotNull() & F.col("spec").isNotNull() & (F.col("spec") != "")).distinct()
    address = F.col("spec").rlike("^(https?://|data:)") & ~F.col("mode").isin("package", "web", "resource", "semantic", "read", "npm", "pip", "cargo", "module", "file", "lua", "ruby", "ruby-relative", "perl-module", "terraform", "literal")
    marked = refs.withColumn("address", address)
    family = _case(F.col("mode"), FAMILY_OF)
    tried = marked.where(~F.col("address") & (F.col("mode") != "glob")).withColumn("family", family)
    candidates = tried.select("path", "spec", "relation", "evidence", "mode", "family", F.posexplode_outer(bases(ALIASES | (aliases or {}))).alias("base", "stem"))
    hits = candidates.where(F.col("stem").isNotNull() & (F.col("stem") != "")).join(stems(inventory), ["family", "stem"])
    reference = ["path", "spec", "relation", "evidence", "mode"]
    best = hits.groupBy(*reference).agg(F.min_by("target", F.struct("base", "rank", "target")).alias("target"))
    joined = tried.select(*reference).join(best, reference, "left")
    name, spec = F.col("mode"), F.col("spec")
    bare = ~spec.rlike(r"^(\.|/|@/|~/)")
    external = (
        F.when(name.isin("lua", "ruby", "perl-module", "module"), F.concat(F.lit("external:module:"), F.left(spec, F.lit(320))))
        .when((name == "terraform") & ~spec.startswith("."), F.concat(F.lit("external:terraform:"), F.left(spec, F.lit(320))))
        .when((name == "package") & bare, F.concat(F.lit("external:package:"), F.left(spec, F.lit(350))))
        .when(name.isin("path", "python", "system-header", "java", "dotnet", "go", "rust", "npm", "pip", "cargo"), F.concat(F.lit("external:"), name, F.lit(":"), F.left(spec, F.lit(350))))
    )
    target = F.when(F.col("target").isNotNull(), F.concat(F.lit("file:"), "target")).otherwise(external)
    evidence = F.when(F.col("target").isNull() & (F.col("evidence") == "heuristic"), "probable").otherwise(F.col("evidence"))
    relation = F.when((name == "terraform") & F.col("target").isNotNull(), "static-import").otherwise(F.col("relation"))
    files = joined.select(F.concat(F.lit("file:"), "path").alias("source"), target.alias("target"), relation.alias("relation"), evidence.alias("evidence")).where(F.col("target").isNotNull())
    network = marked.where("address").select(F.concat(F.lit("file:"), "path").alias("source"), F.concat(F.lit("external:url:"), F.left(spec, F.lit(350))).alias("target"), F.lit("network").alias("relation"), F.lit("declared").alias("evidence"))
    return files.unionByName(network).distinct()


def glob_regex(pattern: Column) -> Column:
    """Regular expression of a path pattern in which ${...} and * stand for one path step or a part of it, and ** for any number."""
    starred = F.regexp_replace(pattern, r"\$\{[\w.]+\}", "*")
    quoted = F.regexp_replace(starred, r"([.+^$(){}|\[\]\\])", r"\\$1")
    deep = F.regexp_replace(quoted, r"\*\*/?", "\u0001")
    return F.concat(F.lit("^"), F.replace(F.replace(F.replace(deep, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]")), F.lit("\u0001"), F.lit("(?:.*/)?")), F.lit("$"))


#: Parts into which the files below one folder are spread for the patterns that begin there.
FOLDER_PARTS = 64


def expanded(refs: DataFrame, inventory: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Edges of pattern references (mode glob): every file of the inventory that fits.

    A pattern meets the files below its literal folder that have its ending and, unless it holds **, its number of steps: an equi-join
    on all three, so that a pattern without a literal folder meets no more than those. Different patterns are expanded once,
    whatever the number of references, and files are spread over FOLDER_PARTS parts of a folder, so that a folder
    with most of the files is no task of its own. Only pairs that meet are tried by the regular expression.
    """
    from depweft.operators.graph import ancestors

    globs = refs.where((F.col("mode") == "glob") & F.col("spec").isNotNull()).withColumn("mode", F.lit("semantic")).withColumn("spec", F.regexp_replace("spec", r"\$\{[\w.]+\}", "*"))
    usable = globs.where(~F.contains("spec", F.lit("${")))
    named = usable.select("path", "relation", "evidence", F.explode(bases(ALIASES | (aliases or {}))).alias("pattern")).where(F.col("pattern").isNotNull())
    literal = F.regexp_extract("pattern", r"^((?:[^*?\[/]+/)*)", 1)
    # The ending where the pattern says it literally; "" stands for any.
    ending, steps = F.lower(F.regexp_extract("pattern", r"\.[^.*?\[\]{}/]+$", 0)), F.when(F.contains("pattern", F.lit("**")), 0).otherwise(F.size(F.split("pattern", "/")))
    parts = F.explode(F.sequence(F.lit(0), F.lit(FOLDER_PARTS - 1)))
    patterns = named.select("pattern").distinct().select("pattern", F.when(literal == "", ".").otherwise(F.regexp_replace(literal, "/$", "")).alias("folder"), ending.alias("ending"), steps.alias("steps"), glob_regex(F.col("pattern")).alias("regex")).withColumn("part", parts)

    own, depth = F.lower(F.regexp_extract("target", r"\.[^./]+$", 0)), F.size(F.split("target", "/"))
    kinds = F.explode(F.array_distinct(F.array(*(F.struct(e.alias("ending"), n.alias("steps")) for e in (own, F.lit("")) for n in (depth, F.lit(0))))))
    files = inventory.select(F.col("path").alias("target")).distinct().select("target", F.explode(ancestors(F.col("target"))).alias("folder"), F.pmod(F.xxhash64("target"), F.lit(FOLDER_PARTS)).cast("int").alias("part"))
    # Only folders that some pattern begins with.
    files = files.join(patterns.select("folder").distinct(), "folder", "left_semi").select("*", kinds.alias("k")).select("target", "folder", "part", "k.*")
    hits = patterns.join(files, ["folder", "part", "ending", "steps"]).where(F.expr("target rlike regex")).select("pattern", "target").distinct()
    return named.join(hits, "pattern").select(F.concat(F.lit("file:"), "path").alias("source"), F.concat(F.lit("file:"), "target").alias("target"), "relation", "evidence").distinct()

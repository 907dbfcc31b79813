"""References in texts: which file names which other file or module, and how.

Pattern extractors are rows of a table (endings, relation, evidence, mode, pattern) and run as one JVM expression over each text;
all patterns of a text's ending go through a single scan and a single explode. Python code is used only where a grammar is needed:
the Python AST, nested JSON, and constants joined into paths.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweft.functions import fixed, keys

REFS = "path string, spec string, relation string, evidence string, mode string"
#: Flags of every line pattern: ^ and $ at line feeds only, and classes of Unicode.
FLAGS = "(?mdU)"


def decoded(content: Column) -> Column:
    """Text of bytes: invalid parts replaced, a leading byte order mark dropped."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^﻿", "")


def _named(kind: dict[str, Column]):
    return lambda x: F.struct(F.trim(x).alias("spec"), kind["relation"].alias("relation"), kind["evidence"].alias("evidence"), kind["mode"].alias("mode"))


def pattern_references(files: DataFrame, table: list[tuple]) -> DataFrame:
    """References by patterns. files: path string, text string; null paths and texts have none."""
    ending = keys.suffix(F.col("path"))
    found = []
    for endings, relation, evidence, mode, pattern in table:
        kind = {"relation": F.lit(relation), "evidence": F.lit(evidence), "mode": F.lit(mode)}
        hits = F.transform(F.regexp_extract_all("text", F.lit(FLAGS + pattern), 1), _named(kind))
        found.append(F.when(F.col("ending").isin(endings), hits).otherwise(F.array().cast("array<struct<spec:string,relation:string,evidence:string,mode:string>>")))
    rows = files.where(F.col("path").isNotNull() & F.col("text").isNotNull()).select("path", "text", ending.alias("ending"))
    rows = rows.where(F.col("ending").isin(sorted({e for t in table for e in t[0]})))
    return rows.select("path", F.explode(F.concat(*found)).alias("r")).select("path", "r.*").where(F.col("spec") != "").distinct()


def static_references(files: DataFrame, more: list[tuple] = ()) -> DataFrame:
    """Imports and includes of the languages without a parser of their own; templated references are left out. more: further rows
    (endings, relation, evidence, mode, pattern with one group), for languages of a user's own."""
    refs = pattern_references(files, [*fixed.PATTERNS, *more])
    templated = F.contains("spec", F.lit("$")) | F.contains("spec", F.lit("{"))
    return refs.where(~(F.col("relation").isin("static-import", "module-source") & (templated | (F.length("spec") > 700))))


def web_references(files: DataFrame) -> DataFrame:
    """Imports, workers, assets and styles in scripts, pages and style sheets."""
    refs = pattern_references(files, fixed.WEB_PATTERNS)
    resource = keys.suffix(F.split_part("spec", F.lit("?"), F.lit(1))).isin(fixed.RESOURCE_SUFFIXES)
    return refs.where((F.col("mode") != "resource") | resource)


def normal_reference(spec: Column) -> Column:
    """A reference without query and fragment, unquoted; null if it has a scheme, a backslash or nothing left."""
    cut = F.trim(F.split_part(F.split_part(spec, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)))
    plain = F.when(F.contains(cut, F.lit("%")), F.coalesce(F.try_url_decode(F.replace(cut, F.lit("+"), F.lit("%2B"))), cut)).otherwise(cut)
    bad = (plain == "") | plain.rlike(r"^(//|https?:|data:|javascript:|mailto:|node:)") | F.contains(plain, F.lit("://")) | F.contains(plain, F.lit("\\")) | (F.length(spec) > 1200)
    return F.when(~bad, plain)


def semantic_references(files: DataFrame) -> DataFrame:
    """Assets named in attributes, style, front matter and data fields, and files read by name. Values with ${...} are patterns, mode
    glob, evidence inferred."""
    refs = pattern_references(files, fixed.SEMANTIC_PATTERNS)
    one = F.when(F.col("mode") == "srcset", F.transform(F.split("spec", ","), lambda x: F.split_part(F.trim(x), F.lit(" "), F.lit(1)))).otherwise(F.array("spec"))
    single = refs.select("path", F.explode(one).alias("spec"), "relation", "evidence", "mode").where(F.col("spec") != "")
    templated = F.contains("spec", F.lit("${"))
    value = normal_reference(F.col("spec"))
    asset = keys.suffix(value).isin(fixed.ASSET_SUFFIXES)
    kept = single.where(value.isNotNull() & (templated | F.col("mode").isin("semantic", "read") | asset))
    mode = F.when(templated, "glob").when(F.col("mode") == "read", "read").otherwise("semantic")
    guessed = templated | ((F.col("mode") == "read") & ~F.col("spec").rlike(r"^(\.|/|@|src/|public/)"))
    return kept.select("path", "spec", "relation", F.when(guessed, "inferred").otherwise(F.col("evidence")).alias("evidence"), mode.alias("mode")).distinct()


def python_streamed(files: DataFrame) -> DataFrame:
    """Imports of Python texts too large to parse, by pattern."""
    return pattern_references(files, [([".py", ".pyi"], "python-import", "heuristic", "python", p) for p in fixed.STREAM_PYTHON])


def package_json(files: DataFrame) -> DataFrame:
    """Packages of package.json: spec is name@version. Fields that are no maps have none."""
    rows = files.where((keys.base_name(F.col("path")) == "package.json") & F.col("text").isNotNull()).select("path", "text")
    out = None
    for field in fixed.PACKAGE_FIELDS:
        inner = F.from_json(F.get_json_object("text", f"$.{field}"), "map<string,string>")
        part = rows.select("path", F.explode(F.map_entries(inner)).alias("e")).select("path", F.concat_ws("@", "e.key", "e.value").alias("spec"))
        out = part if out is None else out.unionByName(part)
    return out.select("path", "spec", F.lit("package-manifest").alias("relation"), F.lit("declared").alias("evidence"), F.lit("npm").alias("mode")).distinct()


def manifest_lines(files: DataFrame) -> DataFrame:
    """Packages of requirements.txt, go.mod and Cargo.toml."""
    name = keys.base_name(F.col("path"))
    rows = files.where(F.col("text").isNotNull()).select("path", name.alias("name"), F.posexplode(F.split("text", r"\r?\n")).alias("n", "line"))
    line = F.trim("line")
    pip = rows.where((F.col("name") == "requirements.txt") & (line != "") & ~line.rlike(r"^[#.\-]")).select("path", F.trim(F.split_part(line, F.lit(";"), F.lit(1))).alias("spec"), F.lit("pip").alias("mode"))
    go = rows.where(F.col("name") == "go.mod").select("path", F.regexp_extract("line", r"^\s*([\w./-]+\.[\w./-]+)\s+v\d", 1).alias("spec"), F.lit("go").alias("mode")).where(F.col("spec") != "")
    from pyspark.sql import Window

    header = F.when(F.col("line").startswith("["), F.col("line"))
    above = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    cargo = rows.where(F.col("name") == "Cargo.toml").withColumn("section", F.last(header, ignorenulls=True).over(above))
    inside = keys.any_of(*(F.col("section").startswith(s) for s in fixed.CARGO_SECTIONS)) & ~F.col("line").startswith("[") & F.contains("line", F.lit("=")) & ~line.startswith("#")
    cargo = cargo.where(inside).select("path", F.trim(F.split_part("line", F.lit("="), F.lit(1))).alias("spec"), F.lit("cargo").alias("mode"))
    every = pip.unionByName(go).unionByName(cargo).where(F.col("spec") != "")
    return every.select("path", "spec", F.lit("package-manifest").alias("relation"), F.lit("declared").alias("evidence"), "mode").distinct()


# ---- with a grammar -------------------------------------------------------------------------------------------------


def python_specs(text: str) -> list[tuple[str, str, str, str]]:
    """(spec, relation, evidence, mode) of a Python source; raises SyntaxError or ValueError where it can't be parsed."""
    out: list[tuple[str, str, str, str]] = []
    for node in ast.walk(ast.parse(text)):
        match node:
            case ast.Import(names=names):
                out += [(a.name, "python-import", "declared", "python") for a in names]
            case ast.ImportFrom(module=module, names=names, level=level):
                base = "." * level + (module or "")
                if module:
                    out.append((base, "python-import", "declared", "python"))
                out += [(f"{base}.{a.name}" if module else base + a.name, "python-member", "heuristic", "python") for a in names if a.name != "*"]
            case ast.Call(func=ast.Name(id="open"), args=[ast.Constant(value=str(spec)), *_]):
                out.append((spec, "file-open", "declared", "path"))
            case ast.Call(func=ast.Name(id="__import__") | ast.Attribute(attr="import_module" | "__import__"), args=[ast.Constant(value=str(spec)), *_]):
                out.append((spec, "dynamic-import", "declared", "python"))
    return list(dict.fromkeys((s.strip(), *rest) for s, *rest in out if s.strip()))


def json_specs(text: str) -> list[str]:
    """Texts in a JSON document under a key that names an asset, to a depth of 60."""
    try:
        todo = [(json.loads(text), "", 0)]
    except ValueError:
        return []
    out = []
    while todo:
        value, key, level = todo.pop()
        if level > 60:
            continue
        if isinstance(value, dict):
            todo += [(v, str(k).lower().replace("_", "").replace("-", ""), level + 1) for k, v in value.items()]
        elif isinstance(value, list):
            todo += [(v, key, level + 1) for v in value]
        elif isinstance(value, str) and key in _JSON_KEYS:
            out.append(value)
    return list(dict.fromkeys(out))


_JSON_KEYS = set(fixed.JSON_KEYS)
_JOINED = re.compile(r"(?:\b(?:const|let|var)\s+([\w$]+)\s*=\s*)?\b(?:path|nodePath)\.join\s*\(([^)\r\n]{1,900})")
_QUOTED, _NAME = re.compile(r"""(['"`])(.*)\1""", re.S), re.compile(r"[\w.]+")


def joined_paths(text: str) -> list[str]:
    """Asset paths below src/ and public/ that a script joins from constants; an unknown part is a *.

    Each constant is worked out when a path needs it, after those that it is made of. A constant that is given several times has its last
    value, and one that is made of itself none.
    """
    calls = [(m[1], [a.strip() for a in m[2].split(",")]) for m in _JOINED.finditer(text)]
    made = {name: parts for name, parts in calls if name}
    values: dict[str, str | None] = {"root": "", "cwd": "", "process.cwd()": ""}

    def value(part: str, first: bool) -> str | None:
        if part in made and part not in values:
            values[part] = None
            values[part] = path(made[part])
        if values.get(part) is not None:
            return values[part]
        quoted = _QUOTED.fullmatch(part)
        return quoted[2] if quoted else "*" if not first and _NAME.fullmatch(part) else None

    def path(parts: list[str]) -> str | None:
        steps = [value(p, not i) for i, p in enumerate(parts)]
        return None if None in steps else "/".join(s.strip("/") for s in steps if s.strip("/"))

    found = (path(parts) for _, parts in calls)
    return list(dict.fromkeys(p for p in found if p and p.startswith(("src/", "public/")) and p[p.rfind(".") :].lower() in fixed.ASSET_SUFFIXES))


def parsed_references(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References that need a grammar (Python, JSON, joined paths), and path, error of the texts that can't be parsed."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"]):
                end = path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()
                if end in ("py", "pyi"):
                    try:
                        rows += [(path, *r, None) for r in python_specs(text)]
                    except (SyntaxError, ValueError) as e:
                        rows.append((path, None, None, None, None, f"Python can't be parsed: {e}"[:450]))
                elif end in ("json", "webmanifest"):
                    rows += [(path, s, "metadata-resource", "declared", "asset", None) for s in json_specs(text)]
                else:
                    rows += [(path, s, "computed-file-path", "inferred" if "*" in s else "declared", "glob" if "*" in s else "semantic", None) for s in joined_paths(text)]
            yield pd.DataFrame(rows, columns=["path", "spec", "relation", "evidence", "mode", "error"])

    wanted = [".py", ".pyi", ".json", ".webmanifest", *fixed.SCRIPTS]
    rows = files.where(F.col("text").isNotNull() & keys.suffix(F.col("path")).isin(wanted)).select("path", "text").mapInPandas(parse, REFS + ", error string")
    refs = rows.where(F.col("error").isNull()).drop("error").distinct()
    asset = F.col("mode") != "asset"
    named = normal_reference(F.col("spec"))
    refs = refs.where(asset | (named.isNotNull() & keys.suffix(named).isin(fixed.ASSET_SUFFIXES))).withColumn("mode", F.when(F.col("mode") == "asset", "semantic").otherwise(F.col("mode")))
    return refs, rows.where(F.col("error").isNotNull()).select("path", "error")


def template_imports(files: DataFrame) -> DataFrame:
    """Dynamic imports whose path holds ${...} or *: mode glob."""
    rows = files.where(F.col("text").isNotNull() & keys.suffix(F.col("path")).isin(fixed.SCRIPTS)).select("path", F.explode(F.regexp_extract_all("text", F.lit("(?sU)" + fixed.TEMPLATE_IMPORT), 2)).alias("spec"))
    kept = rows.where(F.contains("spec", F.lit("${")) | F.contains("spec", F.lit("*")))
    return kept.select("path", "spec", F.lit("dynamic-import-pattern").alias("relation"), F.lit("inferred").alias("evidence"), F.lit("glob").alias("mode")).distinct()


def literal_writes(files: DataFrame) -> DataFrame:
    """Files that a script writes under a literal relative path: relation generates."""
    writers = files.where(F.col("text").isNotNull() & keys.suffix(F.col("path")).isin(".js", ".ts", ".mjs", ".cjs", ".jsx", ".tsx", ".py") & F.col("text").rlike(fixed.OUTPUT_WRITES))
    rows = writers.select("path", F.explode(F.regexp_extract_all("text", F.lit(fixed.LITERAL_WRITE), 1)).alias("spec")).where(F.col("spec").rlike(r"^\.\.?/"))
    return rows.select("path", "spec", F.lit("generates").alias("relation"), F.lit("declared").alias("evidence"), F.lit("literal").alias("mode")).distinct()


#: Parts into which posts are spread for the scripts that make them.
POST_PARTS = 64


def generated_posts(files: DataFrame, inventory: DataFrame) -> DataFrame:
    """Edges of scripts that create posts below src/content/blog to what they make there: source, target, relation, evidence.

    A script counts if it writes files, names that folder part by part and post.json, and calls createPost; images count only if it names
    images/posts as well. Only files that exist are linked, so nothing is made up.
    """
    t = F.col("text")
    maker = t.rlike(fixed.OUTPUT_WRITES) & t.rlike(r"""['"]src['"]\s*,\s*['"]content['"]\s*,\s*['"]blog['"]""") & F.contains(t, F.lit("post.json")) & t.rlike(r"createPost\s*\(")
    images = t.rlike(r"""['"]images['"]\s*,\s*['"]posts['"]""")
    scripts = files.where(keys.suffix(F.col("path")).isin(".js", ".ts", ".mjs", ".cjs", ".jsx", ".tsx", ".py") & F.coalesce(maker, F.lit(False))).select("path", F.explode(F.when(images, F.array(F.lit("post"), F.lit("image"))).otherwise(F.array(F.lit("post")))).alias("kind"))
    p = F.col("target")
    post = p.rlike(r"^src/content/blog/[a-zA-Z0-9_-]{1,160}/(post\.json|index-(es|en)\.mdx)$") | p.rlike(r"^src/locales/(es|en)/posts/[a-zA-Z0-9_-]{1,160}\.json$")
    slug = F.coalesce(F.nullif(F.regexp_extract(p, r"^src/content/blog/([^/]+)/", 1), F.lit("")), F.nullif(F.regexp_extract(p, r"^src/locales/[^/]+/posts/(.+)\.json$", 1), F.lit("")), F.nullif(F.regexp_extract(p, r"^public/images/posts/([^/]+)/[^/]+$", 1), F.lit("")))
    made = inventory.select(F.col("path").alias("target")).distinct().select("target", F.when(post, "post").when(p.rlike(r"^public/images/posts/[^/]+/[^/]+$"), "image").alias("kind"), slug.alias("slug")).where("kind IS NOT NULL")
    known = inventory.select(F.regexp_extract("path", r"^src/content/blog/([a-zA-Z0-9_-]{1,160})/", 1).alias("slug")).where("slug <> ''").distinct()
    # Every maker is linked to every post, which is what the edges say; both sides are spread over parts of the posts.
    part = F.pmod(F.xxhash64("target"), F.lit(POST_PARTS)).cast("int")
    posts = made.join(known, "slug", "left_semi").withColumn("part", part)
    out = scripts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(POST_PARTS - 1)))).join(posts, ["kind", "part"])
    return out.select(F.concat(F.lit("file:"), "path").alias("source"), F.concat(F.lit("file:"), "target").alias("target"), F.lit("generates").alias("relation"), F.lit("inferred").alias("evidence")).distinct()


def paired_content(inventory: DataFrame) -> DataFrame:
    """source, target, relation, evidence of post and project records and the localised files beside them."""
    p = inventory.select("path", keys.parent(F.col("path")).alias("folder"), keys.base_name(F.col("path")).alias("name"))
    record = p.where(F.col("folder").rlike(r"(^|/)content/(blog|projects)/[^/]+$") & F.col("name").isin("post.json", "project.json"))
    twins = record.select("path", "folder").join(p.where(F.col("name").rlike(r"^index-.*\.mdx$")).select("folder", F.col("path").alias("twin")), "folder")
    content = twins.select("path", F.col("twin").alias("target"), F.lit("localized-content").alias("relation"))
    slug = F.substring_index("folder", "/", -1)
    blog = record.where(F.col("folder").rlike(r"(^|/)content/blog/[^/]+$")).select("path", F.concat(slug, F.lit(".json")).alias("name"))
    locale = p.where(F.col("folder").rlike(r"^src/locales/[^/]+/posts$")).select("name", F.col("path").alias("target"))
    metadata = blog.join(locale, "name").select("path", "target", F.lit("localized-metadata").alias("relation"))
    both = content.unionByName(metadata)
    return both.select(F.concat(F.lit("file:"), "path").alias("source"), F.concat(F.lit("file:"), "target").alias("target"), "relation", F.lit("inferred").alias("evidence")).distinct()

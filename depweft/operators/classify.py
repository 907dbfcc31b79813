"""Language and category of files: magic bytes, then name, then interpreter line, then the longest known ending."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depweft.functions import fixed, keys

CATALOGUE = "ending string, language string, category string, analyzer string, ordinal int"


def built_in(spark: SparkSession) -> DataFrame:
    rows = [(e, language, category, analyzer, i) for i, (language, category, analyzer, ends) in enumerate(fixed.ANALYZED) for e in ends.split()]
    return spark.createDataFrame(rows, CATALOGUE)


_BLOCK = re.compile(r"^(?P<name>[^\s#-][^\n]*):[ ]*\n(?P<body>(?:(?:[ ][^\n]*)?(?:\n|\Z))*)", re.M)
_TYPE = re.compile(r"^  type:[ ]*['\"]?(\w+)", re.M)
_ENDINGS = re.compile(r"^  extensions:[ ]*\n((?:  - [^\n]*\n?)*)", re.M)
_ENDING = re.compile(r"""- ['"]?(\.[A-Za-z0-9_+.-]{1,35})['"]?[ ]*$""", re.M)


def linguist_rows(text: str, least: int = 120) -> list[tuple[str, str, str, str]]:
    """(ending, language, category, analyzer) of a language list in YAML: blocks of top-level names, each indented by two, with type
    and extensions. Only these plain fields are read; a list with too few endings is refused."""
    rows = []
    for block in _BLOCK.finditer(text):
        kind, listed = _TYPE.search(block["body"]), _ENDINGS.search(block["body"])
        if kind and listed and kind[1] in ("programming", "markup", "data", "prose"):
            rows += [(e.lower(), block["name"].strip("'\""), kind[1], "inventory") for e in _ENDING.findall(listed[1])]
    if len({r[0] for r in rows}) < least:
        raise ValueError("too few endings for a language list")
    return rows


def merged_catalogue(first: DataFrame, more: DataFrame) -> DataFrame:
    """Rows of first, and those of more whose ending has not that language yet; order of first before that of more."""
    top = first.agg(F.coalesce(F.max("ordinal"), F.lit(-1)).alias("m")).first()["m"] + 1
    extra = more.join(first.select("ending", "language"), ["ending", "language"], "left_anti").withColumn("ordinal", F.col("ordinal") + F.lit(top))
    return first.unionByName(extra).groupBy("ending", "language").agg(F.min(F.struct("ordinal", "category", "analyzer")).alias("r")).select("ending", "language", "r.category", "r.analyzer", "r.ordinal")


def learned_catalogue(file_types: DataFrame) -> DataFrame:
    """Catalogue of the endings that typed files show: per ending and language its most frequent category and analyzer."""
    ending = F.regexp_extract("evidence", r"^extension:(\..+)$", 1)
    rows = file_types.select(ending.alias("ending"), "language", F.lower(F.trim("category")).alias("category"), "analyzer").where((F.col("ending") != "") & F.col("language").isNotNull() & F.col("analyzer").isNotNull())
    counts = rows.groupBy("ending", "language", "category", "analyzer").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("ending", "language").agg(F.max(F.struct("n", "category", "analyzer")).alias("r"))
    return best.select("ending", "language", "r.category", "r.analyzer", F.lit(0).alias("ordinal"))


def ending_rows(catalogue: DataFrame) -> DataFrame:
    """Per ending the chosen language (one with an analyzer first, then in order) and all candidates."""
    order = F.struct((F.col("analyzer") == "inventory").alias("i"), "ordinal", "language", "category", "analyzer")
    per = catalogue.groupBy("ending").agg(F.min(order).alias("r"), F.array_sort(F.collect_set("language")).alias("candidates"))
    return per.select("ending", "r.language", "r.category", "r.analyzer", "candidates")


def _first_match(rows: list[tuple[Column, tuple[str, str, str]]], evidence: str) -> Column:
    out = F.lit(None).cast("struct<language:string,category:string,analyzer:string,evidence:string>")
    for test, (language, category, analyzer) in reversed(rows):
        out = F.when(test, F.struct(F.lit(language).alias("language"), F.lit(category).alias("category"), F.lit(analyzer).alias("analyzer"), F.lit(evidence).alias("evidence"))).otherwise(out)
    return out


def classify(files: DataFrame, catalogue: DataFrame) -> DataFrame:
    """path, language, category, analyzer, evidence, candidates, ambiguous.

    files: path string, header binary (first bytes; null where unknown). The catalogue grows with languages, not with files; every
    file's possible endings meet it in one join, the longest wins.
    """
    name = keys.base_name(F.col("path"))
    first = F.lower(F.split_part(F.make_valid_utf8(F.substring("header", 1, 256).cast("string")), F.lit("\n"), F.lit(1)))
    magic = _first_match([(F.startswith("header", F.lit(bytearray(h))), (a, b, c)) for h, a, b, c in fixed.MAGIC], "magic")
    named = _first_match([(name == n, (a, b, c)) for n, a, b, c in fixed.FILE_NAMES], "filename")
    run = _first_match([(first.startswith("#!") & first.rlike(rf"(?:/|\s){i}(?:[0-9.\s]|$)"), (a, "programming", b)) for i, a, b in fixed.INTERPRETERS], "shebang")
    base = files.where(F.col("path").isNotNull()).select("path", "header", F.coalesce(magic, named, run).alias("known"), F.lower(name).alias("name"))
    dots = F.filter(F.sequence(F.lit(1), F.greatest(F.length("name"), F.lit(1))), lambda i: F.substring(F.col("name"), i, F.lit(1)) == ".")
    tails = base.where(F.col("known").isNull()).select("path", F.explode(F.transform(dots, lambda i: F.substring(F.col("name"), i, F.length("name")))).alias("ending")).distinct()
    best = tails.join(ending_rows(catalogue), "ending").groupBy("path").agg(F.max_by(F.struct("ending", "language", "category", "analyzer", "candidates"), F.length("ending")).alias("e"))
    joined = base.join(best, "path", "left")
    zero = F.contains("header", F.lit(bytearray(1)))
    rest = F.when(F.coalesce(zero, F.lit(False)), F.struct(F.lit("Unknown binary").alias("language"), F.lit("binary").alias("category"), F.lit("inventory").alias("analyzer"), F.lit("content").alias("evidence"))).otherwise(
        F.struct(F.lit("Unknown").alias("language"), F.lit("unknown").alias("category"), F.lit("inventory").alias("analyzer"), F.lit("unrecognized").alias("evidence"))
    )
    by_end = F.when(F.col("e").isNotNull(), F.struct(F.col("e.language").alias("language"), F.col("e.category").alias("category"), F.col("e.analyzer").alias("analyzer"), F.concat(F.lit("extension:"), "e.ending").alias("evidence")))
    chosen = F.coalesce("known", by_end, rest)
    none = F.array().cast("array<string>")
    candidates = F.when(F.col("known").isNotNull(), F.array("known.language")).when(F.col("e").isNotNull(), F.col("e.candidates")).otherwise(none)
    return joined.select("path", chosen.alias("c"), candidates.alias("candidates")).select("path", "c.*", "candidates", (F.size("candidates") > 1).alias("ambiguous"))

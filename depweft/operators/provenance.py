"""Records of a code host's JSON answers, bounded as they are stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_COMMITS, MOST_FILES, MOST_PATCH, MOST_RANGES = 30, 40, 12_000, 120
SHA = "^[a-fA-F0-9]{40,64}$"
COMPARISON = (
    "total_commits bigint, ahead_by bigint, behind_by bigint, status string, commits array<struct<sha:string,commit:struct<message:string,author:struct<name:string,date:string>>,author:struct<login:string>>>, "
    "files array<struct<filename:string,status:string,additions:bigint,deletions:bigint,patch:string>>"
)
BLAME = "data struct<repository:struct<object:struct<isBinary:boolean,blame:struct<ranges:array<struct<startingLine:int,endingLine:int,commit:struct<oid:string,messageHeadline:string,author:struct<name:string,date:string,user:struct<login:string>>>>>>>>>"


def _text(value: Column, most: int) -> Column:
    return F.left(F.coalesce(value, F.lit("")), F.lit(most))


def compared_commits(answers: DataFrame) -> DataFrame:
    """Commits of comparisons (repository, body): the first 30 with a valid id."""
    c = F.posexplode(F.slice(F.from_json("body", COMPARISON)["commits"], 1, MOST_COMMITS)).alias("n", "c")
    rows = answers.select("repository", c).where(F.col("c.sha").rlike(SHA))
    return rows.select("repository", "n", "c.sha", _text(F.col("c.commit.message"), 350).alias("message"), _text(F.col("c.commit.author.name"), 120).alias("author"), F.col("c.author.login").alias("login"), F.col("c.commit.author.date").alias("date"))


def compared_files(answers: DataFrame) -> DataFrame:
    """Files of comparisons: the first 40, patches cut at 12000 characters."""
    f = F.posexplode(F.slice(F.from_json("body", COMPARISON)["files"], 1, MOST_FILES)).alias("n", "f")
    rows = answers.select("repository", f).where(F.length("f.filename") <= 400)
    zero = F.lit(0).cast("bigint")
    return rows.select("repository", "n", F.col("f.filename").alias("path"), _text(F.col("f.status"), 30).alias("status"), F.coalesce("f.additions", zero).alias("additions"), F.coalesce("f.deletions", zero).alias("deletions"), _text(F.col("f.patch"), MOST_PATCH).alias("patch"), F.col("f.patch").isNotNull().alias("has_patch"))


def comparison_totals(answers: DataFrame) -> DataFrame:
    """Counts of comparisons, and whether lists were cut."""
    p = F.from_json("body", COMPARISON)
    cut = (F.coalesce(F.size(p["files"]), F.lit(0)) > MOST_FILES) | (F.coalesce(F.size(p["commits"]), F.lit(0)) > MOST_COMMITS)
    return answers.select("repository", F.coalesce(p["total_commits"], F.lit(0)).alias("total_commits"), F.coalesce(p["ahead_by"], F.lit(0)).alias("ahead_by"), F.coalesce(p["behind_by"], F.lit(0)).alias("behind_by"), p["status"].alias("status"), cut.alias("truncated"))


def blamed_ranges(answers: DataFrame, start: int = 1, end: int = 80) -> DataFrame:
    """Line ranges of blame answers (repository, path, body) that meet the wanted lines, cut to them: at most 120 per answer."""
    if not 1 <= start <= end < start + 120:
        raise ValueError("1 to 120 lines")
    ranges = F.from_json("body", BLAME)["data"]["repository"]["object"]["blame"]["ranges"]
    wanted = F.filter(ranges, lambda r: (r["startingLine"] <= end) & (r["endingLine"] >= start) & (r["endingLine"] >= r["startingLine"]) & r["commit"]["oid"].rlike(SHA))
    rows = answers.select("repository", "path", F.explode(F.slice(wanted, 1, MOST_RANGES)).alias("r"))
    return rows.select("repository", "path", F.greatest("r.startingLine", F.lit(start)).alias("start"), F.least("r.endingLine", F.lit(end)).alias("end"), F.col("r.commit.oid").alias("sha"), _text(F.col("r.commit.author.name"), 120).alias("author"), _text(F.col("r.commit.messageHeadline"), 200).alias("message"))

"""Records of Git's own text formats, and the files a checkout tracks."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depweft.functions import fixed

LOG_FORMAT = "%H%x1f%an%x1f%ae%x1f%aI%x1f%cn%x1f%cI%x1f%s"


def tracked_files(spark: SparkSession, checkout: str) -> DataFrame:
    """path of the files that a local checkout tracks, without odd names and build folders."""
    raw = subprocess.run(["git", "-C", checkout, "ls-files", "-z"], capture_output=True, check=True, timeout=60).stdout.decode("utf-8", "replace")
    rows = spark.createDataFrame([(n,) for n in raw.split("\0") if n], "path string")
    odd = (F.length("path") > 800) | F.contains("path", F.lit("\\")) | F.exists(F.split("path", "/"), lambda s: s.isin("", ".", ".."))
    return rows.where(~odd & ~F.col("path").rlike(r"^(\.git|node_modules|dist|build)/"))


def log_records(lines: DataFrame) -> DataFrame:
    """Commits of log lines in LOG_FORMAT (columns path, line); malformed lines are left out."""
    p = F.split("line", "\u001f", 7)
    rows = lines.where((F.size(p) == 7) & F.get(p, F.lit(0)).rlike("^[0-9a-f]{40,64}$"))
    cut = {"sha": (0, 64), "author": (1, 120), "author_email": (2, 160), "authored_at": (3, 40), "committer": (4, 120), "committed_at": (5, 40), "message": (6, 250)}
    return rows.select("path", *(F.left(F.get(p, F.lit(i)), F.lit(n)).alias(c) for c, (i, n) in cut.items()))


def blame_lines(porcelain: DataFrame) -> DataFrame:
    """Lines of `git blame --line-porcelain`: path, line, text, sha, author, date_unix, message, uncommitted.

    porcelain: path, n (order), line. A header's fields hold for the text line after it; they are carried down by a window per path,
    which is one file's output.
    """
    header = r"^([0-9a-f]{40,64})\s+\d+\s+(\d+)(?:\s+\d+)?$"
    above = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy("path", "g").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)

    def field(prefix: str) -> Column:
        return F.last(F.when(F.col("line").startswith(prefix), F.substring(F.col("line"), F.lit(len(prefix) + 1), F.length("line"))), ignorenulls=True).over(group)

    rows = porcelain.withColumn("g", F.count(F.when(F.col("line").rlike(header), 1)).over(above)).where("g > 0")
    rows = rows.select("path", "n", "line", F.first("line").over(group).alias("head"), field("author ").alias("author"), field("author-time ").alias("time"), field("summary ").alias("summary"))
    sha = F.regexp_extract("head", header, 1)
    open_ = sha.rlike("^0+$") | F.coalesce(F.col("author").isin("Not Committed Yet", "Not Committed"), F.lit(False))
    return rows.where(F.col("line").startswith("\t")).select(
        "path", F.regexp_extract("head", header, 2).cast("int").alias("line"), F.left(F.substring(F.col("line"), F.lit(2), F.length("line")), F.lit(500)).alias("text"), F.when(~open_, sha).alias("sha"),
        F.when(~open_, F.left("author", F.lit(120))).alias("author"), F.try_to_number("time", F.lit("9999999999")).cast("bigint").alias("date_unix"), F.left("summary", F.lit(160)).alias("message"), open_.alias("uncommitted"),
    )


def remote_page(url: Column) -> Column:
    """https page of a GitHub remote in SSH or HTTPS form; null for others."""
    tail = F.coalesce(F.nullif(F.regexp_extract(url, r"^(?:git@github\.com:|ssh://git@github\.com/|https://github\.com/)(.*)$", 1), F.lit("")), F.lit(""))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(tail, "^/+", ""), r"\.git$", ""), "/+$", "")
    return F.when(clean.rlike(fixed.REPOSITORY), F.concat(F.lit("https://github.com/"), clean))


def valid_repository(name: Column) -> Column:
    return name.rlike(fixed.REPOSITORY) & ~F.exists(F.split(name, "/"), lambda p: p == "..")


def valid_revision(ref: Column) -> Column:
    return ref.rlike(fixed.REVISION) & ~ref.rlike(r"^[/.-]") & ~F.contains(ref, F.lit("//")) & ~F.exists(F.split(ref, "/"), lambda p: p == "..")


def valid_path(path: Column) -> Column:
    return F.length(path).between(1, 400) & ~path.rlike(r"^/|\\|[\x00-\x1f]") & ~F.exists(F.split(path, "/"), lambda p: p.isin("", ".", ".."))


def clipped_ranges(ranges: DataFrame, wanted: DataFrame, on: str) -> DataFrame:
    """Line ranges (on, start, end, ...) that meet the wanted ones (on, want_start, want_end), cut to them. An equi-join on the file,
    then the overlap test."""
    hit = ranges.join(wanted, on).where((F.col("start") <= F.col("want_end")) & (F.col("end") >= F.col("want_start")))
    return hit.withColumn("start", F.greatest("start", "want_start")).withColumn("end", F.least("end", "want_end")).drop("want_start", "want_end")


def same_deployment(observed: Column, environment: Column) -> Column:
    """Whether a page lies below a deployment's address: both https on the standard port, same host, path on a step's border."""
    form = r"^https://([^/:?#@]+)(?::443)?(/[^?#]*)?(?:[?#].*)?$"
    host = [F.regexp_replace(F.lower(F.regexp_extract(u, form, 1)), r"\.$", "") for u in (observed, environment)]
    path, base = F.regexp_extract(observed, form, 2), F.regexp_replace(F.regexp_extract(environment, form, 2), "/+$", "")
    return observed.rlike(form) & environment.rlike(form) & (host[0] == host[1]) & ((base == "") | (path == base) | F.startswith(path, F.concat(base, F.lit("/"))))


def deployments_of(pages: DataFrame, deployments: DataFrame, most: int = 3) -> DataFrame:
    """Successful deployments that a page belongs to, the most recent first, at most so many per page.

    pages: url. deployments: deployment_id, sha, environment_url, state, created_at. Joined on the host, then by path.
    """
    host = r"^https://([^/:?#@]+)"
    a = pages.select("url", F.lower(F.regexp_extract("url", host, 1)).alias("host")).where(F.col("host") != "")
    b = deployments.where((F.col("state") == "success") & F.col("sha").rlike("^[a-fA-F0-9]{40,64}$")).withColumn("host", F.lower(F.regexp_extract("environment_url", host, 1)))
    hit = a.join(b, "host").where(same_deployment(F.col("url"), F.col("environment_url")))
    newest = Window.partitionBy("url").orderBy(F.desc("created_at"), F.desc("deployment_id"))
    # The limit on the rank is pushed below the shuffle, so that a page with very many deployments is cut before it.
    return hit.select("url", "created_at", "deployment_id", "sha", "environment_url").distinct().withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= most)

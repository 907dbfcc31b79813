"""The change monitor as a stream: what is known of each target is a small table that every micro-batch carries on.

The input is a stream of checks as in operators.monitor.check_states. A micro-batch is handled as a set: the state of its targets comes in
as one more check each, and the ordered scan in blocks finds what went before each check, so that a target with most of
the checks is spread over tasks and held by none. Events and states are written to folders named by the number of the micro-batch;
a micro-batch that is repeated after a failure overwrites its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweft.operators.monitor import check_states, due, logged_events
from depweft.session import cut

STATE = "target bigint, seq bigint, kind string, algorithm string, sha string, semantic string, failed boolean, not_modified boolean"
#: Targets that are checked at most when the clock ticks, and how often it does: fixed values.
DUE_AT_ONCE, TICK = 3, "10 seconds"


def _known(x) -> bool:
    return x is not None and x == x


def next_state(kind: str, base: tuple | None, sha, semantic, failed: bool, not_modified: bool) -> str:
    """State of a single check, given the fingerprints (sha, semantic) of the last good one: the rule that check_states follows for
    whole tables, which the tests hold it against."""
    if failed or (not_modified and base is None):
        return "error"
    if not_modified:
        return "unchanged"
    if not _known(sha):
        return "error"
    if base is None:
        return "baseline"
    if sha.lower() == base[0].lower():
        return "unchanged"
    if kind == "local":
        return "files"
    a, b = (x.lower() if _known(x) else None for x in (semantic, base[1]))
    return "technical" if a == b else "content"


def carried(checks: DataFrame) -> DataFrame:
    """What is known of each target after its checks, as a check itself: the last seq and algorithm, and the fingerprints of the last
    good check since the algorithm changed last; failed if there is none."""
    good = ~F.coalesce("failed", F.lit(False)) & ~F.coalesce("not_modified", F.lit(False)) & F.col("sha").isNotNull()
    last = checks.groupBy("target").agg(F.max("seq").alias("seq"), F.max_by("algorithm", "seq").alias("algorithm"), F.max_by("kind", "seq").alias("kind"))
    # The last check under another algorithm than the last one: what is older than that counts no more.
    rows = checks.join(last.select("target", F.col("algorithm").alias("__now")), "target")
    before = rows.where(~F.col("algorithm").eqNullSafe(F.col("__now"))).groupBy("target").agg(F.max("seq").alias("__other"))
    since = rows.join(before, "target", "left").where(good & (F.col("__other").isNull() | (F.col("seq") > F.col("__other"))))
    base = since.groupBy("target").agg(F.max_by(F.struct("sha", "semantic"), "seq").alias("b"))
    return last.join(base, "target", "left").select("target", "seq", "kind", "algorithm", F.col("b.sha").alias("sha"), F.col("b.semantic").alias("semantic"), F.col("b").isNull().alias("failed"), F.lit(False).alias("not_modified"))


def handle(checks: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events (target, seq, state, algorithm) of new checks, and what is known afterwards. Checks at or below the seq that is known of
    their target are late repeats and are left out; of checks with equal target and seq the greatest counts."""
    fields = [c for c in known.columns if c not in ("target", "seq")]
    new = checks.select(*known.columns).join(known.select("target", F.col("seq").alias("__seq")), "target", "left").where(F.col("__seq").isNull() | (F.col("seq") > F.col("__seq"))).drop("__seq")
    new = new.groupBy("target", "seq").agg(F.max(F.struct(*fields)).alias("c")).select("target", "seq", *(f"c.{f}" for f in fields)).select(*known.columns)
    every = cut(new.unionByName(known.join(new.select("target").distinct(), "target", "left_semi")))
    events = logged_events(check_states(every)).join(known.select("target", "seq"), ["target", "seq"], "left_anti").select("target", "seq", "state", "algorithm")
    untouched = known.join(new.select("target").distinct(), "target", "left_anti")
    return events, carried(every).select(*known.columns).unionByName(untouched)


def run_available(checks: DataFrame, path: str, checkpoint: str, poll: str | None = None):
    """Starts the stream; events go to Parquet files below path. All that is available, or every so often if poll is given (say
    '10 seconds')."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        known = spark.read.schema(STATE).parquet(f"{checkpoint}/known/{number - 1}") if number else spark.createDataFrame([], STATE)
        events, after = handle(df, known)
        events.write.mode("overwrite").parquet(f"{path}/batch={number}")
        after.write.mode("overwrite").parquet(f"{checkpoint}/known/{number}")

    writer = checks.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/stream")
    return writer.trigger(processingTime=poll).start() if poll else writer.trigger(availableNow=True).start()


def poll_due(spark: SparkSession, targets: Callable[[], DataFrame], check: Callable[[DataFrame], None], checkpoint: str, tick: str = TICK, most: int = DUE_AT_ONCE):
    """Starts a clock: at every tick, check is given the ids of the targets that are due, the earliest first, at most so many.

    targets: gives the present targets (id, next_us). A check that fails ends the query, which can be started again.
    """
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def at_tick(_: DataFrame, __: int) -> None:
        check(due(targets(), F.unix_micros(F.current_timestamp()), most).select("id"))

    return ticks.writeStream.foreachBatch(at_tick).option("checkpointLocation", checkpoint).trigger(processingTime=tick).start()

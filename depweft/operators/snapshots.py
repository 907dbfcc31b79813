"""Differences between consecutive full snapshots.

Only two 64-bit numbers per record, the hashes of its key and of its content, are shuffled, into buckets of bounded size by
key hash. Within a bucket numpy sorts each snapshot's keys and finds set differences with searchsorted. Full values are
fetched in a second pass for the differing keys only, and compared exactly there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweft.functions.text import posix_path
from depweft.session import cut

#: Entries per bucket; 24 bytes each, so that a bucket takes a few MB wherever it is processed.
BUCKET_ENTRIES = 250_000
#: Differing keys up to which they are broadcast to the second pass (one long and one int each); beyond, both sides are shuffled.
BROADCAST_KEYS = 1_000_000


def deliveries(df: DataFrame, snap: str = "snap_no", delivered: str = "delivered_at") -> DataFrame:
    """One row per snapshot with its latest delivery: snap, delivered as text, ord (from 0, by snap). As text, an instant means the same in
    every time zone. A table of snapshots, small whatever the number of records."""
    latest = df.where(F.col(snap).isNotNull()).groupBy(snap).agg(F.max(delivered).cast("string").alias("__at"))
    # Snapshots are few: years of hourly ones are some ten thousand rows, which one task numbers.
    return latest.withColumn("ord", F.row_number().over(Window.orderBy(snap)) - 1)


def snapshot_order(df: DataFrame, snap: str, delivered: str) -> list[tuple]:
    """(snapshot, latest delivery as text) in order: one row per snapshot, whatever the table's size."""
    return [(r[snap], r["__at"]) for r in deliveries(df, snap, delivered).orderBy("ord").collect()]


def of_delivery(delivery: tuple, snap: Column, delivered: Column) -> Column:
    """Whether a row belongs to a delivery of snapshot_order."""
    return (snap == F.lit(delivery[0])) & delivered.cast("string").eqNullSafe(F.lit(delivery[1]))


def latest_deliveries(df: DataFrame, order: list[tuple] | None = None, snap: str = "snap_no", delivered: str = "delivered_at") -> DataFrame:
    """Rows of the latest delivery of each snapshot, or of the deliveries given. The deliveries are a small table that is broadcast, so
    that the plan is the same for any number of snapshots."""
    if order is None:
        small = deliveries(df, snap, delivered).select(F.col(snap).alias("__snap"), "__at")
    else:
        kind = df.schema[snap].dataType.simpleString()
        small = df.sparkSession.createDataFrame([tuple(o) for o in order], f"__snap {kind}, __at string")
    return df.join(F.broadcast(small), (F.col(snap) == F.col("__snap")) & F.col(delivered).cast("string").eqNullSafe(F.col("__at")), "left_semi")


def _runs(keys: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, their hash, and whether a key has several hashes."""
    order = np.lexsort((hashes, keys))
    k, h = keys[order], hashes[order]
    if not len(k):
        return k, h, np.zeros(0, bool)
    new_pair = np.r_[True, (k[1:] != k[:-1]) | (h[1:] != h[:-1])]
    k, h = k[new_pair], h[new_pair]
    first = np.r_[True, k[1:] != k[:-1]]
    starts = np.flatnonzero(first)
    several = np.diff(np.r_[starts, len(k)]) > 1
    return k[first], h[first], several


def differing_keys(a: tuple, b: tuple) -> np.ndarray:
    """Keys in only one of two runs, with different hashes, or with several hashes in either."""
    (ak, ah, am), (bk, bh, bm) = a, b
    at = np.searchsorted(ak, bk)
    inside = at < len(ak)
    same_key = np.zeros(len(bk), bool)
    same_key[inside] = ak[at[inside]] == bk[inside]
    differs = ~same_key
    both = np.flatnonzero(same_key)
    differs[both] = (ah[at[both]] != bh[both]) | am[at[both]] | bm[both]
    gone = np.ones(len(ak), bool)
    gone[at[both]] = False
    return np.concatenate([bk[differs], ak[gone]])


def changed_keys(entries: DataFrame, snapshots: int, n_entries: int) -> DataFrame:
    """(pair int, k bigint): keys that differ between snapshot pair-1 and pair.

    entries: ord int (0 up to snapshots-1), k bigint (hash of the key), h bigint (hash of the content). A key given several
    times in a snapshot counts once if its contents are equal, else as differing.
    """
    buckets = max(1, -(-n_entries // BUCKET_ENTRIES))

    def diff(batch: pa.Table) -> pa.Table:
        order, k, h = (batch.column(c).to_numpy() for c in ("ord", "k", "h"))
        by = np.argsort(order, kind="stable")
        cuts = np.searchsorted(order[by], np.arange(snapshots + 1))
        runs = [_runs(k[by[cuts[i] : cuts[i + 1]]], h[by[cuts[i] : cuts[i + 1]]]) for i in range(snapshots)]
        found = [differing_keys(runs[i - 1], runs[i]) for i in range(1, snapshots)]
        pairs = np.repeat(np.arange(1, snapshots, dtype=np.int32), [len(f) for f in found])
        keys = np.concatenate(found) if found else np.zeros(0, np.int64)
        return pa.table({"pair": pa.array(pairs, pa.int32()), "k": pa.array(keys, pa.int64())})

    bucketed = entries.select("ord", "k", "h", F.pmod(F.shiftright("k", 7), F.lit(buckets)).cast("int").alias("bucket"))
    return bucketed.groupBy("bucket").applyInArrow(lambda t: diff(t.select(["ord", "k", "h"])), "pair int, k bigint")


def monitor_entries(valid: DataFrame) -> DataFrame:
    """One entry per target (path '') and per path of its manifest: ord, id, path, value."""
    head = F.concat_ws("\x1f", "kind", "algorithm", *(F.coalesce(F.lower(c), F.lit("\x1e")) for c in ("last_sha", "last_semantic")))
    heads = F.array(F.struct(F.lit("").alias("key"), head.alias("value")))
    files = F.filter(F.coalesce(F.map_entries("last_manifest"), F.array().cast("array<struct<key:string,value:string>>")), lambda e: ~e["key"].rlike(r"^[./\\]*$"))
    entry = F.explode(F.concat(heads, files)).alias("e")
    return valid.select("ord", "id", entry).select("ord", "id", posix_path(F.col("e.key")).alias("path"), F.coalesce(F.lower("e.value"), F.lit("")).alias("value"))


def target_changes(targets: DataFrame) -> DataFrame:
    """Changes of monitored targets: snap_no, target_id, file_path, change_kind.

    Snapshots follow each other by snap_no; only the latest delivery of each counts. Fewer than two snapshots give no rows.
    Rows without snap_no, delivery or id are no part of a snapshot. A target given twice in one delivery counts once; if
    its copies disagree, its manifest is the union and the greatest value holds. Paths are compared in posix form, markers
    and digests without letter case; a manifest that is null is empty.

    The table is scanned once for the hashes and once for the full values of differing keys; kind, algorithm and fingerprints travel
    with the targets that differ, not with all.
    """
    spark = targets.sparkSession
    order = cut(deliveries(targets))
    n_snaps = order.count()
    if n_snaps < 2:
        return spark.createDataFrame([], "snap_no int, target_id bigint, file_path string, change_kind string")
    used = ("id", "snap_no", "kind", "algorithm", "last_sha", "last_semantic", "last_manifest")
    valid = targets.where(F.col("id").isNotNull()).select(*used, F.col("delivered_at").cast("string").alias("__d"))
    valid = valid.join(F.broadcast(order.select("snap_no", F.col("__at").alias("__d"), "ord")), ["snap_no", "__d"])
    entries = monitor_entries(valid)
    key = F.xxhash64("id", "path")
    # Compact rows are written once: their number gives the buckets, and the buckets read them again.
    compact = cut(entries.select("ord", key.alias("k"), F.xxhash64("value").alias("h")))
    changed = cut(changed_keys(compact, n_snaps, compact.count()))

    n_changed = changed.count()
    wanted = F.broadcast(changed) if n_changed <= BROADCAST_KEYS else changed
    own = entries.withColumn("k", key)
    # An entry of a snapshot is the later side of the pair it ends and the earlier side of the pair it begins.
    met = own.join(wanted, "k").where((F.col("ord") == F.col("pair")) | (F.col("ord") == F.col("pair") - 1)).withColumn("later", F.col("ord") == F.col("pair"))
    old, new = F.when(~F.col("later"), F.col("value")), F.when(F.col("later"), F.col("value"))
    diffs = cut(met.groupBy("pair", "id", "path").agg(F.max(old).alias("old"), F.max(new).alias("new")).where(~F.col("old").eqNullSafe(F.col("new"))))

    # Heads only of the targets that differ, and only for the pairs they differ in.
    asked = diffs.select("pair", "id").distinct()
    sides = asked.select("id", "pair", F.explode(F.array(F.col("pair") - 1, F.col("pair"))).alias("ord"))
    n_asked = asked.count()
    sides = F.broadcast(sides) if n_asked <= BROADCAST_KEYS // 2 else sides
    state = F.struct("kind", "algorithm", F.lower("last_sha").alias("sha"), F.lower("last_semantic").alias("semantic"))
    heads = valid.select("ord", "id", state.alias("state")).join(sides, ["id", "ord"]).groupBy("pair", "id")
    heads = heads.agg(F.max(F.when(F.col("ord") < F.col("pair"), F.col("state"))).alias("a"), F.max(F.when(F.col("ord") == F.col("pair"), F.col("state"))).alias("b"))

    a, b = F.col("a"), F.col("b")
    same_sha = a["sha"].eqNullSafe(b["sha"])
    of_target = (
        F.when(a.isNull(), "target added").when(b.isNull(), "target removed").when(~a["algorithm"].eqNullSafe(b["algorithm"]), "algorithm")
        .when(a["sha"].isNull() & b["sha"].isNotNull(), "baseline")
        .when((b["kind"] == "web") & ~same_sha, F.when(a["semantic"].eqNullSafe(b["semantic"]), "technical").otherwise("content"))
    )
    compared = (b["kind"] == "local") & a["algorithm"].eqNullSafe(b["algorithm"]) & a["sha"].isNotNull()
    of_file = F.when(compared, F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("modified"))
    kind = F.when(F.col("path") == "", of_target).otherwise(of_file)
    numbers = F.broadcast(order.select(F.col("ord").alias("pair"), F.col("snap_no").cast("int").alias("number")))
    return (
        diffs.join(heads, ["pair", "id"])
        .join(numbers, "pair")
        .select(F.col("number").alias("snap_no"), F.col("id").cast("bigint").alias("target_id"), F.col("path").alias("file_path"), kind.alias("change_kind"))
        .where(F.col("change_kind").isNotNull())
    )

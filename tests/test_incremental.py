from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from depweft.operators import refcheck
from depweft.operators.incremental import VersionedTarget, refresh_once, run_once

SCHEMA = "key string, version string, made int, gone boolean"


def make(df):
    return df.withColumn("made", F.lit(1))


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "key string, version string")


def test_versions_that_come_back_and_keys_that_leave(spark, tmp_path):
    target = VersionedTarget(spark, f"file://{tmp_path}/t", SCHEMA)
    made = []

    def process(df):
        made.append(sorted((r["key"], r["version"]) for r in df.collect()))
        return make(df)

    def state(*pairs):
        return {(r["key"], r["version"]) for r in refresh_once(rows(spark, *pairs), target, "key", "version", process)[1].collect()}

    assert state(("a", "A"), ("b", "1"), ("n", None), (None, "x")) == {("a", "A"), ("b", "1"), ("n", None)}
    assert state(("a", "B"), ("b", "1"), ("n", None)) == {("a", "B"), ("b", "1"), ("n", None)}
    assert state(("a", "A"), ("n", None)) == {("a", "A"), ("n", None)}
    assert state(("a", "A"), ("n", "2")) == {("a", "A"), ("n", "2")}
    assert made[1:] == [[("a", "B")], [("a", "A")], [("n", "2")]]
    assert state(("b", "1")) == {("b", "1")} and made[-1] == [("b", "1")]


def test_two_writers_at_once(spark, tmp_path):
    target = VersionedTarget(spark, f"file://{tmp_path}/t", "key string, version string, made int")
    out: list = []

    def write(i):
        try:
            out.append(target.publish(make(rows(spark, (f"k{i}", "1"))), 0))
        except FileExistsError as e:
            out.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sum(x == 1 for x in out) == 1 and sum(isinstance(x, FileExistsError) for x in out) == 5
    assert target.read().count() == 1 and not [p for p in (tmp_path / "t/versions").iterdir() if p.name.endswith(".tmp")]


def test_what_failed_runs_left_is_cleaned(spark, tmp_path):
    target = VersionedTarget(spark, f"file://{tmp_path}/t", "key string, version string, made int")
    run_once(rows(spark, ("a", "1")), target, ["key", "version"], make)
    with pytest.raises(Exception):  # noqa: B017
        run_once(rows(spark, ("b", "1")), target, ["key", "version"], lambda df: df.withColumn("made", F.raise_error(F.lit("lost")).cast("int")))
    rows(spark, ("x", "1")).write.parquet(str(tmp_path / "t/parts/dead"))
    assert target.clean() == [] and "dead" in target.clean(0)
    assert [r["key"] for r in target.read().collect()] == ["a"]


@pytest.mark.parametrize("max_blocks", [1, 1 << 18])
def test_a_filter_too_large_to_broadcast_gives_the_same(spark, max_blocks):
    parents = spark.createDataFrame([(f"k{i}", 50, i % 7 == 0) for i in range(400)], "key string, known_us bigint, gone boolean")
    groups = spark.createDataFrame([("f", f"k{i}", "2026-01", 1, 1, i, i) for i in range(0, 900, 3)], "field string, key string, month string, n_refs bigint, n_dated bigint, first_us bigint, last_us bigint")
    got = {r["key"]: r["state"] for r in refcheck.orphan_states(groups, parents, max_blocks).collect()}
    want = {}
    for i in range(0, 900, 3):
        state = "missing" if i >= 400 else "deleted" if i % 7 == 0 else "late" if i < 50 else None
        if state:
            want[f"k{i}"] = state
    assert got == want
    bloom, blocks = refcheck.bloom_blocks(parents, "key", 400)
    assert blocks == -(-400 * refcheck.BITS_PER_KEY // 512)


@pytest.mark.parametrize("most", [0, 1000])
def test_late_references_of_a_hot_key_are_counted_in_parts(spark, most):
    refs = spark.createDataFrame([("f", "hot", i, "2026-01") for i in range(1000)] + [("f", "hot", None, "2026-01"), ("f", "b", 3, "2026-01")], "field string, key string, us bigint, month string")
    groups = refcheck.reference_groups(refs)
    parents = spark.createDataFrame([("hot", 700, False), ("b", 1, False)], "key string, known_us bigint, gone boolean")
    out = refcheck.exact_late_counts(refcheck.orphan_states(groups, parents), refs, most).collect()
    assert [(r["key"], r["state"], r["n_refs"]) for r in out] == [("hot", "late", 700)]

"""Operators of the core problems against brute force on small tables with all kinds of dirt."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from depweft.functions.text import digest_norm, instant_us, month_of_us, ntz_us, posix_path
from depweft.operators.eager_join import distinct_per_key, eager_join_rollup
from depweft.operators.incremental import VersionedTarget, latest_by, pending, run_once
from depweft.operators.ordered import last_before, ordered_blocks
from depweft.operators.refcheck import bloom_blocks, exact_late_counts, maybe_in, orphan_states, reference_groups
from depweft.operators.snapshots import changed_keys, differing_keys, target_changes
from depweft.plans.core_problems import notes_to_do

T = dt.datetime


# ---- text helpers ----


def test_instants_and_months(spark):
    rows = [("2026-01-31T23:30:00-05:00",), ("2026-02-01T04:30:00Z",), ("2026-02-01T04:30:00",), ("2026-02-01T04:30:00.5+00:00",), ("x",), (None,)]
    out = spark.createDataFrame(rows, "t string").select(instant_us(F.col("t")).alias("us"), month_of_us(instant_us(F.col("t"))).alias("m")).collect()
    assert out[0]["us"] == out[1]["us"] == out[2]["us"] == out[3]["us"] - 500_000
    assert [r["m"] for r in out] == ["2026-02"] * 4 + [None, None]
    at = T(2026, 3, 29, 2, 30, 1, 7)
    for zone in ("UTC", "Europe/Madrid", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            us = spark.createDataFrame([(at,)], "t timestamp_ntz").select(ntz_us(F.col("t"))).first()[0]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert us == (at - T(1970, 1, 1)) // dt.timedelta(microseconds=1)


def test_spellings(spark):
    d = spark.createDataFrame([("SHA256:AB", "./a\\b//c"), ("ab", "a/b/c"), (None, None), ("", ".hidden/x")], "d string, p string").select(digest_norm(F.col("d")), posix_path(F.col("p"))).collect()
    assert [tuple(r) for r in d] == [("ab", "a/b/c"), ("ab", "a/b/c"), (None, None), ("", ".hidden/x")]


# ---- problem 1 ----


@pytest.mark.parametrize("how", ["inner", "left"])
def test_eager_join_equals_plain_join(spark, how):
    r = random.Random(1)
    left = [(r.choice([None, "hot", "hot", "hot", "a", "b"]), r.choice(["x", "y", None]), r.choice([None, 1, 2]), "clash") for _ in range(300)]
    right = [(r.choice([None, "hot", "hot", "a", "c"]), r.choice(["p", "q"]), r.choice([None, 5, 7]), "clash") for _ in range(80)]
    a, b = spark.createDataFrame(left, "k string, g string, v int, kind string"), spark.createDataFrame(right, "k string, h string, w int, kind string")
    got = eager_join_rollup(a, b, F.col("k"), F.col("k"), left_groups={"g": F.col("g")}, right_groups={"h": F.col("h")}, left_sums={"v": F.col("v")}, right_sums={"w": F.col("w")}, how=how, by_key="key")
    want: dict = defaultdict(lambda: [0, None, None])
    for k, g, v, _ in left:
        hits = [(h, w) for k2, h, w, _ in right if k is not None and k == k2] or ([(None, None)] if how == "left" else [])
        for h, w in hits:
            s = want[k, g, h]
            s[0] += 1
            s[1] = s[1] if v is None else (s[1] or 0) + v
            s[2] = s[2] if w is None else (s[2] or 0) + w
    assert {(x["key"], x["g"], x["h"]): [x["n_rows"], x["v"], x["w"]] for x in got.collect()} == dict(want)
    assert eager_join_rollup(a.limit(0), b, F.col("k"), F.col("k"), how=how, by_key="key").count() == 0
    assert [r["n_rows"] for r in eager_join_rollup(a.limit(0), b, F.col("k"), F.col("k"), how=how).collect()] == [0]
    with pytest.raises(ValueError):
        eager_join_rollup(a, b, F.col("k"), F.col("k"), left_groups={"g": F.col("g")}, right_groups={"g": F.col("h")})


def test_distinct_per_key(spark):
    rows = [("t", "a"), ("t", "a"), ("t", "b"), ("u", None), (None, "a")]
    out = distinct_per_key(spark.createDataFrame(rows, "k string, s string"), F.col("k"), F.col("s"), "k", "n").collect()
    assert {(r["k"], r["n"]) for r in out} == {("t", 2)}


# ---- problem 2 ----


def test_differing_keys_by_searchsorted():
    def run(pairs):
        from depweft.operators.snapshots import _runs

        return _runs(np.array([k for k, _ in pairs], np.int64), np.array([h for _, h in pairs], np.int64))

    a, b = run([(1, 1), (2, 2), (3, 3), (5, 1), (5, 1), (6, 1), (6, 2)]), run([(2, 2), (3, 4), (4, 1), (5, 1), (6, 1)])
    assert sorted(differing_keys(a, b)) == [1, 3, 4, 6]
    assert sorted(differing_keys(run([]), b)) == [2, 3, 4, 5, 6] and sorted(differing_keys(a, run([]))) == [1, 2, 3, 5, 6]
    assert len(differing_keys(run([]), run([]))) == 0


def test_changed_keys_over_snapshots(spark):
    r = random.Random(4)
    state, rows = {}, []
    snaps = []
    for s in range(4):
        for _ in range(200):
            k = r.randint(1, 400)
            state[k] = r.randint(1, 3)
            if r.random() < 0.3:
                state.pop(k)
        snaps.append(dict(state))
        rows += [(s, k * 7919, h) for k, h in state.items()]
    got = {(x["pair"], x["k"]) for x in changed_keys(spark.createDataFrame(rows, "ord int, k bigint, h bigint"), 4, 10_000_000).collect()}
    assert got == {(i, k * 7919) for i in range(1, 4) for k in snaps[i - 1].keys() | snaps[i].keys() if snaps[i - 1].get(k) != snaps[i].get(k)}


TARGETS = "snap_no int, delivered_at timestamp, id bigint, kind string, last_sha string, last_semantic string, last_manifest map<string,string>, algorithm string, path string, ord string"


def snapshot_rows():
    d1, d2, d3 = T(2026, 1, 1), T(2026, 2, 1), T(2026, 3, 1)
    return [
        (1, d1, 1, "local", "A", None, {"a.py": "sha256:1", "dir\\b.py": "sha256:2", "c.py": "sha256:3"}, "sha256", "x", "x"),
        (1, d1, 2, "web", "s", "m", None, "sha256", "x", "x"), (1, d1, 3, "web", "s", "m", None, "sha256", "x", "x"), (1, d1, 4, "local", None, None, None, "md5", "x", "x"), (1, d1, 5, "local", "q", None, {"z": "1"}, "sha256", "x", "x"), (1, d1, 6, "web", "s", "m", None, "sha256", "x", "x"),
        (3, d2, 1, "local", "wrong", None, {}, "sha256", "x", "x"),
        (3, d3, 1, "local", "a", None, {"./a.py": "SHA256:1", "dir/b.py": "sha256:9", "d.py": "sha256:4"}, "sha256", "x", "x"), (3, d3, 1, "local", "a", None, {"./a.py": "SHA256:1", "dir/b.py": "sha256:9", "d.py": "sha256:4"}, "sha256", "x", "x"),
        (3, d3, 2, "web", "S", "m", None, "sha256", "x", "x"), (3, d3, 3, "web", "t", "M", None, "sha256", "x", "x"), (3, d3, 4, "local", "n", None, {"n": "1"}, "md5", "x", "x"), (3, d3, 5, "local", "q2", None, {"y": "1"}, "sha512", "x", "x"), (3, d3, 7, "web", "s", "m", None, "sha256", "x", "x"),
        (3, d3, None, "web", "s", "m", None, "sha256", "x", "x"), (None, d3, 9, "web", "s", "m", None, "sha256", "x", "x"),
    ]


def test_target_changes(spark):
    df = spark.createDataFrame(snapshot_rows(), TARGETS)
    got = {(r["snap_no"], r["target_id"], r["file_path"], r["change_kind"]) for r in target_changes(df).collect()}
    assert got == {
        (3, 1, "dir/b.py", "modified"), (3, 1, "c.py", "removed"), (3, 1, "d.py", "added"), (3, 3, "", "technical"), (3, 4, "", "baseline"), (3, 5, "", "algorithm"), (3, 6, "", "target removed"), (3, 7, "", "target added"),
    }
    assert target_changes(df.limit(0)).count() == 0 and target_changes(df.where("snap_no = 1")).count() == 0


# ---- problem 4 ----


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) AS key")
    bloom, blocks = bloom_blocks(keys, "key", 5000)
    probe = spark.range(20000).selectExpr("concat('k', id) AS key", "id").unionByName(spark.createDataFrame([(None, -1)], "key string, id bigint"))
    out = maybe_in(probe, "key", bloom, blocks)
    assert out.where("id >= 0 AND id < 5000 AND NOT maybe").count() == 0
    assert out.where("id >= 5000 AND maybe").count() < 0.03 * 15000
    assert out.where("key IS NULL AND maybe").count() == 0


@pytest.mark.parametrize("max_blocks", [1, 1 << 18])
def test_orphans_equal_brute_force_whatever_the_filter(spark, max_blocks):
    r = random.Random(5)
    parents = [(f"k{i}", r.choice([0, 50, 100, None]), r.random() < 0.2) for i in range(60)]
    refs = [("f", r.choice([None, "hot", "k0", "k0"] + [f"k{r.randint(0, 80)}"] * 4), r.choice([None, 10, 60, 120]), r.choice(["m1", "m2"])) for _ in range(800)]
    groups = reference_groups(spark.createDataFrame(refs, "field string, key string, us bigint, month string"))
    got = {(x["key"], x["month"], x["state"], x["n_refs"]) for x in orphan_states(groups, spark.createDataFrame(parents, "key string, known_us bigint, gone boolean"), max_blocks).collect()}
    by = defaultdict(list)
    for _, k, us, m in refs:
        if k is not None:
            by[k, m].append(us)
    know = {k: (u, g) for k, u, g in parents}
    want = set()
    for (k, m), us in by.items():
        if k not in know:
            want.add((k, m, "missing", len(us)))
        elif know[k][1]:
            want.add((k, m, "deleted", len(us)))
        elif know[k][0] is not None and any(u is not None and u < know[k][0] for u in us):
            want.add((k, m, "late", len(us)))
    assert got == want
    states = orphan_states(groups, spark.createDataFrame(parents, "key string, known_us bigint, gone boolean"), max_blocks)
    exact = {(x["key"], x["month"]): x["n_refs"] for x in exact_late_counts(states, spark.createDataFrame(refs, "field string, key string, us bigint, month string")).where("state = 'late'").collect()}
    assert exact == {(k, m): sum(u is not None and u < know[k][0] for u in by[k, m]) for k, m, s, _ in want if s == "late"}
    none = spark.createDataFrame([], "key string, known_us bigint, gone boolean")
    assert {x["state"] for x in orphan_states(groups, none).collect()} == {"missing"}
    assert orphan_states(groups.limit(0), none).count() == 0


# ---- problem 5 ----


def test_latest_by_ignores_row_order(spark):
    rows = [("a", None, 9), ("a", 1, 1), ("a", 1, 2), ("b", None, 3), (None, 1, 1)]
    for shuffled in (rows, rows[::-1]):
        out = latest_by(spark.createDataFrame(shuffled, "k string, t int, v int"), F.col("k"), [F.col("t")], {"v": F.col("v")}).collect()
        assert {r["key"]: r["v"] for r in out} == {"a": 2, "b": 3, None: 1}


def test_notes_to_do(spark):
    h = {c: c * 64 for c in "abcdef"}
    t1, t2 = T(2026, 1, 1), T(2026, 2, 1)
    nodes = [
        ("same", "file", "done", h["a"], t1, t1), ("spelled", "file", "done", f"sha256:{h['b'].upper()}", t1, t1), ("changed", "file", "done", h["a"], t1, t1), ("changed", "file", "done", h["c"], t2, t1), ("none", "file", "done", h["d"], None, t1), ("undigested", "file", "done", None, t1, t1),
        ("iso", "iso", "done", h["d"], t1, t1), ("pending", "file", "pending", h["d"], t1, t1), ("gone", "file", "done", h["d"], t1, t1), ("back", "file", "done", h["d"], t2, t2), ("other", "file", "done", h["e"], t1, t1), ("failed", "file", "done", h["e"], t1, t1), (None, "file", "done", h["e"], t1, t1),
    ]
    notes = [
        ("same", h["a"], "S", "done", "2026-01-02T00:00:00Z"), ("spelled", h["b"], "S", "skipped", "2026-01-02T00:00:00Z"), ("changed", h["a"], "S", "done", "2026-01-02T00:00:00Z"), ("other", h["e"], "T", "done", "2026-01-02T00:00:00Z"), ("failed", h["e"], "S", "done", "2026-01-02T01:00:00+02:00"),
        ("failed", h["e"], "S", "failed", "2026-01-01T23:30:00Z"), (None, h["e"], "S", "done", None),
    ]
    n = spark.createDataFrame([(i, k, kind, st, 1, d, None, u, l, "x") for i, (k, kind, st, d, u, l) in enumerate(nodes)], "id bigint, key string, kind string, status string, depth int, digest string, error string, updated timestamp, loaded_at timestamp, version string")
    a = spark.createDataFrame(notes, "node_key string, source_sha256 string, settings_hash string, state string, updated_at string")
    gone = spark.createDataFrame([("gone", t2), ("back", t1), (None, t2)], "key string, removed_at timestamp")
    runs = spark.createDataFrame([(1, "T"), (7, "S"), (None, "U")], "run_id bigint, settings_hash string")
    assert {r["key"] for r in notes_to_do(n, gone, a, runs).collect()} == {"changed", "none", "back", "other", "failed"}
    assert notes_to_do(n, gone, a, runs.limit(0)).count() == 7
    assert notes_to_do(n.limit(0), gone, a, runs).count() == 0


def test_versioned_target_survives_failures(spark, tmp_path):
    target = VersionedTarget(spark, f"file://{tmp_path}/t", "key string, version string, made int")
    source = spark.createDataFrame([("a", "1"), ("b", "1")], "key string, version string")
    make = lambda df: df.withColumn("made", F.lit(1))
    assert target.version() == 0 and target.read().count() == 0
    with pytest.raises(Exception):  # noqa: B017
        run_once(source, target, ["key", "version"], lambda df: df.withColumn("made", F.raise_error(F.lit("lost"))))
    assert target.version() == 0 and target.read().count() == 0
    run_once(source, target, ["key", "version"], make)
    assert target.version() == 1 and target.read().count() == 2
    more = source.unionByName(spark.createDataFrame([("b", "2"), ("c", "1")], "key string, version string"))
    assert pending(more, target.read(), ["key", "version"]).count() == 2
    number, rows = run_once(more, target, ["key", "version"], make)
    assert number == 2 and Counter(r["key"] for r in rows.collect()) == {"a": 1, "b": 2, "c": 1}
    assert run_once(more, target, ["key", "version"], make)[1].count() == 4
    stale = target.version() - 1
    with pytest.raises(FileExistsError):
        target.publish(more.withColumn("made", F.lit(9)), stale)
    assert target.read().count() == 4


# ---- ordered scan ----


def test_last_before_in_blocks(spark):
    r = random.Random(6)
    rows = [("hot" if r.random() < 0.7 else f"k{r.randint(0, 9)}", i, r.choice([None, None, r.randint(0, 99)])) for i in range(3000)]
    blocked = ordered_blocks(spark.createDataFrame(rows, "k string, i int, v int"), ["k"], ["i"], blocks=6)
    assert blocked.where("k = 'hot'").select("__block").distinct().count() > 1
    got = {r["i"]: r["e"] for r in last_before(blocked, ["k"], ["i"], F.col("v"), "e").collect()}
    seen: dict = {}
    for k, i, v in rows:
        assert got[i] == seen.get(k)
        if v is not None:
            seen[k] = v

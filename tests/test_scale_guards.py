"""Deep graphs, hot keys and empty tables: nothing is cut off, gathered or dropped."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from depweft.operators import extract, graph, monitor
from depweft.operators.resolve import expanded
from depweft.streaming.monitor import STATE, handle, poll_due

EDGES = "source string, target string, relation string, evidence string"


def test_chains_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(graph, "MERGED", 3)
    rows = [(f"n{i:03}", f"n{i + 1:03}", "r", "declared") for i in range(14)]
    nodes = spark.createDataFrame([(f"n{i:03}",) for i in range(15)], "key string")
    assert graph.reach(nodes, spark.createDataFrame(rows, EDGES), F.col("key") == "n000", "dependencies").count() == 15


def test_patterns_without_a_folder_meet_only_files_that_may_fit(spark):
    r = random.Random(5)
    paths = [f"{'/'.join(r.choice('abc') for _ in range(r.randint(0, 3)))}/f{i}.{r.choice(['js', 'ts', 'JS'])}".lstrip("/") for i in range(300)] + ["hot/" + f"x{i}.js" for i in range(500)]
    specs = ["/**/*.js", "/*.ts", "/a/*/f*.js", "/hot/x1*.js", "/*/x2?.js", "/a/**/*"]
    refs = spark.createDataFrame([(f"src/{w}.js", s, "p", "inferred", "glob") for s in specs for w in "xy"], extract.REFS)
    got = {(x["source"], x["target"]) for x in expanded(refs, spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    import re

    rules = {"/**/*.js": r"(?:.*/)?[^/]*\.js", "/*.ts": r"[^/]*\.ts", "/a/*/f*.js": r"a/[^/]*/f[^/]*\.js", "/hot/x1*.js": r"hot/x1[^/]*\.js", "/*/x2?.js": r"[^/]*/x2[^/]\.js", "/a/**/*": r"a/(?:.*/)?[^/]*"}
    want = {(f"file:src/{w}.js", f"file:{p}") for s in specs for w in "xy" for p in paths if re.fullmatch(rules[s], p) or re.fullmatch("public/" + rules[s], p)}
    assert got == want and len(want) > 500


def test_kept_texts_equal_the_greedy_choice_on_a_hot_target(spark):
    r = random.Random(9)
    files = [("hot", i, f"f{i}.py", r.choice([8000, 7000, 90, 3000])) for i in range(2000)] + [("t", i, f"g{i}.py", 4000) for i in range(50)]
    want = set()
    for t in ("hot", "t"):
        n = used = 0
        for tt, _, p, s in files:
            if tt == t and n < 60 and used + s <= 160_000:
                n, used = n + 1, used + s
                want.add((t, p))
    got = {(x["target"], x["path"]) for x in monitor.snapshot_choice(spark.createDataFrame(files, "target string, ordinal int, path string, size bigint")).collect()}
    assert got == want
    assert monitor.snapshot_choice(spark.createDataFrame([], "target string, ordinal int, path string, size bigint")).count() == 0


def test_stream_carries_on_and_drops_late_repeats(spark):
    empty = spark.createDataFrame([], STATE)
    one = spark.createDataFrame([(1, 1, "web", "sha256", "a", "x", False, False), (1, 2, "web", "sha256", "a", "x", False, False), (2, 5, "local", "md5", None, None, True, False)], STATE)
    events, known = handle(one, empty)
    assert {(e["target"], e["seq"], e["state"]) for e in events.collect()} == {(1, 1, "baseline"), (2, 5, "error")}
    known = spark.createDataFrame(known.collect(), STATE)
    two = spark.createDataFrame([(1, 2, "web", "sha256", "b", "y", False, False), (1, 3, "web", "sha256", "b", "y", False, False), (1, 4, "web", "md5", "q", "y", False, False)], STATE)
    events, after = handle(two, known)
    assert {(e["target"], e["seq"], e["state"]) for e in events.collect()} == {(1, 3, "content"), (1, 4, "baseline")}
    assert {(k["target"], k["seq"], k["algorithm"], k["sha"], k["failed"]) for k in after.collect()} == {(1, 4, "md5", "q", False), (2, 5, "md5", None, True)}
    assert handle(empty, known)[0].count() == 0 and handle(empty, known)[1].count() == 2


def test_the_clock_checks_three_targets_at_most(spark, tmp_path):
    seen: list[list[int]] = []
    targets = spark.createDataFrame([(i, 1_000 - i) for i in range(5)] + [(9, 1 << 60)], "id bigint, next_us bigint")
    query = poll_due(spark, lambda: targets, lambda df: seen.append([r["id"] for r in df.collect()]), str(tmp_path / "cp"), tick="1 second")
    try:
        for _ in range(200):
            if len(seen) >= 2 or not query.isActive:
                break
            query.awaitTermination(0.2)
    finally:
        query.stop()
    assert seen and all(s == [4, 3, 2] for s in seen)


@pytest.mark.parametrize("name", ["unchanged_files", "registration_events", "monitor_replay", "text_diffs"])
def test_monitor_queries_on_an_empty_table(spark, tmp_path, name):
    from depweft.plans.registry import queries

    spark.read.parquet("/root/testdata/sf0.001/targets.parquet").limit(0).write.parquet(str(tmp_path / "targets.parquet"))
    assert queries()[name](spark, str(tmp_path)).count() == 0

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from depweft.functions import fixed, keys
from depweft.operators import graph

EDGES = "source string, target string, relation string, evidence string"
NODES = "id bigint, key string, kind string, status string, depth int"


def edges(spark, rows):
    return spark.createDataFrame(rows, EDGES)


def test_upsert_keeps_the_last_evidence(spark):
    a, b = dt.datetime(2026, 1, 1), dt.datetime(2026, 2, 1)
    rows = [("x", "y", "r", "Declared", a), ("x", "y", "r", "inferred", b), ("x", "y", "r", None, b), ("x", "y", "q", None, None), (None, "y", "r", "d", a), ("x", None, "r", "d", a)]
    got = {tuple(r) for r in graph.current_edges(spark.createDataFrame(rows, EDGES + ", loaded_at timestamp_ntz")).collect()}
    assert got == {("x", "y", "r", "inferred"), ("x", "y", "q", None)}


def test_usage_labels(spark):
    e = edges(spark, [("file:a", "file:b", "source-import", "declared"), ("file:a", "file:c", "source-import", "inferred"), ("file:a", "file:d", "contains", "declared"), ("file:w", "file:e", "generates", "declared"), ("file:a", "file:f", "x", None)])
    n = spark.createDataFrame([(k,) for k in ("file:a", "file:b", "file:c", "file:d", "file:e", "file:f", "file:src/pages/x.astro", "file:Dockerfile", "external:dockerfile")], "key string")
    got = {r["key"]: (r["usage"], r["producers"], r["safe_to_delete"]) for r in graph.usage_labels(n, e).collect()}
    assert got == {
        "file:a": ("unresolved", 0, None), "file:b": ("referenced", 0, None), "file:c": ("possibly-referenced", 0, None), "file:d": ("unresolved", 0, None), "file:e": ("unresolved", 1, None), "file:f": ("referenced", 0, None),
        "file:src/pages/x.astro": ("entrypoint", 0, None), "file:Dockerfile": ("entrypoint", 0, None), "external:dockerfile": ("unresolved", 0, None),
    }


def test_audit_has_one_own_class_per_file(spark):
    r = random.Random(2)
    names = [f"file:{p}{i}{s}" for i in range(30) for p, s in [r.choice([("src/pages/", ".ts"), ("public/", ".txt"), ("img/", ".png"), ("lib/", ".py")])]]
    e = edges(spark, [(r.choice(names), r.choice(names), r.choice(["source-import", "generates", "contains"]), "declared") for _ in range(40)])
    rows = graph.audit_classes(spark.createDataFrame([(k,) for k in names] + [("external:x",)], "key string"), e).collect()
    own = defaultdict(list)
    for x in rows:
        if x["class"] != "produced_but_no_consumers_detected":
            own[x["key"]].append(x["class"])
    assert own.keys() == set(names) and all(len(v) == 1 for v in own.values())


def walk(pairs, seeds):
    seen, todo = set(seeds), list(seeds)
    while todo:
        k = todo.pop()
        for a, b in pairs:
            if a == k and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_reach_and_impact_equal_brute_force(spark, seed):
    r = random.Random(seed)
    names = [f"file:n{i}" for i in range(25)]
    rows = list({(a, b): (a, b, r.choice(["source-import", "contains", "generates"]), r.choice(["declared", "inferred", None])) for a, b in [(r.choice(names), r.choice(names)) for _ in range(45)]}.values())
    e, n = edges(spark, rows), spark.createDataFrame([(k,) for k in names], "key string")
    fwd = [(a, b) for a, b, *_ in rows]
    back = [(b, a) for a, b in fwd]
    for direction, pairs in (("dependencies", fwd), ("dependents", back), ("both", fwd + back)):
        assert {x["key"] for x in graph.reach(n, e, F.col("key") == names[0], direction).collect()} == walk(pairs, [names[0]])
    uses = [(b, a, ev in fixed.LOW_CONFIDENCE) for a, b, rel, ev in rows if rel == "source-import"]
    best, frontier, level = {names[0]: (0, False)}, {names[0]: False}, 0
    while frontier:
        level += 1
        new: dict = {}
        for t, s, low in uses:
            if t in frontier and s not in best:
                new[s] = min(new.get(s, True), frontier[t] or low)
        best |= {k: (level, v) for k, v in new.items()}
        frontier = new
    consumers, truncated = graph.impact(e, names[0])
    got = consumers.collect()
    assert {(x["key"], x["distance"], x["certainty"] == "possible") for x in got} == {(k, d, p) for k, (d, p) in best.items() if d} and not truncated
    for x in got:
        assert x["chain"][0] == x["key"] and x["chain"][-1] == names[0] and len(x["chain"]) == x["distance"] + 1
    short, cut = graph.impact(e, names[0], max_depth=1)
    assert {x["key"] for x in short.collect()} == {k for k, (d, _) in best.items() if d == 1} and cut == any(d > 1 for d, _ in best.values())


def test_chain_of_consumers(spark):
    e = edges(spark, [("file:src/pages/p.astro", "file:post", "computed-file-path", "inferred"), ("file:post", "file:image", "metadata-resource", "declared"), ("dir:x", "file:image", "contains", "filesystem")])
    consumers, _ = graph.impact(e, "file:image")
    assert {(x["key"], x["distance"], x["certainty"]) for x in consumers.collect()} == {("file:post", 1, "declared"), ("file:src/pages/p.astro", 2, "possible")}
    assert [tuple(x["chain"]) for x in graph.entry_chains(consumers).collect()] == [("file:src/pages/p.astro", "file:post", "file:image")]


def test_scope_of_a_folder(spark):
    n = spark.createDataFrame([("file:Src/a_b/x",), ("file:src/a_b/y",), ("file:src/aXb/z",)], "key string")
    assert {x["key"] for x in n.where(graph.scope_seed("/src/a_b/")).collect()} == {"file:Src/a_b/x", "file:src/a_b/y"}
    with pytest.raises(ValueError):
        graph.scope_seed("../x")
    with pytest.raises(ValueError):
        graph.reach(n, edges(spark, []), F.lit(True), "up")


@pytest.mark.parametrize(
    ("counts", "status"),
    [(["done", "done"], "done"), (["done", "pending"], "pending"), (["done", "running"], "pending"), (["failed", "pending"], "failed"), (["encrypted", "failed", "done"], "encrypted"), (["external"], "done")],
)
def test_rollup_takes_the_most_pressing_status(spark, counts, status):
    n = spark.createDataFrame([(f"file:a/b/f{i}", s) for i, s in enumerate(counts)] + [("external:x", "failed"), ("file:", "failed"), ("file:../x", "failed")], "key string, status string")
    got = {r["dir"]: (r["depth"], r["status"], r["n_files"]) for r in graph.folder_rollup(n).collect()}
    assert got == {d: (k, status, len(counts)) for d, k in (("dir:.", 0), ("dir:a", 1), ("dir:a/b", 2))}


def test_structure_and_tree(spark):
    n = spark.createDataFrame([("file:a/b/c.py", "done"), ("file:a/z.iso", "pending"), ("file:top", "failed"), ("iso:a/z.iso!/in/x", "encrypted")], "key string, status string")
    e = edges(spark, [("dir:.", "dir:a", "contains", "filesystem")])
    assert {(r["source"], r["target"]) for r in graph.structure_edges(n, e).collect()} == {("dir:a", "dir:a/b"), ("dir:a/b", "file:a/b/c.py"), ("dir:a", "file:a/z.iso"), ("dir:.", "file:top")}
    assert [(r["name"], r["directory"], r["status"], r["n"]) for r in graph.tree_level(n, "").collect()] == [("a", True, "pending", 2), ("top", False, "failed", 1)]
    assert [(r["name"], r["directory"]) for r in graph.tree_level(n, "a").collect()] == [("b", True), ("z.iso", True)]
    assert [(r["name"], r["status"]) for r in graph.tree_level(n, "iso:a/z.iso!").collect()] == [("in", "encrypted")]


def test_public_snapshot(spark):
    n = spark.createDataFrame([("file:a", "done"), ("file:b", "odd"), ("file:secret", "done"), ("external:x", "external")], "key string, status string")
    e = edges(spark, [("file:a", "file:b", "r-1", "observed"), ("file:a", "file:b", "Bad", "declared"), ("file:a", "file:secret", "r", "declared"), ("file:b", "file:a", "r", "probable")])
    nodes, kept = graph.public_snapshot(n, e, spark.createDataFrame([("a",), ("b",)], "path string"))
    assert {tuple(r) for r in nodes.collect()} == {("file:a", "done", 0), ("file:b", "pending", 0)}
    assert {tuple(r) for r in kept.collect()} == {("file:a", "file:b", "r-1", "observed"), ("file:b", "file:a", "r", "inferred")}


def test_two_hop_and_replacement(spark):
    e = edges(spark, [("a", "b", "r", "d"), ("b", "c", "r", "d"), ("c", "d", "r", "d"), ("a", "a", "r", "d")])
    assert {(r["key"], r["hop"]) for r in graph.two_hop(e, "a").collect()} == {("b", 1), ("c", 2)}
    new = edges(spark, [("a", "z", "r", "d")])
    out = graph.replace_edges(e, new, spark.createDataFrame([("a",)], "source string"))
    assert {(r["source"], r["target"]) for r in out.collect()} == {("a", "z"), ("b", "c"), ("c", "d")}


def test_key_parts(spark):
    paths = ["a/b/c.tar.gz", ".env", "x", "a/.b", "d.", "é/Ü.PNG"]
    out = spark.createDataFrame([(p,) for p in paths], "p string").select(keys.suffix(F.col("p")), keys.parent(F.col("p")), keys.base_name(F.col("p"))).collect()
    assert [tuple(r) for r in out] == [(".gz", "a/b", "c.tar.gz"), ("", "", ".env"), ("", "", "x"), ("", "a", ".b"), ("", "", "d."), (".png", "é", "Ü.PNG")]
    norm = spark.createDataFrame([("a/./b/../c",), ("../x",), ("a/../../x",), ("",), ("a//b/",)], "p string").select(keys.normal_path(F.col("p"))).collect()
    assert [r[0] for r in norm] == ["a/c", None, None, "", "a/b"]

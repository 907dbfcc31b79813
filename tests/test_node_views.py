from __future__ import annotations

from pathlib import Path

import pytest

from depweft.operators import graph
from depweft.plans.registry import oracle_sql, queries

DATA = Path("/root/testdata/sf0.001")
EDGE = "source string, target string, relation string, evidence string"


def test_adjacency_has_the_edges_of_all_keys(spark):
    edges = spark.createDataFrame([("a", "b", "imports", "declared"), ("a", "b", "reads", None), ("c", "b", "produces", "inferred"), ("dir:.", "b", "contains", "filesystem"), ("", "a", "imports", "declared")], EDGE)
    assert sorted(map(tuple, graph.adjacency(edges).collect())) == [
        ("a", "outgoing", "b", "imports", "declared"), ("a", "outgoing", "b", "reads", "unknown"), ("b", "incoming", "a", "imports", "declared"), ("b", "incoming", "a", "reads", "unknown"), ("b", "production", "c", "produces", "inferred"),
    ]


def test_first_edges_of_nodes(spark):
    edges = spark.createDataFrame([(f"s{i:03}", "hot", r, "declared") for i in range(150) for r in ("imports", "reads")] + [("hot", "s000", "imports", None), ("x", "y", "imports", "declared")], EDGE)
    rows = [tuple(r) for r in graph.first_edges(spark.createDataFrame([("hot",), ("hot",), ("lone",)], "key string"), edges).collect()]
    assert len(rows) == 201 and ("hot", "outgoing", 1, "s000", "imports", None) in rows
    assert sorted(r[2:5] for r in rows if r[1] == "incoming") == [(i + 1, f"s{i // 2:03}", ("imports", "reads")[i % 2]) for i in range(200)]


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", ["adjacency_views", "node_edges", "node_facts"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries()[name](spark, str(DATA))
    rel = con.sql(oracle_sql()[name])
    at = [rel.columns.index(c) for c in df.columns]
    theirs = sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())
    assert theirs and sorted(repr(tuple(r)) for r in df.collect()) == theirs

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_the_llm_subpackage():
    for p in (ROOT / "depweft").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "depweft").parts:
            assert "depweft.llm" not in p.read_text(), p


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["key", "usage", "declared_incoming", "inferred_incoming", "producers", "safe_to_delete"]


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p4_found", "p5_found", "usage_labels", "impact_consumers", "monitor_replay", "refs_static"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = entry.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    ours = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    rel = con.sql(entry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    assert ours == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())

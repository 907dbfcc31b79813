from __future__ import annotations

from pathlib import Path

import pandas as pd
import pytest

from depweft.plans.monitor_queries import SQL, note_run_plan

DATA = Path("/root/testdata/sf0.01")


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("most", [0, 7, None])
def test_the_run_in_force_bounds_the_plan(spark, tmp_path, most):
    duckdb = pytest.importorskip("duckdb")
    for name in ("nodes", "ai_notes"):
        (tmp_path / f"{name}.parquet").symlink_to(DATA / f"{name}.parquet")
    runs = pd.read_parquet(DATA / "note_runs.parquet").sort_values("run_id")
    runs["max_files"] = runs["max_files"].astype("Int32")
    runs.loc[runs.index[-1], "max_files"] = pd.NA if most is None else most
    spark.createDataFrame(runs.astype(object).where(runs.notna(), None), "run_id bigint, started_at timestamp, finished_at timestamp, state string, settings_hash string, max_files int").write.parquet(str(tmp_path / "note_runs.parquet"))
    con = duckdb.connect()
    for name in ("nodes", "ai_notes", "note_runs"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    whole = con.sql(SQL["note_run_plan"].rpartition(" LIMIT ")[0]).fetchall()
    got = [tuple(r) for r in note_run_plan(spark, str(tmp_path)).collect()]
    assert len(whole) > 7 and got == (whole[:most] if most else whole)

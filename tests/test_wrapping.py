from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from depweft.operators import monitor


def test_whole_texts_are_wrapped_and_web_diffs_are_bounded(spark):
    words = [f"w{i}" for i in range(5000)]
    (lines,) = spark.createDataFrame([(" ".join(words),)], "t string").select(monitor.wrapped_words(F.col("t"))).first()
    assert len(lines) == 417 and " ".join(lines).split() == words
    assert monitor.unified_diff(" ".join(words), " ".join([*words[:2400], "x"]), True) == "" != monitor.unified_diff(" ".join(words), " ".join(words[:2399]), True)


def test_words_are_parted_as_in_sql(spark, tmp_path):
    texts = ["a\x0bb c", "a\x0b\n\x0b b", "\x0b", " \t\r\f\n", "", "a\x0bb " * 13, "x\ny\f\t z", "a\x85b\u3000c \x1c d", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    ours = entry.queries()["wrapped_lines"](spark, str(tmp_path)).select("doc_id", "n", "line").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, ours)) == sorted(con.sql(entry.oracle_sql()["wrapped_lines"]).fetchall())

"""Values from earlier rows of the same key, without giving a key's rows to one task.

Rows are range-partitioned by key and order into blocks; within a block a window finds the earlier value, and what lies before a block
comes from one summary row per key and block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweft.session import cut

BLOCK = "__block"


def ordered_blocks(df: DataFrame, keys: list[str], order: list[str], blocks: int | None = None) -> DataFrame:
    """df with its block, written once, so that every use sees the same blocks. Their number follows the data's size unless given."""
    number = [blocks] if blocks else []
    return cut(df.repartitionByRange(*number, *keys, *order).withColumn(BLOCK, F.spark_partition_id()))


def last_before(blocked: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """blocked with the column name: the last value that is not null, of the rows before each row in its key; null if there is none.

    Rows with equal order stand in an order of their own that may differ between runs; order should be unique within a key.
    """
    rows = blocked.withColumn("__v", value)
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order)
    summary = rows.groupBy(*keys, BLOCK).agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), at)).alias("__s"))
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(*keys, BLOCK, F.last("__s", ignorenulls=True).over(earlier).alias("__c"))
    out = rows.join(carried, [*keys, BLOCK], "left").withColumn(name, F.coalesce(F.last("__v", ignorenulls=True).over(inside), F.col("__c")))
    return out.drop("__v", "__c")

"""Aggregation pushed below a join, for keys that hold most of the rows.

An aggregate over `left JOIN right` needs no joined rows: each side is first reduced to one compact state per join key
(and per wanted group column), the states are joined, and counts are multiplied and sums scaled by the other side's count.
A key that holds a third of all rows is thereby reduced to one state per map task before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY, LN, RN = "__key", "__l_rows", "__r_rows"


def key_state(df: DataFrame, key: Column, groups: Mapping[str, Column], sums: Mapping[str, Column], rows: str) -> DataFrame:
    """One row per key and group: its number of rows, and of every summed column the sum and the number of values."""
    narrow = df.select(key.alias(KEY), *(c.alias(n) for n, c in groups.items()), *(c.alias(n) for n, c in sums.items()))
    aggs = [F.count(F.lit(1)).alias(rows)]
    for name in sums:
        aggs += [F.sum(name).alias(f"__s_{name}"), F.count(name).alias(f"__c_{name}")]
    return narrow.groupBy(KEY, *groups).agg(*aggs)


def eager_join_rollup(
    left: DataFrame,
    right: DataFrame,
    left_key: Column,
    right_key: Column,
    *,
    left_groups: Mapping[str, Column] | None = None,
    right_groups: Mapping[str, Column] | None = None,
    left_sums: Mapping[str, Column] | None = None,
    right_sums: Mapping[str, Column] | None = None,
    how: str = "inner",
    by_key: str | None = None,
    count: str = "n_rows",
) -> DataFrame:
    """`SELECT groups, count(*), sum(...) FROM left JOIN right ON key GROUP BY groups` without joining rows.

    how: inner or left. by_key: name under which the join key itself is a group column. Null keys join nothing; with how
    = left their rows count once, as in SQL. Empty inputs give an empty result, without any group the one row that SQL gives. Sums skip nulls and are null where no
    value exists. Group columns of both sides must bear different names; other columns may clash, they are dropped first.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    lg, rg, ls, rs = (dict(x or {}) for x in (left_groups, right_groups, left_sums, right_sums))
    names: Sequence[str] = [*lg, *rg, *ls, *rs]
    if len(set(names)) < len(names) or {by_key, count} & set(names):
        raise ValueError("names of groups and sums must differ")
    a = key_state(left, left_key, lg, ls, LN)
    b = key_state(right.where(right_key.isNotNull()), right_key, rg, rs, RN)
    joined = a.join(b, KEY, how)
    other = F.coalesce(F.col(RN), F.lit(1)) if how == "left" else F.col(RN)
    grouped = joined.groupBy(*([F.col(KEY).alias(by_key)] if by_key else []), *lg, *rg)
    aggs = [F.coalesce(F.sum(F.col(LN) * other), F.lit(0)).cast("bigint").alias(count)]
    aggs += [F.sum(F.col(f"__s_{n}") * other).alias(n) for n in ls]
    aggs += [F.sum(F.col(f"__s_{n}") * F.col(LN)).alias(n) for n in rs]
    return grouped.agg(*aggs)


def distinct_per_key(df: DataFrame, key: Column, member: Column, key_name: str, count: str) -> DataFrame:
    """Number of different non-null members per non-null key. The first step groups by key *and* member, so that a hot
    key spreads over all tasks; the second adds up ones."""
    pairs = df.select(key.alias(key_name), member.alias("__member")).where(F.col(key_name).isNotNull() & F.col("__member").isNotNull())
    return pairs.distinct().groupBy(key_name).agg(F.count(F.lit(1)).alias(count))

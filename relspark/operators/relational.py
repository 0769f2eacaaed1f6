"""Relational operators with a rule of their own beside Catalyst's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def natural_join(left: DataFrame, right: DataFrame, left_name: str, right_name: str, how: str = "inner") -> DataFrame:
    """Equality on all shared names; both copies stay, named ``alias.column``. Nulls never match."""
    shared = [c for c in left.columns if c in right.columns]
    a = left.toDF(*(f"{left_name}.{c}" for c in left.columns))
    b = right.toDF(*(f"{right_name}.{c}" for c in right.columns))
    if not shared:
        return a.crossJoin(b)
    return a.join(b, reduce(lambda x, y: x & y, (a[f"`{left_name}.{c}`"] == b[f"`{right_name}.{c}`"] for c in shared)), how)


def table_stats(df: DataFrame) -> DataFrame:
    """Row count and exact number of distinct values of each column, one aggregation for all."""
    aggs = [F.count("*").alias("n"), *(F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(df.columns))]
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col("n").alias("row_count"), F.col(f"d{i}").alias("ndv")) for i, c in enumerate(df.columns)))
    return df.agg(*aggs).select(F.inline(pairs))

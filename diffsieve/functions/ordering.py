"""Positions and running totals in groups that may be very large.

A plain ``row_number()`` over a group puts the whole group into one task. Here a group is first cut into
slices by a coarse key that agrees with the order; only the totals of the slices are added up per group, and
rows are numbered inside their slice. Where no such key is known, ranges of equal size take the slices' place
(``with_range_total``), whatever the values are.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage


def with_running_total(
    df: DataFrame, group: list[str], slice_by: Column, order: list, value: Column, name: str
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the group's rows up to and including this one.

    ``slice_by`` must not decrease along ``order``. One slice has to fit a task, and so have the slice totals
    of one group. Without a group, use ``with_range_total``.
    """
    sliced = df.withColumn("_slice", slice_by).withColumn("_value", value)
    totals = sliced.groupBy(*group, "_slice").agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        *group, "_slice", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before")
    )
    inside = (
        Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        join_on(sliced, before, [*group, "_slice"])
        .withColumn(name, F.col("_before") + F.sum("_value").over(inside))
        .drop("_slice", "_value", "_before")
    )


def join_on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on equal keys where null equals null, so that rows of a null group are kept."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, same).drop(*[f"_right_{k}" for k in keys])


def with_position(df: DataFrame, group: list[str], slice_by: Column, order: list, name: str) -> DataFrame:
    """Add ``name``: the 1-based position of the row in its group."""
    return with_running_total(df, group, slice_by, order, F.lit(1).cast("bigint"), name)


def first_n(df: DataFrame, group: list[str], order: list, n: int, name: str = "_n") -> DataFrame:
    """The first n rows of every group; Spark cuts each task's share before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def with_running_max(
    df: DataFrame, group: list[str], slice_by: Column, order: list, value: Column, name: str, current: bool = True
) -> DataFrame:
    """Add ``name``: the greatest ``value`` of the group's rows before this one, and of this one if ``current``; null if there
    is none. Slices are as in ``with_running_total``."""
    sliced = df.withColumn("_slice", slice_by).withColumn("_value", value)
    tops = sliced.groupBy(*group, "_slice").agg(F.max("_value").alias("_top"))
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = tops.select(*group, "_slice", F.max("_top").over(earlier).alias("_before"))
    inside = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    return (
        join_on(sliced, before, [*group, "_slice"])
        .withColumn(name, F.greatest("_before", F.max("_value").over(inside)))
        .drop("_slice", "_value", "_before")
    )


def in_ranges(df: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """``df`` dealt into ranges of about equal size along ``order`` and written once; ``_range`` rises along the order."""
    dealt = df.repartitionByRange(*([ranges] if ranges else []), *order)
    return stage(dealt.withColumn("_range", F.spark_partition_id()))


def with_range_total(
    df: DataFrame, group: list[str], order: list[str], value: str, name: str, ranges: int | None = None
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the group's rows up to and including this one, for values of any kind and spread.

    Rows of one group that are equal in ``order`` must be one row (add them up first). The rows are range-partitioned by a
    sample of the data; the totals of the ranges, one number a range, are run through on the driver if there is no group, and else group by group.
    """
    dealt = in_ranges(df, [*group, *order], ranges)
    totals = dealt.groupBy(*group, "_range").agg(F.sum(value).alias("_total"))
    if group:
        earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        before = totals.select(*group, "_range", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    else:
        rows = sorted((r["_range"], r["_total"] or 0) for r in totals.collect())
        sums = [0, *accumulate(total for _, total in rows)]
        before = df.sparkSession.createDataFrame(
            [(k, before) for (k, _), before in zip(rows, sums, strict=False)], "_range INT, _before BIGINT")
    inside = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        join_on(dealt, before, [*group, "_range"])
        .withColumn(name, F.col("_before") + F.sum(value).over(inside))
        .drop("_range", "_before")
    )

"""Ordered computations on groups that may hold a large share of all rows.

A plain window sends each group to one task. Here a group is cut into slices that
follow its order; the window runs inside a slice, and what a slice needs from the
earlier ones comes from a table with one row per slice, joined back on the group
and the slice. Group and slice columns must not be NULL. The caller picks a slice column that bounds the rows of a slice
(a day, a block of consecutive iterations, a hash prefix) and never decreases along the order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abundex.functions.expressions import join_null_safe

ITERATIONS_PER_SLICE = 65_536


def block_slice(position: Column, size: int = ITERATIONS_PER_SLICE) -> Column:
    """Slice of a position that is unique in its group: at most ``size`` rows each."""
    return F.floor(position / F.lit(size))


def hash_order(value: Column) -> Column:
    """An order for things whose order carries no meaning; its prefixes are even slices."""
    return F.md5(value.cast("string"))


def hash_slice(value: Column, digits: int = 3) -> Column:
    """``16 ** digits`` even slices of ``hash_order``."""
    return F.substring(hash_order(value), 1, digits)


def lag_in_slices(
    df: DataFrame,
    keys: Sequence[str],
    slice_col: str,
    order: Sequence[str],
    value: str,
    out: str,
) -> DataFrame:
    """``value`` of the previous row of the group, in order of ``slice_col, *order``."""
    inside = Window.partitionBy(*keys, slice_col).orderBy(*order)
    rows = df.withColumn("_before", F.lag(F.struct(value)).over(inside))
    along = Window.partitionBy(*keys).orderBy(F.col(slice_col).asc_nulls_last())
    carried = (
        rows.groupBy(*keys, slice_col)
        .agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
        .withColumn("_carried", F.lag("_last").over(along))
        .drop("_last")
    )
    return (
        join_null_safe(rows, carried, [*keys, slice_col])
        .withColumn(out, F.coalesce("_before", "_carried")[value])
        .drop("_before", "_carried")
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    slice_col: str,
    order: Sequence[str],
    value: Column,
    out: str,
) -> DataFrame:
    """Sum of ``value`` up to and including the row, in order of ``slice_col, *order``."""
    inside = (
        Window.partitionBy(*keys, slice_col)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = df.withColumn("_within", F.sum(value).over(inside))
    along = (
        Window.partitionBy(*keys)
        .orderBy(F.col(slice_col).asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        rows.groupBy(*keys, slice_col)
        .agg(F.sum(value).alias("_slice_sum"))
        .withColumn("_offset", F.coalesce(F.sum("_slice_sum").over(along), F.lit(0)))
        .drop("_slice_sum")
    )
    return (
        join_null_safe(rows, offsets, [*keys, slice_col])
        .withColumn(out, F.col("_within") + F.col("_offset"))
        .drop("_within", "_offset")
    )


def row_number_in_slices(
    df: DataFrame, keys: Sequence[str], slice_col: str, order: Sequence[str], out: str
) -> DataFrame:
    """1-based position in the group."""
    return running_sum(df, keys, slice_col, order, F.lit(1).cast("long"), out)

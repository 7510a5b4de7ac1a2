"""Exact quantiles and ranks per group, also for groups too large for one task.

Spark's ``percentile`` keeps the distinct values of a group in one task's memory.
Groups are therefore counted first; where one is larger than ``limit``, its values
are cut into slices at points taken from a hash sample of the values (the same
sample on every run), ranked slice by slice, and the wanted ranks picked with a
mergeable ``min``. Both ways give the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abundex.functions.expressions import bisect, join_groups
from abundex.functions.ordered import running_sum

GROUP_ROWS = 2_000_000
MAX_SLICES = 4_096
SAMPLES_PER_SLICE = 64


def oversized_groups(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Groups with more than ``limit`` rows: at most rows / limit of them."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return sizes.filter(F.col("_rows") > limit)


def slice_by_value(
    values: DataFrame, keys: Sequence[str], value: str, limit: int, big: DataFrame
) -> DataFrame:
    """Add ``_slice``: 0 in small groups, about ``limit`` rows per slice in ``big`` ones.

    ``values`` holds each (group, value) once, so equal values cannot fill a slice.
    """
    width = F.greatest(F.lit(limit), F.ceil(F.col("_rows") / MAX_SLICES))
    every = F.greatest(F.lit(1), F.floor(width / SAMPLES_PER_SLICE))
    cuts = (
        join_groups(values, big, keys)
        .filter(F.pmod(F.xxhash64(value), every) == 0)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(value)).alias("_sample"))
        .select(
            *keys,
            F.filter(
                "_sample", lambda _, i: i % SAMPLES_PER_SLICE == SAMPLES_PER_SLICE - 1
            ).alias("_cuts"),
        )
    )
    return (
        join_groups(values, cuts, keys, "left")
        .withColumn(
            "_slice",
            F.when(F.col("_cuts").isNull(), 0).otherwise(
                bisect(F.col("_cuts"), lambda cut: cut <= F.col(value), 2 * MAX_SLICES)
            ),
        )
        .drop("_cuts")
    )


def value_ranks(
    df: DataFrame, keys: Sequence[str], value: str, limit: int | None = GROUP_ROWS
) -> DataFrame:
    """Distinct values per group with ``_freq`` and ``_rank``, the number of rows at or below.

    ``limit=None`` states that the groups are small.
    """
    known = df.filter(F.col(value).isNotNull())
    values = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_freq"))
    big = None if limit is None else oversized_groups(known, keys, limit)
    if big is None or big.isEmpty():
        upwards = Window.partitionBy(*keys).orderBy(value)
        return values.withColumn("_rank", F.sum("_freq").over(upwards))
    sliced = slice_by_value(values, keys, value, limit, big)
    return running_sum(sliced, keys, "_slice", [value], F.col("_freq"), "_rank").drop("_slice")


def value_at_rank(value: str, rank: Column) -> Column:
    """Aggregate over ``value_ranks`` rows: the value holding the 1-based ``rank``."""
    return F.min(F.when(F.col("_rank") >= rank, F.col(value)))


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    probs: Sequence[float],
    limit: int | None = GROUP_ROWS,
) -> DataFrame:
    """One row per group with an array of quantiles per column of ``values``.

    Linear interpolation between order statistics. ``limit=None`` states that the
    caller knows the groups to be small and saves the count.
    """
    if limit is None or oversized_groups(df, keys, limit).isEmpty():
        wanted = F.array(*(F.lit(float(p)) for p in probs))
        return df.groupBy(*keys).agg(*(F.percentile(v, wanted).alias(v) for v in values))
    result = df.select(*keys).distinct()
    for v in values:
        result = join_groups(result, _ranked_quantiles(df, keys, v, probs, limit), keys, "left")
    return result


def _ranked_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], limit: int
) -> DataFrame:
    ranks = value_ranks(df, keys, value, limit)
    sizes = df.groupBy(*keys).agg(F.count(value).alias("_n"))
    at = [(F.col("_n") - 1) * F.lit(float(p)) for p in probs]
    picks = []
    for i, h in enumerate(at):
        picks.append(value_at_rank(value, F.floor(h) + 1).alias(f"_low{i}"))
        picks.append(value_at_rank(value, F.ceil(h) + 1).alias(f"_high{i}"))
    found = join_groups(ranks, sizes, keys).groupBy(*keys, "_n").agg(*picks)
    quantiles = [
        F.col(f"_low{i}") + (h - F.floor(h)) * (F.col(f"_high{i}") - F.col(f"_low{i}"))
        for i, h in enumerate(at)
    ]
    return found.select(*keys, F.array(*quantiles).alias(value))


def median_of_counts(value: str, freq: str, prob: float = 0.5) -> Column:
    """Quantile aggregate over (value, how often) rows; holds one entry per distinct value."""
    return F.percentile(F.col(value), F.lit(prob), F.col(freq))

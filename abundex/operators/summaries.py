"""Cohort summary tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundex.functions.quantiles import median_of_counts


def distinct_counts(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Distinct values per group, NULL counting as a value."""
    counts = (
        (
            F.countDistinct(c) + F.max(F.when(F.col(c).isNull(), 1).otherwise(0))
        ).alias(f"n_{c}")
        for c in columns
    )
    return df.groupBy(*by).agg(*counts)


def duration_summary(samples: DataFrame) -> DataFrame:
    """Minimum, median and interquartile range of the subjects' last study day, per type.

    Works on how many subjects have which duration.
    """
    spread = (
        samples.filter(F.col("specimen_type").isNotNull())
        .groupBy("specimen_type", "subject_id")
        .agg(F.max("study_day").alias("duration"))
        .groupBy("specimen_type", "duration")
        .agg(F.count(F.lit(1)).alias("_subjects"))
        .filter(F.col("duration").isNotNull())
    )
    quantile = lambda p: median_of_counts("duration", "_subjects", p)
    return spread.groupBy("specimen_type").agg(
        F.min("duration").alias("min_duration"),
        quantile(0.5).alias("med_duration"),
        (quantile(0.75) - quantile(0.25)).alias("iqr_duration"),
    )


def exposure_load_summary(samples: DataFrame, history: DataFrame) -> DataFrame:
    """Median and interquartile range of the exposures per study day, per type."""
    keys = ["subject_id", "study_day"]
    days = samples.select("subject_id", "specimen_type", "study_day").distinct()
    current = F.filter(
        "abx_lagged", lambda e: (e["day_lag"] == 0) & e["abx_b"].isNotNull()
    )
    load = (
        days.filter(F.col("study_day") > 0)
        .join(history.select(*keys, F.size(current).alias("_now")), keys)
        .groupBy("specimen_type", "study_day")
        .agg(F.sum("_now").alias("abx_num"))
    )
    return load.groupBy("specimen_type").agg(
        F.percentile("abx_num", F.lit(0.5)).alias("med_abx_no"),
        (F.percentile("abx_num", F.lit(0.75)) - F.percentile("abx_num", F.lit(0.25))).alias(
            "iqr_abx_no"
        ),
    )

"""Sample selection, key reconciliation and merging of repeated specimens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from abundex.functions.expressions import join_groups, matches, padded_label
from abundex.functions.ordered import hash_order, hash_slice, row_number_in_slices
from abundex.schemas import AbundanceSet

REPEAT_KEYS = ("subject_id", "specimen_type", "study_day")


def key_intersection(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys found in both tables."""
    return left.select(key).intersect(right.select(key))


def reconcile_keys(data: AbundanceSet) -> AbundanceSet:
    """Keep samples with counts, counts with a sample, and features that occur."""
    sampled = data.counts.select("specimen_id2").distinct()
    known = data.samples.select("specimen_id2").filter(F.col("specimen_id2").isNotNull())
    counts = join_groups(data.counts, known, ["specimen_id2"], "left_semi")
    samples = data.samples.join(sampled, "specimen_id2", "left_semi")
    taxonomy = data.taxonomy.join(counts.select("otu_id").distinct(), "otu_id", "left_semi")
    return AbundanceSet(counts, samples, taxonomy)


def drop_null_subject(samples: DataFrame, col: str = "subject_id") -> DataFrame:
    return samples.filter(F.col(col).isNotNull())


def drop_by_pattern(
    samples: DataFrame, pattern: str = "Culture", col: str = "specimen_type"
) -> DataFrame:
    """Drop rows whose column matches; NULL does not match and stays."""
    return samples.filter(~matches(F.col(col), pattern))


def sample_sums(counts: DataFrame, by: str = "specimen_id2") -> DataFrame:
    """Total reads per sample, or per feature with ``by='otu_id'``."""
    return counts.groupBy(by).agg(F.sum("read_count").alias("total_reads"))


def drop_empty_samples(samples: DataFrame, counts: DataFrame) -> DataFrame:
    filled = counts.filter(F.col("read_count") > 0).select("specimen_id2").distinct()
    return samples.join(filled, "specimen_id2", "left_semi")


def feature_counts(counts: DataFrame) -> DataFrame:
    """Non-zero features per specimen."""
    return counts.groupBy("specimen_id2").agg(
        F.count_if(F.col("read_count") > 0).alias("n_features")
    )


def drop_low_feature_samples(
    samples: DataFrame, counts: DataFrame, min_features: int = 2
) -> DataFrame:
    rich = feature_counts(counts).filter(F.col("n_features") >= min_features)
    return samples.join(rich.select("specimen_id2"), "specimen_id2", "left_semi")


def observe_removed(df: DataFrame, removed: Column, observation: Observation) -> DataFrame:
    """Count the rows a filter is about to remove, in the job that runs the filter."""
    return df.observe(observation, F.count_if(removed).alias("removed"))


CLEANING_STEPS = ("null_subject", "pattern", "empty", "low_feature")


def removal_report(samples: DataFrame, counts: DataFrame, pattern: str = "Culture") -> DataFrame:
    """Rows each cleaning step removes, also where that is none."""
    found = (
        counts.filter(F.col("read_count") > 0)
        .groupBy("specimen_id2")
        .agg(F.count(F.lit(1)).alias("n_features"))
    )
    tagged = samples.join(found, "specimen_id2", "left").select(
        F.when(F.col("subject_id").isNull(), "null_subject")
        .when(matches(F.col("specimen_type"), pattern), "pattern")
        .when(F.col("n_features").isNull(), "empty")
        .when(F.col("n_features") < 2, "low_feature")
        .alias("step")
    )
    sums = tagged.agg(*(F.count_if(F.col("step") == step).alias(step) for step in CLEANING_STEPS))
    return sums.unpivot([], list(CLEANING_STEPS), "step", "removed")


def flag_duplicates(samples: DataFrame, keys: Sequence[str] = REPEAT_KEYS) -> DataFrame:
    """Add ``specimen_id3``, shared by the specimens of one subject, type and day."""
    groups = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(F.col("specimen_id2").cast("string")).alias("_first"),
    )
    own = F.col("specimen_id2").cast("string")
    return (
        join_groups(samples, groups, keys, "left")
        .withColumn(
            "specimen_id3", F.when(F.col("_n") > 1, F.concat("_first", F.lit("_D"))).otherwise(own)
        )
        .drop("_n", "_first")
    )


def merged_samples(flagged: DataFrame) -> DataFrame:
    """One row per ``specimen_id3``, with the metadata of its first specimen."""
    metadata = [c for c in flagged.columns if c not in ("specimen_id2", "specimen_id3")]
    first = F.min_by(F.struct(*metadata), F.col("specimen_id2").cast("string"))
    return (
        flagged.groupBy(F.col("specimen_id3").alias("specimen_id2"))
        .agg(first.alias("_first"))
        .select("specimen_id2", "_first.*")
    )


def merged_counts(counts: DataFrame, flagged: DataFrame) -> DataFrame:
    """Counts summed per ``specimen_id3``; specimens that are not in ``flagged`` drop."""
    return (
        counts.join(flagged.select("specimen_id2", "specimen_id3"), "specimen_id2")
        .groupBy(F.col("specimen_id3").alias("specimen_id2"), "otu_id")
        .agg(F.sum("read_count").alias("read_count"))
    )


def merge_duplicates(
    samples: DataFrame, counts: DataFrame, keys: Sequence[str] = REPEAT_KEYS
) -> tuple[DataFrame, DataFrame]:
    """Sum the counts of repeated specimens; the first specimen's metadata is kept."""
    flagged = flag_duplicates(samples, keys)
    return merged_samples(flagged), merged_counts(counts, flagged)


def samples_with_exposure(
    samples: DataFrame,
    exposures: DataFrame,
    on: Sequence[str] = ("subject_id", "collection_date"),
) -> DataFrame:
    return join_groups(samples, exposures.select(*on).distinct(), on, "left_semi").filter(
        F.col(on[0]).isNotNull()
    )


def surrogate_feature_keys(features: DataFrame, key: str = "seq", prefix: str = "sv") -> DataFrame:
    """Short names ``sv00001`` … for the distinct features.

    The numbering follows a hash of the feature, so that it can be done in even
    slices instead of one sorted pass.
    """
    distinct = features.select(key).distinct().withColumns(
        {"_order": hash_order(F.col(key)), "_slice": hash_slice(F.col(key))}
    )
    numbered = row_number_in_slices(distinct, [], "_slice", ["_order"], "_number")
    return numbered.select(key, padded_label(prefix, F.col("_number")).alias("otu_id"))


def non_empty(df: DataFrame, what: str) -> DataFrame:
    """``df`` itself, or ``ValueError`` when it has no rows."""
    if df.isEmpty():
        raise ValueError(f"no rows left: {what}")
    return df


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key; combined before the shuffle, unlike a row number."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_first")).select(*keys, "_first.*")


def record_index(
    df: DataFrame, keys: Sequence[str] = ("subject_id",), day: str = "study_day",
    tie: Sequence[str] = ("specimen_id2",),
) -> DataFrame:
    """Position of each row in its subject's ordered record."""
    return row_number_in_slices(df, keys, day, tie, "record")


def with_total_reads(counts: DataFrame) -> DataFrame:
    """Add the specimen's total to each of its rows."""
    return join_groups(counts, sample_sums(counts), ["specimen_id2"])

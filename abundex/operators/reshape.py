"""Long and wide forms, nesting, and completion of missing combinations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abundex.functions.expressions import join_groups, join_null_safe
from abundex.schemas import AbundanceSet

# Fixed value: characters that separate the names in a multi-value cell.
CELL_SEPARATOR = r"[^\p{Alnum}.]+"


def melt_join_dims(counts: DataFrame, samples: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Counts with the columns of their sample and their feature."""
    sampled = join_groups(counts, samples, ["specimen_id2"], "left")
    return join_groups(sampled, taxonomy, ["otu_id"], "left")


def phyloseq_to_agglomerated(
    data: AbundanceSet,
    sample_col: str = "specimen_id2",
    otu_col: str = "otu_id",
    count_col: str = "read_count",
) -> DataFrame:
    """One long frame of the three tables, under the column names asked for.

    Counts are sparse, so features that never occur have no rows to drop.
    """
    counts = data.counts.filter(F.col("read_count") > 0)
    return melt_join_dims(counts, data.samples, data.taxonomy).withColumnsRenamed(
        {"specimen_id2": sample_col, "otu_id": otu_col, "read_count": count_col}
    )


def agglomerated_to_phyloseq(
    agg: DataFrame, otu_col: str, sample_col: str, count_col: str, *ranks: str
) -> AbundanceSet:
    """The three tables a long frame was made of."""
    counts = agg.filter(F.col(otu_col).isNotNull()).select(
        F.col(sample_col).alias("specimen_id2"),
        F.col(otu_col).alias("otu_id"),
        F.col(count_col).alias("read_count"),
    )
    taxonomy = (
        agg.filter(F.col(otu_col).isNotNull())
        .select(F.col(otu_col).alias("otu_id"), *ranks)
        .distinct()
    )
    samples = (
        agg.drop(otu_col, count_col, *ranks)
        .withColumnRenamed(sample_col, "specimen_id2")
        .distinct()
    )
    return AbundanceSet(counts, samples, taxonomy)


def wide_counts(counts: DataFrame, features: Sequence[str]) -> DataFrame:
    """Samples x features for a given list of features, 0 where there is no count."""
    wide = counts.groupBy("specimen_id2").pivot("otu_id", list(features)).sum("read_count")
    return wide.fillna(0)


def nest(df: DataFrame, keys: Sequence[str], columns: Sequence[str], out: str) -> DataFrame:
    """Distinct rows per key as a sorted list-column.

    Meant for lists with a bounded vocabulary, such as the exposures of one day.
    """
    return df.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct(*columns))).alias(out))


def unnest(df: DataFrame, col: str) -> DataFrame:
    """List-column to rows; an empty or missing list gives one row of NULLs."""
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, F.inline_outer(col))


def gather(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], key: str, value: str
) -> DataFrame:
    return df.unpivot(list(ids), list(columns), key, value)


def names_in_cell(cell: Column) -> Column:
    """The names in a delimited cell; an empty name before a leading separator is dropped."""
    return F.filter(F.split(cell, CELL_SEPARATOR), lambda name: name != "")


def separate_exposures(df: DataFrame, col: str = "abx_b") -> DataFrame:
    """One row per name of a multi-value cell; a missing cell stays one row."""
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, F.explode_outer(names_in_cell(F.col(col))).alias(col))


def specimen_ids(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The identifying columns of a long frame, each combination once."""
    return df.select(*columns).distinct()


def pivot_exposures(
    df: DataFrame, ids: Sequence[str], exposures: Sequence[str], value: str = "abx_yn"
) -> DataFrame:
    """One 0/1 column per named exposure."""
    return df.groupBy(*ids).pivot("abx_lag", list(exposures)).agg(F.max(value)).fillna(
        0, list(exposures)
    )


def complete(df: DataFrame, columns: Sequence[str], fill: Mapping[str, object]) -> DataFrame:
    """Add the missing combinations of the values seen in ``columns``.

    The first column may have any number of values. The others are labels with a
    small vocabulary; their values are read once as a list, NULL among them.
    """
    key, *labels = columns
    grid = df.select(key).distinct()
    for label in labels:
        seen = df.agg(F.collect_set(F.struct(label)).alias("seen"))
        grid = grid.select("*", F.explode(seen.scalar()).alias("_value")).select(
            *grid.columns, F.col(f"_value.{label}").alias(label)
        )
    missing = join_null_safe(grid, df.select(*columns).distinct(), columns, "left_anti")
    filled = missing.withColumns({name: F.lit(value) for name, value in fill.items()})
    present = df.withColumns(
        {name: F.coalesce(F.col(name), F.lit(value)) for name, value in fill.items()}
    )
    return present.unionByName(filled, allowMissingColumns=True)

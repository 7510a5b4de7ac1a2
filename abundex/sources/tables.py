"""Readers and writers. Every reader takes an explicit schema; nothing is inferred."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abundex import schemas


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    fmt: str = "parquet",
    columns: Mapping[str, str] | None = None,
) -> DataFrame:
    """Read Parquet or CSV; ``columns`` maps a wanted name to the file's name for it."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("nullValue", "NA").option("emptyValue", "NA")
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    if columns is not None:
        df = df.select(*(F.col(file_name).alias(name) for name, file_name in columns.items()))
    return df


def read_counts(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    columns: Mapping[str, str] | None = None,
) -> DataFrame:
    """Sparse counts: one row per specimen and feature, zero counts left out."""
    schema = schemas.COUNTS if columns is None else None
    df = read_table(spark, path, schema, fmt, columns)
    return df.filter(F.col("read_count") > 0)


def counts_from_wide(
    df: DataFrame, features: Sequence[str], sample_col: str = "specimen_id2"
) -> DataFrame:
    """A samples x features table as sparse counts."""
    return df.unpivot([sample_col], list(features), "otu_id", "read_count").filter(
        F.col("read_count") > 0
    )


def read_taxonomy(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    columns: Mapping[str, str] | None = None,
) -> DataFrame:
    return read_table(spark, path, schemas.TAXONOMY if columns is None else None, fmt, columns)


def read_exposures(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    columns: Mapping[str, str] | None = None,
) -> DataFrame:
    return read_table(spark, path, schemas.EXPOSURES if columns is None else None, fmt, columns)


def read_samples(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    columns: Mapping[str, str] | None = None,
    labels: Sequence[str] = (
        "specimen_id2",
        "specimen_id",
        "specimen_type",
        "subject_id",
        "flow_cell_id",
    ),
) -> DataFrame:
    """Sample metadata, with the identifying columns as strings."""
    df = read_table(spark, path, schemas.SAMPLES if columns is None else None, fmt, columns)
    return df.withColumns({c: F.col(c).cast("string") for c in labels if c in df.columns})


def read_stains(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    columns: Mapping[str, str] | None = None,
) -> DataFrame:
    """Genus to stain; the genus column takes the name it is joined on."""
    df = read_table(spark, path, schemas.STAINS if columns is None else None, fmt, columns)
    return df.withColumnRenamed("dominant_genus", "Genus")


def write_draws(draws: DataFrame, path: str, model: str, mode: str = "overwrite") -> None:
    """Store one model's draws under its own partition, in place of those it has there, sorted
    so that a filter on ``parameter`` skips row groups."""
    (
        draws.withColumn("model", F.lit(model))
        .sortWithinPartitions("parameter", "draw")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model")
        .parquet(path)
    )


def read_draws(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    schema = T.StructType(schemas.DRAWS.fields + [T.StructField("model", T.StringType())])
    df = spark.read.schema(schema).parquet(path)
    return df if model is None else df.filter(F.col("model") == model).drop("model")

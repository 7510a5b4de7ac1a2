"""What the text operators share: reading tables, cleaning inputs, batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abundex.session import fresh_path, remove

# Words are runs of anything but these white-space characters.
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null as an empty one."""
    return F.coalesce(F.col(column), F.lit(""))


_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Remove the tables that are ``written`` inside; the caller takes those that stay out of the list."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(token)
        for path in made:
            remove(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, so that later steps read it back and do not recompute it."""
    path = fresh_path(df.sparkSession, name)
    if (made := _MADE.get()) is not None:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def map_rows(
    df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str, batch_rows: int = 4096
) -> DataFrame:
    """Apply a Python function to every row, batch by batch.

    ``make`` runs once per task and returns a function of a row's columns that yields
    output tuples in the order of ``schema``; output leaves in batches of ``batch_rows``.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_fn, out = make(), []
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                out.extend(row_fn(*row))
                if len(out) >= batch_rows:
                    yield as_batch(out, arrow)
                    out = []
        if out:
            yield as_batch(out, arrow)

    return df.mapInArrow(run, schema)


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(values, type=field.type) for values, field in zip(columns, schema, strict=True)], schema=schema
    )

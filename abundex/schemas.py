"""Table schemas and the two containers passed between operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


COUNTS = _struct(
    specimen_id2=T.StringType(), otu_id=T.StringType(), read_count=T.LongType()
)
TAXONOMY = _struct(
    otu_id=T.StringType(),
    Kingdom=T.StringType(),
    Phylum=T.StringType(),
    Class=T.StringType(),
    Order=T.StringType(),
    Family=T.StringType(),
    Genus=T.StringType(),
    Species=T.StringType(),
)
SAMPLES = _struct(
    specimen_id2=T.StringType(),
    specimen_id=T.StringType(),
    specimen_type=T.StringType(),
    subject_id=T.StringType(),
    flow_cell_id=T.StringType(),
    study_day=T.IntegerType(),
    enroll_date=T.DateType(),
    collection_date=T.DateType(),
)
EXPOSURES = _struct(
    subject_id=T.StringType(),
    collection_date=T.DateType(),
    abx_b=T.StringType(),
    abx_b_number=T.IntegerType(),
)
STAINS = _struct(dominant_genus=T.StringType(), stain=T.StringType())
DRAWS = _struct(
    chain=T.IntegerType(),
    iteration=T.IntegerType(),
    draw=T.LongType(),
    parameter=T.StringType(),
    value=T.DoubleType(),
)
SAMPLER = _struct(
    chain=T.IntegerType(),
    iteration=T.IntegerType(),
    divergent=T.IntegerType(),
    treedepth=T.IntegerType(),
    energy=T.DoubleType(),
)


@dataclass(frozen=True)
class AbundanceSet:
    """Sparse counts with the sample and feature tables they refer to."""

    counts: DataFrame
    samples: DataFrame
    taxonomy: DataFrame


@dataclass(frozen=True)
class ModelFrame:
    """Regression input: one row per specimen, and the ones of its exposure indicators.

    ``rows`` holds the long frame both come from, ``kept`` the exposures that
    passed the keep rule.
    """

    obs: DataFrame
    design: DataFrame
    rows: DataFrame
    kept: DataFrame

"""Regression frames: response, lagged response and sparse exposure indicators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abundex.functions.expressions import join_groups, null_or_not_equal, truncated
from abundex.functions.ordered import running_sum
from abundex.functions.quantiles import (
    GROUP_ROWS,
    median_of_counts,
    oversized_groups,
    slice_by_value,
)
from abundex.operators.clean import non_empty
from abundex.operators.diversity import hill_diversity, lagged_response, response_ratio
from abundex.operators.exposure import DAY_KEYS, indicator
from abundex.operators.reshape import unnest
from abundex.schemas import ModelFrame
from abundex.session import cut_lineage

SPECIMEN_COLUMNS = ("specimen_id2", "subject_id", "specimen_type", "study_day")


def specimen_type_filter(df: DataFrame, specimen_type: str) -> DataFrame:
    return df.filter(F.col("specimen_type") == specimen_type)


def response_rows(
    samples: DataFrame, diversity: DataFrame, history: DataFrame, specimen_type: str
) -> DataFrame:
    """Specimens of one type on days with an exposure record, with D1, D1_lag and history.

    The type is filtered before the lag: the previous specimen is the previous one
    of the same type. ``history`` has one row per subject and day; it is wide, so it joins last,
    and the type, now the same for all, is not shuffled.
    """
    keys = list(DAY_KEYS)
    specimens = specimen_type_filter(samples.select(*SPECIMEN_COLUMNS), specimen_type).drop("specimen_type")
    recorded = specimens.join(history.select(*keys), keys, "left_semi")
    lagged = response_ratio(lagged_response(recorded.join(diversity, "specimen_id2", "left")))
    kind = F.lit(specimen_type).cast(samples.schema["specimen_type"].dataType).alias("specimen_type")
    ours = [c for c in lagged.columns if c not in SPECIMEN_COLUMNS]
    theirs = [c for c in history.columns if c not in keys]
    return lagged.join(history, keys).select("specimen_id2", *keys, kind, *theirs, *ours)


def exposure_rows(
    responses: DataFrame, max_lag: int | None = None, max_continuous: int | None = None
) -> DataFrame:
    """One row per specimen and exposure, with ``k`` the lag or the run length.

    With ``max_continuous`` only the exposures of the day itself are kept, and
    longer runs count as ``max_continuous``.
    """
    rows = unnest(responses, "abx_lagged")
    if max_continuous is None:
        rows = rows.filter(F.col("day_lag") <= max_lag).withColumn("k", F.col("day_lag").cast("long"))
    else:
        rows = rows.filter(F.col("day_lag") == 0).withColumn(
            "continuous", truncated(F.col("continuous"), max_continuous)
        )
        rows = rows.withColumn("k", F.col("continuous").cast("long"))
    return indicator(rows).withColumnsRenamed(
        {"specimen_id2": "specimens", "subject_id": "subjects", "abx_b": "abx_lag"}
    )


def exposure_keep_rule(
    rows: DataFrame, min_subjects: int = 2, min_median: float = 2
) -> DataFrame:
    """Exposures given to at least ``min_subjects`` subjects, with a median of at
    least ``min_median`` records per subject.

    The median runs over "how many subjects have n records", not over the subjects.
    """
    current = rows.filter((F.col("abx_lag") != "none") & (F.col("day_lag") == 0))
    per_subject = current.groupBy("abx_lag", "subjects").agg(F.count(F.lit(1)).alias("_n"))
    spread = per_subject.groupBy("abx_lag", "_n").agg(F.count(F.lit(1)).alias("_subjects"))
    return (
        spread.groupBy("abx_lag")
        .agg(
            F.sum("_subjects").alias("n_subjects"),
            median_of_counts("_n", "_subjects").alias("median_n"),
        )
        .filter((F.col("n_subjects") >= min_subjects) & (F.col("median_n") >= min_median))
    )


def exposed_subjects(rows: DataFrame, kept: DataFrame) -> DataFrame:
    return rows.join(kept.select("abx_lag"), "abx_lag", "left_semi").select("subjects").distinct()


def keep_subjects(rows: DataFrame, kept: DataFrame, exposed: DataFrame | None = None) -> DataFrame:
    """Rows of the subjects that have any kept exposure; ``exposed`` are these subjects where they are known."""
    exposed = exposed_subjects(rows, kept) if exposed is None else exposed
    return join_groups(rows, exposed, ["subjects"], "left_semi")


def design_tensor(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The ones of the specimen x exposure x k indicator; rows without k are left out."""
    present = rows.filter((F.col("abx_yn") == 1) & F.col("k").isNotNull())
    kept_only = present.join(kept.select("abx_lag"), "abx_lag", "left_semi")
    return kept_only.select("specimens", "subjects", "abx_lag", "k").distinct()


def model_frame(
    samples: DataFrame,
    diversity: DataFrame,
    history: DataFrame,
    specimen_type: str,
    response: str = "D1",
    min_subjects: int = 2,
    min_median: float = 2,
    max_lag: int | None = 3,
    max_continuous: int | None = None,
    check: bool = False,
    write: bool = True,
) -> ModelFrame:
    """The frame of one specimen type.

    ``response`` is ``D1_delta`` (ratio to the previous specimen) or ``D1`` (with
    D1_lag as a predictor). ``max_continuous`` switches k from lag to run length.
    The responses feed the keep rule, the observations and the design; ``write``
    puts them, the kept exposures and their subjects in the shared folder once instead of
    computing D1, the history and the rule for each of those. Of the history only the lags that
    the frame reads are joined.
    """
    last = max_lag if max_continuous is None else 0
    read = F.filter("abx_lagged", lambda e: e["day_lag"] <= last)
    responses = response_rows(samples, diversity, history.withColumn("abx_lagged", read), specimen_type)
    if write:
        responses = cut_lineage(responses)
    rows = exposure_rows(responses, max_lag, max_continuous)
    kept = exposure_keep_rule(rows, min_subjects, min_median)
    if write:
        kept = cut_lineage(kept)
    exposed = exposed_subjects(rows, kept)
    rows = keep_subjects(rows, kept, cut_lineage(exposed) if write else exposed)
    if check:
        rows = non_empty(rows, f"no subject of type {specimen_type} has a kept exposure")
    columns = ["specimens", "subjects"]
    columns += ["D1_delta"] if response == "D1_delta" else ["D1", "D1_lag"]
    return ModelFrame(rows.select(*columns).distinct(), design_tensor(rows, kept), rows, kept)


def gen_ratio(samples: DataFrame, diversity: DataFrame, history: DataFrame, specimen_type: str, **options) -> ModelFrame:
    """D1_delta with lagged exposures."""
    return model_frame(samples, diversity, history, specimen_type, "D1_delta", **options)


def gen_lag(samples: DataFrame, diversity: DataFrame, history: DataFrame, specimen_type: str, **options) -> ModelFrame:
    """D1 and D1_lag with lagged exposures."""
    return model_frame(samples, diversity, history, specimen_type, "D1", **options)


def gen_continuous(
    samples: DataFrame,
    diversity: DataFrame,
    history: DataFrame,
    specimen_type: str,
    max_continuous: int = 5,
    **options,
) -> ModelFrame:
    """D1 and D1_lag with the length of the running exposure."""
    return model_frame(
        samples, diversity, history, specimen_type, "D1", max_continuous=max_continuous, **options
    )


def cohort(samples: DataFrame, dominant: DataFrame, genus: str, high: bool) -> DataFrame:
    """Samples of the subjects whose dominant genus is, or is not, ``genus``.

    A subject without a dominant genus belongs to the low cohort.
    """
    keys = ["subject_id", "specimen_type"]
    joined = join_groups(samples, dominant.select(*keys, "dominant_genus"), keys, "left")
    is_high = F.col("dominant_genus") == genus
    rule = is_high if high else null_or_not_equal(F.col("dominant_genus"), genus)
    return joined.filter(rule).drop("dominant_genus")


def frame_dims(frame: ModelFrame) -> DataFrame:
    """Sizes of the frame: specimens, subjects, exposures, and values of k."""
    sizes = frame.rows.agg(
        F.countDistinct("specimens").alias("n_specimens"),
        F.countDistinct("subjects").alias("n_subjects"),
        F.countDistinct("k").alias("n_k"),
    )
    return sizes.withColumn("n_abx", frame.kept.agg(F.count(F.lit(1))).scalar())


def label_index(df: DataFrame, col: str, limit: int = GROUP_ROWS) -> DataFrame:
    """1-based codes of the distinct labels in sorted order.

    A label set small enough for one task is numbered there; a larger one in slices.
    """
    labels = df.select(col).distinct().filter(F.col(col).isNotNull())
    one = labels.withColumn("_all", F.lit(0))
    big = oversized_groups(one, ["_all"], limit)
    if big.isEmpty():
        return labels.withColumn("idx", F.row_number().over(Window.orderBy(col)).cast("long"))
    sliced = slice_by_value(one, ["_all"], col, limit, big)
    numbered = running_sum(sliced, ["_all"], "_slice", [col], F.lit(1).cast("long"), "idx")
    return numbered.select(col, "idx")


def compose(frame: ModelFrame, columns: Sequence[str] = ("specimens", "subjects")) -> DataFrame:
    """The observations with integer codes for their labels."""
    coded = frame.obs
    for col in columns:
        index = label_index(frame.obs, col).withColumnRenamed("idx", f"{col}_idx")
        coded = coded.join(index, col)
    return coded


def dense_design(design: DataFrame) -> DataFrame:
    """Indicator with its zeros, over the exposures and values of k that occur.

    Exposures and k are short label lists, read once; the rows are the specimens'.
    """
    grid = design.select("specimens", "subjects").distinct()
    for label in ("abx_lag", "k"):
        seen = design.agg(F.collect_set(label).alias("seen"))
        grid = grid.withColumn(label, F.explode(seen.scalar()))
    ones = design.withColumn("value", F.lit(1))
    keys = ["specimens", "subjects", "abx_lag", "k"]
    return grid.join(ones, keys, "left").fillna(0, ["value"])

"""Posterior draws: index spreading, contrasts, intervals, result tables and rollouts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abundex.functions.expressions import quotient, recoded
from abundex.functions.ordered import block_slice, row_number_in_slices
from abundex.functions.quantiles import GROUP_ROWS, group_quantiles
from abundex.operators.reshape import nest
from abundex.session import cut_lineage

REFERENCE_LAG = 3.0
RECORDS_PER_BLOCK = 1_000
_SPEC = re.compile(r"^(?P<name>[^\[\]]+)(?:\[(?P<index>[^\]]*)\])?$")


def _parse(spec: str) -> tuple[str, tuple[str, ...]]:
    found = _SPEC.match(spec.replace(" ", ""))
    if found is None:
        raise ValueError(f"not a parameter: {spec!r}")
    index = found["index"]
    return found["name"], tuple(index.split(",")) if index else ()


def base_name(parameter: Column) -> Column:
    return F.substring_index(parameter, "[", 1)


def _spread_one_index_set(
    draws: DataFrame, names: Sequence[str], index: Sequence[str]
) -> DataFrame:
    """The named parameters, which share their indices, one column each."""
    parameter = F.col("parameter")
    if not index:
        rows = draws.filter(parameter.isin(list(names)))
    else:
        wanted = F.lit(False)
        for name in names:
            wanted = wanted | parameter.startswith(f"{name}[")
        parts = F.split(F.regexp_extract(parameter, r"\[(.*)\]$", 1), ",")
        rows = draws.filter(wanted).select(
            "draw",
            base_name(parameter).alias("parameter"),
            "value",
            *(F.get(parts, F.lit(n)).cast("int").alias(i) for n, i in enumerate(index)),
        )
    if len(names) == 1:
        return rows.select("draw", *index, F.col("value").alias(names[0]))
    picks = (F.max(F.when(F.col("parameter") == n, F.col("value"))).alias(n) for n in names)
    return rows.groupBy("draw", *index).agg(*picks)


def spread_draws(draws: DataFrame, *specs: str) -> DataFrame:
    """Parameters such as ``b[i,j,k]`` as columns, joined on the draw and shared indices.

    Parameters with the same indices are read in one pass; the others are joined
    from the longest index list down, so a join never multiplies rows unless two
    parameters share no index at all.
    """
    by_index: dict[tuple[str, ...], list[str]] = {}
    for spec in specs:
        name, index = _parse(spec)
        by_index.setdefault(index, []).append(name)
    result: DataFrame | None = None
    for index in sorted(by_index, key=len, reverse=True):
        part = _spread_one_index_set(draws, by_index[index], index)
        if result is None:
            result = part
        else:
            shared = ["draw", *(i for i in index if i in result.columns)]
            result = result.join(part, shared)
    return result


def effect_contrast(
    df: DataFrame,
    effect: str = "b_abx2",
    lag_term: str | None = "b_lag",
    reference_lag: float = REFERENCE_LAG,
    kind: str = "ratio",
) -> DataFrame:
    """Add the response with and without the exposure, and their ``difference``.

    ``kind``: ``ratio`` or ``difference`` of the responses, or ``log`` for the
    difference of the linear predictors.
    """
    lag = F.col(lag_term) if lag_term is not None else None
    with_effect, without, difference = contrast(F.col("a"), F.col("a_subj"), lag, F.col(effect), reference_lag, kind)
    return df.withColumns(
        {"with_abx": with_effect, "without_abx": without, "difference": difference}
    )


def contrast(
    a: Column, a_subj: Column, lag: Column | None, effect: Column, reference_lag: float = REFERENCE_LAG, kind: str = "ratio"
) -> tuple[Column, Column, Column]:
    """The response with and without the effect, and their difference of this ``kind``."""
    without = a + a_subj
    if lag is not None:
        without = without + lag * F.lit(reference_lag)
    with_effect = without + effect
    if kind != "log":
        without, with_effect = F.exp(without), F.exp(with_effect)
    return with_effect, without, with_effect / without if kind == "ratio" else with_effect - without


def median_qi(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    width: float = 0.5,
    limit: int | None = GROUP_ROWS,
) -> DataFrame:
    """Median and equal-tailed interval per group: ``x, x_lower, x_upper``."""
    probs = [0.5, (1 - width) / 2, (1 + width) / 2]
    found = group_quantiles(df, keys, values, probs, limit)
    columns = []
    for v in values:
        columns += [
            F.col(v)[0].alias(v),
            F.col(v)[1].alias(f"{v}_lower"),
            F.col(v)[2].alias(f"{v}_upper"),
        ]
    return found.select(*keys, *columns)


def interval_limit(draws: DataFrame, limit: int = GROUP_ROWS) -> int | None:
    """The ``limit`` for ``median_qi`` over indexed parameters of these draws.

    A parameter has one value per draw, so the number of draws bounds every group.
    """
    return None if draws.select("draw").distinct().count() <= limit else limit


def scale_summary(
    draws: DataFrame, width: float = 0.5, spec: str = "s_abx2[j]", limit: int | None = GROUP_ROWS
) -> DataFrame:
    """Interval of an indexed scale parameter."""
    name, index = _parse(spec)
    return median_qi(spread_draws(draws, spec), index, [name], width, limit)


def cumulative_effect(
    df: DataFrame,
    effect: str = "b_abx2",
    keys: Sequence[str] = ("draw", "i", "j"),
    order: str = "k",
    out: str = "b_abx_agg",
) -> DataFrame:
    """Running sum of the effect over k, within one draw, subject and exposure."""
    upto = (
        Window.partitionBy(*keys)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return df.withColumn(out, F.sum(effect).over(upto))


def observed_distinct(rows: DataFrame) -> DataFrame:
    """Subject, exposure and k combinations that occur in a frame."""
    return rows.select("subjects", "abx_lag", "k").distinct()


def observed_combos(
    effects: DataFrame, observed: DataFrame, on: Mapping[str, str] | None = None
) -> DataFrame:
    """Effect rows whose combination was observed; ``on`` maps effect to observed columns."""
    names = on or {c: c for c in ("subjects", "abx_lag", "k")}
    seen = observed.select(*(F.col(theirs).alias(ours) for ours, theirs in names.items())).distinct()
    return effects.join(seen, list(names), "left_semi")


def flag_observed(
    effects: DataFrame, observed: DataFrame, on: Mapping[str, str] | None = None
) -> DataFrame:
    """All effect rows, with ``observed`` true or false."""
    names = on or {c: c for c in ("subjects", "abx_lag", "k")}
    seen = observed.select(*(F.col(theirs).alias(ours) for ours, theirs in names.items())).distinct()
    marked = effects.join(seen.withColumn("observed", F.lit(True)), list(names), "left")
    return marked.withColumn("observed", F.coalesce("observed", F.lit(False)))


def subject_covariate_join(
    effects: DataFrame, covariate: DataFrame, rows: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """Effects with a baseline covariate of the subjects that are in the frame."""
    known = covariate.select("subjects", *columns).distinct()
    in_frame = known.join(rows.select("subjects").distinct(), "subjects", "left_semi")
    return effects.join(in_frame, "subjects", "left")


def labelled(df: DataFrame, index: DataFrame, idx_col: str, label_col: str) -> DataFrame:
    """Replace a 1-based code by its label; codes without a label drop."""
    names = index.select(F.col("idx").cast("int").alias(idx_col), F.col(index.columns[0]).alias(label_col))
    return df.join(names, idx_col).drop(idx_col)


def all_labelled(
    effects: DataFrame, subject_index: DataFrame, exposure_index: DataFrame, k_index: DataFrame
) -> DataFrame:
    """Effects under the labels of subject, exposure and k."""
    named = labelled(labelled(effects, subject_index, "i", "subjects"), exposure_index, "j", "abx_lag")
    return labelled(named.withColumnRenamed("k", "_k"), k_index, "_k", "k")


def block_effects(
    blocks: DataFrame, values: Sequence[str], width: float = 0.5, reference_lag: float = REFERENCE_LAG
) -> DataFrame:
    """Intervals of ``b_abx2`` or of the ``difference`` it makes, per i, j and k, from draws in blocks."""
    from abundex.operators.drawblocks import block_intervals, count_draws, spread_blocks

    def ratio(d: Column) -> Column:
        return contrast(d["a"], d["a_subj"], d["b_lag"], d["b_abx2"], reference_lag)[2]

    spread = spread_blocks(blocks, "a", "b_lag", "a_subj[i]", "b_abx2[i,j,k]")
    rows = spread.withColumn("difference", F.transform(F.arrays_zip("a", "a_subj", "b_lag", "b_abx2"), ratio))
    return block_intervals(rows, ["i", "j", "k"], values, count_draws(blocks), width)


def effect_table(
    blocks: DataFrame,
    rows: DataFrame,
    subject_index: DataFrame,
    exposure_index: DataFrame,
    k_index: DataFrame,
    covariate: DataFrame | None = None,
    covariate_columns: Sequence[str] = (),
    exposures: Sequence[str] | None = None,
    labels: Mapping[str, str] | None = None,
    width: float = 0.5,
    reference_lag: float = REFERENCE_LAG,
) -> DataFrame:
    """Effect ratio per subject, exposure and k, for the observed combinations.

    ``blocks`` are the draws of ``draw_blocks``. The fitted indices i, j and k are codes; each is
    turned back into its label.
    """
    effects = block_effects(blocks, ["difference"], width, reference_lag)
    named = all_labelled(effects, subject_index, exposure_index, k_index)
    result = observed_combos(named, observed_distinct(rows))
    if covariate is not None:
        result = subject_covariate_join(result, covariate, rows, covariate_columns)
    if exposures is not None:
        result = result.filter(F.col("abx_lag").isin(list(exposures)))
    return result.withColumn("abx_lag", recoded(F.col("abx_lag"), labels or {}))


def sample_groups(df: DataFrame, n: int, seed: int = 1988, key: str = "draw") -> DataFrame:
    """``n`` draws picked by a seeded hash; there must be as many."""
    found = df.select(key).distinct().limit(n).count()
    if found < n:
        raise ValueError(f"{n} draws wanted, {found} found")
    picked = (
        df.select(key)
        .distinct()
        .orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key)
        .limit(n)
    )
    return picked.select(key)


def draw_group_index(df: DataFrame, key: str = "specimen_id2", draw: str = "draw") -> DataFrame:
    """Position of each draw within its specimen."""
    sliced = df.withColumn("_slice", block_slice(F.col(draw)))
    return row_number_in_slices(sliced, [key], "_slice", [draw], "group").drop("_slice")


Link = Callable[[Column, Column], Column]
PythonLink = Callable[[pd.DataFrame, dict, np.ndarray], np.ndarray]


def _series_blocks(specimens: DataFrame, block: int) -> DataFrame:
    """Per subject, its specimens in order of day, as lists of at most ``block`` records."""
    numbered = row_number_in_slices(
        specimens, ["subject_id"], "study_day", ["specimen_id2"], "_record"
    ).withColumn("_block", F.floor((F.col("_record") - 1) / block))
    fields = ["_record", *specimens.columns]
    return nest(numbered, ["subject_id", "_block"], fields, "_series")


def _python_fold(link: PythonLink, params: Sequence[str]):
    """Predictions as lists; a row with a null parameter or start has nulls, and NaN stays NaN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrow in batches:
            batch = arrow.to_pandas()
            rows: list[np.ndarray] = [np.empty(0)] * len(batch)
            for _, part in batch.groupby("subject_id", sort=False):
                previous = part["_previous"].to_numpy(dtype=float)
                columns = []
                for specimen in part["_series"].iloc[0]:
                    previous = np.asarray(link(part[list(params)], dict(specimen), previous))
                    columns.append(previous)
                for at, row in zip(part.index, np.column_stack(columns), strict=True):
                    rows[at] = row
            sizes = [len(row) for row in rows]
            unknown = np.zeros(len(rows), bool)
            for name in (*params, "_previous"):
                unknown |= arrow.column(name).is_null().to_numpy(zero_copy_only=False)
            values = np.concatenate([*rows, np.empty(0)]).astype(float)
            flat = pa.array(values, pa.float64(), mask=np.repeat(unknown, sizes), from_pandas=False)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), flat)
            keys = [arrow.column("draw"), arrow.column("subject_id")]
            yield pa.RecordBatch.from_arrays([*keys, lists], names=["draw", "subject_id", "_pred"])

    return run


def pp_rollout(
    draws: DataFrame,
    specimens: DataFrame,
    link: Link | PythonLink,
    start: str = "lag_emp_prop",
    python: bool = False,
    block: int = RECORDS_PER_BLOCK,
) -> DataFrame:
    """Forward prediction per draw along each subject's specimens.

    ``pred[1] = link(specimen 1, start)``, then ``pred[n] = link(specimen n, pred[n-1])``.
    ``draws`` has one row per draw and subject with the parameter columns. A column
    link gets the specimen as a struct and the previous value, and may use the
    parameter columns; a Python link gets the parameters of a batch of draws, the
    specimen as a dict and the previous values. The steps of one draw follow each
    other, so the work is spread over draws. A series longer than ``block``
    records goes block by block, handing on the last prediction.
    """
    series = _series_blocks(specimens, block)
    blocks = series.agg(F.max("_block")).first()[0]
    params = [c for c in draws.columns if c not in ("draw", "subject_id")]
    previous: DataFrame | None = None
    parts = []
    for number in range(0 if blocks is None else int(blocks) + 1):
        here = draws.join(series.filter(F.col("_block") == number).drop("_block"), "subject_id")
        if previous is None:
            here = here.withColumn("_previous", F.col("_series")[0][start])
        else:
            here = here.join(previous, ["draw", "subject_id"])
        if python:
            schema = f"draw {draws.schema['draw'].dataType.simpleString()}, subject_id " \
                f"{draws.schema['subject_id'].dataType.simpleString()}, _pred array<double>"
            folded = here.mapInArrow(_python_fold(link, params), schema)
            rows = folded.join(
                series.filter(F.col("_block") == number).drop("_block"), "subject_id"
            )
        else:
            rows = here.withColumn(
                "_pred",
                F.aggregate(
                    "_series",
                    F.array().cast("array<double>"),
                    lambda done, specimen: F.concat(
                        done,
                        F.array(
                            link(
                                specimen,
                                F.when(F.size(done) == 0, F.col("_previous")).otherwise(
                                    F.get(done, F.size(done) - 1)
                                ),
                            ).cast("double")
                        ),
                    ),
                ),
            )
        if number < blocks:
            rows = cut_lineage(rows.select("draw", "subject_id", "_series", "_pred"))
            previous = rows.select("draw", "subject_id", F.element_at("_pred", -1).alias("_previous"))
        pairs = F.explode(F.arrays_zip(F.col("_series"), F.col("_pred"))).alias("_step")
        parts.append(rows.select("draw", pairs))
    wanted = [F.col(f"_step._series.{c}").alias(c) for c in specimens.columns]
    result = None
    for part in parts:
        rows = part.select("draw", *wanted, F.col("_step._pred").alias("pred_prob"))
        result = rows if result is None else result.unionByName(rows)
    if result is None:
        raise ValueError("no specimens to predict")
    return result


def with_empirical(df: DataFrame) -> DataFrame:
    """Add the observed share next to the predicted one; without any reads it is NaN."""
    return df.withColumn("emp_prob", quotient(F.col("read_count"), F.col("total_reads")))

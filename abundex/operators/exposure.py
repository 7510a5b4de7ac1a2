"""Subject spans, sub-subjects, exposure cleaning, lag histories and run lengths.

Everything ordered by day works on one row per subject and day. That table is
built first, with a partial aggregate, and a subject has no more rows in it than
days were recorded, however many exposure rows it came from.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from abundex.functions.expressions import days_between, join_groups, recoded
from abundex.operators.reshape import names_in_cell, unnest

# The component that stands for a combined product …
COFORMULATIONS = {
    "clavulanate": "amoxicillin.clavulanate",
    "sulbactam": "ampicillin.sulbactam",
    "tazobactam": "piperacillin.tazobactam",
    "trimethoprim": "trimethoprim.sulfamethoxazole",
}
# … the component dropped on days its combination is present …
SUPPRESSED_BY = {
    "amoxicillin": "amoxicillin.clavulanate",
    "ampicillin": "ampicillin.sulbactam",
    "sulfamethoxazole": "trimethoprim.sulfamethoxazole",
}
# … and the names dropped always.
ALWAYS_DROPPED = ("piperacillin",)
FIRST_STUDY_DAY = -7
DAY_KEYS = ("subject_id", "study_day")


@dataclass(frozen=True)
class EpisodeRule:
    """Days ``first_day … last_day`` of a subject become ``new_subject_id``, shifted by ``offset``.

    An end that is ``None`` is open.
    """

    subject_id: str
    first_day: int | None
    last_day: int | None
    new_subject_id: str
    offset: int = 0


def subject_span(samples: DataFrame) -> DataFrame:
    """Enrolment and exit date per subject.

    The window sees one row per subject and enrolment date.
    """
    ends = samples.groupBy("subject_id", "enroll_date").agg(F.max("collection_date").alias("_end"))
    last = F.max("_end").over(Window.partitionBy("subject_id"))
    return ends.select("subject_id", "enroll_date", last.alias("exit_date"))


def exposure_right_join(spans: DataFrame, exposures: DataFrame) -> DataFrame:
    """Every exposure row, with its subject's span and its study day."""
    joined = join_groups(exposures, spans, ["subject_id"], "left")
    return joined.withColumn(
        "study_day", days_between(F.col("collection_date"), F.col("enroll_date"))
    )


def exit_day(df: DataFrame) -> DataFrame:
    """Add the study day of the subject's row on its exit date."""
    at_exit = (
        df.filter(F.col("collection_date") == F.col("exit_date"))
        .groupBy("subject_id")
        .agg(F.max("study_day").alias("exit_day"))
    )
    return join_groups(df, at_exit, ["subject_id"], "left")


def study_window_filter(df: DataFrame, after: int = FIRST_STUDY_DAY) -> DataFrame:
    """Rows after day ``after`` and not beyond the exit date; NULL days drop."""
    return df.filter(
        (F.col("study_day") > after) & (F.col("collection_date") <= F.col("exit_date"))
    )


def episode_rules(spark: SparkSession, rules: Sequence[EpisodeRule]) -> DataFrame:
    """The rules as one row per subject, in the order given."""
    rows = [
        (r.subject_id, n, r.first_day, r.last_day, r.new_subject_id, r.offset)
        for n, r in enumerate(rules)
    ]
    table = spark.createDataFrame(
        rows,
        "subject_id string, rule int, first_day int, last_day int, new_subject_id string, offset int",
    )
    fields = F.struct("rule", "first_day", "last_day", "new_subject_id", "offset")
    return table.groupBy("subject_id").agg(F.sort_array(F.collect_list(fields)).alias("_rules"))


def episode_rekey(
    df: DataFrame, rules: Sequence[EpisodeRule], shifted: Sequence[str] = ("study_day",)
) -> DataFrame:
    """Split the subjects named in ``rules``; their rows outside every rule drop.

    The first rule that covers the day counts. The rule table is a handful of
    configured rows; Spark broadcasts it after seeing its size.
    """
    if not rules:
        return df
    covering = F.filter(
        "_rules",
        lambda r: F.coalesce(F.col("study_day") >= r["first_day"], r["first_day"].isNull())
        & F.coalesce(F.col("study_day") <= r["last_day"], r["last_day"].isNull()),
    )
    joined = df.join(episode_rules(df.sparkSession, rules), "subject_id", "left").withColumn(
        "_rule", F.get(covering, 0)
    )
    kept = joined.filter(F.col("_rules").isNull() | F.col("_rule").isNotNull())
    offset = F.coalesce(F.col("_rule.offset"), F.lit(0))
    return kept.withColumns(
        {
            **{c: F.col(c) - offset for c in shifted},
            "subject_id": F.coalesce("_rule.new_subject_id", "subject_id"),
        }
    ).select(*df.columns)


def coformulation_map(name: Column, combined: Mapping[str, str] = COFORMULATIONS) -> Column:
    """The combined product a component stands for, or the name itself."""
    return recoded(name, combined)


def always_dropped(name: Column, dropped: Sequence[str] = ALWAYS_DROPPED) -> Column:
    """True for the listed names; NULL is not one of them."""
    return F.coalesce(name.isin(list(dropped)), F.lit(False))


def suppress_components(
    names: Column, suppressed_by: Mapping[str, str] = SUPPRESSED_BY
) -> Column:
    """Drop a component when its combination is in the same array; NULL entries stay."""
    if not suppressed_by:
        return names
    combination = F.create_map(*(F.lit(x) for pair in suppressed_by.items() for x in pair))
    return F.filter(
        names,
        lambda name: ~F.coalesce(
            F.array_contains(names, F.try_element_at(combination, name)), F.lit(False)
        ),
    )


def exposure_days(
    exposures: DataFrame,
    keys: Sequence[str] = DAY_KEYS,
    combined: Mapping[str, str] = COFORMULATIONS,
    suppressed_by: Mapping[str, str] = SUPPRESSED_BY,
    dropped: Sequence[str] = ALWAYS_DROPPED,
) -> DataFrame:
    """One row per key with the array ``abx`` of its cleaned exposure names.

    Cells are split, names mapped and dropped row by row, and the rest collected as
    a set before and after the shuffle, so the array is never longer than the list
    of known exposures. A NULL entry stands for a record without exposure, as
    does a cell that holds no name. Days
    whose names are all dropped vanish. A dropped name that still has to suppress
    another one is taken out last.
    """
    named = names_in_cell(F.col("abx_b"))
    tokens = F.when(F.size(named) > 0, named).otherwise(F.array(F.lit(None).cast("string")))
    needed = set(suppressed_by.values())
    early = [name for name in dropped if name not in needed]
    late = [name for name in dropped if name in needed]
    name = F.col("_name")
    sets = (
        exposures.select(*keys, F.explode(tokens).alias("_name"))
        .withColumn("_name", coformulation_map(name, combined))
        .filter(~always_dropped(name, early))
        .groupBy(*keys)
        .agg(F.collect_set(F.struct("_name")).alias("_set"))
        .select(*keys, suppress_components(F.col("_set._name"), suppressed_by).alias("abx"))
    )
    if late:
        sets = sets.withColumn("abx", F.filter("abx", lambda n: ~always_dropped(n, late))).filter(
            F.size("abx") > 0
        )
    return sets.withColumn("abx", F.sort_array("abx"))


def indicator(df: DataFrame, col: str = "abx_b") -> DataFrame:
    """Add ``abx_yn``; a missing exposure gets the label "none"."""
    return df.withColumns(
        {
            "abx_yn": F.when(F.col(col).isNull(), 0).otherwise(1),
            col: F.coalesce(F.col(col), F.lit("none")),
        }
    )


def _lagged_sets(max_lag: int, calendar: bool) -> list[Column]:
    """The exposure sets 0 to ``max_lag`` records, or calendar days, before each record; null where there is none.

    By calendar, a frame over the range of days holds the records of those days, one a day.
    """
    record = Window.partitionBy("subject_id").orderBy("study_day")
    if not calendar:
        return [F.col("abx"), *(F.lag("abx", n).over(record) for n in range(1, max_lag + 1))]
    near = F.collect_list(F.struct("study_day", "abx")).over(record.rangeBetween(-max_lag, 0))

    def on_day(n: int) -> Column:
        return F.get(F.filter(near, lambda r: r["study_day"] == F.col("study_day") - n), F.lit(0))["abx"]

    return [F.col("abx"), *(on_day(n) for n in range(1, max_lag + 1))]


def exposure_lags(days: DataFrame, max_lag: int, calendar: bool = False) -> DataFrame:
    """Exposures of the current and the ``max_lag`` previous records of the subject.

    Counts records, or days with ``calendar``. Where there is no such record there is one row
    without exposure per lag.
    """
    sets = F.array(*_lagged_sets(max_lag, calendar))
    return (
        days.select(*DAY_KEYS, sets.alias("_sets"))
        .select(*DAY_KEYS, F.posexplode("_sets").alias("day_lag", "_abx"))
        .select(*DAY_KEYS, "day_lag", F.explode_outer("_abx").alias("abx_b"))
    )


def _record_place(calendar: bool) -> Column:
    """What counts on by one within a run: the record's number, or the day itself."""
    record = Window.partitionBy("subject_id").orderBy("study_day")
    return F.col("study_day") if calendar else F.row_number().over(record)


def exposure_run_length(days: DataFrame, max_lag: int, calendar: bool = False) -> DataFrame:
    """Number of consecutive records, or days, up to this one with the exposure, at most ``max_lag + 1``.

    Records of one run share the difference between the subject's record number
    and the exposure's own number. The first window's exchange on the subject
    serves the two that follow.
    """
    own = Window.partitionBy("subject_id", "abx_b").orderBy("_record")
    run = Window.partitionBy("subject_id", "abx_b", "_run").orderBy("_record")
    return (
        days.withColumn("_record", _record_place(calendar))
        .select(*DAY_KEYS, "_record", F.explode("abx").alias("abx_b"))
        .filter(F.col("abx_b").isNotNull())
        .withColumn("_run", F.col("_record") - F.row_number().over(own))
        .withColumn("continuous", F.least(F.row_number().over(run), F.lit(max_lag + 1)))
        .select(*DAY_KEYS, "abx_b", F.col("continuous").cast("long").alias("continuous"))
    )


def gap_flag(lags: DataFrame) -> DataFrame:
    """Run length from the lag rows: count the lags from 0 up to the first gap.

    Gives what ``exposure_run_length`` gives, from its definition; groups have at
    most ``max_lag + 1`` rows.
    """
    keys = [*DAY_KEYS, "abx_b"]
    step = Window.partitionBy(*keys).orderBy("day_lag")
    whole = Window.partitionBy(*keys)
    rows = (
        lags.filter(F.col("abx_b").isNotNull())
        .select(*keys, "day_lag")
        .distinct()
        .withColumn(
            "gap", F.coalesce(F.col("day_lag") - F.lag("day_lag").over(step) > 1, F.lit(False))
        )
        .withColumn("_cut", F.min(F.when(F.col("gap"), F.col("day_lag"))).over(whole))
    )
    return (
        rows.filter(F.col("_cut").isNull() | (F.col("day_lag") < F.col("_cut")))
        .groupBy(*keys)
        .agg(F.count_if(~F.col("gap")).alias("continuous"), F.min("day_lag").alias("_first"))
        .filter(F.col("_first") == 0)
        .drop("_first")
    )


def restore_unmatched(runs: DataFrame, lags: DataFrame) -> DataFrame:
    """All lag rows, with the run length where there is one."""
    return runs.join(lags, [*DAY_KEYS, "abx_b"], "right")


def exposure_record(
    days: DataFrame, max_lag: int, calendar: bool = False, wanted: DataFrame | None = None
) -> DataFrame:
    """Per subject and day the array ``abx_lagged`` of (abx_b, continuous, day_lag).

    Same content as ``exposure_lags`` with the run length of ``exposure_run_length``
    attached, but built on the day rows: after the exchange on the subject no join
    and no further exchange is needed. Lags and runs are those of all days; of the records
    only those of the subjects and days in ``wanted`` are returned, if given.
    """
    if wanted is not None:
        marked = wanted.select(*DAY_KEYS).distinct().withColumn("_wanted", F.lit(True))
        days = days.join(marked, list(DAY_KEYS), "left")
    also = [] if wanted is None else ["_wanted"]
    runs = exposure_runs_per_day(days, max_lag, calendar, also)
    sets = _lagged_sets(max_lag, calendar)
    entry = "struct<abx_b:string,continuous:bigint,day_lag:int>"
    none = F.array(F.lit(None).cast("string"))

    def lagged(n: int) -> Column:
        names = sets[n] if n == 0 else F.coalesce(sets[n], none)
        return F.transform(
            names,
            lambda name: F.struct(
                name.alias("abx_b"),
                F.when(name.isNotNull(), F.try_element_at(F.col("_runs"), F.coalesce(name, F.lit(""))))
                .cast("long")
                .alias("continuous"),
                F.lit(n).cast("int").alias("day_lag"),
            ),
        )

    lists = F.array(*(lagged(n) for n in range(max_lag + 1)))
    records = runs.select(*DAY_KEYS, F.flatten(lists).cast(f"array<{entry}>").alias("abx_lagged"), *also)
    return records if wanted is None else records.filter("_wanted").drop("_wanted")


def exposure_runs_per_day(
    days: DataFrame, max_lag: int, calendar: bool = False, also: Sequence[str] = ()
) -> DataFrame:
    """Day rows with the map ``_runs`` from exposure to run length, and the columns ``also``."""
    own = Window.partitionBy("subject_id", "_name").orderBy("_record")
    run = Window.partitionBy("subject_id", "_name", "_run").orderBy("_record")
    pairs = F.filter(F.collect_list(F.struct("_name", "_length")), lambda p: p["_name"].isNotNull())
    return (
        days.withColumn("_record", _record_place(calendar))
        .select(*DAY_KEYS, "_record", "abx", *also, F.explode("abx").alias("_name"))
        .withColumn("_run", F.col("_record") - F.row_number().over(own))
        .withColumn("_length", F.least(F.row_number().over(run), F.lit(max_lag + 1)))
        .groupBy(*DAY_KEYS)
        .agg(
            F.first("abx").alias("abx"),
            F.map_from_entries(pairs).alias("_runs"),
            *(F.first(c).alias(c) for c in also),
        )
    )


def attach_counts(history: DataFrame, agg: DataFrame) -> DataFrame:
    """Exposure history with the melted counts of the same subject and day.

    The days without counts are added separately: an inner join can be split where
    one day holds much of the counts, an outer join that keeps the history cannot.
    """
    keys = list(DAY_KEYS)
    counted = history.join(agg, keys)
    rest = history.join(agg.select(*keys).distinct(), keys, "left_anti")
    return counted.unionByName(rest, allowMissingColumns=True)


def history_rows(record: DataFrame) -> DataFrame:
    """The nested history as rows."""
    return unnest(record, "abx_lagged")


def effective_window(
    df: DataFrame,
    flag: str,
    lag: int = 1,
    keys: Sequence[str] = ("subject_id",),
    order: Sequence[str] = ("study_day",),
    out: str = "on_abx",
) -> DataFrame:
    """True from each true row to the ``lag`` rows after it; NULL counts as false.

    Expects one row per subject and day.
    """
    recent = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-lag, Window.currentRow)
    return df.withColumn(out, F.max(F.coalesce(F.col(flag), F.lit(False))).over(recent))

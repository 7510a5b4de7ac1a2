"""Queries on set B: exposures, lag histories and regression frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abundex.functions.expressions import days_between, recoded, truncated
from abundex.operators import diversity, exposure, frame, posterior, reshape, summaries
from abundex.plans.pipelines import exposure_history
from abundex.schemas import ModelFrame
from abundex.session import cut_lineage
from catalog import roles as r
from catalog.roles import r6, rounded, sql_r6, with_ctes

MAX_LAG = 3
LONG_LAG = 7
TYPE = "1"
MIN_SUBJECTS = 2
MIN_MEDIAN = 7
MAX_CONTINUOUS = 3
DAY = ("subject_id", "study_day")


# --- spans, windows, sub-subjects ------------------------------------------------


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return exposure.subject_span(r.event_samples(spark, d))


def _spanned(spark: SparkSession, d: str) -> DataFrame:
    """Exposures with the spans of their subjects."""
    return exposure.exposure_right_join(_spans(spark, d), r.event_exposures(spark, d))


def _rekeyed(spark: SparkSession, d: str) -> DataFrame:
    return exposure.episode_rekey(exposure.study_window_filter(_spanned(spark, d)), r.RULES)


def _days(spark: SparkSession, d: str) -> DataFrame:
    return exposure.exposure_days(_rekeyed(spark, d), **r.CLEANING)


def _history(spark: SparkSession, d: str, max_lag: int = MAX_LAG, wanted: DataFrame | None = None) -> DataFrame:
    return exposure_history(
        r.event_samples(spark, d), r.event_exposures(spark, d), max_lag, r.RULES, **r.CLEANING, wanted=wanted
    )


def a12_subject_span(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d)


def j4_exposure_right_join(spark: SparkSession, d: str) -> DataFrame:
    return _spanned(spark, d)


def w3_exit_day(spark: SparkSession, d: str) -> DataFrame:
    found = exposure.exit_day(_spanned(spark, d))
    return found.select("subject_id", "collection_date", "study_day", "exit_day")


def p6_study_window_filter(spark: SparkSession, d: str) -> DataFrame:
    return exposure.study_window_filter(_spanned(spark, d)).select(*DAY, "abx_b")


def j8_episode_rekey(spark: SparkSession, d: str) -> DataFrame:
    return _rekeyed(spark, d).select(*DAY, "abx_b")


def f2_date_functions(spark: SparkSession, d: str) -> DataFrame:
    shipped = r.table(spark, d, "lineitem").join(
        r.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    days = days_between(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    return shipped.select("l_orderkey", "l_linenumber", days.alias("days"))


# --- exposure names ----------------------------------------------------------------


def n6_separate_exposures(spark: SparkSession, d: str) -> DataFrame:
    return reshape.separate_exposures(r.event_exposures(spark, d))


def _sets(spark: SparkSession, d: str) -> DataFrame:
    """Uncleaned sets per subject and date."""
    return exposure.exposure_days(
        r.event_exposures(spark, d), ["subject_id", "collection_date"], {}, {}, ()
    )


def _flat(df: DataFrame, column: str = "abx") -> DataFrame:
    return df.select("subject_id", "collection_date", F.explode(column).alias("abx_b"))


def _names(spark: SparkSession, d: str) -> DataFrame:
    return reshape.separate_exposures(r.event_exposures(spark, d))


def x1_coformulation_map(spark: SparkSession, d: str) -> DataFrame:
    mapped = exposure.coformulation_map(F.col("abx_b"), r.COMBINED)
    return _names(spark, d).withColumn("abx_b", mapped).distinct()


def x2_suppress_components(spark: SparkSession, d: str) -> DataFrame:
    kept = exposure.suppress_components(F.col("abx"), {"click": "purchase", "view": "signup"})
    return _flat(_sets(spark, d).withColumn("abx", kept))


def x3_always_drop(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).filter(~exposure.always_dropped(F.col("abx_b"), r.DROPPED))


def x4_indicator(spark: SparkSession, d: str) -> DataFrame:
    return exposure.indicator(reshape.separate_exposures(r.event_exposures(spark, d)))


def n3_nest(spark: SparkSession, d: str) -> DataFrame:
    names = reshape.separate_exposures(r.event_exposures(spark, d)).filter("abx_b IS NOT NULL")
    nested = reshape.nest(names, ["subject_id"], ["abx_b"], "abx")
    listed = F.array_join(F.transform("abx", lambda e: e["abx_b"]), "|")
    return nested.select("subject_id", listed.alias("abx"), F.size("abx").alias("n"))


def n4_unnest(spark: SparkSession, d: str) -> DataFrame:
    keyed = r.event_exposures(spark, d)
    whole = reshape.separate_exposures(keyed)
    nested = reshape.nest(whole, ["subject_id", "collection_date"], ["abx_b"], "abx")
    return reshape.unnest(nested, "abx")


# --- lags and runs -----------------------------------------------------------------


def w6_exposure_lags(spark: SparkSession, d: str) -> DataFrame:
    return exposure.exposure_lags(_days(spark, d), MAX_LAG)


def w7_exposure_run_length(spark: SparkSession, d: str) -> DataFrame:
    return exposure.exposure_run_length(_days(spark, d), LONG_LAG)


def w6_calendar_lags(spark: SparkSession, d: str) -> DataFrame:
    return exposure.exposure_lags(_days(spark, d), MAX_LAG, calendar=True)


def w7_calendar_run_length(spark: SparkSession, d: str) -> DataFrame:
    return exposure.exposure_run_length(_days(spark, d), LONG_LAG, calendar=True)


def x5_calendar_history(spark: SparkSession, d: str) -> DataFrame:
    return exposure.history_rows(exposure.exposure_record(_days(spark, d), MAX_LAG, calendar=True))


def w8_gap_flag(spark: SparkSession, d: str) -> DataFrame:
    return exposure.gap_flag(exposure.exposure_lags(_days(spark, d), MAX_LAG))


def j5_restore_unmatched(spark: SparkSession, d: str) -> DataFrame:
    days = _days(spark, d)
    return exposure.restore_unmatched(
        exposure.exposure_run_length(days, MAX_LAG), exposure.exposure_lags(days, MAX_LAG)
    )


def x5_exposure_history(spark: SparkSession, d: str) -> DataFrame:
    return exposure.history_rows(_history(spark, d, LONG_LAG))


def _event_agg(spark: SparkSession, d: str) -> DataFrame:
    samples = r.rekeyed_event_samples(spark, d)
    return r.event_counts(spark, d).join(samples, "specimen_id2")


def j6_attach_counts(spark: SparkSession, d: str) -> DataFrame:
    joined = exposure.attach_counts(_history(spark, d), _event_agg(spark, d))
    return joined.select(
        *DAY, F.size("abx_lagged").alias("n_lagged"), "specimen_id2", "otu_id", "read_count"
    )


def w10_effective_window(spark: SparkSession, d: str) -> DataFrame:
    flagged = r.event_exposures(spark, d).select(
        "subject_id",
        F.datediff("collection_date", F.lit("2024-01-01").cast("date")).alias("study_day"),
        F.col("abx_b").contains("error").alias("given"),
    )
    return exposure.effective_window(flagged, "given", 2)


# --- frames --------------------------------------------------------------------------


def _diversity(spark: SparkSession, d: str) -> DataFrame:
    return diversity.hill_diversity(r.event_counts(spark, d))


def _frame(spark: SparkSession, d: str, build, **options) -> ModelFrame:
    """The history of the days with a specimen of the type is written first."""
    samples = r.rekeyed_event_samples(spark, d)
    return build(
        samples,
        _diversity(spark, d),
        cut_lineage(_history(spark, d, wanted=frame.specimen_type_filter(samples, TYPE))),
        TYPE,
        min_subjects=MIN_SUBJECTS,
        min_median=MIN_MEDIAN,
        **options,
    )


def _ratio(spark: SparkSession, d: str) -> ModelFrame:
    return _frame(spark, d, frame.gen_ratio, max_lag=2)


def _lag(spark: SparkSession, d: str) -> ModelFrame:
    return _frame(spark, d, frame.gen_lag, max_lag=MAX_LAG)


def _continuous(spark: SparkSession, d: str) -> ModelFrame:
    return _frame(spark, d, frame.gen_continuous, max_continuous=MAX_CONTINUOUS)


def j7_attach_diversity(spark: SparkSession, d: str) -> DataFrame:
    joined = r.event_samples(spark, d).join(_diversity(spark, d), "specimen_id2", "left")
    return joined.select("specimen_id2", "subject_id", r6("D1").alias("D1"))


def a7_exposure_keep_rule(spark: SparkSession, d: str) -> DataFrame:
    responses = frame.response_rows(
        r.rekeyed_event_samples(spark, d), _diversity(spark, d), _history(spark, d), TYPE
    )
    return frame.exposure_keep_rule(frame.exposure_rows(responses, MAX_LAG), 2, 1)


def j11_keep_subjects(spark: SparkSession, d: str) -> DataFrame:
    return reshape.specimen_ids(_lag(spark, d).rows, ["subjects", "specimens"])


def n7_pivot_exposures(spark: SparkSession, d: str) -> DataFrame:
    rows = _continuous(spark, d).rows.withColumn(
        "abx_lag", F.regexp_replace("abx_lag", r"\.", "_")
    )
    wide = reshape.pivot_exposures(
        rows, ["specimens", "subjects"], ["click", "click_purchase", "signup", "view"]
    )
    return wide


def g1_ratio_obs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_ratio(spark, d).obs, "D1_delta")


def g1_ratio_design(spark: SparkSession, d: str) -> DataFrame:
    return _ratio(spark, d).design


def g2_lag_obs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_lag(spark, d).obs, "D1", "D1_lag")


def g2_lag_design(spark: SparkSession, d: str) -> DataFrame:
    return _lag(spark, d).design


def g3_continuous_obs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_continuous(spark, d).obs, "D1", "D1_lag")


def g3_continuous_design(spark: SparkSession, d: str) -> DataFrame:
    return _continuous(spark, d).design


def n8_dense_design(spark: SparkSession, d: str) -> DataFrame:
    return frame.dense_design(_continuous(spark, d).design)


def g4_frame_dims(spark: SparkSession, d: str) -> DataFrame:
    return frame.frame_dims(_continuous(spark, d))


def g4_compose(spark: SparkSession, d: str) -> DataFrame:
    return rounded(frame.compose(_continuous(spark, d)), "D1", "D1_lag")


def _cohort_frame(spark: SparkSession, d: str, high: bool) -> ModelFrame:
    samples = r.rekeyed_event_samples(spark, d)
    dominant = diversity.dominant_taxon(
        samples, r.event_counts(spark, d), r.event_taxonomy(spark, d)
    )
    return frame.gen_continuous(
        frame.cohort(samples, dominant, "g0", high),
        _diversity(spark, d),
        _history(spark, d),
        TYPE,
        max_continuous=MAX_CONTINUOUS,
        min_subjects=1,
        min_median=1,
    )


def g5_high_cohort(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_cohort_frame(spark, d, True).obs, "D1", "D1_lag")


def g5_low_cohort(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_cohort_frame(spark, d, False).obs, "D1", "D1_lag")


# --- summaries -------------------------------------------------------------------------


def a8_distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    """Subjects and specimens per type, with some subjects missing."""
    return summaries.distinct_counts(
        r.raw_samples(spark, d), ["specimen_type"], ["subject_id", "specimen_id2"]
    )


def a9_duration_summary(spark: SparkSession, d: str) -> DataFrame:
    found = summaries.duration_summary(r.raw_samples(spark, d))
    return rounded(found, "med_duration", "iqr_duration")


def a10_exposure_load(spark: SparkSession, d: str) -> DataFrame:
    found = summaries.exposure_load_summary(
        r.rekeyed_event_samples(spark, d), _history(spark, d)
    )
    return rounded(found, "med_abx_no", "iqr_abx_no")


def a11_observed_distinct(spark: SparkSession, d: str) -> DataFrame:
    return posterior.observed_distinct(_continuous(spark, d).rows)


# --- scalar functions ----------------------------------------------------------------------


def f3_math_functions(spark: SparkSession, d: str) -> DataFrame:
    value = F.col("value")
    return r.table(spark, d, "events").select(
        "event_id",
        r6(F.exp(value / 100)).alias("e"),
        r6(F.ln(value + 1)).alias("l"),
        r6(F.sqrt(value)).alias("root"),
        F.floor(value).alias("down"),
        F.abs(value - 50).cast("int").alias("away"),
        r6(F.try_divide(F.lit(100.0) * value, F.col("user_id") % 3)).alias("ratio"),
    )


def f4_conditional_functions(spark: SparkSession, d: str) -> DataFrame:
    raw = r.raw_samples(spark, d)
    size = F.when(F.col("study_day") < 100, "early").when(F.col("study_day") >= 1000, "late")
    return raw.select(
        "specimen_id2",
        size.otherwise("middle").alias("phase"),
        F.coalesce("specimen_type", F.lit("none")).alias("kind"),
        F.col("subject_id").isNull().alias("missing"),
    )


def f5_truncate(spark: SparkSession, d: str) -> DataFrame:
    days = F.when(F.col("study_day") % 7 != 0, F.col("study_day"))
    return r.raw_samples(spark, d).select("specimen_id2", truncated(days, 500).alias("capped"))


def f6_recode(spark: SparkSession, d: str) -> DataFrame:
    labels = {"click": "Click", "purchase": "Purchase/Click"}
    return r.table(spark, d, "events").select(
        "event_id", recoded(F.col("event_type"), labels).alias("label")
    )


QUERIES = {
    "A12_subject_span": a12_subject_span,
    "J4_exposure_right_join": j4_exposure_right_join,
    "W3_exit_day": w3_exit_day,
    "P6_study_window_filter": p6_study_window_filter,
    "J8_episode_rekey": j8_episode_rekey,
    "F2_date_functions": f2_date_functions,
    "N6_separate_exposures": n6_separate_exposures,
    "X1_coformulation_map": x1_coformulation_map,
    "X2_suppress_components": x2_suppress_components,
    "X3_always_drop": x3_always_drop,
    "X4_indicator": x4_indicator,
    "N3_nest": n3_nest,
    "N4_unnest": n4_unnest,
    "W6_exposure_lags": w6_exposure_lags,
    "W7_exposure_run_length": w7_exposure_run_length,
    "W6_calendar_lags": w6_calendar_lags,
    "W7_calendar_run_length": w7_calendar_run_length,
    "X5_calendar_history": x5_calendar_history,
    "W8_gap_flag": w8_gap_flag,
    "J5_restore_unmatched": j5_restore_unmatched,
    "X5_exposure_history": x5_exposure_history,
    "J6_attach_counts": j6_attach_counts,
    "W10_effective_window": w10_effective_window,
    "J7_attach_diversity": j7_attach_diversity,
    "A7_exposure_keep_rule": a7_exposure_keep_rule,
    "J11_keep_subjects": j11_keep_subjects,
    "N7_pivot_exposures": n7_pivot_exposures,
    "G1_ratio_obs": g1_ratio_obs,
    "G1_ratio_design": g1_ratio_design,
    "G2_lag_obs": g2_lag_obs,
    "G2_lag_design": g2_lag_design,
    "G3_continuous_obs": g3_continuous_obs,
    "G3_continuous_design": g3_continuous_design,
    "N8_dense_design": n8_dense_design,
    "G4_frame_dims": g4_frame_dims,
    "G4_compose": g4_compose,
    "G5_high_cohort": g5_high_cohort,
    "G5_low_cohort": g5_low_cohort,
    "A8_distinct_counts": a8_distinct_counts,
    "A9_duration_summary": a9_duration_summary,
    "A10_exposure_load": a10_exposure_load,
    "A11_observed_distinct": a11_observed_distinct,
    "F3_math_functions": f3_math_functions,
    "F4_conditional_functions": f4_conditional_functions,
    "F5_truncate": f5_truncate,
    "F6_recode": f6_recode,
}


# --- the same in SQL -----------------------------------------------------------------------

_EARLY = """spans2 AS (
  SELECT subject_id, min(enroll_date) AS enroll_date, max(collection_date) AS exit_date
  FROM esamples GROUP BY 1),
spanned2 AS (
  SELECT m.subject_id, s.enroll_date, s.exit_date, m.collection_date, m.abx_b,
    date_diff('day', s.enroll_date, m.collection_date) AS study_day
  FROM meds m LEFT JOIN spans2 s ON s.subject_id = m.subject_id)"""
_SPAN_BASE = (r.EVENT_EXPOSURES, r.EVENT_SAMPLES, _EARLY)
_NAMES = """names AS (
  SELECT DISTINCT subject_id, collection_date,
    unnest(CASE WHEN abx_b IS NULL THEN [NULL] ELSE string_split(abx_b, ',') END) AS abx_b FROM meds)"""


def _history_base(max_lag: int = MAX_LAG) -> tuple[str, ...]:
    return (*r.EXPOSURE_BASE, r.sql_lags(max_lag))


def _frame_ctes(where: str, k: str, min_subjects: int, min_median: float, source: str = "rsamples") -> str:
    """The frame from the long history: filter, count, keep, restrict."""
    return f"""resp AS (
  SELECT *, "D1" / d1_lag AS d1_delta FROM (
    SELECT s.specimen_id2, s.subject_id, s.study_day, d."D1",
      lag(d."D1") OVER (PARTITION BY s.subject_id ORDER BY s.study_day, s.specimen_id2) AS d1_lag
    FROM {source} s JOIN records h ON h.subject_id = s.subject_id AND h.study_day = s.study_day
    LEFT JOIN d1 d ON d.specimen_id2 = s.specimen_id2
    WHERE s.specimen_type = '{TYPE}') WHERE d1_lag IS NOT NULL),
long AS (
  SELECT p.specimen_id2 AS specimens, p.subject_id AS subjects, p."D1", p.d1_lag AS "D1_lag",
    p.d1_delta AS "D1_delta", h.day_lag, coalesce(h.abx_b, 'none') AS abx_lag,
    CASE WHEN h.abx_b IS NULL THEN 0 ELSE 1 END AS abx_yn, CAST({k} AS BIGINT) AS k
  FROM resp p JOIN history h ON h.subject_id = p.subject_id AND h.study_day = p.study_day WHERE {where}),
per_subject AS (
  SELECT abx_lag, subjects, count(*) AS n FROM long WHERE abx_lag <> 'none' AND day_lag = 0 GROUP BY 1, 2),
kept AS (
  SELECT abx_lag, count(*) AS n_subjects, median(n) AS median_n FROM per_subject GROUP BY 1
  HAVING count(*) >= {min_subjects} AND median(n) >= {min_median}),
d5 AS (
  SELECT * FROM long WHERE subjects IN (
    SELECT subjects FROM long WHERE abx_lag IN (SELECT abx_lag FROM kept)))"""


_CAPPED = f"CASE WHEN h.continuous > {MAX_CONTINUOUS} THEN {MAX_CONTINUOUS} ELSE h.continuous END"
_MODEL_BASE = (*_history_base(), r.REKEYED_SAMPLES, r.EVENT_COUNTS, r.DIVERSITY)
_RATIO = (*_MODEL_BASE, _frame_ctes("h.day_lag <= 2", "h.day_lag", MIN_SUBJECTS, MIN_MEDIAN))
LAG = (
    *_MODEL_BASE,
    _frame_ctes(f"h.day_lag <= {MAX_LAG}", "h.day_lag", MIN_SUBJECTS, MIN_MEDIAN),
)
CONTINUOUS = (
    *_MODEL_BASE,
    _frame_ctes("h.day_lag = 0", _CAPPED, MIN_SUBJECTS, MIN_MEDIAN),
)
DESIGN = """design AS (
  SELECT DISTINCT specimens, subjects, abx_lag, k FROM d5
  WHERE abx_yn = 1 AND k IS NOT NULL AND abx_lag IN (SELECT abx_lag FROM kept))"""
_D1_D1LAG = f"""{sql_r6('"D1"')} AS "D1", {sql_r6('"D1_lag"')} AS "D1_lag" """
_OBS = f"SELECT DISTINCT specimens, subjects, {_D1_D1LAG} FROM d5"


def _cohort(high: bool) -> tuple[str, ...]:
    rule = "genus = 'g0'" if high else "genus IS DISTINCT FROM 'g0'"
    return (
        *_MODEL_BASE,
        f"""shares AS (
  SELECT s.subject_id, s.specimen_type, s.study_day, 'g' || (c.otu_id % 3) AS genus, s.specimen_id2,
    sum(c.read_count) / sum(sum(c.read_count)) OVER (PARTITION BY s.specimen_id2)::DOUBLE AS prop
  FROM counts c JOIN rsamples s USING (specimen_id2) GROUP BY 1, 2, 3, 4, 5),
first_day AS (
  SELECT *, rank() OVER (PARTITION BY subject_id, specimen_type ORDER BY study_day) AS day_pos FROM shares),
dominant AS (
  SELECT subject_id, specimen_type, genus FROM (
    SELECT *, row_number() OVER (PARTITION BY subject_id, specimen_type ORDER BY prop DESC, genus) AS pos
    FROM first_day WHERE day_pos = 1) WHERE pos = 1),
csamples AS (
  SELECT s.* FROM rsamples s LEFT JOIN dominant m
    ON m.subject_id = s.subject_id AND m.specimen_type = s.specimen_type WHERE {rule})""",
        _frame_ctes("h.day_lag = 0", _CAPPED, 1, 1, "csamples"),
        _OBS,
    )


SQL = {
    "A12_subject_span": with_ctes(r.EVENT_SAMPLES, r.SPANS, "SELECT * FROM spans"),
    "J4_exposure_right_join": with_ctes(*_SPAN_BASE, "SELECT * FROM spanned2"),
    "W3_exit_day": with_ctes(
        *_SPAN_BASE,
        """SELECT subject_id, collection_date, study_day,
  max(CASE WHEN collection_date = exit_date THEN study_day END) OVER (PARTITION BY subject_id) AS exit_day
FROM spanned2""",
    ),
    "P6_study_window_filter": with_ctes(
        *_SPAN_BASE,
        "SELECT subject_id, study_day, abx_b FROM spanned2 WHERE study_day > -7 AND collection_date <= exit_date",
    ),
    "J8_episode_rekey": with_ctes(
        *r.EXPOSURE_BASE[:-1], "SELECT subject_id, study_day, abx_b FROM rekeyed"
    ),
    "F2_date_functions": """SELECT l_orderkey, l_linenumber,
  CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "N6_separate_exposures": with_ctes(
        r.EVENT_EXPOSURES,
        """SELECT subject_id, collection_date,
  unnest(CASE WHEN abx_b IS NULL THEN [NULL] ELSE string_split(abx_b, ',') END) AS abx_b FROM meds""",
    ),
    "X1_coformulation_map": with_ctes(
        r.EVENT_EXPOSURES,
        _NAMES,
        """SELECT DISTINCT subject_id, collection_date,
  CASE WHEN abx_b = 'purchase' THEN 'click.purchase' ELSE abx_b END AS abx_b FROM names""",
    ),
    "X2_suppress_components": with_ctes(
        r.EVENT_EXPOSURES,
        _NAMES,
        """SELECT subject_id, collection_date, abx_b FROM (
  SELECT *, bool_or(coalesce(abx_b, '') = 'purchase') OVER d AS bought,
    bool_or(coalesce(abx_b, '') = 'signup') OVER d AS joined
  FROM names WINDOW d AS (PARTITION BY subject_id, collection_date))
WHERE abx_b IS NULL OR NOT ((abx_b = 'click' AND bought) OR (abx_b = 'view' AND joined))""",
    ),
    "X3_always_drop": with_ctes(
        r.EVENT_EXPOSURES, _NAMES, "SELECT * FROM names WHERE abx_b IS DISTINCT FROM 'error'"
    ),
    "X4_indicator": with_ctes(
        r.EVENT_EXPOSURES,
        _NAMES,
        """SELECT subject_id, collection_date, coalesce(abx_b, 'none') AS abx_b,
  CAST(abx_b IS NOT NULL AS INT) AS abx_yn FROM names""",
    ),
    "N3_nest": with_ctes(
        r.EVENT_EXPOSURES,
        _NAMES,
        """SELECT subject_id, string_agg(DISTINCT abx_b, '|' ORDER BY abx_b) AS abx, count(DISTINCT abx_b) AS n
FROM names WHERE abx_b IS NOT NULL GROUP BY 1""",
    ),
    "N4_unnest": with_ctes(r.EVENT_EXPOSURES, _NAMES, "SELECT * FROM names"),
    "W6_exposure_lags": with_ctes(
        *_history_base(), "SELECT subject_id, study_day, day_lag, abx_b FROM lags"
    ),
    "W7_exposure_run_length": with_ctes(*_history_base(LONG_LAG), "SELECT * FROM runs"),
    "W6_calendar_lags": with_ctes(
        *r.EXPOSURE_BASE, r.sql_lags(MAX_LAG, calendar=True), "SELECT subject_id, study_day, day_lag, abx_b FROM lags"
    ),
    "W7_calendar_run_length": with_ctes(
        *r.EXPOSURE_BASE, r.sql_lags(LONG_LAG, calendar=True), "SELECT * FROM runs"
    ),
    "X5_calendar_history": with_ctes(
        *r.EXPOSURE_BASE,
        r.sql_lags(MAX_LAG, calendar=True),
        "SELECT subject_id, study_day, abx_b, continuous, day_lag FROM history",
    ),
    "W8_gap_flag": with_ctes(
        *r.EXPOSURE_BASE,
        f"""records AS (
  SELECT subject_id, study_day, row_number() OVER (PARTITION BY subject_id ORDER BY study_day) AS rn
  FROM (SELECT DISTINCT subject_id, study_day FROM cleaned)),
given AS (
  SELECT c.*, rn, rn - row_number() OVER (PARTITION BY c.subject_id, abx_b ORDER BY rn) AS island
  FROM cleaned c JOIN records r ON r.subject_id = c.subject_id AND r.study_day = c.study_day WHERE abx_b IS NOT NULL)""",
        f"""SELECT subject_id, study_day, abx_b, least({MAX_LAG + 1}, row_number() OVER (
  PARTITION BY subject_id, abx_b, island ORDER BY rn)) AS continuous FROM given""",
    ),
    "J5_restore_unmatched": with_ctes(
        *_history_base(), "SELECT subject_id, study_day, abx_b, continuous, day_lag FROM history"
    ),
    "X5_exposure_history": with_ctes(
        *_history_base(LONG_LAG),
        "SELECT subject_id, study_day, abx_b, continuous, day_lag FROM history",
    ),
    "J6_attach_counts": with_ctes(
        *_history_base(),
        r.REKEYED_SAMPLES,
        r.EVENT_COUNTS,
        """SELECT h.subject_id, h.study_day, h.n_lagged, s.specimen_id2, c.otu_id, c.read_count
FROM (SELECT subject_id, study_day, count(*) AS n_lagged FROM history GROUP BY 1, 2) h
LEFT JOIN rsamples s ON s.subject_id = h.subject_id AND s.study_day = h.study_day
LEFT JOIN counts c ON c.specimen_id2 = s.specimen_id2""",
    ),
    "W10_effective_window": with_ctes(
        r.EVENT_EXPOSURES,
        """flags AS (SELECT subject_id, date_diff('day', DATE '2024-01-01', collection_date) AS study_day,
  contains(abx_b, 'error') AS given FROM meds)""",
        """SELECT *, coalesce(given, false) OR coalesce(lag(given, 1) OVER w, false)
  OR coalesce(lag(given, 2) OVER w, false) AS on_abx
FROM flags WINDOW w AS (PARTITION BY subject_id ORDER BY study_day)""",
    ),
    "J7_attach_diversity": with_ctes(
        r.EVENT_SAMPLES,
        r.EVENT_COUNTS,
        r.DIVERSITY,
        f"""SELECT specimen_id2, subject_id, {sql_r6('"D1"')} AS "D1"
FROM esamples LEFT JOIN d1 USING (specimen_id2)""",
    ),
    "A7_exposure_keep_rule": with_ctes(
        *_MODEL_BASE,
        _frame_ctes(f"h.day_lag <= {MAX_LAG}", "h.day_lag", 2, 1),
        "SELECT * FROM kept",
    ),
    "J11_keep_subjects": with_ctes(*LAG, "SELECT DISTINCT subjects, specimens FROM d5"),
    "N7_pivot_exposures": with_ctes(
        *CONTINUOUS,
        """SELECT specimens, subjects, CAST(bool_or(abx_lag = 'click') AS INT) AS click,
  CAST(bool_or(abx_lag = 'click.purchase') AS INT) AS click_purchase,
  CAST(bool_or(abx_lag = 'signup') AS INT) AS signup, CAST(bool_or(abx_lag = 'view') AS INT) AS view
FROM d5 GROUP BY 1, 2""",
    ),
    "G1_ratio_obs": with_ctes(
        *_RATIO,
        f"""SELECT DISTINCT specimens, subjects, {sql_r6('"D1_delta"')} AS "D1_delta" FROM d5""",
    ),
    "G1_ratio_design": with_ctes(*_RATIO, DESIGN, "SELECT * FROM design"),
    "G2_lag_obs": with_ctes(*LAG, _OBS),
    "G2_lag_design": with_ctes(*LAG, DESIGN, "SELECT * FROM design"),
    "G3_continuous_obs": with_ctes(*CONTINUOUS, _OBS),
    "G3_continuous_design": with_ctes(*CONTINUOUS, DESIGN, "SELECT * FROM design"),
    "N8_dense_design": with_ctes(
        *CONTINUOUS,
        DESIGN,
        """SELECT s.*, a.abx_lag, k.k, CAST(EXISTS (
    SELECT 1 FROM design d WHERE d.specimens = s.specimens AND d.abx_lag = a.abx_lag AND d.k = k.k) AS INT) AS value
FROM (SELECT DISTINCT specimens, subjects FROM design) s
CROSS JOIN (SELECT DISTINCT abx_lag FROM design) a CROSS JOIN (SELECT DISTINCT k FROM design) k""",
    ),
    "G4_frame_dims": with_ctes(
        *CONTINUOUS,
        """SELECT count(DISTINCT specimens) AS n_specimens, count(DISTINCT subjects) AS n_subjects,
  count(DISTINCT k) AS n_k, (SELECT count(*) FROM kept) AS n_abx FROM d5""",
    ),
    "G4_compose": with_ctes(
        *CONTINUOUS,
        f"""SELECT *, dense_rank() OVER (ORDER BY specimens) AS specimens_idx,
  dense_rank() OVER (ORDER BY subjects) AS subjects_idx FROM ({_OBS})""",
    ),
    "G5_high_cohort": with_ctes(*_cohort(True)),
    "G5_low_cohort": with_ctes(*_cohort(False)),
    "A8_distinct_counts": with_ctes(
        r.RAW_SAMPLES,
        """SELECT specimen_type, count(DISTINCT coalesce(CAST(subject_id AS VARCHAR), 'missing')) AS n_subject_id,
  count(DISTINCT specimen_id2) AS n_specimen_id2 FROM raw GROUP BY 1""",
    ),
    "A9_duration_summary": with_ctes(
        r.RAW_SAMPLES,
        """longest AS (SELECT specimen_type, subject_id, max(study_day) AS days FROM raw
  WHERE specimen_type IS NOT NULL GROUP BY 1, 2)""",
        f"""SELECT specimen_type, min(days) AS min_duration, {sql_r6("median(days)")} AS med_duration,
  {sql_r6("quantile_cont(days, 0.75) - quantile_cont(days, 0.25)")} AS iqr_duration FROM longest GROUP BY 1""",
    ),
    "A10_exposure_load": with_ctes(
        *_history_base(),
        r.REKEYED_SAMPLES,
        """loads AS (
  SELECT s.specimen_type, s.study_day, count(h.abx_b) AS n
  FROM (SELECT DISTINCT subject_id, specimen_type, study_day FROM rsamples) s
  JOIN history h ON h.subject_id = s.subject_id AND h.study_day = s.study_day
  WHERE h.day_lag = 0 AND s.study_day > 0 GROUP BY 1, 2)""",
        f"""SELECT specimen_type, {sql_r6("median(n)")} AS med_abx_no,
  {sql_r6("quantile_cont(n, 0.75) - quantile_cont(n, 0.25)")} AS iqr_abx_no FROM loads GROUP BY 1""",
    ),
    "A11_observed_distinct": with_ctes(*CONTINUOUS, "SELECT DISTINCT subjects, abx_lag, k FROM d5"),
    "F3_math_functions": f"""SELECT event_id, {sql_r6("exp(value / 100)")} AS e, {sql_r6("ln(value + 1)")} AS l,
  {sql_r6("sqrt(value)")} AS root, CAST(floor(value) AS BIGINT) AS down,
  CAST(trunc(abs(value - 50)) AS INT) AS away,
  CASE WHEN user_id % 3 <> 0 THEN {sql_r6("100.0 * value / (user_id % 3)")} END AS ratio FROM events""",
    "F4_conditional_functions": with_ctes(
        r.RAW_SAMPLES,
        """SELECT specimen_id2, CASE WHEN study_day < 100 THEN 'early' WHEN study_day >= 1000 THEN 'late'
  ELSE 'middle' END AS phase, coalesce(specimen_type, 'none') AS kind, subject_id IS NULL AS missing FROM raw""",
    ),
    "F5_truncate": with_ctes(
        r.RAW_SAMPLES,
        """SELECT specimen_id2, CASE WHEN study_day % 7 = 0 THEN NULL
  ELSE least(study_day, 500) END AS capped FROM raw""",
    ),
    "F6_recode": """SELECT event_id, CASE event_type WHEN 'click' THEN 'Click' WHEN 'purchase' THEN 'Purchase/Click'
  ELSE event_type END AS label FROM events""",
}

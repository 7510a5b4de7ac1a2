"""Queries on set C: posterior draws, model quantities and sampler diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abundex.functions.expressions import any_bit, quotient
from abundex.operators import diagnostics, diversity, exposure, frame, model, posterior
from abundex.operators.drawblocks import exploded, spread_blocks, undrawn
from abundex.operators.model import VARIANTS, Scales
from abundex.schemas import ModelFrame
from abundex.session import fresh_path
from abundex.sources import tables
from catalog import exposure as e
from catalog import roles as r
from catalog.roles import r6, rounded, sql_r6, with_ctes

WIDTH = 0.5
LABELS = {"click.purchase": "Click/Purchase", "signup": "Signup"}
SAMPLED_DRAWS = 150
CODE_BITS = 64


# --- draws and effects -------------------------------------------------------------


def s6_draws_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "draws")
    for name, group in (("first", 0), ("second", 1)):
        half = r.draws(spark, d).filter(F.col("chain") % 2 == group)
        tables.write_draws(half, path, name)
    return rounded(tables.read_draws(spark, path), "value")


def _spread(spark: SparkSession, d: str) -> DataFrame:
    return posterior.spread_draws(
        r.draws(spark, d), "a", "a_subj[i]", "b_abx2[i,j,k]", "b_lag", "sigma"
    )


def n10_spread_draws(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_spread(spark, d), "a", "a_subj", "b_abx2", "b_lag", "sigma")


def _contrast(spark: SparkSession, d: str, **options) -> DataFrame:
    columns = ("with_abx", "without_abx", "difference")
    found = posterior.effect_contrast(_spread(spark, d), **options)
    return rounded(found.select("draw", "i", "j", "k", *columns), *columns)


def b1_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _contrast(spark, d)


def b1_difference(spark: SparkSession, d: str) -> DataFrame:
    return _contrast(spark, d, kind="difference", lag_term=None)


def b1_log_difference(spark: SparkSession, d: str) -> DataFrame:
    return _contrast(spark, d, kind="log", lag_term=None)


def w11_cumulative_effect(spark: SparkSession, d: str) -> DataFrame:
    effects = posterior.spread_draws(r.draws(spark, d), "b_abx2[i,j,k]")
    return rounded(posterior.cumulative_effect(effects), "b_abx2", "b_abx_agg")


def b1_cumulative(spark: SparkSession, d: str) -> DataFrame:
    running = posterior.cumulative_effect(_spread(spark, d))
    found = posterior.effect_contrast(running, "b_abx_agg")
    return rounded(found.select("draw", "i", "j", "k", "difference"), "difference")


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    contrast = posterior.effect_contrast(_spread(spark, d))
    limit = posterior.interval_limit(r.draws(spark, d))
    return posterior.median_qi(contrast, ["i", "j", "k"], ["b_abx2", "difference"], WIDTH, limit)


def b2_median_qi(spark: SparkSession, d: str) -> DataFrame:
    found = _intervals(spark, d)
    return rounded(found, *(c for c in found.columns if c not in ("i", "j", "k")))


def b3_scale_summary(spark: SparkSession, d: str) -> DataFrame:
    found = posterior.scale_summary(r.draws(spark, d), WIDTH)
    return rounded(found, "s_abx2", "s_abx2_lower", "s_abx2_upper")


def _named(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Effect intervals of all subjects under their labels, and the frame rows they belong to."""
    built = e._continuous(spark, d)
    subjects = r.fitted_codes(frame.label_index(built.obs, "subjects"))
    exposures = frame.label_index(built.kept, "abx_lag")
    steps = frame.label_index(built.design, "k")
    effects = posterior.block_effects(r.blocks(spark, d), ["b_abx2", "difference"], WIDTH)
    return posterior.all_labelled(effects, subjects, exposures, steps), built.rows


def j9_observed_combos(spark: SparkSession, d: str) -> DataFrame:
    effects, rows = _named(spark, d)
    kept = posterior.observed_combos(effects, posterior.observed_distinct(rows))
    return rounded(kept.select("subjects", "abx_lag", "k", "difference"), "difference")


def j9_flag_observed(spark: SparkSession, d: str) -> DataFrame:
    """With differently named keys on the two sides."""
    effects, rows = _named(spark, d)
    effects = effects.withColumnRenamed("abx_lag", "abx")
    names = {"subjects": "subjects", "abx": "abx_lag", "k": "k"}
    marked = posterior.flag_observed(effects, posterior.observed_distinct(rows), names)
    return rounded(marked.select("subjects", "abx", "k", "observed", "difference"), "difference")


def _start(spark: SparkSession, d: str) -> DataFrame:
    start = diversity.baseline_diversity(r.rekeyed_event_samples(spark, d), r.event_counts(spark, d))
    return start.filter(F.col("specimen_type") == e.TYPE).withColumnRenamed(
        "subject_id", "subjects"
    )


def j10_subject_covariate(spark: SparkSession, d: str) -> DataFrame:
    effects, rows = _named(spark, d)
    joined = posterior.subject_covariate_join(effects, _start(spark, d), rows, ["D1_start"])
    columns = ("difference", "D1_start")
    return rounded(joined.select("subjects", "abx_lag", "k", *columns), *columns)


def b4_effect_table(spark: SparkSession, d: str) -> DataFrame:
    built = e._continuous(spark, d)
    found = posterior.effect_table(
        r.blocks(spark, d),
        built.rows,
        r.fitted_codes(frame.label_index(built.obs, "subjects")),
        frame.label_index(built.kept, "abx_lag"),
        frame.label_index(built.design, "k"),
        covariate=_start(spark, d),
        covariate_columns=["D1_start"],
        exposures=["click.purchase", "signup"],
        labels=LABELS,
        width=WIDTH,
    )
    return rounded(found, "difference", "difference_lower", "difference_upper", "D1_start")


def b4_lag_table(spark: SparkSession, d: str) -> DataFrame:
    """On the lag frame, whose k starts at 0."""
    built = e._lag(spark, d)
    found = posterior.effect_table(
        r.blocks(spark, d),
        built.rows,
        r.fitted_codes(frame.label_index(built.obs, "subjects")),
        frame.label_index(built.kept, "abx_lag"),
        frame.label_index(built.design, "k"),
        width=WIDTH,
    )
    columns = ("difference", "difference_lower", "difference_upper")
    return rounded(found.select("subjects", "abx_lag", "k", *columns), *columns)


def b4_effects_by_stain(spark: SparkSession, d: str) -> DataFrame:
    """The effects next to the share of one stain at the subject's baseline."""
    built = e._continuous(spark, d)
    start = diversity.starting_stain_proportions(
        r.rekeyed_event_samples(spark, d),
        r.event_counts(spark, d),
        r.event_taxonomy(spark, d),
        r.event_stains(spark, d),
    )
    found = posterior.effect_table(
        r.blocks(spark, d),
        built.rows,
        r.fitted_codes(frame.label_index(built.obs, "subjects")),
        frame.label_index(built.kept, "abx_lag"),
        frame.label_index(built.design, "k"),
        covariate=start.filter(F.col("specimen_type") == e.TYPE),
        covariate_columns=["stain", "stain_prop"],
        labels=LABELS,
        width=WIDTH,
    ).filter(F.col("stain") == "GN")
    return rounded(found, "difference", "difference_lower", "difference_upper", "stain_prop")


def o3_sample_groups(spark: SparkSession, d: str) -> DataFrame:
    return posterior.sample_groups(r.draws(spark, d), 150)


def w13_draw_group_index(spark: SparkSession, d: str) -> DataFrame:
    levels = posterior.spread_draws(r.draws(spark, d), "a_subj[i]")
    numbered = posterior.draw_group_index(levels, "i", "draw")
    return numbered.select("i", "draw", "group")


# --- rollout -------------------------------------------------------------------------


def _series(spark: SparkSession, d: str) -> DataFrame:
    """Share of feature 0 per specimen, its predecessor, and the exposure window."""
    counts = r.event_counts(spark, d).groupBy("specimen_id2").agg(
        F.sum(F.when(F.col("otu_id") == 0, F.col("read_count")).otherwise(0)).alias("read_count"),
        F.sum("read_count").alias("total_reads"),
    )
    day = F.datediff("collection_date", F.lit("2024-01-01").cast("date"))
    given = r.event_exposures(spark, d).select(
        "subject_id", day.alias("study_day"), F.col("abx_b").contains("error").alias("given")
    )
    rows = (
        r.event_samples(spark, d)
        .select("specimen_id2", "subject_id", "study_day")
        .join(counts, "specimen_id2")
        .join(exposure.effective_window(given, "given", 1), ["subject_id", "study_day"])
        .withColumn("share", quotient(F.col("read_count"), F.col("total_reads")))
    )
    lagged = diversity.lagged_response(rows, "share", out="lag_emp_prop")
    return lagged.select(
        "subject_id", "specimen_id2", "study_day", "read_count", "total_reads", "on_abx", "lag_emp_prop"
    )


def _rollout_draws(spark: SparkSession, d: str) -> DataFrame:
    """Sampled draws of every subject, each reading one of the four subjects' positions."""
    draws = r.draws(spark, d)
    subjects = frame.label_index(r.event_samples(spark, d), "subject_id")
    levels = posterior.spread_draws(draws, "a", "b_lag", "a_subj[i]")
    chosen = levels.join(posterior.sample_groups(draws, SAMPLED_DRAWS), "draw", "left_semi")
    codes = subjects.select("subject_id", (F.pmod(F.col("idx") - 1, F.lit(4)) + 1).cast("int").alias("i"))
    return chosen.join(codes, "i").drop("i")


def _link(specimen: Column, previous: Column) -> Column:
    on = F.when(specimen["on_abx"], F.lit(0.5)).otherwise(F.lit(0.0))
    level = F.col("a") + F.col("a_subj") + F.col("b_lag") * previous + on
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-level))


def _python_link(params, specimen, previous):
    import numpy as np

    level = params["a"] + params["a_subj"] + params["b_lag"] * previous + 0.5 * specimen["on_abx"]
    return 1.0 / (1.0 + np.exp(-level.to_numpy()))


def _predicted(spark: SparkSession, d: str, link, python: bool) -> DataFrame:
    found = posterior.pp_rollout(
        _rollout_draws(spark, d), _series(spark, d), link, python=python
    )
    columns = ("pred_prob", "emp_prob")
    return rounded(posterior.with_empirical(found), *columns).select(
        "draw", "subject_id", "specimen_id2", *columns
    )


def b5_pp_rollout(spark: SparkSession, d: str) -> DataFrame:
    return _predicted(spark, d, _link, False)


def h1_python_link(spark: SparkSession, d: str) -> DataFrame:
    return _predicted(spark, d, _python_link, True)


# --- model quantities -------------------------------------------------------------------


def b6_noncentered_effects(spark: SparkSession, d: str) -> DataFrame:
    found = model.noncentered_effects(r.raw_effect_draws(spark, d), VARIANTS["3.8"])
    return rounded(found, "b_abx2")


def _indexed_frame(built: ModelFrame) -> tuple[DataFrame, DataFrame]:
    subjects = r.fitted_codes(frame.label_index(built.obs, "subjects"))
    i = subjects.select("subjects", F.col("idx").cast("int").alias("i"))
    j = frame.label_index(built.kept, "abx_lag").select("abx_lag", F.col("idx").cast("int").alias("j"))
    k = frame.label_index(built.design, "k").select("k", F.col("idx").cast("int").alias("_k"))
    obs = built.obs.join(i, "subjects").drop("subjects")
    coded = built.design.join(i, "subjects").join(j, "abx_lag").join(k, "k")
    design = coded.select("specimens", "i", "j", F.col("_k").alias("k"))
    return obs, design


def _predictor(spark: SparkSession, d: str, build=e._continuous, variant: str = "3.5") -> DataFrame:
    """The predictor of every specimen of a frame, in blocks of draws."""
    obs, design = _indexed_frame(build(spark, d))
    blocks = r.blocks(spark, d)
    effects = spread_blocks(blocks, "b_abx2[i,j,k]")
    return model.predictor_blocks(obs, design, effects, blocks, VARIANTS[variant])


def b7_linear_predictor(spark: SparkSession, d: str) -> DataFrame:
    return rounded(exploded(_predictor(spark, d), ["specimens"], ["mu"]), "mu")


def b8_pointwise_loglik(spark: SparkSession, d: str) -> DataFrame:
    return rounded(model.pointwise_loglik(_predictor(spark, d)), "log_lik")


def b7_lag_predictor(spark: SparkSession, d: str) -> DataFrame:
    return rounded(exploded(_predictor(spark, d, e._lag, "3.4"), ["specimens"], ["mu"]), "mu")


def b8_lag_loglik(spark: SparkSession, d: str) -> DataFrame:
    return rounded(model.pointwise_loglik(_predictor(spark, d, e._lag, "3.4")), "log_lik")


def b7_undrawn_subjects(spark: SparkSession, d: str) -> DataFrame:
    """The subjects of a frame for which a fit of four subjects has no draws."""
    built = e._continuous(spark, d)
    return undrawn(built.obs, frame.label_index(built.obs, "subjects"), r.draws(spark, d))


def b9_log_prior(spark: SparkSession, d: str) -> DataFrame:
    found = model.log_prior(r.raw_effect_draws(spark, d), VARIANTS["3.8"])
    return rounded(found, "log_prior")


def b10_gram_statistics(spark: SparkSession, d: str) -> DataFrame:
    built = e._continuous(spark, d)
    return rounded(model.gram_statistics(built.obs, built.design), "value")


def b11_conditional_fit(spark: SparkSession, d: str) -> DataFrame:
    """One fit for the subjects with even and one for those with odd numbers."""
    built = e._continuous(spark, d)
    even = F.substring("subjects", -1, 1).isin("0", "2", "4", "6", "8")
    gram = model.gram_statistics(
        built.obs.withColumn("model", F.when(even, "even").otherwise("odd")),
        built.design,
        ["model", "subjects"],
    )
    found = model.conditional_map_fit(gram, VARIANTS["3.5"], Scales(0.4, 0.5, 0.5))
    return rounded(found, "value")


# --- diagnostics ---------------------------------------------------------------------------


def k1_check_div(spark: SparkSession, d: str) -> DataFrame:
    return rounded(diagnostics.check_div(r.sampler(spark, d)), "percent")


def k2_check_treedepth(spark: SparkSession, d: str) -> DataFrame:
    return rounded(diagnostics.check_treedepth(r.sampler(spark, d)), "percent")


def w12_energy_diff(spark: SparkSession, d: str) -> DataFrame:
    found = diagnostics.energy_diff(r.sampler(spark, d))
    return found.select("chain", "iteration", r6("energy_diff").alias("energy_diff"))


def k3_check_energy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(diagnostics.check_energy(r.sampler(spark, d)), "e_fmi")


def k4_check_n_eff(spark: SparkSession, d: str) -> DataFrame:
    return rounded(diagnostics.check_n_eff(r.draws(spark, d)), "n_eff", "ratio")


def k5_check_rhat(spark: SparkSession, d: str) -> DataFrame:
    return rounded(diagnostics.check_rhat(r.draws(spark, d)), "rhat")


def k6_khat(spark: SparkSession, d: str) -> DataFrame:
    """Of every parameter; those with values that are not positive have 0."""
    return rounded(diagnostics.khat(r.draws(spark, d), ["parameter"], "value"), "khat")


def k7_tail_khats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(diagnostics.tail_khats(r.draws(spark, d)), "khat_left", "khat_right")


def k8_check_tail_khat(spark: SparkSession, d: str) -> DataFrame:
    found = diagnostics.check_tail_khat(r.draws(spark, d))
    return found.select("parameter", "warn_left", "warn_right")


def k9_check_all(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.check_all_diagnostics(r.draws(spark, d), r.sampler(spark, d))


def k10_parse_warning_code(spark: SparkSession, d: str) -> DataFrame:
    code = (F.col("user_id") % CODE_BITS).cast("int")
    coded = r.table(spark, d, "events").select("event_id", code.alias("code"))
    listed = F.array_join(diagnostics.parse_warning_code(F.col("code")), "; ")
    return coded.select("event_id", "code", listed.alias("warnings"))


def f7_bitmask(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    flags = {0: kind == "click", 1: F.col("value") > 20, 4: F.col("user_id") % 2 == 0}
    return r.table(spark, d, "events").select("event_id", any_bit(flags).alias("mask"))


def u2_stack_chains(spark: SparkSession, d: str) -> DataFrame:
    chains = [r.draws(spark, d).filter(F.col("chain") == c) for c in range(4)]
    stacked = diagnostics.stack_chains(chains)
    return rounded(
        stacked.groupBy("chain", "parameter").agg(
            F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")
        ),
        "mean",
    )


def u3_partition_divergent(spark: SparkSession, d: str) -> DataFrame:
    parts = diagnostics.partition_divergent(r.draws(spark, d), r.sampler(spark, d))
    counted = [
        part.groupBy("parameter").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"))
        for part in parts
    ]
    named = [part.withColumn("divergent", F.lit(1 - i)) for i, part in enumerate(counted)]
    return named[0].unionByName(named[1])


QUERIES = {
    "S6_draws_roundtrip": s6_draws_roundtrip,
    "N10_spread_draws": n10_spread_draws,
    "B1_ratio": b1_ratio,
    "B1_difference": b1_difference,
    "B1_log_difference": b1_log_difference,
    "W11_cumulative_effect": w11_cumulative_effect,
    "B1_cumulative": b1_cumulative,
    "B2_median_qi": b2_median_qi,
    "B3_scale_summary": b3_scale_summary,
    "J9_observed_combos": j9_observed_combos,
    "J9_flag_observed": j9_flag_observed,
    "J10_subject_covariate": j10_subject_covariate,
    "B4_effect_table": b4_effect_table,
    "B4_effects_by_stain": b4_effects_by_stain,
    "B4_lag_table": b4_lag_table,
    "B7_lag_predictor": b7_lag_predictor,
    "B7_undrawn_subjects": b7_undrawn_subjects,
    "B8_lag_loglik": b8_lag_loglik,
    "O3_sample_groups": o3_sample_groups,
    "W13_draw_group_index": w13_draw_group_index,
    "B5_pp_rollout": b5_pp_rollout,
    "H1_python_link": h1_python_link,
    "B6_noncentered_effects": b6_noncentered_effects,
    "B7_linear_predictor": b7_linear_predictor,
    "B8_pointwise_loglik": b8_pointwise_loglik,
    "B9_log_prior": b9_log_prior,
    "B10_gram_statistics": b10_gram_statistics,
    "B11_conditional_fit": b11_conditional_fit,
    "K1_check_div": k1_check_div,
    "K2_check_treedepth": k2_check_treedepth,
    "W12_energy_diff": w12_energy_diff,
    "K3_check_energy": k3_check_energy,
    "K4_check_n_eff": k4_check_n_eff,
    "K5_check_rhat": k5_check_rhat,
    "K6_khat": k6_khat,
    "K7_tail_khats": k7_tail_khats,
    "K8_check_tail_khat": k8_check_tail_khat,
    "K9_check_all": k9_check_all,
    "K10_parse_warning_code": k10_parse_warning_code,
    "F7_bitmask": f7_bitmask,
    "U2_stack_chains": u2_stack_chains,
    "U3_partition_divergent": u3_partition_divergent,
}


# --- the same in SQL ---------------------------------------------------------------------------

_BASE = '(a + a_subj + b_lag * 3)'
_QI = """qi AS (
  SELECT i, j, k, quantile_cont(difference, 0.5) AS difference,
    quantile_cont(difference, 0.25) AS difference_lower, quantile_cont(difference, 0.75) AS difference_upper,
    quantile_cont(b_abx2, 0.5) AS b_abx2, quantile_cont(b_abx2, 0.25) AS b_abx2_lower,
    quantile_cont(b_abx2, 0.75) AS b_abx2_upper
  FROM (SELECT *, exp(a + a_subj + b_abx2 + b_lag * 3) / exp(a + a_subj + b_lag * 3) AS difference FROM effects)
  GROUP BY 1, 2, 3)"""
_LABELS = """sidx AS (SELECT subjects, dense_rank() OVER (ORDER BY subjects) AS i FROM (SELECT DISTINCT subjects FROM d5)),
aidx AS (SELECT abx_lag, dense_rank() OVER (ORDER BY abx_lag) AS j FROM kept),
kidx AS (SELECT k, dense_rank() OVER (ORDER BY k) AS code FROM (SELECT DISTINCT k FROM design))"""
_NAMED = """named AS (
  SELECT s.subjects, a.abx_lag, x.k, q.* EXCLUDE (i, j, k)
  FROM qi q JOIN sidx s USING (i) JOIN aidx a USING (j) JOIN kidx x ON x.code = q.k),
marked AS (
  SELECT n.*, coalesce(o.seen, false) AS observed
  FROM (SELECT DISTINCT subjects, abx_lag, k, true AS seen FROM d5) o RIGHT JOIN named n
    ON o.subjects = n.subjects AND o.abx_lag = n.abx_lag AND o.k = n.k)"""
_START = f"""start AS (
  SELECT DISTINCT subject_id AS subjects, "D1" AS d1_start FROM (
    SELECT s.subject_id, s.specimen_type, d."D1",
      rank() OVER (PARTITION BY s.subject_id, s.specimen_type ORDER BY s.study_day) AS pos
    FROM rsamples s JOIN d1 d USING (specimen_id2))
  WHERE pos = 1 AND specimen_type = '{e.TYPE}'),
covered AS (
  SELECT DISTINCT d5.subjects, start.d1_start FROM start RIGHT JOIN d5 ON d5.subjects = start.subjects)"""
_STAINS = f"""sgenus AS (
  SELECT c.specimen_id2, CASE c.otu_id % 3 WHEN 0 THEN 'GN' WHEN 1 THEN 'GP' END AS stain,
    sum(c.read_count) / any_value(t.total)::DOUBLE AS stain_prop
  FROM counts c JOIN (SELECT specimen_id2, sum(read_count) AS total FROM counts GROUP BY 1) t USING (specimen_id2)
  GROUP BY 1, 2),
sranked AS (
  SELECT s.subject_id AS subjects, s.specimen_type, g.stain, g.stain_prop,
    rank() OVER (PARTITION BY s.subject_id, s.specimen_type ORDER BY s.study_day) AS pos
  FROM sgenus g JOIN rsamples s USING (specimen_id2)),
sgrid AS (
  SELECT * FROM (SELECT DISTINCT subjects FROM sranked) CROSS JOIN (SELECT DISTINCT specimen_type FROM sranked)
  CROSS JOIN (SELECT DISTINCT stain FROM sranked WHERE pos = 1)),
sstart AS (
  SELECT DISTINCT g.subjects, g.stain, coalesce(r.stain_prop, 0) AS stain_prop
  FROM sgrid g LEFT JOIN (SELECT * FROM sranked WHERE pos = 1) r
    ON r.subjects = g.subjects AND r.specimen_type = g.specimen_type AND r.stain IS NOT DISTINCT FROM g.stain
  WHERE g.specimen_type = '{e.TYPE}')"""
_NAMED_BASE = (*e.CONTINUOUS, e.DESIGN, _LABELS, r.all_effects("sidx"), _QI, _NAMED)
_MU = """iobs AS (
  SELECT DISTINCT d5.specimens, s.i, d5."D1", d5."D1_lag" FROM d5 JOIN sidx s ON s.subjects = d5.subjects),
ides AS (
  SELECT d.specimens, s.i, a.j, x.code AS k
  FROM design d JOIN sidx s USING (subjects) JOIN aidx a USING (abx_lag) JOIN kidx x ON x.k = d.k),
dense AS (
  SELECT e.draw, o.specimens, o."D1", e.sigma, e.a + e.a_subj + e.b_lag * o."D1_lag" AS base,
    e.b_abx2 * CAST(x.specimens IS NOT NULL AS INT) AS term
  FROM iobs o JOIN effects e ON e.i = o.i
  LEFT JOIN ides x ON x.specimens = o.specimens AND x.j = e.j AND x.k = e.k),
mus AS (SELECT draw, specimens, "D1", sigma, base + sum(term) AS mu FROM dense GROUP BY draw, specimens, "D1", sigma, base)"""
_MU_BASE = (*e.CONTINUOUS, e.DESIGN, _LABELS, r.all_effects("sidx"), _MU)
_LAG_MU_BASE = (*e.LAG, e.DESIGN, _LABELS, r.all_effects("sidx"), _MU)
_PICKED = f"""picked AS (
  SELECT draw FROM (SELECT DISTINCT draw FROM draws) ORDER BY md5(concat_ws('|', draw, '1988')), draw LIMIT {{n}})"""
_ROLLOUT = f"""
shares AS (
  SELECT specimen_id2, sum(CASE WHEN otu_id = 0 THEN read_count ELSE 0 END) AS hits, sum(read_count) AS total
  FROM counts GROUP BY 1),
flags AS (SELECT subject_id, date_diff('day', DATE '2024-01-01', collection_date) AS study_day,
  coalesce(contains(abx_b, 'error'), false) AS given FROM meds),
on_off AS (SELECT *, given OR coalesce(lag(given) OVER (PARTITION BY subject_id ORDER BY study_day), false) AS on_abx FROM flags),
series AS (
  SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY study_day) AS n FROM (
    SELECT s.specimen_id2, s.subject_id, s.study_day, h.hits / h.total::DOUBLE AS share, o.on_abx,
      lag(h.hits / h.total::DOUBLE) OVER (PARTITION BY s.subject_id ORDER BY s.study_day) AS before
    FROM esamples s JOIN shares h USING (specimen_id2)
    JOIN on_off o ON o.subject_id = s.subject_id AND o.study_day = s.study_day) WHERE before IS NOT NULL),
sidx AS (SELECT subject_id, dense_rank() OVER (ORDER BY subject_id) AS i FROM (SELECT DISTINCT subject_id FROM esamples)),
params AS (
  SELECT DISTINCT e.draw, s.subject_id, e.a, e.b_lag, e.a_subj FROM effects e JOIN sidx s ON (s.i - 1) % 4 + 1 = e.i
  WHERE e.draw IN (SELECT draw FROM picked)),
walk AS (
  SELECT p.*, s.n, s.specimen_id2, s.share,
    1 / (1 + exp(-(p.a + p.a_subj + p.b_lag * s.before + CASE WHEN s.on_abx THEN 0.5 ELSE 0 END))) AS pred
  FROM params p JOIN series s ON s.subject_id = p.subject_id AND s.n = 1
  UNION ALL
  SELECT w.draw, w.subject_id, w.a, w.b_lag, w.a_subj, s.n, s.specimen_id2, s.share,
    1 / (1 + exp(-(w.a + w.a_subj + w.b_lag * w.pred + CASE WHEN s.on_abx THEN 0.5 ELSE 0 END)))
  FROM walk w JOIN series s ON s.subject_id = w.subject_id AND s.n = w.n + 1)"""
_ROLLOUT_SQL = with_ctes(
    r.EVENT_EXPOSURES,
    r.EVENT_SAMPLES,
    r.EVENT_COUNTS,
    r.DRAWS,
    r.EFFECTS,
    _PICKED.format(n=SAMPLED_DRAWS),
    _ROLLOUT,
    f"""SELECT draw, subject_id, specimen_id2, {sql_r6("pred")} AS pred_prob, {sql_r6("share")} AS emp_prob FROM walk""",
).replace("WITH ", "WITH RECURSIVE ", 1)
_RAW = """raw_draws AS (
  SELECT draw, split_part(parameter, '[', 1) AS base, p, value FROM draws)"""
_L2PI = "0.5 * ln(2 * pi())"


def _normal(x: str, mean: str, sd: str) -> str:
    return f"(-ln({sd}) - {_L2PI} - 0.5 * (({x} - {mean}) / {sd}) ** 2)"


_PRIOR = f"""terms AS (
  SELECT r.draw, CASE r.base
    WHEN 'a' THEN {_normal("r.value", "0", "1")} WHEN 'b_lag' THEN {_normal("r.value", "0", "5")}
    WHEN 'sigma' THEN {_normal("r.value", "0", "5")} WHEN 's_subj' THEN {_normal("r.value", "0", "5")}
    WHEN 'a_subj' THEN {_normal("r.value", "0", "s.value")}
    WHEN 'za_abx2' THEN {_normal("r.value", "0", "3")} WHEN 's_abx2' THEN {_normal("r.value", "0", "3")}
    WHEN 'b_abx2' THEN {_normal("r.value", "0", "1")} END AS term
  FROM raw_draws r JOIN raw_draws s ON s.draw = r.draw AND s.base = 's_subj')"""
_ENTRIES = """wide AS (SELECT DISTINCT specimens, subjects, "D1", "D1_lag" FROM d5),
entries AS (
  SELECT specimens, subjects, '1' AS name, 1.0::DOUBLE AS v FROM wide
  UNION ALL SELECT specimens, subjects, 'y', ln("D1") FROM wide
  UNION ALL SELECT specimens, subjects, 'D1_lag', "D1_lag" FROM wide
  UNION ALL SELECT specimens, subjects, 'x[' || abx_lag || ',' || k || ']', 1.0 FROM design)"""
_ENERGY = """steps AS (
  SELECT *, energy - lag(energy) OVER (PARTITION BY chain ORDER BY iteration) AS step FROM sampler),
efmi AS (
  SELECT chain, sum(step * step) / count(*) / var_samp(energy) AS e_fmi FROM steps GROUP BY 1)"""
_ESS = """centred AS (
  SELECT parameter, chain, row_number() OVER (PARTITION BY parameter, chain ORDER BY iteration) AS pos,
    value - avg(value) OVER (PARTITION BY parameter, chain) AS x,
    count(*) OVER (PARTITION BY parameter, chain) AS n FROM draws),
acov AS (
  SELECT a.parameter, a.chain, b.pos - a.pos AS lag, sum(a.x * b.x) / any_value(a.n) AS v
  FROM centred a JOIN centred b ON b.parameter = a.parameter AND b.chain = a.chain AND b.pos >= a.pos
  GROUP BY 1, 2, 3),
chain_stats AS (
  SELECT parameter, chain, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM draws GROUP BY 1, 2),
pooled AS (
  SELECT parameter, sum(n) AS total, avg(v) AS w, avg((n - 1) / n::DOUBLE * v) + var_samp(m) AS vplus
  FROM chain_stats GROUP BY 1),
rho AS (
  SELECT parameter, lag, CASE WHEN lag = 0 THEN 1.0 ELSE 1 - (w - avg(v)) / vplus END AS rho, total
  FROM acov JOIN pooled USING (parameter) GROUP BY parameter, lag, w, vplus, total),
pairs AS (
  SELECT parameter, total, lag // 2 AS t, sum(rho) AS s FROM rho GROUP BY 1, 2, 3 HAVING count(*) = 2),
monotone AS (SELECT *, min(s) OVER (PARTITION BY parameter ORDER BY t) AS low FROM pairs),
ess AS (
  SELECT parameter, total / (-1 + 2 * sum(low) FILTER (low > 0)) AS n_eff, total AS n_draws
  FROM monotone GROUP BY parameter, total)"""
_RHAT = """placed AS (
  SELECT *, row_number() OVER (PARTITION BY parameter, chain ORDER BY iteration) AS pos,
    count(*) OVER (PARTITION BY parameter, chain) AS n FROM draws),
halves AS (
  SELECT parameter, chain, pos > n // 2 AS late, count(*) AS c, avg(value) AS m, var_samp(value) AS v
  FROM placed WHERE pos <= n // 2 OR pos > n - n // 2 GROUP BY 1, 2, 3),
rhats AS (
  SELECT parameter, sqrt(((avg(c) - 1) / avg(c) * avg(v) + var_samp(m)) / avg(v)) AS rhat FROM halves GROUP BY 1)"""


def _khats(source: str) -> str:
    """Tail index from the sorted values, one row per value and candidate."""
    return f"""ordered AS (
  SELECT g, x, row_number() OVER (PARTITION BY g ORDER BY x) AS pos, count(*) OVER (PARTITION BY g) AS n,
    min(x) OVER (PARTITION BY g) AS lo, max(x) OVER (PARTITION BY g) AS hi FROM {source}),
quarters AS (
  SELECT g, any_value(n) AS n, any_value(lo) AS lo, any_value(hi) AS hi,
    max(CASE WHEN pos = floor(0.25 * n + 0.5) THEN x END) AS q FROM ordered GROUP BY 1),
candidates AS (
  SELECT g, n, 1 / hi + (1 - sqrt((20 + floor(sqrt(n))) / (m - 0.5))) / (3 * q) AS b
  FROM quarters, LATERAL (SELECT unnest(range(1, CAST(21 + floor(sqrt(n)) AS BIGINT))) AS m) WHERE lo > 0),
scored AS (
  SELECT c.g, c.b, c.n, -avg(ln(1 - c.b * o.x)) AS k FROM candidates c JOIN ordered o ON o.g = c.g GROUP BY 1, 2, 3),
logw AS (SELECT g, b, n * (ln(b / k) + k - 1) AS w FROM scored),
topw AS (SELECT *, max(w) OVER (PARTITION BY g) AS top FROM logw),
best AS (SELECT g, sum(b * exp(w - top)) / sum(exp(w - top)) AS b FROM topw GROUP BY 1),
khats AS (
  SELECT q.g, coalesce((SELECT avg(ln(1 - b.b * o.x)) FROM ordered o JOIN best b ON b.g = o.g WHERE o.g = q.g), 0) AS khat
  FROM quarters q)"""


_SIDES = """medians AS (
  SELECT parameter, median(value) AS med, min(value) AS lo, max(value) AS hi FROM draws GROUP BY 1),
sides AS (
  SELECT d.parameter || CASE WHEN value <= med THEN '/left' ELSE '/right' END AS g, abs(value - med) AS x
  FROM draws d JOIN medians m ON m.parameter = d.parameter WHERE med <> lo AND med <> hi)"""
_TAILS = """tails AS (
  SELECT m.parameter, coalesce(l.khat, 0) AS khat_left, coalesce(t.khat, 0) AS khat_right FROM medians m
  LEFT JOIN khats l ON l.g = m.parameter || '/left' LEFT JOIN khats t ON t.g = m.parameter || '/right')"""


def _share_sql(bad: str) -> str:
    return f"""SELECT count(*) FILTER ({bad}) AS n, count(*) AS n_total,
  {sql_r6(f"100.0 * count(*) FILTER ({bad}) / count(*)")} AS percent, count(*) FILTER ({bad}) > 0 AS warn FROM sampler"""


def _contrast_sql(with_abx: str, without: str, difference: str) -> str:
    return with_ctes(
        r.EFFECTS,
        f"""SELECT draw, i, j, k, {sql_r6(with_abx)} AS with_abx, {sql_r6(without)} AS without_abx,
  {sql_r6(difference)} AS difference FROM effects""",
    )


SQL = {
    "S6_draws_roundtrip": with_ctes(
        r.DRAWS,
        f"""SELECT chain, iteration, draw, parameter, {sql_r6("value")} AS value,
  CASE WHEN chain % 2 = 0 THEN 'first' ELSE 'second' END AS model FROM draws""",
    ),
    "N10_spread_draws": with_ctes(
        r.EFFECTS,
        f"""SELECT draw, i, j, k, {", ".join(f"{sql_r6(c)} AS {c}" for c in ("a", "a_subj", "b_abx2", "b_lag", "sigma"))}
FROM effects""",
    ),
    "B1_ratio": _contrast_sql(
        "exp(a + a_subj + b_abx2 + b_lag * 3)", f"exp{_BASE}", f"exp(a + a_subj + b_abx2 + b_lag * 3) / exp{_BASE}"
    ),
    "B1_difference": _contrast_sql(
        "exp(a + a_subj + b_abx2)", "exp(a + a_subj)", "exp(a + a_subj + b_abx2) - exp(a + a_subj)"
    ),
    "B1_log_difference": _contrast_sql(
        "a + a_subj + b_abx2", "a + a_subj", "(a + a_subj + b_abx2) - (a + a_subj)"
    ),
    "W11_cumulative_effect": with_ctes(
        r.EFFECTS,
        f"""SELECT x.draw, x.i, x.j, x.k, {sql_r6("x.b_abx2")} AS b_abx2, {sql_r6("sum(y.b_abx2)")} AS b_abx_agg
FROM effects x JOIN effects y ON y.draw = x.draw AND y.i = x.i AND y.j = x.j AND y.k <= x.k
GROUP BY x.draw, x.i, x.j, x.k, x.b_abx2""",
    ),
    "B1_cumulative": with_ctes(
        r.EFFECTS,
        f"""SELECT x.draw, x.i, x.j, x.k, {sql_r6("exp(sum(y.b_abx2))")} AS difference
FROM effects x JOIN effects y ON y.draw = x.draw AND y.i = x.i AND y.j = x.j AND y.k <= x.k
GROUP BY x.draw, x.i, x.j, x.k""",
    ),
    "B2_median_qi": with_ctes(
        r.EFFECTS,
        _QI,
        "SELECT i, j, k, "
        + ", ".join(
            f"{sql_r6(c + suffix)} AS {c}{suffix}"
            for c in ("difference", "b_abx2")
            for suffix in ("", "_lower", "_upper")
        )
        + " FROM qi",
    ),
    "B3_scale_summary": with_ctes(
        """scales AS (SELECT j.j, exp(CAST(embedding[55 + j.j] AS DOUBLE)) AS s FROM embeddings CROSS JOIN range(1, 4) j(j))""",
        f"""SELECT j, {sql_r6("quantile_cont(s, 0.5)")} AS s_abx2, {sql_r6("quantile_cont(s, 0.25)")} AS s_abx2_lower,
  {sql_r6("quantile_cont(s, 0.75)")} AS s_abx2_upper FROM scales GROUP BY 1""",
    ),
    "J9_observed_combos": with_ctes(
        *_NAMED_BASE,
        f"SELECT subjects, abx_lag, k, {sql_r6('difference')} AS difference FROM marked WHERE observed",
    ),
    "J9_flag_observed": with_ctes(
        *_NAMED_BASE,
        f"SELECT subjects, abx_lag AS abx, k, observed, {sql_r6('difference')} AS difference FROM marked",
    ),
    "J10_subject_covariate": with_ctes(
        *_NAMED_BASE,
        _START,
        f"""SELECT n.subjects, n.abx_lag, n.k, {sql_r6("n.difference")} AS difference, {sql_r6("c.d1_start")} AS "D1_start"
FROM covered c RIGHT JOIN named n ON n.subjects = c.subjects""",
    ),
    "B4_effect_table": with_ctes(
        *_NAMED_BASE,
        _START,
        f"""SELECT m.subjects,
  CASE m.abx_lag WHEN 'click.purchase' THEN 'Click/Purchase' WHEN 'signup' THEN 'Signup' ELSE m.abx_lag END AS abx_lag,
  m.k, {sql_r6("m.difference")} AS difference, {sql_r6("m.difference_lower")} AS difference_lower,
  {sql_r6("m.difference_upper")} AS difference_upper, {sql_r6("c.d1_start")} AS "D1_start"
FROM covered c RIGHT JOIN marked m ON m.subjects = c.subjects
WHERE m.observed AND m.abx_lag IN ('click.purchase', 'signup')""",
    ),
    "B4_effects_by_stain": with_ctes(
        *_NAMED_BASE,
        _STAINS,
        f"""SELECT m.subjects,
  CASE m.abx_lag WHEN 'click.purchase' THEN 'Click/Purchase' WHEN 'signup' THEN 'Signup' ELSE m.abx_lag END AS abx_lag,
  m.k, {sql_r6("m.difference")} AS difference, {sql_r6("m.difference_lower")} AS difference_lower,
  {sql_r6("m.difference_upper")} AS difference_upper, s.stain, {sql_r6("s.stain_prop")} AS stain_prop
FROM marked m JOIN sstart s ON s.subjects = m.subjects WHERE m.observed AND s.stain = 'GN'""",
    ),
    "O3_sample_groups": with_ctes(r.DRAWS, _PICKED.format(n=150), "SELECT draw FROM picked"),
    "W13_draw_group_index": """SELECT i, vec_id AS draw, row_number() OVER (PARTITION BY i ORDER BY vec_id) AS "group"
FROM embeddings CROSS JOIN range(1, 5) t(i)""",
    "B5_pp_rollout": _ROLLOUT_SQL,
    "H1_python_link": _ROLLOUT_SQL,
    "B6_noncentered_effects": with_ctes(
        r.EFFECTS,
        f"""SELECT e.draw, e.i, e.j, e.k, {sql_r6(
            "CAST(m.embedding[59 + e.j] AS DOUBLE) + e.b_abx2 * exp(CAST(m.embedding[55 + e.j] AS DOUBLE))")} AS b_abx2
FROM effects e JOIN embeddings m ON m.vec_id = e.draw""",
    ),
    "B7_linear_predictor": with_ctes(
        *_MU_BASE, f"SELECT draw, specimens, {sql_r6('mu')} AS mu FROM mus"
    ),
    "B8_pointwise_loglik": with_ctes(
        *_MU_BASE,
        f"""SELECT draw, specimens,
  {sql_r6('-ln("D1") - ln(sigma) - 0.5 * ln(2 * pi()) - ((ln("D1") - mu) / sigma) ** 2 / 2')} AS log_lik FROM mus""",
    ),
    "B4_lag_table": with_ctes(
        *e.LAG,
        e.DESIGN,
        _LABELS,
        r.all_effects("sidx"),
        _QI,
        _NAMED,
        f"""SELECT subjects, abx_lag, k, {sql_r6("difference")} AS difference,
  {sql_r6("difference_lower")} AS difference_lower, {sql_r6("difference_upper")} AS difference_upper
FROM marked WHERE observed""",
    ),
    "B7_lag_predictor": with_ctes(
        *_LAG_MU_BASE, f"SELECT draw, specimens, {sql_r6('mu')} AS mu FROM mus"
    ),
    "B7_undrawn_subjects": with_ctes(
        *e.CONTINUOUS,
        e.DESIGN,
        _LABELS,
        """SELECT d5.subjects, count(DISTINCT d5.specimens) AS n_specimens
FROM d5 JOIN sidx s ON s.subjects = d5.subjects WHERE s.i > 4 GROUP BY 1""",
    ),
    "B8_lag_loglik": with_ctes(
        *_LAG_MU_BASE,
        f"""SELECT draw, specimens,
  {sql_r6('-ln("D1") - ln(sigma) - 0.5 * ln(2 * pi()) - ((ln("D1") - mu) / sigma) ** 2 / 2')} AS log_lik FROM mus""",
    ),
    "B9_log_prior": with_ctes(
        r.DRAWS, _RAW, _PRIOR, f"SELECT draw, {sql_r6('sum(term)')} AS log_prior FROM terms GROUP BY 1"
    ),
    "B10_gram_statistics": with_ctes(
        *e.CONTINUOUS,
        e.DESIGN,
        _ENTRIES,
        f"""SELECT a.subjects, a.name AS p, b.name AS q, {sql_r6("sum(a.v * b.v)")} AS value
FROM entries a JOIN entries b ON b.specimens = a.specimens AND b.name >= a.name GROUP BY 1, 2, 3""",
    ),
    "K1_check_div": with_ctes(r.SAMPLER, _share_sql("divergent = 1")),
    "K2_check_treedepth": with_ctes(r.SAMPLER, _share_sql("treedepth = 10")),
    "W12_energy_diff": with_ctes(
        r.SAMPLER, _ENERGY, f"SELECT chain, iteration, {sql_r6('step')} AS energy_diff FROM steps"
    ),
    "K3_check_energy": with_ctes(
        r.SAMPLER, _ENERGY, f"SELECT chain, {sql_r6('e_fmi')} AS e_fmi, e_fmi < 0.2 AS warn FROM efmi"
    ),
    "K4_check_n_eff": with_ctes(
        r.DRAWS,
        _ESS,
        f"""SELECT parameter, {sql_r6("n_eff")} AS n_eff, CAST(n_draws AS BIGINT) AS n_draws,
  {sql_r6("n_eff / n_draws")} AS ratio, n_eff / n_draws < 0.001 AS warn FROM ess""",
    ),
    "K5_check_rhat": with_ctes(
        r.DRAWS, _RHAT, f"SELECT parameter, {sql_r6('rhat')} AS rhat, rhat > 1.1 AS warn FROM rhats"
    ),
    "K6_khat": with_ctes(
        r.DRAWS,
        "scales AS (SELECT parameter AS g, value AS x FROM draws)",
        _khats("scales"),
        f"SELECT g AS parameter, {sql_r6('khat')} AS khat FROM khats",
    ),
    "K7_tail_khats": with_ctes(
        r.DRAWS,
        _SIDES,
        _khats("sides"),
        _TAILS,
        f"SELECT parameter, {sql_r6('khat_left')} AS khat_left, {sql_r6('khat_right')} AS khat_right FROM tails",
    ),
    "K8_check_tail_khat": with_ctes(
        r.DRAWS,
        _SIDES,
        _khats("sides"),
        _TAILS,
        "SELECT parameter, khat_left > 0.5 AS warn_left, khat_right > 0.5 AS warn_right FROM tails",
    ),
    "K9_check_all": with_ctes(
        r.DRAWS,
        r.SAMPLER,
        _ESS,
        _RHAT,
        _SIDES,
        _khats("sides"),
        _TAILS,
        _ENERGY,
        """SELECT CAST(
  (SELECT max(CASE WHEN n_eff / n_draws < 0.001 THEN 1 ELSE 0 END) FROM ess)
  + (SELECT max(CASE WHEN rhat > 1.1 THEN 2 ELSE 0 END) FROM rhats)
  + (SELECT max(CASE WHEN khat_left > 0.5 OR khat_right > 0.5 THEN 4 ELSE 0 END) FROM tails)
  + (SELECT max(CASE WHEN divergent = 1 THEN 8 ELSE 0 END) FROM sampler)
  + (SELECT max(CASE WHEN treedepth = 10 THEN 16 ELSE 0 END) FROM sampler)
  + (SELECT max(CASE WHEN e_fmi < 0.2 THEN 32 ELSE 0 END) FROM efmi) AS INT) AS warning_code""",
    ),
    "K10_parse_warning_code": f"""SELECT event_id, user_id % {CODE_BITS} AS code, concat_ws('; ',
  CASE WHEN (user_id % {CODE_BITS}) & 1 > 0 THEN 'n_eff / iteration warning' END,
  CASE WHEN (user_id % {CODE_BITS}) & 2 > 0 THEN 'rhat warning' END,
  CASE WHEN (user_id % {CODE_BITS}) & 4 > 0 THEN 'khat warning' END,
  CASE WHEN (user_id % {CODE_BITS}) & 8 > 0 THEN 'divergence warning' END,
  CASE WHEN (user_id % {CODE_BITS}) & 16 > 0 THEN 'treedepth warning' END,
  CASE WHEN (user_id % {CODE_BITS}) & 32 > 0 THEN 'energy warning' END) AS warnings FROM events""",
    "F7_bitmask": """SELECT event_id, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END
  | CASE WHEN value > 20 THEN 2 ELSE 0 END | CASE WHEN user_id % 2 = 0 THEN 16 ELSE 0 END AS mask FROM events""",
    "U2_stack_chains": with_ctes(
        r.DRAWS,
        f"SELECT chain, parameter, count(*) AS n, {sql_r6('avg(value)')} AS mean FROM draws GROUP BY 1, 2",
    ),
    "U3_partition_divergent": with_ctes(
        r.DRAWS,
        f"""SELECT d.parameter, CAST(m.label = 0 AS INT) AS divergent, count(*) AS n, {sql_r6("avg(d.value)")} AS mean
FROM draws d JOIN embeddings m ON m.vec_id = d.draw GROUP BY 1, 2""",
    ),
}

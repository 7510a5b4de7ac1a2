"""Hand-made frames for NULLs, ties, gaps, repeats, caps and empty groups."""

import datetime as dt

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from abundex.functions.expressions import padded_label, recoded, truncated
from abundex.operators import clean, diversity, exposure, frame, normalize, posterior, reshape, summaries
from abundex.operators.exposure import EpisodeRule
from abundex.plans.pipelines import clean_samples, exposure_history, rekeyed_samples
from abundex.schemas import AbundanceSet

D0 = dt.date(2020, 1, 1)


def day(n):
    return D0 + dt.timedelta(days=n)


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


@pytest.fixture(scope="module")
def samples(spark):
    table = [
        ("a1", "A", "Sputum", 0),
        ("a2", "A", "Sputum", 2),
        ("a3", "A", "Sputum", 2),
        ("a4", "A", "Culture, Sputum", 2),
        ("b1", "B", None, 1),
        ("b2", "B", "Stool Swab", 4),
        ("c1", None, "Sputum", 0),
        ("d1", "D", "Sputum", 5),
    ]
    return spark.createDataFrame(
        [(i, s, t, n, day(0), day(n)) for i, s, t, n in table],
        "specimen_id2 string, subject_id string, specimen_type string, study_day int, "
        "enroll_date date, collection_date date",
    )


@pytest.fixture(scope="module")
def counts(spark):
    table = [
        ("a1", "x", 4), ("a1", "y", 4), ("a1", "z", 4),
        ("a2", "x", 5),
        ("a3", "x", 1), ("a3", "y", 2),
        ("a4", "x", 9), ("a4", "y", 9),
        ("b1", "x", 3), ("b1", "w", 3),
        ("b2", "y", 8), ("b2", "z", 0),
        ("c1", "x", 7),
        ("d1", "x", 0),
        ("q9", "x", 50),
    ]
    return spark.createDataFrame(table, "specimen_id2 string, otu_id string, read_count long")


@pytest.fixture(scope="module")
def taxonomy(spark):
    table = [("x", "G1"), ("y", "G2"), ("z", None), ("v", "G9")]
    return spark.createDataFrame(table, "otu_id string, Genus string")


def ids(df):
    return [r[0] for r in rows(df, "specimen_id2")]


def test_selection_keeps_null_types(samples, counts):
    assert ids(clean.drop_null_subject(samples)) == ["a1", "a2", "a3", "a4", "b1", "b2", "d1"]
    assert ids(clean.drop_by_pattern(samples)) == ["a1", "a2", "a3", "b1", "b2", "c1", "d1"]
    assert ids(clean.drop_empty_samples(samples, counts)) == ["a1", "a2", "a3", "a4", "b1", "b2", "c1"]
    assert ids(clean.drop_low_feature_samples(samples, counts)) == ["a1", "a3", "a4", "b1"]


def test_removed_rows_are_counted(samples, counts):
    assert rows(clean.removal_report(samples, counts)) == [
        ("empty", 1), ("low_feature", 2), ("null_subject", 1), ("pattern", 1),
    ]


def test_observed_removals_need_no_extra_job(samples):
    seen = Observation("null subjects")
    kept = clean.observe_removed(samples, F.col("subject_id").isNull(), seen).filter("subject_id IS NOT NULL")
    assert kept.count() == 7
    assert seen.get == {"removed": 1}


def test_reconciled_by_key(spark, samples, counts, taxonomy):
    kept = clean.reconcile_keys(AbundanceSet(counts, samples.filter("specimen_id2 <> 'a1'"), taxonomy))
    assert ids(kept.samples) == ["a2", "a3", "a4", "b1", "b2", "c1", "d1"]
    assert "q9" not in {r[0] for r in rows(kept.counts)} and "a1" not in {r[0] for r in rows(kept.counts)}
    assert [r[0] for r in rows(kept.taxonomy)] == ["x", "y", "z"]


def test_repeats_are_merged_under_the_first_id(samples, counts):
    chosen = clean.drop_by_pattern(samples)
    merged, summed = clean.merge_duplicates(chosen, counts)
    assert ids(merged) == ["a1", "a2_D", "b1", "b2", "c1", "d1"]
    assert rows(summed.filter("specimen_id2 = 'a2_D'")) == [("a2_D", "x", 6), ("a2_D", "y", 2)]
    kept = {r["specimen_id2"]: r for r in merged.collect()}
    assert kept["a2_D"]["subject_id"] == "A" and kept["a2_D"]["study_day"] == 2
    assert kept["b1"]["specimen_type"] is None


def test_pipeline_end_to_end(spark, samples, counts, taxonomy):
    exposures = spark.createDataFrame(
        [("A", day(2), "p"), ("A", day(2), "q"), ("B", day(1), None), ("D", day(5), "p")],
        "subject_id string, collection_date date, abx_b string",
    )
    data = AbundanceSet(counts, samples, taxonomy)
    plain = clean_samples(data, exposures, rarefy_depth=0)
    assert ids(plain.samples) == ["a2_D", "b1"]
    assert rows(plain.counts) == [("a2_D", "x", 6), ("a2_D", "y", 2), ("b1", "w", 3), ("b1", "x", 3)]
    assert [r[0] for r in rows(plain.taxonomy)] == ["x", "y"]
    drawn = clean_samples(data, exposures, rarefy_depth=7)
    assert ids(drawn.samples) == ["a2_D"]
    assert drawn.counts.agg(F.sum("read_count")).first()[0] == 7
    both = clean_samples(data, exposures, scale_counts=True, rarefy_depth=7)
    assert ids(both.samples) == ["a2_D", "b1"]


def test_names_are_padded_not_cut(spark):
    df = spark.createDataFrame([(7,), (123456,)], "n long")
    assert rows(df.select(padded_label("sv", F.col("n")))) == [("sv00007",), ("sv123456",)]


def test_feature_names_are_unique_and_stable(spark):
    seqs = spark.createDataFrame([(s,) for s in ("ACGT", "TTTT", "ACGT", "GG", "C")], "seq string")
    first, again = rows(clean.surrogate_feature_keys(seqs)), rows(clean.surrogate_feature_keys(seqs))
    assert first == again and sorted(r[1] for r in first) == [f"sv0000{i}" for i in range(1, 5)]


def test_diversity_limits(spark, counts):
    found = {r[0]: r[1] for r in diversity.hill_diversity(counts).collect()}
    assert found["a1"] == pytest.approx(3.0)
    assert found["a2"] == pytest.approx(1.0)
    assert found["b2"] == pytest.approx(1.0)
    assert "d1" not in found
    assert 1 < found["a3"] < 2


def test_baseline_keeps_ties_and_null_groups(spark):
    df = spark.createDataFrame(
        [("A", "t", 1, 1), ("A", "t", 1, 2), ("A", "t", 3, 3), ("A", None, 9, 4)],
        "subject_id string, specimen_type string, study_day int, n int",
    )
    assert rows(diversity.baseline_rows(df), "n") == [(1,), (2,), (4,)]


def test_lag_drops_the_first_row(spark):
    df = spark.createDataFrame(
        [("s1", "A", 1, 2.0), ("s2", "A", 1, 4.0), ("s3", "A", 5, 8.0), ("t1", "B", 0, 1.0)],
        "specimen_id2 string, subject_id string, study_day int, D1 double",
    )
    found = diversity.response_ratio(diversity.lagged_response(df))
    assert rows(found, "specimen_id2", "D1_lag", "D1_delta") == [("s2", 2.0, 2.0), ("s3", 4.0, 2.0)]


def test_missing_genus_is_a_group(spark, counts, taxonomy):
    props = diversity.genus_proportions(counts, taxonomy)
    assert rows(props.filter("specimen_id2 = 'b1'"), "Genus", "genus_reads", "genus_prop") == [
        ("G1", 3, 0.5), (None, 3, 0.5),
    ]
    stains = spark.createDataFrame([("G1", "GN"), (None, "none")], "Genus string, stain string")
    shares = diversity.stain_proportions(props, stains)
    assert rows(shares.filter("specimen_id2 = 'b1'"), "stain", "stain_prop") == [("GN", 0.5), ("none", 0.5)]


def test_complete_knows_null_labels(spark):
    df = spark.createDataFrame([("A", "x", 0.5), ("A", None, 0.5), ("B", "x", None)], "s string, l string, p double")
    assert rows(reshape.complete(df, ["s", "l"], {"p": 0.0})) == [
        ("A", "x", 0.5), ("A", None, 0.5), ("B", "x", 0.0), ("B", None, 0.0),
    ]


def test_dominant_taxon_breaks_ties_by_name(samples, counts, taxonomy):
    found = diversity.dominant_taxon(clean.drop_null_subject(samples), counts, taxonomy)
    got = {(r[0], r[1]): (r[2], r[3]) for r in found.collect()}
    assert got["A", "Sputum"] == ("G1", pytest.approx(1 / 3))
    assert got["B", None] == ("G1", 0.5)


def test_melt_and_back(samples, counts, taxonomy):
    data = AbundanceSet(counts.filter("specimen_id2 <> 'q9'"), samples, taxonomy)
    melted = reshape.phyloseq_to_agglomerated(data, "s", "f", "n")
    back = reshape.agglomerated_to_phyloseq(melted, "f", "s", "n", "Genus")
    assert rows(back.counts) == rows(data.counts.filter("read_count > 0"))
    assert set(ids(back.samples)) == {"a1", "a2", "a3", "a4", "b1", "b2", "c1"}
    assert rows(back.taxonomy) == [("w", None), ("x", "G1"), ("y", "G2"), ("z", None)]


def test_scaling_uses_counts_up_to_the_quantile(spark):
    df = spark.createDataFrame(
        [("s", f, n) for f, n in (("a", 1), ("b", 3), ("c", 3), ("d", 9))], "specimen_id2 string, otu_id string, read_count long"
    )
    found = dict(rows(normalize.css_normalize(df, 0.5, 1000.0), "otu_id", "norm_count"))
    assert found == {"a": pytest.approx(1000 / 7), "b": pytest.approx(3000 / 7), "c": pytest.approx(3000 / 7), "d": pytest.approx(9000 / 7)}


# --- exposures ------------------------------------------------------------------------


def cells(spark, *table):
    return spark.createDataFrame(list(table), "subject_id string, study_day int, abx_b string")


def test_cells_are_split_and_cleaned(spark):
    df = cells(
        spark,
        ("A", 0, ",amoxicillin, clavulanate"),
        ("A", 1, "amoxicillin"),
        ("A", 2, None),
        ("A", 3, "piperacillin"),
        ("A", 4, "piperacillin;tazobactam"),
        ("A", 5, "trimethoprim sulfamethoxazole ampicillin"),
        ("A", 5, "ampicillin"),
        ("A", 6, None),
        ("A", 6, "vancomycin.iv"),
    )
    assert rows(reshape.separate_exposures(df.filter("study_day = 0")), "abx_b") == [("amoxicillin",), ("clavulanate",)]
    days = {r["study_day"]: r["abx"] for r in exposure.exposure_days(df).collect()}
    assert days == {
        0: ["amoxicillin.clavulanate"],
        1: ["amoxicillin"],
        2: [None],
        4: ["piperacillin.tazobactam"],
        5: ["ampicillin", "trimethoprim.sulfamethoxazole"],
        6: [None, "vancomycin.iv"],
    }


def test_a_dropped_name_still_suppresses(spark):
    df = cells(spark, ("A", 0, "p,q"), ("A", 1, "p"), ("A", 2, "q"))
    days = exposure.exposure_days(df, combined={}, suppressed_by={"p": "q"}, dropped=("q",))
    assert {r["study_day"]: r["abx"] for r in days.collect()} == {1: ["p"]}


@pytest.fixture(scope="module")
def days(spark):
    """Subject A: records on days 0, 1, 4, 5, 6, 9; x runs, breaks, runs past the cap."""
    given = {0: ["x"], 1: ["x", "y"], 4: ["y"], 5: ["x"], 6: ["x"], 9: ["x"], 10: ["x"], 11: ["x", None]}
    table = [("A", d, names) for d, names in given.items()] + [("B", 3, [None]), ("B", 4, ["x"])]
    return spark.createDataFrame(table, "subject_id string, study_day int, abx array<string>")


def test_runs_count_records_and_stop_at_the_cap(days):
    runs = exposure.exposure_run_length(days, 3)
    x = {(r[0], r[1]): r[3] for r in rows(runs) if r[2] == "x"}
    assert x == {
        ("A", 0): 1, ("A", 1): 2, ("A", 5): 1, ("A", 6): 2, ("A", 9): 3, ("A", 10): 4, ("A", 11): 4, ("B", 4): 1,
    }
    assert {r[1]: r[3] for r in rows(runs) if r[2] == "y"} == {1: 1, 4: 2}


@pytest.mark.parametrize("max_lag", [1, 2, 3, 9])
def test_runs_agree_with_their_definition(days, max_lag):
    by_gap = exposure.gap_flag(exposure.exposure_lags(days, max_lag))
    columns = ("subject_id", "study_day", "abx_b", "continuous")
    assert rows(by_gap, *columns) == rows(exposure.exposure_run_length(days, max_lag), *columns)


def test_lags_are_padded_before_the_first_record(days):
    lags = exposure.exposure_lags(days, 2)
    assert rows(lags.filter("subject_id = 'B'"), "study_day", "day_lag", "abx_b") == [
        (3, 0, None), (3, 1, None), (3, 2, None), (4, 0, "x"), (4, 1, None), (4, 2, None),
    ]


def test_nested_history_equals_the_joined_one(days):
    joined = exposure.restore_unmatched(exposure.exposure_run_length(days, 3), exposure.exposure_lags(days, 3))
    columns = ("subject_id", "study_day", "day_lag", "abx_b", "continuous")
    assert rows(exposure.history_rows(exposure.exposure_record(days, 3)), *columns) == rows(joined, *columns)


def test_rules_split_a_subject_on_both_sides(spark, samples):
    rules = (EpisodeRule("A", -100, 0, "Aa"), EpisodeRule("A", 2, 100, "Ab", 2), EpisodeRule("A", 2, 100, "late"))
    moved = rekeyed_samples(samples.filter("subject_id IS NOT NULL"), rules)
    assert rows(moved.filter("subject_id LIKE 'A%'"), "subject_id", "study_day") == [("Aa", 0), ("Ab", 0), ("Ab", 0), ("Ab", 0)]
    dropped = (EpisodeRule("A", 5, 9, "never"),)
    assert ids(rekeyed_samples(samples.filter("subject_id = 'A'"), dropped)) == []


def test_history_ends_at_the_last_sample(spark, samples):
    exposures = spark.createDataFrame(
        [("A", day(-7), "p"), ("A", day(-6), "p"), ("A", day(2), "p"), ("A", day(3), "p"), ("Z", day(1), "p")],
        "subject_id string, collection_date date, abx_b string",
    )
    history = exposure_history(samples, exposures, 1)
    assert rows(history, "subject_id", "study_day") == [("A", -6), ("A", 2)]
    spanned = exposure.exposure_right_join(exposure.subject_span(samples), exposures)
    assert rows(exposure.exit_day(spanned).filter("subject_id = 'A'").select("exit_day").distinct()) == [(2,)]


def test_days_without_counts_stay_in_the_history(spark):
    history = spark.createDataFrame([("A", 1, 10), ("A", 2, 20)], "subject_id string, study_day int, h int")
    agg = spark.createDataFrame([("A", 1, "s", 5), ("A", 1, "s", 6)], "subject_id string, study_day int, specimen string, n int")
    found = exposure.attach_counts(history, agg).select("study_day", "h", "specimen", "n")
    assert rows(found) == [(1, 10, "s", 5), (1, 10, "s", 6), (2, 20, None, None)]


def test_window_of_effect(spark):
    flags = [True, None, False, False, True]
    df = spark.createDataFrame([("A", i, f) for i, f in enumerate(flags)], "subject_id string, study_day int, given boolean")
    found = exposure.effective_window(df, "given", 1).orderBy("study_day").collect()
    assert [r["on_abx"] for r in found] == [True, True, False, False, True]


# --- frames ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def study(spark):
    """Two subjects with five specimens each; p on most days, q once."""
    table, history = [], []
    for s in ("A", "B"):
        for d in range(5):
            table.append((f"{s}{d}", s, "Sputum", d))
            entries = [("p", d, 0)] if d else [(None, None, 0)]
            entries += [("q", 1, 0)] if (s, d) == ("A", 3) else []
            entries += [("p", d - 1, 1)] if d > 1 else [(None, None, 1)]
            history.append((s, d, entries))
    samples = spark.createDataFrame(table, "specimen_id2 string, subject_id string, specimen_type string, study_day int")
    nested = spark.createDataFrame(
        history, "subject_id string, study_day int, abx_lagged array<struct<abx_b:string,continuous:bigint,day_lag:int>>"
    )
    d1 = samples.select("specimen_id2", (F.col("study_day") + 1.0).alias("D1"))
    return samples, d1, nested


def test_frame_of_lags(study):
    built = frame.gen_ratio(*study, "Sputum", max_lag=1)
    assert rows(built.kept) == [("p", 2, 4.0)]
    assert rows(built.obs.filter("subjects = 'A'"), "specimens", "D1_delta") == [
        ("A1", 2.0), ("A2", 1.5), ("A3", pytest.approx(4 / 3)), ("A4", 1.25),
    ]
    assert len(rows(built.design)) == 14
    assert rows(frame.frame_dims(built)) == [(8, 2, 2, 1)]


def test_frame_of_runs_is_capped(study):
    built = frame.gen_continuous(*study, "Sputum", max_continuous=3)
    assert rows(built.design.filter("subjects = 'A'"), "specimens", "k") == [("A1", 1), ("A2", 2), ("A3", 3), ("A4", 3)]
    dense = frame.dense_design(built.design)
    assert dense.count() == 8 * 1 * 3 and dense.agg(F.sum("value")).first()[0] == 8
    coded = rows(frame.compose(built), "specimens", "specimens_idx", "subjects_idx")
    assert coded[0] == ("A1", 1, 1) and coded[-1] == ("B4", 8, 2)


def test_frame_without_rows_is_refused(study):
    with pytest.raises(ValueError):
        frame.gen_lag(*study, "Sputum", min_subjects=3, check=True)


def test_low_cohort_holds_those_without_a_taxon(spark, study):
    samples, _, _ = study
    dominant = spark.createDataFrame([("A", "Sputum", "G1", 0.9)], "subject_id string, specimen_type string, dominant_genus string, dom_genus_prop double")
    assert {r[0] for r in rows(frame.cohort(samples, dominant, "G1", True), "subject_id")} == {"A"}
    assert {r[0] for r in rows(frame.cohort(samples, dominant, "G1", False), "subject_id")} == {"B"}


# --- summaries, labels, effects ----------------------------------------------------------------


def test_missing_counts_as_a_value(spark):
    df = spark.createDataFrame([("t", "A"), ("t", None), ("t", None), ("u", "A")], "g string, s string")
    assert rows(summaries.distinct_counts(df, ["g"], ["s"])) == [("t", 2), ("u", 1)]


def test_recode_and_truncate(spark):
    df = spark.createDataFrame([("a", 1), ("b", 9), (None, None)], "x string, n int")
    assert rows(df.select(recoded(F.col("x"), {"a": "A"}), truncated(F.col("n"), 5))) == [("A", 1), ("b", 5), (None, None)]


def test_contrast_is_one_without_effect(spark):
    df = spark.createDataFrame([(0.3, -0.2, 0.0, 1.5)], "a double, a_subj double, b_abx2 double, b_lag double")
    assert posterior.effect_contrast(df).first()["difference"] == 1.0
    assert posterior.effect_contrast(df, kind="log").first()["difference"] == 0.0


def test_spread_joins_on_shared_indices(spark):
    draws = spark.createDataFrame(
        [(0, "a", 1.0), (0, "s[1]", 10.0), (0, "s[2]", 20.0), (0, "b[1,2]", 5.0), (0, "b[2,2]", 6.0), (0, "bb[1]", 9.0)],
        "draw long, parameter string, value double",
    )
    found = posterior.spread_draws(draws, "a", "s[i]", "b[i, k]")
    assert rows(found, "draw", "i", "k", "a", "s", "b") == [(0, 1, 2, 1.0, 10.0, 5.0), (0, 2, 2, 1.0, 20.0, 6.0)]
    with pytest.raises(ValueError):
        posterior.spread_draws(draws, "b[i")


def test_calendar_lags_see_missing_days(spark):
    """Days 0, 1, 3, 4 and 9: day 3 has no record the day before; day 9 none within three days."""
    table = [("A", 0, ["x"]), ("A", 1, ["x", "y"]), ("A", 3, ["x"]), ("A", 4, ["x", None]), ("A", 9, ["x"]), ("B", 4, ["y"])]
    days = spark.createDataFrame(table, "subject_id string, study_day int, abx array<string>")
    given = {(s, d): names for s, d, names in table}
    want = []
    for s, d, _ in table:
        for n in range(4):
            want += [(s, d, n, name) for name in given.get((s, d - n), [None])]
    lags = exposure.exposure_lags(days, 3, calendar=True)
    assert rows(lags, "subject_id", "study_day", "day_lag", "abx_b") == sorted(want, key=repr)
    runs = exposure.exposure_run_length(days, 2, calendar=True)
    assert rows(runs, "subject_id", "study_day", "abx_b", "continuous") == sorted(
        [("A", 0, "x", 1), ("A", 1, "x", 2), ("A", 1, "y", 1), ("A", 3, "x", 1), ("A", 4, "x", 2), ("A", 9, "x", 1), ("B", 4, "y", 1)],
        key=repr,
    )
    assert rows(exposure.gap_flag(lags), "subject_id", "study_day", "abx_b", "continuous") == rows(
        exposure.exposure_run_length(days, 3, calendar=True), "subject_id", "study_day", "abx_b", "continuous"
    )
    by_record = exposure.exposure_run_length(days, 9)
    assert by_record.filter("study_day = 9 AND subject_id = 'A'").first()["continuous"] == 5
    history = exposure.history_rows(exposure.exposure_record(days, 3, calendar=True))
    assert rows(history, "subject_id", "study_day", "day_lag", "abx_b") == sorted(want, key=repr)

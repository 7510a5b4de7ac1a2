"""Cases in which rows were once dropped or answered differently."""

import datetime

import pytest
from pyspark.sql import functions as F

from abundex.functions import quantiles
from abundex.operators import clean, exposure, frame, model, normalize, posterior
from abundex.session import cut_lineage, shared_dir
from abundex.sources import tables


def test_open_ended_rules_keep_far_days(spark):
    days = spark.createDataFrame([("7", -20_000), ("7", 15), ("7", 40_000), ("8", 15)], "subject_id string, study_day int")
    rules = (exposure.EpisodeRule("7", None, 12, "7a"), exposure.EpisodeRule("7", 18, None, "7b", 18))
    got = {(r[0], r[1]) for r in exposure.episode_rekey(days, rules).collect()}
    assert got == {("7a", -20_000), ("7b", 39_982), ("8", 15)}


def test_a_cell_without_names_is_a_record_without_exposure(spark):
    cells = spark.createDataFrame([("s", 1, "a"), ("s", 2, ","), ("s", 3, "a")], "subject_id string, study_day int, abx_b string")
    got = {r["study_day"]: r["abx"] for r in exposure.exposure_days(cells, ["subject_id", "study_day"], {}, {}, ()).collect()}
    assert got == {1: ["a"], 2: [None], 3: ["a"]}


def test_null_groups_have_quantiles_on_either_path(spark):
    rows = spark.createDataFrame([(None, float(i)) for i in range(101)] + [("a", 1.0)], "g string, x double")
    ways = [
        sorted(map(str, quantiles.group_quantiles(rows, ["g"], ["x"], [0.5], limit).collect())) for limit in (None, 10)
    ]
    assert ways[0] == ways[1] and "50.0" in "".join(ways[0])


def test_null_days_come_last_in_a_record(spark):
    rows = spark.createDataFrame(
        [("a", 2, "x"), ("a", None, "y"), ("a", 1, "z"), (None, 1, "w")], "subject_id string, study_day int, specimen_id2 string"
    )
    got = {r["specimen_id2"]: r["record"] for r in clean.record_index(rows).collect()}
    assert got == {"z": 1, "x": 2, "y": 3, "w": 1}


def test_places_cover_totals_beyond_32_bits(spark):
    totals = [1, 1_000, (1 << 32) - 1, 1 << 32, (1 << 59) + 12_345]
    rows = spark.createDataFrame([(t, d) for t in totals for d in range(50)], "total long, draw int")
    got = rows.select("total", "draw", normalize.read_position(F.lit("s"), F.col("draw"), F.col("total"), 1).alias("at")).collect()
    import hashlib

    for r in got:
        h = int(hashlib.md5(f"s|{r['draw']}|1".encode()).hexdigest()[:15], 16)
        assert r["at"] == h * r["total"] >> 60


def test_too_few_draws_stop_the_rollout(spark):
    draws = spark.createDataFrame([(1,), (2,)], "draw int")
    assert posterior.sample_groups(draws, 2).count() == 2
    with pytest.raises(ValueError, match="3 draws wanted, 2 found"):
        posterior.sample_groups(draws, 3)


def test_a_null_prediction_stays_null_to_the_end(spark):
    draws = spark.createDataFrame([(1, "s", 1.0)], "draw int, subject_id string, slope double")
    days = spark.createDataFrame(
        [("s", d, f"x{d}", g, 0.5) for d, g in ((1, 1.0), (2, None), (3, 1.0))],
        "subject_id string, study_day int, specimen_id2 string, gain double, lag_emp_prop double",
    )
    link = lambda specimen, previous: specimen["gain"] + previous * F.col("slope")
    for block in (1, 10):
        got = posterior.pp_rollout(draws, days, link, block=block).orderBy("study_day").collect()
        assert [r["pred_prob"] for r in got] == [1.5, None, None]


def test_every_cleaning_step_is_reported(spark):
    samples = spark.createDataFrame([("a", "s", "x")], "specimen_id2 string, subject_id string, specimen_type string")
    counts = spark.createDataFrame([("a", "f", 3), ("a", "g", 3)], "specimen_id2 string, otu_id string, read_count long")
    got = dict(map(tuple, clean.removal_report(samples, counts).collect()))
    assert got == dict.fromkeys(clean.CLEANING_STEPS, 0)


def test_quoted_empty_cells_are_null(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('a,b\n1,""\n2,NA\n3,x\n')
    assert [r["b"] for r in tables.read_table(spark, str(path), fmt="csv").collect()] == [None, None, "x"]


def test_draws_written_again_replace_those_of_their_model(spark, tmp_path):
    draws = spark.createDataFrame([(0, 1, 1, "a", 0.5)], "chain int, iteration int, draw long, parameter string, value double")
    for model_name in ("m", "n", "m"):
        tables.write_draws(draws, str(tmp_path / "draws"), model_name)
    assert tables.read_draws(spark, str(tmp_path / "draws")).count() == 2


def test_cut_frames_are_tables_in_the_shared_folder(spark):
    df = cut_lineage(spark.createDataFrame([(1, datetime.date(2024, 1, 1))], "a int, d date"))
    assert df.count() == 1 and shared_dir(spark) in df.inputFiles()[0].replace("file://", "")


def test_long_parameter_names_stay_apart():
    import inspect

    assert "1_000" not in inspect.getsource(model)


def test_a_day_without_reads_is_nan_and_no_error(spark, tmp_path):
    """Events of value 0 alone make a specimen without reads: its share is 0 / 0, and so is what follows from it."""
    import math

    import __spark_entry__ as entry
    from tests.oracle import database, differences

    at = lambda day: datetime.datetime(2024, 1, day, 12)
    values = {1: {1: 2.0, 2: 0.0, 3: 4.0, 4: 1.0}, 2: {1: 0.0, 2: 3.0, 3: 5.0}}
    events = [(u * 10 + d, at(d), u, "click", v, '{"k": 10}') for u, days in values.items() for d, v in days.items()]
    spark.createDataFrame(
        events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    ).write.parquet(str(tmp_path / "events.parquet/"))
    vectors = spark.range(150).select(
        F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda p: F.sin(p + F.col("id")).cast("float")).alias("embedding")
    )
    vectors.write.parquet(str(tmp_path / "embeddings.parquet"))
    con = database(str(tmp_path / "none"))
    for name in ("events", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    for name in ("B5_pp_rollout", "H1_python_link"):
        assert differences(spark, con, entry.queries()[name], entry.oracle_sql()[name], str(tmp_path)) == []
        shares = {r["specimen_id2"]: r["emp_prob"] for r in entry.queries()[name](spark, str(tmp_path)).collect()}
        assert math.isnan(shares[101]) and not math.isnan(shares[102])


def test_specimens_of_one_code_are_dealt_in_chunks(spark):
    """Many specimens read few codes: chunks change nothing, and draws are not copied per subject."""
    from abundex.operators.drawblocks import draw_blocks, exploded, spread_blocks

    draws = spark.createDataFrame(
        [(d, n, d + 0.5) for d in range(6) for n in ("a", "b_lag", "sigma", "a_subj[1]", "a_subj[2]", "b_abx2[1,1,1]")],
        "draw long, parameter string, value double",
    )
    obs = spark.createDataFrame([(s, s % 2 + 1, 0.1 * s) for s in range(90)], "specimens int, i int, D1_lag double")
    design = spark.createDataFrame([(s, s % 2 + 1, 1, 1) for s in range(0, 90, 4)], "specimens int, i int, j int, k int")
    blocks = draw_blocks(draws, 4)
    effects = spread_blocks(blocks, "b_abx2[i,j,k]")
    found = []
    for chunk in (7, 1_000):
        pieces = model.in_chunks(obs, chunk).groupBy("i").agg(F.countDistinct("_chunk").alias("n")).collect()
        assert all((r["n"] > 1) == (chunk == 7) for r in pieces)
        mu = model.predictor_blocks(obs, design, effects, blocks, model.VARIANTS["3.5"], chunk=chunk)
        found.append(sorted(map(tuple, exploded(mu, ["specimens"], ["mu"]).collect())))
    assert found[0] == found[1] and len(found[0]) == 90 * 6


def test_draws_are_not_copied_for_every_subject(spark):
    """Subjects meet the codes of the draws; blocks hold the 62 parameters, however many subjects there are."""
    from catalog import roles
    from tests.oracle import DATA

    small = f"{DATA}/sf0.001"
    assert roles.blocks(spark, small).select("parameter").distinct().count() == 62
    subjects = spark.createDataFrame([(f"s{n}", n) for n in range(1, 10)], "subjects string, idx long")
    assert [tuple(r) for r in roles.fitted_codes(subjects).orderBy("subjects").collect()] == [
        (f"s{n}", (n - 1) % 4 + 1) for n in range(1, 10)
    ]


def test_copies_of_draws_and_specimens_are_bounded(spark, monkeypatch):
    """However many specimens read a code: so many copies of its blocks and of the specimens, each pair once."""
    from abundex.operators.drawblocks import draw_blocks, exploded, spread_blocks

    names = ["a", "sigma", "b_lag", "a_subj[1]", "a_subj[2]", "b_abx2[1,1,1]", "b_abx2[2,1,1]"]
    rows = [(d, p, 0.25 * d + len(p)) for d in range(24) for p in names]
    blocks = draw_blocks(spark.createDataFrame(rows, "draw long, parameter string, value double"), 4)
    effects = spread_blocks(blocks, "b_abx2[i,j,k]")
    obs = spark.range(400).selectExpr("id AS specimens", "IF(id < 5, 2, 1) AS i", "id / 8D AS D1_lag", "1D AS D1")
    design = obs.filter("specimens % 3 = 0").selectExpr("specimens", "i", "1 AS j", "1 AS k")
    dealt = model.in_chunks(obs, 5).groupBy("i").agg(F.countDistinct("_chunk").alias("n"), F.max("_groups").alias("g"))
    assert sorted(map(tuple, dealt.collect())) == [(1, model.CHUNKS, model.GROUPS), (2, 1, 1)]
    found = []
    for chunk, groups in ((5, model.GROUPS), (5, 3), (1_000, 1)):
        monkeypatch.setattr(model, "GROUPS", groups)
        mu = model.predictor_blocks(obs, design, effects, blocks, model.VARIANTS["3.5"], chunk=chunk)
        found.append(sorted(map(tuple, exploded(mu, ["specimens"], ["mu"]).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == 400 * 24


@pytest.mark.parametrize("replace", [True, False])
def test_usual_draws_give_what_all_draws_give(spark, replace):
    """Places of each draw as a row, and different ones in the order they are first drawn."""
    depth, totals = 50, {"a": 50, "b": 51, "c": 99, "d": 100, "e": 101, "f": 150, "g": 5_000, "h": 1 << 40}
    counts = spark.createDataFrame(
        [(s, f"o{n}", t // 10 + (t % 10 if n == 0 else 0)) for s, t in totals.items() for n in range(10)],
        "specimen_id2 string, otu_id string, read_count long",
    )
    got = normalize.rarefy(counts, depth, replace=replace).collect()
    assert {s: sum(r["read_count"] for r in got if r["specimen_id2"] == s) for s in totals} == dict.fromkeys(totals, depth)
    rows = spark.createDataFrame([(s, t, d) for s, t in totals.items() for d in range(4 * depth + 64)], "s string, t long, d int")
    single = rows.groupBy("s").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("d", normalize.read_position(F.col("s"), F.col("d"), F.col("t"), 1988).alias("p")))),
            lambda x: x["p"],
        ).alias("one")
    )
    both = spark.createDataFrame(list(totals.items()), "s string, t long").join(single, "s").select(
        "one", normalize.read_positions(F.col("s"), F.lit(4 * depth + 64), F.col("t"), 1988).alias("all")
    )
    assert all(r["one"] == r["all"] for r in both.collect())


def test_a_frame_joins_and_keeps_only_the_history_it_reads(spark, monkeypatch):
    """What is shuffled beside a specimen are its own day's records, and the lists of one frame are written once."""
    days = spark.createDataFrame(
        [("A", n, ["x"]) for n in range(6)] + [("B", 1, ["x", "y"]), ("B", 3, ["y"])],
        "subject_id string, study_day int, abx array<string>",
    )
    samples = spark.createDataFrame(
        [(n, "A", "1" if n % 2 else "2", n) for n in range(6)] + [(10, "B", "1", 1), (11, "B", "1", 3), (12, "B", "1", 9)],
        "specimen_id2 int, subject_id string, specimen_type string, study_day int",
    )
    diversity = spark.createDataFrame([(n, 1.0 + n) for n in range(12)], "specimen_id2 int, D1 double")
    wanted = frame.specimen_type_filter(samples, "1")
    part, whole = exposure.exposure_record(days, 2, wanted=wanted), exposure.exposure_record(days, 2)
    keys = ["subject_id", "study_day"]
    assert part.count() == 5
    assert sorted(map(str, part.collect())) == sorted(map(str, whole.join(wanted.select(*keys), keys, "left_semi").collect()))
    kept = []
    monkeypatch.setattr(frame, "cut_lineage", lambda df: kept.append(cut_lineage(df)) or kept[-1])
    for build, lists in ((frame.gen_continuous, 1), (frame.gen_lag, 3)):
        kept.clear()
        one, all_ = (build(samples, diversity, h, "1", min_subjects=1, min_median=1, **({"max_lag": 2} if lists > 1 else {})) for h in (part, whole))
        assert sorted(map(str, one.rows.collect())) == sorted(map(str, all_.rows.collect())) and one.rows.count() >= 3
        assert {r["specimens"]: r["D1_lag"] for r in one.obs.collect()} == {3: 2.0, 5: 4.0, 11: 11.0}
        responses, exposures, subjects = kept[:3]
        assert {e["day_lag"] for r in responses.collect() for e in r["abx_lagged"]} == set(range(lists))
        assert exposures.columns[0] == "abx_lag" and subjects.columns == ["subjects"]

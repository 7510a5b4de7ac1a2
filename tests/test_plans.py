"""The plans have the shape they are meant to have."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from abundex.operators import clean, diversity, exposure, frame, posterior
from catalog import roles
from tests.oracle import DATA

SMALL = f"{DATA}/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"Exchange (?:hash|range|single|SinglePartition)", plan_of(df)))


def parquet(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_cross_product(spark, name):
    plan = plan_of(entry.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_diversity_is_one_exchange_with_partial_sums(spark):
    counts = parquet(spark, "lineitem").select(
        F.col("l_orderkey").alias("specimen_id2"), F.col("l_quantity").alias("read_count")
    )
    df = diversity.hill_diversity(counts)
    plan = plan_of(df)
    assert exchanges(df) == 1 and "partial_sum" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,0.0)]" in plan


def test_type_filter_reaches_the_scan(spark):
    df = frame.specimen_type_filter(roles.samples(spark, SMALL), "F")
    assert "EqualTo(o_orderstatus,F)" in plan_of(df)


def test_runs_share_the_exchange_on_the_subject(spark):
    days = spark.createDataFrame([("A", 1, ["x"])], "subject_id string, study_day int, abx array<string>")
    assert exchanges(exposure.exposure_run_length(days, 3)) == 1
    assert exchanges(exposure.exposure_record(days, 3)) == 1


def test_hot_specimen_is_split_in_the_join(spark):
    """With a third of the rows in one specimen, the join splits its partition."""
    rows = spark.range(300_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("specimen_id2"),
        F.col("id").alias("otu_id"),
        (F.col("id") % 9 + 1).alias("read_count"),
    )
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df = clean.with_total_reads(rows.repartition(16))
        assert len(df.collect()) == 300_000
        assert "SortMergeJoin(skew=true)" in plan_of(df)
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_baseline_combines_before_the_shuffle(spark):
    df = diversity.baseline_rows(roles.samples(spark, SMALL))
    assert "partial_min(study_day" in plan_of(df)


def test_spread_reads_only_its_parameters(spark, tmp_path):
    path = str(tmp_path / "draws")
    roles.draws(spark, SMALL).write.parquet(path)
    df = posterior.spread_draws(spark.read.parquet(path), "b_abx2[i,j,k]")
    assert "StringStartsWith(parameter,b_abx2[)" in plan_of(df)
    scalars = posterior.spread_draws(spark.read.parquet(path), "a", "b_lag", "sigma")
    assert "In(parameter, [a,b_lag,sigma])" in plan_of(scalars)
    assert plan_of(scalars).count("FileScan") == 1


def test_predictor_shuffles_specimens_and_not_pairs(spark):
    """Observations, design and blocks meet; no exchange holds a row per draw and specimen."""
    from abundex.operators import drawblocks, model

    names = [f"a_subj[{i}]" for i in (1, 2)] + [f"b_abx2[{i},1,1]" for i in (1, 2)] + ["a", "b_lag", "sigma"]
    rows = [(d, n, float(d)) for d in range(50) for n in names]
    draws = spark.createDataFrame(rows, "draw long, parameter string, value double")
    obs = spark.createDataFrame([(s, s % 2 + 1, 1.0) for s in range(40)], "specimens int, i int, D1_lag double")
    design = spark.createDataFrame([(s, s % 2 + 1, 1, 1) for s in range(0, 40, 3)], "specimens int, i int, j int, k int")
    blocks = drawblocks.draw_blocks(draws, 25)
    effects = drawblocks.spread_blocks(blocks, "b_abx2[i,j,k]")
    mu = model.linear_predictor(obs, design, effects, blocks, model.VARIANTS["3.5"])
    assert mu.count() == 40 * 50
    lines = plan_of(mu).split("\n")
    first = next(n for n, line in enumerate(lines) if "Exchange" in line)
    assert any("Generate" in line for line in lines[:first])  # taken apart above the last exchange
    assert sum("Generate" in line for line in lines) == 1

"""Readers and writers on files of the expected layout."""

import datetime as dt

from pyspark.sql import functions as F

from abundex.sources import tables


def test_csv_tables_are_read_with_their_schema(spark, tmp_path):
    (tmp_path / "meds.csv").write_text("subject_id,collection_date,abx_b,abx_b_number\nS1,2020-01-02,\"a,b\",2\nS1,2020-01-03,NA,0\n")
    (tmp_path / "samples.csv").write_text(
        "specimen_id2,specimen_id,specimen_type,subject_id,flow_cell_id,study_day,enroll_date,collection_date\n"
        "1,1,Sputum,S1,7,0,2020-01-01,2020-01-02\n2,2,Sputum,NA,7,NA,NA,NA\n"
    )
    (tmp_path / "stains.csv").write_text("dominant_genus,stain\nG1,GN\nNA,GP\n")
    meds = tables.read_exposures(spark, str(tmp_path / "meds.csv"))
    assert [tuple(r) for r in meds.orderBy("collection_date").collect()] == [
        ("S1", dt.date(2020, 1, 2), "a,b", 2), ("S1", dt.date(2020, 1, 3), None, 0),
    ]
    samples = tables.read_samples(spark, str(tmp_path / "samples.csv"))
    assert dict(samples.dtypes)["specimen_id2"] == "string" and dict(samples.dtypes)["study_day"] == "int"
    assert samples.filter("subject_id IS NULL AND study_day IS NULL").count() == 1
    stains = tables.read_stains(spark, str(tmp_path / "stains.csv"))
    assert sorted(((r.Genus, r.stain) for r in stains.collect()), key=repr) == [("G1", "GN"), (None, "GP")]


def test_counts_drop_zeros(spark, tmp_path):
    path = str(tmp_path / "counts")
    spark.createDataFrame([("s", "a", 3), ("s", "b", 0)], "specimen_id2 string, otu_id string, read_count long").write.parquet(path)
    assert [tuple(r) for r in tables.read_counts(spark, path).collect()] == [("s", "a", 3)]
    wide = spark.createDataFrame([("s", 3, 0), ("t", 1, 2)], "specimen_id2 string, a long, b long")
    found = sorted(tuple(r) for r in tables.counts_from_wide(wide, ["a", "b"]).collect())
    assert found == [("s", "a", 3), ("t", "a", 1), ("t", "b", 2)]


def test_draws_are_read_back_by_model_and_parameter(spark, tmp_path):
    path = str(tmp_path / "draws")
    draws = spark.createDataFrame(
        [(0, n, n, p, float(n)) for n in range(20) for p in ("a", "b[1]")],
        "chain int, iteration int, draw long, parameter string, value double",
    )
    tables.write_draws(draws, path, "m1")
    tables.write_draws(draws.filter("parameter = 'a'"), path, "m2")
    assert tables.read_draws(spark, path).count() == 60
    one = tables.read_draws(spark, path, "m2").filter(F.col("parameter") == "a")
    assert one.count() == 20 and "model" not in one.columns
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model" in plan
    assert "EqualTo(parameter,a)" in plan

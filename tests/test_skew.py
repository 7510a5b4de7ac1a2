"""The ways taken for large groups give what the plain ways give."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from abundex.functions.ordered import (
    hash_slice,
    lag_in_slices,
    row_number_in_slices,
    running_sum,
)
from abundex.functions.quantiles import group_quantiles, value_ranks
from abundex.operators import diagnostics, frame, normalize, posterior


@pytest.fixture(scope="module")
def hot(spark):
    """4,000 rows, more than half of them in one group, with many equal values."""
    n = F.col("id")
    rows = spark.range(4000).select(
        n.alias("id"),
        F.when(n % 7 < 4, "hot").otherwise(F.concat(F.lit("g"), (n % 5).cast("string"))).alias("g"),
        (F.pmod(F.xxhash64("id"), F.lit(100_000)) / 1000).alias("x"),
        F.floor(n / 100).alias("day"),
    )
    dull = F.when(F.col("id") % 3 == 0, F.lit(42.0)).otherwise(F.col("x"))
    return rows.withColumn("y", dull).withColumn("z", F.when(F.col("id") % 11 != 0, F.col("y")))


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_lag_crosses_slices(hot):
    plain = Window.partitionBy("g").orderBy("day", "id")
    expected = hot.select("id", F.lag("z").over(plain).alias("before"))
    found = lag_in_slices(hot, ["g"], "day", ["id"], "z", "before").select("id", "before")
    assert rows_of(found, "id") == rows_of(expected, "id")


def test_running_sum_and_position_cross_slices(hot):
    plain = Window.partitionBy("g").orderBy("day", "id")
    expected = hot.select(
        "id",
        F.sum("id").over(plain.rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
        F.row_number().over(plain).cast("long").alias("n"),
    )
    summed = running_sum(hot, ["g"], "day", ["id"], F.col("id"), "s")
    found = row_number_in_slices(summed, ["g"], "day", ["id"], "n").select("id", "s", "n")
    assert rows_of(found, "id") == rows_of(expected, "id")


def test_hash_slices_are_even(spark):
    sizes = [r["count"] for r in spark.range(64_000).groupBy(hash_slice(F.col("id"), 1)).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * min(sizes)


@pytest.mark.parametrize("limit", [1, 70, 500])
def test_quantiles_of_large_groups(hot, limit):
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    plain = {r["g"]: r for r in group_quantiles(hot, ["g"], ["x", "y", "z"], probs, None).collect()}
    split = {r["g"]: r for r in group_quantiles(hot, ["g"], ["x", "y", "z"], probs, limit).collect()}
    assert plain.keys() == split.keys()
    for g, row in plain.items():
        for c in ("x", "y", "z"):
            assert split[g][c] == pytest.approx(row[c], abs=1e-9)


def test_large_group_is_cut_into_slices(hot):
    from abundex.functions.quantiles import oversized_groups, slice_by_value

    values = hot.groupBy("g", "x").agg(F.count("*").alias("_freq"))
    cut = slice_by_value(values, ["g"], "x", 256, oversized_groups(hot, ["g"], 256))
    spans = cut.groupBy("g", "_slice").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    hot_spans = [r for r in spans.orderBy("_slice").collect() if r["g"] == "hot"]
    assert len(hot_spans) > 4
    assert max(r["n"] for r in hot_spans) < 700
    assert all(a["hi"] < b["lo"] for a, b in zip(hot_spans, hot_spans[1:]))


def test_ranks_of_large_groups(hot):
    plain = value_ranks(hot, ["g"], "y", None)
    split = value_ranks(hot, ["g"], "y", 70).select(*plain.columns)
    assert rows_of(split, "g", "y") == rows_of(plain, "g", "y")


def test_label_index_in_slices(spark):
    labels = spark.range(3000).select(F.concat(F.lit("s"), "id").alias("name"))
    plain = rows_of(frame.label_index(labels, "name"), "name")
    assert rows_of(frame.label_index(labels, "name", 100), "name") == plain
    assert [r[0] for r in plain] == sorted(r[0] for r in plain)
    assert [r[1] for r in plain] == list(range(1, 3001))


def test_rarefaction_is_the_same_in_slices(spark):
    counts = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("specimen_id2"),
        F.col("id").alias("otu_id"),
        (F.col("id") % 9 + 1).alias("read_count"),
    )
    plain = normalize.rarefy(counts, 100)
    sliced = normalize.rarefy(counts, 100, features_per_slice=20)
    order = ("specimen_id2", "otu_id")
    assert rows_of(sliced, *order) == rows_of(plain, *order)
    totals = {r[0]: r[1] for r in plain.groupBy("specimen_id2").sum("read_count").collect()}
    assert set(totals.values()) == {100}
    kept = counts.groupBy("specimen_id2").sum("read_count").filter("`sum(read_count)` >= 100").count()
    assert len(totals) == kept


def test_rarefaction_without_replacement(spark):
    counts = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("specimen_id2"),
        F.col("id").alias("otu_id"),
        (F.col("id") % 9 + 1).alias("read_count"),
    )
    order = ("specimen_id2", "otu_id")
    totals = dict(map(tuple, counts.groupBy("specimen_id2").sum("read_count").collect()))
    for depth in (1, 100, 240, max(totals.values())):
        plain = normalize.rarefy(counts, depth, replace=False)
        assert rows_of(normalize.rarefy(counts, depth, features_per_slice=20, replace=False), *order) == rows_of(plain, *order)
        found = {r[0]: r[1] for r in plain.groupBy("specimen_id2").sum("read_count").collect()}
        assert found == {s: depth for s, n in totals.items() if n >= depth}
        above = plain.withColumnRenamed("read_count", "kept").join(counts, list(order)).filter("kept > read_count")
        assert above.count() == 0
    # All reads of a specimen: every count comes back as it was.
    whole = spark.createDataFrame([(1, f, f + 1) for f in range(20)], "specimen_id2 long, otu_id long, read_count long")
    assert rows_of(normalize.rarefy(whole, 210, replace=False), *order) == rows_of(whole, *order)
    with pytest.raises(ValueError, match="whole counts"):
        normalize.rarefy(whole.withColumn("read_count", F.col("read_count") / 2), 5, replace=False)


def test_reads_without_replacement_are_even(spark):
    counts = spark.createDataFrame(
        [(s, f, n) for s in range(400) for f, n in (("a", 70), ("b", 20), ("c", 10))],
        "specimen_id2 long, otu_id string, read_count long",
    )
    for depth in (30, 80):  # drawn, and left out
        drawn = normalize.rarefy(counts, depth, replace=False).groupBy("otu_id")
        found = {r["otu_id"]: r for r in drawn.agg(F.avg("read_count").alias("m"), F.var_samp("read_count").alias("v")).collect()}
        share = depth / 100
        assert found["a"]["m"] == pytest.approx(70 * share, abs=0.5)
        # Hypergeometric spread, smaller than with replacement.
        assert found["a"]["v"] == pytest.approx(depth * 0.7 * 0.3 * (100 - depth) / 99, rel=0.3)


def test_rarefaction_follows_the_counts(spark):
    counts = spark.createDataFrame(
        [(s, f, n) for s in range(400) for f, n in (("a", 70), ("b", 20), ("c", 10))],
        "specimen_id2 long, otu_id string, read_count long",
    )
    drawn = normalize.rarefy(counts, 50).groupBy("otu_id").sum("read_count").collect()
    shares = {r[0]: r[1] / 20_000 for r in drawn}
    assert shares["a"] == pytest.approx(0.7, abs=0.02)
    assert shares["b"] == pytest.approx(0.2, abs=0.02)


def test_rarefaction_of_scaled_counts(spark):
    whole = spark.range(600).select(
        (F.col("id") % 6).alias("specimen_id2"), F.col("id").alias("otu_id"), (F.col("id") % 7 + 1).alias("read_count")
    )
    scaled = whole.withColumn("read_count", F.col("read_count").cast("double"))
    order = ("specimen_id2", "otu_id")
    assert rows_of(normalize.rarefy(scaled, 80), *order) == rows_of(normalize.rarefy(whole, 80), *order)


@pytest.fixture(scope="module")
def draws(spark):
    rng = np.random.default_rng(5)
    rows = []
    for name, phi in (("slow", 0.97), ("fast", 0.1), ("anti", -0.6), ("flat", None)):
        for chain in range(3):
            x = 0.0
            for it in range(101):
                x = 1.0 if phi is None else phi * x + rng.normal()
                rows.append((chain, it + 50, chain * 1000 + it, name, float(x)))
    return spark.createDataFrame(
        rows, "chain int, iteration int, draw long, parameter string, value double"
    )


def brute_ess(values):
    """values: chains x iterations."""
    m, n = values.shape
    dev = values - values.mean(axis=1, keepdims=True)
    acov = np.array([(dev[:, : n - t] * dev[:, t:]).sum(axis=1) / n for t in range(n)]).mean(axis=1)
    within = values.var(axis=1, ddof=1).mean()
    plus = within * (n - 1) / n + values.mean(axis=1).var(ddof=1)
    rho = np.concatenate([[1.0], 1 - (within - acov[1:]) / plus])
    total, low = 0.0, np.inf
    for t in range(n // 2):
        pair = rho[2 * t] + rho[2 * t + 1]
        low = min(low, pair)
        if low <= 0:
            break
        total += low
    return m * n / (2 * total - 1)


@pytest.mark.parametrize(("lags", "longest"), [(26, 1_024), (4, 1_024), (4, 4), (1024, 1_024)])
def test_effective_sample_size_in_rounds(draws, lags, longest, monkeypatch):
    monkeypatch.setattr(diagnostics, "LONGEST_ROUND", longest)
    table = draws.toPandas()
    found = {r["parameter"]: r["n_eff"] for r in diagnostics.n_eff(draws, lags).collect()}
    assert found["flat"] is None
    for name in ("slow", "fast", "anti"):
        one = table[table.parameter == name].pivot(index="chain", columns="iteration", values="value")
        assert found[name] == pytest.approx(brute_ess(one.to_numpy()), rel=1e-9)


def brute_khat(x):
    x = np.sort(x)
    n = len(x)
    if x[0] <= 0:
        return 0.0
    q = x[int(np.floor(0.25 * n + 0.5)) - 1]
    m = 20 + int(np.floor(np.sqrt(n)))
    b = 1 / x[-1] + (1 - np.sqrt(m / (np.arange(1, m + 1) - 0.5))) / (3 * q)
    k = -np.log(1 - b[:, None] * x).mean(axis=1)
    w = n * (np.log(b / k) + k - 1)
    w = np.exp(w - w.max())
    return np.log(1 - (b * w).sum() / w.sum() * x).mean()


@pytest.mark.parametrize(("limit", "block"), [(None, 4_096), (40, 4_096), (None, 30)])
def test_tail_index(spark, limit, block, monkeypatch):
    monkeypatch.setattr(diagnostics, "VALUES_PER_BLOCK", block)
    rng = np.random.default_rng(3)
    values = {"heavy": rng.pareto(1.0, 400) + 0.1, "light": rng.exponential(1.0, 333), "zero": np.r_[0.0, rng.uniform(1, 2, 20)]}
    values[None] = rng.pareto(2.0, 50) + 0.1
    rows = [(k, float(v)) for k, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "parameter string, value double")
    found = {r["parameter"]: r["khat"] for r in diagnostics.khat(df, ["parameter"], "value", limit).collect()}
    for name, vs in values.items():
        assert found[name] == pytest.approx(brute_khat(vs), abs=1e-9)
    assert found["heavy"] > 0.5 > found["light"] and found["zero"] == 0


def test_rollout_goes_block_by_block(spark):
    specimens = spark.createDataFrame(
        [(s, s * 100 + d, d, 0.1 * d) for s in (1, 2) for d in range(1, 8 - s)],
        "subject_id long, specimen_id2 long, study_day int, lag_emp_prop double",
    )
    draws = spark.createDataFrame(
        [(n, s, 0.3 * n) for n in range(4) for s in (1, 2)], "draw long, subject_id long, a double"
    )

    def link(specimen, previous):
        return F.col("a") + previous * F.lit(0.5) + specimen["study_day"]

    def python_link(params, specimen, previous):
        return params["a"] + previous * 0.5 + specimen["study_day"]

    expected = []
    for n in range(4):
        for s in (1, 2):
            pred = 0.1
            for d in range(1, 8 - s):
                pred = 0.3 * n + pred * 0.5 + d
                expected.append((n, s * 100 + d, pytest.approx(pred)))
    for block in (2, 1000):
        for python, fn in ((False, link), (True, python_link)):
            found = posterior.pp_rollout(draws, specimens, fn, python=python, block=block)
            rows = rows_of(found.select("draw", "specimen_id2", "pred_prob"), "draw", "specimen_id2")
            assert rows == expected


@pytest.mark.parametrize("p", [0.0, 0.37, 0.5, 0.95, 1.0])
def test_scaling_by_ranks_in_slices_of_counts(spark, p):
    """Counts of every size, most in one specimen, against a quantile over all of them."""
    random = np.random.default_rng(3)
    counts = {
        "hot": (2.0 ** random.uniform(0, 40, 3000)).astype(np.int64),
        "ties": random.integers(1, 4, 400),
        "two": np.array([1, 1 << 52]),
        "one": np.array([7]),
    }
    table = [(s, f"o{i}", int(n)) for s, many in counts.items() for i, n in enumerate(many)]
    df = spark.createDataFrame(
        [*table, ("none", "o", 0), (None, "o", 5)], "specimen_id2 string, otu_id string, read_count long"
    )
    found = {(r[0], r[1]): r[2] for r in normalize.css_normalize(df, p, 10.0, min_features=2).collect()}
    want = {}
    for s, many in counts.items():
        scale = int(many[many <= np.sort(many)[int((len(many) - 1) * p)]].sum())
        want |= {(s, f"o{i}"): n / scale * 10.0 for i, n in enumerate(many) if s != "one"}
    assert found.keys() == want.keys()
    assert all(found[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_slices_of_counts_follow_their_order(spark):
    counts = [*range(1, 5000), *(int(2**k) + d for k in range(13, 62) for d in (-1, 0, 1)), 2**63 - 1]
    df = spark.createDataFrame([(n,) for n in counts], "n long")
    slices = [r[1] for r in df.withColumn("s", normalize.count_slice(F.col("n"))).orderBy("n").collect()]
    assert slices == sorted(slices) and slices[:2047] == list(range(1, 2048)) and slices[-1] < 64 << 10


def test_scaling_holds_no_list_of_counts(spark):
    df = spark.createDataFrame([], "specimen_id2 string, otu_id string, read_count long")
    plan = normalize.css_normalize(df)._jdf.queryExecution().toString().lower()
    assert "collect_list" not in plan and "percentile" not in plan

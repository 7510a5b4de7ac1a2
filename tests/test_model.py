"""Model quantities against dense linear algebra."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from abundex.operators import diagnostics, frame, model
from abundex.operators.drawblocks import block_draws, block_intervals, draw_blocks, spread_blocks
from abundex.operators.model import VARIANTS, Scales
from abundex.operators.posterior import median_qi, spread_draws


@pytest.fixture(scope="module")
def study(spark):
    """Two models, five subjects each, up to two exposures on a specimen."""
    rng = np.random.default_rng(11)
    obs, design = [], []
    for m in ("one", "two"):
        for s in range(5):
            for n in range(int(rng.integers(3, 9))):
                name = f"{m}{s}{n}"
                obs.append((m, name, f"s{s}", float(rng.lognormal(1, 0.4)), float(rng.lognormal(1, 0.4))))
                for j in ("p", "q"):
                    if rng.random() < 0.5:
                        design.append((name, f"s{s}", j, int(rng.integers(1, 4))))
    return (
        spark.createDataFrame(obs, "model string, specimens string, subjects string, D1 double, D1_lag double"),
        spark.createDataFrame(design, "specimens string, subjects string, abx_lag string, k long"),
    )


def dense(obs, design, variant, scales):
    """Posterior mean from the whole design at once."""
    subjects = sorted(obs.subjects.unique())
    used = design[design.specimens.isin(obs.specimens)]
    effects = sorted({(r.abx_lag, r.k) for r in used.itertuples()})
    own = sorted({(r.subjects, r.abx_lag, r.k) for r in used.itertuples()})
    names = ["a", "b_lag", *(("za", *e) for e in effects), *(("a_subj", s) for s in subjects), *(("d", *o) for o in own)]
    at = {n: i for i, n in enumerate(names)}
    x = np.zeros((len(obs), len(names)))
    for i, r in enumerate(obs.itertuples()):
        x[i, at["a"]], x[i, at["b_lag"]], x[i, at["a_subj", r.subjects]] = 1, r.D1_lag, 1
        for e in used[used.specimens == r.specimens].itertuples():
            x[i, at["za", e.abx_lag, e.k]] = 1
            x[i, at["d", r.subjects, e.abx_lag, e.k]] = 1
    sd = {"a": 1, "b_lag": variant.lag_sd}
    sds = [sd[n] if n in sd else {"za": variant.za_sd, "a_subj": scales.s_subj, "d": scales.s_abx2}[n[0]] for n in names]
    precision = x.T @ x / scales.sigma**2 + np.diag(1 / np.square(sds))
    beta = np.linalg.solve(precision, x.T @ np.log(obs.D1) / scales.sigma**2)
    value = dict(zip(names, beta))
    out = {(None, "a"): value["a"], (None, "b_lag"): value["b_lag"]}
    out |= {(None, f"za_abx2[{j},{k}]"): value["za", j, k] for j, k in effects}
    out |= {(s, "a_subj"): value["a_subj", s] for s in subjects}
    out |= {(s, f"b_abx2[{j},{k}]"): value["za", j, k] + value["d", s, j, k] for s, j, k in own}
    return out


def test_conditional_fit_equals_the_dense_solution(study):
    obs, design = study
    variant, scales = VARIANTS["3.7"], Scales(0.4, 0.7, 0.3)
    gram = model.gram_statistics(obs, design, ["model", "subjects"])
    found = model.conditional_map_fit(gram, variant, scales).collect()
    for m in ("one", "two"):
        got = {(r["subjects"], r["parameter"]): r["value"] for r in found if r["model"] == m}
        want = dense(obs.filter(F.col("model") == m).toPandas(), design.toPandas(), variant, scales)
        assert got.keys() == want.keys()
        for key, value in want.items():
            assert got[key] == pytest.approx(value, abs=1e-9)


def test_gram_equals_the_dense_product(study):
    obs, design = study
    found = {(r["p"], r["q"]): r["value"] for r in model.gram_statistics(obs, design, ["model"]).filter("model = 'one'").collect()}
    table = obs.filter("model = 'one'").toPandas().set_index("specimens")
    assert found["1", "1"] == len(table)
    assert found["1", "y"] == pytest.approx(np.log(table.D1).sum())
    assert found["D1_lag", "y"] == pytest.approx((np.log(table.D1) * table.D1_lag).sum())
    ones = design.toPandas()
    first = set(ones[(ones.abx_lag == "p") & (ones.k == 1)].specimens) & set(table.index)
    assert found["x[p,1]", "x[p,1]"] == len(first)


@pytest.fixture(scope="module")
def draws(spark):
    rng = np.random.default_rng(2)
    rows = []
    for draw in range(6):
        value = {
            "a": rng.normal(), "b_lag": rng.normal(), "sigma": rng.gamma(2), "s_subj": rng.gamma(2), "s_spec": rng.gamma(2),
            **{f"a_subj[{i}]": rng.normal() for i in (1, 2)},
            **{f"a_spec[{n}]": rng.normal() for n in (1, 2, 3)},
            **{f"za_abx1[{k}]": rng.normal() for k in (1, 2)},
            **{f"s_abx1[{k}]": rng.gamma(2) for k in (1, 2)},
            **{f"zb_abx1[{j},{k}]": rng.normal() for j in (1, 2) for k in (1, 2)},
            **{f"za_abx2[{j},{k}]": rng.normal() for j in (1, 2) for k in (1, 2)},
            **{f"s_abx2[{j},{k}]": rng.gamma(2) for j in (1, 2) for k in (1, 2)},
            **{f"zb_abx2[{i},{j},{k}]": rng.normal() for i in (1, 2) for j in (1, 2) for k in (1, 2)},
        }
        rows += [(draw, name, float(v)) for name, v in value.items()]
    return spark.createDataFrame(rows, "draw long, parameter string, value double")


def values(draws, draw):
    return {r["parameter"]: r["value"] for r in draws.filter(F.col("draw") == draw).collect()}


def normal(x, mean, sd):
    return -math.log(sd) - 0.5 * math.log(2 * math.pi) - 0.5 * ((x - mean) / sd) ** 2


def test_predictor_with_all_terms(spark, draws):
    variant = VARIANTS["3.0"]
    obs = spark.createDataFrame([("s17", 1), ("s42", 1), ("x", 2)], "specimens string, i int")
    codes = frame.label_index(obs, "specimens").withColumnRenamed("idx", "specimen")
    obs = obs.join(codes, "specimens")
    design = spark.createDataFrame(
        [("s17", 1, 1, 1), ("s17", 1, 2, 2), ("x", 2, 1, 2)], "specimens string, i int, j int, k int"
    )
    blocks = draw_blocks(draws, 4)  # six draws in two blocks

    def in_blocks(effects, name, *index):
        parameter = F.concat(F.lit(f"{name}["), F.concat_ws(",", *index), F.lit("]"))
        rows = effects.select("draw", parameter.alias("parameter"), F.col(name).alias("value"))
        return spread_blocks(draw_blocks(rows, 4), f"{name}[{','.join(index)}]")

    effects = in_blocks(model.noncentered_effects(draws, variant), "b_abx2", "i", "j", "k")
    population = in_blocks(model.population_effects(draws), "b_abx1", "j", "k")
    mu = model.linear_predictor(obs, design, effects, blocks, variant, population)
    found = {(r["draw"], r["specimens"]): r["mu"] for r in mu.collect()}
    assert len(found) == 18
    for draw in (0, 5):
        v = values(draws, draw)

        def b(i, j, k):
            own = v[f"za_abx2[{j},{k}]"] + v[f"zb_abx2[{i},{j},{k}]"] * v[f"s_abx2[{j},{k}]"]
            return own + v[f"za_abx1[{k}]"] + v[f"zb_abx1[{j},{k}]"] * v[f"s_abx1[{k}]"]

        base = {n: v["a"] + v[f"a_spec[{n}]"] + v[f"a_subj[{i}]"] for n, i in ((1, 1), (2, 1), (3, 2))}
        assert found[draw, "s17"] == pytest.approx(base[1] + b(1, 1, 1) + b(1, 2, 2))
        assert found[draw, "s42"] == pytest.approx(base[2])
        assert found[draw, "x"] == pytest.approx(base[3] + b(2, 1, 2))


def test_blocks_with_different_draws_stop(spark):
    rows = [(0, "a", 1.0), (1, "a", 2.0), (0, "b", 1.0)]
    blocks = draw_blocks(spark.createDataFrame(rows, "draw long, parameter string, value double"))
    with pytest.raises(Exception, match="different draws"):
        block_draws(blocks).collect()


def test_intervals_of_blocks_are_those_of_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(d, f"b[{i}]", None if d == 3 and i == 1 else float(rng.normal())) for d in range(23) for i in (1, 2, 3)]
    draws = spark.createDataFrame([*rows, (0, "b[4]", None)], "draw long, parameter string, value double")
    spread = spread_blocks(draw_blocks(draws, 5), "b[i]")
    want = median_qi(spread_draws(draws, "b[i]"), ["i"], ["b"], 0.8).collect()
    want = {r["i"]: [r["b"], r["b_lower"], r["b_upper"]] for r in want}
    for limit in (10, 1_000):  # taken apart, and whole
        found = block_intervals(spread, ["i"], ["b"], 23, 0.8, limit).collect()
        for r in found:
            got = [r["b"], r["b_lower"], r["b_upper"]]
            assert got == (pytest.approx(want[r["i"]]) if r["i"] < 4 else [None] * 3)


@pytest.mark.parametrize("name", ["3.0", "3.2", "3.5", "3.7", "3.9b"])
def test_prior_is_the_sum_of_its_terms(draws, name):
    variant = VARIANTS[name]
    found = {r["draw"]: r["log_prior"] for r in model.log_prior(draws, variant).collect()}
    for draw in (0, 3):
        total = 0.0
        v = values(draws, draw)
        repeat = 2 if variant.prior_per_k else 1
        for parameter, x in v.items():
            base = parameter.split("[")[0]
            if base == "a":
                total += normal(x, 0, 1)
            elif base == "b_lag":
                total += normal(x, 0, variant.lag_sd)
            elif base in ("sigma", "s_subj"):
                total += normal(x, 0, 5)
            elif base == "a_subj":
                total += normal(x, 0, v["s_subj"])
            elif base == "za_abx2":
                total += repeat * normal(x, 0, variant.za_sd)
            elif base == "s_abx2":
                total += repeat * normal(x, variant.s_mean, variant.s_sd)
            elif base == "zb_abx2":
                total += normal(x, 0, 1)
            elif base == "s_spec" and variant.specimen_intercept:
                total += normal(x, 0, 5)
            elif base == "a_spec" and variant.specimen_intercept:
                total += normal(x, 0, v["s_spec"])
            elif base in ("za_abx1", "s_abx1", "zb_abx1") and variant.population_effect:
                total += normal(x, 0, 1)
        assert found[draw] == pytest.approx(total)


def test_log_density_integrates_to_one(spark):
    grid = spark.range(1, 200_001).select((F.col("id") / 2000).alias("y"))
    density = F.exp(model.lognormal_log_density(F.col("y"), F.lit(0.3), F.lit(0.5)))
    assert grid.agg(F.sum(density) / 2000).first()[0] == pytest.approx(1.0, abs=1e-3)


# --- diagnostics on known chains ---------------------------------------------------------


def chains(spark, table):
    rows = [(c, n, c * 100 + n, p, float(x)) for p, per_chain in table.items() for c, xs in enumerate(per_chain) for n, x in enumerate(xs)]
    return spark.createDataFrame(rows, "chain int, iteration int, draw long, parameter string, value double")


def test_rhat_flags_apart_and_constant_chains(spark):
    rng = np.random.default_rng(1)
    draws = chains(
        spark,
        {
            "good": rng.normal(size=(3, 60)),
            "apart": rng.normal(size=(3, 60)) + np.array([[0], [5], [10]]),
            "constant": np.ones((3, 60)),
            "stuck": np.ones((3, 60)) * np.array([[0], [1], [2]]),
        },
    )
    found = {r["parameter"]: r for r in diagnostics.check_rhat(draws).collect()}
    assert not found["good"]["warn"] and found["good"]["rhat"] == pytest.approx(1, abs=0.1)
    assert found["apart"]["warn"] and found["apart"]["rhat"] > 2
    assert found["constant"]["warn"] and found["stuck"]["warn"]


def test_single_chain_has_all_diagnostics(spark):
    rng = np.random.default_rng(4)
    draws = chains(spark, {"x": rng.normal(size=(1, 81)), "flat": np.ones((1, 81))})
    sampler = spark.createDataFrame([(0, n, 0, 3, float(e)) for n, e in enumerate(rng.normal(size=81))], "chain int, iteration int, divergent int, treedepth int, energy double")
    tails = {r["parameter"]: (r["khat_left"], r["khat_right"]) for r in diagnostics.tail_khats(draws).collect()}
    assert tails["flat"] == (0.0, 0.0)
    assert tails["x"][0] == 0.0 and tails["x"][1] != 0.0
    assert diagnostics.check_all_diagnostics(draws.filter("parameter = 'x'"), sampler).first()[0] == 0
    deep = sampler.withColumns({"treedepth": F.lit(10), "divergent": F.lit(1)})
    code = diagnostics.check_all_diagnostics(draws, deep).first()[0]
    assert code == 1 + 2 + 8 + 16
    names = spark.range(1).select(diagnostics.parse_warning_code(F.lit(code))).first()[0]
    assert names == ["n_eff / iteration warning", "rhat warning", "divergence warning", "treedepth warning"]


def test_energy_of_a_random_walk_warns(spark):
    rng = np.random.default_rng(8)
    rows = [(0, n, 0, 1, float(e)) for n, e in enumerate(np.cumsum(rng.normal(size=400)))]
    rows += [(1, n, 0, 1, float(e)) for n, e in enumerate(rng.normal(size=400))]
    sampler = spark.createDataFrame(rows, "chain int, iteration int, divergent int, treedepth int, energy double")
    found = {r["chain"]: r for r in diagnostics.check_energy(sampler).collect()}
    for chain in (0, 1):
        e = np.array([r[4] for r in rows if r[0] == chain])
        assert found[chain]["e_fmi"] == pytest.approx((np.diff(e) ** 2).sum() / len(e) / e.var(ddof=1))
    assert found[0]["warn"] and not found[1]["warn"]

"""Sampler diagnostics as table jobs; every check returns rows instead of printing.

Draws: chain, iteration, draw, parameter, value. Sampler: chain, iteration,
divergent, treedepth, energy.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abundex.functions.expressions import join_groups
from abundex.functions.ordered import block_slice, lag_in_slices, row_number_in_slices
from abundex.functions.quantiles import (
    GROUP_ROWS,
    group_quantiles,
    oversized_groups,
    value_at_rank,
    value_ranks,
)
from abundex.session import cut_lineage

# Thresholds of the checks, and the warning behind each bit of the code.
MIN_ESS_RATIO = 0.001
MAX_RHAT = 1.1
MAX_KHAT = 0.5
MIN_EFMI = 0.2
MAX_DEPTH = 10
WARNINGS = (
    "n_eff / iteration warning",
    "rhat warning",
    "khat warning",
    "divergence warning",
    "treedepth warning",
    "energy warning",
)
LAGS_PER_ROUND = 1_024
# Rounds grow up to this many times the first one.
LONGEST_ROUND = 1_024
VALUES_PER_BLOCK = 4_096


def stack_chains(chains: Sequence[DataFrame]) -> DataFrame:
    """One frame from one frame per chain."""
    return reduce(lambda a, b: a.unionByName(b), chains)


def partition_divergent(draws: DataFrame, sampler: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Draws of the divergent and of the other transitions."""
    flagged = draws.join(sampler.select("chain", "iteration", "divergent"), ["chain", "iteration"])
    return flagged.filter(F.col("divergent") == 1), flagged.filter(F.col("divergent") == 0)


def _share(bad: Column) -> list[Column]:
    n, total = F.count_if(bad), F.count(F.lit(1))
    return [
        n.alias("n"),
        total.alias("n_total"),
        (F.lit(100.0) * F.try_divide(n, total)).alias("percent"),
        (n > 0).alias("warn"),
    ]


def check_div(sampler: DataFrame) -> DataFrame:
    return sampler.agg(*_share(F.col("divergent") == 1))


def check_treedepth(sampler: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Transitions at exactly the maximum depth."""
    return sampler.agg(*_share(F.col("treedepth") == max_depth))


def energy_diff(sampler: DataFrame) -> DataFrame:
    """Energy minus the previous iteration's, inside each chain; NULL at its start."""
    sliced = sampler.withColumn("_slice", block_slice(F.col("iteration")))
    lagged = lag_in_slices(sliced, ["chain"], "_slice", ["iteration"], "energy", "_last_energy")
    return lagged.withColumn("energy_diff", F.col("energy") - F.col("_last_energy")).drop(
        "_slice", "_last_energy"
    )


def check_energy(sampler: DataFrame) -> DataFrame:
    """E-FMI per chain: mean squared energy step over the energy variance."""
    step = F.col("energy_diff")
    ratio = F.try_divide(F.sum(step * step) / F.count("energy"), F.var_samp("energy"))
    return (
        energy_diff(sampler)
        .groupBy("chain")
        .agg(ratio.alias("e_fmi"))
        .withColumn("warn", F.coalesce(F.col("e_fmi") < MIN_EFMI, F.lit(True)))
    )


def chain_positions(draws: DataFrame) -> DataFrame:
    """0-based position of each iteration in its chain."""
    known = draws.select("chain", "iteration").distinct().withColumn(
        "_slice", block_slice(F.col("iteration"))
    )
    numbered = row_number_in_slices(known, ["chain"], "_slice", ["iteration"], "_at")
    return numbered.select("chain", "iteration", (F.col("_at") - 1).alias("pos"))


def rhat(draws: DataFrame) -> DataFrame:
    """Split R-hat per parameter: each chain's first and last half count as chains.

    The middle iteration of an odd chain is left out.
    """
    positions = chain_positions(draws)
    lengths = positions.groupBy("chain").agg(F.max("pos").alias("_last"))
    size = F.floor((F.col("_last") + 1) / 2)
    half = F.when(F.col("pos") < size, 0).when(F.col("pos") > F.col("_last") - size, 1)
    halves = (
        positions.join(lengths, "chain")
        .withColumn("half", half)
        .filter(F.col("half").isNotNull())
        .select("chain", "iteration", "half")
    )
    per_half = (
        draws.join(halves, ["chain", "iteration"])
        .groupBy("parameter", "chain", "half")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.avg("value").alias("_mean"),
            F.var_samp("value").alias("_var"),
        )
    )
    n, within = F.avg("_n"), F.avg("_var")
    pooled = (n - 1) / n * within + F.var_samp("_mean")
    return per_half.groupBy("parameter").agg(
        F.sqrt(F.try_divide(pooled, within)).alias("rhat")
    )


def check_rhat(draws: DataFrame) -> DataFrame:
    """R-hat with a warning above the limit, and where it is infinite or undefined."""
    high = F.coalesce(F.col("rhat") > MAX_RHAT, F.lit(True))
    return rhat(draws).withColumn("warn", high)


def _block_products(lags_from: int, size: int):
    """Sums of x[p] * x[p + lag] for the p of one block and ``size`` lags."""

    def products(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        parameter, chain, block = key
        here, there = np.zeros(size), np.zeros(2 * size)
        own = part[part["_role"] == 0]
        here[own["pos"].to_numpy() - block * size] = own["x"]
        other = part[part["_role"] == 1]
        there[other["pos"].to_numpy() - block * size - lags_from] = other["x"]
        # The longer of the two is as long as the transform, so the lags wanted do not wrap.
        spectrum = np.fft.rfft(there) * np.conj(np.fft.rfft(here, 2 * size))
        sums = np.fft.irfft(spectrum, 2 * size)[:size]
        count = min(size, int(part["_n"].iloc[0]) - lags_from)
        return pd.DataFrame(
            {
                "parameter": parameter,
                "chain": chain,
                "lag": np.arange(lags_from, lags_from + count),
                "s": sums[:count],
            }
        )

    return products


def _lag_sums(centred: DataFrame, number: int, size: int) -> DataFrame:
    """Autocovariance sums for the lags of one round, block by block.

    A block of ``size`` positions meets the two blocks that hold its partners, so
    no task sees more than ``3 * size`` rows of a chain; their products are taken by Fourier transform.
    """
    block = F.floor(F.col("pos") / size)
    places = F.array(
        F.struct(block.alias("block"), F.lit(0).alias("_role")),
        F.struct((block - number).alias("block"), F.lit(1).alias("_role")),
        F.struct((block - number - 1).alias("block"), F.lit(1).alias("_role")),
    )
    rows = centred.select("parameter", "chain", "pos", "x", "_n", F.inline(places)).filter(
        F.col("block") >= 0
    )
    parameter = centred.schema["parameter"].dataType.simpleString()
    chain = centred.schema["chain"].dataType.simpleString()
    return (
        rows.groupBy("parameter", "chain", "block")
        .applyInPandas(
            _block_products(number * size, size),
            f"parameter {parameter}, chain {chain}, lag bigint, s double",
        )
        .groupBy("parameter", "chain", "lag")
        .agg(F.sum("s").alias("s"))
    )


def _ess_from_sums(sums: DataFrame, chains: DataFrame) -> DataFrame:
    """Effective sample size from the autocovariance sums of all lags seen so far."""
    pooled = chains.groupBy("parameter").agg(
        F.count(F.lit(1)).alias("_m"),
        F.sum("_n").alias("_total"),
        F.max("_n").alias("_length"),
        F.avg("_var").alias("_within"),
        F.coalesce(F.var_samp("_mean"), F.lit(0.0)).alias("_between"),
        F.avg((F.col("_n") - 1) / F.col("_n") * F.col("_var")).alias("_biased"),
    )
    by_lag = (
        sums.join(chains.select("parameter", "chain", "_n"), ["parameter", "chain"])
        .groupBy("parameter", "lag")
        .agg(F.avg(F.col("s") / F.col("_n")).alias("_acov"))
        .join(pooled, "parameter")
    )
    variance = F.col("_biased") + F.col("_between")
    rho = F.when(F.col("lag") == 0, F.lit(1.0)).otherwise(
        F.lit(1.0) - F.try_divide(F.col("_within") - F.col("_acov"), variance)
    )
    pairs = (
        by_lag.withColumn("_rho", rho)
        .groupBy("parameter", "_total", "_length", F.floor(F.col("lag") / 2).alias("_pair"))
        .agg(
            F.when(F.count("_rho") == 2, F.sum("_rho")).alias("_sum"),
            F.count(F.lit(1)).alias("_size"),
        )
        .filter(F.col("_size") == 2)
    )
    upto = Window.partitionBy("parameter").orderBy("_pair")
    lowest = pairs.withColumn("_low", F.min("_sum").over(upto))
    leading = F.when((F.col("_low") > 0), F.col("_low"))
    return lowest.groupBy("parameter", "_total", "_length").agg(
        F.try_divide(
            F.col("_total").cast("double"), F.lit(-1.0) + F.lit(2.0) * F.sum(leading)
        ).alias("n_eff"),
        (F.min("_low") > 0).alias("_open"),
        (F.max("_pair") * 2 + 2).alias("_lags"),
    )


def n_eff(draws: DataFrame, lags_per_round: int = LAGS_PER_ROUND) -> DataFrame:
    """Effective sample size per parameter, from all chains.

    Pairs of autocorrelations are summed while positive and made monotone. Lags
    are worked off in rounds; only parameters whose pairs are still positive at the
    end of a round go into the next one, so a slow chain costs more rounds and
    loses nothing. From the second round on a round has as many lags as all before it,
    up to a limit, so the work of a chain of n draws is about n log(n)^2. Each round
    writes its own sums. ``lags_per_round`` must be even.
    """
    if lags_per_round % 2:
        raise ValueError("lags_per_round must be even")
    placed = draws.join(chain_positions(draws), ["chain", "iteration"])
    chains = placed.groupBy("parameter", "chain").agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg("value").alias("_mean"),
        F.var_samp("value").alias("_var"),
    )
    centred = join_groups(placed, chains, ["parameter", "chain"]).select(
        "parameter", "chain", "pos", (F.col("value") - F.col("_mean")).alias("x"), "_n"
    )
    longest = chains.agg(F.max("_n")).first()[0]
    sums = None
    left, done, size = centred, 0, lags_per_round
    while longest is not None and done < longest:
        more = _lag_sums(left, done // size, size)
        done += size
        if done < longest:
            more = cut_lineage(more)
        sums = more if sums is None else sums.unionByName(more)
        if done >= longest:
            break
        going_on = _ess_from_sums(sums, chains).filter(
            F.col("_open") & (F.col("_lags") < F.col("_length"))
        )
        if going_on.isEmpty():
            break
        left = cut_lineage(
            join_groups(left, going_on.select("parameter"), ["parameter"], "left_semi")
        )
        size = min(done, LONGEST_ROUND * lags_per_round)
    if sums is None:
        raise ValueError("no draws")
    return _ess_from_sums(sums, chains).select("parameter", "n_eff", F.col("_total").alias("n_draws"))


def check_n_eff(draws: DataFrame, lags_per_round: int = LAGS_PER_ROUND) -> DataFrame:
    """Effective sample size per draw, with a warning below the limit or where undefined."""
    return n_eff(draws, lags_per_round).withColumn(
        "ratio", F.col("n_eff") / F.col("n_draws")
    ).withColumn("warn", F.coalesce(F.col("ratio") < MIN_ESS_RATIO, F.lit(True)))


def khat(
    df: DataFrame, keys: Sequence[str], value: str, limit: int | None = GROUP_ROWS
) -> DataFrame:
    """Tail index of a generalised Pareto fit to the positive values of each group.

    The candidates of a group, ``20 + sqrt(N)`` of them, are made from its size,
    maximum and first quartile. The values are put into blocks; a block tries all candidates
    at once and hands on one array of sums, so there is a row per block and candidate and
    none per value and candidate. Groups with a value of 0 or less get 0; a NULL key is a group.
    """
    keys = list(keys)
    ranks = value_ranks(df, keys, value, limit)
    sizes = ranks.groupBy(*keys).agg(
        F.sum("_freq").alias("_n"), F.min(value).alias("_min"), F.max(value).alias("_max")
    )
    quarter = F.greatest(F.lit(1), F.floor(F.lit(0.25) * F.col("_n") + F.lit(0.5)))
    stats = (
        join_groups(ranks, sizes, keys)
        .groupBy(*keys, "_n", "_min", "_max")
        .agg(value_at_rank(value, quarter).alias("_q"))
    )
    n = F.col("_n")
    count = F.lit(20) + F.floor(F.sqrt(n))

    def candidate(m: Column) -> Column:
        spread = F.lit(1.0) - F.sqrt(count / (m - F.lit(0.5)))
        return F.lit(1.0) / F.col("_max") + spread / (F.lit(3.0) * F.col("_q"))

    positive = stats.filter(F.col("_min") > 0)
    tries = positive.select(*keys, "_n", F.transform(F.sequence(F.lit(1).cast("long"), count), candidate).alias("_b"))
    block = F.pmod(F.xxhash64(value), F.ceil(n / VALUES_PER_BLOCK))
    blocks = (
        join_groups(ranks, positive.select(*keys, "_n"), keys)
        .groupBy(*keys, block.alias("_block"))
        .agg(F.collect_list(F.struct(F.col(value).alias("x"), F.col("_freq").alias("f"))).alias("_values"))
    )

    def summed(b: Column) -> Column:
        return F.aggregate("_values", F.lit(0.0), lambda done, v: done + v["f"] * F.ln(F.lit(1.0) - b * v["x"]))

    profiles = join_groups(blocks, tries, keys).select(*keys, "_n", "_b", F.transform("_b", summed).alias("_s"))
    tried = (
        profiles.select(*keys, "_n", F.inline(F.arrays_zip("_b", "_s")))
        .groupBy(*keys, "_n", "_b")
        .agg(F.sum("_s").alias("_s"))
    )
    k = -F.col("_s") / n
    weighed = tried.withColumn("_log_w", n * (F.ln(F.col("_b") / k) + k - F.lit(1.0)))
    top = weighed.groupBy(*keys).agg(F.max("_log_w").alias("_top"))
    weight = F.exp(F.col("_log_w") - F.col("_top"))
    best = (
        join_groups(weighed, top, keys)
        .groupBy(*keys)
        .agg((F.sum(F.col("_b") * weight) / F.sum(weight)).alias("_best"))
    )
    fitted = (
        join_groups(ranks, best, keys)
        .groupBy(*keys)
        .agg(
            F.sum(F.col("_freq") * F.ln(F.lit(1.0) - F.col("_best") * F.col(value))).alias("_s")
        )
    )
    return join_groups(sizes, fitted, keys, "left").select(
        *keys, F.coalesce(F.col("_s") / n, F.lit(0.0)).alias("khat")
    )


def tail_khats(draws: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """Tail index left and right of the median, per parameter; (0, 0) when the median is an extreme."""
    if oversized_groups(draws, ["parameter"], limit).isEmpty():
        limit = None
    middle = group_quantiles(draws, ["parameter"], ["value"], [0.5], limit).select(
        "parameter", F.col("value")[0].alias("_median")
    )
    ends = draws.groupBy("parameter").agg(
        F.min("value").alias("_min"), F.max("value").alias("_max")
    )
    stats = join_groups(middle, ends, ["parameter"]).withColumn(
        "_flat", (F.col("_median") == F.col("_min")) | (F.col("_median") == F.col("_max"))
    )
    sides = join_groups(draws, stats.filter(~F.col("_flat")), ["parameter"]).select(
        "parameter",
        F.when(F.col("value") <= F.col("_median"), "left").otherwise("right").alias("side"),
        F.abs(F.col("value") - F.col("_median")).alias("_distance"),
    )
    side = F.col("side")
    found = (
        khat(sides, ["parameter", "side"], "_distance", limit)
        .groupBy("parameter")
        .agg(
            F.max(F.when(side == "left", F.col("khat"))).alias("khat_left"),
            F.max(F.when(side == "right", F.col("khat"))).alias("khat_right"),
        )
    )
    return join_groups(stats.select("parameter"), found, ["parameter"], "left").fillna(
        0.0, ["khat_left", "khat_right"]
    )


def check_tail_khat(draws: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """Tail indices with a warning per side above the limit."""
    return tail_khats(draws, limit).withColumns(
        {
            "warn_left": F.col("khat_left") > MAX_KHAT,
            "warn_right": F.col("khat_right") > MAX_KHAT,
        }
    )


def check_all_diagnostics(
    draws: DataFrame, sampler: DataFrame, max_depth: int = MAX_DEPTH
) -> DataFrame:
    """One row with the six-bit warning code."""
    checks = (
        check_n_eff(draws).select("warn"),
        check_rhat(draws).select("warn"),
        check_tail_khat(draws).select((F.col("warn_left") | F.col("warn_right")).alias("warn")),
        check_div(sampler).select("warn"),
        check_treedepth(sampler, max_depth).select("warn"),
        check_energy(sampler).select("warn"),
    )
    marked = [
        check.select(F.when(F.col("warn"), F.lit(1 << bit)).otherwise(F.lit(0)).alias("bit"))
        for bit, check in enumerate(checks)
    ]
    return stack_chains(marked).agg(
        F.coalesce(F.bit_or("bit"), F.lit(0)).alias("warning_code")
    )


def parse_warning_code(code: Column) -> Column:
    """The warnings whose bits are set, as an array."""
    names = F.array(*(F.lit(w) for w in WARNINGS))
    bits = F.transform(
        names,
        lambda name, i: F.when(
            code.bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0, name
        ),
    )
    return F.filter(bits, lambda name: name.isNotNull())

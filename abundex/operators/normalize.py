"""Rarefaction and cumulative-sum scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abundex.functions.expressions import bisect, join_groups
from abundex.functions.ordered import hash_order, hash_slice, running_sum

FEATURES_PER_SLICE = 100_000


def read_word(text: Column) -> Column:
    """A 60-bit hash."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def word_position(word: Column, total: Column, whole: bool = True) -> Column:
    """The place in ``[0, total)`` that a 60-bit hash stands for.

    For whole counts, exactly: ``floor(h * total / 2^60)``, where products fit in two halves of
    ``h`` and as decimals else. ``word`` is read several times and should be a value already.
    """
    if not whole:
        return word / F.lit(2.0**60) * total
    high, low = F.shiftright(word, 30), word.bitwiseAND((1 << 30) - 1)
    short = F.shiftright(high * total + F.shiftright(low * total, 30), 30)
    wide = word.cast("decimal(19,0)") * total.cast("decimal(18,0)")
    long = F.call_function("div", wide, F.lit(1 << 60).cast("decimal(19,0)")).cast("long")
    return F.when(total < 1 << 32, short).otherwise(long)


def read_position(
    specimen: Column, draw: Column, total: Column, seed: int, whole: bool = True
) -> Column:
    """A place in ``[0, total)`` that depends only on specimen, draw and seed."""
    text = F.concat_ws("|", specimen.cast("string"), draw.cast("string"), F.lit(str(seed)))
    return word_position(read_word(text), total, whole)


def read_positions(specimen: Column, draws: Column, total: Column, seed: int, whole: bool = True) -> Column:
    """``read_position`` of the draws 0 to ``draws - 1``, each hashed once."""
    words = F.transform(
        F.sequence(F.lit(0), draws - 1),
        lambda draw: read_word(F.concat(specimen.cast("string"), F.lit("|"), draw.cast("string"), F.lit(f"|{seed}"))),
    )
    return F.transform(words, lambda word: word_position(word, total, whole))


def rarefy(
    counts: DataFrame,
    depth: int,
    seed: int = 1988,
    features_per_slice: int = FEATURES_PER_SLICE,
    replace: bool = True,
) -> DataFrame:
    """Draw ``depth`` reads, with replacement or without, from each specimen that has as many.

    A specimen's reads are laid end to end, feature after feature in hash order; a
    feature gets as many reads as drawn places fall between its start and its end.
    The places of a specimen are one sorted array of ``depth`` numbers, looked up by
    bisection, so neither draws nor pairs of draw and feature become rows.
    Specimens with many features are cut into hash slices, each with the places
    that fall into it.

    Without ``replace`` a place counts once, as often as it is drawn, and drawing goes on until
    there are enough; of more than half of the reads those that are left out are drawn. Every draw
    then finds a new place with a chance of a half or more, and four times as many draws and 64
    are enough but for a chance below 2^-60, in which case the job stops. As many draws as are usually
    enough are made first, the others only where they were not. Counts have to be whole.
    """
    whole = counts.schema["read_count"].dataType.typeName() not in ("double", "float")
    if not (whole or replace):
        raise ValueError("drawing without replacement needs whole counts")
    filled = counts.filter((F.col("read_count") > 0) & F.col("specimen_id2").isNotNull())
    deep = (
        filled.groupBy("specimen_id2")
        .agg(F.sum("read_count").alias("_total"), F.count(F.lit(1)).alias("_features"))
        .filter(F.col("_total") >= depth)
    )
    many = F.col("_features") > features_per_slice
    key = ["specimen_id2", "_slice"]
    inside = Window.partitionBy(*key).orderBy("_order").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    features = (
        join_groups(filled, deep.select("specimen_id2", "_features"), ["specimen_id2"])
        .select(
            "specimen_id2",
            F.when(many, hash_slice(F.col("otu_id"))).otherwise("").alias("_slice"),
            hash_order(F.col("otu_id")).alias("_order"),
            "otu_id",
            "read_count",
        )
        .withColumn("_end", F.sum("read_count").over(inside))
    )
    along = Window.partitionBy("specimen_id2")
    total, last = F.sum("_reads").over(along), F.sum("_reads").over(along.orderBy("_slice"))
    slices = (
        features.groupBy(*key)
        .agg(F.max("_end").alias("_reads"))
        .withColumns({"_total": total, "_last": last})
        .withColumn("_first", F.col("_last") - F.col("_reads"))
    )
    # Of most of the reads, draw those that are left out.
    others = F.lit(False) if replace else 2 * F.lit(depth) > F.col("_total")
    wanted = F.when(others, F.col("_total") - depth).otherwise(F.lit(depth)).cast("int")

    def places(draws: Column) -> Column:
        return read_positions(F.col("specimen_id2"), draws, F.col("_total"), seed, whole)

    mine = F.filter(
        "_all", lambda place: (place >= F.col("_first")) & (place < F.col("_last"))
    )
    # One small row becomes ``depth`` hashes: a fixed number of partitions, the one the
    # features have too, keeps Spark from merging these rows into a few tasks.
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = slices.repartition(tasks, *key)
    if replace:
        dealt = dealt.withColumn("_all", places(F.lit(depth)))
    else:
        most, left = 4 * wanted + 64, 1 - wanted / F.col("_total")
        usual = F.ceil(-F.col("_total") * F.ln(left) + 4 * F.sqrt(wanted) + 8)
        every = F.array_distinct(places(most))
        few = F.raise_error(F.lit("too few different places were drawn")).cast("array<bigint>")
        all_drawn = F.when(F.size(every) >= wanted, F.slice(every, F.lit(1), wanted)).otherwise(few)
        dealt = dealt.withColumn("_some", F.array_distinct(places(F.least(most, usual).cast("int")))).withColumn(
            "_all", F.when(F.size("_some") >= wanted, F.slice("_some", F.lit(1), wanted)).otherwise(all_drawn)
        )
    drawn = dealt.select(
        *key,
        others.alias("_others"),
        F.sort_array(F.transform(mine, lambda place: place - F.col("_first"))).alias("_drawn"),
    )

    def below(end: Column) -> Column:
        return bisect(F.col("_drawn"), lambda place: place < end, depth)

    hits = below(F.col("_end")) - below(F.col("_end") - F.col("read_count"))
    hits = F.when(F.col("_others"), F.col("read_count") - hits).otherwise(hits)
    return (
        features.join(drawn, key)
        .select("specimen_id2", "otu_id", hits.cast("long").alias("_hits"))
        .filter(F.col("_hits") > 0)
        .withColumnRenamed("_hits", "read_count")
    )


def count_slice(count: Column, bits: int = 10) -> Column:
    """Slices of positive counts that follow their order: a count up to ``2 ** (bits + 1)`` has its own,
    a larger one shares its binary exponent and next ``bits`` binary digits.

    There are at most ``64 << bits`` slices. A specimen of ``t`` reads has at most about
    ``sqrt(t / 2 ** bits)`` different counts in one of them, as each count costs that many reads.
    """
    shift = F.greatest(F.length(F.bin(count)) - F.lit(bits + 1), F.lit(0))
    return F.call_function("shiftright", count, shift) + shift.cast("long") * F.lit(1 << bits)


def css_normalize(
    counts: DataFrame, p: float = 0.5, sl: float = 1000.0, min_features: int = 1
) -> DataFrame:
    """Divide each count by its specimen's sum of counts up to the ``p`` quantile, times ``sl``.

    A quantile between two ranks lies below the higher one, so the sum runs up to the count of
    rank ``floor((features - 1) * p)``, its ties included. Ranks come from running totals of how
    often each count occurs, cut into slices of counts; no task holds a specimen's list of counts.
    Specimens with fewer than ``min_features`` features drop.
    """
    key = ["specimen_id2"]
    filled = counts.filter((F.col("read_count") > 0) & F.col("specimen_id2").isNotNull())
    occurs = filled.groupBy(*key, "read_count").agg(F.count(F.lit(1)).alias("_freq"))
    features = occurs.groupBy(*key).agg(F.sum("_freq").alias("_features")).filter(F.col("_features") >= min_features)
    sliced = occurs.withColumn("_slice", count_slice(F.col("read_count")))
    ranked = running_sum(sliced, key, "_slice", ["read_count"], F.col("_freq"), "_upto")
    rank = F.floor((F.col("_features") - 1) * F.lit(float(p)))
    scales = (
        join_groups(ranked, features, key)
        .filter(F.col("_upto") - F.col("_freq") <= rank)
        .groupBy(*key)
        .agg(F.sum(F.col("read_count") * F.col("_freq")).alias("_scale"))
    )
    return join_groups(filled, scales, key).select(
        "specimen_id2",
        "otu_id",
        (F.col("read_count") / F.col("_scale") * F.lit(float(sl))).alias("norm_count"),
    )

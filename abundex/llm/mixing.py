"""Mixing sources to target weights along a curriculum.

Each source has a weight and a schedule: its intensity over training time 0..1, a piecewise
linear function given by its values at equally spaced knots. Targets follow the weights; the
integral of the schedule, scaled to the target, is the source's cumulative demand for words.
Inside a source the documents stand in a hash order, repeated up to three times; a copy is
taken if the middle of its words lies below the target, and its training position is the
time at which the cumulative demand reaches its first word. Sorting by position gives the
training order. Only built-in functions are used.

Defined results: a null source is a source of its own, the last one; a null or empty text has
size 0 and is never taken; an empty table gives empty results; equal sources in other columns
do not matter; repeated rows are separate documents in an order fixed by id, size and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abundex.llm.common import WORD, text_of, written

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
SLICE_DOCS = 2_000
# Intensity at equally spaced times for each weight class: heavy sources grow, light ones fade.
SCHEDULES = ((0.5, 1.0, 1.5), (1.0, 1.0, 1.0), (1.5, 1.0, 0.5))


def _sized(docs: DataFrame, carry: list[str]) -> DataFrame:
    """One row per document: size, a hash order that does not depend on the layout, and ``carry``."""
    words = F.regexp_count(text_of(), F.lit(WORD)).cast("long")
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    tie = F.xxhash64(text_of())
    return docs.select(
        "doc_id",
        F.col("source").alias("_source"),
        words.alias("size"),
        order.alias("_order"),
        tie.alias("_tie"),
        *carry,
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per source: size, weight, target and number of documents.

    With the sources sorted by size per weight, the first ones are full (at ``max_copies`` times
    their size) and the others share what is left by weight; this is where repeated resharing
    of the excess ends. Documents are summed per source before anything else, so the ordered
    steps see one row per source.
    """
    sums = sized.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    named = Window.orderBy(F.col("_source").asc_nulls_last())
    choice = F.array(*[F.lit(w) for w in weights])
    place = (F.row_number().over(named) - 1) % len(weights)
    df = sums.withColumn("_class", place).withColumn("weight", F.get(choice, F.col("_class")).cast("double"))
    full = max_copies * F.col("source_size")
    by_room = Window.orderBy(full / F.col("weight"), F.col("_source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    after = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_words = F.sum("source_size").over(Window.partitionBy())
    left = all_words - F.coalesce(F.sum(full).over(before), F.lit(0))
    level = left / F.sum("weight").over(after)
    df = df.withColumn("_level", level).withColumn("_rank", F.row_number().over(by_room))
    df = df.withColumn("_fits", F.col("weight") * F.col("_level") < max_copies * F.col("source_size"))
    # The first source that is not full fixes the level for it and all that follow.
    fixed = F.min(F.when(F.col("_fits"), F.struct("_rank", F.col("_level").alias("v"))))
    df = df.withColumn("_fixed", fixed.over(Window.partitionBy())["v"])
    share = F.col("weight") * F.coalesce(F.col("_fixed"), F.lit(float("inf")))
    target = F.least((max_copies * F.col("source_size")).cast("double"), share)
    return df.select("_source", "source_size", "weight", "_class", "_n", target.alias("target"))


def _offsets(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Words before each document in its source's order, in slices so that no source is one task.

    A source has one slice for every ``SLICE_DOCS`` documents, cut along the hash order.
    """
    df = sized.join(sources, sized["_source"].eqNullSafe(sources["_source"])).drop(sources["_source"])
    share = F.conv(F.substring("_order", 1, 8), 16, 10).cast("double") / float(1 << 32)
    slices = F.ceil(F.col("_n") / SLICE_DOCS)
    df = df.withColumn("_slice", F.floor(share * slices).cast("long"))
    per_slice = df.groupBy("_source", "_slice").agg(F.sum("size").alias("_slice_size"))
    running = Window.partitionBy("_source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_slice.select(
        F.col("_source").alias("_s"),
        F.col("_slice").alias("_k"),
        F.coalesce(F.sum("_slice_size").over(running), F.lit(0)).alias("_before"),
    )
    df = df.join(starts, df["_source"].eqNullSafe(starts["_s"]) & (df["_slice"] == starts["_k"])).drop("_s", "_k")
    inside = (
        Window.partitionBy("_source", "_slice")
        .orderBy("_order", "doc_id", "size", "_tie")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return df.withColumn("_offset", F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))


def _segments(schedules: tuple[tuple[float, ...], ...]) -> Column:
    """The linear pieces of the schedule of a row's class, their areas scaled to 1 in all."""
    choices = []
    for knots in schedules:
        step = 1.0 / (len(knots) - 1)
        areas = [step * (a + b) / 2 for a, b in zip(knots, knots[1:], strict=False)]
        total, low, pieces = sum(areas), 0.0, []
        for k, area in enumerate(areas):
            a, slope = knots[k] / total, (knots[k + 1] - knots[k]) / step / total
            values = {"low": low, "high": low + area / total, "start": k * step, "a": a, "slope": slope}
            pieces.append(F.struct(*[F.lit(float(v)).alias(n) for n, v in values.items()]))
            low += area / total
        choices.append(F.array(*pieces))
    return F.get(F.array(*choices), F.col("_class"))


def _times(copies: Column) -> Column:
    """When the cumulative demand reaches the first word of each copy.

    On a piece, demand grows as a t + slope t^2 / 2; the root is written so that it holds for slope 0.
    """

    def reached(copy: Column) -> Column:
        share = (F.col("_offset") + copy * F.col("source_size")) / F.col("target")
        piece = F.get(F.filter("_pieces", lambda p: share < p["high"]), F.lit(0))
        return F.struct(share.alias("x"), F.coalesce(piece, F.element_at("_pieces", -1)).alias("p"))

    def at(hit: Column) -> Column:
        p = hit["p"]
        need = F.greatest(hit["x"] - p["low"], F.lit(0.0))
        root = F.sqrt(F.greatest(p["a"] * p["a"] + 2 * p["slope"] * need, F.lit(0.0)))
        return p["start"] + F.when(need > 0, 2 * need / (p["a"] + root)).otherwise(0.0)

    return F.transform(F.transform(F.sequence(F.lit(0), copies - 1), reached), at)


def plan(
    docs: DataFrame,
    carry: tuple[str, ...] = (),
    weights: tuple[int, ...] = WEIGHTS,
    schedules: tuple[tuple[float, ...], ...] = SCHEDULES,
    max_copies: int = MAX_COPIES,
) -> DataFrame:
    """One row per document: size, its source's size and target, ``copies``, ``taken`` and ``positions``."""
    # Sizes and order are found once; every later step reads the columns it needs of this table.
    return _planned(written(_sized(docs, list(carry)), "sized"), carry, weights, schedules, max_copies)


def _planned(
    sized: DataFrame,
    carry: tuple[str, ...],
    weights: tuple[int, ...] = WEIGHTS,
    schedules: tuple[tuple[float, ...], ...] = SCHEDULES,
    max_copies: int = MAX_COPIES,
) -> DataFrame:
    df = _offsets(sized, targets(sized, weights, max_copies))
    copies = F.lit(0)
    for copy in range(max_copies):
        middle = F.col("_offset") + copy * F.col("source_size") + F.col("size") / 2
        copies = copies + F.when((F.col("size") > 0) & (middle <= F.col("target")), 1).otherwise(0)
    df = df.withColumn("copies", copies)
    df = df.withColumn("_pieces", _segments(schedules))
    times = F.when(F.col("copies") > 0, _times(F.col("copies"))).otherwise(F.array().cast("array<double>"))
    return df.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "copies",
        times.alias("positions"),
        *carry,
    )


def training_order(copies: DataFrame) -> DataFrame:
    """The copies (``doc_id``, ``_copy``, ``_at`` and others) with ``place``, their number in training order from 0.

    They are sorted by range of position and written; a range counts on from the rows of those before it.
    """
    numbered = copies.orderBy("_at", "doc_id", "_copy").withColumn("_n", F.monotonically_increasing_id())
    ordered = written(numbered, "ordered").withColumn("_range", F.shiftright("_n", 33))
    sizes = ordered.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_n").bitwiseAND((1 << 33) - 1)
    return ordered.join(starts, "_range").withColumn("place", place).drop("_n", "_range", "_start")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """One row per document: sizes, target, and what the training order has of it: words, first place and position."""
    rows = docs.select("doc_id", "source", "text").withColumn("_id", F.monotonically_increasing_id())
    planned = written(plan(rows, ("_id",), **options), "planned")
    copies = planned.select("_id", "doc_id", F.posexplode("positions").alias("_copy", "_at"))
    found = training_order(copies).groupBy("_id").agg(
        F.count("*").alias("_copies"), F.min("place").alias("first_place"), F.min_by("_at", "place").alias("first_position")
    )
    taken = F.coalesce("_copies", F.lit(0)) * F.col("size")
    kept = planned.select("_id", "doc_id", "size", "source_size", "target").join(found, "_id", "left")
    return kept.withColumn("taken", taken).drop("_id", "_copies")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The training order: every taken copy of a document as a row with exactly the columns of ``docs``.

    The plan is made of sizes alone; the rows, written once with a number each, then meet their
    positions by that number and are sorted by range of position.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = _sized(docs.select("doc_id", "source", "text", row), ["_row"])
    rows = written(rows.withColumn("_id", F.monotonically_increasing_id()), "sized")
    copies = _planned(rows.drop("_row"), ("_id",), **options).select("_id", F.posexplode("positions").alias("_copy", "_at"))
    placed = rows.select("_id", "_row").join(copies, "_id")
    return placed.orderBy("_at", "_row.doc_id", "_copy").select("_row.*")

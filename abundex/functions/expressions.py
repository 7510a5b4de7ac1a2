"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def padded_label(prefix: str, number: Column, width: int = 5) -> Column:
    """``prefix`` and the zero-padded number; numbers wider than ``width`` stay whole."""
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0")))


def days_between(end: Column, start: Column) -> Column:
    return F.datediff(end, start)


def truncated(value: Column, maximum: int) -> Column:
    """Values above ``maximum`` become it; NULL stays NULL."""
    return F.when(value > maximum, F.lit(maximum)).otherwise(value)


def quotient(part: Column, whole: Column) -> Column:
    """Floating division in which zero of zero is NaN, and anything else by zero infinite."""
    by_zero = F.when(part > 0, F.lit(float("inf"))).when(part < 0, F.lit(float("-inf"))).when(part == 0, F.lit(float("nan")))
    return F.when(whole == 0, by_zero).otherwise(part / whole)


def recoded(value: Column, labels: Mapping[str, str]) -> Column:
    """Replace the labels named in the mapping, keep the others."""
    if not labels:
        return value
    pairs = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.coalesce(F.try_element_at(pairs, value), value)


def matches(value: Column, pattern: str) -> Column:
    """Pattern match that is false, not NULL, on NULL."""
    return F.coalesce(value.rlike(pattern), F.lit(False))


def null_or_not_equal(value: Column, label: str) -> Column:
    return value.isNull() | (value != label)


def any_bit(flags: Mapping[int, Column]) -> Column:
    """Bit mask with bit ``i`` set where ``flags[i]`` holds."""
    bits = [
        F.when(flag, F.shiftleft(F.lit(1), bit)).otherwise(F.lit(0)) for bit, flag in flags.items()
    ]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def indexed(base: str, *index: str) -> Column:
    """Parameter name such as ``b[1,2]`` from index columns."""
    return F.concat(F.lit(f"{base}["), F.concat_ws(",", *(F.col(c) for c in index)), F.lit("]"))


def bisect(values: Column, passed: Callable[[Column], Column], longest: int) -> Column:
    """How many leading entries of a sorted array pass, for arrays up to ``longest``."""
    steps = F.array(*(F.lit(1 << bit) for bit in reversed(range(longest.bit_length()))))
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(passed(F.get(values, at + step - 1)), at + step).otherwise(at),
    )


def join_null_safe(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left"
) -> DataFrame:
    """Equi-join in which NULL matches NULL; the key columns of ``left`` are kept."""
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    condition = reduce(
        lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in on)
    )
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*(f"_right_{c}" for c in on))


def join_groups(
    rows: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join rows with a table of one row per group, where a group may hold most rows.

    Spark can split a hot key at run time only between two shuffles, and a grouped
    table needs none for its own keys. Comparing NULL-safe makes both sides shuffle
    (the grouped one is small), so the hot side is split.
    """
    return join_null_safe(rows, groups, keys, how)

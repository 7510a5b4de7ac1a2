"""Quality rules as a bitmask ledger.

Every rule is evaluated once for every document. The ledger keeps what was measured and one
bit per failed rule; a policy is a versioned mask of the rules that count. Policies and
ablations work on the bits alone and read no text again. Only built-in functions are used.

Defined results: a null or empty text has no words and fails ``few_words``; ids may be null
or repeated (rows are judged one by one); other columns are ignored by the ledger and kept
untouched by ``apply_policy``; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abundex.llm.common import SPACE, SPACE_CHARS, text_of

WINDOW = 3
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``failed`` is an SQL condition over the measurements, in whole numbers."""

    name: str
    failed: str


RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("few_lettered_words", "10 * n_lettered_words < 7 * n_words"),
    Rule("capitals", "10 * n_capitals > 4 * word_chars"),
)
BIT = {rule.name: bit for bit, rule in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    version: int
    name: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << BIT[name] for name in self.rules)


BASE = Policy(1, "base", ("few_words", "repeated_windows"))
STRICT = Policy(2, "all", tuple(rule.name for rule in RULES))
POLICIES = (BASE, STRICT)


def _size_without(text: Column, characters: str) -> Column:
    return F.char_length(F.translate(text, characters, ""))


def _repeat_words(windows: Column) -> Column:
    """Words that lie in a window found twice or more, from the windows in text order."""
    placed = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def starts(s: Column) -> Column:
        twice = F.transform(
            s,
            lambda x, j: F.when((F.get(s, j - 1)["w"] == x["w"]) | (F.get(s, j + 1)["w"] == x["w"]), x["i"]),
        )
        return F.sort_array(F.array_compact(twice))

    def covered(f: Column) -> Column:
        return F.aggregate(
            F.transform(f, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(f, j + 1) - x, F.lit(WINDOW)))),
            F.lit(0),
            lambda total, x: total + x,
        )

    return covered, starts, placed


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and all measurements of each row.

    The steps are projections of one pass; an array is put together once and read by the next.
    """
    text = F.col("_t")
    df = docs.select(*[F.col(c) for c in keep], text_of().alias("_t"))
    body = F.btrim(text, F.lit(SPACE_CHARS))
    df = df.select(
        *keep,
        F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACE + "+")).alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "").alias("_lines"),
        _size_without(text, SPACE_CHARS).cast("long").alias("word_chars"),
        (F.char_length(text) - _size_without(text, SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("\\p{Lu}")).cast("long").alias("n_capitals"),
    )
    words = F.col("_words")
    windows = F.when(
        F.size(words) >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - WINDOW),
            lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<string>"))
    measured = ["word_chars", "n_symbols", "n_capitals"]
    df = df.select(
        *keep,
        *measured,
        F.size(words).cast("long").alias("n_words"),
        F.size(F.filter(words, lambda w: w.rlike("\\p{L}"))).cast("long").alias("n_lettered_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("_windows"),
    )
    measured += ["n_words", "n_lettered_words", "n_lines", "n_dup_lines"]
    # Only texts in which some window comes twice are sorted.
    covered, starts, placed = _repeat_words(F.col("_windows"))
    none = F.array().cast("array<int>")
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = df.select(*keep, *measured, F.when(repeats, placed).alias("_placed"))
    df = df.select(*keep, *measured, F.when(F.col("_placed").isNull(), none).otherwise(starts(F.col("_placed"))).alias("_starts"))
    return df.select(*keep, *measured, covered(F.col("_starts")).cast("long").alias("n_repeat_words"))


def failures() -> Column:
    """One bit per rule that a row of measurements fails."""
    bits = [F.when(F.expr(rule.failed), F.lit(1 << BIT[rule.name])).otherwise(F.lit(0)) for rule in RULES]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return total.cast("long")


def passes(bits: Column, policy: Policy) -> Column:
    return bits.bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, all measurements and ``failures``, one row per document."""
    return measure(docs, ["doc_id"]).withColumn("failures", failures())


def verdicts(entries: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """The ledger with one column ``kept_v<version>`` per policy."""
    return entries.withColumns({f"kept_v{p.version}": passes(F.col("failures"), p) for p in policies})


def ablations(entries: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """What each rule does in each policy: rows that fail it, and rows that only it rejects.

    Rows are first counted by their bits (at most two to the number of rules groups), so the
    rest works on a table of bounded size.
    """
    by_bits = entries.groupBy("failures").agg(F.count("*").alias("n"))
    cases = F.array(
        *[
            F.struct(
                F.lit(p.version).alias("version"),
                F.lit(name).alias("rule"),
                F.lit(1 << BIT[name]).cast("long").alias("bit"),
                F.lit(p.mask).cast("long").alias("mask"),
            )
            for p in policies
            for name in p.rules
        ]
    )
    rows = by_bits.select("failures", "n", F.explode(cases).alias("c")).select("failures", "n", "c.*")
    hit = F.col("failures").bitwiseAND(F.col("bit")) != 0
    alone = F.col("failures").bitwiseAND(F.col("mask")) == F.col("bit")
    return rows.groupBy("version", "rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("only_this"),
        F.sum("n").alias("documents"),
    )


def apply_policy(docs: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """The rows of ``docs`` that pass, with exactly their columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    carried = docs.select(row, F.col("text"))
    judged = measure(carried, ["_row"]).select("_row", failures().alias("_failures"))
    # A filter would be pushed below the steps of ``measure`` with all of them copied into it.
    kept = F.when(passes(F.col("_failures"), policy), F.array("_row"))
    return judged.select(F.explode(kept).alias("_row")).select("_row.*")

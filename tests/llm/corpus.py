"""Small corpora with odd rows, and the plain way to do what the operators do."""

from __future__ import annotations

import hashlib
import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    """Sentences of made-up words."""
    rng = random.Random(seed)
    known = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(vocabulary)]
    out = []
    while len(out) < words:
        sentence = [rng.choice(known) for _ in range(rng.randint(4, 12))]
        out += [sentence[0].capitalize(), *sentence[1:-1], sentence[-1] + "."]
    return " ".join(out[:words])


ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n ", "en", "a", 4),
    (4, "word", "en", "b", 4),
    (4, "word", "en", "b", 4),
    (None, "no id at all", None, "b", 12),
    (None, None, "de", None, None),
    (5, "Grüße, 漢字 \U0001f600 <|endoftext|> é x", "de", "a", 30),
    (6, "x" * 50_000, "en", "a", 50_000),
    (7, "one two three " * 4_000, "fr", "a", 56_000),
    (8, "wo rd", "en", "b", 5),
]
# Names the operators use themselves, as extra columns.
CLASHES = ("size", "kept", "failures", "n_words", "key", "fp", "sha", "word", "block", "number", "taken", "_row", "_key", "_t")


def frame(spark, rows, clashes: bool = False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("extra") for c in CLASHES}) if clashes else df


def odd(spark):
    return frame(spark, ODD, clashes=True)


def empty(spark):
    return frame(spark, [], clashes=True)


def norm(text: str | None) -> str:
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()

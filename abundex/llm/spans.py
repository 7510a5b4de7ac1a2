"""Substring dedup over runs of consecutive sentences.

At every sentence of every document one span starts and one ends: the shortest run of consecutive
sentences that has at least two of them and 20 words, or 40 words. A span depends on its sentences
alone, so a passage that two documents share has the same spans in both, wherever it stands, and
spans cover all of it if it is long enough itself: where the span that starts at a sentence runs
out of the passage, the sentence lies in the span that ends with the passage. All spans are joined by a 128-bit hash; a sentence is removed if a
repeated span covers it that is not the span's first occurrence, the first being in the smallest
doc_id and there at the smallest position.

A span that a third of all documents share is counted by partial sums before the shuffle, and
the join that takes the answer back can be split at a hot hash.

Defined results: a null or empty text has no sentences and an empty result text; rows that share
an id count as one document, whose first occurrences stay in each row; null ids come last; a
text of one short sentence has no span; other columns do not matter; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundex.functions.expressions import join_groups
from abundex.llm.common import map_rows, text_of

SENTENCES = 2
WORDS = 20
LONG_SENTENCE = 40
LAST_ID = (1 << 63) - 1

_BREAK = re.compile(r"(?<=[.!?])\s+|\s*\n\s*|(?<=[。！？])\s*")


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence that has a word."""
    out, start = [], 0
    for found in _BREAK.finditer(text):
        out.append((start, found.start()))
        start = found.end()
    out.append((start, len(text)))
    return [(a, b) for a, b in out if a < b and not text[a:b].isspace()]


def spans(text: str, bounds: list[tuple[int, int]]) -> Iterator[tuple[int, int, bytes]]:
    """(first sentence, last sentence, digest) of the shortest spans from and to each sentence, in order."""
    import xxhash

    words = [text[a:b].split() for a, b in bounds]
    plain = [" ".join(w) for w in words]
    found: set[tuple[int, int]] = set()
    for step in (1, -1):
        for i in range(len(bounds)):
            j, n = i, len(words[i])
            while n < WORDS or (i == j and n < LONG_SENTENCE):
                j += step
                if not 0 <= j < len(bounds):
                    break
                n += len(words[j])
            else:
                found.add((min(i, j), max(i, j)))
    for i, j in sorted(found):
        run = "\n".join(plain[i : j + 1])
        yield i, j, xxhash.xxh3_128_digest(run.encode("utf-8", "surrogatepass"))


def span_rows(docs: DataFrame) -> DataFrame:
    """(h1, h2, doc, tag, at): every span's hash, document, hash of its text, and number."""
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), F.xxhash64(text_of()), text_of()
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, docs, tags, places = [], [], [], []

            def full() -> pa.RecordBatch:
                halves = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
                columns = [halves[:, 0].copy(), halves[:, 1].copy(), docs, tags, np.array(places, np.int32)]
                types = [pa.int64()] * 4 + [pa.int32()]
                return pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["h1", "h2", "doc", "tag", "at"]
                )

            for doc, tag, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for number, (_, _, digest) in enumerate(spans(text, sentences(text))):
                    digests.append(digest)
                    docs.append(doc)
                    tags.append(tag)
                    places.append(number)
                if len(digests) >= 65_536:
                    yield full()
                    digests, docs, tags, places = [], [], [], []
            if digests:
                yield full()

    return rows.mapInArrow(run, "h1 long, h2 long, doc long, tag long, at int")


def repeated(docs: DataFrame) -> DataFrame:
    """(doc, tag, at, first): spans that occur twice or more, with the document of the first one."""
    rows = span_rows(docs)
    firsts = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc").alias("first"))
    return join_groups(rows, firsts.filter("n > 1").select("h1", "h2", "first"), ["h1", "h2"]).select(
        "doc", "tag", "at", "first"
    )


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_removed, removed (character ranges of the text) and the text that is left."""
    hits = repeated(docs).distinct().groupBy("doc", "tag").agg(
        F.collect_list(F.struct("at", "first")).alias("hits")
    )
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_of().alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"),
        F.xxhash64(text_of()).alias("tag"),
    )
    found = rows.join(hits, ["doc", "tag"], "left").select("doc_id", "doc", "text", "hits")

    def make():
        def clean(doc_id, doc, text, hits):
            bounds = sentences(text)
            covered = [False] * len(bounds)
            first = {hit["at"]: hit["first"] for hit in hits or ()}
            seen: set[bytes] = set()
            for number, (i, j, digest) in enumerate(spans(text, bounds) if hits else ()):
                if number in first:
                    if first[number] != doc or digest in seen:
                        covered[i : j + 1] = [True] * (j - i + 1)
                    seen.add(digest)
            removed = merged(bounds, covered)
            kept, at = [], 0
            for a, b in removed:
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            ranges = [{"start": a, "end": b} for a, b in removed]
            return [(doc_id, len(bounds), sum(covered), ranges, "".join(kept))]

        return clean

    return map_rows(
        found,
        make,
        "doc_id long, n_sentences int, n_removed int, removed array<struct<start:int,end:int>>, text string",
        batch_rows=512,
    )


def merged(bounds: list[tuple[int, int]], covered: list[bool]) -> list[tuple[int, int]]:
    """Character ranges of runs of covered sentences, up to where the next kept sentence begins."""
    out: list[list[int]] = []
    for k, (a, b) in enumerate(bounds):
        if covered[k]:
            end = bounds[k + 1][0] if k + 1 < len(bounds) else b
            if out and out[-1][1] == a:
                out[-1][1] = end
            else:
                out.append([a, end])
    return [(a, b) for a, b in out]

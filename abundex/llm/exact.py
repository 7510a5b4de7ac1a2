"""Exact duplicates by an extendible-hash index on shared files.

The key of a text is a 64-bit hash of its normalised form. The directory has 2^g slots over
the leading bits of the key; while a bucket holds more bytes than it may, the directory doubles
and the bucket splits, so buckets end at different depths and slots share the shallow ones.
Owner tasks get whole buckets in key order. They chain texts of equal key, compare their bytes,
and write one index entry per different text. Documents then look their entry up.

Equal texts are combined before the shuffle in buffers of bounded size, so a group of any size
reaches its owner as a few rows. Equal keys cannot be split further; they form one chain.

Defined results: a null text counts as empty; empty texts equal each other; the longest original
text stays, then the smallest doc_id, a null id last; repeated rows (same id and text) all carry
the id that stays; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abundex.functions.expressions import join_groups
from abundex.llm.common import SPACE, as_batch, text_of, written

BUCKET_BYTES = 64 << 20
BUFFER_BYTES = 32 << 20
MAX_DEPTH = 48

_ENTRY = "key long, sha string, norm string, n long, n_chars long, doc_id long"


def _keyed(docs: DataFrame) -> DataFrame:
    norm = F.regexp_replace(text_of(), SPACE + "+", "")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        norm.alias("norm"),
        F.char_length(text_of()).cast("long").alias("n_chars"),
    ).select("doc_id", "n_chars", "norm", F.xxhash64("norm").alias("key"), F.sha2("norm", 256).alias("sha"))


def _better(a: tuple, b: tuple) -> bool:
    """Whether (n_chars, doc_id) ``a`` stays before ``b``."""
    if a[0] != b[0]:
        return a[0] > b[0]
    if a[1] is None or b[1] is None:
        return b[1] is None and a[1] is not None
    return a[1] < b[1]


class _Chains:
    """Texts of one bucket: key -> entries that differ in their bytes."""

    def __init__(self) -> None:
        self.chains: dict[int, list[list]] = {}
        self.bytes = 0

    def add(self, key: int, sha: str, norm: str, n: int, n_chars: int, doc_id: int | None) -> None:
        chain = self.chains.setdefault(key, [])
        for entry in chain:
            if entry[1] == norm:
                entry[2] += n
                if _better((n_chars, doc_id), (entry[3], entry[4])):
                    entry[3], entry[4] = n_chars, doc_id
                return
        chain.append([sha, norm, n, n_chars, doc_id])
        self.bytes += 2 * len(norm) + 200

    def drain(self) -> Iterator[tuple]:
        for key, chain in self.chains.items():
            for entry in chain:
                yield (key, *entry)
        self.chains, self.bytes = {}, 0


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) >= size:
            yield as_batch(out, schema)
            out = []
    if out:
        yield as_batch(out, schema)


_ENTRY_ARROW = pa.schema(
    [("key", pa.int64()), ("sha", pa.string()), ("norm", pa.string()), ("n", pa.int64()), ("n_chars", pa.int64()), ("doc_id", pa.int64())]
)


def combine(keyed: DataFrame, buffer_bytes: int = BUFFER_BYTES) -> DataFrame:
    """One entry per different text of a buffer of rows, before any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains = _Chains()
        for batch in batches:
            for key, sha, norm, n_chars, doc_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                chains.add(key, sha, norm, 1, n_chars, doc_id)
                if chains.bytes > buffer_bytes:
                    yield from _batches(chains.drain(), _ENTRY_ARROW)
        yield from _batches(chains.drain(), _ENTRY_ARROW)

    return keyed.select("key", "sha", "norm", "n_chars", "doc_id").mapInArrow(run, _ENTRY)


def directory(sizes: DataFrame, bucket_bytes: int = BUCKET_BYTES, max_depth: int = MAX_DEPTH) -> list[int]:
    """The first key of each bucket, in unsigned key order, found by doubling.

    ``sizes`` has (key, bytes). A round counts the bytes of all overfull buckets one bit deeper;
    it sends one row per bucket to the driver, as many as the data has multiples of a bucket.
    """
    spark = sizes.sparkSession
    total = sizes.agg(F.sum("bytes").alias("bytes")).first()["bytes"]
    if not total or total <= bucket_bytes:
        return [0]
    # As many slots as the data fills buckets, then doubling where a bucket is overfull.
    depth = max(1, int(math.log2(total / bucket_bytes)))
    counted = sizes
    starts: list[int] = []
    while True:
        slot = F.shiftrightunsigned("key", 64 - depth).alias("slot")
        per_slot = counted.groupBy(slot).agg(F.sum("bytes").alias("bytes"), F.max("bytes").alias("most"))
        rows = per_slot.collect()
        overfull = [r["slot"] for r in rows if r["bytes"] > bucket_bytes and r["bytes"] > r["most"]]
        if depth == max_depth:
            overfull = []
        split = set(overfull)
        starts += [r["slot"] << (64 - depth) for r in rows if r["slot"] not in split]
        if not overfull:
            return sorted({0, *starts})
        wanted = spark.createDataFrame([(s,) for s in overfull], "wanted long")
        counted = counted.join(
            wanted, F.shiftrightunsigned("key", 64 - depth) == F.col("wanted"), "left_semi"
        )
        depth += 1


def build_index(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The index as a table in the shared folder: bucket, key, chain, sha, norm, group_size, keep_id."""
    import numpy as np

    keyed = _keyed(docs)
    per_key = keyed.groupBy("key").agg(F.max(F.octet_length("norm") + 200).cast("long").alias("bytes"))
    starts = np.array(directory(written(per_key, "keys"), bucket_bytes), dtype=np.uint64)
    buckets = len(starts)
    spec = "bucket int, chain int, " + _ENTRY
    arrow = pa.schema([("bucket", pa.int32()), ("chain", pa.int32()), *_ENTRY_ARROW])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at = (np.searchsorted(starts, keys, side="right") - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array(np.zeros(len(at), np.int32)), *batch.columns], schema=arrow
            )

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains, current = _Chains(), None

        def flush(bucket: int) -> Iterator[tuple]:
            last, chain = None, 0
            for key, *entry in chains.drain():
                chain = chain + 1 if key == last else 0
                last = key
                yield (bucket, chain, key, *entry)

        for batch in batches:
            for bucket, _, *entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != current:
                    if current is not None:
                        yield from _batches(flush(current), arrow)
                    current = bucket
                chains.add(*entry)
        if current is not None:
            yield from _batches(flush(current), arrow)

    owners = combine(keyed).mapInArrow(placed, spec).repartition(buckets, "bucket").sortWithinPartitions("bucket", "key")
    return written(
        owners.mapInArrow(own, spec).withColumnsRenamed({"n": "group_size", "doc_id": "keep_id"}), "exact-index"
    )


def exact_groups(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per document.

    A document finds its entry by key and digest. ``kept`` holds for the row whose id and length
    stay; of repeated rows that are alike in both, for all of them.
    """
    index = build_index(docs, bucket_bytes).select(
        "key", "sha", "group_size", "keep_id", F.col("n_chars").alias("_most")
    )
    rows = _keyed(docs).select("doc_id", "n_chars", "key", "sha")
    found = join_groups(rows, index, ["key", "sha"])
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("_most"))
    return found.select("doc_id", "keep_id", "group_size", stays.alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row of each group of equal texts, with exactly the columns of ``docs``.

    The rows that stay are found by id, length and digest; a repeated row stays once.
    """
    kept = exact_groups(docs, bucket_bytes).filter("kept")
    return keep_rows(docs, kept.select(row_key("doc_id", F.col("text_sha256")).alias("_kept")).distinct())


def row_key(doc_id: str, digest: Column) -> Column:
    """A row's id and content as one string that is never null."""
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("null")), digest)


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``row_key`` is in ``kept``, with exactly their columns.

    Repeated rows are combined before the shuffle, and the texts are shuffled once.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    digest = F.sha2(F.regexp_replace(text_of(), SPACE + "+", ""), 256)
    carried = docs.select(row, row_key("doc_id", digest).alias("_key"), F.char_length(text_of()).alias("_n"))
    once = carried.groupBy("_key").agg(F.max_by("_row", "_n").alias("_row"))
    return once.join(kept, once["_key"] == kept["_kept"], "left_semi").select("_row.*")

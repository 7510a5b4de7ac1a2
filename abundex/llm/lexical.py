"""Ranked lexical search: the best documents for every item, scored once per class of equal bags.

Only terms of items can score, so a document is read once and kept as its bag: the frequencies of
the items' terms in it, and its length, which enters the score as a whole number m of a hundred steps
or so around 50. Documents with one bag and one m score alike for every item. They meet in a grouping by
a hash of the bag that compares the bags themselves, and only the first k ids of a class go on, a
limit that Spark also applies before the shuffle, so a bag that a third of the documents share sends
k rows a task. Each class is scored once against all items; its members come back in the order of
their ids. A task keeps the k best of each item it has seen, and these meet in a last ranking.

The items are the stated query set. Their terms are counted first and cut into blocks of a fixed number
of entries; a block's terms, weights and items are what is broadcast, and documents are read once
a block. The driver sees the terms of a block and their document frequencies, and two totals.

Defined results: a null or empty text has no terms, it counts neither in N nor in L; documents without
a term of an item, and scores of 0, give no row; rows of one item id are one item with the terms of
all; a null item id is an item; null document ids come after all others; repeated rows rank each;
items without terms and empty tables give no rows; other columns do not matter; texts are read whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abundex.llm.common import map_rows, text_of, written

# (item, term) entries of a block of items, and cells of a block of scores.
ENTRIES = 200_000
CELLS = 1 << 22
# Candidates a task holds before it drops all but the best of each item.
HELD = 1 << 20

# Term bytes: ASCII letters (made lower case) and digits, and all bytes of other characters.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term) of ``items`` (item_id, text)."""
    rows = items.select(F.col("item_id").cast("long"), text_of())

    def make():
        return lambda item, text: [(item, term) for term in set(terms(text))]

    return map_rows(rows, make, "item_id long, term binary").distinct()


def bags(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (terms), and ``bag``: pairs of a term's place in ``vocabulary`` and its frequency, packed."""
    held = docs.sparkSession.sparkContext.broadcast({term: i + 1 for i, term in enumerate(vocabulary)})
    rows = docs.select(F.col("doc_id").cast("long"), text_of())

    def make():
        import xxhash

        place = held.value.get

        def bag(doc_id, text):
            words = terms(text)
            counts = Counter(filter(None, map(place, words)))
            pairs = np.array(sorted(counts.items()), dtype=np.int64).reshape(-1, 2) - [1, 0]
            packed = pairs.astype("<u4").tobytes()
            return [(doc_id, len(words), np.uint64(xxhash.xxh3_64_intdigest(packed)).view(np.int64).item(), packed)]

        return bag

    return map_rows(rows, make, "doc_id long, n long, hash long, bag binary")


def _unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, frequency) of every entry of packed bags."""
    packed = column.to_pylist()
    pairs = np.frombuffer(b"".join(packed), dtype="<u4").reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(packed)), [len(p) // 8 for p in packed]), pairs[:, 0], pairs[:, 1]


def document_frequencies(found: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary, added up in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_unpack(batch.column(0))[1], minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["term", "df"])

    counted = found.select("bag").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(size, np.int64)
    out[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
    return out


def classes(found: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(m, bag, members): one row per bag and m, with the first ``k`` ids that have it, nulls last."""
    # The product may pass 64 bits where the quotient does not.
    m = F.expr(f"50 + (cast(n AS decimal(19, 0)) * cast({50 * n_docs} AS decimal(18, 0)) div cast({n_terms} AS decimal(19, 0)))")
    rows = found.filter("octet_length(bag) > 0").withColumn("m", m)
    first = Window.partitionBy("hash", "m", "bag").orderBy(F.col("doc_id").asc_nulls_last())
    rows = rows.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k)
    members = F.array_sort(F.collect_list(F.struct("place", "doc_id")))
    return rows.groupBy("hash", "m", "bag").agg(members["doc_id"].alias("members")).select("m", "bag", "members")


def _best(rows: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` first rows (item, score, no id, id) of each item: highest score, then smallest id."""
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
    starts = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
    place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(rows)]])))
    return rows[place < k]


def ranked(bagged: DataFrame, weights: np.ndarray, wanted: list[np.ndarray], ids: list[int | None], k: int) -> DataFrame:
    """(item_id, doc_id, score): at least the ``k`` best documents of each item, some of them from every task.

    ``wanted`` has the items' terms, ``ids`` the items' ids.
    """
    pairs = np.concatenate([np.column_stack([w, np.full(len(w), i)]) for i, w in enumerate(wanted)])
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    bounds = np.searchsorted(pairs[:, 0], np.arange(len(weights) + 1))
    held = bagged.sparkSession.sparkContext.broadcast((weights, pairs[:, 1], bounds, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, items, bounds, ids = held.value
        least = np.ones(len(ids), np.int64)  # what a score must reach to be among an item's best so far
        best, waiting, n_waiting = np.empty((0, 4), np.int64), [], 0

        def settle() -> None:
            nonlocal best, waiting, n_waiting
            best = _best(np.concatenate([best, *waiting]), k)
            waiting, n_waiting = [], 0
            counts = np.bincount(best[:, 0], minlength=len(ids))
            last = np.cumsum(counts)[counts >= k] - 1
            least[counts >= k] = best[last, 1]

        step = max(1, CELLS // len(ids))
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            m = batch.column(0).to_numpy()
            members = batch.column(2)
            sizes = members.value_lengths().to_numpy()
            starts = np.cumsum(sizes) - sizes
            flat = members.flatten()
            no_id, doc_ids = flat.is_null().to_numpy(zero_copy_only=False).astype(np.int64), flat.fill_null(0).to_numpy()
            row, term, tf = _unpack(batch.column(1))
            part = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[row]))
            order = np.argsort(term, kind="stable")
            row, term, part = row[order], term[order], part[order]
            cuts = [0, *(np.flatnonzero(term[1:] != term[:-1]) + 1).tolist(), len(term)]
            scores = np.zeros((batch.num_rows, len(ids)), np.int64)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                mine = items[bounds[term[a]] : bounds[term[a] + 1]]
                scores[np.ix_(row[a:b], mine)] += part[a:b, None]
            hit, item = np.nonzero(scores >= least)
            each = sizes[hit]
            at = np.repeat(starts[hit] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            item, score = np.repeat(item, each), np.repeat(scores[hit, item], each)
            waiting.append(np.column_stack([item, score, no_id[at], doc_ids[at]]))
            n_waiting += len(item)
            if n_waiting > HELD:
                settle()
        settle()
        known = pa.array(ids, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                known.take(pa.array(best[:, 0])),
                pa.array(best[:, 3], pa.int64(), mask=best[:, 2] == 1),
                pa.array(best[:, 1].copy()),
            ],
            names=["item_id", "doc_id", "score"],
        )

    return bagged.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, entries: int = ENTRIES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text)."""
    asked = written(item_terms(items), "item-terms")
    blocks = max(1, -(-asked.count() // entries))
    found = None
    for block in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        rows = _search_block(docs, mine, k)
        if rows is not None:
            found = rows if found is None else found.union(rows)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "item_id", "rank", "doc_id", "score"
    )


def _search_block(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame | None:
    by_item: dict[int | None, list[bytes]] = {}
    for item, term in zip(*(c.to_pylist() for c in asked.toArrow().columns), strict=True):
        by_item.setdefault(item, []).append(term)
    vocabulary = sorted({t for found in by_item.values() for t in found})
    if not vocabulary:
        return None
    place = {term: i for i, term in enumerate(vocabulary)}
    found = written(bags(docs, vocabulary), "bags")
    n_docs, n_terms = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return None
    df = document_frequencies(found, len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
    ids = sorted(by_item, key=lambda i: (i is None, i))
    wanted = [np.array(sorted(place[t] for t in by_item[i]), dtype=np.int64) for i in ids]
    return ranked(classes(found, n_docs, n_terms, k), weights, wanted, ids, k)

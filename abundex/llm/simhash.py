"""Near copies by SimHash fingerprints and an inverted index over byte positions.

A fingerprint has eight bytes. Two that differ in at most three bits agree in at least five
byte positions, so every true pair meets in some list of the index whose key is the value of
four positions, for a family of position sets of which every five positions contain one. In a
list the bytes shared by a pair are tallied, pairs below the guaranteed five are left out, and
the rest are verified bit by bit.

The index holds each different fingerprint once, so exact copies add nothing to it. A list
that is still long is not paired off: any two members within the limit agree in one of four
parts of the bits that vary in the list, so it is cut by each part in turn until the pieces are
short. Only enough links to connect a piece leave the task. A list too long for one task is cut
the same way before it is held, and its parts go through a further shuffle. The pipeline's near-copy
stage keeps one document of each component of fingerprints.

``similar_groups`` compares sets of five-word shingles by Jaccard similarity instead, 0.8
or more, and finds all such pairs: two such sets share a member among the first fifth (and one) of
each in any common order of shingles. The order puts those last that are frequent in a sample, which
changes the cost and not the result. Every candidate is verified on the sets. A long list is first
compared with one member after another, members connected to it leave, and what is still in
different components is compared pair by pair, in strips that are dealt out to many tasks.

Defined results: a null or empty text has fingerprint zero and is linked like any other; repeated
rows share a fingerprint; null ids count last as smallest id; an empty table gives an empty
result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abundex.functions.expressions import join_groups
from abundex.llm.common import SPACE, map_rows, text_of, written
from abundex.llm.components import components
from abundex.llm.exact import keep_rows, row_key

BYTES = 8
MAX_BITS = 3
SHARED = BYTES - MAX_BITS
SHORT_LIST = 256
LONG_LIST = 1 << 18
SEED = 42


def position_sets() -> list[tuple[int, ...]]:
    """Sets of four positions such that any five positions contain one of them.

    Five positions have four or more in one half, or three and two: then the three contain one
    of the two fixed pairs of their half.
    """
    halves = ((0, 1, 2, 3), (4, 5, 6, 7))
    fixed = [((a, b), (c, d)) for a, b, c, d in halves]
    sets = {halves[0], halves[1]}
    for mine, other in ((0, 1), (1, 0)):
        for pair in fixed[mine]:
            sets |= {tuple(sorted(pair + rest)) for rest in combinations(halves[other], 2)}
    return sorted(sets)


def fingerprint(text: str | None, shingle: int) -> int:
    """The SimHash of a text's word shingles as a signed 64-bit number."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    hashed, last = xxhash.xxh64_intdigest, len(words) - min(shingle, len(words))
    spans = zip(starts, ends[len(words) - last - 1 :], strict=False)
    votes = np.zeros(64, dtype=np.int64)
    count, part = 0, []
    for start, end in spans:
        part.append(hashed(joined[start : end - 1], SEED))
        if len(part) == 65_536:
            votes += _votes(part)
            count, part = count + len(part), []
    if part:
        votes += _votes(part)
        count += len(part)
    return int(np.packbits((2 * votes > count).astype(np.uint8), bitorder="little").view(np.int64)[0])


def _votes(hashes: list[int]) -> np.ndarray:
    rows = np.array(hashes, dtype=np.uint64).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (signed) and ``digest`` of the text without white space."""
    digest = F.sha2(F.regexp_replace(text_of(), SPACE + "+", ""), 256)
    rows = docs.select(F.col("doc_id").cast("long"), digest, "text")

    def make():
        return lambda doc_id, digest, text: [(doc_id, digest, fingerprint(text, shingle))]

    return map_rows(rows, make, "doc_id long, digest string, fp long")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _roots(near: np.ndarray) -> np.ndarray:
    """The least member reachable from each, from a symmetric matrix of links."""
    labels = np.arange(len(near))
    while True:
        least = np.where(near, labels[None, :], len(near)).min(axis=1)
        least = least[least]
        if (least == labels).all():
            return labels
        labels = least


def connect(fps: np.ndarray, max_bits: int = MAX_BITS, short: int = SHORT_LIST) -> list[tuple[int, int]]:
    """Links that connect all members of a list within ``max_bits`` of each other, not every pair."""
    out: list[tuple[int, int]] = []
    todo = [fps]
    while todo:
        part = todo.pop()
        if len(part) < 2:
            continue
        varying = int(np.bitwise_or.reduce(part ^ part[0]))
        bits = [b for b in range(64) if varying >> b & 1]
        if len(bits) <= max_bits:
            out += [(int(x), int(part[0])) for x in part[1:]]
        elif len(part) <= short:
            differ = part[:, None] ^ part[None, :]
            tally = (differ.view(np.uint8).reshape(len(part), len(part), BYTES) == 0).sum(axis=2)
            near = (tally >= BYTES - max_bits) & (np.bitwise_count(differ) <= max_bits)
            roots = _roots(near)
            out += [(int(part[i]), int(part[r])) for i, r in enumerate(roots) if i != r]
        else:
            for cut in range(max_bits + 1):
                mask = np.uint64(sum(1 << b for b in bits[cut :: max_bits + 1]))
                order = np.argsort(part & mask, kind="stable")
                values = (part & mask)[order]
                edges = np.flatnonzero(values[1:] != values[:-1]) + 1
                todo += [piece for piece in np.split(part[order], edges) if len(piece) > 1]
    return out


def _mixed(values: np.ndarray) -> np.ndarray:
    """Well spread 64-bit numbers."""
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            values = (values ^ values >> np.uint64(shift)) * np.uint64(factor)
    return values ^ values >> np.uint64(31)


def _shorter(key: int, free: int, fps: np.ndarray, max_bits: int) -> pa.RecordBatch:
    """Members of a list as rows of lists with further bits in the key: two near ones meet in one of them."""
    bits = [b for b in range(64) if free >> b & 1]
    keys, rest = [], []
    for cut in range(max_bits + 1):
        mask = sum(1 << b for b in bits[cut :: max_bits + 1])
        start = _mixed(np.array([(key + cut) % 2**64], np.uint64))
        keys.append(_mixed((fps & np.uint64(mask)) ^ start).view(np.int64))
        rest.append(np.full(len(fps), free & ~mask, np.uint64).view(np.int64))
    columns = [np.concatenate(keys), np.concatenate(rest), np.tile(fps.view(np.int64), max_bits + 1)]
    columns = [*map(pa.array, columns), pa.nulls(len(columns[0]), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["key", "free", "u", "v"])


def _linked(batches: Iterator[pa.RecordBatch], longest: int = LONG_LIST) -> Iterator[pa.RecordBatch]:
    """Links of lists from rows (key, free, fp) in key order, with a null key.

    Of a list no more than ``longest`` members and a batch are held; the members of a longer one
    leave as rows of shorter lists.
    """
    held: list[np.ndarray] = []
    now, free, size, long = None, 0, 0, False

    def batch_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
        pairs = np.array(sorted(set(links)), dtype=np.uint64).reshape(-1, 2).view(np.int64)
        columns = [pa.nulls(len(pairs), pa.int64())] * 2 + [pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())]
        return pa.RecordBatch.from_arrays(columns, names=["key", "free", "u", "v"])

    for batch in batches:
        keys, rests = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        fps = batch.column(2).to_numpy().view(np.uint64)
        bounds = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]).tolist()
        links: list[tuple[int, int]] = []
        for start, end in zip(bounds[:-1], bounds[1:], strict=True):
            if start == end:
                continue
            if keys[start] != now:
                if size > 1 and not long:
                    links += connect(np.concatenate(held))
                now, free, held, size, long = keys[start], int(rests.view(np.uint64)[start]), [], 0, False
            held.append(fps[start:end])
            size += end - start
            if size > longest and free.bit_count() > MAX_BITS:
                long = True
            if long:
                yield _shorter(int(now), free, np.concatenate(held), MAX_BITS)
                held = []
        yield batch_of(links)
    yield batch_of(connect(np.concatenate(held)) if size > 1 and not long else [])


def links(nodes: DataFrame, longest: int = LONG_LIST) -> DataFrame:
    """Links (u, v) that connect all different fingerprints ``fp`` within three bits of each other.

    A list with more than ``longest`` members is cut by a further shuffle, by a quarter of the bits
    its key leaves free at a time. With 18 bits free no list is longer than the default.
    """
    fp = F.col("fp")
    lists = []
    for number, positions in enumerate(position_sets()):
        key = F.lit(number).cast("long")
        for p in positions:
            byte = F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255).cast("long"))
            key = F.shiftleft(key, 8).bitwiseOR(byte)
        free = sum(255 << 8 * p for p in range(BYTES) if p not in positions)
        lists.append(F.struct(key.alias("key"), F.lit(int(np.uint64(free).view(np.int64))).cast("long").alias("free")))
    rows = nodes.select(F.explode(F.array(*lists)).alias("at"), "fp").select("at.*", "fp")
    found = None
    while True:
        dealt = rows.repartition("key").sortWithinPartitions("key")
        out = dealt.mapInArrow(lambda batches: _linked(batches, longest), "key long, free long, u long, v long")
        out = written(out, "byte-lists")
        linked = out.filter("key IS NULL").select("u", "v")
        found = linked if found is None else found.union(linked)
        rows = out.filter("key IS NOT NULL").select("key", "free", F.col("u").alias("fp"))
        if rows.isEmpty():
            return found


def near_groups(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, digest, fp and component_id: the smallest id reachable over links, its own included."""
    fps = written(fingerprints(docs, shingle), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    return _named(fps, nodes, "fp", components(links(nodes)))


def _named(fps: DataFrame, nodes: DataFrame, id_: str, roots: DataFrame) -> DataFrame:
    """``fps`` with the smallest document id of the component of each row's fingerprint."""
    nodes = nodes.join(roots, nodes[id_] == roots["node"], "left").select(
        id_, "first", F.coalesce("root", id_).alias("root")
    )
    least = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = join_groups(nodes, least, ["root"]).select(id_, "component_id")
    return join_groups(fps, named, [id_])


SLOTS = 1 << 22
ORDER_DOCS = 20_000
COMMON = 8
LIST = 128
STRIP = 1_024
ROUNDS = 4


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Hashes of a text's different word shingles, in order."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, width = b" ".join(words), min(shingle, len(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    hashed, starts = xxhash.xxh64_intdigest, [0, *ends[:-1]]
    found = {hashed(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :], strict=False)}
    return np.sort(np.fromiter(found, dtype=np.uint64, count=len(found)))


def similar(a: bytes, b: bytes) -> bool:
    """Whether two sets of hashes have a Jaccard similarity of 0.8 or more."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * common >= 4 * (len(x) + len(y) - common)


def _slots_of(rows: DataFrame, slots: Callable[[pa.RecordBatch], np.ndarray], least: int) -> np.ndarray:
    """How often each of ``SLOTS`` slots occurs, 0 below ``least``; its size does not depend on the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = np.unique(slots(batch), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(n)], names=["slot", "n"])

    total = rows.mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    counted = total.filter(F.col("n") >= least).toArrow()
    out = np.zeros(SLOTS, np.int32)
    out[counted.column("slot").to_numpy()] = np.minimum(counted.column("n").to_numpy(), (1 << 31) - 1)
    return out


def _top(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def _common(sets: DataFrame) -> np.ndarray:
    """Slots of shingles that many of a bounded number of sets have; only the order of shingles depends on it."""
    share = min(1.0, ORDER_DOCS / max(sets.count(), 1))
    chosen = sets.filter(F.pmod("id", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("hashes")
    return _slots_of(chosen, lambda b: _top(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64)), COMMON)


def _fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can have a similarity of 0.8."""
    return 5 * np.minimum(a, b) >= 4 * np.maximum(a, b)


def _pairs(rows: np.ndarray, later: np.ndarray, triangle: bool) -> np.ndarray:
    """(u, v) with u < v of rows (id, size, root) that fit and are not connected yet."""
    near = _fits(rows[:, 1][:, None], later[:, 1][None, :]) & (rows[:, 2][:, None] != later[:, 2][None, :])
    i, j = np.nonzero(np.triu(near, 1) if triangle else near)
    a, b = rows[i, 0], later[j, 0]
    return np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)


def prefix_lists(sets: DataFrame, longest: int = LIST) -> DataFrame:
    """(key, at, u, v): pairs of lists of up to ``longest`` with a null key, and members of longer lists.

    A member has its place as ``at``, its id as ``u`` and its size as ``v``. Of a list no more than
    ``longest`` members are held.
    """
    held = sets.sparkSession.sparkContext.broadcast(_common(sets))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = held.value
        for batch in batches:
            keys, ids, sizes = [], [], []
            for id_, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes = np.frombuffer(data, np.uint64)
                if len(hashes):
                    order = np.argsort(count[_top(hashes)], kind="stable")[: len(hashes) // 5 + 1]
                    keys.append(hashes[order].view(np.int64))
                    ids.append(np.full(len(order), id_, np.int64))
                    sizes.append(np.full(len(order), len(hashes), np.int64))
            if keys:
                columns = [pa.array(np.concatenate(c)) for c in (keys, ids, sizes)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "size"])

    def batch_of(rows: np.ndarray, pairs: bool) -> pa.RecordBatch:
        columns = [pa.array(c) for c in np.ascontiguousarray(rows.T)]
        if pairs:
            columns = [pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64()), *columns]
        return pa.RecordBatch.from_arrays(columns, names=["key", "at", "u", "v"])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, sent = np.empty((0, 3), np.int64), 0  # the list that may go on; how many of it have left

        def members(rows: np.ndarray, at: int) -> pa.RecordBatch:
            return batch_of(np.column_stack([rows[:, 0], at + np.arange(len(rows)), rows[:, 1], rows[:, 2]]), False)

        for batch in _and_end(batches):
            if batch is None:
                rows, open_ = rest, len(rest)
            else:
                fresh = np.column_stack([c.to_numpy() for c in batch.columns])
                rows = np.concatenate([rest, fresh])
                again = np.zeros(len(rows), bool)
                again[1:] = (rows[1:, :2] == rows[:-1, :2]).all(axis=1)  # sets that several rows have
                rows = rows[~again]
                open_ = int(np.searchsorted(rows[:, 0], rows[-1, 0])) if len(rows) else 0
            bounds = np.concatenate([[0], np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1, [len(rows)]])
            out: list[np.ndarray] = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                last = a == open_ and batch is not None
                if b - a + sent > longest:
                    # the newest member stays, so that the next batch can see whether it repeats
                    end = b - 1 if last else b
                    yield members(rows[a:end], sent)
                    sent = sent + end - a if last else 0
                    if last:
                        open_ = end
                elif not last:
                    if b - a > 1:
                        part = np.column_stack([rows[a:b, 1], rows[a:b, 2], rows[a:b, 1]])
                        out.append(_pairs(part, part, True))
                    sent = 0
            rest = rows[open_:]
            if out:
                yield batch_of(np.unique(np.concatenate(out), axis=0), True)

    index = sets.select("id", "hashes").mapInArrow(prefixes, "key long, id long, size long")
    sorted_ = index.repartition("key").sortWithinPartitions("key", "size", "id")
    return sorted_.mapInArrow(lists, "key long, at long, u long, v long")


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough, as a table."""
    pairs = written(pairs.distinct(), "near-pairs")

    def slots(batch: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([c.to_numpy() for c in batch.columns]) & (SLOTS - 1)

    held = sets.sparkSession.sparkContext.broadcast(_slots_of(pairs, slots, 1) > 0)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(held.value[batch.column(0).to_numpy() & (SLOTS - 1)]))

    found = sets.select("id", "hashes").mapInArrow(wanted, "id long, hashes binary").dropDuplicates(["id"])
    found = written(found, "near-sets")
    both = join_groups(pairs, found.select(F.col("id").alias("u"), F.col("hashes").alias("a")), ["u"])
    both = join_groups(both, found.select(F.col("id").alias("v"), F.col("hashes").alias("b")), ["v"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(a, b) for a, b in zip(*(batch.column(n).to_pylist() for n in (2, 3)), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return written(both.select("u", "v", "a", "b").mapInArrow(check, "u long, v long"), "near-links")


def open_members(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (key, at, id, size, root) of the lists that lie in two components or more."""
    named = join_groups(members, roots.select(F.col("node").alias("id"), "root"), ["id"], "left")
    named = written(named.withColumn("root", F.coalesce("root", "id")), "near-members")
    parts = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    return join_groups(named, parts.filter("low < high").select("key"), ["key"])


def leader_pairs(members: DataFrame, round_: int) -> DataFrame:
    """Pairs (u, v) of one member of each list with those that are not connected to it."""
    chosen = F.min_by(F.struct("id", "size", "root"), F.struct(F.xxhash64("id", F.lit(round_)), "id"))
    led = join_groups(members, members.groupBy("key").agg(chosen.alias("leader")), ["key"])
    fit = 5 * F.least("size", "leader.size") >= 4 * F.greatest("size", "leader.size")
    return led.filter((F.col("root") != F.col("leader.root")) & fit).select(
        F.least("id", "leader.id").alias("u"), F.greatest("id", "leader.id").alias("v")
    )


def strip_pairs(members: DataFrame, strip: int = STRIP) -> DataFrame:
    """All pairs (u, v) in a list that are not connected, two strips of the list in a task's hands at a time."""
    last = members.groupBy("key").agg(F.floor(F.max("at") / strip).alias("last"))
    mine = F.floor(F.col("at") / strip)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))
    met = join_groups(members, last, ["key"]).select("key", "id", "size", "root", mine.alias("mine"), other.alias("other"))
    met = met.select(
        "key", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "mine", "id", "size", "root"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((0, 7), np.int64)
        for batch in _and_end(batches):
            if batch is not None:
                rest = np.concatenate([rest, np.column_stack([c.to_numpy() for c in batch.columns])])
            bounds = np.flatnonzero((rest[1:, :3] != rest[:-1, :3]).any(axis=1)) + 1
            bounds = [0, *bounds.tolist(), *([len(rest)] if batch is None else [])]
            for start, end in zip(bounds[:-1], bounds[1:], strict=True):
                rows = rest[start:end]
                if len(rows):
                    left, right = rows[rows[:, 3] == rows[0, 1]][:, 4:], rows[rows[:, 3] == rows[0, 2]][:, 4:]
                    pairs = _pairs(left, right, rows[0, 1] == rows[0, 2])
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["u", "v"])
            rest = rest[bounds[-1] :]

    return met.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(run, "u long, v long")


def similar_roots(sets: DataFrame, longest: int = LIST, rounds: int = ROUNDS, strip: int = STRIP) -> DataFrame:
    """(node, root) over links between all sets (id, hashes) with a Jaccard similarity of 0.8 or more."""
    lists = written(prefix_lists(sets, longest), "near-lists")
    links = verified(lists.filter("key IS NULL").select("u", "v"), sets)
    members = lists.filter("key IS NOT NULL").select("key", "at", F.col("u").alias("id"), F.col("v").alias("size"))
    for round_ in range(rounds + 1):
        roots = components(links)
        members = written(open_members(members.select("key", "at", "id", "size"), roots), "near-open")
        if members.isEmpty():
            return roots
        pairs = strip_pairs(members, strip) if round_ == rounds else leader_pairs(members, round_)
        links = links.union(verified(pairs, sets))
    return components(links)


def similar_groups(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, digest and component_id over pairs whose sets of word shingles have a Jaccard similarity of 0.8 or more."""
    import xxhash

    digest = F.sha2(F.regexp_replace(text_of(), SPACE + "+", ""), 256)

    def make():
        def sets(doc_id, digest, text):
            data = shingle_set(text, shingle).tobytes()
            return [(doc_id, digest, int(np.uint64(xxhash.xxh3_64_intdigest(data)).view(np.int64)), data)]

        return sets

    rows = docs.select(F.col("doc_id").cast("long"), digest, text_of())
    fps = written(map_rows(rows, make, "doc_id long, digest string, id long, hashes binary", batch_rows=512), "shingle-sets")
    nodes = fps.groupBy("id").agg(F.min("doc_id").alias("first"))
    return _named(fps.drop("hashes"), nodes, "id", similar_roots(fps.select("id", "hashes")))


def drop_near_copies(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row of each component of fingerprints within three bits, with exactly the columns of ``docs``.

    The smallest id stays. Of rows that repeat an id, the smallest digest stays.
    """
    return _stay(docs, near_groups(docs, shingle))


def drop_similar(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """One row of each group of ``similar_groups``, as ``drop_near_copies`` does."""
    return _stay(docs, similar_groups(docs, shingle))


def _stay(docs: DataFrame, groups: DataFrame) -> DataFrame:
    key = row_key("doc_id", F.col("digest"))
    stays = groups.groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key.alias("key"))).alias("first")
    )
    return keep_rows(docs, stays.select(F.col("first.key").alias("_kept")))

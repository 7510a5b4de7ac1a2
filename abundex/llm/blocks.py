"""Distinct words by blocks of documents, and answers about words brought back to the documents.

A task cuts its documents into blocks of bounded size. From a block it makes two things: the
block's distinct words, numbered from the most frequent one, and its documents as sequences of
these numbers. The word rows meet in a shuffle by word, where each distinct word is worked on
once for all blocks; what is found returns to the block by number, and so to every position.
A word costs one row per block that has it, not one per occurrence, whatever its share.

Both things are made from the same rows by the same function. A block's id covers its place and
its content, and the answers of a block must be as many as its words; should the input have been
cut differently in between, the job stops with an error and never mixes blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 32 << 20
PACK_WORDS = 1 << 18

# Words may also come as UTF-8.
Split = Callable[[], Callable[[str], list[str] | list[bytes]]]


class _Numbers(dict):
    """Numbers words in the order they are first looked up."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def occurrences(sequences: list[np.ndarray], size: int) -> np.ndarray:
    """How often each number below ``size`` occurs in the sequences, added up a part at a time."""
    counts, part, held = np.zeros(size, np.int64), [], 0
    for sequence in sequences:
        part.append(sequence)
        held += len(sequence)
        if held >= PACK_WORDS:
            counts += np.bincount(np.concatenate(part), minlength=size)
            part, held = [], 0
    return counts + np.bincount(np.concatenate(part), minlength=size) if part else counts


def distinct(parts: Iterable[np.ndarray]) -> np.ndarray:
    """The different numbers of all parts in order; what is held grows with these and not with the parts."""
    found, new, held = np.empty(0, np.int64), [], 0

    def merged() -> np.ndarray:
        # numpy's unique looks integers up in a hash table first, which takes several times as long.
        numbers = np.sort(np.concatenate([found, *new]))
        return numbers[np.diff(numbers, prepend=numbers[:1] - 1) != 0]

    for part in parts:
        new.append(part)
        held += len(part)
        if held >= max(PACK_WORDS, len(found)):
            found, new, held = merged(), [], 0
    return merged() if new else found


def _blocks(
    batches: Iterator[pa.RecordBatch], split: Callable[[str], list[str]], block_chars: int
) -> Iterator[tuple[int, list[str], np.ndarray, list[int | None], list[np.ndarray], list[bool]]]:
    """(block id, words, their counts, document ids, sequences, counted) from rows (id, text[, counted]).

    A text is turned into numbers as it comes; a block holds those and its distinct words.
    Words of texts that are not ``counted`` get a number, but no count.
    """
    import xxhash
    from pyspark import TaskContext

    context = TaskContext.get()
    place = context.partitionId() if context else 0
    number, size = 0, 0
    numbers, ids, sequences, counted, seen = _Numbers(), [], [], [], xxhash.xxh64(f"{place}/0")

    def close() -> tuple:
        first_seen = list(numbers)
        numbers.clear()
        counts = occurrences(sequences, len(first_seen))
        learned = counts
        if not all(counted):
            learned = occurrences([x for x, learn in zip(sequences, counted, strict=True) if learn], len(first_seen))
        # Words that are equally frequent keep the order in which they were first seen.
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        words = [first_seen[i] for i in order.tolist()]
        for k, sequence in enumerate(sequences):
            sequences[k] = rank[sequence]
        return seen.intdigest() - (1 << 63), words, learned[order], ids, sequences, counted

    for batch in batches:
        for i, text, *learn in zip(*batch.columns, strict=True):
            i, text = i.as_py(), text.as_py()
            counted.append(learn[0].as_py() if learn else True)
            words = split(text)
            ids.append(i)
            sequences.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.uint32, count=len(words)))
            seen.update(f"\0{i}\0".encode())
            seen.update(text.encode("utf-8", "surrogatepass"))
            size += len(text) + 64
            if size >= block_chars:
                done = close()
                number, size = number + 1, 0
                numbers, ids, sequences, counted = _Numbers(), [], [], []
                seen = xxhash.xxh64(f"{place}/{number}")
                yield done
                # A block is gone before the next one is filled.
                del done
    if ids:
        yield close()


def block_words(
    docs: DataFrame, split: Split, block_chars: int = BLOCK_CHARS, word_type: str = "string"
) -> DataFrame:
    """(block, number, word, n) for each distinct word of a block; ``docs`` has (doc_id, text[, counted]).

    ``split`` may also give numbers in place of words, with ``word_type`` long.
    """
    kind = pa.int64() if word_type == "long" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, words, counts, *_ in _blocks(batches, split(), block_chars):
            for start in range(0, len(words), 16_384):
                part = words[start : start + 16_384]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(part), block, np.int64)),
                        pa.array(np.arange(start, start + len(part), dtype=np.int32)),
                        pa.array(part, kind),
                        pa.array(counts[start : start + 16_384]),
                    ],
                    names=["block", "number", "word", "n"],
                )

    return docs.mapInArrow(run, f"block long, number int, word {word_type}, n long")


def packed_rows(
    block: int, n_words: int, ids: list, sequences: Iterable[np.ndarray], kind: pa.DataType
) -> Iterator[pa.RecordBatch]:
    """(block, n_words, doc_ids, lengths, packed) rows of about ``PACK_WORDS`` numbers."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3)

    def pack(some_ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        numbers = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 4).T)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block], pa.int64()),
                pa.array([n_words], pa.int32()),
                pa.array([some_ids], pa.list_(kind)),
                pa.array([[len(p) for p in parts]], pa.list_(pa.int32())),
                pa.array([squeeze.compress(planes.tobytes())], pa.binary()),
            ],
            names=["block", "n_words", "doc_ids", "lengths", "packed"],
        )

    some_ids, some, size = [], [], 0
    for i, sequence in zip(ids, sequences, strict=True):
        some_ids.append(i)
        some.append(sequence)
        size += len(sequence) + 1
        if size >= PACK_WORDS:
            yield pack(some_ids, some)
            some_ids, some, size = [], [], 0
    if some_ids:
        yield pack(some_ids, some)


def block_sequences(
    docs: DataFrame, split: Split, block_chars: int = BLOCK_CHARS, id_type: str = "long"
) -> DataFrame:
    """(block, n_words, doc_ids, lengths, packed): the documents of a block as word numbers.

    A row holds several documents; the numbers are stored byte plane by byte plane and compressed.
    """
    kind = pa.string() if id_type == "string" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, words, _, ids, sequences, _ in _blocks(batches, split(), block_chars):
            yield from packed_rows(block, len(words), ids, sequences, kind)

    return docs.mapInArrow(run, f"block long, n_words int, doc_ids array<{id_type}>, lengths array<int>, packed binary")


CONTEXT_BITS = 10
_BOTH = {
    "block": ("long", pa.int64()),
    "number": ("int", pa.int32()),
    "word": ("string", pa.string()),
    "classes": ("array<smallint>", pa.list_(pa.int16())),
    "counts": ("array<int>", pa.list_(pa.int32())),
    "n_words": ("int", pa.int32()),
    "doc_ids": ("array<long>", pa.list_(pa.int64())),
    "lengths": ("array<int>", pa.list_(pa.int32())),
    "packed": ("binary", pa.binary()),
}


def block_contexts(
    docs: DataFrame, split: Split, context_of: Callable[[str | bytes], int], block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """Words and sequences of each block from one pass over the texts (doc_id, text, counted).

    ``context_of`` gives the class, below 2 ** ``CONTEXT_BITS``, that a word is to the word after it;
    a text starts in class 0. A block has rows of two kinds, the columns of the other kind being
    NULL: (block, number, word, classes, counts) for each distinct word, with the classes it follows
    in ascending order and how often it does so in counted texts, and (block, n_words, doc_ids,
    lengths, packed) for the texts. A text is a sequence of places in the block's list of all
    (number, class) in order, so what is found for a word's classes needs no look-up.
    """

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [
            batch.column(name) if name in batch.schema.names else pa.nulls(batch.num_rows, kind)
            for name, (_, kind) in _BOTH.items()
        ]
        return pa.RecordBatch.from_arrays(columns, names=list(_BOTH))

    def rows(
        block: int, words: list, _: np.ndarray, ids: list, sequences: list[np.ndarray], counted: list[bool]
    ) -> Iterator[pa.RecordBatch]:
        of_word = np.fromiter(map(context_of, words), np.int64, len(words))

        def keys(sequence: np.ndarray) -> np.ndarray:
            key = sequence.astype(np.int64) << CONTEXT_BITS
            key[1:] |= of_word[sequence[:-1]]
            return key

        # Keys take twice the room of the sequences: they are made a text at a time, and made again for the places.
        pairs = distinct(map(keys, sequences))
        for k, sequence in enumerate(sequences):
            sequences[k] = np.searchsorted(pairs, keys(sequence)).astype(np.uint32)
        counts = occurrences([x for x, learn in zip(sequences, counted, strict=True) if learn], len(pairs))
        starts = np.searchsorted(pairs >> CONTEXT_BITS, np.arange(len(words) + 1)).astype(np.int32)
        classes = (pairs & ((1 << CONTEXT_BITS) - 1)).astype(np.int16)
        for start in range(0, len(words), 16_384):
            stop = min(start + 16_384, len(words))
            low, high = starts[start], starts[stop]
            offsets = pa.array(starts[start : stop + 1] - low)
            yield whole(
                pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(stop - start, block, np.int64)),
                        pa.array(np.arange(start, stop, dtype=np.int32)),
                        pa.array(words[start:stop], pa.string()),
                        pa.ListArray.from_arrays(offsets, pa.array(classes[low:high])),
                        pa.ListArray.from_arrays(offsets, pa.array(counts[low:high].astype(np.int32))),
                    ],
                    names=["block", "number", "word", "classes", "counts"],
                )
            )
        for batch in packed_rows(block, len(words), ids, sequences, pa.int64()):
            yield whole(batch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in _blocks(batches, split(), block_chars):
            yield from rows(*made)
            del made

    return docs.mapInArrow(run, ", ".join(f"{name} {kind}" for name, (kind, _) in _BOTH.items()))


def unpack(packed: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel()


def answered(
    sequences: DataFrame,
    answers: DataFrame,
    finish: Callable[[pa.Table], Callable[[list, np.ndarray, np.ndarray], pa.Table]],
    schema: str,
) -> DataFrame:
    """Bring ``answers`` (block, number, ...) back to the documents of ``sequences``.

    ``finish`` gets a block's answers in the order of their numbers and returns a function of
    (document ids, lengths, word numbers of all of them in a row) that gives the output rows.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("number")
        numbers = right.column("number").to_numpy()
        last, make, parts = None, None, []
        for row in range(left.num_rows):
            n_words = left.column("n_words")[row].as_py()
            if len(numbers) != n_words or (n_words and numbers[-1] != n_words - 1):
                raise RuntimeError(f"block {left.column('block')[row]}: {len(numbers)} answers for {n_words} words")
            make = make or finish(right)
            parts.append(
                make(
                    left.column("doc_ids")[row].as_py(),
                    np.array(left.column("lengths")[row].as_py(), dtype=np.int64),
                    unpack(left.column("packed")[row].as_py()),
                )
            )
        if not parts and right.num_rows:
            raise RuntimeError("a block has words but no documents")
        return pa.concat_tables(parts) if parts else empty

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    return sequences.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def by_word(words: DataFrame) -> DataFrame:
    """The word rows dealt out by word, equal words one after another."""
    return words.repartition(F.col("word")).sortWithinPartitions("word")

"""Packing documents into training sequences of several lengths.

A task turns its documents into token ids and collects blocks of bounded size. A block is packed
hierarchically. Whole windows are cut off long documents first; what is left of each document is
routed to the shortest context size that holds it. The sizes are packed from the longest down: a
document opens a window of its size, whose gap is filled with the longest documents of the shorter
sizes that still fit; where none fits, the longest one left is cut. So every window but the block's
last one is full. What would lie in that last window goes on: the rests of about a thousand blocks
are packed together by the same steps, and only there a window may stay open. Each block's sequences
are dealt out to step groups of about equal tokens, the longest first, each to the emptiest group.

No document passes the driver, and no shuffle moves anything but the rests, less than one window a
block. A hot source, language or text changes nothing: blocks follow the order of the rows. The
packed blocks are written to the shared folder before anything reads them twice, so that a lost
executor cannot pack one block in two ways.

Words are encoded by the vocabulary file's own tokenizer, each once for as long as a bounded table of
known words holds it.

Defined results: a null or empty text has only the closing id; repeated rows are packed each; null
ids pass through; an empty table gives an empty result; other columns do not matter; documents of
one length are packed in row order; a document longer than a block makes a block of its own size.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundex.llm.bpe import _read, byte_characters, settled_classes
from abundex.llm.common import text_of, written

TIERS = (512, 1024, 2048, 4096)
BLOCK_TOKENS = 4 << 20
STEP_TOKENS = 64 << 10
CLOSING_ID = 2
# Words a worker keeps in a generation, and the characters they may have in all.
KNOWN_WORDS = 300_000
KNOWN_CHARS = 16 << 20

# A piece of a document in a window: (item, first token, number of tokens).
Piece = tuple[int, int, int]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def fill_windows(sizes: list[int], tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Full windows (size, pieces) of items with these sizes, and the pieces of the last, open one."""
    longest = tiers[-1]
    windows: list[tuple[int, list[Piece]]] = []
    waiting: list[list[tuple[int, int]]] = [[] for _ in range(longest)]
    lengths = 0  # bit s is set while an item of s tokens waits

    def wait(item: int, start: int, size: int) -> None:
        nonlocal lengths
        waiting[size].append((item, start))
        lengths |= 1 << size

    def take(at_most: int) -> Piece | None:
        nonlocal lengths
        size = (lengths & ((2 << at_most) - 1)).bit_length() - 1
        if size < 0:
            return None
        item, start = waiting[size].pop()
        if not waiting[size]:
            lengths ^= 1 << size
        return item, start, size

    for item in reversed(range(len(sizes))):  # the last one waiting of a size is the first row
        whole, rest = divmod(sizes[item], longest)
        windows += [(longest, [(item, k * longest, longest)]) for k in range(whole)]
        if rest:
            wait(item, whole * longest, rest)
    while (first := take(longest - 1)) is not None:
        window = next(t for t in tiers if first[2] <= t)
        pieces, gap = [first], window - first[2]
        while gap:
            piece = take(gap)
            if piece is None:
                piece = take(longest - 1)
                if piece is None:
                    return windows, pieces
                item, start, size = piece
                wait(item, start + gap, size - gap)
                piece = item, start, gap
            pieces.append(piece)
            gap -= piece[2]
        windows.append((window, pieces))
    return windows, []


def deal_steps(windows: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """The step group of each window: the longest windows first, each to the group with the fewest tokens."""
    groups = max(1, round(sum(windows) / step_tokens))
    load = [(0, g) for g in range(groups)]
    out = [0] * len(windows)
    for i in sorted(range(len(windows)), key=lambda i: -windows[i]):
        tokens, group = load[0]
        out[i] = group
        heapq.heapreplace(load, (tokens + windows[i], group))
    return out


class _Known(dict):
    """Ids by word; a new word is looked up in an older table, else encoded."""

    def __init__(self, older: dict[str, bytes], encode: Callable[[str, _Known], bytes]):
        super().__init__()
        self.older, self.encode, self.chars = older, encode, 0

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word, self)
        self[word] = ids
        self.chars += len(word)
        return ids


class WordIds:
    """Token ids of whole texts, packed as unsigned 32-bit integers.

    The tokenizer never merges across white space, so a text's ids are those of its words in a row.
    Words met lately are kept in two generations: when the younger one is full it takes the place of
    the older one, and what is met again comes over.
    """

    def __init__(self, spec: str):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merge = self.tokenizer.model.tokenize
        letter, number, space = settled_classes()
        self.settled = re.compile(f"[{letter}{number}\\u0021-\\u007e]+").fullmatch
        self.pieces = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{space}{letter}{number}]+"
        ).findall
        self.ascii_pieces = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall
        self.spaces = re.compile("[^\x09-\x0d\x20]+").findall
        self.shown = {b: chr(c) for c, b in byte_characters().items()}
        self.known = _Known({}, self._encode)

    def _pieces(self, word: str) -> list[str] | None:
        """The parts a word is cut into before the merges; None if the whole tokenizer has to see it."""
        from unicodedata import is_normalized

        # Python's lower() treats a final sigma by its context and splits a dotted I.
        if self.settled(word) and "<|" not in word and "İ" not in word and "Σ" not in word:
            low = word.lower()
            if self.settled(low) and is_normalized("NFC", word):
                return self.pieces(low)
        return None

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii() or not piece.isprintable():
            piece = "".join(map(self.shown.__getitem__, piece.encode()))
        return array("I", [token.id for token in self.merge(piece)]).tobytes()

    def _encode(self, word: str, known: _Known) -> bytes:
        plain = word.isascii() and "<|" not in word
        pieces = self.ascii_pieces(word.lower()) if plain else self._pieces(word)
        if pieces is None:
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if len(pieces) == 1:
            piece = pieces[0]
            return self._piece(piece) if piece == word else known[piece]
        return b"".join(map(known.__getitem__, pieces))

    def __call__(self, text: str) -> bytes:
        if len(self.known) > KNOWN_WORDS or self.known.chars > KNOWN_CHARS:
            self.known.older = {}
            self.known = _Known(self.known, self._encode)
        # split() knows four separators that are not white space to the tokenizer.
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        words = self.spaces(text) if odd else text.split()
        return b"".join(map(self.known.__getitem__, words))


@lru_cache(maxsize=1)
def word_ids(spec: str) -> WordIds:
    """The encoder of a vocabulary; a worker keeps it, and the words it knows, from task to task."""
    return WordIds(spec)


_SCHEMA = "doc_id long, start long, doc_tokens long, sequence_id long, offset long, window int, step long, ids binary"
# Bits of an id: above the block's, which is task and number in the task, stands whether it is a block of rests.
_TASK, _NUMBER, _INSIDE = 24, 14, 24


def _packed(block: int, items: list[tuple], tiers: tuple[int, ...], last: bool) -> Iterator[pa.RecordBatch]:
    """Rows of a block's items (doc_id, start, doc_tokens, ids as bytes); open pieces have no sequence unless ``last``."""
    windows, rest = fill_windows([len(i[3]) // 4 for i in items], tiers)
    if last and rest:
        windows, rest = [*windows, (tiers[-1], rest)], []
    steps = deal_steps([size for size, _ in windows])
    rows: list[tuple] = []
    held = 0

    def row(piece: Piece, *where: int | None) -> tuple:
        item, start, size = piece
        doc_id, first, tokens, ids = items[item]
        return doc_id, first + start, tokens, *where, ids[4 * start : 4 * (start + size)]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        columns = zip(*rows, strict=True)
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for number, ((size, pieces), step) in enumerate(zip(windows, steps, strict=True)):
        offset = 0
        for piece in pieces:
            rows.append(row(piece, block << _INSIDE | number, offset, size, block << _INSIDE | step))
            offset += piece[2]
        held += size
        if held >= 1 << 18:
            yield batch(rows)
            rows, held = [], 0
    rows += [row(piece, None, None, None, block) for piece in rest]
    if rows:
        yield batch(rows)


def token_rows(docs: DataFrame, path: str | None, closing_id: int) -> tuple[DataFrame, Callable]:
    """The rows (doc_id, text) to read and a function that gives a task's encoder, closing id included."""
    held = docs.sparkSession.sparkContext.broadcast(_read(path or vocabulary_path()))
    end = np.array([closing_id], dtype="<u4").tobytes()

    def encoder() -> Callable[[str], bytes]:
        words = word_ids(held.value)
        return lambda text: words(text) + end

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")), encoder


def pack(
    docs: DataFrame,
    path: str | None = None,
    tiers: tuple[int, ...] = TIERS,
    closing_id: int = CLOSING_ID,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row per piece: its document, place in it, ids (packed), sequence, offset there, window and step group.

    ``tiers`` are the context sizes, ascending; a step group has about ``STEP_TOKENS`` tokens.
    """
    rows, encoder = token_rows(docs, path, closing_id)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, place = encoder(), TaskContext.get().partitionId()
        number, size, items = 0, 0, []
        for batch in batches:
            for i, text in zip(*batch.columns, strict=True):
                ids = encode(text.as_py())
                items.append((i.as_py(), 0, len(ids) // 4, ids))
                size += len(ids) // 4
                if size >= block_tokens:
                    yield from _packed(place << _NUMBER | number, items, tiers, last=False)
                    number, size, items = number + 1, 0, []
        if items:
            yield from _packed(place << _NUMBER | number, items, tiers, last=False)

    def rests(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        table = table.sort_by([("step", "ascending"), ("place", "ascending")])
        items = list(zip(*(table.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True))
        return pa.Table.from_batches(_packed(1 << _TASK + _NUMBER | group, items, tiers, last=True))

    placed = written(rows.mapInArrow(blocks, _SCHEMA), "packed")
    left = placed.filter("sequence_id IS NULL")
    # As many groups as the rests fill blocks: a thousand blocks and more to a group.
    n_blocks = left.select("step").distinct().count()
    groups = max(1, -(-n_blocks * tiers[-1] // block_tokens))
    left = left.withColumn("group", F.pmod(F.xxhash64("step"), F.lit(groups).cast("long")))
    left = left.withColumn("place", F.monotonically_increasing_id())
    packed = left.groupBy("group").applyInArrow(rests, _SCHEMA)
    return placed.filter("sequence_id IS NOT NULL").unionByName(packed)

"""BPE encoding and decoding over a table of distinct words.

Texts are split into the words that byte-level BPE never merges across. Each distinct word is
encoded once for the whole corpus, with the vocabulary file's own tokenizer; its ids return to
every position by block and word number. Decoding joins ids with the table of pieces, which is
bounded by the vocabulary and therefore broadcast.

Ids are packed as little-endian unsigned 32-bit integers, as token files hold them.

Defined results: a null or empty text has no ids; a special token's string in a text becomes its
id, as the library does by default; repeated rows are encoded each; null ids pass through;
other columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abundex.llm.blocks import BLOCK_CHARS, answered, block_sequences, block_words, by_word
from abundex.llm.common import text_of

# Below this code point all Unicode versions agree on letters, numbers and white space.
_SETTLED = 0x0530


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def _ranges(test: Callable[[str], object]) -> str:
    """A character class of all settled code points that pass, as ranges."""
    inside = [c for c in range(_SETTLED) if test(chr(c))]
    starts = [c for c in inside if c - 1 not in set(inside)]
    ends = [c for c in inside if c + 1 not in set(inside)]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends, strict=True))


def settled_classes() -> tuple[str, str, str]:
    """Character classes of the settled letters, numbers and white space."""
    import regex

    return tuple(_ranges(regex.compile(p).fullmatch) for p in ("\\p{L}", "\\p{N}", "\\s"))


def splitter(spec: str) -> Callable[[str], list[str]]:
    """The words of a text; texts with newer code points are split by the tokenizer itself."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    letter, number, space = settled_classes()
    words = re.compile(
        f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    ).findall
    newer = re.compile(f"[^\\u0000-\\u{_SETTLED - 1:04x}]").search
    added = [a["content"] for a in json.loads(spec)["added_tokens"]]
    special = re.compile("(" + "|".join(re.escape(a) for a in sorted(added, key=len, reverse=True)) + ")") if added else None

    def plain(text: str) -> list[str]:
        if newer(text):
            return [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return words(text)

    def split(text: str) -> list[str]:
        if special is None or not any(a in text for a in added):
            return plain(text)
        out: list[str] = []
        for i, part in enumerate(special.split(text)):
            out += [part] if i % 2 else plain(part)
        return out

    return split


def encode(docs: DataFrame, path: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_tokens and ``ids`` (packed) of every document."""
    spec = _read(path or vocabulary_path())
    held = docs.sparkSession.sparkContext.broadcast(spec)
    # Ids of a word travel as 16-bit numbers where the vocabulary fits.
    width = "<u2" if len(_pieces(spec)) <= 1 << 16 else "<u4"
    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))

    def split() -> Callable[[str], list[str]]:
        return splitter(held.value)

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(held.value)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        last, last_ids = None, b""
        for batch in batches:
            words = batch.column(2).to_pylist()
            # Equal words follow each other: each is encoded where its run begins.
            new = [w for i, w in enumerate(words) if w != (words[i - 1] if i else last)]
            coded = iter(tokenizer.encode_batch_fast(new, add_special_tokens=False))
            packed = []
            for w in words:
                if w != last:
                    last, last_ids = w, np.array(next(coded).ids, dtype=width).tobytes()
                packed.append(last_ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["block", "number", "ids"]
            )

    def finish(answers: pa.Table) -> Callable[[list, np.ndarray, np.ndarray], pa.Table]:
        found = answers.column("ids").combine_chunks().cast(pa.large_binary())
        bounds = np.frombuffer(found.buffers()[1], dtype=np.int64)[found.offset : found.offset + len(found) + 1]
        unit = np.dtype(width).itemsize
        flat = np.frombuffer(found.buffers()[2] or b"", dtype=width)
        starts, sizes = bounds[:-1] // unit, np.diff(bounds) // unit

        def texts(ids: list, lengths: np.ndarray, numbers: np.ndarray) -> pa.Table:
            each = sizes[numbers]
            ends = np.cumsum(each)
            total = int(ends[-1]) if len(ends) else 0
            tokens = flat[np.repeat(starts[numbers] - (ends - each), each) + np.arange(total)].astype("<u4")
            cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lengths)])]
            packed = pa.Array.from_buffers(
                pa.binary(), len(ids), [None, pa.py_buffer((4 * cuts).astype(np.int32)), pa.py_buffer(tokens)]
            )
            return pa.table(
                [pa.array(ids, pa.int64()), pa.array(np.diff(cuts), pa.int64()), packed],
                names=["doc_id", "n_tokens", "ids"],
            )

        return texts

    words = by_word(block_words(rows, split, block_chars).drop("n"))
    coded = words.mapInArrow(encode_words, "block long, number int, ids binary")
    return answered(
        block_sequences(rows, split, block_chars), coded, finish, "doc_id long, n_tokens long, ids binary"
    )


def pieces(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The id-to-piece table of a vocabulary file: id and the bytes it stands for."""
    rows = [(i, piece) for i, piece in enumerate(_pieces(_read(path or vocabulary_path()))) if piece is not None]
    return spark.createDataFrame(rows, "id int, piece binary")


def byte_characters() -> dict[int, int]:
    """Bytes by code point. Byte-level vocabularies write each byte as a visible character: itself
    where it is printable in Latin-1, else the next code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {256 + i: b for i, b in enumerate(hidden)}


def _pieces(spec: str) -> list[bytes | None]:
    """Bytes by id."""
    byte_of = {chr(c): b for c, b in byte_characters().items()}
    model = json.loads(spec)
    table = {i: bytes(byte_of[c] for c in piece) for piece, i in model["model"]["vocab"].items()}
    table |= {a["id"]: a["content"].encode() for a in model["added_tokens"]}
    return [table.get(i) for i in range(max(table) + 1)]


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (doc_id, n_tokens, ids) with the decoded ``text``.

    Bytes that are not UTF-8 become replacement characters; special tokens keep their strings.
    """
    held = encoded.sparkSession.sparkContext.broadcast(_pieces(_read(path or vocabulary_path())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = held.value.__getitem__
        parts = (whole.slice(start, 256) for whole in batches for start in range(0, whole.num_rows, 256))
        for batch in parts:
            texts = [
                b"".join(map(piece, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")
                for packed in batch.column(2).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "text"]
            )

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(
        run, "doc_id long, n_tokens long, ids binary, text string"
    )

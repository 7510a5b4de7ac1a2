"""Lexical search, the Merkle manifest and packing against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from abundex.llm import lexical, merkle, packing, queries
from tests.llm import corpus

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ITEMS = "item_id long, text string"


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_search(rows, items, k=50):
    split = lambda t: TERM.findall(ascii_lower(t or ""))
    docs = [(r[0], Counter(split(r[1]))) for r in rows]
    docs = [(i, bag, sum(bag.values())) for i, bag in docs if bag]
    total, df = sum(n for *_, n in docs), Counter(t for _, bag, _ in docs for t in bag)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(split(text))
    out = []
    for item, terms in wanted.items():
        scored = []
        for i, bag, n in docs:
            m = 50 + 50 * n * len(docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m))
                for t in terms & set(bag)
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def searched(spark, rows, items, **options):
    found = lexical.search(corpus.frame(spark, rows, clashes=True), spark.createDataFrame(items, ITEMS), **options)
    return sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_search_is_the_plain_one(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta", "GAMMA", "délta", "É", "x1", "über", "漢字", "rare"]
    rows = [(i, " ".join(rng.choices(words, weights=range(9, 0, -1), k=rng.randint(1, 30))), None, None, 0) for i in range(150)]
    rows += [(1000 + i, "alpha beta; the same bag!", None, None, 0) for i in range(120)]  # more copies than ranks
    rows += [(2000, "rare " * 30_000, None, None, 0), (None, "rare alpha", None, None, 0), (3000, "alpha", None, None, 0)] * 2
    rows += corpus.ODD
    items = [(1, "Alpha, gamma"), (2, "rare 漢字 é"), (2, "beta"), (None, "über word"), (4, None), (5, "?!"), (6, "unseen")]
    want = plain_search(rows, items)
    assert searched(spark, rows, items) == want
    assert searched(spark, rows, items, entries=2) == want  # items in several blocks
    assert searched(spark, rows, items, k=3) == [r for r in want if r[1] <= 3]
    assert searched(spark, [], items) == searched(spark, rows, []) == searched(spark, rows, [(1, None)]) == []
    assert searched(spark, [(1, None, None, None, 0)], items) == []


def test_small_batches_and_held_rows_rank_alike(spark, monkeypatch):
    rows = [(i, corpus.prose(i % 40, 30, vocabulary=60), None, None, 0) for i in range(90)]
    items = [(i, corpus.prose(100 + i, 8, vocabulary=60)) for i in range(12)]
    whole = searched(spark, rows, items, k=5)
    assert whole == plain_search(rows, items, k=5)
    rng = np.random.default_rng(1)
    cells = np.column_stack([rng.integers(0, 4, 500), rng.integers(1, 9, 500), rng.integers(0, 2, 500), rng.integers(0, 50, 500)])
    best = lexical._best(cells, 7)
    for item in range(4):
        want = sorted(map(tuple, cells[cells[:, 0] == item].tolist()), key=lambda r: (-r[1], r[2], r[3]))[:7]
        assert [tuple(r) for r in best[best[:, 0] == item].tolist()] == want


def test_long_documents_pass_64_bits(spark):
    rows = [(1, 10**6, 1, bytearray(np.array([0, 3], "<u4").tobytes()))]
    found = spark.createDataFrame(rows, "doc_id long, n long, hash long, bag binary")
    n_docs, n_terms = 10**11, 7 * 10**13  # 50 n N is 5 x 10^18
    assert lexical.classes(found, n_docs, n_terms, 5).first()["m"] == 50 + 50 * 10**6 * n_docs // n_terms
    assert lexical.classes(found, 10**13, 7 * 10**13, 5).first()["m"] == 50 + 50 * 10**6 * 10**13 // (7 * 10**13)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def beside(tree, i):
    for level in tree[:-1]:
        start = i // 8 * 8
        yield "".join(level[start:i]), "".join(level[i + 1 : start + 8])
        i //= 8


def plain_manifest(rows):
    def leaf(row, text):
        doc_id, _, lang, source, n_chars = row
        return sha("".join(map(field, (doc_id, source, lang, n_chars, text))))

    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append((row[0] is not None, row[0] or 0, leaf(row, row[1]), row))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda g: g[:3])
        trees[lang] = levels([g[2] for g in groups[lang]])
    top = levels([trees[lang][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for i, (*_, digest, row) in enumerate(groups[lang]):
            path = [*beside(trees[lang], i), *beside(top, k)]
            chosen = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[1] is not None
            node = leaf(row, ascii_lower(row[1])) if chosen else digest
            for left, right in path:
                node = sha(left + node + right)
            root = top[-1][0]
            proof = sha("".join(a + b for a, b in path))
            out.append((row[0], digest, trees[lang][-1][0], root, proof, node, node == root))
    return sorted(out, key=str)


def manifested(spark, tmp_path, rows, name):
    pq.write_table(corpus.frame(spark, rows, clashes=True).toArrow(), f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, queries.op12_nested_rollup(spark, str(tmp_path)).collect()), key=str)


@pytest.mark.parametrize("n", [1, 8, 9, 65])
def test_manifest_of_small_tables(spark, tmp_path, n):
    rows = [(i, f"Text {i}", "en", None, i) for i in range(n)]
    assert manifested(spark, tmp_path, rows, "small") == plain_manifest(rows)


def test_manifest_is_the_plain_one(spark, tmp_path):
    rows = [(i, f"Some TEXT {i}", "de", "s", i) for i in range(4_200)]  # more than one block
    rows += [(i // 2, "Ü" * (i % 3), f"l{i % 11}", "s", None) for i in range(100)]  # equal ids, eleven groups
    rows += [(7, "same row", "copies", "s", 8)] * 70 + [(None, "No Id", None, None, None)] * 3
    rows += [(99, "A" * 200_000, "long", "s", 1), *corpus.ODD]
    assert manifested(spark, tmp_path, rows, "whole") == plain_manifest(rows)


def test_manifest_of_nothing_and_without_changes(spark, tmp_path):
    assert manifested(spark, tmp_path, [], "none") == []
    rows = corpus.frame(spark, [(1, "a", "en", "s", 1), (2, "b", "en", "s", 1)])
    proofs = merkle.manifest(rows, "doc_id", "lang", ["doc_id", "text"])
    assert proofs.filter("found_leaf IS NOT NULL").count() == 0
    assert proofs.filter(merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).count() == 2
    assert proofs.filter(merkle.fold(F.lit("0"), F.col("path")) == F.col("root")).count() == 0


@pytest.fixture(scope="module")
def encoder():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary_path())


def test_word_ids_are_the_librarys(encoder, monkeypatch):
    from abundex.llm.bpe import _read

    monkeypatch.setattr(packing, "KNOWN_WORDS", 20)  # generations change all the time
    words = packing.WordIds(_read(packing.vocabulary_path()))
    rng = random.Random(3)
    letters = "aAbB'sS.,!1290 \t\n<|>éÉßİΣσςȺ½²́​\x1c\x85 漢가각ﬁ😀_-\x00"
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 30))) for _ in range(3_000)]
    texts += [f"aB{chr(c)}Cd 1{chr(c)}2'" for c in range(0x3000)]
    texts += ["a<|endoftext|>b <|StartOfText|>", "x" * 20_000, *(t or "" for _, t, *_ in corpus.ODD)]
    for text in texts:
        got = np.frombuffer(words(text), "<u4").tolist()
        assert got == encoder.encode(text, add_special_tokens=False).ids, repr(text)


def test_windows_hold_every_token_once():
    rng = random.Random(4)
    some = [1, 5, 511, 512, 513, 1024, 2100, 4095, 4096, 5000, 20_000]
    for _ in range(150):
        sizes = [rng.choice([*some, rng.randint(1, 6_000)]) for _ in range(rng.randint(0, 60))]
        windows, rest = packing.fill_windows(sizes)
        assert all(size in packing.TIERS and sum(p[2] for p in pieces) == size for size, pieces in windows)
        assert sum(p[2] for p in rest) < packing.TIERS[-1]
        found = defaultdict(list)
        for item, start, n in (p for _, pieces in [*windows, (0, rest)] for p in pieces):
            found[item].append((start, n))
        for item, size in enumerate(sizes):
            at = 0
            for start, n in sorted(found[item]):
                assert start == at and n > 0
                at += n
            assert at == size
        steps = packing.deal_steps([size for size, _ in windows], 16_384)
        load = Counter()
        for (size, _), step in zip(windows, steps, strict=True):
            load[step] += size
        assert not load or max(load.values()) - min(load.values()) <= packing.TIERS[-1]


def packed(spark, docs, encoder, rows, **options):
    """Pieces per document, after checking ids, places and windows; returns windows by sequence."""
    found = packing.pack(docs, **options).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(Counter)
    for r in found:
        by_sequence[r["sequence_id"]].append(r)
        by_doc[r["doc_id"]][(r["start"], r["doc_tokens"], bytes(r["ids"]))] += 1
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += len(r["ids"]) // 4
        assert at <= pieces[0]["window"] and len({(r["window"], r["step"]) for r in pieces}) == 1
    texts = defaultdict(Counter)
    for r in rows:
        ids = [*encoder.encode(r[1] or "", add_special_tokens=False).ids, packing.CLOSING_ID]
        texts[r[0]][np.array(ids, "<u4").tobytes()] += 1
    for doc_id, copies in texts.items():
        total = Counter()
        for (start, tokens, ids), n in by_doc[doc_id].items():
            assert any(4 * tokens == len(t) and t[4 * start : 4 * start + len(ids)] == ids for t in copies)
            total["packed"] += n * len(ids)
        assert total["packed"] == sum(len(t) * n for t, n in copies.items())
        if sum(copies.values()) == 1:  # one row: the pieces in order are its ids
            (whole,) = copies
            assert b"".join(ids for _, _, ids in sorted(by_doc[doc_id])) == whole
    return by_sequence


def test_packing_keeps_all_ids(spark, encoder):
    rows = [(100 + i, corpus.prose(i, 20 + 37 * (i % 50)), "en", "s", 1) for i in range(160)]
    rows += [(1_000 + i, rows[3][1], "en", "s", 1) for i in range(80)] + corpus.ODD
    docs = corpus.frame(spark, rows, clashes=True).repartition(5)
    for options in ({}, {"block_tokens": 20_000}, {"block_tokens": 1}):
        sequences = packed(spark, docs, encoder, rows, **options)
        used = {s: sum(len(r["ids"]) // 4 for r in pieces) for s, pieces in sequences.items()}
        windows = {s: pieces[0]["window"] for s, pieces in sequences.items()}
        open_ = [s for s in used if used[s] < windows[s]]
        # Only the last window of a group of rests may be open.
        groups = max(1, -(-len(rows) * 4_096 // options.get("block_tokens", packing.BLOCK_TOKENS)))
        assert len(open_) <= groups and all(windows[s] == 4_096 for s in open_)
    assert set(windows.values()) <= set(packing.TIERS)


def test_packing_of_odd_tables(spark, encoder, tmp_path):
    assert packing.pack(corpus.empty(spark)).count() == 0
    only = packing.pack(corpus.frame(spark, [(1, None, None, None, None)])).collect()
    assert [(r["doc_id"], r["start"], bytes(r["ids"]), r["offset"]) for r in only] == [(1, 0, b"\2\0\0\0", 0)]
    pq.write_table(corpus.odd(spark).toArrow(), f"{tmp_path}/documents.parquet")
    rows = queries.op13_tier_packing(spark, str(tmp_path)).collect()
    whole = {i: [*encoder.encode(t or "", add_special_tokens=False).ids, 2] for i, t, *_ in corpus.ODD}
    assert all(r["doc_tokens"] == len(whole[r["doc_id"]]) for r in rows if r["doc_id"] not in (4, None))
    for r in rows:
        if r["doc_id"] not in (None,):
            ids = whole[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())

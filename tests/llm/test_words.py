"""BPE, language models, scores, licences and pages."""

import math
import os
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from abundex.llm import blocks, bpe, html_main, language, licences, ppm, queries
from abundex.llm.common import written
from tests.llm import corpus


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


TEXTS = [
    *[t for _, t, *_ in corpus.ODD],
    "don't I'LL we've 12 ½ \x85\xa0x", "\r\n\t\x0b\x0c ", "a<|endoftext|>b", "՘࢏ hello", "é \x1c\x1d x", "\x00a",
]


def test_tokens_are_the_librarys(spark, tokenizer):
    rows = [(i, t, None, None, 0) for i, t in enumerate(TEXTS)]
    got = {r["doc_id"]: r for r in queries.token_digests(corpus.frame(spark, rows, clashes=True)).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == corpus.sha(np.array(ids, dtype="<u4").tobytes())
        assert got[i]["decoded_sha256"] == corpus.sha(tokenizer.decode(ids, skip_special_tokens=False))
    assert queries.token_digests(corpus.empty(spark)).count() == 0
    assert queries.token_digests(corpus.odd(spark)).count() == len(corpus.ODD)


def test_small_blocks_give_the_same_ids(spark):
    rows = [(i, corpus.prose(i, 50), None, None, 0) for i in range(40)]
    docs = corpus.frame(spark, rows).repartition(3).cache()
    whole = sorted(map(tuple, bpe.encode(docs).collect()))
    assert sorted(map(tuple, bpe.encode(docs, block_chars=600).collect())) == whole


def test_decoding_replaces_broken_bytes(spark, tokenizer):
    ids = [[447], [50256, 198], []]
    rows = [(i, len(x), bytearray(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)]
    got = {r["doc_id"]: r["text"] for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, n_tokens long, ids binary")).collect()}
    assert [got[i] for i in range(3)] == [tokenizer.decode(x, skip_special_tokens=False) for x in ids]
    assert bpe.pieces(spark).count() == 50_257


def test_answers_that_miss_a_block_stop_the_job(spark):
    docs = corpus.frame(spark, [(1, "a b c", None, None, 0)]).select("doc_id", "text")
    words = blocks.block_words(docs, ppm.split_words).filter("number < 2").select("block", "number")
    bad = blocks.answered(blocks.block_sequences(docs, ppm.split_words), words, lambda t: None, "doc_id long")
    with pytest.raises(Exception, match="answers"):
        bad.collect()


def languages(n=60):
    alphabets = {"en": "thandering of", "de": "schüßenkeit ü", "fr": "éauleçtionè x"}
    rows = []
    for i in range(n):
        lang = ("en", "de", "fr")[i % 3]
        letters = alphabets[lang]
        words = [letters[(i + k) % 5 : (i + k) % 5 + 3 + k % 4].strip() for k in range(60)]
        rows.append((i, " ".join(words), lang, "s", 0))
    return rows


def test_languages_of_held_out_documents(spark):
    docs = corpus.frame(spark, languages() + [(100, "1 2 3", "en", "s", 0), (101, None, "de", "s", 0), (102, "unlabelled the", None, "s", 0)])
    model = language.train(docs.filter("doc_id % 4 != 1"))
    got = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang, *_ in languages())
    assert got[100]["lang_pred"] == got[101]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.predict(corpus.empty(spark), model).count() == 0
    assert language.predict(corpus.odd(spark), model).count() == len(corpus.ODD)


def test_a_text_that_most_rows_hold_is_fitted_on_few_of_them(spark, monkeypatch):
    text = corpus.prose(1, 30)
    rows = [(i, text, "x", "s", 0) for i in range(2000)] + [(9_999, text, "x", "s", 0)] * 500
    seen = []
    monkeypatch.setattr(language, "_calibrate", lambda model, found: seen.extend(found))
    language.train(corpus.frame(spark, rows), calibration_docs=250)
    assert 100 < len(seen) < 300


def test_no_labels_means_no_language(spark):
    docs = corpus.frame(spark, [(1, "some text", None, None, 0)])
    model = language.train(docs)
    assert [r["lang_pred"] for r in language.predict(docs, model).collect()] == ["und"]


def test_language_probabilities_add_up(spark):
    """Over all characters that a context may have, interpolated probabilities add up to one."""
    docs = corpus.frame(spark, [(i, corpus.prose(i, 50), "x", None, 0) for i in range(6)])
    model = language.Model.of(language.kneser_ney(language.gram_counts(docs)).toArrow())
    model.floor = 0.0
    scorer = language.Scorer(model)
    characters = sorted(set("".join(corpus.prose(i, 50).lower() for i in range(6))) - set(" \n"))
    first = math.exp(-float(scorer._word_costs([""])[0, 0]))
    total = first
    for c in characters:
        grams = [np.array([language._slot(g)]) for g in (c, language.EDGE + c)] + [np.array([0], np.int32)] * 2
        contexts = [np.array([0], np.int32), np.array([language._slot(language.EDGE)])] + [np.array([0], np.int32)] * 2
        total += math.exp(-float(model.gram_costs(np.array([2]), grams, contexts)[0, 0]))
    assert abs(total - 1) < 1e-3


def test_ngrams_do_not_share_entries(spark):
    """With 2^20 entries about a dozen of 5,000 n-grams met another one."""
    grams = [chr(0x4E00 + i % 71) + chr(0x5E00 + i // 71) for i in range(5_000)]
    assert len({language._slot(g) for g in grams}) == 5_000
    rows = [("zh", g, 1 + i % 3) for i, g in enumerate(language.EDGE + g for g in grams)]
    model = language.kneser_ney(spark.createDataFrame(rows, "lang string, gram string, n long"))
    for order in (2, 3):
        assert model.filter(f"order = {order} AND is_gram").select("slot").distinct().count() == 5_000


def test_block_takes_little_room_besides_its_sequences(monkeypatch):
    """A word is 4 bytes in its sequence; keys of 8 bytes, copies of them and the block before took over 24 more."""
    monkeypatch.setattr(blocks, "PACK_WORDS", 1 << 14)
    docs = type("Docs", (), {"mapInArrow": lambda self, run, schema: run})()
    run = blocks.block_contexts(docs, ppm.split_words, ppm.context_class, block_chars=700_000)
    texts = [" ".join(f"w{(i * k) % 97}" for k in range(1_000)) for i in range(1, 401)]
    rows = pa.RecordBatch.from_arrays(
        [pa.array(range(400)), pa.array(texts), pa.array([i % 10 > 0 for i in range(400)])], names=["doc_id", "text", "counted"]
    )
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        made = [sum(map(len, batch.column("lengths").drop_null().to_pylist())) for batch in run(iter([rows]))]
        taken = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert sum(made) == 400
    assert taken < 12 * 200_000


def test_distinct_numbers_by_parts(monkeypatch):
    monkeypatch.setattr(blocks, "PACK_WORDS", 5)
    parts = [np.array(part, np.int64) for part in ([3, 3, 1], [], [0, 7, 3, 7, 2], [9], [1 << 40, 0, 5])]
    assert blocks.distinct(parts).tolist() == [0, 1, 2, 3, 5, 7, 9, 1 << 40]
    assert blocks.distinct([]).tolist() == blocks.distinct([np.empty(0, np.int64)]).tolist() == []


def test_scores_by_brute_force(spark):
    rows = [(i, corpus.prose(i % 17, 60) + (" again and again" * (i % 3)), None, None, 0) for i in range(60)] + corpus.ODD[:6]
    docs = corpus.frame(spark, rows, clashes=True)
    got = sorted(map(tuple, ppm.score(docs, ~queries.held_out(10, 0)).collect()), key=str)
    lower = {c: c + 32 for c in range(65, 91)}
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, *_ in rows]
    tokens = [[*corpus.WORD.findall((t or "").translate(lower)), "\n"] for _, t, *_ in rows]
    seen = Counter(w for x, h in zip(tokens, held, strict=True) if not h for w in x)
    total, kinds = sum(seen.values()), len(seen)
    trie = [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]

    def places(word):
        context = b" "
        for byte in b"\n" if word == "\n" else (word + " ").encode():
            yield context[-ppm.ORDER :], byte
            context += bytes([byte])

    for word in seen:
        for context, byte in places(word):
            trie[len(context)][context][byte] += 1
    for size in range(ppm.ORDER - 1, -1, -1):
        for context, symbols in list(trie[size + 1].items()):
            for byte in symbols:
                trie[size][context[1:]][byte] += 1

    def byte_cost(context, byte):
        cost, excluded = 0.0, set()
        for size in range(len(context), -1, -1):
            table = trie[size].get(context[len(context) - size :])
            if table is None:
                continue
            open_ = {b: c for b, c in table.items() if b not in excluded}
            n = sum(open_.values())
            if byte in open_:
                return cost + math.log10((2 * open_[byte] - 1) / (2 * n))
            cost += math.log10(len(open_) / (2 * n)) if n else 0.0
            excluded |= set(table)
        return cost - math.log10(256 - len(excluded))

    def discount(counts):
        once, twice = (sum(c == n for c in counts) for n in (1, 2))
        return (once + 1) / (once + 2 * twice + 2)

    follows = defaultdict(Counter)
    for x, h in zip(tokens, held, strict=True):
        for before, word in zip([None, *x], x):  # noqa: B905
            if not h:
                follows[ppm.context_class(before.encode()) if before else 0][word] += 1
    less, pair_less = discount(seen.values()), discount([c for x in follows.values() for c in x.values()])

    def single(word):
        if seen[word]:
            return math.log10((seen[word] - less) / total)
        return math.log10(kinds * less / total) + sum(byte_cost(*p) for p in places(word))

    def token_cost(before, word):
        after = follows.get(ppm.context_class(before.encode()) if before else 0)
        if after is None:
            return single(word)
        n = sum(after.values())
        if word in after:
            return math.log10((after[word] - pair_less) / n)
        rest = 1 - sum((seen[w] - less) / total for w in after)
        return math.log10(len(after) * pair_less / n) + single(word) - math.log10(rest)

    want = []
    for (i, *_), words in zip(rows, tokens, strict=True):
        shown, score = Counter(), 0.0
        for k, word in enumerate(words):
            cost = token_cost(words[k - 1] if k else None, word)
            if k:
                escape = (sum(c == 1 for c in shown.values()) + 0.5) / (k + 1)
                cost += math.log10(escape)
                if shown[word]:
                    cost = math.log10((1 - escape) * shown[word] / k + 10**cost)
            score += cost
            shown[word] += 1
        base = sum(math.log10((seen[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in words)
        want.append((i, len(words), sum(seen[w] > 0 for w in words), total, base, score))
    in_blocks = sorted(map(tuple, ppm.score(docs, ~queries.held_out(10, 0), block_chars=2_000).collect()), key=str)
    for mine, parts in zip(got, in_blocks, strict=True):
        assert mine[:4] == parts[:4] and mine[4:] == pytest.approx(parts[4:], rel=1e-9)
    for mine, theirs in zip(got, sorted(want, key=str), strict=True):
        assert mine[:4] == theirs[:4]
        assert mine[4:] == pytest.approx(theirs[4:], rel=1e-9)
    assert ppm.score(corpus.empty(spark), F.lit(True)).count() == 0


def test_scoring_shuffles_a_class_with_its_count(spark, monkeypatch):
    """An answer is one list a word, and the costs, read once, are not written."""
    names, found = [], []
    monkeypatch.setattr(ppm, "written", lambda df, name: names.append(name) or written(df, name))
    monkeypatch.setattr(ppm, "answered", lambda s, a, f, schema: found.append(a) or blocks.answered(s, a, f, schema))
    docs = corpus.frame(spark, [(n, text, None, None, 0) for n, text in enumerate(("a b a", "b c", "", "a d"))])
    assert ppm.score(docs, F.col("doc_id") < 3).count() == 4
    assert found[-1].columns == ["block", "number", "value", "pairs"] and "ppm-costs" not in names


def test_keys_of_tokens():
    tokens = ["a", "\n", "wort", "gr\u00fc\u00dfe", "x" * 40, "\n"]
    want = []
    for token in tokens:
        text = b" " + (b"\n" if token == "\n" else (token + " ").encode())
        for k in range(1, len(text)):
            context = text[max(0, k - ppm.ORDER) : k]
            want.append((int.from_bytes(context, "big") << 3 | len(context)) << 8 | text[k])
    keys, lengths = ppm.token_keys([t.encode() for t in tokens])
    assert keys.tolist() == want and lengths.tolist() == [2, 1, 5, 8, 41, 1]
    assert [x.tolist() for x in ppm.token_keys([])] == [[], []]


def test_query_spells_every_token(spark, tmp_path, monkeypatch):
    """Tokens that training texts have are spelled too, and what each level leaves to its escape goes to the shorter one."""
    rows = [(i, corpus.prose(i % 17, 60) + (" again and again" * (i % 3)), None, None, 0) for i in range(60)] + corpus.ODD[:6]
    corpus.frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    names = []
    monkeypatch.setattr(ppm, "written", lambda df, name: names.append((name, written(df, name))) or names[-1][1])
    got = sorted(map(tuple, queries.op5_byte_ppm(spark, str(tmp_path)).drop("held_out").collect()), key=str)
    kept = {"ppm-blocks", "ppm-vocabulary", "ppm-spelled"}
    assert {name for name, _ in names} > kept
    cost = {r["word"]: r["cost"] / math.log(10) for name, df in names if name == "ppm-spelled" for r in df.collect()}
    lower = {c: c + 32 for c in range(65, 91)}
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, *_ in rows]
    tokens = [[*corpus.WORD.findall((t or "").translate(lower)), "\n"] for _, t, *_ in rows]
    assert set(cost) == {w for x in tokens for w in x}
    seen = Counter(w for x, h in zip(tokens, held, strict=True) if not h for w in x)
    total, kinds = sum(seen.values()), len(seen)
    trie = [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
    for word in seen:
        text = b" " + (b"\n" if word == "\n" else (word + " ").encode())
        for k in range(1, len(text)):
            context = text[max(0, k - ppm.ORDER) : k]
            trie[len(context)][context][text[k]] += 1
    for size in range(ppm.ORDER - 1, -1, -1):
        for context, symbols in list(trie[size + 1].items()):
            for byte in symbols:
                trie[size][context[1:]][byte] += 1
    for word in seen:
        # A token of the training texts has all its longest contexts in the trie.
        text, want = b" " + (b"\n" if word == "\n" else (word + " ").encode()), 0.0
        for k in range(1, len(text)):
            context = text[max(0, k - ppm.ORDER) : k]
            table = trie[len(context)][context]
            want += math.log10((2 * table[text[k]] - 1) / (2 * sum(table.values())))
        assert cost[word] == pytest.approx(want, rel=1e-9)

    def discount(counts):
        once, twice = (sum(c == n for c in counts) for n in (1, 2))
        return (once + 1) / (once + 2 * twice + 2)

    follows = defaultdict(Counter)
    for x, h in zip(tokens, held, strict=True):
        for before, word in zip([None, *x], x):  # noqa: B905
            if not h:
                follows[ppm.context_class(before.encode()) if before else 0][word] += 1
    less, pair_less = discount(seen.values()), discount([c for x in follows.values() for c in x.values()])

    def probability(before, word):
        found = (max(seen[word] - less, 0.0) + kinds * less * 10 ** cost[word]) / total
        if after := follows.get(ppm.context_class(before.encode()) if before else 0):
            found = (max(after[word] - pair_less, 0.0) + len(after) * pair_less * found) / sum(after.values())
        return found

    want = []
    for (i, *_), words in zip(rows, tokens, strict=True):
        shown, score = Counter(), 0.0
        for k, word in enumerate(words):
            found = probability(words[k - 1] if k else None, word)
            if k:
                escape = (sum(c == 1 for c in shown.values()) + 0.5) / (k + 1)
                found = (1 - escape) * shown[word] / k + escape * found
            score += math.log10(found)
            shown[word] += 1
        base = sum(math.log10((seen[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in words)
        want.append((i, len(words), sum(seen[w] > 0 for w in words), total, base, score))
    for mine, theirs in zip(got, sorted(want, key=str), strict=True):
        assert mine[:4] == theirs[:4] and mine[4:] == pytest.approx(theirs[4:], rel=1e-9)
    for before in [None, *list(seen)[:20]]:
        assert sum(probability(before, w) for w in cost) <= 1
    # What the trie was made from is gone, what is read later is not.
    for name, df in names:
        path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert os.path.exists(path) == (name in kept), name


def test_spelling_without_training_rows(spark):
    docs = corpus.frame(spark, [(1, "ab", None, None, 0), (2, None, None, None, 0)])
    assert sorted(ppm.score(docs, F.lit(False), spell=True).collect()) == sorted(ppm.score(docs, F.lit(False)).collect())
    assert ppm.score(corpus.empty(spark), F.lit(True), spell=True).count() == 0


def test_keys_are_cut_into_blocks(spark):
    words = [(w, n % 3) for n, w in enumerate(["\n", *sorted(f"w{n}" for n in range(2_500))])]
    tokens = spark.createDataFrame(words, "word string, c long").coalesce(1).cache()
    rows = ppm.block_keys(tokens, block_size=50).filter("packed IS NOT NULL").select("block", "doc_ids", "lengths").collect()
    assert len({r["block"] for r in rows}) > 1 and sorted(w for r in rows for w in r["doc_ids"]) == [w for w, _ in words]
    assert {w: n for r in rows for w, n in zip(r["doc_ids"], r["lengths"], strict=True)} == {
        w: len(w.encode()) + (w != "\n") for w, _ in words
    }


def test_scores_without_training_rows(spark):
    got = ppm.score(corpus.frame(spark, [(1, "ab", None, None, 0), (2, None, None, None, 0)]), F.lit(False)).collect()
    byte, escape = math.log10(1 / 256), math.log10(0.75)
    assert {r["doc_id"]: r["score"] for r in got} == pytest.approx({1: 4 * byte + escape, 2: byte})


def test_probabilities_of_different_texts_add_up_to_less_than_one(spark):
    """One beginning alone, and followed by each token that training texts have and one that they lack."""
    rows = [(i, corpus.prose(i, 30), None, None, 0) for i in range(5)]
    kinds = sorted({w for _, t, *_ in rows for w in corpus.WORD.findall(t.lower())})
    start = " ".join(kinds[:3] + kinds[:1])
    asked = [(100 + k, f"{start} {w}", None, None, 0) for k, w in enumerate([*kinds, "notseen"])] + [(99, start, None, None, 0)]
    got = {r["doc_id"]: r["score"] for r in ppm.score(corpus.frame(spark, rows + asked), F.col("doc_id") < 99).collect()}
    assert sum(10 ** got[100 + k] for k in range(len(asked) - 1)) + 10 ** got[99] < 1


def test_licences_in_prose(spark):
    apache = licences.TEMPLATES["Apache-2.0"][1]
    texts = [
        corpus.prose(1, 200) + " " + apache + " " + corpus.prose(2, 50) + " " + apache,
        corpus.prose(3, 100) + "\nLicensed under CC BY-NC 4.0.\n" + corpus.prose(4, 30),
        corpus.prose(5, 100),
        " ".join(w if k % 9 else "zzz" for k, w in enumerate(apache.split(), 1)),
        " ".join(reversed(apache.split())),
    ]
    docs = corpus.frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)], clashes=True)
    got = sorted((r["doc_id"], r["start"], r["licence"], round(r["coverage"], 2)) for r in licences.scan(docs).collect())
    assert [(i, name) for i, _, name, _ in got] == [(0, "Apache-2.0"), (0, "Apache-2.0"), (1, "CC-BY-NC-4.0"), (3, "Apache-2.0")]
    assert got[0][3] == got[2][3] == 1.0 and 0.8 <= got[3][3] < 1.0
    assert licences.scan(corpus.odd(spark)).count() == 0 and licences.scan(corpus.empty(spark)).count() == 0


def _found(text):
    scanner = licences.Scanner(licences.TEMPLATES, licences.MIN_COVERAGE)
    return [(name, round(coverage, 2)) for name, coverage, *_ in scanner.scan(text)]


def test_every_template_is_its_own_licence():
    for name, texts in licences.TEMPLATES.items():
        for text in texts:
            assert (name, 1.0) in _found(corpus.prose(1, 40) + "\n" + text + "\n" + corpus.prose(2, 40)), text
            assert {found for found, _ in _found(text)} == {name}, text


def test_longer_names_are_other_licences():
    gpl, agpl = licences.TEMPLATES["GPL-3.0"][1], licences.TEMPLATES["AGPL-3.0"][1]
    assert _found(agpl) == [("AGPL-3.0", 1.0)] and _found(gpl) == [("GPL-3.0", 1.0)]
    assert _found(licences.TEMPLATES["LGPL-2.1"][0]) == [("LGPL-2.1", 1.0)]
    assert _found(licences.TEMPLATES["BSD-3-Clause"][0]) == [("BSD-3-Clause", 1.0)]
    assert _found(licences.TEMPLATES["BSD-2-Clause"][0]) == [("BSD-2-Clause", 1.0)]
    ((name, coverage, purity, *_),) = licences.Scanner({"GPL-3.0": (gpl,)}, 0.8).scan(agpl)
    assert name == "GPL-3.0" and coverage == 1.0 and purity < 1.0


def test_whole_licences_and_their_parts():
    whole = licences.TEMPLATES["MIT"][-1]
    text = corpus.prose(7, 60) + "\n" + whole + "\n" + corpus.prose(8, 60)
    scanner = licences.Scanner(licences.TEMPLATES, 0.8)
    ((name, coverage, purity, start, end),) = scanner.scan(text)
    assert (name, coverage, purity) == ("MIT", 1.0, 1.0) and whole.startswith(text[start : end - 1])
    assert _found(whole[len(whole) // 2 :]) and {n for n, _ in _found(whole[len(whole) // 2 :])} == {"MIT"}


def test_a_licence_with_other_words_inside():
    notice = licences.TEMPLATES["GPL-3.0"][1].split()
    inserted = " ".join(notice[:20]) + " " + " ".join(f"zz{i}" for i in range(40)) + " " + " ".join(notice[20:])
    ((name, coverage, purity, *_),) = licences.Scanner(licences.TEMPLATES, 0.8).scan(inserted)
    assert name == "GPL-3.0" and coverage == 1.0 and 0.5 < purity < 0.6


def test_a_text_of_many_notices_takes_time_in_proportion():
    import time

    line = "Licensed under the MIT License. " + corpus.prose(9, 12) + "\n"
    started = time.monotonic()
    assert len(_found(line * 10_000)) == 10_000
    assert time.monotonic() - started < 30


def test_patience_alignment_keeps_order():
    pairs = licences.align("x a b c y d e z".split(), "a b q c d e".split())
    assert pairs == [(1, 0), (2, 1), (3, 3), (5, 4), (6, 5)]


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h2>Site</h2></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies here today</div>
<main><article class="post has-sidebar"><header><h1>Big &amp; bold</h1></header><p>First <b>par</b>agraph of
the&nbsp;text.</p><div class="ad-box">Buy now</div><p>Second one<br>goes on.<script>x="</p>"</script></p>
<form><label>Mail</label></form><section id="comments"><p>Nice post!</p></section></article></main>
<aside>Related things</aside><footer>&copy; Site</footer></body></html>"""


def test_main_text_without_the_rest(spark):
    pages = [(i, f"u{i}", PAGE) for i in range(12)] + [(20, None, None), (None, "u", ""), (21, "u", "plain words only"), (22, "u", "<p>open <div class=")]
    docs = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {r["page_id"]: r for r in html_main.main_texts(docs).collect()}
    want = "Big & bold First paragraph of the text. Second one goes on."
    assert got[3]["text"] == want and got[3]["n_chars"] == len(want)
    assert got[20]["text"] == "" and got[None]["text"] == "" and got[21]["text"] == "plain words only"
    assert html_main.main_texts(docs.limit(0)).count() == 0


def test_pages_without_content_elements_use_the_learned_weights(spark):
    page = PAGE.replace("<article class=\"post has-sidebar\">", "<div>").replace("</article>", "</div>").replace("main>", "div>")
    labelled = spark.createDataFrame([(i, "u", PAGE) for i in range(20)], "page_id long, url string, html string")
    text = html_main.extract(page, html_main.weights(labelled))
    assert "First paragraph of the text. Second one goes on." in text
    assert not any(x in text for x in ("Home", "cookies", "Buy now", "Nice post", "Related", "©"))


def test_best_region_by_brute_force():
    import random

    draw = random.Random(5)
    for size in [0, 1, 2, *[draw.randrange(3, 25) for _ in range(300)]]:
        scores = [draw.randrange(-3, 4) for _ in range(size)]
        regions = [(-sum(scores[a:b]), b, -a) for b in range(1, size + 1) for a in range(b) if sum(scores[a:b]) > 0]
        _, stop, start = min(regions, default=(0, 0, 0))
        assert html_main.best_region(scores) == (-start, stop)


@pytest.mark.parametrize(
    "piece", ["<a ", '<p title="x ', "<! ", "<!-- ", "<p title='a\" ", "<div>", "</p>", "<b><p>", "<", "a<b ", '<a b="'],
)
def test_broken_pages_take_time_in_proportion(piece):
    import time

    page = "<main><p>first words here</p>" + piece * ((1 << 20) // len(piece))
    for end in ("", ">", "'>", '">'):
        start = time.process_time()
        html_main.extract(page + end, {})
        assert time.process_time() - start < 6


def test_what_is_no_tag_is_text():
    assert html_main.extract("<p>if a < b and <3 then c<d", {}) == "if a < b and <3 then c<d"
    assert html_main.extract('<p>x <a title="> y', {}) == 'x <a title="> y'
    assert html_main.extract("<p>x <!-- y", {}) == "x"
    assert html_main.extract("<p>x <?php y ?>z", {}) == "x z"


def test_weights_of_a_page_do_not_jump_with_the_number_of_pages(spark):
    def found(n):
        pages = spark.createDataFrame([(i, "u", PAGE) for i in range(n)], "page_id long, url string, html string")
        return html_main.weights(pages)

    nine, ten = found(9), found(10)
    assert nine.keys() == ten.keys()
    assert all(abs(nine[k] - ten[k]) < 0.3 for k in nine)


def test_temperature_and_limits_come_from_all_labelled_rows(spark, monkeypatch):
    """More rows than the sample once had room for; each is scored, and the fit is that of a list of all of them."""
    rows = [(i, *row[1:]) for i, row in enumerate(languages() * 3)] + [(7_000, "1 2", "en", "s", 0)]
    docs = corpus.frame(spark, rows + rows[:40])
    fit, seen = language._calibrate_all, []
    monkeypatch.setattr(language, "_calibrate_all", lambda model, found: (seen.extend(found.collect()), fit(model, found)))
    model = language.train(docs)
    assert len(seen) == len(rows)
    whole = language.Model(model.langs, model.tables)
    language._calibrate(whole, seen)
    assert whole.temperature == model.temperature and whole.limits.keys() == model.limits.keys() != set()
    for lang, limits in whole.limits.items():
        assert np.allclose(limits, model.limits[lang], rtol=1e-9)

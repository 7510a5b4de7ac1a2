"""Exact copies, near copies and repeated passages against the plain way."""

import random
from collections import Counter, defaultdict

import numpy as np

from abundex.llm import exact, simhash, spans
from abundex.llm.components import components
from tests.llm import corpus


def test_exact_groups_of_odd_rows(spark):
    rows = exact.exact_groups(corpus.odd(spark), bucket_bytes=2_000).collect()
    sizes = Counter(corpus.norm(t) for _, t, *_ in corpus.ODD)
    assert sorted(r["group_size"] for r in rows) == sorted(sizes[corpus.norm(t)] for _, t, *_ in corpus.ODD)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[4]["keep_id"] == 8 and not by_id[4]["kept"] and by_id[8]["kept"]
    assert by_id[3]["keep_id"] == 3 and by_id[2]["keep_id"] == 3
    assert by_id[1]["text_sha256"] == corpus.sha("")
    assert exact.exact_groups(corpus.empty(spark)).count() == 0


def test_directory_splits_overfull_buckets_only(spark):
    keys = [((k * 37) << 46, 100) for k in range(60)] + [(-(k + 1) << 58, 100) for k in range(30)] + [(-5, 5_000)]
    starts = exact.directory(spark.createDataFrame(keys, "key long, bytes long"), bucket_bytes=1_000)
    held = defaultdict(list)
    for k, b in keys:
        held[max(s for s in starts if s <= k % (1 << 64))].append(b)
    assert all(sum(b) <= 1_000 or sum(b) == max(b) for b in held.values())
    assert 9 <= len(held) <= 24


def test_equal_keys_are_told_apart_by_their_bytes():
    chains = exact._Chains()
    for doc_id, norm in enumerate(["aa", "bb", "aa", "cc"]):
        chains.add(7, norm, norm, 1, 2, doc_id)
    assert [(e[2], e[3], e[5]) for e in chains.drain()] == [("aa", 2, 0), ("bb", 1, 1), ("cc", 1, 3)]


def test_drop_copies_keeps_one_row_with_its_columns(spark):
    docs = corpus.odd(spark)
    kept = exact.drop_copies(docs, bucket_bytes=2_000)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(corpus.norm(r["text"]) for r in rows) == sorted({corpus.norm(t) for _, t, *_ in corpus.ODD})
    assert all(r["size"] == "extra" for r in rows)


def test_any_five_positions_contain_a_key():
    from itertools import combinations

    sets = [set(s) for s in simhash.position_sets()]
    assert all(any(s <= set(five) for s in sets) for five in combinations(range(8), 5))


def linked(values, limit=3):
    """Components by comparing all pairs."""
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if bin((a ^ values[j]) & (2**64 - 1)).count("1") <= limit:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(values))]


def test_fingerprints_and_components_by_brute_force(spark):
    import xxhash

    texts = [corpus.prose(i, 60) for i in range(30)]
    texts += [t.replace(".", "", 1) for t in texts[:10]] + [texts[0].upper(), "two words", "two words", "", None, "lone"]
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]

    def fingerprint(text):
        words = corpus.WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        runs = [words[i : i + 3] for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    want = [fingerprint(t) for t in texts]
    got = {r["doc_id"]: r for r in simhash.near_groups(corpus.frame(spark, rows, clashes=True)).collect()}
    assert [got[i]["fp"] % 2**64 for i in range(len(texts))] == want
    assert [got[i]["component_id"] for i in range(len(texts))] == linked(want)
    assert simhash.near_groups(corpus.empty(spark)).count() == 0
    assert simhash.near_groups(corpus.odd(spark)).count() == len(corpus.ODD)


def test_long_lists_are_cut_without_losing_links():
    rng = random.Random(3)
    base = rng.getrandbits(64)
    values = sorted({base ^ sum(1 << rng.randrange(0, 40) for _ in range(rng.randint(0, 6))) for _ in range(700)})
    pairs = simhash.connect(np.array(values, dtype=np.uint64), short=16)
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        assert bin(a ^ b).count("1") <= 40
        parent[max(root(a), root(b))] = min(root(a), root(b))
    want = linked(values)
    groups = defaultdict(set)
    for v, g in zip(values, want, strict=True):
        groups[g].add(root(v))
    assert all(len(g) == 1 for g in groups.values()) and len({root(v) for v in values}) == len(set(want))


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 101 + i) for i in range(50)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain + star, "u long, v long")).collect()}
    assert {found[i] for i in range(41)} == {0} and {found[i] for i in range(100, 151)} == {100}


def fingerprint_components(texts):
    """The least place reachable over fingerprints that differ in three bits or fewer."""
    return linked([simhash.fingerprint(t, 3) % 2**64 for t in texts])


def test_long_lists_are_cut_by_a_further_shuffle(spark):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    # A third of a table as variants of one text: few bits of half the fingerprint change.
    values = {base ^ sum(1 << rng.randrange(0, 34) for _ in range(rng.randint(0, 7))) for _ in range(500)}
    values = sorted(values | {rng.getrandbits(64) for _ in range(200)})
    nodes = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in values], "fp long")
    want = linked(values)
    for longest in (20, 200, simhash.LONG_LIST):
        found = simhash.links(nodes.repartition(3), longest).collect()
        place = {v: i for i, v in enumerate(values)}
        root = list(range(len(values)))

        def top(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for u, v in found:
            a, b = top(place[u % 2**64]), top(place[v % 2**64])
            root[max(a, b)] = min(a, b)
        assert [top(i) for i in range(len(values))] == want


def test_near_copy_stage_keeps_one_of_each_group(spark):
    texts = [corpus.prose(i, 200, vocabulary=3_000) for i in range(12)]
    copies = [" ".join(w if k != 50 + n else "changed" for k, w in enumerate(t.split())) for n, t in enumerate(texts[:4])]
    hot = [texts[5] + " " * n + "tail" * (n % 3) for n in range(30)]
    texts += copies + hot + ["", "few words", "FEW words"]
    docs = corpus.frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)], clashes=True)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    want = fingerprint_components(texts)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))
    assert simhash.drop_near_copies(corpus.empty(spark)).count() == 0


def test_similar_groups_keep_one_row_each(spark):
    texts = [corpus.prose(i, 200, vocabulary=3_000) for i in range(12)]
    copies = [" ".join(w if k != 50 + n else "changed" for k, w in enumerate(t.split())) for n, t in enumerate(texts[:4])]
    docs = corpus.frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts + copies)], clashes=True)
    kept = simhash.drop_similar(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(12))
    assert simhash.drop_similar(corpus.empty(spark)).count() == 0


def similar_components(sets):
    """Components over all pairs with a Jaccard similarity of 0.8 or more."""
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(sets))]


def shingled(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_copies_by_brute_force_around_the_limit(spark):
    rng, texts = random.Random(5), []
    for i in range(60):  # tails of new words: similarities of 0.7 to 0.92
        words = corpus.prose(i, 90 + i, vocabulary=3_000).split()
        n = rng.randint(4, len(words) // 5)
        texts += [" ".join(words), " ".join(words[: len(words) - n] + [f"new{i}x{k}" for k in range(n)])]
    near = [len(a & b) / len(a | b) for a, b in zip(map(shingled, texts[::2]), map(shingled, texts[1::2]), strict=True)]
    assert sum(0.8 <= s < 0.86 for s in near) >= 5 and sum(0.7 <= s < 0.8 for s in near) >= 5
    texts += ["", "few words", "FEW words"]
    docs = corpus.frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    assert [got[i] for i in range(len(texts))] == similar_components([shingled(t) if t else {""} for t in texts])


def test_long_lists_of_near_copies_are_compared_in_full(spark):
    rng, base = random.Random(6), list(range(100))
    sets = [{0, 1}]
    for n in range(90):  # one text with some shingles changed, so that many pairs are below the limit
        changed = set(rng.sample(base, rng.randint(0, 14)))
        sets.append({x for x in base if x not in changed} | {1_000 * n + 1_000 + x for x in changed})
    hashed = [np.array(sorted(x * 0x9E3779B97F4A7C15 % 2**64 for x in s), np.uint64).tobytes() for s in sets]
    rows = [(i, bytearray(h)) for i, h in enumerate(hashed)] + [(3, bytearray(hashed[3]))] * 30
    frame = spark.createDataFrame(rows, "id long, hashes binary")
    want = similar_components(sets)
    assert len(set(want)) > 3
    for rounds in (0, 2):
        found = {r["node"]: r["root"] for r in simhash.similar_roots(frame, longest=8, rounds=rounds, strip=16).collect()}
        assert [found.get(i, i) for i in range(len(sets))] == want


def test_repeated_passages_by_brute_force(spark):
    passage = corpus.prose(99, 60)
    texts = [corpus.prose(i, 80) for i in range(12)]
    for i in (2, 5, 9):
        texts[i] = texts[i] + " " + passage + " " + corpus.prose(200 + i, 30)
    texts.append(passage + "\n" + passage)
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)] + corpus.ODD
    rows = [r for r in rows if r[0] != 7 or r[1].startswith("one") is False]
    got = {(r["doc_id"], r["n_sentences"]): r for r in spans.dedup(corpus.frame(spark, rows, clashes=True)).collect()}
    count, first = Counter(), {}
    parts = {}
    for k, (i, t, *_) in enumerate(rows):
        bounds = spans.sentences(t or "")
        parts[k] = (bounds, list(spans.spans(t or "", bounds)))
        for _, _, digest in parts[k][1]:
            count[digest] += 1
            first[digest] = min(first.get(digest, 1 << 63), (1 << 63) - 1 if i is None else i)
    for k, (i, t, *_) in enumerate(rows):
        bounds, found = parts[k]
        covered, seen = set(), set()
        for a, b, digest in found:
            if count[digest] > 1 and (first[digest] != i or digest in seen):
                covered |= set(range(a, b + 1))
            seen.add(digest)
        assert got[i, len(bounds)]["n_removed"] == len(covered)
    assert passage in got[2, len(parts[2][0])]["text"]
    assert all(passage not in r["text"] for (i, _), r in got.items() if i in (5, 9))
    assert spans.dedup(corpus.empty(spark)).count() == 0


def test_single_short_sentences_are_left(spark):
    rows = [(i, "Les. Es. " + corpus.prose(i, 40), None, None, 0) for i in range(6)]
    assert all(r["n_removed"] == 0 for r in spans.dedup(corpus.frame(spark, rows)).collect())


def test_no_sentence_of_a_repeated_passage_is_left(spark):
    rng = random.Random(8)
    shapes = [[12, 12, 12, 12, 7], [45, 30], [39, 1], [40], [3] * 9, [41, 5, 5]]
    shapes += [[rng.randint(1, 45) for _ in range(rng.randint(2, 6))] for _ in range(30)]
    shapes = [s for s in shapes if sum(s) >= spans.WORDS and (len(s) > 1 or sum(s) >= spans.LONG_SENTENCE)]

    def passage(name, sizes):
        return [" ".join(f"{name}s{k}w{i}" for i in range(n)) + "." for k, n in enumerate(sizes)]

    rows, planted = [], {}
    for p, shape in enumerate(shapes):
        for copy in range(2):
            doc = 2 * p + copy
            around = [passage(f"d{doc}{side}", [rng.randint(1, 30) for _ in range(3)]) for side in "ab"]
            rows.append((doc, " ".join(around[0] + passage(f"p{p}", shape) + around[1]), None, None, 0))
            planted[doc] = (len(shape), " ".join(passage(f"p{p}", shape)))
    got = {r["doc_id"]: r for r in spans.dedup(corpus.frame(spark, rows)).collect()}
    for doc, (n, text) in planted.items():
        assert got[doc]["n_removed"] == (n if doc % 2 else 0)
        assert (text in got[doc]["text"]) == (doc % 2 == 0)

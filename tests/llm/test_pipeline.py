"""The pipeline against a plain version on a small corpus."""

import hashlib
import math
from collections import defaultdict

import pyarrow.parquet as pq

import corpus_pipeline
from abundex.llm import bpe, mixing
from abundex.llm.sql import SQL
from tests.llm import corpus
from tests.llm.test_copies import fingerprint_components
from tests.oracle import database


def test_stages_and_columns(spark, tmp_path):
    texts = [corpus.prose(i, 150, vocabulary=2_000) for i in range(30)]
    rows = [(1000 + i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    rows += [(2000 + i, texts[i] + " \n", "en", "s0", 1) for i in range(3)]  # exact copies that are longer
    rows += [(3000 + i, texts[10 + i].replace(" ", " changed ", 1), "en", "s1", 1) for i in range(3)]  # near copies
    rows += [(4000, "word### more*** " * 60, "en", "s1", 1), *corpus.ODD]
    folder = str(tmp_path)
    pq.write_table(corpus.frame(spark, rows).toArrow(), f"{folder}/documents.parquet")

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
    got = corpus_pipeline.run(spark, folder).collect()

    con = database(folder)
    clean = {r[0] for r in con.execute(f"SELECT doc_id FROM ({SQL['op8_rule_ledger']}) WHERE kept").fetchall()}
    left = {i: (t, s) for i, t, _, s, _ in rows if i in clean}
    first = {}
    for i in sorted(left, key=lambda i: (-len(left[i][0]), i)):
        first.setdefault(corpus.norm(left[i][0]), i)
    left = {i: left[i] for i in first.values()}
    ids = sorted(left)
    components = fingerprint_components([left[i][0] for i in ids])
    left = {ids[k]: left[ids[k]] for k in set(components)}
    assert len(left) < len(ids)
    copies = mixed(left)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.vocabulary_path())
    want = [(i, len(tokenizer.encode(left[i][0]).ids), corpus.sha(left[i][0])) for i, n in copies.items() for _ in range(n)]
    assert sorted((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in got) == sorted(want)


def test_an_empty_table_and_a_hot_group(spark, tmp_path):
    pq.write_table(corpus.empty(spark).toArrow(), f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    text = corpus.prose(1, 160, vocabulary=2_000)
    rows = [(i, text + " " * (i % 3), "en", "hot", 1) for i in range(60)]
    rows += [(100 + i, corpus.prose(50 + i, 160, vocabulary=2_000), "en", f"s{i % 3}", 1) for i in range(30)]
    folder = tmp_path / "hot"
    folder.mkdir()
    pq.write_table(corpus.frame(spark, rows, clashes=True).toArrow(), f"{folder}/documents.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(folder)).collect()}
    assert len(got & set(range(60))) <= 1 and len(got) > 15


def mixed(left):
    """Copies of each document by the rule of the mix."""
    sizes = {i: len(corpus.WORD.findall(t)) for i, (t, _) in left.items()}
    sources = defaultdict(list)
    for i in sorted(left, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)):
        sources[left[i][1]].append(i)
    total = sum(sizes.values())
    weights = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sorted(sources))}
    size = {s: sum(sizes[i] for i in ids) for s, ids in sources.items()}
    full = {}
    while True:
        open_ = {s: w for s, w in weights.items() if s not in full}
        rest = total - sum(full.values())
        target = {s: rest * w / sum(open_.values()) for s, w in open_.items()}
        above = {s: 3 * size[s] for s in target if target[s] > 3 * size[s]}
        if not above:
            target |= full
            break
        full |= above
    out = {}
    for s, ids in sources.items():
        offset = 0
        for i in ids:
            out[i] = sum(offset + k * size[s] + sizes[i] / 2 <= target[s] for k in range(3))
            offset += sizes[i]
    assert all(math.isfinite(t) for t in target.values())
    return out

"""Rule ledger and mixing: odd rows, policies, ablations, targets."""

from collections import defaultdict

from pyspark.sql import functions as F

from abundex.llm import mixing, queries, rules
from tests.llm import corpus


def test_odd_rows_have_one_ledger_entry_each(spark):
    rows = rules.ledger(corpus.odd(spark)).collect()
    assert len(rows) == len(corpus.ODD)
    for row in rows:
        words = next(len(corpus.WORD.findall(t or "")) for i, t, *_ in corpus.ODD if i == row["doc_id"] and len(corpus.WORD.findall(t or "")) == row["n_words"])
        assert row["n_words"] == words
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[7]["n_repeat_words"] == 12_000
    assert by_id[1]["failures"] & 1 and by_id[6]["word_chars"] == 50_000
    assert rules.ledger(corpus.empty(spark)).count() == 0


def test_repeated_windows_count_each_word_once(spark):
    text = "a b c d a b c x y z a b c q"
    row = rules.ledger(corpus.frame(spark, [(1, text, None, None, 0)])).first()
    assert row["n_repeat_words"] == 9
    row = rules.ledger(corpus.frame(spark, [(1, "z z z z z", None, None, 0)])).first()
    assert row["n_repeat_words"] == 5


def test_policy_keeps_columns_and_clean_documents(spark):
    good = [(i, corpus.prose(i, 120), "en", "a", 1) for i in range(5)]
    junk = [(10, "word*** and### more$$$ " * 40, "en", "a", 1), (11, "SHOUT!! LOUD!! " * 60, "en", "a", 1)]
    docs = corpus.frame(spark, good + junk + corpus.ODD, clashes=True)
    kept = rules.apply_policy(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 4]


def test_ablations_from_bits_alone(spark):
    entries = spark.createDataFrame([(0,), (1,), (1,), (3,), (4,)], "failures long")
    found = {(r["version"], r["rule"]): (r["failed"], r["only_this"]) for r in rules.ablations(entries).collect()}
    assert found[1, "few_words"] == (3, 2)
    assert found[1, "repeated_windows"] == (1, 0)
    assert found[2, "symbols"] == (1, 1)


def reshared(sizes, weights):
    """Targets by resharing the excess until none is above three times its source's size."""
    total, full = sum(sizes.values()), {}
    while True:
        left = total - sum(full.values())
        open_ = {s: w for s, w in weights.items() if s not in full}
        targets = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        above = {s: 3 * sizes[s] for s, t in targets.items() if t > 3 * sizes[s]}
        if not above:
            return {**full, **targets}
        full |= above


def test_targets_stop_at_three_times_the_size(spark):
    rows = [(i, "w " * (5 if i % 3 else 400), None, f"s{i % 5}" if i % 5 else None, 0) for i in range(60)]
    docs = corpus.frame(spark, rows)
    got = mixing.plan(docs).select("size", "source_size", "target", "taken").collect()
    sizes = defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += len(text.split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = reshared(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    assert {(r["source_size"], round(r["target"], 6)) for r in got} == {(sizes[s], round(t, 6)) for s, t in want.items()}
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert abs(sum(r["target"] for r in {r["source_size"]: r for r in got}.values())) > 0


def test_a_hot_source_is_cut_into_slices_without_changing_the_order(spark, monkeypatch):
    rows = [(i, "w " * (i % 17 + 1), None, "hot" if i % 3 else f"s{i % 7}", 0) for i in range(500)]
    docs = corpus.frame(spark, rows)
    whole = sorted(map(tuple, mixing.plan(docs).select("doc_id", "taken").collect()))
    monkeypatch.setattr(mixing, "SLICE_DOCS", 20)
    assert sorted(map(tuple, mixing.plan(docs).select("doc_id", "taken").collect())) == whole
    taken = sum(t for _, t in whole)
    assert abs(taken - sum(i % 17 + 1 for i in range(500))) <= 8 * 9


def test_positions_follow_the_schedule(spark):
    rows = [(i, "w " * 10, None, ("a", "b", "c")[i % 3], 0) for i in range(300)]
    got = mixing.plan(corpus.frame(spark, rows), carry=("source",)).collect()
    for source, late in (("a", True), ("c", False)):
        times = [t for r in got if r["source"] == source for t in r["positions"]]
        assert all(0 <= t <= 1 for t in times)
        assert (sum(t > 0.5 for t in times) > len(times) / 2) == late


def test_mix_repeats_rows_and_keeps_columns(spark):
    docs = corpus.odd(spark)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    planned = mixing.plan(docs).collect()
    assert mixed.count() == sum(r["copies"] for r in planned)
    assert all(r["taken"] == 0 for r in planned if r["size"] == 0)
    assert mixing.mix(corpus.empty(spark)).count() == 0


def test_the_query_reads_the_training_order(spark, monkeypatch, tmp_path):
    """Copies are numbered in order of position; what the order lacks is not taken."""
    rows = [(i, "w " * (i % 9), None, f"s{i % 4}", 0) for i in range(300)] * 2
    docs = corpus.frame(spark, rows)
    planned = mixing.plan(docs).collect()
    copies = mixing.plan(docs).select("doc_id", F.posexplode("positions").alias("_copy", "_at"))
    placed = sorted(mixing.training_order(copies.repartition(7)).collect(), key=lambda r: r["place"])
    assert [r["place"] for r in placed] == list(range(sum(r["copies"] for r in planned)))
    assert [r["_at"] for r in placed] == sorted(t for r in planned for t in r["positions"])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op3_curriculum_mix(spark, str(tmp_path)).collect()
    want = [(r["doc_id"], r["size"], r["taken"], r["positions"][0] if r["positions"] else None) for r in planned]
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["size"], r["taken"], r["first_position"])) for r in got)
    whole = mixing.training_order
    monkeypatch.setattr(mixing, "training_order", lambda copies: whole(copies).filter("place < 10"))
    short = queries.op3_curriculum_mix(spark, str(tmp_path)).collect()
    assert len(short) == 600 and sum(r["taken"] / r["size"] for r in short if r["taken"]) == 10

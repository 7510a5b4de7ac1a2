"""Language identification by interpolated Kneser-Ney character models.

One model per language is counted on labelled documents: for words with a mark on either side,
how often each character follows its last one to three characters. The highest order uses
counts, lower orders the number of different characters before (Kneser-Ney), with absolute
discounts estimated from counts of one and two. What a model says about an n-gram is stored in
sorted arrays of 64-bit hashes that are searched by bisection.

A text's cross-entropy per character is taken under every language; the lowest one is the
prediction. Its score is the posterior over languages at a temperature fitted on all labelled
documents, and a prediction is rejected if the score, or the cross-entropy against that of the
language's own documents, falls outside of what 99% of them have. Rejection is a column of its
own.

Every n-gram keeps its own 64-bit key, so no n-gram has the probability of another one. The model
has one entry per different n-gram and context and is held whole by the driver and each worker.

Defined results: a null text or one without a letter is ``und`` with score 0; a text whose
n-grams are all unseen gets the language with the lowest floor; rows without label, or with a
null label, are not learned from; without any learned language every row is ``und``; repeated
rows count each time; other columns do not matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abundex.functions.quantiles import group_quantiles
from abundex.llm.common import as_batch, map_rows, written

ORDER = 4
EDGE = "\x02"
CACHE_WORDS = 1 << 19
TEMPERATURES = tuple(2.0**k for k in range(-3, 7))
UNKNOWN = "und"


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _rolled(characters: np.ndarray) -> list[np.ndarray]:
    """For n = 1, 2, ...: the 64-bit hash of the n characters that end at each place."""
    hashes = [(characters + np.uint64(1)) * _FACTOR]
    for _ in range(1, ORDER):
        before = np.concatenate([np.zeros(1, np.uint64), hashes[-1][:-1]])
        hashes.append((before ^ (before >> np.uint64(29))) * _FACTOR + characters + np.uint64(1))
    return hashes


def _slots(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def _characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _slot(gram: str) -> int:
    """The key of one n-gram."""
    if not gram:
        return 0
    return int(_slots(_rolled(_characters(gram))[len(gram) - 1][-1:])[0])


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): n-grams of the highest order that fits each character, over all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter[str]] = {}
        schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])

        def drain() -> Iterator[pa.RecordBatch]:
            for lang, counted in words.items():
                grams: Counter[str] = Counter()
                for word, n in counted.items():
                    marked = EDGE + word + EDGE
                    for i in range(1, len(marked)):
                        grams[marked[max(0, i - ORDER + 1) : i + 1]] += n
                rows = [(lang, g, n) for g, n in grams.items()]
                for k in range(0, len(rows), 16_384):
                    yield as_batch(rows[k : k + 16_384], schema)
            words.clear()

        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words.setdefault(lang, Counter()).update(text.lower().split())
            if sum(map(len, words.values())) > CACHE_WORDS:
                yield from drain()
        yield from drain()

    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    return labelled.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(grams: DataFrame) -> DataFrame:
    """(lang, order, slot, is_gram, value): smoothed probabilities and what is left to lower orders.

    The value is the discounted share of an n-gram or, on the row of a context, the mass handed
    to the next lower order. Lower orders count different left neighbours. An n-gram that
    begins with the word's edge has no left neighbour and keeps its own count, as usual.
    """
    size = F.char_length("gram")
    edge = F.substring("gram", 1, 1) == EDGE
    level = grams.withColumn("order", size.cast("int"))
    whole = level.filter((F.col("order") == ORDER) | edge)
    levels = [level.filter(F.col("order") == ORDER).select("lang", "gram", F.col("n").cast("double").alias("c"))]
    for order in range(ORDER - 1, 0, -1):
        longer = levels[-1]
        kept = whole.filter(F.col("order") == order).select("lang", "gram", F.col("n").cast("double").alias("c"))
        suffix = longer.select("lang", F.expr("substring(gram, 2)").alias("gram"), F.lit(1.0).alias("c"))
        counted = kept.union(suffix).groupBy("lang", "gram").agg(F.sum("c").alias("c"))
        levels.append(written(counted, "language-level"))
    out = None
    for order, counts in zip(range(ORDER, 0, -1), levels, strict=True):
        ones = F.sum(F.when(F.col("c") == 1, 1.0).otherwise(0.0))
        twos = F.sum(F.when(F.col("c") == 2, 1.0).otherwise(0.0))
        discount = counts.groupBy("lang").agg(
            F.least(F.lit(0.9), F.greatest(F.lit(0.1), F.coalesce(F.try_divide(ones, ones + 2 * twos), F.lit(0.5)))).alias("d")
        )
        context = F.expr("substring(gram, 1, char_length(gram) - 1)")
        totals = counts.groupBy("lang", context.alias("context")).agg(
            F.sum("c").alias("total"), F.count("*").cast("double").alias("kinds")
        )
        full = counts.withColumn("context", context).join(totals, ["lang", "context"]).join(discount, "lang")
        rows = full.select(
            "lang", F.lit(order).alias("order"), "gram", ((F.col("c") - F.col("d")) / F.col("total")).alias("p")
        ).withColumn("backoff", F.lit(None).cast("double"))
        left = totals.join(discount, "lang").select(
            "lang",
            F.lit(order).alias("order"),
            F.col("context").alias("gram"),
            F.lit(None).cast("double").alias("p"),
            (F.col("d") * F.col("kinds") / F.col("total")).alias("backoff"),
        )
        part = written(rows.union(left), "language-order")
        out = part if out is None else out.union(part)
    return map_rows(
        out,
        lambda: lambda lang, order, gram, p, left: [(lang, order, _slot(gram), p is not None, left if p is None else p)],
        "lang string, order int, slot long, is_gram boolean, value double",
    )


class Model:
    """Per language and order: sorted keys with probabilities, and sorted contexts with backoffs."""

    def __init__(self, langs: list[str], tables: dict[tuple[str, int, bool], tuple[np.ndarray, np.ndarray]]):
        self.langs, self.tables = langs, tables
        characters = max((len(tables[lang, 1, True][0]) for lang in langs), default=1)  # kinds of characters
        self.floor = 1.0 / (characters + 1_000)
        self.temperature, self.limits = 1.0, {}

    @staticmethod
    def of(rows: pa.Table) -> Model:
        """From the columns of ``kneser_ney``."""
        langs = sorted(rows.column("lang").unique().to_pylist())
        lang = np.array([langs.index(x) for x in rows.column("lang").unique().to_pylist()], dtype=np.int64)
        code = rows.column("lang").combine_chunks().dictionary_encode().indices.to_numpy()
        group = (lang[code] * (ORDER + 1) + rows.column("order").to_numpy()) * 2 + rows.column("is_gram").to_numpy()
        slots, values = rows.column("slot").to_numpy(), rows.column("value").to_numpy()
        by_slot = np.lexsort((slots, group))
        group, slots, values = group[by_slot], slots[by_slot], values[by_slot].astype(np.float32)
        tables = {}
        for k, name in enumerate(langs):
            for n in range(1, ORDER + 1):
                for is_gram in (True, False):
                    key = (k * (ORDER + 1) + n) * 2 + is_gram
                    part = slice(*np.searchsorted(group, [key, key + 1]))
                    tables[name, n, is_gram] = (slots[part].copy(), values[part].copy())
        return Model(langs, tables)

    def _find(self, key: tuple[str, int, bool], slots: np.ndarray, missing: float) -> np.ndarray:
        known, values = self.tables[key]
        if not len(known):
            return np.full(len(slots), missing)
        at = np.minimum(np.searchsorted(known, slots), len(known) - 1)
        return np.where(known[at] == slots, values[at], missing)

    def gram_costs(self, orders: np.ndarray, grams: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """Natural-log cost of each n-gram's last character under each language.

        ``grams[n - 1]`` and ``contexts[n - 1]`` are keys of its last n characters and of those
        before the last; only orders up to ``orders`` count.
        """
        out = np.empty((len(orders), len(self.langs)))
        for k, lang in enumerate(self.langs):
            p = np.full(len(orders), self.floor)
            for n in range(1, ORDER + 1):
                share = self._find((lang, n, True), grams[n - 1], 0.0)
                left = self._find((lang, n, False), contexts[n - 1], 1.0)
                p = np.where(orders >= n, share + left * p, p)
            out[:, k] = -np.log(p)
        return out


class Scorer:
    """Costs of texts, with a bounded memory of the words and n-grams seen before."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.costs = np.empty((0, len(self.model.langs)))
        self.keys = np.empty(0, np.uint64)
        self.key_costs = np.empty((0, len(self.model.langs)))

    def _word_costs(self, words: list[str]) -> np.ndarray:
        """The cost of each word's characters and closing edge under each language."""
        marked = [EDGE + w + EDGE for w in words]
        sizes = np.array([len(m) for m in marked])
        characters = _characters("".join(marked))
        place = np.arange(len(characters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        hashes = _rolled(characters)
        orders = np.minimum(place + 1, ORDER)
        full = np.choose(orders - 1, hashes) ^ orders.astype(np.uint64)
        inside = np.flatnonzero(place > 0)
        keys, first, which = np.unique(full[inside], return_index=True, return_inverse=True)
        spot = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            known = self.keys[np.minimum(spot, len(self.keys) - 1)] == keys
        at = inside[first[~known]]
        before = [np.zeros(len(at), np.int64)] + [_slots(h[at - 1]) for h in hashes[:-1]]
        fresh = self.model.gram_costs(orders[at], [_slots(h[at]) for h in hashes], before)
        costs = np.empty((len(keys), len(self.model.langs)))
        costs[known] = self.key_costs[spot[known]]
        costs[~known] = fresh
        self.keys = np.concatenate([self.keys, keys[~known]])
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.key_costs = self.keys[order], np.concatenate([self.key_costs, fresh])[order]
        owner = np.repeat(np.arange(len(words)), sizes)[inside]
        return np.stack(
            [np.bincount(owner, weights=costs[which, k], minlength=len(words)) for k in range(costs.shape[1])], axis=1
        )

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cost per language and number of characters of each text."""
        if len(self.at) > CACHE_WORDS or len(self.keys) > CACHE_WORDS:
            self._forget()
        split = [(t or "").lower().split() for t in texts]
        new = list(dict.fromkeys(w for words in split for w in words if w not in self.at))
        if new:
            for w in new:
                self.at[w] = len(self.at)
            self.costs = np.concatenate([self.costs, self._word_costs(new)])
        total, length = np.zeros((len(texts), len(self.model.langs))), np.zeros(len(texts))
        for i, words in enumerate(split):
            if words:
                at = np.fromiter(map(self.at.__getitem__, words), dtype=np.int64, count=len(words))
                total[i] = self.costs[at].sum(axis=0)
                length[i] = sum(map(len, words)) + len(words)
        return total, length


def _posterior(cross: np.ndarray, length: np.ndarray, temperature: float) -> np.ndarray:
    """Probabilities of languages from cross-entropies; long texts count as 50 characters."""
    logits = -cross * np.minimum(length, 50.0)[:, None] / temperature
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    return p / p.sum(axis=1, keepdims=True)


def train(docs: DataFrame, calibration_docs: int | None = None) -> Model:
    """Models of all languages in ``lang``, counted on every labelled row of ``docs``.

    Temperature and limits are fitted on all of these rows too; a row that repeats with its id counts
    once. Scores stay distributed: the driver gets sums of losses and two quantiles per language.

    A caller may bound the fit to about ``calibration_docs`` rows, chosen by a hash of id and text, so
    that a text many rows hold counts as often as it should.
    """
    model = Model.of(kneser_ney(written(gram_counts(docs), "language-grams")).toArrow())
    if not model.langs:
        return model
    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL")
    if calibration_docs is None:
        _calibrate_all(model, written(_scored(labelled, model), "language-scores"))
        return model
    share = min(1.0, calibration_docs / max(labelled.count(), 1))
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / F.lit(2.0**53)
    found = _scored(labelled.filter(place < share), model).collect()
    if found:
        _calibrate(model, found)
    return model


def _scored(labelled: DataFrame, model: Model) -> DataFrame:
    """(truth, cross, length): the number of its language and the cross-entropies of every labelled row with words."""
    held = labelled.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        number = {lang: k for k, lang in enumerate(held.value.langs)}
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                total, length = scorer.texts(batch.column(3).to_pylist())
                cross = total / np.maximum(length, 1)[:, None]
                truth = pa.array([number[lang] for lang in batch.column(2).to_pylist()], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), truth, pa.array(cross.tolist(), pa.list_(pa.float64())), pa.array(length)],
                    names=["doc_id", "digest", "truth", "cross", "length"],
                )

    kind = labelled.schema["doc_id"].dataType.simpleString()
    rows = labelled.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "lang", "text").mapInArrow(
        run, f"doc_id {kind}, digest string, truth int, cross array<double>, length double"
    )
    once = rows.filter("length > 0").dropDuplicates(["doc_id", "truth", "digest"])
    return once.select("truth", "cross", "length")


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    truth, length = batch.column(0).to_numpy(), batch.column(2).to_numpy()
    return truth, batch.column(1).flatten().to_numpy().reshape(len(truth), -1), length


def _calibrate(model: Model, rows: list) -> None:
    cross, length = np.array([r["cross"] for r in rows]), np.array([r["length"] for r in rows])
    truth, at = np.array([r["truth"] for r in rows]), np.arange(len(rows))

    def loss(temperature: float) -> float:
        return float(-np.log(np.maximum(_posterior(cross, length, temperature)[at, truth], 1e-12)).mean())

    model.temperature = min(TEMPERATURES, key=loss)
    score = _posterior(cross, length, model.temperature)[at, truth]
    for k, lang in enumerate(model.langs):
        mine = truth == k
        if mine.any():
            model.limits[lang] = (float(np.quantile(score[mine], 0.01)), float(np.quantile(cross[mine, k], 0.99)))


def _calibrate_all(model: Model, rows: DataFrame) -> None:
    """As ``_calibrate``, on a table of any size."""

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(TEMPERATURES))
        for batch in batches:
            truth, cross, length = _columns(batch)
            at = np.arange(len(truth))
            for k, temperature in enumerate(TEMPERATURES):
                sums[k] -= np.log(np.maximum(_posterior(cross, length, temperature)[at, truth], 1e-12)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums)], names=["k", "loss"])

    found = dict(map(tuple, rows.mapInArrow(losses, "k int, loss double").groupBy("k").agg(F.sum("loss")).collect()))
    if not found:
        return
    model.temperature = chosen = TEMPERATURES[min(sorted(found), key=found.__getitem__)]

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            truth, cross, length = _columns(batch)
            at = np.arange(len(truth))
            score = _posterior(cross, length, chosen)[at, truth]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array(cross[at, truth])], names=["truth", "score", "cross"]
            )

    own = written(rows.mapInArrow(scores, "truth int, score double, cross double"), "language-own")
    for r in group_quantiles(own, ["truth"], ["score", "cross"], [0.01, 0.99]).collect():
        model.limits[model.langs[r["truth"]]] = (r["score"][0], r["cross"][1])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy (nats per character) and ``rejected``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        scorer = Scorer(model)
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                n, lettered = batch.num_rows, batch.column(2).to_pylist()
                if not model.langs:
                    langs, scores, crosses, out = [UNKNOWN] * n, [0.0] * n, [None] * n, [True] * n
                else:
                    total, length = scorer.texts(batch.column(1).to_pylist())
                    cross = total / np.maximum(length, 1)[:, None]
                    p = _posterior(cross, length, model.temperature)
                    best = cross.argmin(axis=1)
                    langs, scores, crosses, out = [], [], [], []
                    for i, k in enumerate(best.tolist()):
                        if not lettered[i]:
                            langs.append(UNKNOWN), scores.append(0.0), crosses.append(None), out.append(True)
                            continue
                        lang, score, value = model.langs[k], float(p[i, k]), float(cross[i, k])
                        low, high = model.limits.get(lang, (0.0, math.inf))
                        langs.append(lang), scores.append(score), crosses.append(value)
                        out.append(score < low or value > high)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(langs, pa.string()),
                        pa.array(scores, pa.float64()),
                        pa.array(crosses, pa.float64()),
                        pa.array(out, pa.bool_()),
                    ],
                    names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"],
                )

    lettered: Column = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", lettered.alias("_lettered")).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, cross_entropy double, rejected boolean"
    )

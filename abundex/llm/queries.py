"""One query per operator on its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abundex.llm import bpe, exact, html_main, language, lexical, licences, merkle, mixing, packing, ppm, rules, simhash, spans
from abundex.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without sentences of repeated passages."""
    return spans.dedup(table(spark, sf_dir, "documents"))


def op2_best_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_main.main_texts(table(spark, sf_dir, "pages"))


def op3_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the training order takes of each document, and its first position there."""
    mixed = mixing.mixed_documents(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "first_position")


def op4_byte_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and near-copy component of every document."""
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), shingle=3)
    return groups.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id counts as an empty text."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return F.pmod(crc, F.lit(modulus)) == remainder


def op5_byte_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log10 probability of every document, learned from nine tenths of them; every token is spelled."""
    scored = ppm.score(table(spark, sf_dir, "documents"), ~held_out(10, 0), spell=True)
    return scored.select("*", held_out(10, 0).alias("held_out"))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.filter(~held_out(4, 2)))
    found = language.predict(docs, model)
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op7_patience_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence text in every document."""
    return licences.scan(table(spark, sf_dir, "documents"))


def op8_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and the verdicts of the base and the strict policy."""
    entries = rules.ledger(table(spark, sf_dir, "documents"))
    return entries.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~rules.passes(F.col("failures"), rules.BASE)).alias("base_failed"),
        rules.passes(F.col("failures"), rules.STRICT).alias("kept"),
        "failures",
    )


def op9_exact_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of every document."""
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def token_digests(docs: DataFrame) -> DataFrame:
    """Number of tokens, and digests of ids and decoded text, of every row."""
    decoded = bpe.decode(bpe.encode(docs))
    return decoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op10_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, there and back, as digests."""
    return token_digests(table(spark, sf_dir, "documents"))


def op11_bag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_nested_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and check of every document; a third of them is tampered with before the check."""
    docs = table(spark, sf_dir, "documents")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = F.when(chosen, F.translate("text", upper, lower))
    proofs = merkle.manifest(docs, "doc_id", "lang", ["doc_id", "source", "lang", "n_chars", "text"], {"text": tampered})
    folded = proofs.withColumn("folded_root", merkle.fold(F.coalesce("found_leaf", "leaf"), F.col("path")))
    return folded.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in its training sequence."""
    return packing.pack(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "start",
        F.expr("octet_length(ids) div 4").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "window",
        "step",
    )


QUERIES: dict[str, Query] = {
    "op1_sentence_spans": op1_sentence_spans,
    "op2_best_region": op2_best_region,
    "op3_curriculum_mix": op3_curriculum_mix,
    "op4_byte_index": op4_byte_index,
    "op5_byte_ppm": op5_byte_ppm,
    "op6_kneser_ney": op6_kneser_ney,
    "op7_patience_scan": op7_patience_scan,
    "op8_rule_ledger": op8_rule_ledger,
    "op9_exact_index": op9_exact_index,
    "op10_word_table_bpe": op10_word_table_bpe,
    "op11_bag_search": op11_bag_search,
    "op12_nested_rollup": op12_nested_rollup,
    "op13_tier_packing": op13_tier_packing,
}

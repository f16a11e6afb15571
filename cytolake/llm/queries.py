"""One query for each operator of this subpackage, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolake.llm import bpe, chat, decontaminate, divergence, html, jaccard, katz, mixing, quality, repair, secrets, suffix, toxicity
from cytolake.llm._spark import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return secrets.digest(found).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op4_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1, F.lit(False))
    scored = katz.score(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    model = toxicity.fit(documents, labels, ~held_out)
    return toxicity.score(documents, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


#: The tree of the mix: which sources make a domain, and the weights; sources not named are "other".
DOMAINS = {"web": [f"src{i}" for i in range(8)], "books": [f"src{i}" for i in range(8, 14)], "forum": [f"src{i}" for i in range(14, 20)]}
WEIGHTS = {("web",): 0.5, ("books",): 0.3, ("forum",): 0.2} | {(d, x): w for d in DOMAINS for x, w in (("en", 0.6), ("de", 0.15), ("fr", 0.15), ("es", 0.1))}


def domain_of(source: str = "source"):
    out = F.lit("other")
    for name, sources in DOMAINS.items():
        out = F.when(F.col(source).isin(sources), F.lit(name)).otherwise(out)
    return out


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), domain_of(), WEIGHTS, budget_share=1.0, max_epochs=4, seed=17)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), k=4, percent=85)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.benchmark_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination(hits).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(suffix.remove_repeats(table(spark, sf_dir, "documents"), length=200, batches=4))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op11_rank_queue_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = bpe.vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), known, carry=["doc_id"]), known)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=10, ranks=10)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair.repair(repair.damage(conversations), conversations.select("conv_id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}

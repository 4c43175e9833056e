"""The registered queries of the text operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corelith.llm import bpe, exact_dedup, html_extract, language, line_dedup, merkle, mixing, near_dedup, packing, pii, resampling, secrets, topk_search
from corelith.llm.common import table


#: The key of the registered query's surrogates; an application passes its own, secret one.
SURROGATE_KEY = "corelith"


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(table(spark, sf_dir, "documents"), SURROGATE_KEY)


def tokenizer_files() -> tuple[str, str]:
    """The file of the tokenizer's ranks and its splitting pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), *tokenizer_files())


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(table(spark, sf_dir, "documents"))


def op5_guess_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = secrets.vocabulary_words(tokenizer_files()[0])
    return secrets.scan(table(spark, sf_dir, "documents"), words=words).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_guess"
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op7_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.apply_bitmaps(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return made.select("doc_id", "n_features", "weight", "score", "rank")


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    made = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    n_tokens = F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens")
    return made.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = merkle.manifest(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_surrogates": op1_surrogates,
    "op2_pack": op2_pack,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_near_dedup": op4_near_dedup,
    "op5_guess_cost": op5_guess_cost,
    "op6_language_id": op6_language_id,
    "op7_maxscore": op7_maxscore,
    "op8_html_text": op8_html_text,
    "op9_line_dedup": op9_line_dedup,
    "op10_mix_sources": op10_mix_sources,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_bpe": op12_bpe,
    "op13_merkle": op13_merkle,
}

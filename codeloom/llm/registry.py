"""The queries of the corpus operators, by name, with their oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import (
    decontaminate,
    html_text,
    language_id,
    lexical_search,
    mixing,
    near_dedup,
    passage_dedup,
    quality_classifier,
    quality_rules,
    secrets,
    sharding,
    token_counts,
    whitening,
)
from codeloom.llm.io import table


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark passages: doc_id, item_id, n_windows, start, end, edits."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: doc_id, held_out, lang_pred, score over whole documents."""
    return language_id.identify_languages(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: doc_id, n_assign, n_access, n_hex, base_sha256, spans, then n_markov."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op4_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of each document: doc_id, shard_id, depth, n_bytes."""
    return sharding.shard_map(table(spark, sf_dir, "documents"), limit=sharding.QUERY_LIMIT)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: page_id, url, text, n_chars over whole pages."""
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op6_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated runs to remove: doc_id, start, end, n_words, first_doc_id."""
    return passage_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed order: doc_id, source, n_tokens, epoch, block, position, weight."""
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: doc_id, n_shingles, component_id, kept over whole documents."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, then lost_chars and clean_chars."""
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars", "clean_chars"
    )


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: doc_id, held_out, score, predicted over whole documents."""
    return quality_classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: vec_id, component, n, deviation, whitened, explained, identity_error over whole embeddings."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: item_id, rank, doc_id, score of every benchmark item over whole documents."""
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_counts(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Contract: doc_id, n_bytes, n_tokens, over_limit over whole documents; `model` is another model file."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.token_counts(table(spark, sf_dir, "documents"), model)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination, op2_language_id, op3_secret_scan, op4_extendible_sharding, op5_html_extraction,
        op6_passage_dedup, op7_source_mixing, op8_minhash_near_dedup, op9_quality_rules, op10_quality_classifier, op11_embedding_whitening, op12_ranked_search, op13_token_counts,
    )
}

ORACLE_SQL: dict[str, str] = {"op4_extendible_sharding": sharding.ORACLE_SQL, "op12_ranked_search": lexical_search.ORACLE_SQL}

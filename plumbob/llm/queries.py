"""One query per operator, over its whole table. Their SQL is in ``ORACLE`` where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbob.llm import bpe, conversations, host_quality, html_text, ngram_join, packing, pieces, pii, tokens, topk, url_filter, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_quality.judge_documents(_table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op3_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_adaptive_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_components(_table(spark, sf_dir, "documents"))


def op5_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), k=5, queries=F.col("vec_id") % 50 == 0)


#: Allow and block rules, by host and start of the path.
URL_RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)


def op6_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_pages(_table(spark, sf_dir, "pages"), URL_RULES)


def op7_span_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op8_article_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op9_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op10_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(_table(spark, sf_dir, "documents"), path, end_id=1, with_tokens=False)


def op11_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), components=16)


def op12_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.text_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_digests(_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_host_quality": op1_host_quality,
    "op2_token_files": op2_token_files,
    "op3_piece_round_trip": op3_piece_round_trip,
    "op4_adaptive_join": op4_adaptive_join,
    "op5_threshold_top_k": op5_threshold_top_k,
    "op6_url_aliases": op6_url_aliases,
    "op7_span_votes": op7_span_votes,
    "op8_article_text": op8_article_text,
    "op9_warc_segments": op9_warc_segments,
    "op10_lexical_packing": op10_lexical_packing,
    "op11_lanczos_whitening": op11_lanczos_whitening,
    "op12_pair_index": op12_pair_index,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE: dict[str, str] = {
    "op1_host_quality": host_quality.ORACLE,
    "op5_threshold_top_k": topk.ORACLE,
    "op6_url_aliases": url_filter.ORACLE,
    "op9_warc_segments": warc.ORACLE,
}

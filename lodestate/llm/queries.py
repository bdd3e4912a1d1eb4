"""The registered queries opN_<name> over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bpe_segment, chat_format, exact_dedup, language_id, near_dedup, packing, substring_dedup, token_store, url_filter
from .common import table


def tokenizer(name: str) -> str:
    """Where a public vocabulary file lies; operators take the place as a parameter."""
    return public_tokenizers.path(name)


def op1_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op2_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_format.with_control_case(spark, table(spark, sf_dir, "conversations"))
    return chat_format.digest(chat_format.format_paths(chat_format.from_turns(turns)))


def op3_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_segment.round_trip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op5_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digests(audio.media_table(table(spark, sf_dir, "documents")))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read(*token_store.write(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


def op9_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4)


QUERIES = {f.__name__: f for f in (op1_url_templates, op2_chat_trees, op3_segment_tree_bpe, op4_language_id, op5_audio_features, op6_substring_dedup, op7_token_store, op8_exact_dedup, op9_sum_of_squares_packing, op10_minhash_dedup)}

ORACLE_SQL = {
    "op2_chat_trees": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), escaped AS (
            SELECT *, replace(replace(replace(replace(replace(text, '~', '~0'), '</s>', '~1'), '<s>', '~2'), '[INST]', '~3'), '[/INST]', '~4') AS safe FROM turns
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(length(safe) + CASE WHEN role = 'assistant' THEN 7 ELSE length(role) + 16 END)::BIGINT AS formatted_chars
        FROM escaped GROUP BY conv_id
    """,
    "op8_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
}

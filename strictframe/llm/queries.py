"""The registered queries of the text operators: thin, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_folder

from .binary import token_rows, written
from .chat import chat_digests
from .common import documents
from .fingerprint import fingerprint_pairs
from .licenses import scan_licenses
from .neardup import near_classes
from .packing import pack
from .pieces import piece_digests
from .quality import quality_rules
from .repeats import repeat_digests
from .secrets import secret_digests
from .tokens import ByteTokens

#: Contract of the chat query: one more conversation whose texts look like control strings.
TRICKY = r"\### Assistant: </turn> ok"


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(documents(spark, sf_dir)).select("doc_id", "class_id")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], chats.schema)
    return chat_digests(chats.unionAll(extra))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(documents(spark, sf_dir))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(documents(spark, sf_dir))


def byte_tokens() -> ByteTokens:
    """The byte-level vocabulary; called on the executors."""
    import public_tokenizers

    return ByteTokens(vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(documents(spark, sf_dir))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), byte_tokens)


def op10_token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(token_rows(documents(spark, sf_dir), byte_tokens), scratch_folder(spark))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}

"""The corpus pipeline: quality rules, near-dedup, suffix-array dedup, secret scans, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.  A stage sees all that the one before
it kept, and its own decisions take effect in what it returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strictframe.llm.neardup import one_of_each
from strictframe.llm.packing import pack
from strictframe.llm.quality import quality_rules
from strictframe.llm.queries import byte_tokens
from strictframe.llm.repeats import without_repeats
from strictframe.llm.secrets import redact
from strictframe.session import scratch_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the limits on repetition."""
    return quality_rules(docs, keep=COLUMNS).filter("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least id, of each class of near copies."""
    return one_of_each(docs, COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that also start elsewhere; ``n_chars`` follows the text."""
    return _recounted(without_repeats(docs, COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced by a mark; ``n_chars`` follows the text."""
    return _recounted(redact(docs, COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document, packed into sequences."""
    return pack(docs, byte_tokens)


def _recounted(docs: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return docs.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_dedup),
    ("secret_scans", secrets),
    ("best_fit_packing", packing),
]

#: Suffix arrays, near classes and packing are beyond SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``.

    Each stage but the last is written once in the shared folder and read by the
    next, which uses its input several times; so no stage runs twice, and a lost
    executor costs the tasks of one stage.
    """
    folder = scratch_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

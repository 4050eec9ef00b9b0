"""Append a stream to a table and keep its digest, batch by batch.

Each batch is written to a folder of its own and its digest beside it, both
named by the batch, so a batch that runs again after a failure replaces itself:
the table and the sum of the digests stay exact.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.digest import MODULUS
from ..sources.catalog import normalised


def _multiset_digests(df: DataFrame) -> DataFrame:
    """Column digests that don't depend on row numbers, as streams have none."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in df.columns:
        aggs.append(F.pmod(F.coalesce(F.sum(F.xxhash64(F.col(c)).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)"), F.lit(str(MODULUS)).cast("decimal(38,0)")).cast("string").alias(c))
    return df.agg(*aggs)


def append_stream(stream: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start appending; ``once`` takes what is there and stops."""
    frame, _ = normalised(stream)

    def write(batch: DataFrame, number: int) -> None:
        path = f"{folder}/rows/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        done = batch.sparkSession.read.schema(batch.schema).parquet(path)
        _multiset_digests(done).coalesce(1).write.mode("overwrite").json(f"{folder}/digests/batch={number}")

    writer = frame.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def table(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/rows").drop("batch")


def digests(spark: SparkSession, folder: str) -> dict[str, int]:
    """Rows, and the digest of each column, summed over the batches (one small row each)."""
    total: dict[str, int] = {}
    for line in spark.read.text(f"{folder}/digests").select("value").toLocalIterator():
        for k, v in json.loads(line["value"]).items():
            total[k] = (total.get(k, 0) + int(v)) % MODULUS
    return total


def current_digests(df: DataFrame) -> dict[str, int]:
    """The digests of a table as a whole, for comparison."""
    return {k: int(v) for k, v in _multiset_digests(df).first().asDict().items()}

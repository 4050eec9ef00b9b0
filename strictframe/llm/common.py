"""Helpers shared by the text operators: bounded Arrow slices and checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import checkpointed as checkpointed

#: Text bytes that one call of a batch function sees at most (a longer text comes alone).
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows that hold at most ``limit`` bytes in ``column``; nulls count 0."""
    start = held = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as the empty text."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def map_texts(
    df: DataFrame,
    columns: list[str],
    text: str,
    make: Callable[[], Callable[[pa.RecordBatch], dict[str, object]]],
    fields: list[T.StructField],
    keep: list[str],
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Map each row of ``df[columns]`` by Arrow slices of bounded size, without a shuffle.

    ``make`` runs once per task and returns the function from a slice to new
    columns, one value for each row; ``keep`` names the input columns that go
    through untouched, whatever their type.  Columns beyond ``columns`` are
    never read.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    source = df.select(*columns)
    out = T.StructType([source.schema[c] for c in keep] + fields)
    arrow = to_arrow_schema(T.StructType(fields))

    def run(batches):
        f = make()
        for batch in batches:
            for part in slices(batch, text, limit):
                made = f(part)
                cols = [part.column(c) for c in keep]
                names = list(keep)
                for field in arrow:
                    v = made[field.name]
                    cols.append(v if isinstance(v, pa.Array) else pa.array(v, field.type))
                    names.append(field.name)
                yield pa.RecordBatch.from_arrays(cols, names)

    return source.mapInArrow(run, out)


def long_field(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def string_field(name: str) -> T.StructField:
    return T.StructField(name, T.StringType())


def bool_field(name: str) -> T.StructField:
    return T.StructField(name, T.BooleanType())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

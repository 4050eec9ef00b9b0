"""Tables by name: what queries read, with their SQL types and without nulls."""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types as S
from ..errors import NullInputError, TypeMismatchError, UnknownNameError
from ..functions.digest import Digest, digest
from ..operators.relational import with_row_index
from ..types import SqlType
from . import files


def normalised(df: DataFrame, types: dict[str, SqlType] | None = None, not_null: bool = True) -> tuple[DataFrame, dict[str, SqlType]]:
    """Columns as the engine holds them: floats as decimal(20,10), timestamps in UTC, names in lower case.

    With ``not_null`` a null raises when it is met; the check is part of the
    scan's projection, so it costs no pass.  It covers the columns a query reads.
    """
    schema: dict[str, SqlType] = {}
    cols = []
    for f in df.schema:
        name = f.name.lower()
        if name in schema:
            raise TypeMismatchError(f"two columns named {name}")
        t = (types or {}).get(name) or S.from_spark(f.dataType)
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampNTZType) and t.unit != "ns":
            c = c.cast(T.TimestampType())
        if c is not None and f.dataType != t.spark():
            c = c.cast(t.spark())
        if not_null and f.nullable:
            c = F.coalesce(c, F.raise_error(F.lit(f"null in column {name}")).cast(t.spark()))
        schema[name] = t
        cols.append(c.alias(name))
    return df.select(*cols), schema


def without_nulls(df: DataFrame) -> DataFrame:
    """The table itself, or an error if any of its rows holds a null; one aggregate over the table."""
    checks = [F.count_if(F.col(f"`{c}`").isNull()).alias(str(k)) for k, c in enumerate(df.columns)]
    if checks and (found := [c for c, n in zip(df.columns, df.agg(*checks).first()) if n]):
        raise NullInputError(f"nulls in {', '.join(found)}")
    return df


#: What was found in tables that have not changed since, by path; for the running application only.
_CHECKED: dict[tuple, list[str]] = {}


def parquet_nulls(spark: SparkSession, path: str, columns: list[str]) -> list[str]:
    """Columns that hold a null, from the null counts in the footers of the files.

    Counts of columns are pushed to the footers by the second version of the
    Parquet source, one task a group of files.  A table is asked once as long
    as the change time of its file or folder stays the same.
    """
    key = None
    if (changed := files.changed(spark, path)) is not None:
        key = (spark.sparkContext.applicationId, path, *changed, tuple(columns))
        if key in _CHECKED:
            return _CHECKED[key]
    found = _footer_counts(spark, path, columns)
    if key is not None:
        _CHECKED[key] = found
    return found


def _footer_counts(spark: SparkSession, path: str, columns: list[str]) -> list[str]:
    def nulls() -> list[str]:
        n, *counts = spark.read.parquet(path).agg(F.count(F.lit(1)), *(F.count(F.col(f"`{c}`")) for c in columns)).first()
        return [c for c, k in zip(columns, counts) if k != n]

    # Both settings decide at planning; they are put back before anything else is planned.
    use = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k) for k in use}
    try:
        for k, v in use.items():
            spark.conf.set(k, v)
        return nulls()
    except PySparkException:  # footers without null counts: the columns themselves are read
        spark.conf.set("spark.sql.parquet.aggregatePushdown", "false")
        return nulls()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Catalog:
    """A registry of tables; names are ``table`` or ``schema.table``."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, tuple[DataFrame, dict[str, SqlType]]] = {}
        self.offsets: dict[str, int] = {}

    def add(self, name: str, df: DataFrame, types: dict[str, SqlType] | None = None, not_null: bool = True, offset: int = 0) -> None:
        """``offset`` is the number of the table's first row, for digests of parts of a longer table."""
        if name.count(".") > 1:
            raise UnknownNameError(f"{name} has more than two parts")
        self.tables[name.lower()] = normalised(df, types, not_null)
        self.offsets[name.lower()] = offset

    def offset(self, name: str) -> int:
        self.get(name)
        return self.offsets.get(name, 0)

    def update_offset(self, name: str, offset: int) -> None:
        self.get(name)
        self.offsets[name] = offset

    def digest(self, name: str, order: list[str]) -> Digest:
        """The digest of a table whose rows, in the given order, are numbered from its offset on."""
        df, schema = self.get(name)
        start = self.offset(name)
        numbered = with_row_index(df, order).withColumn("rho", (F.col("rho") + F.lit(start)).cast("decimal(38,0)"))
        return digest(numbered, schema, "rho", start)

    def add_parquet(self, name: str, path: str, check: bool = True) -> None:
        """A table of Parquet files; a null in any of its columns is an error.

        The null counts of the files' footers are summed first, so no value is
        read and filters still reach the files.  Columns the engine has no type
        for (arrays, maps) are left out.  ``check=False`` is for tables known to
        have no nulls.
        """
        df = self.spark.read.parquet(path)
        known = [f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
        if check and (found := parquet_nulls(self.spark, path, known)):
            raise NullInputError(f"nulls in {', '.join(found)} of {path}")
        self.add(name, df.select(*known), not_null=False)

    def add_arrow(self, name: str, table: pa.Table) -> None:
        self.tables[name.lower()] = from_arrow(self.spark, table)

    def get(self, name: str) -> tuple[DataFrame, dict[str, SqlType]]:
        if name not in self.tables:
            raise UnknownNameError(f"no table {name}")
        return self.tables[name]

    def columns(self, name: str) -> dict[str, SqlType]:
        return self.get(name)[1]


_ARROW = {pa.bool_(): S.BOOLEAN, pa.uint8(): S.UINT8, pa.int8(): S.TINYINT, pa.int16(): S.SMALLINT, pa.int32(): S.INT, pa.int64(): S.BIGINT, pa.string(): S.VARCHAR, pa.large_string(): S.VARCHAR, pa.binary(): S.VARBINARY, pa.large_binary(): S.VARBINARY}


def arrow_type(t: pa.DataType) -> SqlType:
    if t in _ARROW:
        return _ARROW[t]
    if pa.types.is_floating(t):
        return S.decimal(20, 10)
    if pa.types.is_decimal(t):
        return S.INT128 if pa.types.is_decimal128(t) and (t.precision, t.scale) == (38, 0) else S.decimal(t.precision, t.scale)
    if pa.types.is_timestamp(t):
        return S.timestamp(t.unit)
    raise TypeMismatchError(f"Arrow type {t} has no counterpart")


def from_arrow(spark: SparkSession, table: pa.Table) -> tuple[DataFrame, dict[str, SqlType]]:
    """An Arrow table; nulls and repeated names are rejected at once."""
    names = [n.lower() for n in table.column_names]
    if len(set(names)) < len(names):
        raise TypeMismatchError("repeated column names")
    if found := [n for n, c in zip(names, table.columns) if c.null_count]:
        raise NullInputError(f"nulls in {', '.join(found)}")
    schema = {n: arrow_type(f.type) for n, f in zip(names, table.schema)}
    columns = []
    for t, c in zip(schema.values(), table.columns):
        if t.name == "timestamp":
            c = c.cast(pa.int64()) if t.unit == "ns" else c.cast(pa.timestamp("us", "UTC"))
        elif t.name == "uint8":
            c = c.cast(pa.int16())
        elif t.name in ("decimal", "int128"):
            kind = t.spark()
            c = c.cast(pa.decimal128(kind.precision, kind.scale))
        columns.append(c)
    df = spark.createDataFrame(pa.table(columns, names=names))
    return df.select(*(F.col(n).cast(t.spark()).alias(n) for n, t in schema.items())), schema


def to_arrow(df: DataFrame) -> pa.Table:
    """A result as Arrow data; the instants of timestamps are kept, their zone is not.

    The whole result comes to the driver, as an Arrow table is one value: limit
    or aggregate it first, or write it to files.
    """
    table = df.toArrow()
    fields = [f if not pa.types.is_timestamp(f.type) else f.with_type(pa.timestamp(f.type.unit)) for f in table.schema]
    return table.cast(pa.schema(fields))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV file with a header, of a declared schema or, for small files, an inferred one.

    Inferred integers are bigint and floats decimal(20,10).
    """
    if schema is not None:
        return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)

    def of(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.IntegerType):
            return c.cast("bigint").alias(f.name)
        return c.cast("decimal(20,10)").alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c

    return df.select(*map(of, df.schema))


def append_csv(df: DataFrame, path: str) -> None:
    """Append rows as CSV files with headers to a folder."""
    df.write.mode("append").option("header", True).csv(path)


def random_table(spark: SparkSession, columns: dict[str, SqlType], rows: int, bound: int | None = None, seed: int = 0) -> DataFrame:
    """Random columns of given types, reproducible by seed; numbers lie within ``bound``, strings have up to ten characters."""
    limit = bound or max(rows // 10, 10)
    df = spark.range(rows)
    out = []
    for k, (name, t) in enumerate(columns.items()):
        r = F.rand(seed * 1000 + k)
        most = min(limit, {"uint8": 127, "tinyint": 127, "smallint": 32767}.get(t.name, limit))
        number = F.floor(r * (most + 1)) if t.name == "uint8" else F.floor(r * (2 * most + 1)) - most
        text = F.substring(F.sha2((r * 1e15).cast("string"), 256), 1, F.floor(F.rand(seed * 1000 + k + 500) * 11).cast("int"))
        col = {"boolean": r < 0.5, "varchar": text, "varbinary": F.encode(text, "utf-8"), "timestamp": F.timestamp_seconds(number.cast("bigint"))}.get(t.name, number)
        out.append(col.cast(t.spark()).alias(name))
    return df.select(*out)

"""The relational operators: each declares a Spark plan and leaves its execution to Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types as S
from ..errors import QueryError, TypeMismatchError
from ..functions.typed import Typed, checked_byte
from ..session import checkpointed
from ..types import SqlType


def scan(frame: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns of a table; the projection reaches its file scan."""
    return frame.select(*columns)


def empty(spark: SparkSession) -> DataFrame:
    """One row without columns: the input of a query without FROM."""
    return spark.range(1).select()


def project(df: DataFrame, columns: list[tuple[str, Column]]) -> DataFrame:
    return df.select(*(c.alias(a) for a, c in columns))


def filtered(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(condition)


def aggregate(function: str, argument: Typed | None) -> tuple[Column, SqlType]:
    """An aggregate and its type: sums keep the type of what they add, and raise where they leave it."""
    if function == "count":
        return F.count(F.lit(1)), S.BIGINT
    t = argument.type
    if function == "sum":
        if not t.numeric:
            raise TypeMismatchError(f"sum of {t} is not defined")
        total = F.sum(argument.col).cast(t.spark())
        return checked_byte(total) if t.name == "uint8" else total, t
    if t.name in ("varchar", "varbinary"):
        raise TypeMismatchError(f"{function} of {t} is not defined")
    return (F.max if function == "max" else F.min)(argument.col), t


def group(df: DataFrame, keys: list[tuple[str, Column]], aggregates: list[tuple[str, Column]], strict_empty: bool = False) -> DataFrame:
    """Grouped or global aggregates, combined before their one shuffle.

    A global aggregate over no rows is one row, or with ``strict_empty`` none.
    """
    aggs = [c.alias(a) for a, c in aggregates]
    if keys:
        grouped = df.groupBy(*(c.alias(a) for a, c in keys))
        return grouped.agg(*aggs) if aggs else grouped.agg(F.count(F.lit(1)).alias("__rows")).drop("__rows")
    out = df.agg(*aggs, F.count(F.lit(1)).alias("__rows"))
    return (out.filter("__rows > 0") if strict_empty else out).drop("__rows")


def ordered(df: DataFrame, keys: tuple[tuple[str, bool], ...]) -> DataFrame:
    """Sorted by result columns; strings compare by bytes.  With a limit Catalyst makes it a top-k."""
    return df.orderBy(*(F.col(a).asc() if up else F.col(a).desc() for a, up in keys))


def sliced(df: DataFrame, offset: int = 0, limit: int | None = None, keys: tuple[tuple[str, bool], ...] = ()) -> DataFrame:
    """``limit`` rows from ``offset`` on; a negative offset counts from the end.

    Where ``keys`` say how the rows are ordered, the last rows are the first ones
    in the reversed order: a top-k, which is also what shows that there are
    enough of them.  Without an order the rows are counted first.  An offset
    beyond the end gives no rows, one before the beginning is an error.
    """
    if offset < 0 and keys:
        tail = ordered(df, tuple((a, not up) for a, up in keys)).limit(-offset)
        n = tail.count()
        if n + offset < 0:
            raise QueryError(f"offset {offset} lies before the first of {n} rows")
        df, offset = ordered(tail, keys), 0
    if offset < 0:
        n = df.count()
        if n + offset < 0:
            raise QueryError(f"offset {offset} lies before the first of {n} rows")
        offset += n
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def union_all(parts: list[tuple[DataFrame, dict[str, SqlType]]], names: list[str] | None = None) -> DataFrame:
    """Rows of all parts under ``names``, else those of the first part; their types must be the same."""
    if not parts:
        raise QueryError("a union without parts has no schema")
    df, schema = parts[0]
    want, schema = list(schema.values()), names or list(schema)
    df = df.toDF(*schema)
    for other, has in parts[1:]:
        if list(has.values()) != want:
            raise TypeMismatchError(f"union of ({', '.join(map(str, want))}) with ({', '.join(map(str, has.values()))})")
        df = df.union(other.toDF(*schema))
    return df


def join_inner(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Inner join on one key of one type: the key, the other columns of the left, those of the right.

    No hint: Catalyst broadcasts a side only below its threshold, sorts and
    merges otherwise, and splits skewed keys at run time.
    """
    a, b = left.schema[left_key].dataType, right.schema[right_key].dataType
    if a != b:
        raise TypeMismatchError(f"join of {a.simpleString()} with {b.simpleString()}")
    renamed = right.withColumnRenamed(right_key, left_key) if right_key != left_key else right
    return left.join(renamed, left_key, "inner")


def cross_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of rows."""
    return left.crossJoin(right)


def key_union(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of both sides; each side is made distinct before the rows move."""
    return left.select(key).union(right.select(key)).distinct()


def multiplicities(keys: DataFrame, data: DataFrame, key: str) -> DataFrame:
    """How often each key occurs in the data, 0 for those that don't."""
    counts = data.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return keys.join(counts, key, "left").select(key, F.coalesce("__n", F.lit(0)).cast("long").alias("multiplicity"))


def with_row_index(df: DataFrame, order: list[str], name: str = "rho") -> DataFrame:
    """Dense numbers 0..n-1 in the given order, without gathering all rows in one task.

    Rows are laid out once by ranges of the order, each range sorted, and
    written with range and place; sizes and numbers both come from what was
    written, so they agree whatever adaptive execution or the sampling of
    bounds does.  Rows of equal keys are told apart by a hash of the whole row,
    so a key that many rows share is spread over ranges too.  Only the sizes
    are broadcast: one row a range.
    """
    part, base, tie, at = (_fresh(df, n) for n in ("part", "base", "tie", "at"))
    hashed = [c for c, t in zip(df.columns, df.schema) if not isinstance(t.dataType, T.MapType)]
    keys = [*order, tie]
    laid = checkpointed(
        df.withColumn(tie, F.xxhash64(*(_col(c) for c in hashed)))
        .repartitionByRange(*map(_col, keys))
        .sortWithinPartitions(*map(_col, keys))
        .select(*map(_col, df.columns), F.monotonically_increasing_id().alias(at))
    )
    # A monotonic id is the number of the partition, then 33 bits of the place in it.
    sizes = laid.groupBy(F.shiftright(at, 33).alias(part)).agg(F.count(F.lit(1)).alias(base))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(part, F.coalesce(F.sum(base).over(before), F.lit(0)).alias(base))
    numbered = laid.join(F.broadcast(bases), F.shiftright(at, 33) == F.col(part))
    return numbered.select(*map(_col, df.columns), (F.col(base) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).cast("decimal(38,0)").alias(name))


def _col(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def _fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while f"__{name}" in df.columns:
        name += "_"
    return f"__{name}"


def gather(indexed: DataFrame, positions: DataFrame, name: str = "rho") -> DataFrame:
    """Rows at the given positions, repeated as the positions are."""
    return positions.select(name).join(indexed, name, "inner").select(*indexed.columns)


def coerced(df: DataFrame, schema: dict[str, SqlType]) -> DataFrame:
    """The result under a declared schema: same names in order, values that fit, or an error."""
    if df.columns != list(schema):
        raise TypeMismatchError(f"columns {df.columns} declared as {list(schema)}")
    return df.select(*((checked_byte(F.col(c)) if t.name == "uint8" else F.col(c)).cast(t.spark()).alias(c) for c, t in schema.items()))


def monotonic(df: DataFrame, column: str, order: str, strict: bool = False) -> DataFrame:
    """Rows whose value is less than (or, if strict, not greater than) that of the row before them.

    Rows are numbered in order and joined with their successors, so no task
    sees more than its share of them.
    """
    numbered = with_row_index(df, [order], "__at")
    before = numbered.select((F.col("__at") + 1).cast("decimal(38,0)").alias("__at"), F.col(column).alias("__before"))
    bad = F.col("__before") >= F.col(column) if strict else F.col("__before") > F.col(column)
    return numbered.join(before, "__at").filter(bad).select(*df.columns)


def permuted(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side holds more often than the other; none if both hold the same rows."""
    return left.exceptAll(right).unionAll(right.exceptAll(left))


def missing_members(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of the left whose columns no row of the right has."""
    return left.join(right, columns, "left_anti")

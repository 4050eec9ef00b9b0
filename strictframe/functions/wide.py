"""Whole numbers of up to 75 digits as built-in columns: five limbs of base 10^18.

A wide number is a struct of bigints ``l0`` … ``l4``; ``l0`` … ``l3`` lie in
[0, 10^18) and the top limb carries the sign, so order is that of the limbs
from the top.  A decimal(p, s) beyond 38 digits is its unscaled wide number;
its scale is kept by whoever declares it.

Columns are trees in which each use repeats the tree, so carries are computed
by chains of projections on a DataFrame: every function adds the column
``name`` to ``df``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMBS, DIGITS, MOST_DIGITS = 5, 18, 75
_D = T.DecimalType(38, 0)
_TOP = 10 ** (MOST_DIGITS - DIGITS * (LIMBS - 1))


def _base() -> Column:
    return F.lit(10**DIGITS).cast(_D)


def _limbs(w: str) -> list[Column]:
    return [F.col(w)[f"l{i}"] for i in range(LIMBS)]


def _too_wide() -> Column:
    return F.raise_error(F.lit(f"more than {MOST_DIGITS} digits")).cast(_D)


def carried(df: DataFrame, name: str, parts: list[Column]) -> DataFrame:
    """Limbs of sums and products (38 digits at most) in canonical form; more than 75 digits raise."""
    keep = [c for c in df.columns if c != name]
    df = df.withColumns({f"__x{i}": p.cast(_D) for i, p in enumerate(parts)})
    for i in range(LIMBS - 1):
        df = df.withColumn("__q", F.call_function("div", f"__x{i}", _base()).cast(_D))
        df = df.withColumn("__r", (F.col(f"__x{i}") - F.col("__q") * _base()).cast(_D))
        low = F.col("__r") < 0
        df = df.withColumns({
            f"__x{i}": F.when(low, F.col("__r") + _base()).otherwise(F.col("__r")).cast(_D),
            f"__x{i + 1}": (F.col(f"__x{i + 1}") + F.when(low, F.col("__q") - 1).otherwise(F.col("__q"))).cast(_D),
        })
    top = F.col(f"__x{LIMBS - 1}")
    limbs = [F.col(f"__x{i}") for i in range(LIMBS - 1)] + [F.when((top < _TOP) & (top >= -_TOP), top).otherwise(_too_wide())]
    return df.select(*keep, F.struct(*(x.cast("bigint").alias(f"l{i}") for i, x in enumerate(limbs))).alias(name))


def from_text(df: DataFrame, name: str, text: Column) -> DataFrame:
    """Digits with an optional sign."""
    df = df.withColumns({"__digits": F.lpad(F.regexp_replace(text, r"^[+-]", ""), DIGITS * LIMBS, "0"), "__sign": F.when(F.startswith(text, F.lit("-")), F.lit(-1)).otherwise(F.lit(1))})
    parts = [F.substring("__digits", DIGITS * (LIMBS - 1 - i) + 1, DIGITS).cast("bigint") * F.col("__sign") for i in range(LIMBS)]
    return carried(df, name, parts).drop("__digits", "__sign")


def from_number(df: DataFrame, name: str, c: Column) -> DataFrame:
    """Any integer or decimal(38, 0) below 9 * 10^36 in size, as a quotient by a limb must fit a bigint."""
    x = c.cast(_D)
    zero = F.lit(0).cast(_D)
    return carried(df, name, [x % _base(), F.call_function("div", x, _base()), *[zero] * (LIMBS - 2)])


def negative(w: str) -> Column:
    return F.col(w)["l4"] < 0


def absolute(df: DataFrame, name: str, w: str) -> DataFrame:
    return carried(df, name, [F.when(negative(w), -x).otherwise(x) for x in _limbs(w)])


def add(df: DataFrame, name: str, a: str, b: str) -> DataFrame:
    return carried(df, name, [x.cast(_D) + y.cast(_D) for x, y in zip(_limbs(a), _limbs(b))])


def subtract(df: DataFrame, name: str, a: str, b: str) -> DataFrame:
    return carried(df, name, [x.cast(_D) - y.cast(_D) for x, y in zip(_limbs(a), _limbs(b))])


def multiply(df: DataFrame, name: str, a: str, b: str) -> DataFrame:
    """Convolution of the limbs of the absolute values; products beyond 75 digits raise."""
    keep = [c for c in df.columns if c != name]
    df = absolute(absolute(df, "__a", a), "__b", b).withColumn("__minus", negative(a) != negative(b))
    x, y = _limbs("__a"), _limbs("__b")
    parts: list[Column] = []
    for k in range(LIMBS):
        term = F.lit(0).cast(_D)
        for i in range(k + 1):
            term = (term + x[i].cast(_D) * y[k - i].cast(_D)).cast(_D)
        parts.append(term)
    beyond = F.lit(False)
    for i in range(LIMBS):
        for j in range(LIMBS - i, LIMBS):
            beyond = beyond | ((x[i] != 0) & (y[j] != 0))
    parts[-1] = F.when(beyond, _too_wide()).otherwise(parts[-1])
    df = carried(df, "__p", parts)
    return carried(df, name, [F.when(F.col("__minus"), -v).otherwise(v) for v in _limbs("__p")]).select(*keep, name)


def to_text(df: DataFrame, name: str, w: str) -> DataFrame:
    """The decimal digits, with a minus sign where needed."""
    df = absolute(df.withColumn("__minus", negative(w)), "__a", w)
    digits = F.concat(*(F.lpad(x.cast("string"), DIGITS, "0") for x in reversed(_limbs("__a"))))
    text = F.concat(F.when(F.col("__minus"), F.lit("-")).otherwise(F.lit("")), F.regexp_replace(digits, r"^0+(?=\d)", ""))
    return df.withColumn(name, text).drop("__minus", "__a")


def order(w: str) -> Column:
    """A struct that sorts and compares as the numbers do."""
    return F.struct(*(x.alias(f"k{i}") for i, x in enumerate(reversed(_limbs(w)))))


def total(df: DataFrame, keys: list[str], name: str, w: str) -> DataFrame:
    """Sums by key; limbs are added apart, so they combine before the shuffle."""
    sums = df.groupBy(*keys).agg(*(F.sum(x.cast(_D)).alias(f"__s{i}") for i, x in enumerate(_limbs(w))))
    return carried(sums, name, [F.col(f"__s{i}") for i in range(LIMBS)]).select(*keys, name)

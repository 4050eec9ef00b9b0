"""Columns with their SQL types, and the operations on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types as S
from ..errors import TypeMismatchError
from ..types import SqlType


@dataclass(frozen=True)
class Typed:
    """A Spark column and its type; ``literal`` keeps a constant's value."""

    col: Column
    type: SqlType
    literal: object = None


def held(e: Typed, t: SqlType) -> Typed:
    """The value as another type it fits; Spark raises where a value does not fit."""
    if e.type == t:
        return e
    return Typed(e.col.cast(t.spark()), t)


def checked_byte(c: Column) -> Column:
    """An unsigned byte, or an error."""
    return F.when((c >= 0) & (c <= 255), c).otherwise(F.raise_error(F.lit("value out of range for uint8")).cast("smallint"))


def _decimal(e: Typed) -> Typed:
    """Integers as decimals of their digits and scale 0."""
    if e.type.name == "decimal":
        return e
    return held(e, S.decimal(min(e.type.precision, S.MAX_PRECISION), 0))


def _exact(op: str, a: Column, b: Column, t: SqlType) -> Column:
    out = a + b if op == "+" else a - b if op == "-" else a * b
    return out.cast(t.spark())


def arithmetic(op: str, a: Typed, b: Typed, over_results: bool) -> Typed:
    """``+ - * /``; over results (aggregates, and around division) integers stay integers."""
    if op == "/" or over_results:
        t = S.result_type(op, a.type, b.type)
        if t.integer:
            x, y = a.col.cast(t.spark()), b.col.cast(t.spark())
            if op == "/":
                out = F.call_function("div", x, y)
                if t.name == "bigint":
                    # The least value by -1 leaves the range; plain division would wrap it.
                    out = F.when((y == -1), -x).otherwise(out)
                out = out.cast(t.spark())
            else:
                out = x + y if op == "+" else x - y if op == "-" else x * y
                out = out.cast(t.spark())
            return Typed(checked_byte(out) if t.name == "uint8" else out, t)
        if op == "/":
            return Typed(divide(_decimal(a), _decimal(b), t), t)
    else:
        t = S.multiply_type(a.type, b.type) if op == "*" else S.add_type(a.type, b.type, op)
    return Typed(_exact(op, _decimal(a).col, _decimal(b).col, t), t)


def _unscaled(e: Typed) -> Column:
    """A decimal's digits as a whole number."""
    kind = e.type.spark()
    return (e.col.cast(T.DecimalType(38, kind.scale)) * F.lit(10**kind.scale).cast(T.DecimalType(38, 0))).cast(T.DecimalType(38, 0)) if kind.scale else e.col.cast(T.DecimalType(38, 0))


def divide(a: Typed, b: Typed, t: SqlType) -> Column:
    """Quotient cut off toward zero at the scale of ``t``: long division in chunks of nine digits.

    All steps are decimal ``div`` and ``%`` on whole numbers, which are exact; a
    divisor of zero raises.
    """
    x, y = _unscaled(a), _unscaled(b)
    digits = t.s - a.type.spark().scale + b.type.spark().scale  # of the quotient of the whole numbers
    whole, wide = T.DecimalType(38, 0), T.DecimalType(38, 0)
    out = F.call_function("div", x, y).cast(whole)
    rest = (x % y).cast(wide)
    while digits > 0:
        k = min(9, digits)
        step = F.lit(10**k).cast(T.DecimalType(10, 0))
        shifted = (rest * step).cast(wide)
        out = (out * step + F.call_function("div", shifted, y)).cast(whole)
        rest = (shifted % y).cast(wide)
        digits -= k
    if digits < 0:
        out = F.call_function("div", out, F.lit(10**-digits).cast(whole)).cast(whole)
    kind = t.spark()
    if not kind.scale:
        return out.cast(kind)
    # The digits become a decimal of that scale by moving the point, without a product that needs more than 38 digits.
    return _point(out, kind)


def _point(digits: Column, kind: T.DecimalType) -> Column:
    text = F.lpad(F.abs(digits).cast("string"), 40, "0")
    at = 40 - kind.scale
    return F.concat(F.when(digits < 0, F.lit("-")).otherwise(F.lit("")), F.substring(text, 1, at), F.lit("."), F.substring(text, at + 1, kind.scale)).cast(kind)


def negate(a: Typed, over_results: bool) -> Typed:
    """-1 times the value, typed as a product."""
    if not a.type.numeric:
        raise TypeMismatchError(f"-{a.type} is not defined")
    return arithmetic("*", Typed(F.lit(-1).cast("bigint"), S.BIGINT, -1), a, over_results)


def _instants(a: Typed, b: Typed) -> tuple[Column, Column]:
    """Timestamps in one unit: nanoseconds are longs, other units Spark timestamps."""
    if "ns" not in (a.type.unit, b.type.unit):
        return a.col, b.col
    # Microseconds times 1000 could leave the range of a long, so both go to decimals.
    fine = lambda e: (e.col if e.type.unit == "ns" else F.unix_micros(e.col)).cast(T.DecimalType(38, 0)) * F.lit(1 if e.type.unit == "ns" else 1000)
    return (a.col, b.col) if a.type.unit == b.type.unit else (fine(a), fine(b))


def compare(op: str, a: Typed, b: Typed, over_results: bool = False) -> Typed:
    """``= != < > <= >=`` on types that have them."""
    if op in ("=", "!="):
        S.check_equal(a.type, b.type)
        if over_results and a.type.name in ("timestamp", "varbinary"):
            raise TypeMismatchError(f"{a.type} can't be compared over results")
    else:
        S.check_ordered(a.type, b.type)
    x, y = a.col, b.col
    if a.type.name == "timestamp":
        x, y = _instants(a, b)
    out = {"=": lambda: x == y, "!=": lambda: x != y, "<": lambda: x < y, ">": lambda: x > y, "<=": lambda: x <= y, ">=": lambda: x >= y}[op]()
    return Typed(out, S.BOOLEAN)


def logic(op: str, *args: Typed) -> Typed:
    for a in args:
        if a.type.name != "boolean":
            raise TypeMismatchError(f"{op} takes booleans, not {a.type}")
    if op == "not":
        return Typed(~args[0].col, S.BOOLEAN)
    return Typed(args[0].col & args[1].col if op == "and" else args[0].col | args[1].col, S.BOOLEAN)


def cast(a: Typed, t: SqlType) -> Typed:
    """An explicit cast of the permitted kinds."""
    S.check_cast(a.type, t)
    if a.type == t:
        return a
    if a.type.name == "boolean":
        return Typed(F.when(a.col, F.lit(1)).otherwise(F.lit(0)).cast(t.spark()), t)
    if a.type.name == "timestamp":
        by_unit = {"s": F.unix_seconds, "ms": F.unix_millis, "us": F.unix_micros, "ns": lambda c: c}
        return Typed(by_unit[a.type.unit](a.col), t)
    return Typed(a.col.cast(t.spark()), t)


def scale_cast(a: Typed, t: SqlType) -> Typed:
    """An implicit cast to a finer decimal scale or time unit."""
    S.check_scaling(a.type, t)
    if a.type.name == "timestamp" and t.unit == "ns" and a.type.unit != "ns":
        return Typed(F.unix_micros(a.col) * F.lit(1000), t)
    return Typed(a.col if a.type.name == "timestamp" else a.col.cast(t.spark()), t)

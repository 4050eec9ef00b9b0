"""The type system: twelve non-null types, and the rules for what combines with what.

Pure Python.  Exact decimals have up to 75 digits and any scale from -128 to
127; Spark holds 38, so a wider type keeps its declared precision here and is
held at 38 digits physically, where a value that needs more raises an error.
``strictframe.functions.wide`` computes beyond 38 digits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from .errors import TypeMismatchError

MAX_PRECISION, SPARK_PRECISION = 75, 38
_INTEGERS = ("uint8", "tinyint", "smallint", "int", "bigint", "int128")
_DIGITS = {"uint8": 3, "tinyint": 3, "smallint": 5, "int": 10, "bigint": 19, "int128": 39}
_BITS = {"uint8": 8, "tinyint": 8, "smallint": 16, "int": 32, "bigint": 64, "int128": 128}
_SIGNED = {8: "tinyint", 16: "smallint", 32: "int", 64: "bigint", 128: "int128"}
_UNITS = {"s": 0, "ms": 3, "us": 6, "ns": 9}


@dataclass(frozen=True)
class SqlType:
    """One column type; ``p``/``s`` only for decimals, ``unit``/``zone`` (seconds) only for timestamps."""

    name: str
    p: int = 0
    s: int = 0
    unit: str = ""
    zone: int = 0

    def __str__(self) -> str:
        if self.name == "decimal":
            return f"decimal({self.p},{self.s})"
        return f"timestamp({self.unit})" if self.name == "timestamp" else self.name

    @property
    def integer(self) -> bool:
        return self.name in _INTEGERS

    @property
    def numeric(self) -> bool:
        return self.integer or self.name in ("decimal", "scalar")

    @property
    def precision(self) -> int | None:
        if self.name == "decimal":
            return self.p
        return 0 if self.name == "scalar" else 19 if self.name == "timestamp" else _DIGITS.get(self.name)

    @property
    def scale(self) -> int | None:
        if self.name == "decimal":
            return self.s
        if self.name == "timestamp":
            return _UNITS[self.unit]
        return 0 if self.numeric else None

    def spark(self) -> T.DataType:
        """How values are held."""
        if self.name == "decimal":
            p, s = (self.p - self.s, 0) if self.s < 0 else (max(self.p, self.s), self.s)
            if s > SPARK_PRECISION:
                raise TypeMismatchError(f"{self} has more decimals than {SPARK_PRECISION}")
            return T.DecimalType(min(p, SPARK_PRECISION), s)
        if self.name == "timestamp":
            return T.LongType() if self.unit == "ns" else T.TimestampType()
        return {
            "boolean": T.BooleanType(), "uint8": T.ShortType(), "tinyint": T.ByteType(), "smallint": T.ShortType(), "int": T.IntegerType(), "bigint": T.LongType(),
            "int128": T.DecimalType(38, 0), "varchar": T.StringType(), "varbinary": T.BinaryType(), "scalar": T.DecimalType(38, 0),
        }[self.name]


BOOLEAN, UINT8, TINYINT, SMALLINT, INT, BIGINT, INT128 = (SqlType(n) for n in ("boolean", *_INTEGERS))
VARCHAR, VARBINARY, SCALAR = SqlType("varchar"), SqlType("varbinary"), SqlType("scalar")


def decimal(p: int, s: int) -> SqlType:
    if not (1 <= p <= MAX_PRECISION and -128 <= s <= 127):
        raise TypeMismatchError(f"decimal({p},{s}) is out of range")
    return SqlType("decimal", p, s)


def timestamp(unit: str = "us", zone: int = 0) -> SqlType:
    if unit not in _UNITS:
        raise TypeMismatchError(f"no time unit {unit}")
    return SqlType("timestamp", unit=unit, zone=zone)


def from_spark(t: T.DataType) -> SqlType:
    """The type of a Spark column; floats become decimal(20,10) when a table is registered."""
    simple = {T.BooleanType: BOOLEAN, T.ByteType: TINYINT, T.ShortType: SMALLINT, T.IntegerType: INT, T.LongType: BIGINT, T.StringType: VARCHAR, T.BinaryType: VARBINARY}
    for k, v in simple.items():
        if isinstance(t, k):
            return v
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return decimal(20, 10)
    if isinstance(t, T.DecimalType):
        return decimal(t.precision, t.scale)
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return timestamp("us")
    raise TypeMismatchError(f"{t.simpleString()} has no counterpart")


def parse_type(text: str) -> SqlType:
    """A type as CAST and :: write it."""
    word, _, rest = text.strip().lower().partition("(")
    args = [int(x) for x in rest.rstrip(")").split(",")] if rest else []
    names = {"bool": "boolean", "boolean": "boolean", "uint8": "uint8", "tinyint": "tinyint", "smallint": "smallint", "int": "int", "integer": "int", "bigint": "bigint", "varchar": "varchar", "string": "varchar", "text": "varchar", "varbinary": "varbinary", "binary": "varbinary", "int128": "int128"}
    if word in ("decimal", "numeric"):
        return decimal(*(args + [0] if len(args) == 1 else args or [38, 0]))
    if word == "timestamp":
        return timestamp({0: "s", 3: "ms", 6: "us", 9: "ns"}[args[0]] if args else "us")
    if word not in names or args:
        raise TypeMismatchError(f"no type {text}")
    return SqlType(names[word])


def wider_integer(a: SqlType, b: SqlType) -> SqlType:
    """The signed type of the greater width; the same type if both are alike."""
    return a if a == b else SqlType(_SIGNED[max(_BITS[a.name], _BITS[b.name])])


def _clash(op: str, a: SqlType, b: SqlType) -> TypeMismatchError:
    return TypeMismatchError(f"{a} {op} {b} is not defined")


def _numbers(op: str, a: SqlType, b: SqlType) -> None:
    if not (a.numeric and b.numeric):
        raise _clash(op, a, b)


def add_type(a: SqlType, b: SqlType, op: str = "+") -> SqlType:
    """Sum or difference of row values: scale is the greater, one digit more before it, 75 at most."""
    _numbers(op, a, b)
    if "scalar" in (a.name, b.name):
        return SCALAR
    s = max(a.scale, b.scale)
    return decimal(min(s + max(a.precision - a.scale, b.precision - b.scale) + 1, MAX_PRECISION), s)


def multiply_type(a: SqlType, b: SqlType) -> SqlType:
    """Product of row values: precisions add up with one digit more, scales add up."""
    _numbers("*", a, b)
    if "scalar" in (a.name, b.name):
        return SCALAR
    return decimal(min(a.precision + b.precision + 1, MAX_PRECISION), a.scale + b.scale)


def divide_type(a: SqlType, b: SqlType) -> SqlType:
    """Quotient of results: integers stay integers, else the scale is at least 6."""
    _numbers("/", a, b)
    if "scalar" in (a.name, b.name):
        raise _clash("/", a, b)
    if a.integer and b.integer:
        return result_type("/", a, b)
    s = max(6, a.scale + b.precision + 1)
    return decimal(min(a.precision - a.scale + b.scale + s, MAX_PRECISION), s)


def result_type(op: str, a: SqlType, b: SqlType) -> SqlType:
    """Types over aggregates and around division: integers keep the wider width."""
    _numbers(op, a, b)
    if a.integer and b.integer:
        if {a.name, b.name} == {"uint8", "tinyint"}:
            raise TypeMismatchError(f"{a} {op} {b} mixes signed and unsigned bytes")
        return wider_integer(a, b)
    if op == "/":
        return divide_type(a, b)
    return multiply_type(a, b) if op == "*" else add_type(a, b, op)


def check_equal(a: SqlType, b: SqlType) -> None:
    """Equality takes alike types: two strings, binaries, booleans, timestamps or numbers."""
    if not (a.numeric and b.numeric or a.name == b.name and a.name in ("varchar", "varbinary", "boolean", "timestamp")):
        raise _clash("=", a, b)


def check_ordered(a: SqlType, b: SqlType) -> None:
    """Order takes numbers, booleans and timestamps, but no strings.

    Products of row values may be typed beyond 38 digits and still be compared;
    a value that needs them raises when it is computed.
    """
    if not (a.numeric and b.numeric or a.name == b.name and a.name in ("boolean", "timestamp")):
        raise _clash("<", a, b)


def check_cast(a: SqlType, b: SqlType) -> None:
    """Explicit casts that lose nothing: boolean or number to a number as wide, timestamp to bigint."""
    signed = b.integer and b.name != "uint8"
    ok = a == b
    ok |= a.name == "boolean" and signed
    ok |= a.name == "timestamp" and b.name == "bigint"
    ok |= a.integer and b.integer and b.precision >= a.precision and (b.name != "uint8" or a.name == "uint8")
    ok |= a.integer and b.name == "decimal" and b.s == 0 and b.p >= a.precision
    ok |= a.name == "decimal" and b.name == "decimal" and a.s == b.s and b.p >= a.p
    if not ok:
        raise TypeMismatchError(f"{a} can't be cast to {b}")


def check_scaling(a: SqlType, b: SqlType) -> None:
    """Implicit casts to a finer scale or time unit."""
    ok = a.numeric and b.name == "decimal" and b.s >= a.scale and b.p - b.s >= a.precision - a.scale
    ok |= a.name == b.name == "timestamp" and b.scale >= a.scale
    if not ok:
        raise TypeMismatchError(f"{a} can't be scaled to {b}")

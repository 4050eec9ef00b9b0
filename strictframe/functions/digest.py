"""Digests of tables: integrity checksums that add up over contiguous ranges of rows.

They detect accidental change; they are not cryptographic commitments.  A
column's digest is the sum modulo 2^64 of hashes of (row number, value), so the
digest of appended rows is added to that of the table.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DigestError
from ..types import SqlType

MODULUS = 1 << 64


@dataclass(frozen=True)
class Bounds:
    """What is known of a column's least and greatest value.

    ``kind``: none (its type has no order here), empty, sharp (both occur) or
    bounded (all values lie between).
    """

    kind: str
    least: object = None
    greatest: object = None

    def union(self, other: Bounds) -> Bounds:
        if "none" in (self.kind, other.kind):
            if self.kind != other.kind:
                raise DigestError("bounds of different columns")
            return self
        if "empty" in (self.kind, other.kind):
            return other if self.kind == "empty" else self
        kind = "sharp" if self.kind == other.kind == "sharp" else "bounded"
        return Bounds(kind, min(self.least, other.least), max(self.greatest, other.greatest))

    def difference(self, other: Bounds) -> Bounds:
        """After rows within ``other`` are taken away: sharp only if those lie strictly inside or nowhere."""
        if "none" in (self.kind, other.kind):
            if self.kind != other.kind:
                raise DigestError("bounds of different columns")
            return self
        if "empty" in (self.kind, other.kind) or other.least > self.greatest or other.greatest < self.least:
            return self
        inside = self.kind == "sharp" and self.least < other.least and other.greatest < self.greatest
        return self if inside else replace(self, kind="bounded")


@dataclass(frozen=True)
class Digest:
    """Rows [start, end) and, by column: its type, digest and bounds."""

    start: int
    end: int
    columns: dict[str, tuple[str, int, Bounds]]

    def _same_columns(self, other: Digest) -> None:
        if [(c, v[0]) for c, v in self.columns.items()] != [(c, v[0]) for c, v in other.columns.items()]:
            raise DigestError("digests of different columns")

    def add(self, other: Digest) -> Digest:
        """The digest of both ranges, which must adjoin."""
        self._same_columns(other)
        if self.end != other.start and other.end != self.start:
            raise DigestError(f"rows {self.start}-{self.end} and {other.start}-{other.end} don't adjoin")
        cols = {c: (t, (v + other.columns[c][1]) % MODULUS, b.union(other.columns[c][2])) for c, (t, v, b) in self.columns.items()}
        return Digest(min(self.start, other.start), max(self.end, other.end), cols)

    def subtract(self, other: Digest) -> Digest:
        """The digest without a range at one of its ends."""
        self._same_columns(other)
        if other.start < self.start or other.end > self.end:
            raise DigestError("the range taken away lies outside")
        if other.start == self.start:
            start, end = other.end, self.end
        elif other.end == self.end:
            start, end = self.start, other.start
        else:
            raise DigestError("the range taken away lies inside")
        cols = {c: (t, (v - other.columns[c][1]) % MODULUS, b.difference(other.columns[c][2])) for c, (t, v, b) in self.columns.items()}
        return Digest(start, end, cols)

    def extend(self, other: Digest) -> Digest:
        """More columns of the same rows."""
        if (self.start, self.end) != (other.start, other.end) or set(self.columns) & set(other.columns):
            raise DigestError("the columns to add are of other rows or already there")
        return Digest(self.start, self.end, self.columns | other.columns)


def column_digests(df: DataFrame, schema: dict[str, SqlType], row: str) -> DataFrame:
    """One row: ``n`` and for each column ``<name>_digest``, and its bounds where it has an order.

    One aggregate over the table, combined before the shuffle.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for c, t in schema.items():
        # A hash is a signed long; its residue is added as a decimal, which can't overflow.
        h = F.xxhash64(F.col(row).cast("bigint"), F.col(c)).cast("decimal(20,0)")
        aggs.append(F.pmod(F.sum(h).cast("decimal(38,0)"), F.lit(str(MODULUS)).cast("decimal(38,0)")).alias(f"{c}_digest"))
        if t.integer or t.name == "timestamp":
            aggs += [F.min(c).alias(f"{c}_least"), F.max(c).alias(f"{c}_greatest")]
    return df.agg(*aggs)


def digest(df: DataFrame, schema: dict[str, SqlType], row: str = "rho", start: int = 0) -> Digest:
    """The digest of a table whose column ``row`` numbers its rows from ``start`` on."""
    r = column_digests(df, schema, row).first()
    cols = {}
    for c, t in schema.items():
        if not (t.integer or t.name == "timestamp"):
            bounds = Bounds("none")
        else:
            bounds = Bounds("sharp", r[f"{c}_least"], r[f"{c}_greatest"]) if r["n"] else Bounds("empty")
        cols[c] = (str(t), int(r[f"{c}_digest"] or 0), bounds)
    return Digest(start, start + r["n"], cols)


def bounds(df: DataFrame, columns: list[str]) -> DataFrame:
    """Least and greatest value of each column, in one row."""
    return df.agg(*(f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.min, "least"), (F.max, "greatest"))))


def result_hash(df: DataFrame) -> str:
    """32 bytes (hex) for a result, whatever the order of its rows: hashes are summed, then digested."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in df.columns]
    sums = [F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(20,0)")).cast("string") for seed in range(4)]
    parts = [F.coalesce(s, F.lit("0")) for s in sums]
    return df.agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.lit(",".join(df.columns)), *parts), 256).alias("h")).first()["h"]

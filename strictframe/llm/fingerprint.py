"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A text's paragraphs (lines, cut again after sentence ends) are hashed to wide
vectors that are summed lane by lane modulo powers of two:

* 8 lanes modulo 2^64 hold BLAKE2b digests; they tell multisets apart;
* 128 lanes modulo 2^32, more than a text has paragraphs, hold +-1 by the bits of a second hash; centred, their
  scalar products estimate how many paragraphs two texts share.

So equal texts, and any order of the same paragraphs, have equal fingerprints;
fingerprints of unions are sums, and a paragraph is inserted or deleted by
adding or subtracting its vector.

Defined cases: a null text is the empty text, whose fingerprint is all zeros;
empty paragraphs don't count; rows of equal id (ties) follow each other by
text, null ids come last; a very long text is hashed paragraph
by paragraph while it and its edited text are held in one task, and its lanes hold
2^31 copies of a paragraph; repeated rows are fingerprinted row by row; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

WIDE, SIGNED = 8, 128
#: Text bytes that are fingerprinted at once: a paragraph takes some 1 KB meanwhile.
PRINT_BYTES = 1 << 20


def paragraphs(text: str) -> list[bytes]:
    b = text.encode("utf-8", "surrogatepass")
    for end in (b". ", b"! ", b"? "):
        b = b.replace(end, end[:1] + b"\n")
    return [p for p in b.split(b"\n") if p]


class Fingerprints:
    """Fingerprints of a list of texts: ``wide`` uint64 (n, 8) and ``signed`` int32 (n, 128), both wrapping."""

    def __init__(self, wide: np.ndarray, signed: np.ndarray):
        self.wide, self.signed = wide, signed

    @classmethod
    def of_parts(cls, parts: list[list[bytes]]) -> Fingerprints:
        n = len(parts)
        wide, signed = np.zeros((n, WIDE), np.uint64), np.zeros((n, SIGNED), np.int32)
        flat = [p for ps in parts for p in ps]
        if flat:
            a = np.frombuffer(b"".join([hashlib.blake2b(p).digest() for p in flat]), "<u8").reshape(-1, WIDE)
            bits = np.frombuffer(b"".join([xxhash.xxh3_128_digest(p) for p in flat]), np.uint8).reshape(-1, SIGNED // 8)
            signs = np.unpackbits(bits, axis=1).astype(np.int8) * 2 - 1
            sizes = np.array([len(ps) for ps in parts])
            full = np.flatnonzero(sizes)
            at = (np.cumsum(sizes) - sizes)[full]
            wide[full] = np.add.reduceat(a, at, axis=0)
            signed[full] = np.add.reduceat(signs, at, axis=0, dtype=np.int32)
        return cls(wide, signed)

    @classmethod
    def of(cls, texts: list[str]) -> Fingerprints:
        return cls.of_parts([paragraphs(t) for t in texts])

    def take(self, rows: np.ndarray) -> Fingerprints:
        return Fingerprints(self.wide[rows], self.signed[rows])

    def plus(self, other: Fingerprints) -> Fingerprints:
        """Fingerprints of the unions of the multisets (insertion of paragraphs)."""
        return Fingerprints(self.wide + other.wide, self.signed + other.signed)

    def minus(self, other: Fingerprints) -> Fingerprints:
        """Fingerprints after deletion of the other's paragraphs."""
        return Fingerprints(self.wide - other.wide, self.signed - other.signed)

    def hex(self) -> list[str]:
        return [a.tobytes().hex() + b.tobytes().hex() for a, b in zip(self.wide.astype("<u8"), self.signed.astype("<i4"))]

    def likeness(self, other: Fingerprints) -> np.ndarray:
        """Estimated cosine of the paragraph counts, 0 to 1; 1 exactly where the fingerprints are equal.

        The standard error is about 1 / sqrt(128), 0.09.
        """
        a, b = self.signed.astype(np.float64), other.signed.astype(np.float64)
        norm = np.sqrt((a * a).sum(1) * (b * b).sum(1))
        dots = np.divide((a * b).sum(1), norm, out=np.zeros(len(a)), where=norm > 0)
        same = (self.wide == other.wide).all(1) & (self.signed == other.signed).all(1)
        return np.where(same, 1.0, np.clip(dots, 0.0, 1.0))


def edit(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many, or all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: Characters of a text by which rows of one id are parted into ranges.
PREFIX = 32


class _Key(tuple):
    """(whether the id is known, id, start of the text), ordered by id upward, nulls first, then by text downward."""

    def __lt__(self, other: tuple) -> bool:
        return self[2] > other[2] if self[:2] == other[:2] else self[:2] < other[:2]

    @classmethod
    def of(cls, known: bool, id_: object, start: str) -> _Key:
        return cls((True, id_, start) if known else (False, 0, start))


def _ranges(docs: DataFrame, id_col: str, text_col: str, parts: int) -> list[tuple[_Key, _Key]]:
    """Least and greatest key of ranges of about equally many rows, in order; one row a range comes to the driver."""
    keys = docs.select(F.col(id_col).isNotNull().alias("known"), F.col(id_col).alias("id"), F.substring(F.coalesce(text_col, F.lit("")), 1, PREFIX).alias("start"))
    laid = keys.repartitionByRange(parts, F.col("known").asc(), F.col("id").asc(), F.col("start").desc())
    # Within a range the least key has the least id and of its texts the greatest; the other way round for the last.
    ends = laid.groupBy(F.spark_partition_id().alias("p"), "known", "id").agg(F.max("start").alias("first"), F.min("start").alias("last"))
    found = ends.groupBy("p").agg(F.min(F.struct("known", "id", "first")).alias("lo"), F.max(F.struct("known", "id", "last")).alias("hi")).collect()
    return sorted(((_Key.of(*r["lo"]), _Key.of(*r["hi"])) for r in found), key=lambda r: r[0])


def _place(ranges: list[tuple[_Key, _Key]]):
    """For keys, twice the number of their range, plus 1 for the last of it: an Arrow function."""
    starts, lasts = [lo for lo, _ in ranges[1:]], {tuple(hi) for _, hi in ranges}

    @F.arrow_udf("long")
    def place(known: pa.Array, ids: pa.Array, texts: pa.Array) -> pa.Array:
        keys = map(_Key.of, known.to_pylist(), ids.to_pylist(), texts.to_pylist())
        return pa.array([2 * bisect_right(starts, k) + (tuple(k) in lasts) for k in keys], pa.int64())

    return place


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint each row's text and its edited text, and compare it with both the edited and the next one.

    The next row is the one before it in ascending order of ids (of any type
    that has an order), cyclically.  Rows are shuffled once to ranges of about equally
    many rows and streamed in order; each range also gets the last row of the
    range before it, so no task sees more than its rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = docs.select(id_col, text_col)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = _ranges(docs, id_col, text_col, parts)
    n = max(len(ranges), 1)
    keyed = docs.select(F.col(id_col), F.col(text_col).alias("__text"), F.substring(F.coalesce(text_col, F.lit("")), 1, PREFIX).alias("__start"))
    keyed = keyed.withColumn("__at", _place(ranges)(F.col(id_col).isNotNull(), F.col(id_col), F.col("__start")))
    number = F.shiftright("__at", 1)
    own = F.struct(number.alias("range"), F.lit(False).alias("edge"))
    after = F.struct(F.pmod(number + 1, F.lit(n).cast("long")).alias("range"), F.lit(True).alias("edge"))
    places = F.when(F.col("__at").bitwiseAND(F.lit(1)) == 1, F.array(own, after)).otherwise(F.array(own))
    ordered = (
        keyed.select(id_col, "__text", F.explode(places).alias("__place"))
        .select(id_col, "__text", F.col("__place.range").cast("int").alias("__range"), F.col("__place.edge").alias("__edge"))
        .repartitionById(n, F.col("__range"))
        .sortWithinPartitions("__range", F.col("__edge").desc(), F.col(id_col).asc_nulls_first(), F.col("__text").desc_nulls_last())
    )
    made = [T.StructField("n_chars", T.LongType())] + [T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    made += [T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")]
    out = T.StructType([docs.schema[id_col], *made])
    arrow = to_arrow_schema(T.StructType(made))

    def run(batches):
        pending = None  # the row before, which is the next one of the row to come
        for batch in batches:
            for part in slices(batch, "__text", PRINT_BYTES):
                rows = pa.Table.from_batches([part] if pending is None else [pending, part]).combine_chunks().to_batches()[0]
                pending = rows.slice(rows.num_rows - 1)
                texts = ["" if t is None else t for t in rows.column(1).to_pylist()]
                ranges, edges = np.asarray(rows.column(2)), np.asarray(rows.column(3).to_numpy(zero_copy_only=False), bool)
                now = np.flatnonzero(~edges[1:] & (ranges[:-1] == ranges[1:])) + 1
                if not len(now):
                    continue
                prints = Fingerprints.of(texts)
                edited = [edit(texts[i], texts[i - 1]) for i in now]
                changed = Fingerprints.of(edited)
                own = prints.take(now)
                values = {
                    "n_chars": [len(texts[i]) for i in now],
                    "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
                    "fingerprint": own.hex(),
                    "edited_fingerprint": changed.hex(),
                    "near_edited": own.likeness(changed),
                    "near_next": own.likeness(prints.take(now - 1)),
                }
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(now)), *(pa.array(values[f.name], f.type) for f in arrow)], [id_col, *arrow.names])

    return ordered.mapInArrow(run, out)

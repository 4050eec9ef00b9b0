"""Suffix-array dedup: remove every byte covered by a string that also starts elsewhere.

Strings of ``length`` bytes (windows) are judged over the whole corpus, exactly:

1. Each window belongs to the least hash of its ``GRAM``-byte substrings, at
   the leftmost place of that hash, so equal windows belong to equal hashes
   wherever they stand.  A run of windows of one such place, with the bytes it
   spans, is a stretch; about one starts every 85 bytes, and no window occurs
   twice in a stretch.  Stretches go by as (hash, 64-bit digest of the bytes,
   place); equal ones that follow each other in periodic text share a row.
2. By hash: a hash seen once has no repeat; if all its stretches are equal,
   all their windows repeat.  Counts combine before the shuffle.
3. The rest, distinct stretches under one hash, are the shards: their bytes are
   gathered by hash (copies of a stretch once), a suffix array is built by
   induced sorting over each batch of shards, and common prefixes in text order
   show the windows that repeat.  A hash with more than ``HOT`` distinct
   stretches would be an unbounded shard; its windows are counted by 128-bit
   digests over the whole cluster instead, which is as exact.
4. Spans go back to their documents, where they are merged and cut out.

A place names its document by 80 bits of hashes of id and text, so identical
rows share spans (each of them has a copy, so they agree), and lost executors
recompute the same names.

Defined cases: a null text is the empty text; a text may have up to 2^34 bytes
(16 GB), more than a row can hold, and is cut into stretches in one task; repeated
rows are copies of each other, as are ties (equal texts under several ids); null
ids are kept; texts shorter than ``length`` lose nothing; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, slices
from .suffixes import repeated, suffix_array

LENGTH, GRAM = 200, 32
#: Text bytes that are cut into stretches at once: some 14 numbers of 8 bytes are held for each.
CUT_BYTES = 1 << 18
#: Distinct stretches of one hash up to which they share a suffix array; bytes of one array.
HOT, SHARD_BYTES = 2000, 1 << 19
#: Equal stretches in a row (periodic text) that one row may stand for; with 14 bits for its windows.
RUN = 60

_ODD = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ODD, -1, 1 << 64)
_TABLE = np.frombuffer(hashlib.shake_256(b"strictframe repeats").digest(256 * 8), "<u8")


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


class Stretches:
    """Cuts the windows of texts into stretches; holds the tables of powers it needs."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, min(gram, length)
        self.up = self.down = np.ones(1, np.uint64)

    def _gram_hashes(self, data: np.ndarray) -> np.ndarray:
        n, k = len(data), self.gram
        if len(self.up) < n + 1:
            self.up, self.down = _powers(_ODD, n), _powers(_INVERSE, n)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_TABLE[data] * self.up[:n], out=total[1:])
            h = (total[k:] - total[:-k]) * self.down[: n - k + 1]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
            return h

    def cut(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Text number, start, windows, hash and digest of each stretch."""
        none = np.zeros(0, np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        if not len(sizes) or sizes.max() < self.length:
            return none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        joined = b"".join(texts)
        h = self._gram_hashes(np.frombuffer(joined, np.uint8))
        # Sliding minimum over the grams of a window: prefix and suffix minima of blocks.
        w = self.length - self.gram + 1
        blocks = -(-len(h) // w)
        padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(h)] = h
        grid = padded.reshape(blocks, w)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(joined) - self.length + 1
        least = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])
        begins = np.cumsum(sizes) - sizes
        inside = np.zeros(n + 1, np.int8)
        long = np.flatnonzero(sizes >= self.length)
        np.add.at(inside, begins[long], 1)
        np.add.at(inside, begins[long] + sizes[long] - self.length + 1, -1)
        inside = np.cumsum(inside[:n], dtype=np.int8) > 0
        new = np.ones(n, bool)
        new[1:] = least[1:] != least[:-1]
        new[1:] |= h[: n - 1] == least[:-1]  # the window leaves the place of its hash
        new[begins[long]] = True
        new[1:] |= inside[1:] != inside[:-1]
        starts = np.flatnonzero(new)
        counts = np.diff(np.append(starts, n))
        valid = inside[starts]
        starts, counts = starts[valid], counts[valid]
        of = np.searchsorted(begins, starts, side="right") - 1
        view, digest, tail = memoryview(joined), xxhash.xxh3_64_intdigest, self.length - 1
        digests = np.array([digest(view[a : a + n + tail]) for a, n in zip(starts.tolist(), counts.tolist())], np.uint64)
        hashes = least[starts]
        # Equal stretches in a row: the first stays alone, the others share rows of RUN at most.
        again = np.zeros(len(starts), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (digests[1:] == digests[:-1]) & (of[1:] == of[:-1])
        if again.any():
            at = np.arange(len(again))
            group = np.maximum.accumulate(np.where(again, 0, at))
            head = ~again | ((at - group - 1) % RUN == 0)
            keep = np.flatnonzero(head)
            counts = np.add.reduceat(counts, keep)
            of, starts, hashes, digests = of[keep], starts[keep], hashes[keep], digests[keep]
        return of, starts - begins[of], counts, hashes, digests


def _keys(id_col: str, text_col: str) -> list[Column]:
    return [F.xxhash64(F.col(id_col), F.col(text_col)).alias("__h"), F.xxhash64(F.col(text_col), F.lit(1)).bitwiseAND(F.lit((1 << 16) - 1)).cast("int").alias("__g")]


def _bytes_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [b"" if t is None else t for t in batch.column(column).cast(pa.binary()).to_pylist()]


def _stretch_rows(keyed: DataFrame, text_col: str, length: int, gram: int, places: bool) -> DataFrame:
    """(hash, digest) of each stretch, and with ``places`` its document and place."""
    fields = [T.StructField("m", T.LongType()), T.StructField("c", T.LongType())]
    if places:
        # One long holds 16 bits of the document's name, then 34 of the start and 14 of the windows.
        fields += [T.StructField("__h", T.LongType()), T.StructField("at", T.LongType())]

    def run(batches) -> Iterator[pa.RecordBatch]:
        s = Stretches(length, gram)
        for batch in batches:
            for part in slices(batch, text_col, CUT_BYTES):
                of, start, n, least, digests = s.cut(_bytes_of(part, text_col))
                cols = [pa.array(least.view(np.int64)), pa.array(digests.view(np.int64))]
                if places:
                    name = np.asarray(part.column("__h"))[of]
                    low = np.asarray(part.column("__g")).astype(np.int64)[of]
                    cols += [pa.array(name), pa.array((low << 48) | (start << 14) | n)]
                yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields])

    return keyed.select(text_col, "__h", "__g").mapInArrow(run, T.StructType(fields))


_ALL, _SHIP, _COUNT = 1, 2, 4  # what is done with a stretch: all of it repeats; to a shard; windows counted


def _spans_to_ship(keyed: DataFrame, text_col: str, wanted: DataFrame, action: int, length: int) -> DataFrame:
    """Bytes of the stretches marked with ``action``, read from their documents."""
    spans = wanted.filter(F.col("do").bitwiseAND(F.lit(action)) > 0).groupBy("__h", "__g").agg(F.collect_set(F.struct("start", "n", "m", (F.col("do").bitwiseAND(F.lit(_ALL)) == 0).alias("open"))).alias("spans"))
    out = T.StructType([T.StructField("m", T.LongType()), T.StructField("__h", T.LongType()), T.StructField("__g", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("open", T.BooleanType()), T.StructField("bytes", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                rows: list[tuple] = []
                for text, h, g, spans in zip(_bytes_of(part, text_col), part.column("__h").to_pylist(), part.column("__g").to_pylist(), part.column("spans").to_pylist()):
                    rows += [(s["m"], h, g, s["start"], s["open"], text[s["start"] : s["start"] + s["n"] + length - 1]) for s in spans]
                if rows:
                    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], out.names)

    # Identical rows ship the same bytes twice, but only as witnesses, as their stretches are copies.
    # All columns go along so that this join and the last one read one and the same exchange.
    return keyed.join(spans.hint("shuffle_hash"), ["__h", "__g"]).select(*keyed.columns, "spans").mapInArrow(run, out)


_FOUND = "__h long, __g int, start long, n long"


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2] - edge[::2]


def _shard_repeats(shipped: DataFrame, length: int) -> DataFrame:
    """Repeating windows of the shards, as (document, start, windows)."""

    def run(batches):
        held: list[tuple] = []
        size, last = 0, None

        def solve() -> pa.RecordBatch:
            joined = b"\xff".join(x[-1] for x in held)  # a byte that UTF-8 has not: no window matches across it
            data = np.frombuffer(joined, np.uint8)
            flags = repeated(data, suffix_array(data), length)
            out, at = [], 0
            for _, h, g, start, open_, raw in held:
                if open_:
                    for s, n in zip(*(x.tolist() for x in _runs(flags[at : at + len(raw) - length + 1]))):
                        out.append((h, g, start + s, n))
                at += len(raw) + 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 4, types)], ["__h", "__g", "start", "n"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("m", "__h", "__g", "start", "open", "bytes"))):
                if row[0] != last and size >= SHARD_BYTES:
                    yield solve()
                    held, size = [], 0
                last = row[0]
                held.append(row)
                size += len(row[-1])
        if held:
            yield solve()

    parts = int(shipped.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shipped.repartition(parts, "m").sortWithinPartitions("m").mapInArrow(run, _FOUND)


def _counted_repeats(shipped: DataFrame, length: int) -> DataFrame:
    """Repeating windows of hashes with very many stretches: each window's digest is counted."""

    def run(batches):
        for batch in batches:
            for h, g, start, raw in zip(*(batch.column(c).to_pylist() for c in ("__h", "__g", "start", "bytes"))):
                view, n = memoryview(raw), len(raw) - length + 1
                d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[i : i + length]) for i in range(n)), "<i8").reshape(-1, 2)
                cols = [pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.array(np.full(n, h)), pa.array(np.full(n, g, np.int32)), pa.array(start + np.arange(n))]
                yield pa.RecordBatch.from_arrays(cols, ["a", "b", "__h", "__g", "start"])

    windows = shipped.mapInArrow(run, "a long, b long, __h long, __g int, start long")
    twice = windows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("a", "b")
    return windows.join(twice, ["a", "b"]).select("__h", "__g", "start", F.lit(1).cast("long").alias("n"))


def repeated_spans(keyed: DataFrame, text_col: str, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row a document that loses bytes: its name (``__h``, ``__g``) and ``spans`` of (start, windows)."""
    by_hash = _stretch_rows(keyed, text_col, length, gram, False).groupBy("m").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("k > 1").select("m", (F.col("lo") == F.col("hi")).alias("same"))
    places = _stretch_rows(keyed, text_col, length, gram, True)
    found = checkpointed(places.join(by_hash, "m"))
    place = [F.col("__h"), F.shiftrightunsigned("at", 48).cast("int").alias("__g"), F.shiftright("at", 14).bitwiseAND(F.lit((1 << 34) - 1)).alias("start"), F.col("at").bitwiseAND(F.lit((1 << 14) - 1)).alias("n")]
    same = found.filter("same").select(*place, "m", F.lit(_ALL).alias("do"))
    mixed = found.filter(~F.col("same"))
    kinds = mixed.groupBy("m", "c").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("__h", "at")).alias("first"))
    twice = kinds.filter("k > 1").select("m", "c")
    kinds = kinds.join(kinds.groupBy("m").agg(F.count(F.lit(1)).alias("kinds")), "m")
    send = F.when(F.col("kinds") > hot, F.lit(_COUNT)).otherwise(F.lit(_SHIP))
    # Of equal stretches one goes to the shard, as a witness; all of them repeat already.
    ship = kinds.select("m", F.col("first.__h").alias("__h"), F.col("first.at").alias("at"), (send + F.when(F.col("k") > 1, F.lit(_ALL)).otherwise(F.lit(0))).alias("do")).select(*place, "m", "do")
    copies = mixed.join(twice, ["m", "c"]).select(*place, "m", F.lit(_ALL).alias("do"))
    ship = checkpointed(ship)
    spans = same.select("__h", "__g", "start", "n").unionAll(copies.select("__h", "__g", "start", "n"))
    spans = spans.unionAll(_shard_repeats(_spans_to_ship(keyed, text_col, ship, _SHIP, length), length))
    if not ship.filter(F.col("do").bitwiseAND(F.lit(_COUNT)) > 0).isEmpty():
        spans = spans.unionAll(_counted_repeats(_spans_to_ship(keyed, text_col, ship, _COUNT, length), length))
    return spans.groupBy("__h", "__g").agg(F.collect_set(F.struct("start", "n")).alias("spans"))


def merged(spans: list[dict[str, int]], length: int) -> list[tuple[int, int]]:
    """Byte ranges covered by the windows of spans, merged where they overlap or touch."""
    out: list[tuple[int, int]] = []
    for start, n in sorted((s["start"], s["n"]) for s in spans):
        end = start + n + length - 1
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = out[-1][0], end
        else:
            out.append((start, end))
    return out


def remove_repeats(docs: DataFrame, make, fields: list[T.StructField], keep: list[str], id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Map each row by ``make()(bytes, removed ranges)`` to ``fields``; the columns ``keep`` go along."""
    from pyspark.sql.pandas.types import to_arrow_schema

    columns = list(dict.fromkeys([*keep, id_col, text_col]))
    keyed = docs.select(*columns, *_keys(id_col, text_col))
    spans = repeated_spans(keyed, text_col, length, gram, hot)
    joined = keyed.join(spans.hint("shuffle_hash"), ["__h", "__g"], "left").select(*columns, "spans")
    out = T.StructType([*(docs.schema[c] for c in keep), *fields])
    arrow = to_arrow_schema(T.StructType(fields))

    def run(batches):
        f = make()
        for batch in batches:
            for part in slices(batch, text_col):
                rows = [f(t, merged(s, length) if s else []) for t, s in zip(_bytes_of(part, text_col), part.column("spans").to_pylist())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(c, x.type) for c, x in zip(zip(*rows), arrow))], out.names)

    return joined.mapInArrow(run, out)


def kept_bytes(text: bytes, removed: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in removed:
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return b"".join(out)


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    def make():
        return lambda t, removed: (len(t), sum(b - a for a, b in removed), len(removed), hashlib.sha256(kept_bytes(t, removed)).hexdigest())

    fields = [*(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())]
    return remove_repeats(docs, make, fields, [id_col], id_col, text_col, length, gram, hot)


def without_repeats(docs: DataFrame, columns: list[str], id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``columns`` of the documents, the text without its repeats; a character cut in two is dropped."""
    fields = [T.StructField("__kept", T.StringType())]

    def make():
        return lambda t, removed: (kept_bytes(t, removed).decode("utf-8", "ignore"),)

    kept = remove_repeats(docs, make, fields, [c for c in columns if c != text_col], id_col, text_col, length, gram, hot)
    return kept.select(*(F.col("__kept").alias(c) if c == text_col else c for c in columns))

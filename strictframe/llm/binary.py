"""Token ids packed to fixed rows: best-fit decreasing with a segment tree over free room.

Each task reads its documents, cuts the ids of overlong ones into pieces
without loss and packs the pieces it has gathered, at most ``BATCH_TOKENS`` ids
at a time, so memory is bounded and nothing is shuffled; a partly filled row
remains for each such batch at most, besides what best fit leaves.  Packing a
batch is exact in what it stores, whatever its size: no id is lost or repeated.

A row of the output is one packed sequence: ``ids`` (padded to the capacity)
and ``positions`` are little-endian unsigned 16- or 32-bit matrices' rows,
``cu_seqlens`` the cumulative segment lengths from 0, ``resets`` the offsets at
which positions start again from 0.

Defined cases: a null text is the empty text, which gives the end id alone; a
very long text is cut into rows without loss, while its ids are held in one task;
of pieces of equal length (ties) the earlier one is packed first; repeated rows and null ids are packed as documents of their own; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices, texts_of
from .tokens import ByteTokens, cut

CAPACITY, END_ID, PAD_ID = 2048, 50256, 50256
BATCH_TOKENS = 4 << 20


class RoomTree:
    """Open rows by free room: a segment tree finds the least room of at least a given size."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.full = np.zeros(2 * self.leaves, np.int64).tolist()  # rows in each subtree
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.leaves
        while i:
            self.full[i] += 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove a row with the least room >= size; its room and number."""
        i = size + self.leaves
        if not self.full[i]:
            while i > 1 and (i & 1 or not self.full[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i *= 2
                if not self.full[i]:
                    i += 1
        room = i - self.leaves
        row = self.rows[room].pop()
        while i:
            self.full[i] -= 1
            i >>= 1
        return room, row


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Rows of piece numbers, each piece in the fullest row that takes it, longest pieces first."""
    tree, rows = RoomTree(capacity), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        found = tree.take(size)
        if found is None:
            rows.append([])
            found = capacity, len(rows) - 1
        room, row = found
        rows[row].append(i)
        tree.add(room - size, row)
    return rows


def token_rows(
    docs: DataFrame,
    make_tokens,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    pad_id: int = PAD_ID,
    wide: bool = False,
) -> DataFrame:
    """Packed sequences; ``wide`` chooses 32-bit ids, needed for vocabularies over 65,536."""
    docs = docs.select(id_col, text_col)
    id_type = docs.schema[id_col].dataType
    out = T.StructType([
        T.StructField("sequence_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
        T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())), T.StructField("resets", T.ArrayType(T.IntegerType())), T.StructField("positions", T.BinaryType()),
        T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ids_crc32", T.LongType()),
    ])
    kind = np.dtype("<u4" if wide else "<u2")
    end = np.array([end_id], "<u4")

    def packed(number: int, held: list[tuple[object, int, np.ndarray]], arrow_id: pa.DataType) -> pa.RecordBatch:
        rows = best_fit_decreasing(np.array([len(ids) for _, _, ids in held]), capacity)
        cols: list[list] = [[] for _ in out]
        for k, row in enumerate(rows):
            ids = np.concatenate([held[i][2] for i in row])
            cu = np.cumsum([0, *(len(held[i][2]) for i in row)])
            starts = np.repeat(cu[:-1], np.diff(cu))
            line = np.full(capacity, pad_id, kind)
            line[: len(ids)] = ids
            values = (number + k, len(ids), line.tobytes(), cu.tolist(), cu[:-1].tolist(), (np.arange(len(ids)) - starts).astype(kind).tobytes(), [held[i][0] for i in row], [held[i][1] for i in row], zlib.crc32(line.tobytes()))
            for c, v in zip(cols, values):
                c.append(v)
        types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.list_(arrow_id), pa.list_(pa.int64()), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], out.names)

    def run(batches):
        from pyspark import TaskContext

        tokens: ByteTokens = make_tokens()
        held, total, number, arrow_id = [], 0, TaskContext.get().partitionId() << 40, None
        for batch in batches:
            arrow_id = batch.schema.field(0).type
            for part in slices(batch, text_col):
                for doc, text in zip(part.column(0).to_pylist(), texts_of(part, text_col)):
                    ids = np.concatenate([tokens.encode(text), end])
                    if ids.max() > np.iinfo(kind).max:
                        raise ValueError("an id needs 32 bits; pass wide=True")
                    held += [(doc, s, ids[s : s + n].astype(kind)) for s, n in cut(len(ids), capacity)]
                    total += len(ids)
                    if total >= BATCH_TOKENS:
                        made = packed(number, held, arrow_id)
                        number += made.num_rows
                        held, total = [], 0
                        yield made
        if held:
            yield packed(number, held, arrow_id)

    return docs.mapInArrow(run, out)


def written(rows: DataFrame, folder: str) -> DataFrame:
    """The packed rows, written as Parquet through Hadoop's file systems (any store the cluster has) and read back.

    A row of the files is a row of the matrices.  Spark commits tasks one by
    one, so a task that runs again leaves no second copy.
    """
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def write_rows(rows: DataFrame, folder: str) -> DataFrame:
    """Write the packed rows of each task as raw matrices in a folder that is mounted on all executors.

    Use ``written`` where the shared folder is no mounted one.

    For each task: ``ids-P.bin`` (rows of ids one after another), ``cu-P.bin``
    (int32, the cumulative lengths of the rows joined) and ``pos-P.bin``.  Files
    are written under another name and renamed, so a task that runs again
    replaces them whole.  Returns one row a file: path, rows, bytes, crc32.
    """

    def run(batches):
        from pyspark import TaskContext

        t = TaskContext.get()
        os.makedirs(folder, exist_ok=True)
        names = {c: os.path.join(folder, f"{c}-{t.partitionId():06d}.bin") for c in ("ids", "cu", "pos")}
        parts = {c: f"{n}.{t.taskAttemptId()}" for c, n in names.items()}
        files = {c: open(n, "wb") for c, n in parts.items()}  # noqa: SIM115
        crc, n = dict.fromkeys(names, 0), 0
        for batch in batches:
            n += batch.num_rows
            for ids, cu, pos in zip(*(batch.column(c).to_pylist() for c in ("ids", "cu_seqlens", "positions"))):
                for c, v in (("ids", ids), ("cu", np.array(cu, "<i4").tobytes()), ("pos", pos)):
                    files[c].write(v)
                    crc[c] = zlib.crc32(v, crc[c])
        sizes = {}
        for c, f in files.items():
            sizes[c] = f.tell()
            f.close()
            os.replace(parts[c], names[c])
        yield pa.RecordBatch.from_pydict({"path": list(names.values()), "rows": [n] * 3, "bytes": list(sizes.values()), "crc32": list(crc.values())})

    return rows.select("ids", "cu_seqlens", "positions").mapInArrow(run, "path string, rows long, bytes long, crc32 long")


def unpack_rows(rows: DataFrame, wide: bool = False) -> DataFrame:
    """The pieces back from packed rows: doc id, start, and their ids as an array."""
    kind = "<u4" if wide else "<u2"
    item = rows.schema["doc_ids"].dataType.elementType
    out = T.StructType([T.StructField("doc_id", item), T.StructField("start", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            docs, starts, ids = [], [], []
            for raw, cu, d, s in zip(*(batch.column(c).to_pylist() for c in ("ids", "cu_seqlens", "doc_ids", "starts"))):
                line = np.frombuffer(raw, kind)
                docs += d
                starts += s
                ids += [line[a:b].tolist() for a, b in zip(cu, cu[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(docs, batch.schema.field("doc_ids").type.value_type), pa.array(starts, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], out.names)

    return rows.select("ids", "cu_seqlens", "doc_ids", "starts").mapInArrow(run, out)

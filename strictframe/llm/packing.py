"""Best-fit packing by a configuration linear program over the length histogram.

The tokens are read once, for the pieces (id, start, length, checksum).  On the
histogram of piece lengths the driver solves the configuration program: a
configuration is a multiset of lengths that fits a sequence, and the fewest
sequences that cover all lengths are wanted.

1. Multiplicative weights on the covering program: each length has a price; a
   knapsack dynamic program over lengths and their counts prices all
   configurations at once.  A round serves an equal share of the demand of
   every length by the best configurations still to be had, and the price of
   what it leaves unserved is multiplied up.  The served demand is the primal
   solution, ``value`` its sequences; prices divided by the worth of the best
   configuration are a dual solution, ``bound`` the best such value or that of
   step prices.  Solving again from the last prices stops at a gap of ``GAP``.
2. Rounding: whole copies of each configuration, most used first.
3. The residue, less than one copy of each configuration, goes through the same
   pricing with whole copies only, down to the last piece.

Plans depend on the number of distinct lengths (at most the capacity), not on
the number of pieces.  Pieces of one length are interchangeable: a piece's rank
among those of its length finds its place in the plan.  Ranks come from counts
by partition, so that no length, however common, is gathered in one task.

Defined cases: a null text is the empty text, one token (the end id); a very
long text is cut into pieces of the capacity, and its ids are held in one task
while that is done; ties of lengths are ranked by partition, then id, piece and
checksum; repeated rows and null ids are packed as documents of their own; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, slices, texts_of
from .tokens import ByteTokens, cut

CAPACITY, END_ID = 2048, 0
#: Rounds that share the demand of one solution, at most; more that serve what they leave; the learning rate.
ROUNDS, REST_ROUNDS, RATE = 4, 5, 0.03
#: Power of the length at which the prices of pieces start: long pieces are the hard ones.
BULK = 1.5
#: Room of a sequence that a configuration may leave, in a round and (in turn) for the residue.
SLACK, RESIDUE_SLACK = 0.002, (0.0005, 0.002, 0.01)
#: Solutions from prices learnt before, and the gap between primal and dual value at which no further one is sought.
SOLUTIONS, GAP = 3, 0.001

#: A pattern is a tuple of (length, copies), longest first; a plan lists (pattern, sequences).
Pattern = tuple[tuple[int, int], ...]
Plan = list[tuple[Pattern, int]]


class Knapsack:
    """Most valuable multisets of lengths for every room at once, no length more often than it occurs."""

    def __init__(self, lengths: np.ndarray, prices: np.ndarray, counts: np.ndarray, capacity: int):
        self.lengths, self.counts, self.capacity = lengths.tolist(), counts.tolist(), capacity
        # The copies of a length that fit are split into powers of two and a rest: items that are taken or not.
        items = []
        for j, n in enumerate(np.minimum(counts, capacity // lengths).astype(np.int64).tolist()):
            step = 1
            while n:
                items.append((j, min(step, n)))
                n -= items[-1][1]
                step *= 2
        self.items = items
        best, took = np.zeros(capacity + 1), np.zeros((len(items), capacity + 1), bool)
        for i, (j, copies) in enumerate(items):
            size = self.lengths[j] * copies
            total = best[: capacity + 1 - size] + prices[j] * copies
            better = total > best[size:] + 1e-12
            took[i, size:] = better
            np.copyto(best[size:], total, where=better)
        self.most = best[capacity]
        kind = np.int16 if len(items) < 1 << 15 else np.int32
        #: The last item taken among the first i + 1, for each room; -1 for none.
        self.last = np.maximum.accumulate(np.where(took, np.arange(len(items), dtype=kind)[:, None], kind(-1)), axis=0)

    def configuration(self, j: int, left: list[float], least: float) -> dict[int, int]:
        """Copies by number of length in the best configuration with length j, of lengths with ``least`` a copy left.

        A choice that is used up is passed over; the table then has the best one among the lengths before it.
        """
        lengths, counts, items, last = self.lengths, self.counts, self.items, self.last
        out, room, i = {j: 1}, self.capacity - lengths[j], len(items) - 1
        while i >= 0:
            i = int(last[i, room])
            if i < 0:
                break
            k, copies = items[i]
            n = out.get(k, 0) + copies
            if n <= counts[k] and left[k] >= least * n:
                out[k] = n
                room -= lengths[k] * copies
            i -= 1
        return out

    def serve(self, left: list[float], slack: float, whole: bool) -> Iterator[tuple[dict[int, int], float]]:
        """Configurations and how often each is used, until none is left that fills all but ``slack`` of a sequence.

        ``left``, the demand by length, is reduced; ``whole`` uses whole copies only.
        """
        least = 1.0 if whole else 1e-9
        full = (1 - slack) * self.capacity
        for j in range(len(self.lengths) - 1, -1, -1):
            while left[j] >= least:
                c = self.configuration(j, left, least)
                if sum(self.lengths[k] * n for k, n in c.items()) < full:
                    break
                times = min(left[k] / n for k, n in c.items())
                if whole:
                    times = math.floor(times)
                for k, n in c.items():
                    left[k] -= times * n
                yield c, times


@dataclass
class Program:
    """A solved and rounded configuration program."""

    plan: Plan
    value: float  # sequences of the fractional solution
    bound: float  # value of the best dual solution: no packing has fewer
    rounded: int  # sequences that come from rounding the fractional solution down
    residue: int  # sequences that the residue took

    @property
    def gap(self) -> float:
        return self.value / self.bound - 1 if self.bound else 0.0


def _step_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> float:
    """The best dual value among step prices: 1 above ``capacity`` - a, 0 below a, in proportion to the length between.

    Each is a dual solution for any histogram; a = 0 is the bound by size.
    """
    best = 0.0
    steps = np.unique(np.concatenate([[0], lengths, capacity + 1 - lengths]))
    for a in steps[steps <= capacity // 2].tolist():
        price = np.where(lengths > capacity - a, 1.0, np.where(lengths >= a, lengths / capacity, 0.0))
        best = max(best, float((counts * price).sum()))
    return best


def _solution(lengths: np.ndarray, counts: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[dict[Pattern, float], float, float, np.ndarray]:
    """One run of multiplicative weights: configurations, their sum, the best dual value, and the prices learnt."""
    demand = counts.astype(np.float64)
    used: defaultdict[Pattern, float] = defaultdict(float)
    left, value, bound = np.zeros(len(lengths)), 0.0, 0.0
    for r in range(ROUNDS + REST_ROUNDS + 1):
        if r < ROUNDS:
            left = left + demand / ROUNDS
        priced = Knapsack(lengths, prices, counts, capacity)
        bound = max(bound, float((demand * prices).sum() / priced.most))
        now = left.tolist()
        for c, times in priced.serve(now, SLACK if r < ROUNDS + REST_ROUNDS else 1.0, False):
            used[tuple(sorted(((int(lengths[k]), n) for k, n in c.items()), reverse=True))] += times
            value += times
        left = np.array(now)
        prices = prices * np.exp(RATE * ROUNDS * np.maximum(left, 0) / demand)
        if r >= ROUNDS and (left < 1e-6).all():
            break
    return dict(used), value, bound, prices


def solve_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> Program:
    """The configuration program of a histogram of lengths, solved by multiplicative weights and rounded."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return Program([], 0.0, 0.0, 0, 0)
    n = counts[lengths]
    bound = _step_bound(lengths, n, capacity)
    prices = (lengths / capacity) ** BULK
    used, value = {}, math.inf
    for _ in range(SOLUTIONS):
        found, total, dual, prices = _solution(lengths, n, prices, capacity)
        bound = max(bound, dual)
        if total < value:
            used, value = found, total
        if value <= bound * (1 + GAP):
            break
    left = counts.copy()
    plan: Counter[Pattern] = Counter()
    for pattern, times in sorted(used.items(), key=lambda x: (-x[1], x[0])):
        whole = min(math.floor(times + 1e-6), *(int(left[length]) // copies for length, copies in pattern))
        if whole > 0:
            plan[pattern] += whole
            for length, copies in pattern:
                left[length] -= whole * copies
    rounded = sum(plan.values())
    for slack in (*RESIDUE_SLACK, 1.0):
        some = left[lengths] > 0
        if not some.any():
            break
        open_ = lengths[some]
        now = left[open_].tolist()
        for c, times in Knapsack(open_, prices[some], left[open_], capacity).serve(now, slack, True):
            plan[tuple(sorted(((int(open_[k]), m) for k, m in c.items()), reverse=True))] += times
        left[open_] = now
        prices = np.where(left[lengths] > 0, prices * math.exp(RATE), prices)
    return Program(list(plan.items()), value, bound, rounded, sum(plan.values()) - rounded)


@dataclass
class Places:
    """A plan as arrays: for each length, where each run of ranks goes."""

    key: np.ndarray  # length * BIG + first rank of the run, ascending
    first: np.ndarray
    sequence: np.ndarray
    copies: np.ndarray
    offset: np.ndarray

    BIG = 1 << 48

    @classmethod
    def of(cls, plan: Plan) -> Places:
        rank: Counter[int] = Counter()
        rows, at = [], 0
        for pattern, k in plan:
            offset = 0
            for length, copies in pattern:
                rows.append((length * cls.BIG + rank[length], rank[length], at, copies, offset))
                rank[length] += copies * k
                offset += copies * length
            at += k
        return cls(*np.array(sorted(rows), np.int64).reshape(-1, 5).T.copy())

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces of given lengths and ranks."""
        i = np.searchsorted(self.key, length * self.BIG + rank, side="right") - 1
        over = rank - self.first[i]
        return self.sequence[i] + over // self.copies[i], self.offset[i] + over % self.copies[i] * length


def pieces(docs: DataFrame, make_tokens, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32`` of each piece; one map pass."""
    docs = docs.select(id_col, text_col)
    fields = [T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    end = np.array([end_id], "<u4")

    def run(batches):
        tokens: ByteTokens = make_tokens()
        for batch in batches:
            for part in slices(batch, text_col):
                row, out = [], ([], [], [], [])
                for i, text in enumerate(texts_of(part, text_col)):
                    ids = np.concatenate([tokens.encode(text), end])
                    raw = memoryview(ids.tobytes())
                    for k, (start, length) in enumerate(cut(len(ids), capacity)):
                        row.append(i)
                        for to, v in zip(out, (k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]))):
                            to.append(v)
                yield pa.RecordBatch.from_arrays([part.column(id_col).take(pa.array(row, pa.int64())), *map(pa.array, out, types)], [id_col, *(f.name for f in fields)])

    return docs.mapInArrow(run, T.StructType([docs.schema[id_col], *fields]))


def pack(docs: DataFrame, make_tokens, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece with its ``sequence_id`` and its ``offset`` there."""
    # The checkpointed pieces are a few dozen bytes each; partition numbers read from them are stable.
    made = checkpointed(pieces(docs, make_tokens, id_col, text_col, capacity, end_id)).withColumn("__part", F.spark_partition_id())
    counts = made.groupBy("length", "__part").agg(F.count(F.lit(1)).alias("__n"))
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    places = Places.of(solve_packing(histogram, capacity).plan)
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("length", "__part").orderBy(F.col(id_col), "piece", "ids_crc32")
    ranked = made.withColumn("__rank", F.row_number().over(within) - 1).join(bases, ["length", "__part"])
    columns = [id_col, "piece", "start", "length", "ids_crc32"]
    ranked = ranked.select(*columns, (F.col("__base") + F.col("__rank")).cast("long").alias("__rank"))
    out = T.StructType([*(ranked.schema[c] for c in columns), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                sequence, offset = places.find(np.asarray(batch.column("length")), np.asarray(batch.column("__rank")))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], out.names)

    return ranked.mapInArrow(place, out)

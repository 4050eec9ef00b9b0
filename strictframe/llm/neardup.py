"""SimHash near-dedup: fingerprints of word shingles, near neighbours, exact check, classes.

1. Each text's set of distinct ``WORDS``-word shingles (lower case; a shorter
   text is one shingle) gives a digest of the set and a 192-bit SimHash.  Texts
   of equal sets are one node, so copies are never compared with each other.
2. Nodes go through the recursion of ``nearest``: a row for each small list a
   fingerprint falls into, lists are searched by brute force, and what is near
   enough by all 192 bits is a candidate.  A forest and the nearest neighbours
   are noted, never all pairs of a group.  Where the plan asks for many lists it
   is repeated in runs with other filters.
3. Candidates are checked by the exact Jaccard coefficient of their sets; large groups
   that this leaves in several classes are searched again, completely.
4. Classes are the connected components of what passed, found by star
   contraction on tables; nothing of the corpus reaches the driver.

The design distance is that of a pair at the threshold, plus one standard
deviation of the fingerprints; candidates are kept up to four of them, 49 of 192
bits, which two unrelated fingerprints keep with a chance of 5e-12: unrelated
texts don't chain into groups before there are about 10^11 of them.

Limits that bound a task's memory, and what makes up for them: a list of more
than ``HOT_LIST`` rows is cut into blocks, in each list by other hashes, and what
its blocks leave apart meets block by block (``_meetings``); of a dense list only
a forest and the nearest ones are noted.  Neither parts rows that hang together
by near pairs of a list, and a group is then searched completely (``settled``),
so a link is lost only if its two nodes share no list and no chain of near ones
joins them.  README has measured figures.

Defined cases: a null text is the empty text; texts without words are copies of
each other; a very long text is shingled whole, in one task; ties don't arise, as
classes don't depend on an order; null ids are classed by their texts; repeated
rows get one class; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, slices
from .components import components
from .nearest import BLOCK, NEIGHBOURS, SMALL, Recursion, links

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.9999
#: Fingerprints from which a list is cut into blocks of about ``BLOCK``.
HOT_LIST = 8 * SMALL
BITS = 192
#: Columns that hold the words of a fingerprint.
PRINT = tuple(f"f{k}" for k in range(BITS // 64))

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def distances(similarity: float = SIMILARITY) -> tuple[float, int]:
    """The design distance (relative) and the greatest distance (bits) of a candidate."""
    cosine = 2 * similarity / (1 + similarity)
    d = math.acos(cosine) / math.pi
    deviation = math.sqrt(d * (1 - d) / BITS)
    return d + deviation, math.ceil((d + 4 * deviation) * BITS)


class Shingles:
    """Distinct shingle hashes of texts; keeps a bounded table of the words it has seen."""

    TABLE_WORDS = 400_000

    def __init__(self, words: int = WORDS):
        self.words = words
        self.number: dict[bytes, int] = {}
        self.hashes = np.zeros(0, np.uint64)

    def _word_hashes(self, words: list[bytes]) -> np.ndarray:
        number = self.number
        new = list(set(words).difference(number))
        if new:
            if len(number) > self.TABLE_WORDS:
                number.clear()
                self.hashes = np.zeros(0, np.uint64)
                new = list(set(words))
            at = len(number)
            number.update(zip(new, range(at, at + len(new))))
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))])
        return self.hashes[np.fromiter(map(number.__getitem__, words), np.int64, len(words))]

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingle hashes of all texts, one text after another, and how many each has."""
        split = [t.lower().encode("utf-8", "surrogatepass").split() for t in texts]
        counts = np.array([len(w) for w in split], np.int64)
        h = self._word_hashes([w for ws in split for w in ws])
        n, k = len(h), self.words
        shingles = np.minimum(np.maximum(counts - k + 1, 0) + ((counts > 0) & (counts < k)), np.maximum(counts, 0))
        if not n:
            return np.zeros(0, np.uint64), shingles
        ends = np.repeat(np.cumsum(counts), counts)
        with np.errstate(over="ignore"):
            total = np.zeros(n, np.uint64)
            for j in range(k):
                at = np.arange(n) + j
                term = _mix(h[np.minimum(at, n - 1)] + np.uint64(j + 1))
                total += np.where(at < ends, term, np.uint64(0)) * np.uint64(2 * j + 3)
        total = _mix(total)
        place = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
        valid = place < np.repeat(shingles, counts)
        of = np.repeat(np.arange(len(texts)), counts)[valid]
        total = total[valid]
        key = total ^ _mix(of.astype(np.uint64) + np.uint64(77))
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key), bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        return total[~again], np.bincount(of[~again], minlength=len(texts))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of rows, zero for an empty group."""
    out = np.zeros((len(counts), *values.shape[1:]), values.dtype)
    full = np.flatnonzero(counts)
    if len(full):
        out[full] = np.add.reduceat(values, (np.cumsum(counts) - counts)[full], axis=0)
    return out


def simhash(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SimHash words (n, 3) of consecutive groups of shingle hashes."""
    seeds = np.arange(1, len(PRINT) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        hashes = np.stack([_mix(shingles + seed) for seed in seeds], axis=1)
    # A byte a bit, added eight at a time as 64-bit words: groups are cut to 255 rows, so no byte overflows.
    bits = np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little").view(np.uint64)
    parts = -(-counts // 255)
    total = int(parts.sum())
    part = np.full(total, 255, np.int64)
    last = np.cumsum(parts)[counts > 0] - 1
    part[last] = (counts - (parts - 1) * 255)[counts > 0]
    ones = _sums(_sums(bits, part).view(np.uint8).astype(np.int32), parts) if total else np.zeros((len(counts), BITS), np.int32)
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view(np.uint64)


def node_digests(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set, which doesn't depend on the order of its members."""
    with np.errstate(over="ignore"):
        return _mix(_sums(_mix(shingles ^ np.uint64(0xA5A5)), counts) + _mix(counts.astype(np.uint64))).view(np.int64)


_NODE = [T.StructField(c, T.LongType()) for c in ("node", *PRINT)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``id_col``, a hash of the text, ``node`` and the fingerprint of each row; one map pass."""
    docs = docs.select(id_col, text_col, F.xxhash64(text_col).alias("__text"))

    def run(batches):
        s = Shingles(words)
        for batch in batches:
            for part in slices(batch, text_col, 1 << 20):
                h, n = s.of(["" if t is None else t for t in part.column(1).to_pylist()])
                f = simhash(h, n).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(node_digests(h, n)), *(pa.array(x.copy()) for x in f.T)], [id_col, "__text", "node", *PRINT])

    return docs.mapInArrow(run, T.StructType([docs.schema[id_col], docs.schema["__text"], *_NODE]))


def _runs(batches, keys: tuple[str, ...], columns: tuple[str, ...]):
    """The rows of each run of equal keys, which may go over several batches, as an array of ``columns``."""
    names, rest = np.zeros((0, len(keys)), np.int64), np.zeros((0, len(columns)), np.int64)
    for batch in batches:
        names = np.concatenate([names, np.stack([np.asarray(batch.column(c)) for c in keys], axis=1)])
        rest = np.concatenate([rest, np.stack([np.asarray(batch.column(c)) for c in columns], axis=1)])
        cuts = np.flatnonzero((np.diff(names, axis=0) != 0).any(axis=1)) + 1
        for a, b in zip([0, *cuts], cuts):
            yield rest[a:b]
        if len(cuts):
            names, rest = names[cuts[-1] :], rest[cuts[-1] :]
    if len(rest):
        yield rest


def _noted(nodes: np.ndarray, found):
    """Links between rows as pairs of nodes (u < v)."""
    for x, y in found:
        a, b = nodes[x], nodes[y]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["u", "v"])


def _labels(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """``nodes`` with the least node of their component."""
    found = components(edges).select(F.col("u").alias("node"), F.col("v").alias("__root"))
    return nodes.join(found, "node", "left").withColumn(name, F.coalesce("__root", "node")).drop("__root")


def _meetings(rows: DataFrame, of: str, block: int, least: int = 0) -> DataFrame:
    """``rows`` (with ``of``, ``node`` and a class ``c``) spread over pairs of blocks ``i`` <= ``j`` in which each two rows of an ``of`` meet.

    The greatest class of an ``of``, if it has more than ``least`` rows, needs no
    pairs of its own: only the blocks of the ``lesser`` ones meet, each other and
    those of the greatest, so work follows the lesser classes' share.  ``b`` is a
    row's own block; ``j`` always is one of lesser rows.
    """
    sizes = rows.groupBy(of, "c").agg(F.count(F.lit(1)).alias("k")).groupBy(of).agg(F.sum("k").alias("n"), F.max(F.struct("k", "c")).alias("most"))
    sizes = sizes.select(of, "n", F.when(F.col("most.k") > least, F.col("most.k")).otherwise(0).alias("k"), F.when(F.col("most.k") > least, F.col("most.c")).alias("great"))
    in_blocks = lambda n: F.ceil(n / F.lit(block))
    sizes = sizes.filter("n > k").select(of, "great", in_blocks(F.col("k")).alias("first"), in_blocks(F.col("n") - F.col("k")).alias("more"))
    key = F.xxhash64("node")
    spread = rows.join(sizes, of).withColumn("lesser", ~F.col("c").eqNullSafe(F.col("great")))
    spread = spread.withColumn("b", F.when(F.col("lesser"), F.col("first") + F.pmod(key, F.col("more"))).otherwise(F.pmod(key, F.col("first"))))
    spread = spread.withColumn("o", F.explode(F.sequence(F.when(F.col("lesser"), F.lit(0).cast("long")).otherwise(F.col("first")), F.col("first") + F.col("more") - 1)))
    return spread.select(*rows.columns, "lesser", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))


def candidates(nodes: DataFrame, plan: Recursion, most: int) -> DataFrame:
    """Distinct pairs of nodes (u < v) whose fingerprints are near, from the lists of one run of the recursion."""

    def memberships(batches):
        cache: dict = {}
        for batch in batches:
            if batch.num_rows:
                cols = [np.asarray(batch.column(c)) for c in ("node", *PRINT)]
                yield cols, *plan.lists(np.stack(cols[1:], axis=1).view(np.uint64), cache)

    def count(batches):
        for _, name, _ in memberships(batches):
            lists, sizes = np.unique(name, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(lists), pa.array(sizes)], ["list", "n"])

    def spread(batches):
        for cols, name, rows in memberships(batches):
            yield pa.RecordBatch.from_arrays([pa.array(name), *(pa.array(c[rows]) for c in cols)], ["list", "node", *PRINT])

    def search(batches):
        for rows in _runs(batches, ("list", "block"), ("node", *PRINT)):
            yield from _noted(rows[:, 0], links(rows[:, 1:].copy().view(np.uint64), most))

    def meet(batches):
        for rows in _runs(batches, ("list", "i", "j"), ("side", "node", *PRINT)):
            rows = rows[np.argsort(rows[:, 0], kind="stable")]
            head = int((rows[:, 0] == 0).sum())
            if head:
                alone = head == len(rows)
                yield from _noted(rows[:, 1], links(rows[:, 2:].copy().view(np.uint64), most, head=0 if alone else head, joined=rows[-1, 0] == 2))

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = nodes.select("node", *PRINT).repartition(parts, "node")
    lists = nodes.mapInArrow(spread, "list long, node long, " + ", ".join(f"{c} long" for c in PRINT))
    sizes = nodes.mapInArrow(count, "list long, n long").groupBy("list").agg(F.sum("n").alias("n"))
    hot = checkpointed(sizes.filter(F.col("n") > HOT_LIST).select("list", F.ceil(F.col("n") / BLOCK).alias("blocks")))
    if hot.isEmpty():
        lists = lists.withColumn("block", F.lit(0).cast("long"))
    else:
        # A list far above its expected size holds a clump, say a group of copies. It is cut into
        # blocks, in each list by other hashes, so that the lists together link what a block parts.
        lists = lists.join(hot, "list", "left").select("list", "node", *PRINT, "blocks", F.coalesce(F.pmod(F.xxhash64("node", "list"), F.col("blocks")), F.lit(0)).alias("block"))
    ordered = lists.repartition(parts, "list", "block").sortWithinPartitions("list", "block", "node")
    found = ordered.select("list", "block", "node", *PRINT).mapInArrow(search, "u long, v long").distinct()
    if hot.isEmpty():
        return found
    # Then the blocks of such a list meet, but for rows of its greatest component, which hang together
    # already: whatever is near in a list is joined in the end, and small groups are complete.
    found = checkpointed(found)
    rows = checkpointed(lists.filter(F.col("blocks").isNotNull()).select("list", "node", *PRINT))
    of_rows = rows.select("node").distinct()
    among = found.join(of_rows.withColumnRenamed("node", "u"), "u", "left_semi").join(of_rows.withColumnRenamed("node", "v"), "v", "left_semi")
    met = _meetings(checkpointed(_labels(rows, among, "c")), "list", BLOCK, NEIGHBOURS + 1)
    side = F.when(F.col("b") == F.col("j"), 0).when(F.col("lesser"), 1).otherwise(2).cast("long")
    met = met.select("list", "i", "j", side.alias("side"), "node", *PRINT)
    ordered = met.repartition(parts, "list", "i", "j").sortWithinPartitions("list", "i", "j")
    return found.unionAll(ordered.mapInArrow(meet, "u long, v long")).distinct()


def _candidates_of_runs(nodes: DataFrame, plan: Recursion, most: int) -> DataFrame:
    """The candidates of all runs of a plan; each run is written before the next begins, which lets go of its lists."""
    runs: list[DataFrame] = []
    for run in plan.runs():
        if runs:
            nodes.sparkSession._jvm.System.gc()  # Spark removes shuffle files once their plan is collected
        runs.append(checkpointed(candidates(nodes, run, most)))
    return runs[0] if len(runs) == 1 else checkpointed(reduce(DataFrame.unionAll, runs).distinct())


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """The sorted shingle hashes (32 bits each) of the nodes wanted, read from one text of each."""

    def run(batches):
        s = Shingles(words)
        for batch in batches:
            for part in slices(batch, text_col, 1 << 20):
                h, n = s.of(["" if t is None else t for t in part.column(text_col).to_pylist()])
                node = node_digests(h, n)
                short = (h >> np.uint64(32)).astype(np.uint32)
                ends = np.cumsum(n)
                sets = [np.sort(short[e - k : e]).tobytes() for e, k in zip(ends.tolist(), n.tolist())]
                same = np.flatnonzero(node == np.asarray(part.column("node")))  # another text may share the id
                yield pa.RecordBatch.from_arrays([pa.array(node[same]), pa.array([sets[i] for i in same], pa.binary())], ["node", "members"])

    texts = docs.select(F.col(id_col).alias("__id"), text_col).join(wanted.hint("shuffle_hash"), F.col("__id").eqNullSafe(F.col("__first")))
    return texts.select(text_col, "node").mapInArrow(run, "node long, members binary").dropDuplicates(["node"])


def checked(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose sets have a Jaccard coefficient of ``similarity`` or more."""

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            part = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([part.column("u"), part.column("v")], ["u", "v"])

    with_a = pairs.join(sets.select(F.col("node").alias("u"), F.col("members").alias("a")), "u")
    with_both = with_a.join(sets.select(F.col("node").alias("v"), F.col("members").alias("b")), "v")
    return with_both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


#: Members of a group that is settled in one block; rounds in which hubs are tried before.
SETTLE_BLOCK, HUB_ROUNDS = 2048, 2


def _block_links(rows: list[tuple[int, int, bytes]], similarity: float) -> list[tuple[int, int]]:
    """Links (one for each merger) among (node, class, members), by exact overlaps from postings."""
    sets = [np.frombuffer(m, np.uint32) for _, _, m in rows]
    sizes = np.array([len(x) for x in sets])
    joined = np.concatenate(sets)
    owner = np.repeat(np.arange(len(rows)), sizes)
    order = np.argsort(joined, kind="stable")
    joined, owner = joined[order], owner[order]
    up: dict[int, int] = {}

    def find(c: int) -> int:
        while up.get(c, c) != c:
            c = up[c]
        return c

    out = []
    common = Counter(c for _, c, _ in rows).most_common(1)[0][0]  # of two rows of different classes one is of another
    for i, x in enumerate(sets):
        if rows[i][1] == common:
            continue
        low, high = np.searchsorted(joined, x, "left"), np.searchsorted(joined, x, "right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(rows))
        near = np.flatnonzero(both >= similarity * (sizes + len(x) - both) - 1e-9)
        for j in near.tolist():
            a, b = find(rows[i][1]), find(rows[j][1])
            if a != b:
                up[max(a, b)] = min(a, b)
                out.append((min(rows[i][0], rows[j][0]), max(rows[i][0], rows[j][0])))
    return out


def _settle_blocks(open_: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between the classes of each group ``g``: every two rows of different classes meet in one task."""

    def run(batches):
        held: list[tuple[int, int, bytes]] = []
        key = None

        def solved():
            links_ = _block_links(held, similarity)
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in links_], pa.int64()), pa.array([v for _, v in links_], pa.int64())], ["u", "v"])

        for batch in batches:
            for g, i, j, *row in zip(*(batch.column(c).to_pylist() for c in ("g", "i", "j", "node", "c", "members"))):
                if (g, i, j) != key and held:
                    yield solved()
                    held = []
                key = g, i, j
                held.append(tuple(row))
        if held:
            yield solved()

    spread = _meetings(open_, "g", SETTLE_BLOCK).select("g", "i", "j", "node", "c").join(sets, "node")
    parts = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = spread.select("g", "i", "j", "node", "c", "members").repartition(parts, "g", "i", "j").sortWithinPartitions("g", "i", "j")
    return ordered.mapInArrow(run, "u long, v long")


def settled(pairs: DataFrame, passed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``passed``, and the links that the noted candidates of large groups may have missed.

    Fingerprints are noisy, so in a large group the nearest ones need not be
    the ones whose texts are similar.  A group is a component of the candidates
    of more than ``NEIGHBOURS`` + 1 nodes; it is open while its verified links
    leave it in several classes.  In an open group each class is first checked
    against the node with most links (the text that the others are copies of,
    as a rule); what stays open is checked completely, the lesser classes
    against everything, and adds only one link for each merger of classes.
    """
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    groups = checkpointed(_labels(nodes, pairs, "g"))
    sizes = groups.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > NEIGHBOURS + 1)
    if sizes.isEmpty():
        return passed
    large = checkpointed(groups.join(sizes, "g"))

    def opened(edges: DataFrame) -> DataFrame:
        labelled = _labels(large, edges, "c")
        still = labelled.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("g")
        return checkpointed(labelled.join(still, "g"))

    for _ in range(HUB_ROUNDS):
        open_ = opened(passed)
        if open_.isEmpty():
            return passed
        degrees = passed.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
        hubs = open_.join(degrees, "node").groupBy("g").agg(F.max(F.struct("links", "node", "c")).alias("hub"))
        tried = open_.join(hubs, "g").filter(F.col("c") != F.col("hub.c")).select(F.least("node", "hub.node").alias("u"), F.greatest("node", "hub.node").alias("v"))
        passed = checkpointed(passed.unionAll(checked(tried, sets, similarity)).distinct())
    open_ = opened(passed)
    return passed if open_.isEmpty() else passed.unionAll(_settle_blocks(open_, sets, similarity))


def _classes(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """The fingerprinted rows, and for each node the first row (id, text hash) of its class."""
    prints = checkpointed(fingerprints(docs, id_col, text_col, words))
    row = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("__text").alias("text"))
    nodes = checkpointed(prints.groupBy("node").agg(F.min(row).alias("row"), *(F.first(c).alias(c) for c in PRINT)))
    design, most = distances(similarity)
    plan = Recursion.plan(nodes.count(), design, recall)
    pairs = _candidates_of_runs(nodes, plan, most)
    involved = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    wanted = nodes.join(involved, "node").select("node", F.col("row.id").alias("__first"))
    sets = checkpointed(_sets(docs, wanted, id_col, text_col, words))
    classes = components(settled(pairs, checkpointed(checked(pairs, sets, similarity)), sets, similarity))
    named = nodes.join(classes.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", "row", F.coalesce("root", "node").alias("root"))
    first = named.groupBy("root").agg(F.min("row").alias("first"))
    return prints, named.join(first, "root").select("node", "first")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``id_col``, ``class_id`` (the least id of its class, null if all are) and ``node`` of each row."""
    prints, first = _classes(docs, id_col, text_col, words, similarity, recall)
    return prints.select(id_col, "node").join(first, "node").select(id_col, F.col("first.id").alias("class_id"), "node")


def one_of_each(docs: DataFrame, columns: list[str], id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``columns`` of one row of each class: the one of least id (nulls last), then of least text hash."""
    prints, first = _classes(docs, id_col, text_col, words, similarity, recall)
    kept = first.select(F.col("first.id").alias("__id"), F.col("first.text").alias("__key")).distinct()
    keyed = docs.select(*dict.fromkeys([*columns, id_col, text_col])).withColumn("__text", F.xxhash64(text_col))
    out = keyed.join(kept.hint("shuffle_hash"), keyed[id_col].eqNullSafe(kept["__id"]) & (keyed["__text"] == kept["__key"]), "left_semi")
    if not prints.groupBy(id_col, "__text").count().filter("count > 1").isEmpty():  # rows repeat
        out = out.dropDuplicates([id_col, "__text"])
    return out.select(*columns)

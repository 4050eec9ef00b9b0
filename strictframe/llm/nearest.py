"""Near neighbours of binary fingerprints by the recursion of May and Ozerov.

A list of fingerprints is filtered by partial weights: a random set of
coordinates of one strip is drawn, and those whose weight there (after a random
shift) is at most ``WEIGHT`` go to a smaller list; each list is filtered again
on the next strip.  Two near fingerprints pass the same filter far more often
than two random ones do.  When lists are small they are searched by brute
force.  The number of filters follows from the recall wanted for a pair at the
design distance, the number of levels and the size of the sets from the number
of fingerprints.  A pair goes down the recursion as a branching process: it must
not die out on any level, so the first level has many filters and those below
it few, which costs far fewer lists than as many on each.

Fingerprints are rows of unsigned 64-bit words, each word cut into two strips of
32 bits.  The filters look at a few coordinates; whether two fingerprints of a
list are near is decided by all bits.

A plan may stretch over several runs with filters of their own: each run finds
a pair with a lower chance, and all of them together with the one asked for, so
what one run writes stays small however large the corpus is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np

STRIP_BITS, WEIGHT = 32, 1
#: Levels of a plan at most, each of which has a strip of its own; enough for 10^13 fingerprints.
LEVELS = 4
#: Lists of about this size are searched by brute force.
SMALL = 1500
#: Elements of a tile of rows by filters, and filters kept for further batches.
TILE, KEPT_FILTERS = 1 << 20, 8 << 20
#: Fingerprints in a block of a list too large for one task, and neighbours noted for each beyond the forest.
BLOCK, NEIGHBOURS = 4096, 16
#: Near rows of a row, on average, beyond which a tile is thinned.
DENSE = 64
#: Lists to which a fingerprint goes in one run, beyond which a plan is cut into more runs.
RUN_LISTS = 48
#: Cost of a list's member in filters tried: it is shuffled and compared with its list.
MEMBER_COST = 1000


def pass_probability(a: int) -> float:
    """Chance that a random fingerprint passes a filter of a coordinates."""
    return sum(math.comb(a, w) for w in range(WEIGHT + 1)) / 2**a


def joint_probability(a: int, distance: float) -> float:
    """Chance that a fingerprint at a relative distance of one that passes, passes too."""
    total = 0.0
    for w in range(WEIGHT + 1):
        for off in range(w + 1):  # ones that become zeros
            for on in range(WEIGHT - (w - off) + 1):  # zeros that become ones
                if on <= a - w:
                    total += math.comb(a, w) * math.comb(w, off) * math.comb(a - w, on) * distance ** (off + on) * (1 - distance) ** (a - off - on)
    return total / 2**a / pass_probability(a)


@dataclass(frozen=True)
class Recursion:
    """Levels, coordinates in a filter, and filters at the root and at each node below it (0: as many)."""

    levels: int
    size: int
    branches: int
    seed: int = 1
    below: int = 0

    @classmethod
    def plan(cls, n: int, distance: float, recall: float, small: int = SMALL, seed: int = 1) -> Recursion:
        """Lists of about ``small`` out of n, and enough of them for the recall at the distance."""
        levels = 1
        while n * pass_probability(12) ** levels > small:
            levels += 1
        if levels > LEVELS:
            raise ValueError("more fingerprints than four levels can tell apart")
        size = next((a for a in range(4, 13) if n * pass_probability(a) ** levels <= small), 12)
        one = pass_probability(size)
        both = one * joint_probability(size, distance)

        def filters(survival: float) -> int:
            """Filters of which one passes the pair, and keeps it with this chance, as often as the recall asks."""
            return math.ceil(math.log(1 / (1 - recall)) / (both * survival))

        if levels == 1:
            return cls(levels, size, filters(1.0), seed)
        best = None
        for mean in np.arange(0.05, 4, 0.05).tolist():  # filters of a node below the root that pass the pair
            below = math.ceil(mean / both)
            branches = filters(cls.survival(both, [below] * (levels - 1)))
            reached = [branches * one * (below * one) ** k for k in range(levels)]  # nodes or lists a fingerprint gets to
            cost = branches + below * sum(reached[:-1]) + MEMBER_COST * reached[-1]
            if best is None or cost < best[0]:
                best = cost, branches, below
        return cls(levels, size, best[1], seed, best[2])

    @staticmethod
    def survival(both: float, widths: list[int]) -> float:
        """Chance that a pair meets in some list below nodes of ``widths`` filters, each passing it with chance ``both``."""
        dies = 0.0
        for n in reversed(widths):
            dies = (1 - both * (1 - dies)) ** n
        return 1 - dies

    def widths(self) -> list[int]:
        """Filters at a node of each level."""
        return [self.branches] + [self.below or self.branches] * (self.levels - 1)

    def runs(self) -> list[Recursion]:
        """The plan as runs of filters of their own, whose filters at the root add up to the plan's."""
        one = pass_probability(self.size)
        reached = self.branches * one * math.prod(w * one for w in self.widths()[1:])
        n = max(1, math.ceil(reached / RUN_LISTS))
        below = self.below or self.branches
        return [replace(self, branches=math.ceil(self.branches / n), below=below, seed=self.seed * 1000 + k) for k in range(n)] if n > 1 else [self]

    def recall(self, distance: float) -> float:
        """Chance that a pair at a relative distance meets in some list."""
        return self.survival(pass_probability(self.size) * joint_probability(self.size, distance), self.widths())

    def _filters(self, path: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The coordinates and the shifts of a node's filters."""
        rng, width = np.random.default_rng([self.seed, level, path]), self.widths()[level]
        picks = np.argsort(rng.random((width, STRIP_BITS)), axis=1)[:, : self.size]
        masks = (np.uint32(1) << picks.astype(np.uint32)).sum(axis=1, dtype=np.uint32)
        return masks, rng.integers(0, 1 << 32, width, dtype=np.uint32)

    def lists(self, prints: np.ndarray, cache: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For the leaves of the recursion over fingerprints (rows of words): list and row, one pair for each membership.

        ``cache`` keeps filters between calls, up to ``KEPT_FILTERS`` numbers.
        """
        strips = 2 * prints.shape[1]
        words = np.ascontiguousarray(prints).view(np.uint32).reshape(len(prints), strips)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        self._descend(words, np.arange(len(prints)), 0, 0, np.arange(self.branches) % strips, {} if cache is None else cache, found)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(map(np.concatenate, zip(*found)))

    def _descend(self, words: np.ndarray, rows: np.ndarray, path: int, level: int, strips: np.ndarray, cache: dict, found: list) -> None:
        """Filter rows by all filters of a node at once, a tile of rows at a time; then go into each smaller list.

        Filters of the first level go round the strips; each level below takes
        the strip after its parent's.
        """
        width = len(strips)
        if path not in cache.setdefault(level, {}):
            if len(cache[level]) * width > KEPT_FILTERS:
                cache[level].clear()
            cache[level][path] = self._filters(path, level)
        masks, shifts = cache[level][path]
        tile = max(1, TILE // width)
        hits = []
        for i in range(0, len(rows), tile):
            y = (words[rows[i : i + tile]][:, strips] ^ shifts) & masks
            r, b = np.nonzero((y & (y - np.uint32(1))) == 0)
            hits.append((b, rows[r + i]))
        branch, inside = map(np.concatenate, zip(*hits))
        if level == self.levels - 1:
            found.append((path * width + branch, inside))
            return
        order = np.argsort(branch, kind="stable")
        branch, inside = branch[order], inside[order]
        cuts = np.flatnonzero(np.diff(branch)) + 1
        for a, z in zip([0, *cuts], [*cuts, len(branch)]):
            if z > a:
                b = int(branch[a])
                below = np.full(self.widths()[level + 1], (strips[b] + 1) % words.shape[1])
                self._descend(words, inside[a:z], path * width + b, level + 1, below, cache, found)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
    for k in range(1, a.shape[1]):
        out += np.bitwise_count(a[:, None, k] ^ b[None, :, k])
    return out


def _near_pairs(prints: np.ndarray, most: int, neighbours: int, head: int = 0, joined: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (lower row, higher row, distance) within ``most``, found tile by tile.

    A tile in which rows have more than ``DENSE`` near ones on average is thinned
    to each row's nearest ones and one near row of every group known so far, so
    memory doesn't follow the pairs of a clump.  What a thinned row is near to is
    one group from then on: thinning never changes which rows hang together.

    With a ``head`` the first ``head`` rows are compared with the others, and
    neither part within itself; ``joined`` others are one group from the start.
    """
    n = len(prints)
    low, high, far = [], [], []
    group = np.arange(n)
    if joined:
        group[head:] = head
    rows = max(16, min(256, (1 << 20) // max(n, 1)))
    for i in range(0, head or n, rows):
        # Rows before the tile were compared with it in their own tiles; what thinning left out there is in a large group.
        tile, at = prints[i : min(i + rows, head or n)], head or i
        d = _distances(tile, prints[at:])
        near = d <= most
        own = np.arange(len(d))
        if not head:
            near[own, own] = False
        if near.sum() <= DENSE * len(d):
            x, y = np.nonzero(near)
            far.append(d[x, y])
            y += at
        else:
            if not head:
                d = _distances(tile, prints)
                near = d <= most
                near[own, own + i] = False
            k = min(neighbours, d.shape[1] - 1)
            y = np.argpartition(np.where(near, d, 255), k, axis=1)[:, : k + 1].ravel()
            x = np.repeat(own, k + 1)
            keep = near[x, y]
            xs, ys = [x[keep]], [y[keep]]
            for r in np.flatnonzero(near.any(axis=1)).tolist():
                near_to = np.flatnonzero(near[r])
                groups, first = np.unique(group[head + near_to], return_index=True)
                other = groups != group[i + r]
                if other.any():
                    ys.append(near_to[first[other]])
                    xs.append(np.full(len(ys[-1]), r))
                    merged = np.append(groups[other], group[i + r])
                    group[np.isin(group, merged)] = merged.min()
            x, y = np.concatenate(xs), np.concatenate(ys)
            far.append(d[x, y])
            y += head
        low.append(np.minimum(x + i, y))
        high.append(np.maximum(x + i, y))
    lo, hi, d = map(np.concatenate, (low, high, far))
    _, first = np.unique(lo * n + hi, return_index=True)
    return lo[first], hi[first], d[first]


class _Sets:
    """Union-find over small integers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def union(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def links(prints: np.ndarray, most: int, neighbours: int = NEIGHBOURS, head: int = 0, joined: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within a list: a minimum spanning forest of its near pairs, and each row's nearest ones.

    Groups of up to ``neighbours`` + 1 rows are linked completely, and rows that
    hang together by near pairs hang together by links; the whole list is
    compared, tile by tile.  With a ``head`` these are the near pairs of one of
    the first ``head`` rows and one of the others, which may be ``joined``.
    """
    if len(prints) < 2:
        return
    x, y, d = _near_pairs(prints, most, neighbours, head, joined)
    order = np.argsort(d, kind="stable")
    x, y = x[order], y[order]
    sets = _Sets(len(prints))
    if joined:
        sets.up[head:] = [head] * (len(prints) - head)
    degree = [0] * len(prints)
    take = []
    for k, (i, j) in enumerate(zip(x.tolist(), y.tolist())):
        if sets.union(i, j) or degree[i] < neighbours or degree[j] < neighbours:
            degree[i] += 1
            degree[j] += 1
            take.append(k)
    if take:
        yield x[take], y[take]

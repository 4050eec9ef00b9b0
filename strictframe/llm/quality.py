"""Quality rules: base counts and suffix-array repetition within each text.

The words of a slice of texts are laid out one text after another; a word's
first rank includes its text, so that no comparison crosses texts.  Rank
doubling (only groups not yet resolved are sorted again) gives the suffix
array; longest common prefixes of neighbours are found in text order, where only
those that don't follow from the one before are compared.  An interval of common prefixes of ``min_span`` words or more is a
maximal repeat; the union of all such spans and the longest repeat are limited.

Defined cases: a null text has no words; a text without words fails the base
rule; repeated rows and null ids are judged row by row; an empty table gives an
empty result; other columns are not read.  Ties don't arise: every count is of a
row alone.  Memory is bounded by the slice, or by one text if that is longer: a
very long one takes about ten times its bytes (25 times, where words have three),
and its words and lines are compared by digests of 64 and 128 bits.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bool_field, long_field, map_texts, texts_of

_WS = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"

#: Production parameters.  A repeat counts from 10 words; repeats may cover 30 %
#: of the words, and the longest may hold 10 % of them if it has over 100 words.
#: Covered words also lie in repeated 3-word windows, so a limit on them decides
#: only below ``BASE_PERCENT``; two copies cover twice the longest repeat, so its
#: limit decides only below half of the covered one.
MIN_WORDS, BASE_PERCENT = 50, 50
MIN_SPAN, MAX_COVERED, MAX_LONGEST, LONG_WORDS = 10, 0.3, 0.1, 100


def suffix_array(words: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of integer words grouped by text, and LCP of each suffix with its predecessor.

    ``texts`` holds the (nondecreasing) number of the text of each word.
    Suffixes end with their text.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    key = (texts.astype(np.int64) << 32) | words.astype(np.int64)
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(key[1:], key[:-1], out=new[1:])
    del key
    starts = np.flatnonzero(new).astype(np.int32)
    sizes = np.diff(np.append(starts, np.int32(n)))
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(starts, sizes)
    ends = np.append(np.flatnonzero(np.diff(texts)) + 1, n).astype(np.int32)
    end_of = np.repeat(ends, np.diff(np.append(0, ends)))
    active = order[np.repeat(sizes > 1, sizes)]  # in rank order
    del order, new, starts, sizes
    h = 1
    while len(active):
        # Only the ranks of the words h on are needed; they are read before any rank changes.
        after = active + np.int32(h)
        second = np.where(after < end_of[active], rank[np.minimum(after, n - 1)], np.int32(-1))
        first = rank[active]
        both = (first.astype(np.int64) << 32) + second
        del after, second
        o = np.argsort(both)
        active, first, both = active[o], first[o], both[o]
        del o
        m = len(active)
        sub = np.empty(m, bool)
        sub[0] = True
        np.not_equal(both[1:], both[:-1], out=sub[1:])
        del both
        top = np.empty(m, bool)
        top[0] = True
        np.not_equal(first[1:], first[:-1], out=top[1:])
        at = np.arange(m, dtype=np.int32)
        sub_start = np.maximum.accumulate(np.where(sub, at, 0))
        rank[active] = first + (sub_start - np.maximum.accumulate(np.where(top, at, 0)))
        h *= 2
        size = np.diff(np.append(np.flatnonzero(sub), m))
        active = active[np.repeat(size > 1, size)]
    sa = np.empty(n, np.int32)
    sa[rank] = np.arange(n, dtype=np.int32)
    return sa, _common_prefixes(words, sa, rank, end_of)


#: Words of a common prefix that are compared for all suffixes at once, before each is followed alone.
TOGETHER = 16


def _common_prefixes(words: np.ndarray, sa: np.ndarray, rank: np.ndarray, end_of: np.ndarray) -> np.ndarray:
    """LCP of each suffix with its predecessor, by way of the permuted array in text order.

    Where a suffix and its predecessor follow equal words, their common prefix
    is one word shorter than that of the suffix before.  Only the others are
    compared word by word; the sum of those prefixes is O(n log n).
    """
    n = len(words)
    before = np.full(n, -1, np.int32)  # the suffix before each in the array
    before[sa[1:]] = sa[:-1]
    near = (before >= 0) & (end_of[before] == end_of)  # in one text, as ends tell
    j = np.maximum(before[1:], 1)
    led = near[1:] & (before[1:] > 0) & (end_of[:-1] == end_of[1:]) & (end_of[j - 1] == end_of[j]) & (words[:-1] == words[j - 1])
    fresh = np.append(True, ~led)
    del led
    i = np.flatnonzero(fresh & near).astype(np.int32)
    plcp = np.zeros(n, np.int32)
    j = before[i]
    for k in range(TOGETHER):
        more = (i + k < end_of[i]) & (j + k < end_of[j])
        same = more & (words[np.minimum(i + k, n - 1)] == words[np.minimum(j + k, n - 1)])
        i, j = i[same], j[same]
        plcp[i] += 1
        if not len(i):
            break
    for a, b in zip(i.tolist(), j.tolist()):
        got, step = TOGETHER, TOGETHER
        most = min(int(end_of[a]) - a, int(end_of[b]) - b)
        while got < most:
            size = min(step, most - got)
            differ = np.flatnonzero(words[a + got : a + got + size] != words[b + got : b + got + size])
            if len(differ):
                got += int(differ[0])
                break
            got, step = got + size, min(2 * step, 1 << 16)
        plcp[a] = got
    # Behind a compared position the prefix shrinks by one word at each step.
    start = np.maximum.accumulate(np.where(fresh, np.arange(n, dtype=np.int32), 0))
    plcp = np.maximum(plcp[start] - (np.arange(n, dtype=np.int32) - start), 0)
    plcp[~near] = 0
    return plcp[sa]


def _cover(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in a span."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + lengths, -1)
    return np.cumsum(d[:n], dtype=np.int32) > 0


def repetition(words: np.ndarray, texts: np.ndarray, n_texts: int, min_span: int = MIN_SPAN) -> dict[str, np.ndarray]:
    """By text: words in repeated 3-word windows, words covered by maximal repeats, longest repeat."""
    n = len(words)
    sa, lcp = suffix_array(words, texts)
    longest_here = np.zeros(n, np.int32)
    if n:
        longest_here[sa] = np.maximum(lcp, np.append(lcp[1:], np.int32(0)))
    out = {}
    three = np.flatnonzero(longest_here >= 3)
    out["n_repeat_words"] = np.bincount(texts[_cover(three, np.full(len(three), 3, np.int32), n)], minlength=n_texts)
    long = np.flatnonzero(longest_here >= min_span)
    out["covered_words"] = np.bincount(texts[_cover(long, longest_here[long], n)], minlength=n_texts)
    longest = np.zeros(n_texts, np.int64)
    np.maximum.at(longest, texts[long], longest_here[long])
    out["longest_repeat"] = longest
    return out


#: Bytes of a text beyond which its words and lines are counted piece by piece and by digests.
LONG_TEXT = 4 << 20


def _pieces(b: bytes, ends: bytes) -> Iterator[bytes]:
    """A text in pieces of about a megabyte, each cut behind one of the bytes ``ends``."""
    at, find = 0, re.compile(b"[" + ends + b"]").search
    while at < len(b):
        m = find(b, at + (1 << 20))
        end = m.end() if m else len(b)
        yield b[at:end]
        at = end


def _long_words(b: bytes) -> np.ndarray:
    """Numbers of the words of a very long text; equal words by equal 64-bit digests."""
    digests = [np.fromiter(map(xxhash.xxh3_64_intdigest, p.split()), np.uint64) for p in _pieces(b, _WS)]
    return np.unique(np.concatenate(digests), return_inverse=True)[1].astype(np.int32)


def _long_dup_lines(b: bytes) -> int:
    """Lines with a word that are equal to an earlier one, by 128-bit digests."""
    rows = []
    for p in _pieces(b, b"\n"):
        rows.append(np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in p.split(b"\n") if x.strip()), "<u8").reshape(-1, 2))
    d = np.concatenate(rows)
    order = np.lexsort((d[:, 1], d[:, 0]))
    return int((d[order[1:]] == d[order[:-1]]).all(1).sum()) if len(d) else 0


def judge(texts: list[str], min_span: int = MIN_SPAN, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST, long_words: int = LONG_WORDS) -> dict[str, object]:
    """All rule columns for a list of texts."""
    ids: defaultdict[bytes, int] = defaultdict(count().__next__)
    numbers: list[np.ndarray] = []
    n_words, chars, symbols, dup = [], [], [], []
    for text in texts:
        b = text.encode("utf-8", "surrogatepass")
        if len(b) > LONG_TEXT:
            numbers.append(_long_words(b))
            dup.append(_long_dup_lines(b))
        else:
            words = b.split()
            numbers.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
            lines = [x for x in b.split(b"\n") if x.strip()]
            dup.append(len(lines) - len(set(lines)))
        n_words.append(len(numbers[-1]))
        chars.append(len(text) - (len(b) - len(b.translate(None, _WS))))
        symbols.append(len(b) - len(b.translate(None, _SYMBOLS)))
    counts = np.array(n_words, np.int64)
    of = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
    r = repetition(np.concatenate([np.zeros(0, np.int32), *numbers]), of, len(texts), min_span)
    base = (counts < MIN_WORDS) | (100 * r["n_repeat_words"] > BASE_PERCENT * counts)
    covered = r["covered_words"] > max_covered * counts
    longest = (r["longest_repeat"] > long_words) & (r["longest_repeat"] > max_longest * counts)
    return {
        "n_words": counts,
        "word_chars": chars,
        "n_symbols": symbols,
        "n_dup_lines": dup,
        "n_repeat_words": r["n_repeat_words"],
        "base_failed": base,
        "kept": ~(base | covered | longest),
        "covered_words": r["covered_words"],
        "longest_repeat": r["longest_repeat"],
    }


FIELDS: list[T.StructField] = [
    *map(long_field, ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    *map(bool_field, ("base_failed", "kept")),
    *map(long_field, ("covered_words", "longest_repeat")),
]


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, **limits: float) -> DataFrame:
    """Judge each row's whole text; one map pass without a shuffle.

    Returns ``id_col`` (or the columns ``keep``), the counts, ``base_failed``
    and ``kept``.  ``limits`` are those of ``judge``.
    """
    keep = keep or [id_col]

    def make():
        return lambda batch: judge(texts_of(batch, text_col), **limits)

    return map_texts(docs, list(dict.fromkeys([*keep, text_col])), text_col, make, FIELDS, keep)

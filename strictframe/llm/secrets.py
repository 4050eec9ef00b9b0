"""Secret scans: pattern matches, and corpus-wide ownership of what they found.

One map pass finds the matches of each whole text.  Candidate hashes are then
counted by distinct repositories and owners over the whole corpus: a value held
by a single owner looks live; one held by many is a widely copied example.  A
document with a key may itself have copies, so a few owners don't make an
example.  All matches are reported: those of the further kinds that are widely
copied in a list of their own, all others, with the flag of looking live, in the
main one.

Defined cases: a null text is the empty text; a null repository counts as one
of its own; a very long text is scanned whole in one task, in time that grows
with its length; matches that start together (ties) are listed by kind; repeated
rows are reported row by row; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from heapq import merge

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, map_texts, slices, texts_of

BASE_KINDS = ("assign", "access", "hex")
#: Further kinds, in the order in which they are listed after the base kinds.
MORE_KINDS = ("pem", "jwt", "vendor", "opaque")
KINDS = BASE_KINDS + MORE_KINDS
#: Kinds whose form alone tells a credential; they are redacted however many hold them.
STRUCTURED_KINDS = ("pem", "jwt", "vendor")
#: A value looks live up to these, and is widely copied beyond those.  The second
#: bound acts where owners have several repositories each.
MAX_OWNERS, MAX_REPOSITORIES = 1, 3
WIDE_OWNERS, WIDE_REPOSITORIES = 4, 12
MIN_ENTROPY = 3.5

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----")
#: A token starts a run of its characters, so a long run is tried once.
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")
_VENDOR = re.compile(r"(?:ghp_|gho_|github_pat_|sk_live_|rk_live_|xox[abpr]-|glpat-|AIza)[A-Za-z0-9_-]{16,}")
_OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values())


def _opaque(value: str) -> bool:
    """Mixed letters and digits without structure, as random keys are."""
    digits = sum(map(str.isdigit, value))
    return 3 <= digits < len(value) - 3 and _entropy(value) >= MIN_ENTROPY


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind number, value) of the base matches, by start, then kind."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "apikey" in low or "api_key" in low:
        out += [(m.start(), m.end(), 0, m[1]) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), 2, m[0]) for m in _HEX.finditer(text)]
    out.sort()
    return out


def _joined(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with those that overlap made one."""
    out: list[tuple[int, int]] = []
    for start, end in spans:
        if out and start < out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def more_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Candidates of the further kinds that no earlier match overlaps; linear in the matches of a kind."""
    taken = _joined((s, e) for s, e, _, _ in base)
    out = []

    def add(kind: int, matches: Iterator[re.Match]) -> None:
        # Both sides are sorted and disjoint, so one pass over both finds the free matches.
        nonlocal taken
        free, i = [], 0
        for m in matches:
            start, end = m.span()
            while i < len(taken) and taken[i][1] <= start:
                i += 1
            if i == len(taken) or end <= taken[i][0]:
                free.append((start, end))
                out.append((start, end, kind, m[0]))
        taken = list(merge(taken, free))

    if "PRIVATE KEY-----" in text:
        add(3, _PEM.finditer(text))
    if "eyJ" in text:
        add(4, _JWT.finditer(text))
    add(5, _VENDOR.finditer(text))
    add(6, (m for m in _OPAQUE.finditer(text) if _opaque(m[0])))
    return out


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("hash", T.LongType())])


def candidates(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """Each row's candidate spans with a 63-bit hash of the value; values themselves are not passed on."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("hash", pa.int64())]))

    def make():
        def of(text: str) -> list[dict[str, int]]:
            base = base_spans(text)
            return [
                {"start": s, "end": e, "kind": k, "hash": int.from_bytes(hashlib.sha256(v.encode()).digest()[:8], "little") >> 1}
                for s, e, k, v in sorted(base + more_spans(text, base))
            ]

        return lambda batch: {"found": pa.array([of(t) for t in texts_of(batch, text_col)], kind)}

    return map_texts(docs, list(dict.fromkeys([*keep, text_col])), text_col, make, [T.StructField("found", T.ArrayType(_SPAN))], keep)


def ownership(found: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """``hash``, its ``rows``, distinct ``owners`` and ``repositories`` over the corpus.

    Distinct (hash, owner, repository) rows combine before the shuffle, so a
    value that a third of all rows hold moves once a task and repository.
    """
    each = found.select(F.explode("found.hash").alias("hash"), F.coalesce(owner, F.lit("")).alias("owner"), F.coalesce(repository, F.lit("")).alias("repository"))
    each = each.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("rows"))
    by_owner = each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows"))
    return by_owner.groupBy("hash").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))


#: Matches of one value from which its verdict is broadcast instead of joined by
#: a shuffle on the value; there are at most (all matches / HOT_ROWS) of them.
HOT_ROWS = 100_000


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repository_col: str = "source",
    max_owners: int = MAX_OWNERS,
    max_repositories: int = MAX_REPOSITORIES,
    keep: list[str] | None = None,
    wide_owners: int = WIDE_OWNERS,
    wide_repositories: int = WIDE_REPOSITORIES,
) -> DataFrame:
    """One row a document: ``id_col``, the columns ``keep``, ``found`` and ``copied``, arrays of (start, end, kind, base, live).

    ``copied`` has the widely copied matches of the further kinds, ``found`` all others.
    A repository's owner is the part of its name before the first slash.
    The candidates (no texts) are checkpointed: they are counted and read again.
    """
    carried = [id_col, *(keep or [])]
    found = checkpointed(candidates(docs, list(dict.fromkeys([*carried, repository_col])), text_col).withColumn("__row", F.monotonically_increasing_id()))
    repository = F.col(repository_col).cast("string")
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    wide = (F.col("owners") > wide_owners) | (F.col("repositories") > wide_repositories)
    some = found.filter(F.size("found") > 0)
    verdicts = checkpointed(ownership(some, repository, F.substring_index(repository, "/", 1)).select(F.col("hash").alias("__hash"), "rows", live.alias("live"), wide.alias("wide")))
    spans_ = some.select("__row", F.explode("found").alias("s"))
    hot = verdicts.filter(F.col("rows") > HOT_ROWS).drop("rows")
    rare = verdicts.drop("rows")
    if hot.isEmpty():
        ruled = spans_.join(rare, F.col("s.hash") == F.col("__hash"))
    else:
        both = spans_.join(F.broadcast(hot), F.col("s.hash") == F.col("__hash"), "left")
        ruled = both.filter(F.col("__hash").isNotNull()).unionByName(both.filter(F.col("__hash").isNull()).select("__row", "s").join(rare, F.col("s.hash") == F.col("__hash")))
    judged = (
        ruled.select("__row", "s", "live", (F.col("wide") & (F.col("s.kind") >= len(BASE_KINDS))).alias("copied"))
        .groupBy("__row")
        .agg(F.sort_array(F.collect_list(F.struct("s.start", "s.kind", "s.end", "live", "copied"))).alias("judged"))
    )
    kinds = F.array(*map(F.lit, KINDS))
    every = F.coalesce("judged", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,live:boolean,copied:boolean>>"))

    def spans(copied: bool) -> Column:
        return F.transform(
            F.filter(every, lambda s: s["copied"] == copied),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(kinds, s["kind"]).alias("kind"), (s["kind"] < len(BASE_KINDS)).alias("base"), s["live"].alias("live")),
        )

    return found.join(judged, "__row", "left").select(*carried, spans(False).alias("found"), spans(True).alias("copied"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digests(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, digest of the base spans, and the lists of the spans found and of the widely copied ones, from ``scan_secrets``."""
    base = F.filter("found", lambda s: s["base"])
    n = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return scan_secrets(docs, id_col).select(
        id_col,
        *(n(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: s["live"])).cast("long").alias("n_live"),
        _listed(F.col("copied")).alias("copied"),
    )


def redact(docs: DataFrame, columns: list[str], id_col: str = "doc_id", text_col: str = "text", repository_col: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """``columns`` of the documents with every span found, and every widely copied one of a structured kind, replaced by ``mark``.

    Spans are joined back by id and text hash, so repeated ids and rows and null ids keep their own texts.
    """
    keyed = docs.select(*dict.fromkeys([*columns, id_col, text_col, repository_col])).withColumn("__hash", F.xxhash64(F.col(text_col)))
    found = scan_secrets(keyed, id_col, text_col, repository_col, keep=["__hash"])
    structured = F.filter("copied", lambda s: s["kind"].isin(*STRUCTURED_KINDS))
    found = found.withColumn("found", F.sort_array(F.concat("found", structured))).filter(F.size("found") > 0)
    found = found.select(F.col(id_col).alias("__id"), F.col("__hash").alias("__key"), F.col("found").alias("__found")).dropDuplicates(["__id", "__key"])
    joined = keyed.join(found, keyed[id_col].eqNullSafe(found["__id"]) & (keyed["__hash"] == found["__key"]), "left").select(*(keyed[c] for c in dict.fromkeys([*columns, text_col])), "__found")
    kept = [c for c in columns if c != text_col]

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                texts = part.column(text_col).to_pylist()
                for i, spans in enumerate(part.column("__found").to_pylist()):
                    if spans:
                        texts[i] = without_spans(texts[i], ((s["start"], s["end"]) for s in spans), mark)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, text_col])

    out = joined.mapInArrow(run, T.StructType([*(joined.schema[c] for c in kept), joined.schema[text_col]]))
    return out.select(*columns)


def without_spans(text: str, spans: Iterable[tuple[int, int]], mark: str) -> str:
    """A text with sorted spans, joined where they overlap, replaced by ``mark``; one pass."""
    out, at = [], 0
    for start, end in _joined(spans):
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])

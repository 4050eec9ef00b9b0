"""Corpus operators against brute force: near-dedup, repeats, packing, and the pipeline."""

import dataclasses
import hashlib
import itertools
import math
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from strictframe.llm import nearest, neardup, packing, quality, repeats, secrets
from strictframe.llm import components as component_steps
from strictframe.llm.components import components
from strictframe.llm.nearest import BLOCK, Recursion, links
from strictframe.llm.queries import byte_tokens
from strictframe.llm.suffixes import repeated, suffix_array
from strictframe.llm.tokens import cut

from .conftest import prose


def shingles(text):
    w = text.lower().encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def classes(texts, similarity=0.8):
    """Class number of each text, by all pairs."""
    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(range(len(texts)), 2):
        x, y = sets[a], sets[b]
        if x == y or len(x & y) >= similarity * len(x | y):
            i, j = find(a), find(b)
            up[max(i, j)] = min(i, j)
    return [find(i) for i in range(len(texts))]


def test_near_classes(docs, none, pairs):
    of = classes([t for _, t in pairs])
    least = defaultdict(list)
    for (i, _), c in zip(pairs, of):
        least[c].append(i)
    want = Counter((i, min((x for x in least[c] if x is not None), default=None)) for (i, _), c in zip(pairs, of))
    got = neardup.near_classes(docs).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == want
    assert neardup.near_classes(none).count() == 0


def variants(seed, n, edits):
    base = prose(seed, 220).split(" ")
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        words = list(base)
        for at in rng.choice(len(words), edits, replace=False):
            words[at] = f"new{k}x{at}"
        out.append(" ".join(words))
    return out


def test_near_groups_of_all_sizes(spark):
    texts = [t for g in range(30) for t in variants(1000 + g, 2 + g % 5, 1 + g % 6)] + variants(5000, 150, 2) + [prose(9000 + i, 120) for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.class_id for r in neardup.near_classes(df).collect()} == dict(enumerate(classes(texts)))


def star(seed, copies, edits):
    """A text and copies that are near it, each in places of its own, but hardly near each other."""
    return [" ".join(prose(seed, 220).split(" ")), *variants(seed, copies, edits)]


def test_stars_are_linked(spark, monkeypatch):
    """Copies linked only through their original, in one block and in several; a group that stays apart."""
    texts = star(31, 60, 4) + star(32, 40, 5) + star(33, 40, 9)
    want = dict(enumerate(classes(texts)))
    assert len(set(want.values())) < len(texts) / 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for block, hubs in ((2048, 2), (16, 0)):
        monkeypatch.setattr(neardup, "SETTLE_BLOCK", block)
        monkeypatch.setattr(neardup, "HUB_ROUNDS", hubs)
        assert {r.doc_id: r.class_id for r in neardup.near_classes(df).collect()} == want


def test_clumps_are_cut_into_blocks(spark, monkeypatch):
    """A group that swells its lists is linked across blocks."""
    monkeypatch.setattr(neardup, "HOT_LIST", 60)
    monkeypatch.setattr(neardup, "BLOCK", 40)
    texts = variants(77, 260, 1) + [prose(7000 + i, 100) for i in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in neardup.near_classes(df).collect()} == {i: 0 if i < 260 else i for i in range(310)}


def test_recall_of_the_recursion():
    """Pairs at the design distance are found about as often as planned, on one level and on two."""
    rng = np.random.default_rng(5)
    design, most = neardup.distances()
    a = rng.integers(0, 1 << 63, (400, 2), dtype=np.uint64)
    flips = rng.random((400, 128)) < design
    b = a ^ np.packbits(flips, axis=1, bitorder="little").view(np.uint64)
    prints = np.concatenate([a, b])
    for plan in (Recursion.plan(50_000, design, 0.99), Recursion(2, 7, 220)):
        name, row = plan.lists(prints)
        seen = set(zip(name.tolist(), row.tolist()))
        together = np.zeros(400, bool)
        together[[r for n, r in seen if (n, r + 400) in seen]] = True
        assert together.mean() > 0.93


def test_recall_of_large_plans():
    """However many levels a corpus needs, a pair must not die out on any of them."""
    design, _ = neardup.distances()
    for n, levels in ((250_000, 1), (500_000, 2), (1_000_000, 2), (15_000_000, 2), (200_000_000, 3)):
        plan = Recursion.plan(n, design, 0.9999)
        assert plan.levels == levels and plan.recall(design) >= 0.9999
    plan = Recursion.plan(1_000_000, design, 0.9999)
    rng = np.random.default_rng(8)
    a = rng.integers(0, 1 << 63, (4000, 2), dtype=np.uint64)
    flips = rng.permuted(np.tile(np.arange(128) < round(design * 128), (4000, 1)), axis=1)
    b = a ^ np.packbits(flips, axis=1, bitorder="little").view(np.uint64)
    name, row = plan.lists(np.concatenate([a, b]))
    both = np.intersect1d(name[row < 4000] * 4000 + row[row < 4000], name[row >= 4000] * 4000 + row[row >= 4000] - 4000)
    assert len(set((both % 4000).tolist())) >= 0.998 * 4000


def test_links_join_a_long_list():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, (1, 2), dtype=np.uint64)
    near = np.repeat(base, BLOCK + 500, axis=0)
    near[np.arange(len(near)), 0] ^= np.uint64(1) << rng.integers(0, 64, len(near), dtype=np.uint64)
    up = list(range(len(near)))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    n = 0
    for x, y in links(near, 8):
        n += len(x)
        for i, j in zip(x.tolist(), y.tolist()):
            up[find(i)] = find(j)
    assert len({find(i) for i in range(len(near))}) == 1 and n <= 40 * len(near)


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(component_steps, "TASK_EDGES", most)
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (200, 200)] + [(500, 500 + i) for i in range(1, 40)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.u: r.v for r in components(df).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100, 103: 100} | {500 + i: 500 for i in range(1, 40)}
    assert components(df.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 30), st.integers(-9, 30)), max_size=40))
def test_components_in_a_task(edges):
    node, root = component_steps._least(*(np.array([e[k] for e in edges], np.int64) for k in (0, 1)))
    least = {n: n for e in edges for n in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert dict(zip(node.tolist(), root.tolist())) == least


def brute_repeats(texts, length):
    """Removed ranges of each text, over all windows."""
    data = [t.encode() for t in texts]
    seen = Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats(docs, none, pairs):
    want = Counter((i, *r) for (i, _), r in zip(pairs, brute_repeats([t for _, t in pairs], 200)))
    for hot in (repeats.HOT, 1):
        assert Counter(tuple(r) for r in repeats.repeat_digests(docs, hot=hot).collect()) == want
    assert repeats.repeat_digests(none).count() == 0


def test_repeats_of_short_strings(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abé "), rng.integers(0, 90))) for _ in range(120)] + ["abab" * 30, "aaaa" * 40, "aaaa" * 40, "日本" * 25]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {i: r for i, r in enumerate(brute_repeats(texts, 9))}
    for hot in (repeats.HOT, 0):
        got = {r.doc_id: tuple(r)[1:] for r in repeats.repeat_digests(df, length=9, gram=4, hot=hot).collect()}
        assert got == want


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abc", max_size=60), st.integers(1, 4))
def test_suffix_arrays_of_bytes(text, times):
    data = (text * times).encode()
    sa = suffix_array(np.frombuffer(data, np.uint8))
    assert sa.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    seen = Counter(data[i : i + 8] for i in range(len(data) - 7))
    assert repeated(np.frombuffer(data, np.uint8), sa, 8).tolist() == [i + 8 <= len(data) and seen[data[i : i + 8]] > 1 for i in range(len(data))]


def token_pieces(rows, capacity):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text in rows:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        for k, (s, n) in enumerate(cut(len(ids), capacity)):
            want[i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    return want


_TOKENS, _LIBRARY = byte_tokens(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(["a", " ", "<|endoftext|>", "<|end", "oftext|>", "ſ", "’s", "'S", "\n\n", "\u00a0", "ǅ", "9", "…", "Ⅷ"]), max_size=25).map("".join)))
def test_byte_ids_are_the_library_s(text):
    text = text.encode("utf-8", "ignore").decode()
    assert _TOKENS.encode(text).tolist() == _LIBRARY.encode(text, add_special_tokens=False).ids


def check_packing(rows, want, capacity):
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_packing(docs, none, pairs):
    for capacity in (64, 2048):
        rows = packing.pack(docs, byte_tokens, capacity=capacity).collect()
        want = token_pieces(pairs, capacity)
        n = check_packing(rows, want, capacity)
        bound = -(-sum(w[3] * k for w, k in want.items()) // capacity)
        assert n <= bound * 1.1 + 1
    assert packing.pack(none, byte_tokens).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
def test_plans_place_every_piece_once(histogram):
    program = packing.solve_packing(histogram, 30)
    plan = program.plan
    assert program.bound <= program.value + 1e-6 and program.rounded + program.residue == sum(k for _, k in plan)
    used = Counter()
    for pattern, k in plan:
        assert sum(length * copies for length, copies in pattern) <= 30 and k > 0
        for length, copies in pattern:
            used[length] += copies * k
    assert used == Counter(histogram)
    places = packing.Places.of(plan)
    seen = set()
    for length, n in histogram.items():
        s, o = places.find(np.full(n, length), np.arange(n))
        assert len({*zip(s.tolist(), o.tolist())} - seen) == n
        seen |= {*zip(s.tolist(), o.tolist())}


def test_program_alone_packs_to_its_bound():
    rng = np.random.default_rng(0)
    for n, seed_lengths in ((200_000, rng.geometric(0.004, 200_000)), (3_000, rng.geometric(0.002, 3_000)), (5_000, rng.integers(1, 1500, 5_000))):
        counts = Counter(np.minimum(seed_lengths, 2048).tolist())
        program = packing.solve_packing(counts)
        total = sum(k for _, k in program.plan)
        assert program.gap <= packing.GAP and total == program.rounded + program.residue
        assert -(-sum(length * k for length, k in counts.items()) // 2048) <= total <= math.ceil(program.bound - 1e-6) + 2
    # The dual shows what the sum of lengths does not: no two of these share a sequence.
    apart = packing.solve_packing({1100: 40, 1300: 7})
    assert apart.bound == pytest.approx(47) and sum(k for _, k in apart.plan) == 47


def test_plans_are_least_for_small_histograms():
    """Against an exact search over all packings of a few pieces."""

    def least(pieces, capacity):
        pieces = sorted(pieces, reverse=True)
        best = len(pieces)

        def place(i, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if i == len(pieces):
                best = len(rooms)
                return
            for r in {r for r in rooms if r >= pieces[i]}:
                k = rooms.index(r)
                place(i + 1, [*rooms[:k], r - pieces[i], *rooms[k + 1 :]])
            place(i + 1, [*rooms, capacity - pieces[i]])

        place(0, [])
        return best

    rng = np.random.default_rng(5)
    over = 0
    for _ in range(60):
        pieces = rng.integers(1, 20, rng.integers(1, 11)).tolist()
        found, exact = sum(k for _, k in packing.solve_packing(Counter(pieces), 20).plan), least(pieces, 20)
        assert exact <= found <= exact + 1
        over += found - exact
    assert over <= 6


def test_pipeline(spark, docs, none, tmp_path):
    """Each stage against brute force on what the stage before it kept, reread from Parquet."""
    source = docs.select(*corpus_pipeline.COLUMNS)
    frames = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frames[-1], "")
        if k < 4:
            assert out.columns == source.columns
        out.write.parquet(str(tmp_path / str(k)))
        frames.append(spark.read.parquet(str(tmp_path / str(k))))
    rows = [[tuple(r) for r in f.select(*corpus_pipeline.COLUMNS).collect()] for f in frames[:5]]
    judged = quality.judge([r[1] or "" for r in rows[0]])
    assert Counter(rows[1]) == Counter(r for r, kept in zip(rows[0], judged["kept"]) if kept)
    of = classes([r[1] for r in rows[1]])
    assert len(rows[2]) == len(set(of)) and not Counter(rows[2]) - Counter(rows[1])
    want = {r[0]: x for r, x in zip(rows[2], brute_repeats([r[1] for r in rows[2]], 200)) if r[0] is not None}
    for r in rows[3]:
        if r[0] in want and len({x[1] for x in rows[2] if x[0] == r[0]}) == 1:
            assert len(r[1].encode()) <= want[r[0]][0] - want[r[0]][1] and r[4] == len(r[1])
    assert len(rows[3]) == len(rows[2]) == len(rows[4])
    assert not [s for r in rows[4] for s in secrets.base_spans(r[1])]
    check_packing(frames[5].collect(), token_pieces([(r[0], r[1]) for r in rows[4]], packing.CAPACITY), packing.CAPACITY)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0


@pytest.mark.parametrize("small,levels,runs", [(12, 2, 1), (5, 2, 3), (3, 3, 2)])
def test_deep_recursions_and_runs_end_to_end(spark, monkeypatch, small, levels, runs):
    """Two and three levels and several runs, over texts and not over fingerprints alone, find the same classes."""
    plan = Recursion.plan

    def deep(n, distance, recall):
        made = plan(n, distance, recall, small=small)
        while made.levels < levels:
            n *= 2
            made = plan(n, distance, recall, small=small)
        planned.append(made)
        return made

    planned = []
    monkeypatch.setattr(Recursion, "plan", deep)
    monkeypatch.setattr(Recursion, "runs", lambda self: [dataclasses.replace(self, branches=-(-self.branches // runs), below=self.below or self.branches, seed=7 + k) for k in range(runs)])
    texts = [t for g in range(25) for t in variants(1000 + g, 2 + g % 5, 1 + g % 6)] + variants(5000, 60, 2) + [prose(9000 + i, 120) for i in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.class_id for r in neardup.near_classes(df).collect()} == dict(enumerate(classes(texts)))
    assert planned[0].levels >= levels


def test_runs_share_a_plan():
    design, _ = neardup.distances()
    for n in (15_000_000, 1_000_000_000):
        plan = Recursion.plan(n, design, 0.9999)
        runs = plan.runs()
        lost = math.prod(1 - r.recall(design) for r in runs)
        assert len(runs) > 1 and len({r.seed for r in runs}) == len(runs) and 1 - lost >= 0.9999
    assert len(Recursion.plan(200_000, design, 0.9999).runs()) == 1


def test_thinned_tiles_keep_what_hangs_together(monkeypatch):
    """Two dense clumps joined by one pair each way: thinning keeps every component of the near pairs."""
    monkeypatch.setattr(nearest, "DENSE", 4)
    rng = np.random.default_rng(9)
    for seed in range(6):
        base = rng.integers(0, 1 << 63, (3, 3), dtype=np.uint64)
        base[1] = base[0]
        base[1, 0] ^= np.uint64((1 << 24) - 1)  # 24 bits from the first
        prints = np.repeat(base, (90, 90, 20), axis=0)
        flips = rng.random((200, 192)) < 0.02
        prints = prints ^ np.packbits(flips, axis=1, bitorder="little").view(np.uint64)
        for most in (10, 16, 20, 26):
            d = nearest._distances(prints, prints) <= most
            reach = d | np.eye(200, dtype=bool)
            for _ in range(9):
                reach = (reach.astype(np.int64) @ reach.astype(np.int64)) > 0
            up = list(range(200))

            def find(i):
                while up[i] != i:
                    i = up[i]
                return i

            for x, y in links(prints, most, 3):
                assert d[x, y].all()
                for i, j in zip(x.tolist(), y.tolist()):
                    a, b = find(i), find(j)
                    up[max(a, b)] = min(a, b)
            assert [find(i) for i in range(200)] == reach.argmax(axis=1).tolist()


def near_of(seed, n, bits):
    """A random fingerprint and n - 1 others that differ from it in so many bits."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, (1, 3), dtype=np.uint64).repeat(n, axis=0)
    flips = rng.permuted(np.tile(np.arange(192) < bits, (n, 1)), axis=1)
    flips[0] = False
    return base ^ np.packbits(flips, axis=1, bitorder="little").view(np.uint64)


def grouped(n, edges):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in edges:
        a, b = find(i), find(j)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("clumps", [(), (90,), (70, 60)])
def test_blocks_of_a_list_meet(spark, monkeypatch, clumps):
    """One list that holds everything, cut into blocks: no pair of it is lost, beside clumps and without."""
    monkeypatch.setattr(neardup, "HOT_LIST", 20)
    monkeypatch.setattr(neardup, "BLOCK", 10)
    plan, most = Recursion(1, 11, 1), 30
    prints = np.concatenate([near_of(s, 2 + s % 3 * 5, 9) for s in range(40)] + [near_of(100 + k, n, 8) for k, n in enumerate(clumps)])
    prints.view(np.uint32)[:, 0] = plan._filters(0, 0)[1][0]  # passes the only filter
    n = len(prints)
    df = spark.createDataFrame([(i, *map(int, f.view(np.int64))) for i, f in enumerate(prints)], "node long, f0 long, f1 long, f2 long")
    got = {(r.u, r.v) for r in neardup.candidates(df, plan, most).collect()}
    want = set(zip(*(x.tolist() for x in np.nonzero(np.triu(nearest._distances(prints, prints) <= most, 1)))))
    assert got <= want
    of = grouped(n, want)
    assert grouped(n, got) == of
    sizes = Counter(of)
    assert {p for p in want if sizes[of[p[0]]] <= nearest.NEIGHBOURS + 1} <= got


def test_links_between_two_parts(monkeypatch):
    """Pairs of a head row and another: none lost between groups, dense or not, and no other pairs."""
    for dense, joined in ((64, False), (1, False), (1, True)):
        monkeypatch.setattr(nearest, "DENSE", dense)
        parts = [near_of(s, 2 + s % 4, 9) for s in range(30)] + [near_of(50, 80, 8)]
        prints = np.concatenate(parts)
        rng = np.random.default_rng(3)
        order = rng.permutation(len(prints) - 80)
        prints = np.concatenate([prints[order], prints[-80:]])
        n, head = len(prints), len(order) if joined else len(prints) // 2
        if joined:
            prints[:3] = near_of(50, 80, 8)[:3] ^ np.uint64(1)
        near = nearest._distances(prints, prints) <= 30
        near[head:] = near[:, :head] = False
        known = [(head, k) for k in range(head, n)] if joined else []
        got = [p for x, y in links(prints, 30, head=head, joined=joined) for p in zip(x.tolist(), y.tolist())]
        assert got and all(near[p] for p in got)
        assert grouped(n, known + got) == grouped(n, known + list(zip(*(x.tolist() for x in np.nonzero(near)))))


def test_near_stage_over_cut_lists(spark, monkeypatch):
    """The pipeline's stage keeps one text of each class, though blocks part nearly every pair of every list."""
    monkeypatch.setattr(neardup, "HOT_LIST", 4)
    monkeypatch.setattr(neardup, "BLOCK", 2)
    texts = [t for g in range(25) for t in variants(1000 + g, 2 + g % 2, 1 + g % 4)] + variants(5000, 24, 2) + [prose(9000 + i, 120) for i in range(15)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == sorted(set(classes(texts)))


def test_stretches_hold_a_slice(spark, monkeypatch):
    """A worker that gets 2 MB of texts in one batch cuts them by parts, with memory in proportion to a part."""
    made = []
    df = spark.createDataFrame([("a", 1, 2)], "text string, __h long, __g int")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: made.append(f))
    repeats._stretch_rows(df, "text", repeats.LENGTH, repeats.GRAM, True)
    texts = ["".join(f"line {i} of text {k}, as long as a sentence may be. " for i in range(50)) for k in range(850)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts))), pa.array([0] * len(texts), pa.int32())], ["text", "__h", "__g"])
    assert batch.nbytes > 2 << 20
    tracemalloc.start()
    found = Counter(h for b in made[0]([batch]) for h in b.column(2).to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == len(texts) and peak < 40e6

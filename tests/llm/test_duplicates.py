"""Similarity join, passages and decontamination against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from webquarry.llm import jaccard_join, substring_dedup
from webquarry.llm.components import components
from webquarry.llm.decontamination import contaminated
from webquarry.llm.jaccard_join import Similarity, boundary, classes, could_link, sketch
from webquarry.llm.substring_dedup import Passages, cut, deduplicate, repeated_passages

SCHEMA = "doc_id long, text string, node string"


def corpus(seed: int, n: int = 120) -> list[tuple]:
    """Copies, near copies, shared passages, short texts, nulls, empties and a repeated row."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 400)}"
    texts: list[str | None] = [None, "", "   ", "one", "one two", "Same words here now", "same WORDS here now"]
    passage = " ".join(word() for _ in range(60))
    for _ in range(n):
        pick = rng.random()
        if pick < 0.35 or len(texts) < 12:
            texts.append(" ".join(word() for _ in range(rng.choice([3, 7, 9, 12, 30, 80, 150]))))
        elif pick < 0.5:
            texts.append(rng.choice(texts))
        elif pick < 0.6:
            texts.append(f"{word()} {passage} {word()} {word()}")
        else:
            base = (rng.choice(texts) or "x y z").split()
            for _ in range(rng.choice([1, 1, 2, 5])):
                if base:
                    base[rng.randrange(len(base))] = word()
            texts.append(" ".join(base))
    rows = [(i * 3, t, "x") for i, t in enumerate(texts)]
    return [*rows, rows[10]]


def shingles(text, width):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows, s: Similarity) -> dict:
    sets = {i: shingles(t, s.width) for i, t, _ in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and s.of * len(sets[a] & sets[b]) >= s.least * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("seed", "s"), [(1, Similarity(4, 85)), (2, Similarity(5, 80))])
def test_join_equals_brute_force(spark, seed, s):
    rows = corpus(seed)
    got = classes(spark.createDataFrame(rows, SCHEMA).repartition(4), s).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, s)


def test_join_with_blocks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", 1)
    monkeypatch.setattr(jaccard_join.within_lists, "__defaults__", (3,))
    rows = corpus(5, 80)
    got = classes(spark.createDataFrame(rows, SCHEMA), Similarity(4, 85)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, Similarity(4, 85))


def test_join_edges(spark):
    assert classes(spark.createDataFrame([], SCHEMA)).count() == 0
    got = classes(spark.createDataFrame([(None, "a b c d e f g", "x"), (4, "a b c d e f g", "x"), (None, None, "x")], SCHEMA)).collect()
    assert sorted(str(r.component_id) for r in got) == ["4", "4", "None"]


def test_sketches_never_lose_a_link():
    rng, s = np.random.default_rng(0), Similarity(5, 80)
    for _ in range(300):
        n = int(rng.integers(5, 400))
        a = rng.integers(0, 1 << 62, n).astype(np.uint64)
        b = np.unique(np.concatenate([a[: int(n * rng.uniform(0.7, 1))], rng.integers(0, 1 << 62, int(rng.integers(0, n // 5 + 1))).astype(np.uint64)]))
        a = np.unique(a)
        if s.linked(a, b):
            assert could_link(sketch(a), len(a), sketch(b), len(b), s) and could_link(sketch(b), len(b), sketch(a), len(a), s)


def test_boundary_follows_cost():
    s = Similarity(4, 85)
    sizes = {n: 10 for n in range(1, 257)}
    assert boundary(sizes, s, 0.1) <= boundary(sizes, s, 5.0) <= boundary(sizes, s, 50.0)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 201), (200, 202), (202, 203)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200, 201: 200, 202: 200, 203: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def passages_corpus(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    word = lambda: f"v{rng.randint(0, 5000)}"
    parts = [" ".join(word() for _ in range(n)) for n in (52, 60, 90, 200)]
    rows = []
    for i in range(60):
        text = [word() for _ in range(rng.randint(0, 120))]
        if rng.random() < 0.5:
            text.insert(rng.randint(0, len(text)), rng.choice(parts))
        rows.append((i, " ".join(text), "x"))
    return [*rows, (60, None, "x"), (61, "", "x"), (None, parts[1], "x"), (62, "la " * 80, "x"), (63, "la " * 70 + "end", "x")]


def test_passages_equal_brute_force(spark):
    rows = passages_corpus(4)
    got: dict[int, set] = {}
    for r in repeated_passages(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect():
        assert r.source_doc_id < r.doc_id and r.end_word - r.start_word >= 50 and r.similarity >= 0.8
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    first: dict[tuple, int] = {}
    want: dict[int, set] = {}
    for i, text, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (text or "").lower().split()
        runs = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        for k, run in enumerate(runs):
            if first.get(run, i) != i:
                want.setdefault(i, set()).update(range(k, k + 50))
        for run in runs:
            first.setdefault(run, i)
    assert set(got) == set(want)
    assert all(want[i] <= got[i] for i in want)


def test_near_passages_are_found(spark):
    words = [f"n{i}" for i in range(120)]
    edited = words.copy()
    edited[60] = "other"
    rows = [(1, " ".join(["a", *words]), "x"), (2, " ".join([*edited, "b"]), "x"), (3, " ".join(f"z{i}" for i in range(90)), "x")]
    got = repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.doc_id, r.start_word, r.end_word, r.source_doc_id, r.source_start) for r in got] == [(2, 0, 120, 1, 1)]
    assert repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_edited_passages_equal_brute_force(spark):
    """Edits of several words in a row, insertions, deletions and moves: all pairs that are similar enough are found."""
    rng = random.Random(3)
    base = [f"n{i}" for i in range(100)]
    rows, n = [(0, base)], 1
    for size in (1, 2, 4, 5, 6, 8):
        for at in (30, 48, 60):
            for kind in ("replace", "insert", "delete"):
                new = [] if kind == "delete" else [f"e{n}x{k}" for k in range(size)]
                rows.append((n, [*base[:at], *new, *base[at + (0 if kind == "insert" else size) :]]))
                n += 1
    rows.append((n, [*base[:45], "e", *base[46:49], "e", *base[50:95]]))
    rows = [(i, [f"a{i}x{k}" for k in range(rng.randint(0, 30))] + w + [f"b{i}x{k}" for k in range(rng.randint(0, 30))]) for i, w in rows]
    got: dict[int, set] = {}
    for r in repeated_passages(spark.createDataFrame([(i, " ".join(w), "x") for i, w in rows], SCHEMA)).collect():
        a, b = (shingles(" ".join(dict(rows)[d][s:e]), 5) for d, s, e in ((r.doc_id, r.start_word, r.end_word), (r.source_doc_id, r.source_start, r.source_end)))
        assert len(a & b) >= 0.8 * len(a | b) and min(r.end_word - r.start_word, r.source_end - r.source_start) >= 50
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    for i, w in rows[1:]:
        own = [k for k, x in enumerate(w) if x[0] == "n"]
        s, e = own[0], own[-1] + 1
        if len(shingles(" ".join(w[s:e]), 5) & shingles(" ".join(base), 5)) >= 0.8 * len(shingles(" ".join(w[s:e]), 5) | shingles(" ".join(base), 5)):
            assert got[i] >= set(range(s, e)), i


@pytest.mark.parametrize("large", [False, True])
def test_all_members_of_a_group_are_partners(spark, monkeypatch, large):
    """A line that many documents have, and passages around it that only two of them share; a chain of variants."""
    if large:
        monkeypatch.setattr(substring_dedup, "SMALL_GROUP", 2)
    line = [f"l{k}" for k in range(40)]
    rows = [(i, [f"p{i}x{k}" for k in range(30)] + line + [f"q{i}x{k}" for k in range(30)]) for i in range(40)]
    rows += [(100 + i, [f"p{i}x{k}" for k in range(30)] + line + [f"r{i}x{k}" for k in range(30)]) for i in (7, 20)]
    for i in range(4):  # of three variants the last one is similar to the middle one only
        first = [f"c{i}x{k}" for k in range(60)]
        middle = [*first[:20], "d", *first[21:]]
        rows += [(200 + 10 * i, first), (201 + 10 * i, middle), (202 + 10 * i, [*middle[:40], "d", *middle[41:]])]
    got = {(r.doc_id, r.source_doc_id) for r in repeated_passages(spark.createDataFrame([(i, " ".join(w), "x") for i, w in rows], SCHEMA)).collect()}
    assert {(107, 7), (120, 20)} <= got and all(d >= 100 for d, _ in got)
    assert {(k + 10 * i, k - 1 + 10 * i) for i in range(4) for k in (201, 202)} <= got


def test_cutting(spark):
    assert cut(b"a  b\nc d", [(1, 2)]) == b"a  c d" and cut(b" a b ", [(0, 2)]) == b" " and cut("é x y".encode(), [(0, 1), (2, 3)]) == b"x "
    p = " ".join(f"n{i}" for i in range(60))
    docs = spark.createDataFrame([(1, p, 5), (2, f"mine {p} too", 5), (3, p, 5), (4, None, 5), (5, "", 5)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in deduplicate(docs).collect()}
    assert got == {1: (p, 5), 2: ("mine too", 8), 4: (None, 5), 5: ("", 5)}


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(9)
    word = lambda: f"q{rng.randint(0, 900)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 5, 6, 12, 25, 59])))) for i in range(40)] + [(90, None), (91, ""), (92, "a b c"), (92, "a b c")]
    docs = []
    for i in range(60):
        text = [word() for _ in range(rng.randint(0, 300))]
        for _ in range(rng.choice([0, 1, 2])):
            part = (rng.choice(items)[1] or "").split()
            if part and rng.random() < 0.4:
                part[rng.randrange(len(part))] = "changed"
            text[rng.randint(0, len(text)) :] = [*part, *text[-20:]]
        docs.append((i, " ".join(text), "x"))
    docs += [(60, None, "x"), (61, "", "x"), (None, "x A  b\tC y", "x")]
    runs = lambda t, w: {tuple(t[k : k + w]) for k in range(len(t) - w + 1)}
    want = set()
    for i, text, _ in docs:
        t = (text or "").lower().split()
        for j, item in set(items):
            v = (item or "").lower().split()
            if v and len(runs(v, w := min(5, len(v))) & runs(t, w)) >= 0.8 * len(runs(v, w)):
                want.add((i, j))
    got = contaminated(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(str, [(r.doc_id, r.item_id) for r in got])) == sorted(map(str, want)) and len(want) > 10
    assert contaminated(spark.createDataFrame([], SCHEMA), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert contaminated(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_passage_options():
    assert Passages().tokens == 46


def test_windows_of_batches_are_those_of_the_trees():
    rng, passages = np.random.default_rng(0), Passages()
    for trial in range(8):
        texts = []
        for _ in range(20):
            x = rng.integers(0, int(rng.choice([1, 2, 5, 50, 5000])), int(rng.integers(50, 400))).astype(np.uint32)
            if rng.random() < 0.3:
                x[20:80] = 7
            texts.append(x)
        tokens = np.unique(np.concatenate([substring_dedup._shingles(x, passages.width) for x in texts]))
        hot = np.sort(rng.choice(tokens, len(tokens) // 3, replace=False)) if trial % 2 else None
        *made, text = substring_dedup.batch_windows(texts, passages, hot)
        for i, x in enumerate(texts):
            want = sorted(zip(*(m.tolist() for m in substring_dedup.compact_windows(x, passages, hot)), strict=True))
            assert sorted(zip(*(m[text == i].tolist() for m in made), strict=True)) == want


def test_hash_functions_are_independent():
    rng, few, same, trials = np.random.default_rng(1), 0, 0, 6000
    for _ in range(trials):
        s = rng.integers(1, 1 << 62, 51).astype(np.uint64)
        least = [int(substring_dedup._order(s, f, np.ones(51, np.uint64)).argmin()) for f in range(5)]
        few += sum(c < 41 for c in least) < 2
        same += least[0] == least[2]
    assert few / trials < 0.012 and same / trials < 0.04


@pytest.mark.parametrize("members", [8, 300])
def test_recall_of_near_passages(spark, members):
    """Pairs of passages of 60 words at similarity 0.8 and a bit more, in groups that share a line: inside small and large groups."""
    rng = random.Random(members)
    line = [f"l{k}" for k in range(40)]
    rows, pairs = [], []
    for i in range(members):
        own = [f"p{i}x{k}" for k in range(60)]
        edited = own.copy()
        edited[rng.choice([18, 30, 41])] = "changed"  # 5 of 56 shingles on either side: 51 / 61
        rows += [(2 * i, [f"a{i}x{k}" for k in range(rng.randint(0, 9))] + line + own), (2 * i + 1, line + edited + [f"b{i}x{k}" for k in range(rng.randint(0, 9))])]
        pairs.append((2 * i + 1, 2 * i))
    got = {(r.doc_id, r.source_doc_id) for r in repeated_passages(spark.createDataFrame([(i, " ".join(w), "x") for i, w in rows], SCHEMA).repartition(4)).collect()}
    recall = len(got & set(pairs)) / len(pairs)
    print(f"recall of near passages in groups of {2 * members}: {recall:.3f}")
    assert recall > 0.95


def test_shared_keys_are_streamed():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        rows = sorted((int(rng.integers(0, 8)), int(rng.integers(0, 3)), int(rng.integers(0, 5))) for _ in range(n))
        whole = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["key", "doc_id", "a"])
        docs: dict[int, list[tuple]] = {}
        for r in rows:
            docs.setdefault(r[0], []).append(r)
        for first in ([], ["a"]):
            sharing, got, at = substring_dedup.Sharing(first), [], 0
            while at < n:
                size = int(rng.integers(1, 9))
                for b in sharing(whole.slice(at, size)):
                    got += zip(*(c.to_pylist() for c in b.columns), strict=True)
                at += size
            assert sorted(got) == sorted(r + (docs[r[0]][0][1:] if first else ()) for r in rows if len({x[1] for x in docs[r[0]]}) > 1)


def test_promising_pairs_are_those_with_enough_in_common():
    rng, passages = np.random.default_rng(0), Passages()
    sizes, n = [], passages.tokens
    while n < 2 * passages.tokens:
        m = min(2 * passages.tokens, n + n // 3)
        sizes.append((n, int(n - (1 - passages.similarity) * (m - 1))))
        n = m
    for _ in range(20):
        pairs = []
        for _ in range(12):
            a = rng.integers(0, int(rng.choice([3, 50, 10000])), int(rng.integers(0, 200))).astype(np.uint32)
            b = a.copy() if rng.random() < 0.5 else rng.integers(0, 50, int(rng.integers(0, 200))).astype(np.uint32)
            b[rng.integers(0, max(1, len(b)), int(rng.integers(0, 20)) if len(b) else 0)] = 99999
            pairs.append((a, b[int(rng.integers(0, 30)) :]))
        for (a, b), got in zip(pairs, substring_dedup.promising(pairs, passages), strict=True):
            hit = np.isin(substring_dedup._shingles(a, 5), substring_dedup._shingles(b, 5))
            assert got == any(hit[k : k + n].sum() >= least for n, least in sizes for k in range(len(hit) - n + 1))


def test_stretches_hold_all_that_can_be_passages():
    rng = np.random.default_rng(5)
    passages = Passages(least=14, width=5)
    n, t = 160, passages.tokens
    for _ in range(60):
        alone = rng.random(n) < rng.choice([0.05, 0.2, 0.5, 0.9], 8).repeat(n // 8)
        inside = np.ones(n, dtype=bool)
        inside[rng.integers(n, size=3)] = False
        kept = np.zeros(n, dtype=bool)
        for lo, hi in substring_dedup.stretches(alone, inside, passages).tolist():
            assert hi - lo >= t and inside[lo:hi].all()
            kept[lo:hi] = True
        want = np.zeros(n, dtype=bool)
        for lo in range(n):
            for hi in range(lo + t, n + 1):
                if inside[lo:hi].all() and 5 * alone[lo:hi].sum() <= hi - lo:
                    want[lo:hi] = True
        assert (kept == want).all()


def test_only_texts_that_can_share_a_passage_have_windows(spark):
    rng = random.Random(8)
    words = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    line, passage = words(12), words(60)
    rows = [(i, f"{words(100)} {line} {words(100)}".encode()) for i in range(20)]
    rows += [(i, f"{words(70)} {passage} {line} {words(30)}".encode()) for i in (20, 21)] + [(22, None), (23, b"a b")]
    held = substring_dedup.chunks(spark.createDataFrame(rows, "doc_id long, text binary"), Passages()).cache()
    found = substring_dedup.segments(held, substring_dedup.repeated(held, 3, Passages()), Passages()).collect()
    assert {r.node for r in found} == {20, 21}
    for r in found:
        (lo, hi), *more = np.frombuffer(r.segments, dtype="<i4").reshape(-1, 2).tolist()
        assert not more and lo <= 70 and hi >= 70 + 72 - 4


def test_large_groups_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SMALL_GROUP", 2)
    monkeypatch.setattr(substring_dedup, "rare_windows", lambda texts, passages: spark.createDataFrame([], substring_dedup._WINDOWS))
    rng = random.Random(9)
    words = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    line, rows = words(44), []
    for k in range(12):
        passage = f"{words(3)} {line} {words(3)}"
        rows += [(2 * k + i, f"{words(30)} {passage} {words(30)}") for i in (0, 1)]
    found = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), Passages(functions=2)).collect()
    assert {(r.doc_id, r.source_doc_id) for r in found if r.doc_id % 2} >= {(2 * k + 1, 2 * k) for k in range(12)}

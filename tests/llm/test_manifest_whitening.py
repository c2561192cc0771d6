"""The Merkle manifest against a recursive tree, whitening against exact rational arithmetic."""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest

from webquarry.llm.merkle import Shape, manifest
from webquarry.llm.whitening import primes, remainder, whiten

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row: tuple, lower: bool = False) -> str:
    doc_id, text, lang, source, n_chars = row
    if lower and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def _up(nodes: list[str], at: int, own: str, fanout: int) -> tuple[str, str, str]:
    """Root of nodes, root with ``own`` at ``at``, and the siblings met on the way."""
    proof, mine = "", own
    nodes = list(nodes)
    while len(nodes) > 1:
        lo = at - at % fanout
        run = nodes[lo : lo + fanout]
        proof += "".join(x for k, x in enumerate(run) if lo + k != at)
        mine = _h(*[mine if lo + k == at else x for k, x in enumerate(run)])
        nodes = [_h(*nodes[k : k + fanout]) for k in range(0, len(nodes), fanout)]
        at //= fanout
    return nodes[0], mine, proof


def _expected(rows: list[tuple], fanout: int) -> list[tuple]:
    groups: dict[str | None, list[tuple]] = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in langs:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
    leaves = {g: [_leaf(r) for r in groups[g]] for g in langs}
    subroots = [_up(leaves[g], 0, "", fanout)[0] for g in langs]
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(groups[g]):
            changed = zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 3 == 0
            _, mine, proof = _up(leaves[g], i, _leaf(r, changed), fanout)
            root, mine, upper = _up(subroots, k, mine, fanout)
            out.append((r[0], leaves[g][i], subroots[k], root, _h(proof + upper), mine, mine == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shape", [Shape(2, 2), Shape(3, 1), Shape(8, 4)])
def test_manifest_is_the_recursive_tree(spark, shape):
    langs = ["en"] * 6 + ["de", "fr", None, "é"]
    rows = [(k if k % 17 else None, f"Text {k} A" if k % 5 else None, langs[k % 10] if k % 41 else f"x{k}", "S" if k % 7 else None, k) for k in range(150)]
    rows += [rows[3], rows[3], (7, "", "en", "", 0), (7, "Other", "en", "", 0), (501, "Ä A" * 100_000, "only", None, None)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS digest", "2 AS grp", "3 AS position", "4 AS path")
    got = [tuple(r) for r in manifest(df.repartition(5), shape).collect()]
    assert sorted(got, key=repr) == _expected(rows, shape.fanout)


def test_manifest_of_few_rows(spark):
    assert manifest(spark.createDataFrame([], DOCS)).collect() == []
    (one,) = manifest(spark.createDataFrame([(1, "abc", None, "s", 3)], DOCS)).collect()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == _h("") and one.verified


def test_remainders_are_exact():
    values = np.array([0, 1, -1, 10**40, -(10**40), 123456789012345678901234567890], dtype=object)
    chosen = primes(2 * 10**40)
    assert all(p < 1 << 20 and all(p % k for k in range(2, 1024)) for p in chosen)
    assert remainder({p: (values % p).astype(np.int64) for p in chosen}).tolist() == values.tolist()


def _exact(vectors: list[list[float]]) -> tuple[list[list[int]], int, list[int], np.ndarray]:
    xs = [[int(np.floor(256 * float(np.float32(c)))) for c in v] for v in vectors]
    fit = sorted({tuple(x) for x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    d = len(sums)
    centred = [[Fraction(c) - Fraction(s, n) for c, s in zip(x, sums, strict=True)] for x in fit]
    return xs, n, sums, np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(d)] for i in range(d)])


@pytest.mark.parametrize("scale", [1.0, 3e12])
def test_whitening_is_exact(spark, scale):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(60, 6)) * [5, 4, 3, 2, 1, 0.5] * scale).astype(np.float32).tolist()
    vectors += [vectors[0]] * 40  # copies count once
    bad = [None, [], [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5, [1.0, 2.0]]
    rows = [(k, v, 0) for k, v in enumerate([*vectors, *bad])] + [(None, vectors[1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x int").repartition(7)
    got = whiten(df).collect()
    xs, n, sums, covariance = _exact(vectors)
    values, axes = np.linalg.eigh(covariance)
    assert len(got) == 4 * 101 and {r.vec_id for r in got} == {*range(100), None}
    signs: dict[int, float] = {}
    for r in got:
        x = xs[1 if r.vec_id is None else r.vec_id]
        e, v = values[-r.component], axes[:, -r.component]
        want = sum((Fraction(c) - Fraction(s, n)) * Fraction(float(a)) for c, s, a in zip(x, sums, v, strict=True)) / Fraction(float(np.sqrt(e)))
        sign = signs.setdefault(r.component, np.sign(float(want) * r.whitened) or 1.0)
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        assert r.n == n and r.deviation == (deviation if deviation < 1 << 63 else None)
        assert abs(sign * float(want) - r.whitened) < 1e-8
        assert abs(r.explained - e / np.trace(covariance)) < 1e-9 and r.identity_error < 1e-9


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema)).collect() == []
    assert whiten(spark.createDataFrame([(1, None)], schema)).collect() == []
    same = whiten(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], schema)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(1, 0, None, None, None)] * 4
    line = whiten(spark.createDataFrame([(1, [0.5, 0.25]), (2, [1.5, 0.25])], schema)).collect()
    assert [r.whitened is None for r in line] == [False, True, False, True] and {abs(r.whitened) for r in line if r.component == 1} == {1.0}

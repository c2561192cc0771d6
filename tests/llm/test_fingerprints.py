"""Weighted sampling agrees with the generalised Jaccard similarity."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np

from webquarry.llm.fingerprint import WeightedSampler, edited_fingerprints, fingerprints, terms_of

SCHEMA = "doc_id long, text string, fingerprint string"


def jaccard(a: Counter, b: Counter) -> float:
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / max(1, sum(max(a[k], b[k]) for k in keys))


def test_collision_rate_is_generalised_jaccard():
    rng, sampler, errors = random.Random(3), WeightedSampler(samples=512), []
    for _ in range(60):
        a = Counter({b"w%d" % i: rng.randint(1, 9) for i in range(40)})
        b = Counter({k: max(1, v + rng.randint(-4, 4)) for k, v in a.items() if rng.random() < 0.8})
        errors.append(float((sampler(a) == sampler(b)).mean()) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04


def test_memory_does_not_change_signatures():
    small, large = WeightedSampler(memory=8), WeightedSampler()
    for n in (3, 8, 30):
        terms = Counter({b"t%d" % i: 1 + i % 3 for i in range(n)})
        assert (small(terms) == large(terms)).all()


def test_edited_texts(spark):
    texts = {1: "one two three four five six seven eight", 2: None, 3: "", 5: "ä" * 50, 9: "one two three four five six seven eight", 12: "b " * 20_000, -4: "first of all"}
    rows = [(i, t, "x") for i, t in texts.items()]
    got = {r.doc_id: r for r in edited_fingerprints(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    order = sorted(texts)
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        a, b = texts[i] or "", texts[j] or ""
        q = len(a) // 4
        assert got[i].n_chars == len(a) and got[i].edited_sha256 == hashlib.sha256((a[: len(a) - q] + b[:q]).encode()).hexdigest()
        assert abs(got[i].near_next - jaccard(terms_of(a), terms_of(b))) < 0.25 or not a.strip()
    assert got[1].fingerprint == got[9].fingerprint and got[2].fingerprint == got[3].fingerprint and got[2].near_next == 1.0
    plain = {r.doc_id: r.fingerprint for r in fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert plain == {i: r.fingerprint for i, r in got.items()}


def test_edges(spark):
    assert edited_fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    one = edited_fingerprints(spark.createDataFrame([(1, "only one", "x")], SCHEMA)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    same = edited_fingerprints(spark.createDataFrame([(1, "a b c d", "x"), (1, "a b c d", "x"), (None, "a", "x")], SCHEMA)).collect()
    assert len(same) == 3 and len({r.fingerprint for r in same}) == 2

"""Toxicity and the language model on held-out rows, and the pipeline."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from webquarry.llm.lm import Shape, pack_tokens, perplexity, sample_contexts, sample_restaurants, sample_tail, seat, unpack_tokens
from webquarry.llm.toxicity import Features, Ftrl, Rates, fit, score, toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    s, y = rows["score"].to_numpy(), rows["toxic"].to_numpy()
    auc = (s[y == 1][:, None] > s[y == 0][None, :]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :]).mean()
    hit = rows["predicted"].to_numpy() == 1
    assert auc > 0.97 and y[hit].mean() > 0.9 and hit[y == 1].mean() > 0.8


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, "you idiot", 0.5), (2, None, 0.5), (None, "", 0.5), (1, "you idiot", 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity(docs, none).collect()
    assert len(got) == 4 and all(r.score == 0.5 and r.predicted == 1 for r in got)
    assert [r.held_out for r in got if r.doc_id == 1] == [zlib.crc32(b"1") % 4 == 2] * 2
    kept = score(docs, fit(docs, none), [F.col("doc_id"), F.col("score")], name="toxic").collect()
    assert [r.toxic for r in kept] == [0.5] * 4


def test_ftrl_is_sparse_and_learns():
    rng = np.random.default_rng(0)
    rows = [(int(i % 4 == 0), np.unique(np.append(rng.integers(10, 4000, 30), 3 if i % 4 == 0 else 5))) for i in range(800)]
    model = Ftrl(4001, Rates())
    for _ in range(6):
        for y, x in rows:
            model.learn(x, y)
    places, values = model.sparse()
    weights = dict(zip(places.tolist(), values.tolist(), strict=True))
    assert len(places) < 200 and weights[3] > 1 and weights.get(5, 0) <= 0
    assert Features().bits == 22


def test_seating_counts():
    rng = np.random.default_rng(1)
    assert (seat(np.array([1.0, 1.0]), np.array([5.0, 0.1]), 0.5, rng) == 1).all()
    c, prior, d = 200.0, 3.0, 0.5
    drawn = seat(np.full(4000, c), np.full(4000, prior), d, rng)
    exact = []
    for _ in range(300):
        t = 1
        for j in range(1, int(c)):
            t += rng.random() < prior / (prior + j - d * t)
        exact.append(t)
    assert abs(drawn.mean() - np.mean(exact)) < 0.6 and (drawn <= c).all()
    assert len(seat(np.empty(0), np.empty(0), d, rng)) == 0


def test_probabilities_add_up():
    rng = np.random.default_rng(2)
    cells = rng.choice(5 * 9, 25, replace=False)
    logs = sample_contexts(cells // 9, cells % 9, rng.integers(1, 50, 25), 5, 9, Shape())
    assert np.allclose((10.0**logs).sum(axis=1), 1, atol=1e-4)
    bins = {1: (500, 500), 2: (80, 160), 7: (10, 70)}
    keep, rest = sample_tail(bins, Shape())
    total = sum(n * (s / n * keep[b] + rest) for b, (n, s) in bins.items()) + rest
    assert abs(total - 1) < 0.02


def test_perplexity_base_and_gain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(900001, None), (900002, ""), (None, "Zzz unseen Zzz")], "doc_id long, text string")
    docs = docs.unionByName(extra).withColumn("score", F.lit("x"))
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.collect()]
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10
    c: Counter = Counter()
    for i, w in rows:
        if fold(i):
            c.update(w)
            c[b""] += 1
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in perplexity(docs, shape=Shape(contexts=40, dishes=300, dictionary=2000)).collect()}
    assert len(got) == len(rows)
    for i, w in rows:
        r, tokens = got[i], [*w, b""]
        assert r.held_out == (fold(i) == 0) and r.n_tokens == len(tokens) and r.n_known == sum(c[t] > 0 for t in tokens) and r.train_tokens == n
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens), abs=1e-6)
        assert r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert perplexity(docs.limit(0)).count() == 0


def test_pairs_beyond_the_table_count(spark):
    """Held-out texts of pairs of rare words that training has, against the same words in other pairs."""
    rng = np.random.default_rng(3)
    fold = lambda i: zlib.crc32(str(i).encode()) % 10
    learned, held = [i for i in range(1200) if fold(i)][:900], [i for i in range(1200) if not fold(i)]
    pair = lambda i, shift=0: f"first{i} second{(i + shift) % 60}"
    rows = [(i, " ".join(["the", *[pair(int(k)) for k in rng.integers(0, 60, 5)]])) for i in learned]
    kept, broken = held[:30], held[30:60]
    for a, b in zip(kept, broken, strict=True):
        some = [int(k) for k in rng.integers(0, 60, 5)]
        rows += [(a, " ".join(["the", *[pair(k) for k in some]])), (b, " ".join(["the", *[pair(k, 7) for k in some]]))]
    for dictionary in (4, 2000):  # the words are looked up by the join; the dictionary has them
        got = {r.doc_id: r for r in perplexity(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shape=Shape(contexts=1, dishes=2, dictionary=dictionary)).collect()}
        assert len(got) == len(rows)
        # Each of five pairs is one of 60 that were seen about 75 times.
        assert all(got[a].score > got[b].score + 5 for a, b in zip(kept, broken, strict=True))


def test_restaurants_add_up():
    rng = np.random.default_rng(4)
    context, c = np.repeat(np.arange(6), 20), rng.integers(1, 30, 120)
    prior = rng.dirichlet(np.ones(20), 6).ravel()
    own, share = sample_restaurants(context, c, prior, 7, Shape())
    assert np.allclose(np.bincount(context, own, 7) + share, 1) and share[6] == pytest.approx(1) and (own > 0).all()


def test_packed_tokens():
    rng = np.random.default_rng(5)
    row, before, token, context = rng.integers(2**40, 2**40 + 9000, 500), rng.integers(-(2**63), 2**63 - 1, 500), rng.integers(2, 131_074, 500), rng.integers(-1, 512, 500)
    before[:100] = before[100:200]
    got = unpack_tokens(pack_tokens(row, before, token, context))
    assert sorted(zip(*(x.tolist() for x in got[:4]), strict=True)) == sorted(zip(row.tolist(), before.tolist(), token.tolist(), context.tolist(), strict=True))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), f"test-{name}")
        if name != "packing":
            assert docs.columns == columns and 0 < docs.count() <= n
            n = docs.count()
    pieces = docs.toPandas()
    assert pieces.groupby("sequence_id")["length"].sum().max() <= 2048 and pieces["doc_id"].nunique() == n


def test_pipeline_decisions(spark, tmp_path):
    p = " ".join(f"k{i}" for i in range(70))
    other = " ".join(f"m{i}" for i in range(40))
    leak = " ".join(f"b{i}" for i in range(20))
    docs = [(1, p), (2, p), (3, f"{other} {p}"), (4, f"x y {leak} z"), (5, None), (6, ""), (7, "clean words stay as they are"), (8, other.replace("m3 ", "mm "))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    run = dict(corpus_pipeline.STAGES)
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    d = corpus_pipeline.materialize(run["near_duplicates"](spark, d, str(tmp_path)), "t1")
    assert {r.doc_id for r in d.collect()} == {1, 3, 4, 5, 6, 7, 8}
    d = corpus_pipeline.materialize(run["passages"](spark, d, str(tmp_path)), "t2")
    assert {r.doc_id: r.text for r in d.collect()}[3].split() == other.split()
    d = corpus_pipeline.materialize(run["decontamination"](spark, d, str(tmp_path)), "t3")
    assert {r.doc_id for r in d.collect()} == {1, 3, 5, 6, 7, 8}


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    """Empty labels and benchmark, null ids and texts, repeated rows, other columns with the names that stages use."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    text = " ".join(f"w{i}" for i in range(70))
    rows = [(1, text, "en", "s", 5, "a"), (1, text, "en", "s", 5, "a"), (2, f"{text} end", "en", "s", 5, "b"), (3, None, None, None, None, None), (None, "", "en", "s", 0, "c"), (None, None, "en", "s", 0, "d")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _toxicity string"
    names = dict(corpus_pipeline.STAGES)
    for docs, kept in ((spark.createDataFrame(rows, schema), {"toxicity": 6, "near_duplicates": 4, "passages": None, "decontamination": 6}), (spark.createDataFrame([], schema), {})):
        for name in ("toxicity", "near_duplicates", "passages", "decontamination"):
            got = names[name](spark, docs, str(tmp_path))
            assert got.columns == docs.columns, name
            if kept.get(name) is not None:
                assert got.count() == kept[name], name
            elif not kept:
                assert got.count() == 0, name
    assert names["packing"](spark, spark.createDataFrame([], schema), str(tmp_path)).count() == 0


def test_sums_of_texts_go_on_packed():
    import pyarrow as pa

    from webquarry.llm import lm

    rng = np.random.default_rng(2)
    row = np.unique(rng.integers(0, 1 << 40, 500))
    known, base, score = rng.integers(0, 9, len(row)), -rng.random(len(row)), -rng.random(len(row))
    for got, want in zip(lm.unpack_sums(lm.pack_sums(row, known, base, score)), (row, known, base, score), strict=True):
        assert (got == want).all()
    n = len(row)
    names = ["row", "doc_id", *lm._SUMS, "to", "packed"]
    texts = [pa.array(row[::-1]), pa.array([None, *range(1, n)], pa.int64()), pa.array(np.full(n, 3)), pa.array(np.full(n, 1)), pa.array(np.zeros(n)), pa.array(np.zeros(n)), pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.binary())]
    parts = [lm.pack_sums(row[k::2], known[k::2], base[k::2], score[k::2]) for k in (0, 1)] + [lm.pack_sums(row, known, base, score)]
    added = [*[pa.nulls(3, pa.int64())] * 4, *[pa.nulls(3, pa.float64())] * 2, pa.array(np.zeros(3, np.int32)), pa.array(parts, pa.binary())]
    out = pa.Table.from_batches(lm.summed(iter([pa.RecordBatch.from_arrays(added, names=names), pa.RecordBatch.from_arrays(texts, names=names)]))).to_pydict()
    assert out["row"] == row.tolist() and out["doc_id"] == [*range(n - 1, 0, -1), None]
    assert out["n_known"] == (1 + 2 * known).tolist() and np.allclose(out["base"], 2 * base) and np.allclose(out["score"], 2 * score)

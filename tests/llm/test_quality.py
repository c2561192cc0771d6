"""Quality by multiple-instance learning: features, gradients, held-out rows, edges."""

from __future__ import annotations

import zlib

import numpy as np

from webquarry.llm.quality import FEATURES, PIECE, Attention, Bags, Training, encode, fit, pieces, quality, score
from webquarry.llm.shingles import Words
from pyspark.sql import functions as F


def test_encoding_by_hand():
    text = b"  Aa aa, aa!!\nbb " + b"c d " * 50
    x, each = encode([text, b"", b" \n ", b"zz"], Bags(), Words())
    # Two lines; the second has 101 words in passages of 48.
    assert each.tolist() == [4, 1, 1, 1] and not x[4].any() and not x[5].any() and x.shape == (7, FEATURES)
    first = x[0][-7:]
    lengths = np.array([2, 3, 4])
    assert np.allclose(first, [np.log1p(3), np.log1p(3), lengths.std() / 3, 0, 1, 1 / 3, 1 / 3], atol=1e-6)
    assert np.allclose(x[1][-3:], [3 / 48, 0, 0]) and np.allclose((x[:4, :256] ** 2).sum(axis=1), 1, atol=1e-5)
    assert np.allclose(x[2][-4:], [0, 2 / 48, 0, 0])


def test_encoding_does_not_depend_on_neighbours():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.choice(np.frombuffer("ab C!|.\n\t9é\x00".encode(), np.uint8), size=int(n)).tobytes()) for n in rng.integers(0, 900, 60)]
    x, each = encode(texts, Bags(5), Words())
    for t, own in zip(texts, np.split(x, np.cumsum(each)[:-1]), strict=True):
        alone, count = encode([t], Bags(5), Words())
        assert count.tolist() == [len(own)] and np.array_equal(alone, own)


def test_pieces_are_whole():
    text = b"word " * 300 + b"x" * 999
    got = pieces(text, 100)
    assert b"".join(got) == text and max(map(len, got)) <= 100 and all(p.endswith(b" ") for p in got[:14])


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    each, y = np.array([3, 1, 4]), np.array([1.0, 0.0, 1.0])
    x = rng.normal(size=(8, 5))
    model = Attention.start(x, Training(hidden=4, attention=3))

    def loss() -> float:
        p = model.scores(*model.pooled(x, each))
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    for name, gradient in model.gradients(x, each, y).items():
        flat = model.p[name].reshape(-1)
        for k in range(0, flat.size, 3):
            before = flat[k]
            flat[k] = before + 1e-6
            up = loss()
            flat[k] = before - 1e-6
            down = loss()
            flat[k] = before
            assert abs((up - down) / 2e-6 - gradient.reshape(-1)[k]) < 1e-6, name


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in rows["doc_id"])
    s, y = rows["score"].to_numpy(), rows["quality"].to_numpy()
    auc = (s[y == 1][:, None] > s[y == 0][None, :]).mean()
    kept = rows["predicted"].to_numpy() == 1
    assert auc > 0.99 and kept[y == 1].mean() > 0.99 and kept[y == 0].mean() < 0.05


def test_attention_finds_the_one_bad_passage(spark):
    rng = np.random.default_rng(2)
    line = lambda: " ".join("".join(rng.choice(list("abcdefg"), 5)) for _ in range(20))
    texts = ["\n".join([line() for _ in range(6)] + ([line().upper() + " !!"] if k % 2 else []) + [line() for _ in range(6)]) for k in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(300)], "doc_id long, quality int")
    rows = quality(docs, labels).filter("held_out").collect()
    assert len(rows) > 30 and all(r.predicted == 1 - r.doc_id % 2 for r in rows)


def test_quality_edges(spark):
    schema = "doc_id long, text string, score double, label int"
    rows = [(1, "some words", 0.5, 0), (2, None, 0.5, 0), (None, "", 0.5, 0), (1, "some words", 0.5, 0), (3, "long text " * (PIECE // 8), 0.5, 0), (4, "x" * (PIECE + 5), 0.5, 0)]
    docs, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality(docs, none).collect()] == [0.5] * 6
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (None, 1), (4, None), (99, 1)], "doc_id long, quality int")
    got = quality(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1 and len({r.score for r in got if r.doc_id in (2, None)}) == 1
    kept = score(docs, fit(docs, none), [F.col("doc_id"), F.col("score")], name="quality").collect()
    assert [r.quality for r in kept] == [0.5] * 6
    assert quality(spark.createDataFrame([], schema), labels).collect() == []

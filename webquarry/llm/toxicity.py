"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import trimmed, tune

_WORD = re.compile(r"[^\W\d_]+")
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


@dataclass(frozen=True)
class Features:
    """Which hashed features a text has.

    Unigrams, bigrams, skip-grams that leave out up to ``skips`` words, and stems (the first 3 to 7 letters of a word),
    each counted once a text, in ``1 << bits`` places.
    """

    bits: int = 22
    skips: int = 2
    stems: tuple[int, ...] = (3, 4, 5, 6, 7)


class Hasher:
    """Features of texts, with a bounded memory of words."""

    def __init__(self, kind: Features, memory: int = 200_000):
        self.kind, self.memory = kind, memory
        self.rows: dict[str, int] = {}
        self.table = np.zeros((memory, 1 + len(kind.stems)), dtype=np.uint64)

    def _hashes(self, words: list[str]) -> np.ndarray:
        """A row of hashes for each distinct word, then one row for each word of the text."""
        rows = self.rows
        missing = [w for w in dict.fromkeys(words) if w not in rows]
        if len(rows) + len(missing) > self.memory:
            rows.clear()
            missing = list(dict.fromkeys(words))
            if len(missing) > len(self.table):
                self.table = np.zeros((len(missing), self.table.shape[1]), dtype=np.uint64)
        for w in missing:
            n = rows[w] = len(rows)
            own = xxhash.xxh64_intdigest(w)
            self.table[n, 0] = own
            for k, size in enumerate(self.kind.stems):
                self.table[n, k + 1] = xxhash.xxh64_intdigest(w[:size], seed=size) if len(w) > size else own
        return self.table[np.fromiter((rows[w] for w in words), np.int64, len(words))]

    def __call__(self, text: str) -> np.ndarray:
        """The sorted places of a text's features; none for a text without words."""
        words = _WORD.findall(text.lower())
        if not words:
            return np.empty(0, dtype=np.int64)
        h = self._hashes(words)
        parts = [h.ravel()]
        for gap in range(1, self.kind.skips + 2):
            if len(words) > gap:
                parts.append((h[:-gap, 0] * _FACTORS[0]) ^ (h[gap:, 0] * _FACTORS[1]) ^ np.uint64(gap * 0x51ED270B))
        places = (np.concatenate(parts) * _FACTORS[2]) >> np.uint64(64 - self.kind.bits)
        return np.unique(places.astype(np.int64))


@dataclass(frozen=True)
class Rates:
    """FTRL-proximal: learning rate alpha / (beta + sqrt(sum of squared gradients)) for each coordinate, L1 and L2."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 1.0
    passes: int = 8


class Ftrl:
    """Logistic regression with per-coordinate rates; weights whose gradient sum stays within L1 are exactly zero."""

    def __init__(self, size: int, rates: Rates):
        self.rates = rates
        self.z = np.zeros(size)
        self.n = np.zeros(size)

    def weights(self, at: np.ndarray) -> np.ndarray:
        r, z = self.rates, self.z[at]
        w = -(z - np.sign(z) * r.l1) / ((r.beta + np.sqrt(self.n[at])) / r.alpha + r.l2)
        return np.where(np.abs(z) <= r.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.rates.alpha * w
        self.n[at] = n + g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(np.abs(self.z) > self.rates.l1)
        return at, self.weights(at)


def train(rows: list[tuple[int, np.ndarray]], kind: Features, rates: Rates) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the weights that aren't zero; the last place, ``1 << bits``, is the bias."""
    model = Ftrl((1 << kind.bits) + 1, rates)
    bias = np.int32(1 << kind.bits)
    for k, (y, x) in enumerate(rows):  # in place and in 32 bits: the rows are most of the memory of this task
        rows[k] = y, np.append(x.astype(np.int32, copy=False), bias)
    for p in range(rates.passes):
        for i in np.random.default_rng(p).permutation(len(rows)):
            model.learn(rows[i][1], rows[i][0])
    return model.sparse()


@dataclass(frozen=True)
class Model:
    kind: Features
    places: np.ndarray
    values: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros((1 << self.kind.bits) + 1, dtype=np.float32)
        out[self.places] = self.values
        return out


def crc_mod(id_column: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(id_column.cast("string"), F.lit("")), "UTF-8")) % divisor


def fit(docs: DataFrame, labels: DataFrame, kind: Features = Features(), rates: Rates = Rates(), most_rows: int = 16_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from the labelled rows of ``labels`` (id and 0/1 label), at most about ``most_rows`` of them.

    Beyond that number the rows with the smallest hashes of their ids are taken, so that the training set, the one
    task that learns and the broadcast of its ids are bounded at any input size.  Rows without id, label or document
    are left out; of an id with several labels the greatest counts, of one with several texts the least.  Without any rows all scores are 0.5.
    """
    spark = docs.sparkSession
    tune(spark)
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    n = known.count()
    if n > most_rows:
        share = int((1 << 32) * 0.98 * most_rows / n)
        known = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 32)) < share)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(known), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.first("_label").alias("_label"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(kind)
        seen: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for i, text, label in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                seen[i] = (label, hasher(text).astype(np.int32))
        if seen:
            places, values = train([seen.pop(i) for i in sorted(seen)], kind, rates)
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(values, pa.float64())], names=["place", "value"])

    found = rows.repartition(1).mapInArrow(trimmed(learn), "place long, value double").collect()
    return Model(kind, np.array([r.place for r in found], dtype=np.int64), np.array([r.value for r in found], dtype=np.float32))


def score(docs: DataFrame, model: Model, keep: list[Column], text_col: str = "text", name: str = "score") -> DataFrame:
    """The columns ``keep`` and ``name``, the score, for each row, without a shuffle; only the weights are broadcast.

    Null and empty texts have the score of the bias alone.
    """
    spark = docs.sparkSession
    tune(spark)
    weights = spark.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_scored_text"))
    schema = rows.drop("_scored_text").schema
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, hasher = weights.value.dense(), Hasher(weights.value.kind)
        bias = float(w[-1])
        for batch in batches:
            sums = np.array([bias + float(w[hasher(t)].sum(dtype=np.float64)) for t in batch.column(len(names)).to_pylist()])
            scores = 1.0 / (1.0 + np.exp(-np.clip(sums, -35, 35)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(scores, pa.float64())], names=[*names, name])

    return rows.mapInArrow(trimmed(run), schema.add(name, "double"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 4, fold: int = 2, kind: Features = Features(), rates: Rates = Rates(), most_rows: int = 16_000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each document.

    Learns only from labels of ids whose crc32 modulo ``folds`` isn't ``fold``.  Repeated rows give repeated rows, a
    null id is kept, an empty table gives an empty result; other columns than the id and the text are not looked at.
    """
    model = fit(docs, labels.filter(crc_mod(F.col("doc_id"), folds) != fold), kind, rates, most_rows)
    doc_id = F.col("doc_id").cast("long")
    scored = score(docs, model, [doc_id.alias("doc_id"), (crc_mod(doc_id, folds) == fold).alias("held_out")])
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

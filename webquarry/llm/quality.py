"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages; only the document has a label.  Every passage is encoded from what its bytes and words
look like, gated attention weights passages against each other, and the weighted mean of the encoded passages is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import trimmed, tune
from .shingles import Words, mix
from .toxicity import crc_mod

_CLASSES = 16


def _classes() -> np.ndarray:
    """One of 16 kinds for each byte."""
    kinds = [range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), b" \t", b"\n\r\x0b\x0c", b".", b",;:", b"!", b"?", b"'\"()[]{}", b"|", range(0x21, 0x7F), range(0xC0, 0x100), range(0x80, 0xC0), range(256)]
    out = np.zeros(256, dtype=np.int32)
    for k in reversed(range(len(kinds))):
        out[list(kinds[k])] = k + 1
    return out


_CLASS = _classes()
_UPPER, _MARKS = 2, [8, 11, 12]
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Features of the words of a passage, after the shares of pairs of byte kinds.
WORD_FEATURES = 7
FEATURES = _CLASSES * _CLASSES + WORD_FEATURES
#: Bytes that are encoded at once; longer texts are cut at white space into pieces of at most so many.
PIECE = 1 << 19


@dataclass(frozen=True)
class Bags:
    """Passages are the lines of a text, cut after every ``words`` words."""

    words: int = 48


def pieces(text: bytes, most: int = PIECE) -> list[bytes]:
    """A long text cut at white space; a piece without any is cut where it is full."""
    out, at = [], 0
    while len(text) - at > most:
        end = max(text.rfind(b"\n", at, at + most), text.rfind(b" ", at, at + most)) + 1
        end = end if end > at else at + most
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def encode(texts: list[bytes], bags: Bags, hashes: Words) -> tuple[np.ndarray, np.ndarray]:
    """The features of all passages of some texts, and the number of passages of each; a text without words is one passage
    without features."""
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n = len(data)
    word = ~_SPACE[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    starts = np.flatnonzero(word & (first[:-1] | np.concatenate([[True], ~word[:-1]]))) if n else np.empty(0, np.int64)
    ends = np.flatnonzero(word & (first[1:] | np.concatenate([~word[1:], [True]]))) + 1 if n else np.empty(0, np.int64)
    if not len(starts):
        return np.zeros((len(texts), FEATURES), dtype=np.float32), np.ones(len(texts), dtype=np.int64)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    line = np.cumsum(data == 10)[starts]
    opens = np.concatenate([[True], (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])])
    at = np.arange(len(starts))
    opens |= (at - np.maximum.accumulate(np.where(opens, at, 0))) % bags.words == 0
    passage = np.cumsum(opens) - 1
    heads = np.flatnonzero(opens)
    tails = np.append(heads[1:], len(starts)) - 1
    count = (tails - heads + 1).astype(np.float64)
    made = len(heads)
    # Pairs of neighbouring bytes within a passage, by their kinds.
    inside = np.zeros(n + 1, dtype=np.int64)
    np.add.at(inside, starts[heads], 1)
    np.add.at(inside, ends[tails], -1)
    inside = np.cumsum(inside[:-1]).astype(bool)
    of = np.zeros(n, dtype=np.int64)
    of[starts[heads]] = 1
    of = np.cumsum(of) - 1
    kind = _CLASS[data]
    both = np.flatnonzero(inside[:-1] & inside[1:] & (of[:-1] == of[1:]))
    shares = np.bincount(of[both] * (_CLASSES * _CLASSES) + kind[both] * _CLASSES + kind[both + 1], minlength=made * _CLASSES * _CLASSES).reshape(made, -1)
    shares = shares / np.maximum(1, shares.sum(axis=1, keepdims=True))
    own = np.concatenate(list(hashes(pa.array(texts, pa.binary()))))
    again = np.concatenate([[False], (own[1:] == own[:-1]) & (passage[1:] == passage[:-1])])
    _, distinct = np.unique(mix(own + mix(passage.astype(np.uint64))), return_index=True)
    length = (ends - starts).astype(np.float64)
    total = lambda x: np.bincount(passage, weights=x, minlength=made) / count
    mean = total(length)
    words = np.stack([
        np.log1p(count), np.log1p(mean), np.sqrt(np.maximum(0, total(length * length) - mean * mean)) / np.maximum(1, mean),
        total(again.astype(np.float64)), np.bincount(passage[distinct], minlength=made) / count,
        total((kind[starts] == _UPPER).astype(np.float64)), total(np.isin(kind[ends - 1], _MARKS).astype(np.float64)),
    ], axis=1)
    found = np.concatenate([np.sqrt(shares), words], axis=1).astype(np.float32)
    each = np.bincount(doc[heads], minlength=len(texts))
    if (each > 0).all():
        return found, each
    filled = np.zeros((made + int((each == 0).sum()), FEATURES), dtype=np.float32)
    each = np.maximum(each, 1)
    keep = np.ones(len(filled), dtype=bool)
    keep[(np.cumsum(each) - each)[np.bincount(doc[heads], minlength=len(texts)) == 0]] = False
    filled[keep] = found
    return filled, each


@dataclass(frozen=True)
class Training:
    """Sizes and rates of a fit; ``most_rows`` labelled documents of at most ``most_passages`` passages each are learned from."""

    hidden: int = 24
    attention: int = 12
    passes: int = 14
    bag_batch: int = 64
    rate: float = 0.01
    decay: float = 1e-4
    most_rows: int = 4000
    most_passages: int = 96


class Attention:
    """The network: encoder tanh(x W + b), gated attention, a logistic score of the weighted mean of a bag."""

    NAMES = ("mean", "scale", "w", "b", "v", "u", "a", "c", "d")

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def start(cls, x: np.ndarray, kind: Training) -> Attention:
        rng = np.random.default_rng(7)
        draw = lambda n, m: rng.normal(size=(n, m)) / np.sqrt(n)
        mean = x.mean(axis=0, dtype=np.float64)
        scale = np.maximum(x.std(axis=0, dtype=np.float64), 1e-3)
        return cls({"mean": mean, "scale": scale, "w": draw(x.shape[1], kind.hidden), "b": np.zeros(kind.hidden), "v": draw(kind.hidden, kind.attention), "u": draw(kind.hidden, kind.attention), "a": draw(kind.attention, 1)[:, 0], "c": draw(kind.hidden, 1)[:, 0], "d": np.zeros(1)})

    def encoded(self, x: np.ndarray) -> np.ndarray:
        p = self.p
        z = np.clip((x - p["mean"]) / p["scale"], -8, 8)
        return np.tanh(z @ p["w"] + p["b"])

    def gates(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, g = np.tanh(h @ self.p["v"]), 1 / (1 + np.exp(-h @ self.p["u"]))
        return t, g, (t * g) @ self.p["a"]

    def pooled(self, x: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each bag: sum of weighted encoded passages, sum of weights.  Attention is bounded by the sum of |a|, so that
        weights need no common maximum and bags in pieces can be added up."""
        h = self.encoded(x)
        weight = np.exp(self.gates(h)[2])
        at = np.cumsum(each) - each
        return np.add.reduceat(h * weight[:, None], at, axis=0), np.add.reduceat(weight, at)

    def scores(self, sums: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(sums / weights[:, None] @ self.p["c"] + self.p["d"][0], -35, 35)))

    def gradients(self, x: np.ndarray, each: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, at = self.p, np.cumsum(each) - each
        z = np.clip((x - p["mean"]) / p["scale"], -8, 8)
        h = np.tanh(z @ p["w"] + p["b"])
        t, g, s = self.gates(h)
        weight = np.exp(s)
        bag = np.repeat(np.arange(len(each)), each)
        share = weight / np.add.reduceat(weight, at)[bag]
        m = np.add.reduceat(h * share[:, None], at, axis=0)
        error = (1 / (1 + np.exp(-np.clip(m @ p["c"] + p["d"][0], -35, 35))) - y) / len(y)
        dm = error[:, None] * p["c"]
        ds = share * ((h - m[bag]) * dm[bag]).sum(axis=1)
        dt, dg = ds[:, None] * p["a"] * g * (1 - t * t), ds[:, None] * p["a"] * t * g * (1 - g)
        dh = (share[:, None] * dm[bag] + dt @ p["v"].T + dg @ p["u"].T) * (1 - h * h)
        return {"w": z.T @ dh, "b": dh.sum(axis=0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ ds, "c": m.T @ error, "d": np.array([error.sum()])}


def train(bags: list[np.ndarray], labels: np.ndarray, kind: Training) -> Attention:
    """Adam over batches of bags, with decaying rates; the same bags and order give the same network."""
    each = np.array([len(x) for x in bags])
    x = np.concatenate(bags).astype(np.float32)
    model, at = Attention.start(x, kind), np.cumsum(each) - each
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    step, steps = 0, kind.passes * -(-len(bags) // kind.bag_batch)
    for n in range(kind.passes):
        order = np.random.default_rng(n).permutation(len(bags))
        for k in range(0, len(order), kind.bag_batch):
            chosen = order[k : k + kind.bag_batch]
            rows = np.concatenate([np.arange(at[i], at[i] + each[i]) for i in chosen])
            step += 1
            rate = kind.rate * (1 - (step - 1) / steps)
            for name, gradient in model.gradients(x[rows], each[chosen], labels[chosen]).items():
                gradient = gradient + kind.decay * model.p[name] * (name in "wvu")
                one, two = moments[name]
                one += 0.1 * (gradient - one)
                two += 0.001 * (gradient * gradient - two)
                model.p[name] = model.p[name] - rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
    return model


def _encoded_batches(batch: pa.RecordBatch, column: int, bags: Bags, hashes: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each bag, features, passages of each bag) over the texts of a batch; a long text is several bags of one row."""
    rows: list[int] = []
    held: list[bytes] = []
    size = 0
    for k, text in enumerate(batch.column(column).to_pylist()):
        for piece in pieces(text or b""):
            if held and size + len(piece) > PIECE:
                yield np.array(rows), *encode(held, bags, hashes)
                rows, held, size = [], [], 0
            rows.append(k)
            held.append(piece)
            size += len(piece)
    if held:
        yield np.array(rows), *encode(held, bags, hashes)


def fit(docs: DataFrame, labels: DataFrame, bags: Bags = Bags(), kind: Training = Training(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Attention | None:
    """Learns from labelled documents (id and 0/1 label); None without any.

    Beyond ``most_rows`` labels those with the smallest hashes of their ids are taken; documents of more than
    ``most_passages`` passages are not learned from.  So the training set, its one task and the broadcast ids are bounded at any
    input size.  Rows without id, label or document are left out; of an id with several labels the greatest
    counts, of one with several texts the least.
    """
    tune(docs.sparkSession)
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(kind.most_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))
    rows = texts.join(F.broadcast(known), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.first("_label").alias("_label"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Words()
        for batch in batches:
            parts: dict[int, list[np.ndarray]] = {}
            for of, x, each in _encoded_batches(batch, 1, bags, hashes):
                for k, own in zip(of.tolist(), np.split(x, np.cumsum(each)[:-1]), strict=True):
                    parts.setdefault(k, []).append(own)
            kept = {k: np.concatenate(v) for k, v in parts.items() if sum(map(len, v)) <= kind.most_passages}
            at = pa.array(list(kept), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array([v.astype("<f4").tobytes() for v in kept.values()], pa.binary())], names=["id", "label", "bag"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = {i: (y, np.frombuffer(x, dtype="<f4").reshape(-1, FEATURES)) for b in batches for i, y, x in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)}
        if rows:
            order = sorted(rows)
            model = train([rows[i][1] for i in order], np.array([rows[i][0] for i in order], dtype=np.float64), kind)
            values = [model.p[k] for k in Attention.NAMES]
            yield pa.RecordBatch.from_arrays([pa.array(Attention.NAMES), pa.array([list(v.shape) for v in values], pa.list_(pa.int32())), pa.array([v.ravel().tolist() for v in values], pa.list_(pa.float64()))], names=["name", "shape", "value"])

    bagged = rows.mapInArrow(trimmed(features), "id long, label int, bag binary").repartition(1)
    found = bagged.mapInArrow(trimmed(learn), "name string, shape array<int>, value array<double>").collect()
    return Attention({r.name: np.array(r.value).reshape(r.shape) for r in found}) if found else None


def score(docs: DataFrame, model: Attention | None, keep: list[Column], bags: Bags = Bags(), text_col: str = "text", name: str = "score") -> DataFrame:
    """The columns ``keep`` and ``name``, the score, for each row, without a shuffle; the weights, a few thousand numbers, are broadcast.

    Null and empty texts and texts without words are a passage without features; without a model all scores are 0.5.
    """
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_scored_text"))
    schema = rows.drop("_scored_text").schema
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, hashes = shared.value, Words()
        for batch in batches:
            scores = np.full(len(batch), 0.5)
            if net is not None and len(batch):
                sums, weights = np.zeros((len(batch), len(net.p["c"]))), np.zeros(len(batch))
                for of, x, each in _encoded_batches(batch, len(names), bags, hashes):
                    own, weight = net.pooled(x, each)
                    np.add.at(sums, of, own)
                    np.add.at(weights, of, weight)
                scores = net.scores(sums, weights)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(scores)], names=[*names, name])

    return rows.mapInArrow(trimmed(run), schema.add(name, "double"))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, fold: int = 0, bags: Bags = Bags(), kind: Training = Training()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each document.

    Learns only from labels of ids whose crc32 modulo ``folds`` isn't ``fold``.  Repeated rows give repeated rows, a null id
    is kept, an empty table gives an empty result, an empty label table scores of 0.5 and so ``predicted`` 1 everywhere; other columns than the id and the text are not looked at.
    """
    model = fit(docs, labels.filter(crc_mod(F.col("doc_id"), folds) != fold), bags, kind)
    doc_id = F.col("doc_id").cast("long")
    scored = score(docs, model, [doc_id.alias("doc_id"), (crc_mod(doc_id, folds) == fold).alias("held_out")], bags)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

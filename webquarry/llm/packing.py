"""Vector best-fit packing of tokenized documents into training sequences."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .session import keeps, trimmed, tune

#: Documents of one packing shard, about.  Each shard wastes part of a sequence at most, so more would gain nothing.
SHARD_DOCUMENTS = 4096


@dataclass(frozen=True)
class Capacity:
    """What one sequence can hold: tokens, documents, and attention cost (the sum of squared piece lengths)."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], dtype=np.float64)


#: Parts of texts of these characters alone aren't changed by the tokenizer's normalizer but for their case.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


class _Ids:
    """Token ids of texts as little-endian bytes, through a bounded memory of parts between white space and of their words."""

    def __init__(self, path: str, cache_size: int = 600_000):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.no_padding()
        self.encoder.no_truncation()
        self.shown = {b: c for b, c in enumerate(bpe.byte_symbols()) if chr(b) != c}
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.cache_size = cache_size

    def _merge(self, word: str) -> bytes:
        """Ids of a word that is normalized and split already: only the merges are left to do."""
        symbols = word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(self.shown)
        ids = [t.id for t in self.encoder.model.tokenize(symbols)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _encode(self, parts: list[str]) -> None:
        """Encodes many parts in one call; each is a word of its own to the tokenizer."""
        for at in range(0, len(parts), 4096):
            some = parts[at : at + 4096]
            found = self.encoder.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(found.ids, dtype="<u4").tobytes()
            ends = np.searchsorted(np.array(found.word_ids, dtype=np.int64), np.arange(len(some)), side="right") * 4
            start = 0
            for c, end in zip(some, ends.tolist(), strict=True):
                self.known[c] = ids[start:end]
                start = end

    def _learn(self, missing: set[str]) -> None:
        known, words, plain = self.known, self.words, _PLAIN.fullmatch
        if len(words) > self.cache_size // 2:
            words.clear()
        other = []
        for c in missing:
            if not plain(c) or "<|" in c:
                other.append(c)
                continue
            ids = b""
            for w in bpe.split_plain(c.lower()):
                b = words.get(w)
                if b is None:
                    b = words[w] = self._merge(w)
                ids += b
            known[c] = ids
        self._encode(other)

    def __call__(self, texts: list[str]) -> list[bytes]:
        get, found, holes, missing = self.known.get, [], [], set()
        for text in texts:
            parts = bpe.chunks(text)
            ids = list(map(get, parts))
            found.append(ids)
            at = -1
            try:
                while True:
                    at = ids.index(None, at + 1)
                    missing.add(parts[at])
                    holes.append((ids, at, parts[at]))
            except ValueError:
                pass
        if missing:
            if len(self.known) + len(missing) > self.cache_size:  # only what this batch uses is kept
                self.known = {c: b for text, ids in zip(texts, found, strict=True) for c, b in zip(bpe.chunks(text), ids, strict=True) if b is not None}
            self._learn(missing)
            for ids, at, part in holes:
                ids[at] = self.known[part]
        return [b"".join(ids) for ids in found]


_encoders: dict[str, _Ids] = {}
keeps(__name__, _encoders.clear)


def _ids(path: str) -> _Ids:
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = _Ids(path)
    return _encoders[path]


def pieces(docs: DataFrame, vocabulary: str, tokens: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as pieces: ``doc_id, piece, start, length, ids_crc32, row``.

    A document is its ids and then ``end_id``; one longer than ``tokens`` is cut there, and only such a one.  A null
    text is the empty one, of a single id.  ``row`` tells repeated rows apart.
    """
    tune(docs.sparkSession)
    schema = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"
    shape = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = np.uint32(end_id).astype("<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _ids(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            texts = ["" if x is None else x for x in batch.column("text").to_pylist()]
            for doc, row, ids in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), encode(texts), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * tokens)):
                    part = ids[at : at + 4 * tokens]
                    out.append((doc, row, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out, strict=True), shape.types, strict=True)], schema=shape)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(trimmed(cut), schema)


def best_fit(lengths: np.ndarray, capacity: Capacity = Capacity(), weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, by vector best-fit in order of falling length.

    Each open sequence keeps a residual vector (tokens, documents, attention), as shares of the capacity.  Among the
    sequences in which the piece fits under every constraint, ``norm`` takes the one whose weighted residual after
    the placement is the shortest; ``dot`` the one whose weighted residual has the smallest dot product with the piece
    among equals in tokens.  If none fits, a new one is opened. 
    """
    full = capacity.vector()
    scale, w = 1.0 / full, np.asarray(weights)
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    residual = np.empty((max(16, len(lengths)), 3))
    number = np.empty(len(residual), dtype=np.int64)
    used: list[int] = []
    n_open = 0
    smallest = float(lengths.min()) if len(lengths) else 0.0
    for i in order:
        x = float(lengths[i])
        need = np.array([x, 1.0, x * x])
        if (need > full).any():
            raise ValueError(f"a piece of {x:.0f} tokens fits in no sequence of {capacity}")
        fits = (residual[:n_open] >= need).all(axis=1)
        at = np.flatnonzero(fits)
        if len(at):
            left = (residual[at] - need) * scale
            score = (w * left * left).sum(axis=1) if rule == "norm" else (w * residual[at] * scale * need * scale).sum(axis=1)
            b = at[int(np.argmin(score))]
        else:
            b = n_open
            residual[b] = full
            number[b] = len(used)
            used.append(0)
            n_open += 1
        bins[i] = number[b]
        offsets[i] = used[number[b]]
        used[number[b]] += int(x)
        residual[b] -= need
        if residual[b, 0] < smallest or residual[b, 1] < 1:  # nothing can enter any more: keep the open ones together
            n_open -= 1
            residual[b] = residual[n_open]
            number[b] = number[n_open]
    return bins, offsets


def pack(cut: DataFrame, shards: int, capacity: Capacity = Capacity(), weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a table of pieces.

    Pieces are dealt to ``shards`` by a hash of the row, so that each shard is a fair sample of the lengths, and each
    shard is packed by itself: memory and time of a task don't grow with the input.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def one(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("row", "ascending"), ("piece", "ascending")])
        bins, offsets = best_fit(table.column("length").to_numpy().astype(np.float64), capacity, weights, rule)
        table = table.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        table = table.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins, pa.int64()))
        return table.append_column("offset", pa.array(offsets, pa.int64()))

    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(max(1, shards))))
    return dealt.groupBy("shard").applyInArrow(one, schema)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: Capacity = Capacity(), end_id: int = 0, shard_documents: int = SHARD_DOCUMENTS, id_col: str = "doc_id", text_col: str = "text", weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm") -> DataFrame:
    """Packs whole documents into sequences: one row per piece with ``sequence_id`` and gapless ``offset``.

    Null and empty texts are one piece of one id; a null id is kept; repeated rows are packed each; an empty table
    gives an empty result; extra columns are not looked at.  Ties in length go by id, row and piece.
    """
    shards = -(-docs.count() // shard_documents)
    return pack(pieces(docs, vocabulary, capacity.tokens, end_id, id_col, text_col), shards, capacity, weights, rule)

"""Perplexity of texts under a hierarchical Pitman-Yor model sampled by Gibbs.

The vocabulary is all training words.  A token is seated in the restaurant of its context, the nearest earlier word of
its text that is one of the most frequent words (or the start).  Context restaurants share one parent over classes: each of
the ``dishes`` most frequent words, and the class of all others; that parent rests on a uniform base.  A word of the last
class is then drawn from a Pitman-Yor restaurant over all the other words, with one place for words never seen.

What this table of a fixed greatest size can't hold has restaurants of its own, one for each word that is followed by
another, however rare both are.  After a word that is no context of the table it seats all that follow, and rests on what the
table gives for the token; after one of the table's contexts it seats the words of the last class, and rests on that class.
These restaurants are dealt to tasks by their word.  So every pair of adjacent words counts, every word has a probability,
and the probabilities of all words add up to one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import materialize, trimmed, tune
from .shingles import mix
from .toxicity import crc_mod

#: Counts up to this have a bin of their own.
EXACT_BINS = 64
#: Bins for each doubling of the count beyond.
BINS_PER_DOUBLING = 8
#: Words of the dictionary have this many bytes at most; longer ones are looked up by the join.
WORD_BYTES = 32


@dataclass(frozen=True)
class Shape:
    """Greatest sizes of what is broadcast: context words of the table, classes of their own in it, and words of the
    dictionary; Gibbs sweeps.  The restaurants of all other pairs of words aren't bounded."""

    contexts: int = 511
    dishes: int = 8192
    dictionary: int = 131_072
    burn_in: int = 4
    samples: int = 6
    theta: float = 1.0
    seed: int = 7


def count_bin(c: Column) -> Column:
    """The bin of a count: exact up to EXACT_BINS, then BINS_PER_DOUBLING for each doubling."""
    return F.when(c <= EXACT_BINS, c.cast("int")).otherwise((F.lit(EXACT_BINS) + F.floor(F.log2(c / EXACT_BINS) * BINS_PER_DOUBLING)).cast("int"))


def count_bins(c: np.ndarray) -> np.ndarray:
    c = np.maximum(c, 1)
    return np.where(c <= EXACT_BINS, c, EXACT_BINS + np.floor(np.log2(c / EXACT_BINS) * BINS_PER_DOUBLING)).astype(np.int64)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word`` (binary, lower-case A-Z) and its count ``c`` over all rows; the empty word stands for the end of a text."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            words, numbers = list(counts.keys()), list(counts.values())
            for i in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 50_000], pa.binary()), pa.array(numbers[i : i + 50_000], pa.int64())], names=["word", "c"])
            counts.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update((text or b"").lower().split())
            counts[b""] += batch.num_rows
            if len(counts) > 500_000:
                yield from flush()
        yield from flush()

    return docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(trimmed(run), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def seat(c: np.ndarray, prior: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of one dish after c customers came, for many dishes at once, ``c`` falling.

    ``prior`` is (theta + d T) times the parent's probability of the dish: with t tables so far, customer j + 1 opens
    one more with the probability prior / (prior + j - d t).  Beyond customer 64 growing blocks of customers share
    the probability at their middle, and their tables are drawn together.
    """
    t = np.ones(len(c))
    j = 1
    while True:
        active = int(np.searchsorted(-c, -j, side="left"))
        if not active:
            return t
        steps = 1 if j < 64 else max(1, j // 8)
        a, now = prior[:active], t[:active]
        middle = j + (steps - 1) / 2
        p = a / (a + np.maximum(middle - d * now, 1e-9))
        if steps == 1:
            t[:active] = now + (rng.random(active) < p)
        else:
            t[:active] = now + rng.binomial(np.minimum(steps, c[:active] - j).astype(np.int64), np.clip(p, 0, 1))
        j += steps


def discount(ones: float, twos: float) -> float:
    """The discount that the numbers of things counted once and twice suggest."""
    return float(np.clip(ones / (ones + 2 * twos), 0.05, 0.95)) if ones + twos > 0 else 0.5


def sample_contexts(context: np.ndarray, dish: np.ndarray, c: np.ndarray, n_contexts: int, n_dishes: int, shape: Shape) -> np.ndarray:
    """log10 of the averaged predictive probabilities, contexts by dishes.

    Each sweep seats the tables of all context restaurants as customers of the shared parent, samples the parent's
    tables, and then the tables of each dish in each context given the parent's probabilities.
    """
    rng = np.random.default_rng(shape.seed)
    order = np.argsort(-c, kind="stable")
    context, dish, c = context[order], dish[order], c[order].astype(np.float64)
    d = discount(np.count_nonzero(c == 1), np.count_nonzero(c == 2))
    theta, base = shape.theta, 1.0 / n_dishes
    customers = np.bincount(context, c, n_contexts)
    t = np.ones(len(c))
    mean = np.zeros((n_contexts, n_dishes), dtype=np.float32)
    parent_tables = 1.0
    for sweep in range(shape.burn_in + shape.samples):
        sent = np.bincount(dish, t, n_dishes)
        d_parent = discount(np.count_nonzero(sent == 1), np.count_nonzero(sent == 2))
        by_size = np.argsort(-sent, kind="stable")
        some = by_size[: np.count_nonzero(sent)]
        s = np.zeros(n_dishes)
        if len(some):
            s[some] = seat(sent[some], np.full(len(some), (theta + d_parent * parent_tables) * base), d_parent, rng)
        parent_tables = max(1.0, s.sum())
        parent = (sent - d_parent * s + (theta + d_parent * s.sum()) * base) / (theta + sent.sum())
        tables = np.bincount(context, t, n_contexts)
        if len(c):
            t = seat(c, (theta + d * tables[context]) * parent[dish], d, rng)
        if sweep >= shape.burn_in:
            tables = np.bincount(context, t, n_contexts)
            share = (theta + d * tables) / (theta + customers)
            for u in range(n_contexts):
                mean[u] += (share[u] * parent).astype(np.float32)
            np.add.at(mean.reshape(-1), context * n_dishes + dish, ((c - d * t) / (theta + customers[context])).astype(np.float32))
    return np.log10(mean / shape.samples)


def sample_tail(bins: dict[int, tuple[int, int]], shape: Shape) -> tuple[np.ndarray, float]:
    """For each bin of counts the averaged tables for each customer, and (averaged) what else the probability needs.

    ``bins``: types and tokens of each bin of counts.  The probability of a word with count c is
    (c (1 - d r) + rest) / total, with r the first result at the bin of c.  Returns ([1 - d r for each bin], rest) / total.
    """
    rng = np.random.default_rng(shape.seed + 1)
    top = max(bins, default=0)
    keep, rest = np.zeros(top + 1), 0.0
    types, tokens = sum(n for n, _ in bins.values()), sum(s for _, s in bins.values())
    d = discount(bins.get(1, (0, 0))[0], bins.get(2, (0, 0))[0])
    base, total = 1.0 / (types + 1), shape.theta + tokens
    tables = float(types)
    for sweep in range(shape.burn_in + shape.samples):
        prior = (shape.theta + d * tables) * base
        ratio = np.zeros(top + 1)
        for b, (n, s) in bins.items():
            c = s / n
            drawn = seat(np.full(min(n, 512), max(1.0, round(c))), np.full(min(n, 512), prior), d, rng)
            ratio[b] = min(1.0, drawn.mean() / c)
        tables = sum(ratio[b] * s for b, (_, s) in bins.items())
        if sweep >= shape.burn_in:
            keep += (1 - d * ratio) / total
            rest += (shape.theta + d * tables) * base / total
    return keep / shape.samples, rest / shape.samples


def sample_restaurants(context: np.ndarray, c: np.ndarray, prior: np.ndarray, n_contexts: int, shape: Shape, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Averaged over sweeps: what each cell's own customers give to its probability, and each context's share for its parent.

    ``prior``: the parent's probability of the cell.  A word of the cell has the first result plus the second one times the
    parent's probability; in a context without customers the parent has all.
    """
    rng = np.random.default_rng([shape.seed + 2, seed])
    order = np.argsort(-c, kind="stable")
    context, c, prior = context[order], c[order].astype(np.float64), prior[order]
    d = discount(np.count_nonzero(c == 1), np.count_nonzero(c == 2))
    total = shape.theta + np.bincount(context, c, n_contexts)
    several = int(np.searchsorted(-c, -1, side="left"))  # a single customer has one table
    t = np.ones(len(c))
    kept, tables = np.zeros(len(c)), np.zeros(n_contexts)
    for sweep in range(shape.burn_in + shape.samples):
        sent = np.bincount(context, t, n_contexts)
        if several:
            t[:several] = seat(c[:several], (shape.theta + d * sent[context[:several]]) * prior[:several], d, rng)
        if sweep >= shape.burn_in:
            kept += t
            tables += np.bincount(context, t, n_contexts)
    own = np.empty(len(c))
    own[order] = (c - d * kept / shape.samples) / total[context]
    return own, (shape.theta + d * tables / shape.samples) / total


@dataclass
class _Dictionary:
    """The frequent words with their counts; the first ``dishes`` are classes, the first ``contexts`` of those contexts."""

    words: list[bytes]
    counts: np.ndarray
    contexts: int
    dishes: int

    def __post_init__(self) -> None:
        self.place = {w: i for i, w in enumerate(self.words)}

    def read(self, texts: list[bytes | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
        """Of a batch: words of each text, places of all tokens with the ends (-1: not here), contexts, first tokens."""
        parts = [(x or b"").lower().split() for x in texts]
        get, end = self.place.get, self.place.get(b"", -1)
        sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        places = np.empty(int(sizes.sum()), dtype=np.int64)
        for at, p in zip(starts.tolist(), parts, strict=True):
            places[at : at + len(p)] = [get(w, -1) for w in p]
        places[starts + sizes - 1] = end
        # The nearest earlier context word of the same text.
        n = len(places)
        usable = (places >= 0) & (places < self.contexts)
        usable[starts + sizes - 1] = False
        seen = np.maximum.accumulate(np.where(usable, np.arange(n), -1))
        before = np.concatenate([[-1], seen[:-1]])
        own = np.repeat(starts, sizes)
        context = np.where(before >= own, places[before], self.contexts)
        return parts, places, context, starts


    def pairs(self, places: np.ndarray, starts: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token the number of the word before it (of the start), whether the table has that word as a context,
        and whether the table has the token's own cell there.  ``numbers``: those of the tokens themselves."""
        before, place = np.concatenate([numbers[:1], numbers[:-1]]), np.concatenate([[-1], places[:-1]])
        before[starts] = 1
        framed = (place >= 0) & (place < self.contexts)
        framed[starts] = True
        return before, framed, framed & (places >= 0) & (places < self.dishes)


def _numbers(places: np.ndarray, rare: list[bytes]) -> np.ndarray:
    """Numbers of words: 2 and the place of those of the dictionary, a 64-bit hash of others (``rare``, in order)."""
    out = places + 2
    hashes: dict[bytes, bytes] = {w: blake2b(w, digest_size=8).digest() for w in set(rare)}
    out[places < 0] = np.frombuffer(b"".join([hashes[w] for w in rare]), dtype="<i8")
    return out


def _rare(parts: list[list[bytes]], places: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """The words without a place, in order."""
    at = np.flatnonzero(places < 0)
    text = np.searchsorted(starts, at, side="right") - 1
    return [parts[k][i] if i < len(parts[k]) else b"" for k, i in zip(text.tolist(), (at - starts[text]).tolist(), strict=True)]


@dataclass
class _Tail:
    """The averaged probabilities of the words of the last class in it, and log10 of the base model."""

    keep: np.ndarray
    rest: float
    z: float

    def __call__(self, c: np.ndarray) -> np.ndarray:
        keeps = np.concatenate([self.keep, [0.0]])
        return c * keeps[np.minimum(count_bins(c), len(keeps) - 1)] + self.rest

    def of(self, words: _Dictionary) -> np.ndarray:
        """For each word of the dictionary; 1 for the classes and, last, for other words."""
        return np.concatenate([np.ones(words.dishes), self(words.counts[words.dishes :]), [1.0]])

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / self.z)


#: Tokens that are packed together; and by how many times more numbers than there are partitions restaurants are dealt.
PACKED = 1_000_000
SPREAD = 8


def pack_tokens(row: np.ndarray, before: np.ndarray, token: np.ndarray, context: np.ndarray) -> bytes:
    """Tokens as bytes, sorted by ``before``, byte by byte of all numbers, compressed.  Rows are of one task, tokens of the dictionary."""
    by = np.argsort(before, kind="stable")
    first = np.array([len(row), row.min(), before[by[0]]], dtype="<i8")
    columns = [(row[by] - first[1]).astype("<u4"), np.diff(before[by], prepend=first[2:]).astype("<u8"), token[by].astype("<u4"), context[by].astype("<i2")]
    planes = b"".join(x.view(np.uint8).reshape(len(x), -1).T.tobytes() for x in columns)
    return first.tobytes() + pa.compress(planes, codec="zstd", asbytes=True)


def unpack_tokens(packed: bytes) -> tuple[np.ndarray, ...]:
    n, row, before = np.frombuffer(packed, dtype="<i8", count=3).tolist()
    planes = np.frombuffer(pa.decompress(packed[24:], decompressed_size=18 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    row_, before_, token, context = (np.ascontiguousarray(planes[a * n : b * n].reshape(b - a, n).T).view(t)[:, 0] for a, b, t in ((0, 4, "<u4"), (4, 12, "<i8"), (12, 16, "<u4"), (16, 18, "<i2")))
    return row_.astype(np.int64) + row, np.cumsum(before_) + before, token.astype(np.int64), context, np.full(n, -1, dtype=np.int64)


def pack_sums(row: np.ndarray, known: np.ndarray, base: np.ndarray, score: np.ndarray) -> bytes:
    """Rows (rising) and what is added to their sums as bytes, compressed."""
    columns = [np.diff(row, prepend=0).astype("<i8"), known.astype("<i8"), base.astype("<f8"), score.astype("<f8")]
    planes = b"".join(x.view(np.uint8).reshape(len(x), 8).T.tobytes() for x in columns)
    return np.array([len(row)], dtype="<i8").tobytes() + pa.compress(planes, codec="zstd", asbytes=True)


def unpack_sums(packed: bytes) -> tuple[np.ndarray, ...]:
    n = int(np.frombuffer(packed, dtype="<i8", count=1)[0])
    planes = np.frombuffer(pa.decompress(packed[8:], decompressed_size=32 * n, codec="zstd", asbytes=True), dtype=np.uint8).reshape(4, 8, n)
    row, known, base, score = (np.ascontiguousarray(x.T).view(t)[:, 0] for x, t in zip(planes, ("<i8", "<i8", "<f8", "<f8"), strict=True))
    return np.cumsum(row), known, base, score


_SUMS = ["n_tokens", "n_known", "base", "score"]
_TEXT = "doc_id long, n_tokens long, n_known long, base double, score double"


def seated(cells: DataFrame, shared: Broadcast, tail: _Tail, parts: int, shape: Shape) -> DataFrame:
    """``row, doc_id`` and sums of ``_SUMS``, from ``row`` (twice the number, and 1 if it is learned from), ``before, token, context, c, text,
    packed, part``; ``packed`` holds many rows of one ``part``, by which restaurants are dealt.

    Rows without ``before`` are texts with what is known of them.  The others are tokens of that restaurant: those learned from
    are its customers, and the score of each is raised or lowered by what the restaurant says beyond its parent's
    probability.  ``context`` is the token's context in the table (-1: the parent is the last class alone), ``c`` the count
    of a word that the dictionary hasn't, else null.

    A text has tokens in many parts.  What a task adds to its texts goes on packed, a row for each task that sums it up.
    """
    names = ["row", "doc_id", *_SUMS, "to", "packed"]

    def to(row: np.ndarray) -> np.ndarray:
        return (mix(row.astype(np.uint64)) % np.uint64(parts)).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes | tuple[np.ndarray, ...]]] = {}
        for batch in batches:
            packed = batch.filter(batch.column(6).is_valid())
            for k, x in zip(packed.column(7).to_pylist(), packed.column(6).to_pylist(), strict=True):
                held.setdefault(k, []).append(x)
            batch = batch.filter(batch.column(6).is_null())
            none = batch.column(1).is_null()
            if batch.column(1).null_count:
                texts = batch.filter(none)
                row = texts.column(0).to_numpy() >> 1
                yield pa.RecordBatch.from_arrays([pa.array(row), *texts.column(5).flatten(), pa.array(to(row)), pa.nulls(len(row), pa.binary())], names=names)
            if batch.column(1).null_count < batch.num_rows:
                some = batch.filter(pa.compute.invert(none))
                of, columns = some.column(7).to_numpy(), [some.column(k).fill_null(-1).to_numpy() for k in range(5)]
                by = np.argsort(of, kind="stable")
                for at in np.split(by, np.flatnonzero(np.diff(of[by])) + 1):
                    held.setdefault(int(of[at[0]]), []).append(tuple(x[at] for x in columns))
        if not held:
            return
        known, logs = shared.value
        tails = tail.of(known)

        def scored(parts: list[bytes | tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
            """Of the restaurants of a part: row and score of each token, and row, whether known, and base of the looked-up ones."""
            row, before, token, frame, count = (np.concatenate(x) for x in zip(*(unpack_tokens(x) if isinstance(x, bytes) else x for x in parts), strict=True))
            by = np.lexsort((token, before))
            row, before, token, frame, count = (x[by] for x in (row, before, token, frame, count))
            place = np.where(count < 0, token - 2, len(known.words))
            prior, score = tails[place], np.zeros(len(row))
            rare = np.flatnonzero(count >= 0)
            prior[rare] = tail(count[rare].astype(np.float64))
            score[rare] = np.log10(prior[rare])
            wide = np.flatnonzero(frame >= 0)
            prior[wide] *= 10.0 ** logs[frame[wide], np.minimum(place[wide], known.dishes)].astype(np.float64)
            train = (row & 1).astype(np.float64)
            restaurant = np.cumsum(np.concatenate([[False], before[1:] != before[:-1]]))
            cell = np.cumsum(np.concatenate([[False], (before[1:] != before[:-1]) | (token[1:] != token[:-1])]))
            of = np.zeros(cell[-1] + 1, dtype=np.int64)
            of[cell] = restaurant
            c = np.bincount(cell, train)
            seen = np.flatnonzero(c)
            own = np.zeros(len(c))
            own[seen], share = sample_restaurants(of[seen], c[seen], np.bincount(cell, train * prior)[seen] / c[seen], int(restaurant[-1]) + 1, shape, int(before[0]) & 0xFFFFFFFF)
            return row >> 1, score + np.log10(own[cell] / prior + share[restaurant]), row[rare] >> 1, count[rare] > 0, tail.base(count[rare])

        # Part by part, so that what a task holds at once stays small.
        made = [scored(held.pop(k)) for k in sorted(held)]
        row, score, rare, met, base = (np.concatenate(x) for x in zip(*made, strict=True))
        made.clear()
        rows, at = np.unique(row, return_inverse=True)
        of = np.searchsorted(rows, rare)
        sums = [np.bincount(of, met, len(rows)).astype(np.int64), np.bincount(of, base, len(rows)).astype(np.float64), np.bincount(at, score)]
        goal = to(rows)
        by = np.argsort(goal, kind="stable")
        cuts = [0, *(np.flatnonzero(np.diff(goal[by])) + 1).tolist(), len(by)]
        packed = [pack_sums(*(x[by[lo:hi]] for x in (rows, *sums))) for lo, hi in zip(cuts, cuts[1:])]
        n = len(packed)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(n, pa.int64())] * 4, *[pa.nulls(n, pa.float64())] * 2, pa.array(goal[by[cuts[:-1]]]), pa.array(packed, pa.binary())], names=names)

    out = cells.repartition(parts, "part").mapInArrow(trimmed(run), f"row long, {_TEXT}, to int, packed binary")
    return out.repartition(parts, "to").mapInArrow(trimmed(summed), f"row long, {_TEXT}")


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``row, doc_id`` and sums of ``_SUMS`` from a row for each text and packed rows with what is added to them."""
    texts, added = [], []
    for batch in batches:
        packed = batch.column(7).is_valid()
        added += [unpack_sums(x) for x in batch.filter(packed).column(7).to_pylist()]
        texts.append(batch.filter(pa.compute.invert(packed)).select(range(6)))
    if not texts:
        return
    table = pa.Table.from_batches(texts).sort_by("row").combine_chunks()
    if not table.num_rows:
        return
    values = [table.column(k).to_numpy() for k in range(6)]
    if added:
        row, *sums = (np.concatenate(x) for x in zip(*added, strict=True))
        at = np.searchsorted(values[0], row)
        for k, x in zip((3, 4, 5), sums, strict=True):
            values[k] = values[k] + np.bincount(at, x, table.num_rows).astype(values[k].dtype)
    columns = [table.column(k).combine_chunks() if k < 3 else pa.array(values[k]) for k in range(6)]
    yield from pa.table([x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in columns], names=["row", "doc_id", *_SUMS]).to_batches(max_chunksize=50_000)


def context_counts(docs: DataFrame, words: _Dictionary, text_col: str = "text") -> DataFrame:
    """``cell`` (context times classes plus class) and its count, over all rows."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(words)
    n_dishes = words.dishes + 1
    cells = (words.contexts + 1) * n_dishes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells, dtype=np.int64)
        for batch in batches:
            _, places, context, _ = shared.value.read(batch.column(0).to_pylist())
            dish = np.where((places < 0) | (places >= n_dishes - 1), n_dishes - 1, places)
            counts += np.bincount(context * n_dishes + dish, minlength=cells)
        at = np.flatnonzero(counts)
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 100_000].astype(np.int32), pa.int32()), pa.array(counts[at[i : i + 100_000]], pa.int64())], names=["cell", "c"])

    return docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(trimmed(run), "cell int, c long").groupBy("cell").agg(F.sum("c").alias("c"))


def perplexity(docs: DataFrame, folds: int = 10, fold: int = 0, shape: Shape = Shape(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base and model scores of every document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from the rows whose id's crc32 modulo ``folds`` isn't ``fold``.  Null and empty texts have the end alone; a
    null id counts as the empty text for the fold; repeated rows are counted and returned each; an empty table gives
    an empty result; other columns are not looked at.  The perplexity of a text is 10 ** (-score / n_tokens).
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    training = rows.filter(crc_mod(F.col("doc_id"), folds) != fold)
    counts = materialize(word_counts(training), "lm-counts")
    found = {r.bin: (r.n, r.s) for r in counts.groupBy(count_bin(F.col("c")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("s")).collect()}
    total, distinct = sum(s for _, s in found.values()), sum(n for n, _ in found.values())

    # The dictionary: all words whose counts are in the highest bins, as many as fit.
    least, room = max(found, default=0) + 1, shape.dictionary
    while least > 1 and room >= found.get(least - 1, (0, 0))[0]:
        least -= 1
        room -= found.get(least, (0, 0))[0]
    top = counts.filter((count_bin(F.col("c")) >= least) & (F.octet_length("word") <= WORD_BYTES)).collect()
    top.sort(key=lambda r: (-r.c, bytes(r.word)))
    words = [bytes(r.word) for r in top]
    numbers = np.array([r.c for r in top], dtype=np.float64)
    if b"" in words[shape.dishes :]:  # the end of a text always is a class of its own
        at = words.index(b"")
        words.insert(0, words.pop(at))
        numbers = np.concatenate([numbers[at : at + 1], np.delete(numbers, at)])
    dishes = min(shape.dishes, len(words))
    dictionary = _Dictionary(words, numbers, min(shape.contexts, dishes), dishes)
    n_dishes, n_contexts = dishes + 1, dictionary.contexts + 1

    tail = {b: list(x) for b, x in found.items()}
    for b, c in zip(count_bins(numbers[:dishes]).tolist(), numbers[:dishes].tolist(), strict=True):
        tail[b][0] -= 1
        tail[b][1] -= int(c)
    keep, rest = sample_tail({b: (n, s) for b, (n, s) in tail.items() if n > 0}, shape)

    def gibbs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, c = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for batch in batches:
            cells.append(batch.column(0).to_numpy().astype(np.int64))
            c.append(batch.column(1).to_numpy())
        cell, c = np.concatenate(cells), np.concatenate(c)
        by = np.argsort(cell)
        logs = sample_contexts(cell[by] // n_dishes, cell[by] % n_dishes, c[by], n_contexts, n_dishes, shape)
        for u in range(n_contexts):
            yield pa.RecordBatch.from_arrays([pa.array([u], pa.int32()), pa.array([logs[u].astype("<f4").tobytes()], pa.binary())], names=["context", "logs"])

    # One task samples: it reads a row for each cell of a table whose size is fixed.
    table = np.zeros((n_contexts, n_dishes), dtype=np.float32)
    for r in context_counts(training, dictionary).repartition(1).mapInArrow(trimmed(gibbs), "context int, logs binary").collect():
        table[r.context] = np.frombuffer(r.logs, dtype="<f4")
    shared = spark.sparkContext.broadcast((dictionary, table))
    del table

    z = total + 0.1 * (distinct + 1)
    tail = _Tail(keep, rest, z)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = SPREAD * partitions
    row = F.monotonically_increasing_id() * 2 + (crc_mod(F.col("doc_id"), folds) != fold).cast("long")
    texts = rows.select(row.alias("row"), "doc_id", F.col("text").cast("binary").alias("text"))
    fields = [pa.field(n, pa.int64() if t == "long" else pa.float64()) for n, t in (x.split() for x in _TEXT.split(", "))]
    schema = pa.schema([("row", pa.int64()), ("word", pa.binary()), ("before", pa.int64()), ("context", pa.int16()), ("text", pa.struct(fields))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text with what the dictionary gives, and one for each word of a text to be looked up."""
        known, logs = shared.value
        base, own = np.append(tail.base(known.counts), 0.0), np.log10(tail.of(known))
        for batch in batches:
            parts, places, context, starts = known.read(batch.column(2).to_pylist())
            if not len(parts):
                continue
            dish = np.where((places < 0) | (places >= known.dishes), known.dishes, places)
            score = logs[context, dish].astype(np.float64) + own[places]
            sizes = np.diff(np.append(starts, len(places)))
            m, ids = len(parts), batch.column(0)
            sums = [batch.column(1), pa.array(sizes), pa.array(np.add.reduceat((places >= 0).astype(np.int64), starts)), pa.array(np.add.reduceat(base[places], starts)), pa.array(np.add.reduceat(score, starts))]
            # a word with a space in it meets no other
            yield pa.RecordBatch.from_arrays([ids, pa.array([b" %d" % i for i in ids.to_pylist()], pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int16()), pa.StructArray.from_arrays(sums, fields=fields)], schema=schema)
            at = np.flatnonzero(places < 0)
            rare = _rare(parts, places, starts)
            before, framed, _ = known.pairs(places, starts, _numbers(places, rare))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(m), sizes)[at])), pa.array(rare, pa.binary()), pa.array(before[at]), pa.array(np.where(framed, -1, context)[at].astype(np.int16)), pa.nulls(len(at), pa.struct(fields))], schema=schema)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tokens that the dictionary has and the table hasn't, packed."""
        known = shared.value[0]
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if sum(len(x[0]) for x in held):
                columns = [np.concatenate(x) for x in zip(*held, strict=True)]
                part = columns[1] % spread
                by = np.argsort(part, kind="stable")
                cuts = [0, *(np.flatnonzero(np.diff(part[by])) + 1).tolist(), len(by)]
                packed = [pack_tokens(*(x[by[lo:hi]] for x in columns)) for lo, hi in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(part[by[cuts[:-1]]]), pa.array(packed, pa.binary())], names=["part", "packed"])
            held.clear()

        for batch in batches:
            parts, places, context, starts = known.read(batch.column(2).to_pylist())
            if not len(parts):
                continue
            numbers = _numbers(places, _rare(parts, places, starts))
            before, framed, dense = known.pairs(places, starts, numbers)
            at = np.flatnonzero((places >= 0) & ~dense)
            of = np.repeat(np.arange(len(parts)), np.diff(np.append(starts, len(places))))[at]
            held.append((batch.column(0).to_numpy()[of], before[at], numbers[at], np.where(framed, -1, context)[at].astype(np.int16)))
            if sum(len(x[0]) for x in held) > PACKED:
                yield from flush()
        yield from flush()

    found = texts.mapInArrow(trimmed(read), f"row long, word binary, before long, context short, text struct<{_TEXT.replace(' ', ':').replace(',:', ',')}>")
    part = F.pmod(F.coalesce("before", F.shiftright("row", 1)), F.lit(spread).cast("long")).alias("part")
    looked_up = found.join(counts, "word", "left").select("row", "before", F.xxhash64("word").alias("token"), "context", F.coalesce("c", F.lit(0)).alias("c"), "text", F.lit(None).cast("binary").alias("packed"), part)
    others = texts.mapInArrow(trimmed(follow), "part long, packed binary")
    others = others.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in looked_up.schema.fields[:6]], "packed", "part")
    summed = seated(looked_up.unionByName(others), shared, tail, partitions, shape)
    return summed.select("doc_id", (crc_mod(F.col("doc_id"), folds) == fold).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")

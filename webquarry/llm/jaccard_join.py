"""Set similarity join of documents on word n-grams: a size-aware heavy-light join.

Sets that are equal are one node.  Tokens of a set are put in one order, frequent ones last.  Two sets of a Jaccard
similarity of at least t share l tokens among the first n - ceil(t n) + l of each.  Light sets enumerate subsets of two
tokens (l = 2) of that prefix, heavy sets are met on the inverted lists of single tokens (l = 1); sets that are heavy but
could be similar to a light one do both.  The boundary is the size with the least estimated cost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .lm import count_bin
from .session import materialize, release, trimmed, tune
from .shingles import Shingler, mix, set_key

#: Frequent tokens that are ordered last, at most (16 bytes each are broadcast); the order only bears on the cost.
HOT_TOKENS = 1 << 20
#: Largest size that can be light.
MOST_LIGHT = 256
#: Bits of the filter for candidate nodes.
FILTER_BITS = 1 << 25
#: Lists up to this length give their pairs at once, each pair counted once over all lists; longer ones go by blocks.
SHORT_LIST = 16
#: Nodes of a list that are held against each other at once.
LIST_BLOCK = 2048
#: Blocks into which the partners of one hub are dealt.
BLOCKS = 32


@dataclass(frozen=True)
class Similarity:
    """Two sets are linked when ``of * intersection >= least * union``; sets of ``width``-word shingles."""

    width: int = 5
    least: int = 80
    of: int = 100

    @property
    def smallest(self) -> int:
        """The least size at which different sets can be linked."""
        return -(-self.least // (self.of - self.least))

    def needed(self, n: int) -> int:
        """Tokens that a set of n shares with any set linked to it, at least."""
        return -(-self.least * n // self.of)

    def prefix(self, n: int, common: int) -> int:
        return min(n, n - self.needed(n) + common)

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        if self.of * min(len(a), len(b)) < self.least * max(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return self.of * both >= self.least * (len(a) + len(b) - both)

    def sizes_fit(self, n: Column, m: Column) -> Column:
        return F.lit(self.of) * F.least(n, m) >= F.lit(self.least) * F.greatest(n, m)


def _batches(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def sketch(shingles: np.ndarray) -> bytes:
    """Which of 2 ** k classes of hashes a set has tokens in, four classes a token or more: packed bits."""
    k = max(3, (4 * len(shingles) - 1).bit_length())
    bits = np.zeros(1 << k, dtype=np.uint8)
    bits[(mix(shingles) >> np.uint64(64 - k)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def could_link(a: bytes, n: int, b: bytes, m: int, similarity: Similarity) -> bool:
    """Whether two sets could be linked, by their sketches: a class that only one set has holds a token that only it has.

    Never false for sets that are linked.
    """
    x, y = (np.frombuffer(v, dtype=np.uint8) for v in (a, b))
    while len(x) != len(y):  # the finer one is folded: neighbouring classes become one
        fine = np.unpackbits(x if len(x) > len(y) else y).reshape(-1, 2).max(axis=1)
        x, y = (np.packbits(fine), y) if len(x) > len(y) else (x, np.packbits(fine))
    most = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))
    return similarity.of * most >= similarity.least * (n + m - most)


def describe(docs: DataFrame, similarity: Similarity) -> DataFrame:
    """From ``doc_id, text (binary)``: rows of ``doc_id, n, node, sketch``, and rows of ``token, c`` of repeated tokens.

    Tokens are counted within stretches of a few million; those seen more than once in one are reported.
    """
    types, names = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()], ["doc_id", "n", "node", "sketch", "token", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(similarity.width)
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                token, c = np.unique(np.concatenate(held), return_counts=True)
                some = c >= 2
                token, c = token[some].astype(np.int64), c[some]
                if len(token):
                    none = pa.nulls(len(token), pa.int64())
                    yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(token), pa.binary()), pa.array(token), pa.array(c.astype(np.int64))], names=names)
                held.clear()

        for batch in batches:
            rows = []
            for doc, s in zip(batch.column(0).to_pylist(), shingler.of(batch.column(1)), strict=True):
                rows.append((doc, len(s), set_key(s), sketch(s) if len(s) >= similarity.smallest else None, None, None))
                held.append(s)
                size += len(s)
            if rows:
                yield _batches(rows, types, names)
            if size > 4_000_000:
                yield from flush()
                size = 0
        yield from flush()

    return materialize(docs.mapInArrow(trimmed(run), "doc_id long, n long, node long, sketch binary, token long, c long"), "sets")


def hot_tokens(repeated: DataFrame, most: int = HOT_TOKENS) -> tuple[np.ndarray, np.ndarray, float]:
    """The most frequent tokens, sorted, with their counts, and the mean length of the other inverted lists."""
    repeated = materialize(repeated, "repeated")
    bins = {r.bin: (r.n, r.s) for r in repeated.groupBy(count_bin(F.col("c")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("s")).collect()}
    least, room = max(bins, default=0) + 1, most
    while least > 1 and room >= bins.get(least - 1, (0, 0))[0]:
        least -= 1
        room -= bins.get(least, (0, 0))[0]
    rows = repeated.filter(count_bin(F.col("c")) >= least).select("token", "c").toArrow()
    token, c = rows.column("token").to_numpy().astype(np.uint64), rows.column("c").to_numpy()
    by = np.argsort(token)
    release(repeated)
    rest = [(n, s) for b, (n, s) in bins.items() if b < least]
    return token[by], c[by], sum(s for _, s in rest) / max(1, sum(n for n, _ in rest))


def boundary(sizes: dict[int, int], similarity: Similarity, list_length: float) -> int:
    """The largest light size, with the least cost: subsets enumerated by light sets, lists scanned by heavy ones.

    ``sizes`` has the number of sets of each size up to MOST_LIGHT; larger sets are heavy at any boundary.
    """
    pairs = lambda n: (p := similarity.prefix(n, 2)) * (p - 1) / 2
    lists = lambda n: similarity.prefix(n, 1) * (1 + list_length)
    best, cost = similarity.smallest - 1, None
    for x in range(similarity.smallest - 1, MOST_LIGHT + 1):
        reach = similarity.of * x // similarity.least
        now = sum(h * ((pairs(n) if n <= reach else 0) + (lists(n) if n > x else 0)) for n, h in sizes.items() if n >= similarity.smallest)
        if cost is None or now < cost:
            best, cost = x, now
    return best


def signatures(docs: DataFrame, similarity: Similarity, hot: tuple[np.ndarray, np.ndarray], light: int) -> DataFrame:
    """``token, node, n``: what each set is met by.  A task gives the signatures of equal sets once."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    reach = similarity.of * light // similarity.least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, (tokens, counts) = Shingler(similarity.width), shared.value
        seen: set[int] = set()
        for batch in batches:
            out: list[tuple[np.ndarray, int, int]] = []
            for s in shingler.of(batch.column(0)):
                n = len(s)
                if n < similarity.smallest or (node := set_key(s)) in seen:
                    continue
                seen.add(node)
                order = mix(s)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    c = np.where(tokens[at] == s, counts[at], 0)
                    s = s[np.lexsort((order, c))]
                else:
                    s = s[np.argsort(order)]
                if n > light:
                    out.append((s[: similarity.prefix(n, 1)], node, n))
                if n <= reach:
                    p = np.sort(s[: similarity.prefix(n, 2)])
                    i, j = np.triu_indices(len(p), 1)
                    out.append((mix(mix(p[i]) + p[j]), node, n))
            if out:
                size = [len(t) for t, _, _ in out]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([t for t, _, _ in out]).astype(np.int64)), pa.array(np.repeat([x for _, x, _ in out], size).astype(np.int64)), pa.array(np.repeat([x for _, _, x in out], size).astype(np.int32))], names=["token", "node", "n"])

    return docs.select("text").mapInArrow(trimmed(run), "token long, node long, n int")


def node_filter(nodes: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit array of fixed size with the bits of all nodes set (a Bloom filter of one hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.zeros(bits // 8, dtype=np.uint8)
        for batch in batches:
            h = (mix(batch.column(0).to_numpy().astype(np.uint64)) % np.uint64(bits)).astype(np.int64)
            np.bitwise_or.at(field, h >> 3, (1 << (h & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([field.tobytes()], pa.binary())], names=["field"])

    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in nodes.coalesce(6).mapInArrow(trimmed(run), "field binary").toLocalIterator():
        out |= np.frombuffer(r.field, dtype=np.uint8)
    return out


def node_texts(docs: DataFrame, rows: DataFrame, nodes: DataFrame, similarity: Similarity) -> DataFrame:
    """``node, text`` for the nodes of a table: one text of each, without shuffling other texts."""
    ids = rows.join(nodes, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    ids = materialize(ids.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id")), "ids")
    shared = docs.sparkSession.sparkContext.broadcast(node_filter(ids))
    release(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, field, seen = Shingler(similarity.width), shared.value, set()
        for batch in batches:
            out = []
            h = (mix(batch.column(0).fill_null(-1).to_numpy().astype(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)
            some = batch.column(1).filter(pa.array((field[h >> 3] >> (h & 7).astype(np.uint8) & 1).astype(bool)))
            for text, s in zip(some.to_pylist(), shingler.of(some), strict=True):
                node = set_key(s)
                if node not in seen:
                    seen.add(node)
                    out.append((node, text))
            if out:
                yield _batches(out, [pa.int64(), pa.binary()], ["node", "text"])

    found = docs.mapInArrow(trimmed(run), "node long, text binary").join(nodes, "node", "left_semi")
    return found.groupBy("node").agg(F.first("text").alias("text"))


def possible(pairs: DataFrame, sketches: DataFrame, similarity: Similarity) -> DataFrame:
    """Of ``hub, node`` the pairs whose sketches don't rule them out."""
    one = pairs.join(sketches.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("sketch").alias("hub_sketch")), "hub")
    both = one.join(sketches, "node").select("hub", "node", "hub_sketch", "hub_n", "sketch", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [could_link(*x, similarity) for x in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)]
            yield batch.select(["hub", "node"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(trimmed(run), "hub long, node long")


class _Block:
    """The nodes of a part of a list, by size, with their sketches at the level of their own and at the one below."""

    def __init__(self, rows: list[tuple[int, int, int, int, bytes]]):
        rows.sort(key=lambda r: (r[3], r[0]))
        self.node, self.component, self.part, self.n = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(4))
        self.bits = [np.frombuffer(r[4], dtype=np.uint8) for r in rows]
        self.level = np.array([len(b) for b in self.bits])
        self.own = {size: (at := np.flatnonzero(self.level == size), np.stack([self.bits[i] for i in at])) for size in set(self.level.tolist())}
        self.folded = {size // 2: (at, np.packbits(np.unpackbits(m, axis=1).reshape(len(at), -1, 2).max(axis=2), axis=1)) for size, (at, m) in self.own.items() if size > 1}

    def pairs(self, similarity: Similarity, across: bool) -> Iterator[tuple[int, int]]:
        """Pairs of nodes of different components (and parts, if ``across``) that sketches and sizes don't rule out."""
        for i in range(len(self.node)):
            most_n = similarity.of * int(self.n[i]) // similarity.least
            for at, matrix in (self.own[int(self.level[i])], self.folded.get(int(self.level[i]), (None, None))):
                if at is None:
                    continue
                lo, hi = np.searchsorted(at, i + 1), np.searchsorted(self.n[at], most_n, side="right")
                if hi <= lo:
                    continue
                j, m = at[lo:hi], matrix[lo:hi]
                fits = (self.component[j] != self.component[i]) & ((self.part[j] != self.part[i]) if across else True)
                j, m = j[fits], m[fits]
                if not len(j):
                    continue
                own = self.bits[i]
                both = np.bitwise_count(m & own).sum(axis=1, dtype=np.int64)
                most = np.minimum(self.n[i] - (int(np.bitwise_count(own).sum()) - both), self.n[j] - (np.bitwise_count(m).sum(axis=1, dtype=np.int64) - both))
                for k in j[similarity.of * most >= similarity.least * (self.n[i] + self.n[j] - most)].tolist():
                    a, b = int(self.node[i]), int(self.node[k])
                    yield (a, b) if a > b else (b, a)


def within_lists(lists: DataFrame, sketches: DataFrame, similarity: Similarity, most: int = LIST_BLOCK) -> DataFrame:
    """``hub, node``: pairs of one list and of different components that could be linked.

    Short lists give their pairs, which are the same in many lists; sketches are looked at for distinct pairs later.
    Nodes of a longer list are held against each other in blocks of ``most`` by their sketches, and only what is left
    is emitted.  ``lists`` has ``token, node, n, component, k``, with k the length of the list.
    """
    short = lists.filter(F.col("k") <= SHORT_LIST).select("token", "node", "n", "component")
    a, b = short.alias("a"), short.alias("b")
    met = a.join(b, F.col("a.token") == F.col("b.token")).filter((F.col("a.node") > F.col("b.node")) & (F.col("a.component") != F.col("b.component")) & similarity.sizes_fit(F.col("a.n"), F.col("b.n")))
    few = met.select(F.col("a.node").alias("hub"), F.col("b.node").alias("node")).distinct()
    lists = lists.filter(F.col("k") > SHORT_LIST)
    parts = F.ceil(F.col("k") / most).cast("int")
    dealt = lists.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.select("token", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "node", "component", "part")
    dealt = dealt.join(sketches, "node").select("token", "low", "high", "node", "component", "part", "n", "sketch")
    dealt = dealt.repartition(docs_partitions(lists), "token", "low", "high").sortWithinPartitions("token", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, seen = None, [], set()

        def done() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                found = {p for p in _Block(held).pairs(similarity, key[1] != key[2])} - seen
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.update(found)
                if found:
                    yield _batches(sorted(found), [pa.int64(), pa.int64()], ["hub", "node"])

        for batch in batches:
            for token, low, high, *row in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if key != (token, low, high):
                    yield from done()
                    key, held = (token, low, high), []
                held.append(tuple(row))
        yield from done()

    return few.unionByName(dealt.mapInArrow(trimmed(run), "hub long, node long"))


def verify(pairs: DataFrame, docs: DataFrame, rows: DataFrame, sketches: DataFrame, similarity: Similarity) -> DataFrame:
    """Of ``hub, node`` the pairs that are linked, as ``a, b``.

    Sketches rule most others out; only the texts of the pairs that are left are gathered.

    The texts of a hub's partners are dealt to blocks, each with the hub's text in front, and streamed past it.
    """
    pairs = materialize(possible(pairs, sketches, similarity), "pairs")
    nodes = materialize(pairs.select("node").unionByName(pairs.select(F.col("hub").alias("node"))).distinct(), "nodes")
    texts = materialize(node_texts(docs, rows, nodes, similarity), "texts")
    dealt = pairs.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(BLOCKS)).cast("int"))
    hubs = dealt.select("hub", "block").distinct().withColumn("node", F.col("hub"))
    dealt = dealt.select("hub", "block", "node", F.lit(1).alias("place")).unionByName(hubs.select("hub", "block", "node", F.lit(0).alias("place")))
    met = dealt.join(texts, "node").select("hub", "block", "place", "node", "text")
    sorted_ = met.repartition(int(docs_partitions(pairs)), "hub", "block").sortWithinPartitions("hub", "block", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(similarity.width)
        hub, own = None, np.empty(0, np.uint64)
        for batch in batches:
            out = []
            for h, block, place, node, s in zip(*(batch.column(i).to_pylist() for i in range(4)), shingler.of(batch.column(4)), strict=True):
                if place == 0:
                    hub, own = (h, block), s
                elif hub == (h, block) and similarity.linked(own, s):
                    out.append((h, node))
            if out:
                yield _batches(out, [pa.int64(), pa.int64()], ["a", "b"])

    linked = materialize(sorted_.mapInArrow(trimmed(run), "a long, b long"), "linked")
    release(pairs, nodes, texts)
    return linked


def docs_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def links(docs: DataFrame, similarity: Similarity) -> tuple[DataFrame, DataFrame]:
    """``doc_id, n, node`` of each row (a written table), and the components ``node, component`` of nodes linked to others.

    First each node is verified against one hub of each list and size class.  Then, in lists whose nodes aren't all
    in one component yet, every two nodes of different components and fitting sizes are held against each other.  What
    stays unverified is in one component already or ruled out by exact bounds, so that no component is lost.
    """
    spark = docs.sparkSession
    tune(spark)
    described = describe(docs, similarity)
    rows = described.filter("node IS NOT NULL").select("doc_id", "n", "node", "sketch")
    tokens, counts, list_length = hot_tokens(described.filter("token IS NOT NULL").groupBy("token").agg(F.sum("c").alias("c")))
    sizes = {r.n: r["count"] for r in rows.filter(F.col("n") <= MOST_LIGHT).groupBy("n").count().collect()}
    light = boundary(sizes, similarity, list_length)

    lists = signatures(docs, similarity, (tokens, counts), light).repartition(docs_partitions(docs), "token").groupBy("token", "node").agg(F.first("n").alias("n"))
    # A hub for each list and size class.  Sizes of one class fit each other.
    ratio = float(np.log(similarity.of / similarity.least))
    lists = lists.withColumn("class", F.floor(F.log(F.col("n")) / ratio).cast("int"))
    by_list, by_class = Window.partitionBy("token"), Window.partitionBy("token", "class")
    lists = lists.withColumn("size", F.count(F.lit(1)).over(by_list)).filter("size > 1").drop("size")
    lists = materialize(lists, "lists")
    # The node that shares the most tokens is likest to the others: an original among its edited copies.
    degrees = materialize(lists.groupBy("node").agg(F.count(F.lit(1)).alias("degree")), "degrees")
    ranked = lists.join(degrees, "node").withColumn("hub", F.max(F.struct("degree", "node")).over(by_class)["node"])

    sketches = materialize(rows.filter("sketch IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sketches")

    stars = ranked.filter("hub <> node").select("hub", "node").distinct()
    first = verify(stars, docs, rows, sketches, similarity)
    release(degrees)
    tied = materialize(components(first), "tied")

    labelled = lists.select("token", "node", "n").join(tied, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = materialize(labelled, "labelled")
    release(lists, tied)
    several = labelled.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("k")).filter("low <> high").select("token", "k")
    several = materialize(several, "several")
    pairs = within_lists(labelled.join(several, "token"), sketches, similarity).distinct()
    second = verify(pairs, docs, rows, sketches, similarity)
    tied = materialize(components(first.unionByName(second)), "tied")
    slim = materialize(rows.select("doc_id", "n", "node"), "rows")
    release(labelled, several, sketches, first, second, described)
    return slim, tied


def classes(docs: DataFrame, similarity: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``.

    ``component_id`` is the smallest id that can be reached over links, its own included.  Texts without words (null,
    empty) are linked with nothing and are their own component; a text of fewer words than a shingle is one shingle.
    Rows of equal sets, repeated rows among them, are linked.  A null id is never a component's id unless all of its ids
    are null.  An empty table gives an empty result; other columns are not looked at.
    """
    rows, tied = links(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")), similarity)
    least = rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = least.join(tied, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "least")
    named = materialize(named, "named")
    smallest = materialize(named.groupBy("component").agg(F.min("least").alias("component_id")), "smallest")
    ids = materialize(named.join(smallest, "component").select("node", "component_id"), "ids")
    empty = rows.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    found = rows.filter("n > 0").join(ids, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(empty)
    found = materialize(found, "classes")
    release(rows, tied, named, smallest, ids)
    return found

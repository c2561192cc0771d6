"""A Merkle manifest of a table: a leaf for each row, a tree for each group of rows, a tree over the groups.

Rows are numbered within their group by one range partitioning and cut into aligned blocks of ``fanout ** depth``.  A
block's leaves are one contiguous matrix of 64-byte hex digests; reshaped by the fanout, its rows are hashed level by
level.  The nodes that are left of blocks are leaves of the next round, so that no task ever has more than a block,
however many rows a group has.  Proofs go the other way: from the top each block gets the path above it and hands it to
its members, whose siblings are found by index arithmetic.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import materialize, release, trimmed, tune

HEX = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<slot:int,siblings:string>>"


@dataclass(frozen=True)
class Shape:
    """``fanout`` children of a node, and ``depth`` levels in a block."""

    fanout: int = 8
    depth: int = 4

    @property
    def block(self) -> int:
        return self.fanout**self.depth

    def levels(self, n: int) -> int:
        """Levels above ``n`` leaves until one node remains."""
        out = 0
        while n > 1:
            n, out = -(-n // self.fanout), out + 1
        return out


def leaf(*fields: Column) -> Column:
    """The digest of a row: each field as ``-`` if null, else its UTF-8 byte count, ``:`` and its value as text."""
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def matrix(digests: pa.Array) -> np.ndarray:
    """The hex digests of an Arrow string array as a matrix with a row of bytes for each, without a copy."""
    offsets = np.frombuffer(digests.buffers()[1], dtype=np.int64 if pa.types.is_large_string(digests.type) else np.int32)
    first = int(offsets[digests.offset])
    return np.frombuffer(digests.buffers()[2], dtype=np.uint8)[first : first + HEX * len(digests)].reshape(-1, HEX)


def tree(leaves: np.ndarray, fanout: int, levels: int) -> list[np.ndarray]:
    """The digests of a block, level by level: every ``fanout`` consecutive rows give one of the next level, the last
    run may be shorter."""
    out = [leaves]
    for _ in range(levels):
        rows = out[-1]
        full = len(rows) // fanout
        nodes = [hashlib.sha256(run).hexdigest() for run in np.ascontiguousarray(rows[: full * fanout]).reshape(full, fanout * HEX)]
        if full * fanout < len(rows):
            nodes.append(hashlib.sha256(rows[full * fanout :].tobytes()).hexdigest())
        out.append(np.frombuffer("".join(nodes).encode(), dtype=np.uint8).reshape(-1, HEX))
    return out


def siblings(rows: np.ndarray, fanout: int) -> list[bytes]:
    """For each row of a level the other rows of its run, left to right, as one text."""
    at = np.arange(len(rows))
    others = (at - at % fanout)[:, None] + np.arange(fanout - 1)
    others += others >= at[:, None]
    size = np.minimum(at - at % fanout + fanout, len(rows)) - (at - at % fanout) - 1
    gathered = rows[np.minimum(others, len(rows) - 1)].reshape(len(rows), -1)
    return [x[: HEX * n].tobytes() for x, n in zip(gathered, size.tolist(), strict=True)]


def fold(digest: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The digest at the end of a path of (slot, siblings), from a leaf's digest."""
    for slot, others in path:
        digest = hashlib.sha256(others[: HEX * slot] + digest + others[HEX * slot :]).hexdigest().encode()
    return digest


def numbered(leaves: DataFrame) -> DataFrame:
    """``leaves`` with ``position`` within ``grp`` (by ``key``, then ``digest``) and ``n``, the size of the group.

    One range partitioning sorts all groups; a row's place in its partition and the sizes of the group's parts in earlier
    partitions give its position, so that a hot group is no one's task.  The part sizes are at most a row for each
    partition and group.
    """
    order = ["grp", "key", "digest"]
    sorted_ = leaves.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(sorted_.withColumn("_at", F.monotonically_increasing_id()), "merkle-order")
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    parts = placed.groupBy("grp", part.alias("_part")).agg(F.min(row).alias("_first"), F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy("grp")
    before = F.coalesce(F.sum("_n").over(by.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("grp", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(by).alias("n"))
    return placed.withColumn("_part", part).join(parts, ["grp", "_part"]).withColumn("position", row + F.col("_shift")).drop("_at", "_part", "_shift")


def blocks(rows: DataFrame, shape: Shape, carried: list[str]) -> DataFrame:
    """A row for each aligned block: ``grp, block, n`` and arrays of ``digest`` and the ``carried`` columns, by position."""
    members = F.sort_array(F.collect_list(F.struct("position", "digest", *carried)))
    cut = rows.groupBy("grp", F.floor(F.col("position") / shape.block).cast("long").alias("block"), "n").agg(members.alias("_m"))
    return cut.select("grp", "block", "n", *[F.col(f"_m.{c}").alias(c) for c in ("digest", *carried)])


def nodes(cut: DataFrame, shape: Shape) -> DataFrame:
    """``grp, position, n, digest`` of the node of each block, as the leaves of the next round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [tree(matrix(batch.column(3)[k].values), shape.fanout, min(shape.depth, shape.levels(n)))[-1].tobytes().decode() for k, n in enumerate(batch.column(2).to_pylist())]
            counts = pa.array([-(-n // shape.block) for n in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts, pa.array(made, pa.string())], names=["grp", "position", "n", "digest"])

    return cut.select("grp", "block", "n", "digest").mapInArrow(trimmed(run), "grp string, position long, n long, digest string")


def _member_paths(batch: pa.RecordBatch, shape: Shape) -> Iterator[tuple[int, np.ndarray, list[list[bytes]], list[tuple[int, bytes]]]]:
    """For each block of ``grp, block, n, digest, path, ...``: its number in the batch, leaves, siblings of each level, path above."""
    for k in range(len(batch)):
        leaves = matrix(batch.column(3)[k].values)
        levels = tree(leaves, shape.fanout, min(shape.depth, shape.levels(batch.column(2)[k].as_py())))
        above = [(x["slot"], x["siblings"].encode()) for x in batch.column(4)[k].as_py()]
        yield k, leaves, [siblings(x, shape.fanout) for x in levels[:-1]], above


def _own_path(i: int, sides: list[list[bytes]], fanout: int) -> list[tuple[int, bytes]]:
    out = []
    for level in sides:
        out.append((i % fanout, level[i]))
        i //= fanout
    return out


def paths(cut: DataFrame, shape: Shape) -> DataFrame:
    """``grp, block, path`` for each member of blocks (with the ``path`` above each): members are the blocks of the round below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grp, block, path = [], [], []
            for k, leaves, sides, above in _member_paths(batch, shape):
                grp += [batch.column(0)[k].as_py()] * len(leaves)
                first = batch.column(1)[k].as_py() * shape.block
                block += range(first, first + len(leaves))
                path += [[{"slot": s, "siblings": x.decode()} for s, x in (*_own_path(i, sides, shape.fanout), *above)] for i in range(len(leaves))]
            if grp:
                yield pa.RecordBatch.from_arrays([pa.array(grp, pa.string()), pa.array(block, pa.int64()), pa.array(path, pa.list_(pa.struct([("slot", pa.int32()), ("siblings", pa.string())])))], names=["grp", "block", "path"])

    return cut.select("grp", "block", "n", "digest", "path").mapInArrow(trimmed(run), f"grp string, block long, path {_PATH}")


_RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proofs(cut: DataFrame, shape: Shape) -> DataFrame:
    """The result rows of the lowest blocks: ``grp, block, n, digest, path, key, changed, subroot, root``."""
    names = [x.split()[0] for x in _RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, leaves, sides, above in _member_paths(batch, shape):
                ids, changed = batch.column(5)[k].values, batch.column(6)[k].as_py()
                subroot, root = batch.column(7)[k].as_py(), batch.column(8)[k].as_py()
                upper = b"".join(x for _, x in above)
                ends: dict[bytes, str] = {}
                proof, folded = [], []
                for i, other in enumerate(changed):
                    own = _own_path(i, sides, shape.fanout)
                    h = hashlib.sha256()
                    for _, x in own:
                        h.update(x)
                    h.update(upper)
                    proof.append(h.hexdigest())
                    top = fold(leaves[i].tobytes() if other is None else other.encode(), own)
                    if top not in ends:
                        ends[top] = fold(top, above).decode()
                    folded.append(ends[top])
                    if len(ends) > 64:
                        ends.clear()
                n = len(leaves)
                columns = [ids, batch.column(3)[k].values, pa.array([subroot] * n), pa.array([root] * n), pa.array(proof), pa.array(folded), pa.array([x == root for x in folded])]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return cut.select("grp", "block", "n", "digest", "path", "key", "changed", "subroot", "root").mapInArrow(trimmed(run), _RESULT)


def manifest(docs: DataFrame, shape: Shape = Shape(), id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text", tampered: Column | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for each row of ``docs``.

    Leaves of a group (null is a group) ascend by id, then by digest; groups ascend by UTF-8 bytes, null first.  Rows for
    which ``tampered`` holds (by default where 3 divides the crc32 of the id as text, a null id as empty text) are folded
    from their leaf with A-Z of the text lower-cased.  Null ids come first; repeated rows are leaves of their own, next to each
    other; null and empty texts, and texts of any length, are hashed on the JVM like others; an empty table gives an empty result; columns that
    aren't ``fields`` are not looked at.
    """
    spark = docs.sparkSession
    tune(spark)
    if tampered is None:
        tampered = F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 3 == 0
    lowered = [F.translate(F.col(c), _UPPER, _LOWER) if c == text_col else F.col(c) for c in fields]
    # A group's key sorts as the group does, null first, and is never null.
    grp = F.coalesce(F.concat(F.lit("+"), F.col(group_col).cast("string")), F.lit(""))
    leaves = materialize(docs.select(grp.alias("grp"), F.col(id_col).cast("long").alias("key"), leaf(*[F.col(c) for c in fields]).alias("digest"), F.when(tampered, leaf(*lowered)).alias("changed")), "merkle-leaves")
    bottom = materialize(blocks(numbered(leaves), shape, ["key", "changed"]), "merkle-blocks")
    release(leaves)

    def climb(cut: DataFrame) -> tuple[list[DataFrame], DataFrame]:
        """Blocks of all rounds above ``cut``, and the last node of each group."""
        rounds, tops = [], []
        while True:
            above = materialize(nodes(cut, shape), "merkle-nodes")
            tops.append(above.filter("n = 1").select("grp", "digest"))
            more = above.filter("n > 1")
            if more.isEmpty():
                break
            cut = materialize(blocks(more, shape, []), "merkle-blocks")
            rounds.append(cut)
        found = tops[0]
        for other in tops[1:]:
            found = found.unionByName(other)
        return rounds, found

    def descend(rounds: list[DataFrame], path: DataFrame) -> DataFrame:
        """``grp, block, path`` for the blocks below ``rounds``, given ``grp, path`` of each group."""
        whole = path.withColumn("block", F.lit(0).cast("long"))
        for cut in reversed(rounds):
            # Groups of one block had no part in this round: their path stays.
            whole = whole.join(cut.select("grp").distinct(), "grp", "left_anti").unionByName(paths(cut.join(whole, ["grp", "block"]), shape))
            whole = materialize(whole, "merkle-paths")
        return whole

    rounds, subroots = climb(bottom)
    # The tree over the groups: one group whose keys are the groups.
    ends = materialize(subroots, "merkle-subroots")
    top = numbered(ends.select(F.lit("").alias("grp"), F.col("grp").alias("key"), "digest"))
    top = materialize(blocks(top, shape, ["key"]), "merkle-blocks")
    upper, roots = climb(top)
    none = F.array().cast(_PATH)
    below = top.join(descend(upper, roots.select("grp", none.alias("path"))), ["grp", "block"])
    members = top.select("block", F.posexplode("key").alias("_k", "of")).select((F.col("block") * shape.block + F.col("_k")).alias("block"), F.col("of").alias("grp"))
    group_paths = paths(below, shape).select("block", "path").join(members, "block").select("grp", "path")
    group_paths = materialize(group_paths, "merkle-paths")
    above = descend(rounds, group_paths)
    root = roots.select(F.col("digest").alias("root"))
    known = ends.select("grp", F.col("digest").alias("subroot")).crossJoin(F.broadcast(root))
    return proofs(bottom.join(above, ["grp", "block"]).join(known, "grp"), shape)

"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

DataFrame functions only.  A MinHash function of an item has its minimum at one of the item's shingles; the document
holds that shingle with a probability equal to the containment of the item in it.  So an item of the index is the
shingles at the minima of k functions, and any document that contains a share t of the item misses all of them with
the probability (1 - t) ** k.  Items are partitioned by size (doublings): each partition has its own k, all shingles
where an item has no more than that, and its own least document size, below which a document cannot contain t of an item.
Documents are probed with all of their shingles: a signature that finds a short item in a long document as surely would
be longer than the document.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import materialize

#: Bytes of the items' shingles up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
#: Rows of the index up to which it is broadcast (16 bytes each); a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Words: A-Z lower-cased, split at the ASCII white space 20 and 09 to 0D; none for null."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_hashes(ws: Column, width: Column | int) -> Column:
    """A 64-bit hash of each run of ``width`` words, in order; none for shorter texts."""
    width = F.lit(width) if isinstance(width, int) else width
    return F.when(F.size(ws) >= width, F.transform(F.sequence(F.lit(1), F.size(ws) - width + 1), lambda i: F.xxhash64(F.slice(ws, i, width)))).otherwise(F.array().cast("array<bigint>"))


def shingle_texts(ws: Column, width: Column) -> Column:
    """The distinct runs of ``width`` words themselves."""
    return F.when(F.size(ws) >= width, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(ws) - width + 1), lambda i: F.array_join(F.slice(ws, i, width), " ")))).otherwise(F.array().cast("array<string>"))


def functions_for(threshold: float, miss: float) -> int:
    """MinHash functions with which an item contained to ``threshold`` is missed with a probability of ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - threshold)) if threshold < 1 else 1


def item_table(items: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``item_id, width, shingles, n, part``: an item of fewer words than ``width`` is one shingle; one without is left out."""
    rows = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("ws")).filter(F.size("ws") > 0).distinct()
    rows = rows.withColumn("width", F.least(F.lit(width), F.size("ws")))
    rows = rows.select("item_id", "ws", "width", shingle_texts(F.col("ws"), F.col("width")).alias("shingles")).withColumn("n", F.size("shingles"))
    return rows.withColumn("part", F.floor(F.log2("n")).cast("int"))


def index(table: DataFrame, threshold: float, miss: float) -> DataFrame:
    """``h, item_id, width, least``: the shingles at the minima of each item's functions, and the least document size."""
    k = functions_for(threshold, miss)
    h = F.array_distinct(shingle_hashes(F.col("ws"), F.col("width")))
    rows = table.withColumn("h", h)

    def minimum(i: int) -> Column:
        """The shingle at which function i has its least value."""
        return F.array_min(F.transform("h", lambda x: F.struct(F.xxhash64(x, F.lit(i)).alias("v"), x.alias("h"))))["h"]

    minima = F.array_distinct(F.array(*[minimum(i) for i in range(k)]))
    # Small partitions hold no more shingles than functions: all of them stand in the index, which makes them exact.
    signature = F.when(F.size("h") <= k, F.col("h")).otherwise(minima)
    least = F.ceil(F.lit(threshold) * F.pow(F.lit(2.0), F.col("part")))
    return rows.select(F.explode(signature).alias("h"), "item_id", "width", least.cast("int").alias("least"))


def contaminated(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8, miss: float = 1e-9, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, n_item_shingles, n_shared, containment`` of each document that contains an item to ``threshold``.

    Containment is the share of the item's distinct shingles of ``width`` words that the document has.  Null and empty
    texts contain nothing and are contained nowhere.  Repeated documents give a row each, repeated items one; null ids
    are kept; empty tables give an empty result; other columns are not looked at.
    """
    table = item_table(items, width, item_id_col, item_text_col)
    found = materialize(index(table, threshold, miss), "index")
    widths = sorted(r.width for r in found.select("width").distinct().collect())  # 1 to ``width`` at most
    small = found.count() <= BROADCAST_ROWS
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if not widths:
        return rows.select("doc_id", F.lit(None).cast("bigint").alias("item_id"), F.lit(0).alias("n_item_shingles"), F.lit(0).alias("n_shared"), F.lit(0.0).alias("containment")).filter("false")
    split = rows.select("doc_id", words(F.col("text")).alias("ws"))
    # explode_outer: for explode, the optimizer would add a filter that computes all shingles once more, from the text
    # for each word; the null of a text without shingles meets nothing.
    probes = None
    for w in widths:
        one = split.select("doc_id", F.size("ws").alias("size"), F.explode_outer(shingle_hashes(F.col("ws"), w)).alias("h"))
        part = found.filter(F.col("width") == w).select("h", "item_id", "least")
        met = one.join(F.broadcast(part) if small else part, "h").filter(F.col("size") - (w - 1) >= F.col("least")).select("doc_id", "item_id")
        probes = met if probes is None else probes.unionByName(met)
    candidates = materialize(probes.distinct(), "candidates")
    # Candidates get their texts back, and are held against the words themselves.
    held = rows.join(candidates, rows.doc_id.eqNullSafe(candidates.doc_id)).select(rows.doc_id, "text", "item_id")
    size = table.agg(F.sum(F.octet_length(F.array_join("shingles", "")))).first()[0] or 0
    small = small and size <= BROADCAST_BYTES
    own = table.select(F.col("item_id").alias("own_id"), "shingles", "width", F.col("n").alias("n_item_shingles"))
    held = held.join(F.broadcast(own) if small else own, F.col("item_id").eqNullSafe(F.col("own_id")))
    # Written before it is filtered: a filter on the containment would be pushed below the words and split them again.
    held = held.withColumn("ws", words(F.col("text"))).select("doc_id", "item_id", "shingles", "n_item_shingles", shingle_texts(F.col("ws"), F.col("width")).alias("own"))
    held = materialize(held.select("doc_id", "item_id", "n_item_shingles", F.size(F.array_intersect("own", "shingles")).alias("n_shared")), "held")
    return held.withColumn("containment", F.col("n_shared") / F.col("n_item_shingles")).filter(F.col("containment") >= threshold).select("doc_id", "item_id", "n_item_shingles", "n_shared", "containment")

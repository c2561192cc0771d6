"""JSON-LD and other JSON as variants: parsing, unwrapping and paths on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _is(v: Column, kind: str) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit(kind))


def objects(document: Column) -> Column:
    """The JSON objects of a document as an array of variants: itself, the members of a list, or of its ``@graph``.

    Members that aren't objects go; null and malformed documents have none.
    """
    v = F.coalesce(F.try_parse_json(document), F.parse_json(F.lit("null")))
    graph = F.try_variant_get(v, "$['@graph']", "array<variant>")
    every = F.when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>")).when(graph.isNotNull(), graph).when(_is(v, "OBJECT"), F.array(v)).otherwise(F.array().cast("array<variant>"))
    return F.filter(every, lambda x: F.coalesce(_is(x, "OBJECT"), F.lit(False)))


def structured(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per object of JSON documents: the other columns, ``pos``, ``type`` (of a list of types the first), ``name`` and
    ``sites`` (``sameAs``, a text or a list)."""
    rows = documents.select(*[c for c in documents.columns if c != text_col], F.posexplode(objects(F.col(text_col))).alias("pos", "_o"))
    get = lambda path, kind="string": F.try_variant_get("_o", path, kind)
    same = F.coalesce(get("$.sameAs", "array<string>"), F.array_compact(F.array(get("$.sameAs"))))
    return rows.select(*[c for c in rows.columns if c != "_o"], F.coalesce(get("$['@type'][0]"), get("$['@type']")).alias("type"), get("$.name").alias("name"), same.alias("sites"))

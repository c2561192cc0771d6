"""Site snapshots in JSON as tables of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PAGE = "struct<url:string,title:string,text:string,html:string,headers:map<string,string>,links:array<string>,metadata:map<string,string>,images:array<struct<src:string,alt:string,title:string,caption:string,classes:array<string>>>,structured_data:array<string>,status_code:int,crawl_depth:int,original_url:string,redirect_chain:array<string>,source_text:string,body_text:string,rendered_text:string>"
SNAPSHOT = f"site string, root_url string, homepage {_PAGE}, pages array<{_PAGE}>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per snapshot file, in the schema SNAPSHOT; unknown keys are left out."""
    return spark.read.schema(SNAPSHOT).json(path, multiLine=True)


def pages(snapshots: DataFrame) -> DataFrame:
    """A table of pages from snapshots: the homepage first, then the others, each URL once.

    A page without html is taken as its text; a snapshot without a homepage has as one the page of its root URL, else its
    first page, else none.
    """
    from ..functions import urls

    root = F.coalesce("homepage.url", "root_url")
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "/+$", "")
    others = F.filter(F.coalesce("pages", F.array().cast(f"array<{_PAGE}>")), lambda p: p["url"].isNotNull() & (F.col("homepage").isNull() | (p["url"] != F.col("homepage.url"))))
    rooted = F.filter(others, lambda p: bare(p["url"]) == bare(F.col("root_url")))
    rest = F.filter(others, lambda p: bare(p["url"]) != bare(F.col("root_url")))
    every = F.when(F.col("homepage").isNotNull(), F.concat(F.array("homepage"), others)).otherwise(F.concat(rooted, rest))
    rows = snapshots.select(F.coalesce("site", urls.host(root)).alias("site"), F.posexplode(every).alias("page_id", "p"))
    text = F.coalesce(*[F.nullif(F.col(f"p.{c}"), F.lit("")) for c in ("html", "source_text", "body_text", "rendered_text", "text")])
    first = rows.groupBy("site", "p.url").agg(F.min("page_id").alias("page_id"))
    found = rows.select("site", F.col("page_id").cast("long").alias("page_id"), F.col("p.url").alias("url"), text.alias("html"), F.coalesce("p.status_code", F.lit(200)).alias("status_code"), F.coalesce("p.crawl_depth", F.col("page_id").cast("int")).alias("crawl_depth"), F.col("p.original_url").alias("original_url"), F.coalesce("p.redirect_chain", F.array().cast("array<string>")).alias("redirect_chain"))
    first = first.withColumnsRenamed({"site": "_site", "url": "_url", "page_id": "_id"})
    return found.join(first, F.col("site").eqNullSafe(F.col("_site")) & F.col("url").eqNullSafe(F.col("_url")) & (F.col("page_id") == F.col("_id")), "left_semi")

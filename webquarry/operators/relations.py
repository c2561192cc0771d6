"""Pages as one wide table: each page is parsed once, everything else is column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import lexicons as lex
from ..functions import urls
from ..functions.page_parser import PAGE_SCHEMA, parse_safely
from . import facts as fact_rows

#: Optional columns of a table of fetched pages and their values where they are missing.
DEFAULTS = {
    "site": "string", "status_code": "int", "allowed_by_robots": "boolean", "original_url": "string", "redirect_chain": "array<string>", "crawl_depth": "int", "rendered_html": "string",
}


def words(text: Column) -> Column:
    """Number of words (letters, digits, underscores of any script)."""
    return F.regexp_count(text, F.lit(r"(?U)\w+"))


def any_rlike(text: Column, patterns: list[str]) -> Column:
    """Whether any pattern is found; one expression, so that the text is bound once."""
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return F.coalesce(out, F.lit(False))


def any_contains(text: Column, parts: list[str]) -> Column:
    return F.coalesce(F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(text, p)), F.lit(False))


def raw_pages(pages: DataFrame) -> DataFrame:
    """Adds what a table of pages lacks: status 200, allowed, depth 0 and the host as the site."""
    for name, kind in DEFAULTS.items():
        if name not in pages.columns:
            value = {"status_code": F.lit(200), "allowed_by_robots": F.lit(True), "crawl_depth": F.lit(0), "redirect_chain": F.array().cast("array<string>")}.get(name, F.lit(None))
            pages = pages.withColumn(name, value.cast(kind))
    return pages.withColumn("site", F.coalesce("site", urls.host(F.col("url")), F.lit("")))


def parse_pages(pages: DataFrame, partitions: int | None = None, closed_references: bool = False) -> DataFrame:
    """The wide page table: the fields of the parser, the fetch columns, and URL keys.

    The only Python step of an audit.  Pages are parsed where they are read; the html is not carried on.  Of pages of a
    site with one URL that with the smallest id is kept, one without an id only where none has one; pages without a URL are all
    kept, in the site that they name or else in the site ``''``.  Null and broken html is an empty page; rows that repeat
    id and URL stay; an empty table gives an empty result.  With ``closed_references`` a character reference that no semicolon
    ends stays as it is.  With ``partitions`` pages are dealt to so many tasks before; else a file of few row groups has few.
    """
    spark = pages.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    kept = ["site", "page_id", "url", "status_code", "allowed_by_robots", "original_url", "redirect_chain", "crawl_depth"]
    rows = raw_pages(pages)
    schema = StructType([*rows.select(*kept).schema.fields, *StructType.fromDDL(PAGE_SCHEMA).fields, *StructType.fromDDL("needs_rendering string, is_rendered boolean, source_text string, rendered_text string").fields])
    shape = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                static = parse_safely(row["url"], row["html"], closed_references)
                reason = rendering_reason(row["html"], static)
                page = dict(static)
                shown = parse_safely(row["url"], row["rendered_html"], closed_references) if row["rendered_html"] else None
                if shown:
                    page |= {k: v for k, v in shown.items() if v}
                out.append({k: row[k] for k in kept} | page | {"needs_rendering": reason, "is_rendered": bool(shown), "source_text": static["body_text"], "rendered_text": shown["body_text"] if shown else None})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=shape)

    dealt = rows.select(*kept, "html", "rendered_html")
    if partitions:
        dealt = dealt.repartition(partitions, "page_id")
    parsed = dealt.mapInArrow(run, schema)
    # From the raw rows, and in one join for pages with and without a URL, so that pages are parsed once.
    first = rows.filter("url IS NOT NULL").groupBy(F.col("site").alias("_site"), F.col("url").alias("_url")).agg(F.min("page_id").alias("_id"))
    met = parsed.join(first, (F.col("site") == F.col("_site")) & (F.col("url") == F.col("_url")), "left")
    keyed = met.filter(F.col("url").isNull() | F.col("page_id").eqNullSafe(F.col("_id"))).drop("_site", "_url", "_id")
    u = F.col("url")
    return keyed.withColumns({"url_norm": urls.normalize(u), "url_key": urls.equivalence_key(u), "canonical": urls.canonical(u), "locale": urls.locale(u), "is_locale_root": urls.is_locale_root(u), "n_words": words(F.col("body_text"))})


def rendering_reason(html: str | None, page: dict) -> str | None:
    """Why a static page doesn't show its content; null if it does."""
    import re

    if not html:
        return None
    if any(re.search(p, html) for p in lex.NOSCRIPT_PHRASES):
        return "noscript notice"
    if any(re.search(p, html) for p in lex.SPA_CONTAINERS):
        return "empty application container"
    if re.search(r"(?i)<script\b[^>]*>", html) and len(page["body_text"]) < 80:
        return "scripts and little text"
    if any(re.search(p, html) for p in lex.FRAMEWORK_MARKERS) and not page["headings"] and len(page["body_text"]) < 150:
        return "framework markers and no headings"
    return None


def headings(page: DataFrame) -> DataFrame:
    return page.select("site", "page_id", "url", F.posexplode("headings").alias("pos", "h")).select("site", "page_id", "url", "pos", "h.level", "h.text")


def links(page: DataFrame) -> DataFrame:
    return page.select("site", "page_id", "url", F.posexplode("links").alias("pos", "l")).select("site", "page_id", "url", "pos", F.col("l.url").alias("target_url"), "l.text", "l.rel", "l.is_internal")


def images(page: DataFrame) -> DataFrame:
    return page.select("site", "page_id", "url", F.posexplode("images").alias("pos", "i")).select("site", "page_id", "url", "pos", "i.*")


def json_ld(page: DataFrame) -> DataFrame:
    return page.select("site", "page_id", "url", F.posexplode("json_ld").alias("pos", "object"))


def facts(page: DataFrame) -> DataFrame:
    """One row per fact of parsed pages, from JSON-LD and from the text that is shown."""
    return fact_rows.facts(page.select("site", "page_id", "url", F.col("clean_text").alias("text"), "meta_site_name", "json_ld"))


def homepages(page: DataFrame) -> DataFrame:
    """The homepage of each site: the first page of depth 0, else the first page; with its aliases as keys."""
    best = F.min(F.struct((F.coalesce("crawl_depth", F.lit(0)) != 0).alias("deep"), F.col("page_id"), F.col("url"))).alias("h")
    home = page.groupBy("site").agg(best, F.count(F.lit(1)).alias("n_pages")).select("site", F.col("h.page_id").alias("home_id"), F.col("h.url").alias("home_url"), "n_pages")
    return home.withColumns({"home_key": urls.equivalence_key(F.col("home_url")), "home_canonical": urls.canonical(F.col("home_url")), "home_locale": urls.locale(F.col("home_url")), "home_host": urls.host(F.col("home_url"))})


_LINK_SCAN = r"(?is)<a\s+(?:[^>]*?\s+)?href=([\"'])(.*?)\1[^>]*>(.*?)</a>"


def link_scan(pages: DataFrame) -> DataFrame:
    """Raw links by pattern alone, repeated ones included: ``page_id, pos, href, text``, without fragments and other schemes."""
    tags = F.transform(F.regexp_extract_all("html", F.lit(_LINK_SCAN), F.lit(0)), lambda t: F.struct(F.trim(F.regexp_extract(t, _LINK_SCAN, 2)).alias("href"), urls.strip(F.regexp_replace(F.regexp_extract(t, _LINK_SCAN, 3), "<[^>]+>", "")).alias("text")))
    rows = pages.select("page_id", "url", F.posexplode(tags).alias("pos", "l")).select("page_id", "url", "pos", "l.href", "l.text")
    return rows.filter((F.col("href") != "") & ~F.startswith("href", F.lit("#")) & ~F.col("href").rlike("(?i)" + lex.SKIPPED_SCHEMES))

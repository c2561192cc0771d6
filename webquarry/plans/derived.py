"""Tables that Spark derives from ``pages`` and ``documents`` where those lack what an operator needs.

Each is one projection whose expressions are written in SQL that Spark and DuckDB both read, so that the SQL of a query begins
with the same rows.  They are as large as their tables: a robots.txt for each host, a page of a link tree for each page, a text with
statements for each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import urls
from pyspark.sql import functions as F

from ..operators.numbering import numbered

#: Page ``r`` of a host in the order of ids, as a node of a binary tree of links.
TREE_URL = "'https://' || site || CASE WHEN r = 1 THEN '/' ELSE '/p' || CAST(r AS VARCHAR(20)) END"


def hosted(pages: DataFrame) -> DataFrame:
    """``site, page_id, r``: the pages of each host, numbered."""
    return numbered(pages.select(urls.host(F.col("url")).alias("site"), "page_id"), ["site"], ["page_id"], "r")


def _variant(number: str, texts: list[str]) -> str:
    """SQL: the text of a variant; texts are SQL expressions."""
    return f"CASE {number} " + " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(texts)) + " END"


_OWN_LINKS = """'<a href="https://' || site || '/p' || CAST(2 * r AS VARCHAR(20)) || '">next</a> <a href="https://' || site || '/p' || CAST(2 * r + 1 AS VARCHAR(20)) || '">more</a>'"""
_HTML = f"""'<html><head><title>' || CASE page_id % 12 WHEN 0 THEN '' WHEN 1 THEN 'Abc' ELSE 'Page number ' || CAST(r AS VARCHAR(20)) END || '</title>'
    || CASE WHEN page_id % 12 IN (2, 10, 11) THEN '' ELSE '<meta name="description" content="One of the pages of a derived site.">' END
    || CASE WHEN page_id % 12 = 3 THEN '<meta name="robots" content="NoIndex, follow">' ELSE '' END
    || CASE page_id % 12 WHEN 4 THEN '' WHEN 5 THEN '<link rel="canonical" href="http://' || site || '/x">' WHEN 6 THEN '<link rel="canonical" href="https://unrelated.org/x">' WHEN 7 THEN '<link rel="canonical" href="ftp://files">' ELSE '<link rel="canonical" href="https://' || site || '/x">' END
    || '</head><body>' || CASE WHEN page_id % 12 = 10 THEN ''
        ELSE {_OWN_LINKS} || CASE page_id % 12 WHEN 8 THEN '' WHEN 9 THEN '<h1>One</h1><h1>Two</h1>' ELSE '<h1>Heading</h1>' END || CASE page_id % 12 WHEN 11 THEN '<b>Short.</b>' ELSE '<div>Here are a dozen words or more that a visitor of the page can read with ease.</div>' END END || '</body></html>'"""
#: Derived page columns: what was fetched, with which status and over which hops.
TREE = {
    "url": TREE_URL, "html": _HTML, "status_code": "CASE page_id % 7 WHEN 0 THEN 404 WHEN 1 THEN 500 WHEN 2 THEN 403 WHEN 3 THEN NULL ELSE 200 END", "allowed_by_robots": "page_id % 7 <> 4",
    "error": "CASE WHEN page_id % 7 = 3 THEN 'timeout' END", "is_truncated": "page_id % 9 = 0",
}


def tree_pages(pages: DataFrame) -> DataFrame:
    """A page for each page of the table: pages of a host link to two others, and differ in what a page can lack."""
    rows = hosted(pages).selectExpr("site", "page_id", "r", *[f"{e} AS {c}" for c, e in TREE.items()])
    other = lambda name: F.concat(F.lit("https://"), F.col("site"), F.lit(f"/{name}"))
    hops = F.when(F.col("page_id") % 5 == 0, F.array(other("a"), other("b"), other("c"), F.col("url"))).when(F.col("page_id") % 5 == 1, F.array("url", other("b"), "url")).when(F.col("page_id") % 5 == 2, F.array(other("old"), F.col("url"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumns({"redirect_chain": hops, "status_code": F.col("status_code").cast("int")})


_LONG = "word " * 60
#: html and rendered html of page variants by ``page_id % 6``, and why the html doesn't show the content.
RENDERING = [
    ("<html><body><noscript>You need to enable JavaScript to run this.</noscript><h1>Title</h1></body></html>", None, "noscript notice"),
    ('<html><body><div id="root"></div><script src="/a.js"></script></body></html>', None, "empty application container"),
    ("<html><body><h1>Few</h1><script>go()</script></body></html>", None, "scripts and little text"),
    ('<html><head><link href="/_next/static/a.css"></head><body><p>' + "plain words " * 8 + "</p></body></html>", None, "framework markers and no headings"),
    ("<html><body><h1>Whole</h1><p>" + "plain words " * 20 + "</p></body></html>", None, None),
    ('<html><body><div id="app"></div></body></html>', f"<html><body><h1>App</h1><p>{_LONG}</p></body></html>", "empty application container"),
]


def script_pages(pages: DataFrame) -> DataFrame:
    """A page for each page of the table, some of which need scripts; of some the rendered page is there."""
    lit = lambda x: "NULL" if x is None else "'" + x + "'"
    return pages.selectExpr("page_id", "'https://' || CAST(page_id AS STRING) || '.example.org/' AS url", f"{_variant('page_id % 6', [lit(r[0]) for r in RENDERING])} AS html", f"CAST({_variant('page_id % 6', [lit(r[1]) for r in RENDERING])} AS STRING) AS rendered_html")


def robots(pages: DataFrame) -> DataFrame:
    """``site, status_code, raw_text, error`` of each host; the length of its name chooses among four answers."""
    rules = "User-agent: *\\nDisallow: /p2\\nAllow: /p2$ # one page\\n\\nUser-agent: WebquarryBot\\nUser-agent: other\\nDisallow: /p3$\\nDisallow: /p1*\\nAllow: /p11$\\n"
    text = f"CASE length(site) % 4 WHEN 0 THEN '{rules}' WHEN 3 THEN '{rules}Crawl-delay: 12\\nSitemap: https://' || site || '/sitemap.xml' END"
    hosts = pages.select(urls.host(F.col("url")).alias("site")).distinct()
    return hosts.selectExpr("site", "CAST(CASE length(site) % 4 WHEN 1 THEN 404 WHEN 2 THEN 500 ELSE 200 END AS INT) AS status_code", f"{text} AS raw_text", "CASE WHEN length(site) % 4 = 2 THEN 'timeout' END AS error")


def sitemaps(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sitemap files ``site, url, status_code, body`` and the files to begin with: an index with a file for each 20 pages,
    one file (``length % 4 = 1``), or none (2).  Every third page isn't listed."""
    rows = hosted(pages).selectExpr("site", "r", f"{TREE_URL} AS url", "CASE WHEN length(site) % 4 = 1 THEN 0 ELSE CAST(floor((r - 1) / 20) AS INT) END AS part").filter("length(site) % 4 <> 2")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") % 3 != 0, F.struct("r", "url")))), lambda x: F.concat(F.lit("<url><loc>"), x["url"], F.lit("</loc></url>"))), "")
    parts = rows.groupBy("site", "part").agg(F.concat(F.lit("<urlset>"), listed, F.lit("</urlset>")).alias("body"))
    whole = F.length("site") % 4 == 1
    name = F.concat(F.lit("https://"), F.col("site"), F.when(whole, "/sitemap.xml").otherwise(F.concat(F.lit("/part-"), F.col("part").cast("string"), F.lit(".xml"))))
    files = parts.select("site", name.alias("url"), F.lit(200).alias("status_code"), "body")
    inner = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda n: F.concat(F.lit("<sitemap><loc>https://"), F.col("site"), F.lit("/part-"), n.cast("string"), F.lit(".xml</loc></sitemap>"))), "")
    index = parts.filter(~whole).groupBy("site").agg(F.concat(F.lit("<sitemapindex>"), inner, F.lit("</sitemapindex>")).alias("body")).select("site", F.concat(F.lit("https://"), F.col("site"), F.lit("/sitemap.xml")).alias("url"), F.lit(200).alias("status_code"), "body")
    roots = hosted(pages).select("site").distinct().select("site", F.concat(F.lit("https://"), F.col("site"), F.lit("/sitemap.xml")).alias("url"), F.lit(0).alias("pos"))
    return files.unionByName(index), roots


#: Two pages of each host for the rules of entities, clarity and freshness, by ``length(site) % 3``.
_ORG = """'<script type="application/ld+json">{"@type":"Organization","name":"Org ' || CAST(length(site) AS VARCHAR(20)) || '","foundingDate":"' || CAST(1950 + length(site) AS VARCHAR(20)) || '-05-01","telephone":"+44 20 7946 0958","email":"team@org.io","address":{"addressLocality":"Leeds","addressCountry":"UK"}}</script>'"""
BRANDS = {
    0: f"""'<html><head><title>Home</title><meta name="description" content="Org is software that plans the flights of kites for makers.">' || {_ORG} || '</head><body><h1>Welcome</h1><p>Org provides software for makers of kites and is based in Leeds.</p><img src="/growth-chart.png" alt="chart"></body></html>'""",
    1: """'<html><head><title>Kites of wind</title><meta property="og:site_name" content="Maker ' || CAST(length(site) AS VARCHAR(20)) || '"></head><body><h1>Kites for all winds</h1><p>We offer world-class solutions and seamless experience and unmatched quality for all.</p></body></html>'""",
    2: """'<html><head><title>Home</title></head><body><h1>Welcome</h1><p>Write to hello@kites.io or call.</p><footer class="footer">© 2019 Holder ' || CAST(length(site) AS VARCHAR(20)) || '!</footer></body></html>'""",
}
_NEWS = """'<html><head><title>News of kites</title><meta property="article:published_time" content="2019-03-04"></head><body><h1>News</h1><p>Nothing new.</p></body></html>'"""


def brand_pages(pages: DataFrame) -> DataFrame:
    """A home page and a news page of each host."""
    hosts = pages.select(urls.host(F.col("url")).alias("site")).distinct()
    home = hosts.selectExpr("site", "CAST(1 AS BIGINT) AS page_id", "'https://' || site || '/' AS url", f"{_variant('length(site) % 3', list(BRANDS.values()))} AS html", "0 AS crawl_depth")
    return home.unionByName(hosts.selectExpr("site", "CAST(2 AS BIGINT) AS page_id", "'https://' || site || '/blog/news' AS url", f"{_NEWS} AS html", "1 AS crawl_depth"))


#: Statements added to texts by ``doc_id % 11``; the place of a page by ``doc_id % 6``.
_N = lambda e: f"CAST({e} AS VARCHAR(20))"
STATEMENTS = [
    f"'Kites were founded in ' || {_N('1980 + doc_id % 3')} || ' and grew.'", "'Google was founded in 1998.'", "'The company is headquartered in ' || CASE doc_id % 4 WHEN 0 THEN 'New York' WHEN 1 THEN 'NYC' WHEN 2 THEN 'Leeds' ELSE 'York' END || '. It has offices in Paris, France.'",
    "'The user is located in Berlin. Governed by local law.'", f"'Plans start at $' || {_N('10 + doc_id % 4')} || '.50 for the starter tier. Chargeback fee: $15 per month.'", f"'Membership INR 1,' || {_N('100 + doc_id % 3')} || ' per month, starting from 20 EUR.'",
    f"'Write to Hello.' || {_N('doc_id % 5')} || '@' || coalesce(source, 'none') || '.org or logo@' || coalesce(source, 'none') || '.png today.'", f"'Call +1 555 010 ' || {_N('1000 + doc_id % 3')} || ' or 555-010-' || {_N('1000 + doc_id % 3')} || ' now.'",
    f"'Trusted by ' || {_N('100 + doc_id % 3')} || ' customers worldwide. On May 15 20 users came.'", "'Hertz unifies 160 countries. See how Acme serves 12 partners.'", f"'Since ' || {_N('2001 + doc_id % 4')} || ', est. 1776 and est. ' || {_N('1990 + doc_id % 3')} || '.'",
]
PATHS = ["/", "/about/", "/blog/post/", "/legal/terms", "/pricing", "/en-us/about/us"]
TEXTS = {
    "site": "coalesce(source, '')", "page_id": "doc_id", "url": f"'https://' || coalesce(source, 'none') || '.org' || {_variant('doc_id % 6', [repr(p) for p in PATHS])}",
    "text": f"{_variant('doc_id % 11', STATEMENTS)} || chr(10) || coalesce(text, '')",
}


def fact_texts(documents: DataFrame) -> DataFrame:
    """``site, page_id, url, text``: each whole document after a statement or two, its source being the site."""
    return documents.filter("doc_id IS NOT NULL").selectExpr(*[f"{e} AS {c}" for c, e in TEXTS.items()])


#: JSON documents by ``page_id % 6``: an object, a list, a graph, broken text, a number, a list of types.
JSON = [
    """'{"@type":"Organization","name":"N' || CAST(page_id AS VARCHAR(20)) || '","sameAs":["https://a.io/' || CAST(page_id AS VARCHAR(20)) || '","https://b.io"]}'""",
    """'[{"@type":"Product","name":"P"},3,{"@type":"Offer","sameAs":"https://c.io"}]'""", """'{"@context":"x","@graph":[{"@type":"Person","name":"G"},"no",{"name":"untyped"}]}'""", """'{"@type":"Broken'""", "'17'", """'{"@type":["Corporation","Thing"],"name":null}'""",
]


def json_documents(pages: DataFrame) -> DataFrame:
    """``page_id, text``: a JSON document for each page."""
    return pages.selectExpr("page_id", f"{_variant('page_id % 6', JSON)} AS text")


#: Where an address of a host sends to, by page: ``/h<k>`` to ``/h<k + 1>`` and so on; see ``redirect_hops``.
def redirect_hops(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Addresses ``site, url`` (``/h0`` to ``/h11`` of each host) and hops ``site, url, location``.

    h0 to h3 go on one by one to h4, which ends; h5 and h6 send to each other; h7 sends to a private host; h8 to h9 by a full
    address; of a host with an even length of name h10 begins a chain of seven hops by relative addresses; h11 stays.
    """
    hosts = pages.select(urls.host(F.col("url")).alias("site")).distinct()
    at = lambda k: F.concat(F.lit("https://"), F.col("site"), F.lit(f"/{k}"))
    starts = hosts.select("site", F.explode(F.array(*[at(f"h{k}") for k in range(12)])).alias("url"))
    pairs = [(f"h{k}", f"/h{k + 1}") for k in range(4)] + [("h5", "/h6"), ("h6", "h5"), ("h7", "http://10.0.0.1/x")]
    long = [("h10", "c1"), *[(f"c{k}", f"c{k + 1}") for k in range(1, 7)]]
    some = lambda ps: F.array(*[F.struct(at(a).alias("url"), F.lit(b).alias("location")) for a, b in ps])
    hops = hosts.select("site", F.explode(F.concat(some(pairs), F.array(F.struct(at("h8").alias("url"), at("h9/").alias("location"))), F.filter(some(long), lambda x: F.length("site") % 2 == 0))).alias("h"))
    return starts, hops.select("site", "h.url", "h.location")

"""Small sites of our own that make every rule fire, for queries that the synthetic pages can't feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_MENU = '<nav><a href="/">Home</a><a href="/pricing">Pricing</a><a href="/about">About</a></nav>'
_LONG = " ".join(f"word{i}" for i in range(260))
_ORG = '{"@type":"Organization","name":"Northwind Kites","foundingDate":"2004-05-01","telephone":"+44 20 7946 0958","address":{"addressLocality":"Leeds","addressCountry":"UK"},"sameAs":["https://github.com/northwind"]}'

#: site, page_id, url, html, status_code, allowed_by_robots, original_url, redirect_chain, crawl_depth, rendered_html
PAGES = [
    ("kites.io", 1, "https://kites.io/", f'<html><head><title>Northwind Kites | Home</title><meta name="description" content="Northwind Kites is software that plans flights for makers of kites."><link rel="canonical" href="https://kites.io/"><script type="application/ld+json">{_ORG}</script></head><body>{_MENU}<h1>Northwind Kites</h1><p>Northwind Kites provides software for makers of kites and was founded in 2004.</p><a href="/signup">Get started</a><p>Write to hello@kites.io.</p></body></html>', 200, True, None, [], 0, None),
    ("kites.io", 2, "https://kites.io/pricing", f'<html><head><title>Pricing</title><link rel="canonical" href="http://kites.io/pricing"></head><body>{_MENU}<h1>Pricing</h1><h3>Plans</h3><p>Plans start at $20 per month for one maker of kites.</p></body></html>', 200, True, None, [], 1, None),
    ("kites.io", 3, "https://kites.io/about", f'<html><head><title>About</title><link rel="canonical" href="https://other.org/about"></head><body>{_MENU}<h1>About</h1><h1>History</h1><p>We were founded in 2009 and are headquartered in Paris, France. We serve 500 customers.</p><img src="/growth-chart.png" alt="chart"></body></html>', 200, True, "https://kites.io/old-about", ["https://kites.io/old-about", "https://kites.io/about"], 1, None),
    ("kites.io", 4, "https://kites.io/blog/news", f'<html><head><title>News</title><meta property="article:published_time" content="2019-03-04"></head><body><h1>News of 2019</h1><p>{_LONG}</p><footer class="footer">© 2019 Northwind Kites</footer></body></html>', 200, True, None, [], 2, None),
    ("kites.io", 5, "https://kites.io/gone", "", 404, True, None, [], 1, None),
    ("kites.io", 6, "https://kites.io/loop", f"<html><head><title>Loop</title></head><body>{_MENU}<p>We offer world-class solutions and seamless experience and unmatched quality for makers of kites.</p></body></html>", 200, True, None, ["https://kites.io/a", "https://kites.io/b", "https://kites.io/a", "https://kites.io/loop"], 2, None),
    ("home.dev", 1, "https://home.dev/", '<html><head><title>Home</title></head><body><h1>Welcome</h1><a href="/x">here</a><a href="/y">more</a></body></html>', 200, True, None, [], 0, None),
    ("home.dev", 2, "https://home.dev/x/deep", "<html><head><title>X</title></head><body><p>Short.</p></body></html>", 200, False, None, [], 1, None),
    ("home.dev", 3, "https://home.dev/y/deep", "", None, True, None, [], 1, None),
    ("home.dev", 4, "https://home.dev/app", '<html><head><title>Application</title><meta name="robots" content="noindex"></head><body><div id="root"></div><script src="/static/js/main.abc.js"></script></body></html>', 500, True, None, [], 1, "<html><head><title>Application</title></head><body><h1>App</h1><p>" + "rendered text " * 20 + "</p></body></html>"),
    ("docs.kites.io", 1, "https://docs.kites.io/en/", '<html><head><title>Kites Docs</title></head><body><h1>Kite manual</h1><a href="https://docs.kites.io/en/start">Start here now</a></body></html>', 200, True, None, [], 0, None),
    ("docs.kites.io", 2, "https://docs.kites.io/en/start", '<html><head><title>Start guide</title></head><body><h1>Start guide</h1><a href="https://docs.kites.io/en/">Home</a><p>Offices are in Berlin, Germany. Call 555-010-4477.</p></body></html>', 200, True, None, [], 1, None),
    ("docs.kites.io", 3, "https://docs.kites.io/de/", "<html><head><title>Kites Handbuch</title></head><body><h1>Handbuch</h1></body></html>", 200, True, None, [], 1, None),
]
_PAGES = "site string, page_id long, url string, html string, status_code int, allowed_by_robots boolean, original_url string, redirect_chain array<string>, crawl_depth int, rendered_html string"

URLS = [
    "HTTPS://Example.COM/Path/", "example.com", "http://example.com:80/a?b=1#c", "https://user@example.com:8443/x/", "https://example.com/a;p=1", "ftp://example.com", "mailto:a@b.c", "http://localhost/x",
    "http://10.1.2.3/", "http://8.8.8.8/dns/", "https://shop.example", "http://[::1]/", "http://[2606:4700::1111]/x", "   ", "https://www.adobe.com/in/products", "https://www.adobe.com/ae_ar/", "https://docs.python.org/3", "//cdn.example.com/lib.js",
    "https://example.com//", "http://example.com:99999/", "http://172.16.0.9", "http://172.32.0.9", "example.com:8080",
]

ROBOTS = [("kites.io", 200, "# rules\nUser-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow: /*.pdf$\n\nUser-agent: WebquarryBot\nUser-agent: otherbot\nDisallow: /secret\nDisallow: /blog\nAllow: /blog/news\nCrawl-delay: 12\nSitemap: https://kites.io/sitemap.xml", None), ("home.dev", 404, None, None), ("docs.kites.io", 500, None, "timeout")]
SITEMAPS = [
    ("kites.io", "https://kites.io/sitemap.xml", 200, '<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>https://kites.io/pages.xml</loc></sitemap></sitemapindex>'),
    ("kites.io", "https://kites.io/pages.xml", 200, '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://kites.io/</loc></url><url><loc>https://kites.io/pricing/</loc></url><url><loc>https://kites.io/about</loc></url></urlset>'),
    ("docs.kites.io", "https://docs.kites.io/sitemap.xml", 200, "<urlset><url><loc>https://docs.kites.io/en/</loc></url><broken"),
]
FETCHED = [("kites.io", 1, "https://kites.io/", None, False, 200), ("kites.io", 5, "https://kites.io/gone", None, False, 404), ("home.dev", 3, "https://home.dev/y/deep", "timeout", False, None), ("home.dev", 4, "https://home.dev/app", None, True, 500)]

FACTS = [
    ("a.io", 1, "founding_year", "2001", "2001", 2001.0, None, None, "https://a.io/", "founded in 2001", 0.92), ("a.io", 2, "founding_year", "2003", "2003", 2003.0, None, None, "https://a.io/about", "since 2003", 0.92), ("a.io", 3, "founding_year", "2001", "2001", 2001.0, None, None, "https://a.io/team", "since 2001", 0.98),
    ("a.io", 4, "headquarters", "New Delhi", "new delhi", None, None, None, "https://a.io/", "based in New Delhi", 0.85), ("a.io", 5, "headquarters", "Delhi, India", "delhi india", None, None, None, "https://a.io/about", "based in Delhi, India", 0.85),
    ("a.io", 6, "price", "$10", "10.00 USD", 10.0, "USD", None, "https://a.io/p", "starts at $10", 0.88), ("a.io", 7, "price", "$12", "12.00 USD", 12.0, "USD", None, "https://a.io/q", "starts at $12", 0.88), ("a.io", 8, "price", "$90", "90.00 USD", 90.0, "USD", "plan", "https://a.io/r", "annual plan starts at $90", 0.88), ("a.io", 9, "price", "$9", "9.00 USD", 9.0, "USD", "plan", "https://a.io/s", "monthly plan starts at $9", 0.88),
    ("a.io", 10, "email", "x@a.io", "x@a.io", None, None, None, "https://a.io/", "x@a.io", 0.95), ("a.io", 11, "email", "y@a.io", "y@a.io", None, None, None, "https://a.io/c", "y@a.io", 0.95),
    ("a.io", 12, "phone", "+1 555 010 9999", "15550109999", None, None, None, "https://a.io/", "call", 0.89), ("a.io", 13, "phone", "555-010-9999", "5550109999", None, None, None, "https://a.io/c", "call", 0.89),
    ("a.io", 14, "metric", "500 customers", "500 customers", None, None, None, "https://a.io/", "500 customers", 0.86), ("a.io", 15, "metric", "900 customers", "900 customers", None, None, None, "https://a.io/c", "900 customers", 0.86), ("a.io", 16, "metric", "20 countries", "20 countries", None, None, None, "https://a.io/d", "20 countries", 0.86),
    ("b.io", 1, "phone", "111-111-1111", "1111111111", None, None, None, "https://b.io/de/", "call", 0.89), ("b.io", 2, "phone", "222-222-2222", "2222222222", None, None, None, "https://b.io/fr/", "call", 0.89), ("b.io", 3, "organization_name", "Bee Inc", "bee inc", None, None, None, "https://b.io/de/", "Bee Inc", 0.95), ("b.io", 4, "organization_name", "Bee GmbH", "bee gmbh", None, None, None, "https://b.io/fr/", "Bee GmbH", 0.95),
]

#: Severity counts of stored reports with the scores and grades that they state: critical, high, medium, low, score, grade.
SCORES = [("fastapi", 0, 1, 4, 1, 73.0, "C"), ("python", 0, 1, 5, 3, 67.0, "D"), ("verge 1", 0, 3, 3, 1, 57.0, "F"), ("verge 2", 0, 2, 3, 1, 67.0, "D"), ("mozilla", 0, 1, 8, 1, 57.0, "F"), ("notion", 0, 3, 5, 0, 50.0, "F"), ("mit", 0, 3, 8, 1, 37.0, "F"), ("floor", 3, 3, 0, 0, 0.0, "F"), ("none", 0, 0, 0, 0, 100.0, "A")]


def pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAGES, _PAGES)


def robots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROBOTS, "site string, status_code int, raw_text string, error string")


def sitemaps(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SITEMAPS, "site string, url string, status_code int, body string")


def sitemap_roots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("kites.io", "https://kites.io/sitemap.xml", 0), ("docs.kites.io", "https://docs.kites.io/sitemap.xml", 0), ("home.dev", "https://home.dev/sitemap.xml", 0)], "site string, url string, pos int")


def fetched(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FETCHED, "site string, page_id long, url string, error string, is_truncated boolean, status_code int")


def facts(spark: SparkSession) -> DataFrame:
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(FACTS, "site string, n long, fact_type string, raw_value string, canonical_value string, numeric_value double, currency string, fee_category string, source_url string, snippet string, confidence double")
    return rows.withColumn("ord", F.struct(F.col("n").alias("page_id"), F.lit(0).alias("pos"))).drop("n")

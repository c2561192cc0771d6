"""Audits as a whole: crawl and gate, failing skills, broken pages, partitions, report files, redirects, structured data."""

from __future__ import annotations

import json
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

import sites
from webquarry.functions import urls
from webquarry.operators import crawl, relations, structured
from webquarry.plans import audit, catalogue
from webquarry.plans.audit import Options, audit_sites
from webquarry.sources import redirects


def rows(df) -> list[str]:
    return sorted(map(str, df.collect()))


def test_first_pages_keep_null_keys(spark):
    html = "<h1>Head</h1>"
    pages = spark.createDataFrame([(1, "https://a.io/x", html), (2, "https://a.io/x", html), (None, "https://a.io/y", html), (3, None, html), (None, None, None), (4, "https://a.io/z", html), (4, "https://a.io/z", html)], "page_id long, url string, html string")
    got = sorted(((r.page_id, r.url) for r in relations.parse_pages(pages.repartition(3)).collect()), key=str)
    assert got == sorted([(1, "https://a.io/x"), (None, "https://a.io/y"), (3, None), (None, None), (4, "https://a.io/z"), (4, "https://a.io/z")], key=str)
    assert relations.parse_pages(pages.limit(0)).collect() == []


def test_audits_do_not_depend_on_partitions(spark):
    pages = sites.pages(spark).unionByName(spark.createDataFrame([("home.dev", None, None, "<p>x</p>")], "site string, page_id long, url string, html string"), allowMissingColumns=True)
    one, two = (audit_sites(pages.repartition(n)) for n in (1, 7))
    for name in ("findings", "reports", "recommendations"):
        assert rows(getattr(one, name).drop("ord") if name == "findings" else getattr(one, name)) == rows(getattr(two, name).drop("ord") if name == "findings" else getattr(two, name)), name
    assert one.statuses == {"technical": "success", "trust": "success", "engagement": "success"}


def test_a_failing_skill_leaves_the_others(spark, monkeypatch):
    def fail(*_):
        raise ValueError("no rules")

    monkeypatch.setattr(audit.trust, "clarity_findings", fail)
    made = audit_sites(sites.pages(spark))
    assert made.statuses["trust"].startswith("error: ValueError") and {r.status for r in made.reports.collect()} == {"partial_failure"}
    assert {r.skill for r in made.findings.select("skill").distinct().collect()} == {"technical", "engagement"}


def test_a_failing_skill_ends_queries(spark, monkeypatch, tmp_path):
    def fail(*_):
        raise ValueError("no rules")

    sites.pages(spark).select("page_id", "url", "html").write.parquet(str(tmp_path / "pages.parquet"))
    monkeypatch.setattr(audit.trust, "clarity_findings", fail)
    for name in ("audit_findings", "audit_recommendations", "full_audit", "json_reports", "markdown_reports"):
        with pytest.raises(ValueError, match="no rules"):
            catalogue.QUERIES[name](spark, str(tmp_path))


def test_broken_pages_are_told(spark, monkeypatch):
    empty = audit_sites(spark.createDataFrame([], "page_id long, url string, html string"))
    assert empty.reports.collect() == [] and empty.findings.collect() == [] and empty.broken.collect() == []


def test_crawl_gate_and_files(spark, tmp_path):
    made = audit_sites(sites.pages(spark), Options(max_pages=2, max_depth=1), robots=sites.robots(spark), sitemaps=(sites.sitemaps(spark), sites.sitemap_roots(spark)))
    seen = {(r.site, r.url): r.crawl_depth for r in made.pages.collect()}
    assert seen == {("kites.io", "https://kites.io/"): 0, ("kites.io", "https://kites.io/pricing"): 1, ("home.dev", "https://home.dev/"): 0, ("docs.kites.io", "https://docs.kites.io/en/"): 0, ("docs.kites.io", "https://docs.kites.io/en/start"): 1}
    assert {(r.site, r.code) for r in made.site_issues.collect()} == {("docs.kites.io", "ROBOTS_TXT_NOT_FOUND"), ("home.dev", "ROBOTS_TXT_NOT_FOUND"), ("home.dev", "SITEMAP_NOT_FOUND"), ("kites.io", "HIGH_CRAWL_DELAY")}
    audit.write_reports(made, str(tmp_path / "json"))
    audit.write_reports(made, str(tmp_path / "md"), "markdown")
    for site in ("kites.io", "home.dev", "docs.kites.io"):
        (one,) = (tmp_path / "json" / f"site={site}").glob("part-*")
        assert json.loads(one.read_text())["site"] == site
        (two,) = (tmp_path / "md" / f"site={site}").glob("part-*")
        assert two.read_text().startswith(f"# Audit of {site}\n\nScore ")


def test_gate_without_a_crawl(spark):
    made = audit_sites(sites.pages(spark), Options(skills=("technical",)), robots=sites.robots(spark))
    shut = made.pages.filter("NOT allowed_by_robots").select("url").collect()
    assert {r.url for r in shut} == {"https://home.dev/x/deep"} and made.statuses["trust"] == "skipped"


@pytest.mark.parametrize("base", ["https://a.io/x/y", "https://a.io", "http://b.org/p/q/r/", "https://a.io/?z=1"])
def test_references_resolve_like_the_library(spark, base):
    refs = ["/h", "h", "./h", "../h", "../../../h", "?a=1", "#f", "//c.io/k", "https://d.io/e", "mailto:x@y.z", "h/../i/.", "a/b?c=/d", "..", "."]
    got = spark.createDataFrame([(r,) for r in refs], "r string").select("r", urls.resolve(F.lit(base), F.col("r")).alias("u")).collect()
    assert {r.r: r.u for r in got} == {r: urljoin(base, r) for r in refs}


def test_redirects(spark):
    hops = spark.createDataFrame([("s", "https://a.io/1", "/2"), ("s", "https://a.io/1", "/3"), ("s", "https://a.io/2/", "https://b.io"), ("s", "https://a.io/l", "/l"), ("s", "https://a.io/p", "http://localhost/"), ("s", None, "x"), ("t", "https://a.io/9", "/1")], "site string, url string, location string")
    starts = spark.createDataFrame([("s", f"https://a.io/{k}") for k in ("1", "l", "p", "9")] + [("s", None)], "site string, url string")
    got = {r.url: (r.final_url, r.redirect_chain, r.outcome) for r in redirects.resolve(starts, hops).collect()}
    assert got == {
        "https://a.io/1": ("https://b.io", ["https://a.io/1", "https://a.io/2", "https://b.io"], "ok"), "https://a.io/l": ("https://a.io/l", ["https://a.io/l", "https://a.io/l"], "loop"),
        "https://a.io/p": ("https://a.io/p", [], "private"), "https://a.io/9": ("https://a.io/9", [], "ok"), None: (None, [], "ok"),
    }
    assert redirects.resolve(starts.limit(0), hops).collect() == [] and len(redirects.resolve(starts, hops.limit(0)).collect()) == 5


def test_structured_data_edges(spark):
    texts = [None, "", "{", "[]", "null", '"x"', '{"@graph": 3}', '{"@graph": []}', '[[{"@type":"T"}]]', '{"@type":"T","sameAs":5}']
    got = structured.structured(spark.createDataFrame(list(enumerate(texts)), "k int, text string")).collect()
    assert sorted((r.k, r.pos, r.type, r.sites) for r in got) == [(6, 0, None, []), (9, 0, "T", ["5"])]


def test_crawl_places_do_not_depend_on_partitions(spark):
    """Links of a seed tie with links of the page at the seed's number: the shorter address comes first."""
    link = lambda r: "".join(f'<a href="https://a.io/p{k}">p{k}</a>' for k in (2 * r, 2 * r + 1))
    url = lambda r: f"https://a.io/p{r}" if r > 1 else "https://a.io/"
    # Pages 4 and 5 are missing, so that the ties are within the budget.
    pages = spark.createDataFrame([(r, url(r), link(r)) for r in range(1, 20) if r not in (4, 5)], "page_id long, url string, html string")
    roots, seeds = spark.createDataFrame([("a.io", url(1))], "site string, url string"), spark.createDataFrame([("a.io", 1, url(9))], "site string, pos int, url string")
    want = [url(r).rstrip("/") for r in (1, 9, 2, 3, 6, 18, 7, 19)]
    for n in (1, 5):
        seen = crawl.crawl(relations.parse_pages(pages.orderBy(F.desc("page_id")).repartition(n)), roots, seeds=seeds)
        assert [r.canonical for r in seen.orderBy("place").collect()] == want

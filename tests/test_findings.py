"""Findings: equivalence, order, evidence, status; results don't depend on the number of partitions."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

import sites
from webquarry.operators import consistency, findings as fnd, relations, trust
from webquarry.plans.audit import known_urls, raw_findings


def test_score_formula(spark):
    rows = spark.createDataFrame([r[:5] for r in sites.SCORES], "name string, critical long, high long, medium long, low long")
    assert [(r.overall_score, r.grade) for r in fnd.scored(rows).collect()] == [(r[5], r[6]) for r in sites.SCORES]


def test_overall_status(spark):
    cases = [(["success", "success"], "success"), (["error: x", "success"], "partial_failure"), (["failed", "skipped: inspection failure"], "error")]
    rows = spark.createDataFrame([(c,) for c, _ in cases], "s array<string>")
    assert [r[0] for r in rows.select(fnd.overall_status(F.col("s"))).collect()] == [w for _, w in cases]


@pytest.fixture(scope="module")
def raw(spark):
    page = relations.parse_pages(sites.pages(spark)).persist()
    return page, raw_findings(page)[0].persist()


def test_equivalent_findings_merge_once(raw):
    page, found = raw
    once = fnd.deduplicated(fnd.validated(found, known_urls(page))).persist()
    ids = {(r.site, r.id) for r in once.select("site", "id").collect()}
    assert ("kites.io", "TECH-MULTIPLE_H1") in ids and ("kites.io", "ENG-006") not in ids
    again = fnd.deduplicated(once)
    key = lambda df: sorted(map(tuple, df.select("site", "id", "severity", "confidence", F.array_join("affected_urls", " "), "evidence").collect()))
    assert key(once) == key(again)


def test_hot_sites_keep_all_strings(spark):
    """More than 1000 links, and offerings of which the services come last."""
    links = [(1, [f"u{i}" for i in range(700)]), (2, [f"u{i}" for i in range(600, 1500)])]
    page = spark.createDataFrame([("a", n, x, [f"Kite {i}" for i in range(1200)] + ["Kite Consulting"]) for n, x in links], "site string, page_id long, social_links array<string>, offerings array<string>")
    assert trust._first_strings(page, "social_links").first().all_social_links == [f"u{i}" for i in range(1500)]
    assert trust._first_offerings(page).first().all_offerings == [*[f"Kite {i}" for i in range(8)], "Kite Consulting"]


def test_evidence_is_joined_as_texts_come():
    def plain(texts):
        out = ""
        for e in dict.fromkeys(texts):
            out = e if out == "" else out if e in out else f"{out} | {e}"
        return out

    rng = random.Random(1)
    for _ in range(300):
        texts = ["".join(rng.choices("ab |", k=rng.choice([0, 1, 5, 17, 40]))) for _ in range(rng.randint(0, 8))]
        whole = " | ".join(texts)
        texts += [whole[i : i + rng.randint(1, 50)] for i in (rng.randint(0, len(whole)) for _ in range(8))]
        assert fnd.joined_evidence(texts) == plain(texts)
    assert fnd.joined_evidence(["a", None]) is None


def test_many_pages_of_one_finding_merge_in_proportion(spark):
    url = F.concat(F.lit("https://x.org/"), (F.col("page_id") * 7919 % 10000019).cast("string"), F.lit("/a-page-of-the-site"))
    rows = spark.range(60_000).select(F.lit("x.org").alias("site"), F.col("id").alias("page_id")).withColumn("url", url)
    found = fnd.made(rows, fnd.order(3, 10, F.col("page_id")), "engagement", "ENG-009", "engagement", "t", "medium", 0.9, F.concat(F.lit("no links to "), F.col("url")), F.array("url"), "a")
    began = time.monotonic()
    got = fnd.deduplicated(found).select(F.size(F.split("evidence", r" \| ")).alias("n"), F.size("affected_urls").alias("urls")).collect()
    assert [tuple(r) for r in got] == [(60_000, 60_000)]
    assert time.monotonic() - began < 25


def test_facts_of_pages_are_found_once(spark, monkeypatch):
    asked = []
    real = consistency.consistency_findings
    monkeypatch.setattr(consistency, "consistency_findings", lambda told: asked.append(told) or real(told))
    raw_findings(relations.parse_pages(sites.pages(spark)))
    (told,) = asked
    assert "regexp_replace" not in told._jdf.queryExecution().toString()


def test_pages_are_parsed_once(spark):
    plan = relations.parse_pages(sites.pages(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_pages_of_one_url_and_without_one(spark):
    rows = [(3, "https://a.org/x"), (2, "https://a.org/x"), (2, "https://a.org/x"), (None, "https://a.org/x"), (None, "https://a.org/y"), (5, None), (None, None)]
    pages = spark.createDataFrame([(i, u, "<p>text</p>") for i, u in rows], "page_id long, url string, html string")
    got = sorted(map(str, relations.parse_pages(pages, 3).select("page_id", "url").collect()))
    assert got == sorted(f"Row(page_id={i}, url={u!r})" for i, u in [(2, "https://a.org/x"), (2, "https://a.org/x"), (None, "https://a.org/y"), (5, None), (None, None)])

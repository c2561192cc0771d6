"""Facts, their clusters and contradictions, numbering: against hand-written cases and plain folds."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from webquarry.operators import consistency, facts
from webquarry.operators.numbering import numbered

PAGE = "site string, page_id long, url string, text string, meta_site_name string, json_ld array<string>"


def found(spark, url: str | None, text: str | None, name: str | None = None, json_ld: list[str] | None = None) -> list:
    df = spark.createDataFrame([("s", 1, url, text, name, json_ld)], PAGE)
    return sorted(facts.facts(df).collect(), key=lambda r: r.ord)


def values(rows: list) -> list[tuple[str, str]]:
    return [(r.fact_type, r.canonical_value) for r in rows]


def test_prices(spark):
    raw = [("$999", "999.00 USD"), ("INR 999", "999.00 INR"), ("Rs. 1,999", "1999.00 INR"), ("99.00 EUR", "99.00 EUR"), ("£5", "5.00 GBP"), ("C$5", "5.00 USD"), ("none", None)]
    df = spark.createDataFrame([(r,) for r, _ in raw], "r string")
    got = df.select(F.when(facts.amount(F.col("r")).isNotNull(), F.format_string("%.2f %s", facts.amount(F.col("r")), facts.currency(F.col("r"))))).collect()
    assert [r[0] for r in got] == [w for _, w in raw]


def test_normal_forms(spark):
    row = spark.range(1).select(facts.year(F.lit("est. 1776")), facts.year(F.lit("since 2004")), facts.location(F.lit("NYC, US")), facts.location(F.lit("x")), facts.digits(F.lit("12-34")), facts.digits(F.lit("+1 (555) 010-9999"))).first()
    assert tuple(row) == (None, "2004", "new york city us", None, None, "15550109999")


def test_pages_and_third_parties(spark):
    assert values(found(spark, "https://acme.io/", "We serve 500 customers. Hertz unifies 160 countries.")) == []
    assert values(found(spark, "https://acme.io/", "Today 500 customers use it.")) == [("metric", "500 customers")]
    assert values(found(spark, "https://hertz.io/", "Hertz unifies 160 countries.")) == [("metric", "160 countries")]
    assert values(found(spark, "https://acme.io/blog/x", "The shop was founded in 1999 by friends.")) == []
    assert values(found(spark, "https://acme.io/about", "Acme was founded in 1999 by friends.")) == [("founding_year", "1999")]
    assert values(found(spark, "https://acme.io/a", "Google was founded in 1998 by friends.")) == []
    assert values(found(spark, "https://acme.io/legal/terms", "Offices are in Paris.")) == []
    assert values(found(spark, "https://acme.io/a/b/c", "We are based in Paris.")) == [] and values(found(spark, "https://acme.io/a", "We are based in Paris.")) == [("headquarters", "paris")]
    assert values(found(spark, "https://acme.io/", "On May 15 20 customers came. Ask the 3 Users here")) == [("metric", "3 users")]


def test_windows_overlap_and_are_cut(spark):
    text = "x" * 70 + " mail a@b.io and c@d.io " + "y" * 90
    a, b = found(spark, "https://acme.io/", text)
    assert (a.raw_value, b.raw_value) == ("a@b.io", "c@d.io")
    for r in (a, b):
        at = text.index(r.raw_value)
        assert r.snippet == f"...{text[at - 60 : at + 6 + 60].strip()}..."
    (c,) = found(spark, "https://acme.io/", "😀 a@b.io\x01\x02\x03!")
    assert c.snippet == "😀 a@b.io   !"


def test_fees_beside_prices(spark):
    rows = found(spark, "https://acme.io/", "Chargeback: $15 per month for you. Starter plan $5/mo. No more $7/mo.\n")
    assert [(r.canonical_value, r.fee_category) for r in rows] == [("15.00 USD", "dispute"), ("5.00 USD", "plan"), ("7.00 USD", "dispute")]


def test_json_ld(spark):
    documents = [
        '{"@type": ["X", "Corporation"], "name": " Bee Inc ", "foundingDate": "1999-01-02", "address": {"addressLocality": "NYC", "addressCountry": "US"}, "telephone": "+1 555 010 1000", "email": " Me@A.io "}',
        '{"@type": "Organization", "name": 5, "foundingYear": 2004, "address": "Paris, FR", "telephone": "12"}', "{oops", "3", "", '{"name": "no", "address": {}}',
    ]
    rows = found(spark, "https://acme.io/", None, None, documents)
    assert [(r.fact_type, r.raw_value, r.canonical_value, r.confidence) for r in rows] == [
        ("organization_name", "Bee Inc", "bee inc", 0.95), ("founding_year", "1999-01-02", "1999", 0.98), ("headquarters", "NYC,  US", "new york city us", 0.96), ("phone", "+1 555 010 1000", "15550101000", 0.98),
        ("email", "me@a.io", "me@a.io", 0.98), ("founding_year", "2004", "2004", 0.98), ("headquarters", "Paris, FR", "paris fr", 0.95),
    ]


def test_edges(spark):
    assert found(spark, None, "a@b.io")[0].canonical_value == "a@b.io" and found(spark, "https://a.io/", None) == [] and found(spark, None, None) == []
    assert facts.facts(spark.createDataFrame([], PAGE)).collect() == []
    assert len(found(spark, "https://a.io/", "word " * 200_000 + "a@b.io")) == 1


FACTS = "site string, ord struct<page_id:long,pos:int>, fact_type string, raw_value string, canonical_value string, numeric_value double, currency string, fee_category string, source_url string, snippet string, confidence double"


def random_facts(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.choice(["founding_year", "headquarters", "price", "email", "phone", "metric", "organization_name"])
        number = currency = fee = None
        if kind == "founding_year":
            number = float(rng.randint(1990, 1995))
            value = str(int(number))
        elif kind == "headquarters":
            value = " ".join(rng.choice("abcdefghijkl") for _ in range(rng.choice([0, 1, 1, 2, 3]) if seed % 2 else rng.choice([1, 2])))
        elif kind == "price":
            number = rng.choice([1.0, 1.01, 1.02, 1.005, 1.014, 2.0, 0.01, 0.02])
            currency, fee = rng.choice(["USD", "EUR"]), rng.choice([None, "plan"])
            value = f"{number:.2f} {currency}"
        elif kind == "email":
            value = f"{rng.choice('abc')}@x.io"
        elif kind == "phone":
            value = rng.choice(["", "1", "49"]) + rng.choice(["5550100", "15550100", "7770100"])
        elif kind == "metric":
            value = rng.choice(["5 users", "5 Users", "6 users"])
        else:
            value = rng.choice(["bee inc", "bee", "ant llc", "inc", "ant bee co", "cat"])
        out.append((f"s{rng.randint(0, 1)}", {"page_id": i // 3, "pos": i % 3}, kind, value, value, number, currency, fee, f"https://s.io/{i % 5}", f"text of {value}", 0.9))
    return out


def agree(kind: str, a: tuple, b: tuple) -> bool:
    x, y = (set(re.findall(r"\w+", v[4].lower())) for v in (a, b))
    if kind == "price":
        return a[6] == b[6] and a[7] == b[7] and abs(a[5] - b[5]) <= 0.01
    if kind == "headquarters":
        return not x or not y or bool(x & y)
    if kind == "organization_name":
        x, y = x - {"inc", "llc", "co"}, y - {"inc", "llc", "co"}
        return bool(x & y) or a[4] == b[4]
    if kind == "phone":
        return a[4].endswith(b[4]) or b[4].endswith(a[4])
    return kind == "email" or a[4].lower() == b[4].lower()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clusters_are_those_of_a_fold(spark, seed):
    rows = random_facts(seed, 260)
    firsts: dict[tuple, list[tuple]] = {}
    want = {}
    for r in sorted(rows, key=lambda r: (r[1]["page_id"], r[1]["pos"])):
        led = firsts.setdefault((r[0], r[2]), [])
        n = next((k for k, f in enumerate(led) if agree(r[2], f, r)), len(led))
        if n == len(led):
            led.append(r)
        want[(r[0], r[2], r[1]["page_id"], r[1]["pos"])] = (n, led[n][4])
    got = consistency.clusters(spark.createDataFrame(rows, FACTS).repartition(5)).collect()
    assert len(got) == len(rows)
    assert {(r.site, r.fact_type, r.ord.page_id, r.ord.pos): (r.cluster, r.first_value) for r in got} == want


def test_chains_of_places_take_turns(spark):
    rows = [("s", {"page_id": k, "pos": 0}, "headquarters", "", f"w{k} w{k + 1}", None, None, None, "u", "", 0.9) for k in range(7)]
    got = {r.ord.page_id: r.cluster for r in consistency.clusters(spark.createDataFrame(rows, FACTS)).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 2, 6: 3}
    assert consistency.clusters(spark.createDataFrame([], FACTS)).collect() == []


def test_contradictions(spark):
    def fact(n, kind, value, number=None, currency=None, fee=None, url="a", said=""):
        return ("s", {"page_id": n, "pos": 0}, kind, value, value, number, currency, fee, f"https://s.io/{url}", said, 0.9)

    rows = [
        fact(0, "founding_year", "1999", 1999.0), fact(1, "founding_year", "2001", 2001.0, url="b"), fact(2, "email", "a@s.io"), fact(3, "email", "b@s.io", url="b"), fact(4, "phone", "5550100"), fact(5, "phone", "15550100", url="b"), fact(6, "phone", "7770100", url="c"),
        fact(7, "price", "5.00 USD", 5.0, "USD", said="starter"), fact(8, "price", "9.00 USD", 9.0, "USD", url="b", said="premium"), fact(9, "metric", "5 users"), fact(10, "metric", "9 clients", url="b"), fact(11, "metric", "7 users", url="b"),
        fact(12, "headquarters", "paris", url="en-us/a"), fact(13, "headquarters", "rome", url="fr-fr/a"),
    ]
    got = consistency.consistency_findings(spark.createDataFrame(rows, FACTS)).select("id", "severity", "evidence").orderBy("id").collect()
    assert [(r.id, r.severity) for r in got] == [("CO-001", "high"), ("CO-002", "medium"), ("CO-003", "medium")]
    assert "1999" in got[0].evidence and "7770100" in got[1].evidence and "7 users" in got[2].evidence
    assert {(r.fact_type, r.value) for r in consistency.consensus(spark.createDataFrame(rows, FACTS)).collect()} == {("email", "a@s.io")}
    (s,) = consistency.summary(spark.createDataFrame(rows, FACTS)).collect()
    assert (s.total_fact_types, s.total_facts_recorded) == (6, 14) and s.fact_types[0] == "founding_year"


def test_numbers_equal_a_window(spark):
    from pyspark.sql import Window

    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.9 else rng.choice(["a", "b", None]), rng.randint(0, 50), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "site string, x int, k int").repartition(6)
    got = numbered(df, ["site"], ["x", "k"], "place")
    want = df.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy("x", "k")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert numbered(df.limit(0), ["site"], ["x"], "place").collect() == []


def test_pairs_of_a_large_group_are_dealt_over_tasks(spark):
    """All contradictions of 600 clusters of phone numbers, which more than one task works out."""
    value = lambda k: f"{5550000 + k}" if k % 3 else f"1{5550001 + k}"  # noqa: E731  every third ends with the next one
    rows = [("s", "phone", k, value(k), None, None, None, {"page_id": k, "pos": 0}, 0.9, [f"https://s.io/{k % 7}"], "", [""], []) for k in range(600)]
    schema = "site string, fact_type string, cluster long, first_value string, first_number double, first_currency string, first_fee string, ord struct<page_id:long,pos:int>, confidence double, urls array<string>, snippets string, locales array<string>, evidence array<struct<raw_value:string,source_url:string>>"
    got = consistency.conflicts(spark.createDataFrame(rows, schema)).withColumn("task", F.spark_partition_id()).select("cluster_a", "cluster_b", "task").collect()
    ends = lambda a, b: value(a).endswith(value(b)) or value(b).endswith(value(a))
    want = {(a, b) for a in range(600) for b in range(a + 1, 600) if a % 7 != b % 7 and not ends(a, b)}
    assert len(got) == len(want) and {(r.cluster_a, r.cluster_b) for r in got} == want
    assert len({r.task for r in got}) > 1

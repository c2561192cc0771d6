"""URL expressions agree with their Python twins and with known cases."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webquarry.functions import urls
import sites


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, u string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("u"))).collect()]


def test_normal_form_equals_python(spark):
    assert column(spark, sites.URLS, urls.normalize) == [urls.py_normalize(u) if not u.startswith("//") else column(spark, [u], urls.normalize)[0] for u in sites.URLS]


def test_nulls(spark):
    assert column(spark, [None, ""], urls.normalize) == [None, None]
    assert column(spark, [None, ""], urls.locale) == [None, None]
    assert column(spark, [None], urls.is_private) == [True]
    assert column(spark, [None], urls.canonical) == [""]


def test_normal_form_is_stable(spark):
    once = [u for u in column(spark, sites.URLS, urls.normalize) if u]
    assert column(spark, once, urls.normalize) == once


def test_locales(spark):
    cases = {"https://www.adobe.com/in/": "in", "/ae_ar/about": "ae_ar", "/cis_en/": "cis_en", "/africa/": "africa", "https://docs.python.org/3": None, "/api/v1/users": None, "https://x.com/en-US/": "en-us", "https://x.com": None}
    assert column(spark, list(cases), urls.locale) == list(cases.values())
    assert column(spark, ["https://x.com/in/", "https://x.com/in/p", "/africa/"], urls.is_locale_root) == [True, False, True]


def test_private_addresses(spark):
    private = ["http://127.0.0.1", "http://192.168.1.1", "http://169.254.1.1", "http://[fe80::1]", "http://[fc00::1]", "http://224.0.0.1", "http://a.internal", "http://192.0.2.9", "http://0.0.0.0"]
    public = ["http://1.1.1.1", "http://example.com", "http://172.15.0.1", "http://[2606:4700::1]", "http://100.200.1.1"]
    assert column(spark, private, urls.is_private) == [True] * len(private)
    assert column(spark, public, urls.is_private) == [False] * len(public)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.from_regex(r"\A(https?://)?[a-z]{1,8}\.(com|org|test)(:[0-9]{1,4})?(/[a-zA-Z0-9;._-]{0,6}){0,3}(\?[a-z=&]{0,5})?(#[a-z]{0,3})?\Z"), min_size=20, max_size=40))
def test_random_urls_equal_python(spark, values):
    assert column(spark, values, urls.normalize) == [urls.py_normalize(u) for u in values]

"""The page parser."""

from __future__ import annotations

from webquarry.functions import markup
from webquarry.functions.page_parser import parse, parse_safely


def test_implied_end_tags():
    page = parse("https://a.io/", "<body><p>One two three four five six seven.<p><b>Eight nine ten eleven twelve thirteen.<br><p>Last")
    assert page["paragraphs"] == ["One two three four five six seven.", "Eight nine ten eleven twelve thirteen."]


def test_empty_and_broken_pages():
    for html in (None, "", "<", "<a href=", "<!-- never closed", "<script>var a = '</p>'", "<title>x", "</p></div>", "a" * 100_000, "<div>" * 3_000, '<a href="http://[::1">x</a>'):
        page = parse_safely("https://a.io/", html)
        assert page["parse_error"] is None, html


def test_comments_scripts_and_references():
    assert parse("https://a.io/", "<body><!-- <h1>no</h1> --><script>'<h1>no</h1>'</script><h1>A &amp; B</h1></body>")["headings"] == [(1, "A & B")]


def test_links_base_and_schemes():
    page = parse("https://a.io/x/", '<base href="/y/"><a href="z">in</a><a href="#t">t</a><a href="mailto:me@a.io">m</a><a href="https://b.org/">out</a><a href="z">in</a>')
    assert [x[0] for x in page["links"]] == ["https://a.io/y/z", "https://b.org"] and [x[2] for x in page["links"]] == [True, False]
    assert page["emails"] == ["me@a.io"]


def test_json_ld_graph_and_malformed():
    html = '<script type="application/ld+json">{"@graph":[{"@type":"Organization","name":"A"}, 3]}</script><script type="application/ld+json">{oops</script>'
    page = parse("https://a.io/", html)
    assert [o["name"] for o in page["organizations"]] == ["A"] and len(page["json_ld"]) == 1


def test_events_are_balanced():
    depth = 0
    for kind, *_ in markup.events("<ul><li>a<li>b<table><tr><td>c<td>d</table></ul><p>x<div>y</p>"):
        depth += (kind == "start") - (kind == "end")
    assert depth == 0


def test_references_without_a_semicolon():
    html = "<title>A &amp; B&amp</title><body><h1>C &quot;D&quot;&lt</h1>&notit; &#x41; &#65 &nope; <a href='/x?a=1&amp;b&lt'>E</a></body>"
    page, closed = parse("https://a.io/", html), parse("https://a.io/", html, closed=True)
    assert (page["title"], page["headings"], page["body_text"]) == ("A & B&", [(1, 'C "D"<')], 'C "D"< ¬it; A A &nope; E')
    assert (closed["title"], closed["headings"], closed["body_text"]) == ("A & B&amp", [(1, 'C "D"&lt')], 'C "D"&lt &notit; A &#65 &nope; E')
    assert markup.attributes("href='/x?a=1&amp;b&lt'", closed=True) == {"href": "/x?a=1&b&lt"}

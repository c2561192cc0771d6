"""WARC round trips and main texts."""

from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from webquarry.llm import warc
from webquarry.llm.html_extract import extract, main_text

SCHEMA = "page_id long, url string, html string, digest string"


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.integers(1, 64), st.integers(20, 300))
def test_records_and_chunks_round_trip(payload, chunk, segment):
    assert warc.dechunked(warc.chunked(payload, chunk)) == payload
    digest = hashlib.sha256(payload).hexdigest()
    archive = b"".join(r + b"\r\n\r\n" for r in warc.records(7, 1, "http://a/\r\nx", payload, digest, None, segment))
    found = list(warc.parse(archive))
    block = b"".join(b for _, b in found)
    assert warc.http_payload(block) == payload
    if len(found) > 1:
        assert [int(f["warc-segment-number"]) for f, _ in found] == [*range(1, len(found) + 1)]
        assert int(found[-1][0]["warc-segment-total-length"]) == len(block)
        assert {f["warc-segment-origin-id"] for f, _ in found[1:]} == {found[0][0]["warc-record-id"]}


def test_round_trip(spark):
    rows = [(1, "u", "a" * 200, "x"), (2, "u", "a" * 200, "x"), (3, None, None, "x"), (None, "x", "a" * 200, "x"), (5, "u", "é" * 100_000, "x"), (7, "u", "short", "x"), (8, "u", "short", "x"), (9, "z", "é" * 100_000, "x"), (10, "w", "WARC/1.1\r\n\r\n\r\n" * 20, "x")]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows) and all(r.verified for r in got.values())
    for i, _, html, _ in rows:
        data = (html or "").encode()
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == hashlib.sha256(data).hexdigest()
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {2: 1, 9: 5}
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
    same = warc.round_trip(spark.createDataFrame([(1, "u", "b" * 70_000, "x")] * 2, SCHEMA)).collect()
    assert [(r.record_type, r.payload_bytes, r.verified) for r in same] == [("response", 70_000, True)] * 2


def test_missing_segments_are_told(spark):
    parts = [("<1>", "<1>", 1, None, "response", 1, "u", None, "d", bytearray(b"ab")), ("<3>", "<1>", 3, 6, "continuation", None, None, None, "", bytearray(b"ef"))]
    found = warc.reassemble(spark.createDataFrame(parts, warc._READ)).collect()
    assert [(r.block, r.complete) for r in found] == [(None, False)]


def test_cut_archives_are_refused():
    archive = next(iter(warc.records(1, 1, "u", b"x" * 50, "d", None))) + b"\r\n\r\n"
    with pytest.raises(ValueError):
        list(warc.parse(archive[:-10]))


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Logo</a></header><nav><ul><li><a href=1>One</a></ul></nav><div class="cookie-notice">We use cookies, really.</div>
<div id=wrap>%s<h1>Kites &amp; wind</h1><p>Kites are flown in the wind, by many people. They like it, they say.<p>Short.<ul><li>first item<li>second item</ul><p>More text, about kites; and the wind.  It blows.<br>Again.</p>%s</div>
<aside>Related pages, many of them.</aside><div class=comments><p>Nice article, I like it. Thanks, really.</p></div><form><input><label>Mail</label></form><script>x("</p>")</script><footer>&copy; all rights</footer></body></html>"""
WANT = "Kites & wind\nKites are flown in the wind, by many people. They like it, they say.\nShort.\nfirst item\nsecond item\nMore text, about kites; and the wind. It blows. Again."


@pytest.mark.parametrize(("a", "b"), [("<article>", "</article>"), ("<main>", "</main>"), ("", ""), ("<div class=content>", "</div>")])
def test_main_text(a, b):
    assert main_text(PAGE % (a, b)) == WANT


def test_teasers_do_not_stand_for_the_article():
    """Article elements that are teasers only: the path scores find the main text in a div."""
    text = "".join(f"<p>Sentence {i} of the text, which is long enough; it has marks, too. Another one follows, really.</p>" for i in range(12))
    teasers = "".join(f"<article><h3><a href={i}>Teaser {i}</a></h3></article>" for i in range(4))
    got = main_text(f"<body><div id=page><div class=text>{text}</div><div class=more>{teasers}</div></div></body>").split("\n")
    assert got == [f"Sentence {i} of the text, which is long enough; it has marks, too. Another one follows, really." for i in range(12)]


@pytest.mark.parametrize("wrap", ['<div class="layout with-sidebar">%s</div>', '<article class="post no-comments">%s</article>', '<div id="page_menu"><main>%s</main></div>', '<div class="has-sidebar"><div class="single-post">%s</div></div>', '<div class="widget">%s</div>'])
def test_names_of_layout_do_not_empty_a_page(wrap):
    body = "<h1>Head</h1>" + "".join(f"<p>Sentence {i} of the text, which is long enough; it has marks, too. Another one follows, really.</p>" for i in range(6))
    side = '<div class="sidebar">Other things, many.</div><div class="post-comments"><p>Well said, really. I like it.</p></div><div class="site-header">Brand</div>'
    got = main_text(f"<body>{wrap % body}{side}</body>").split("\n")
    assert got[0] == "Head" and len(got) == 7


def test_heading_beside_the_content():
    text = "".join(f"<p>Sentence {i} of the text, which is long enough; it has marks, too. Another one follows, really.</p>" for i in range(6))
    assert main_text(f"<body><h1>Head</h1><div class=content>{text}</div><div class=more>End</div></body>").split("\n")[0] == "Head"
    assert main_text(f"<body><header><h1>Site</h1></header><div class=content>{text}</div></body>").split("\n")[0].startswith("Sentence")
    assert main_text(f"<body><div class=content>{text}</div><h1>After</h1></body>").count("\n") == 5


def test_marks():
    from webquarry.llm.html_extract import is_mark

    marked = ["ad", "cookie-notice", "comments", "post-comments", "sidebar", "side-bar", "site-header", "nav_main", "navbar", "related-posts", "footer", "x comment-list"]
    assert all(map(is_mark, marked)) and not any(map(is_mark, ["", "content", "with-sidebar", "no-comments", "adapter", "header", "post", "layout-sidebar-right", "-", "paragraph"]))


def slow_scores(found) -> list[float]:
    """The path scores by their definition, one block at a time."""
    import math

    fused = []
    for x in found:
        same = [y for y in found if y.path == x.path]
        own = sum(len(y.text) for y in same)
        linked = sum(y.linked for y in same)
        marks = sum(y.text.count(c) for y in same for c in ".,;:!?…。，；：！？、")
        fused.append(0.0 if x.outside else math.sqrt((own - linked) / len(same) * (1 + marks) / len(same)) * (1 - linked / own))
    out = []
    for i in range(len(fused)):
        near = [(math.exp(-((i - j) ** 2) / 2), fused[j]) for j in range(max(0, i - 3), min(len(fused), i + 4))]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def test_path_scores_equal_a_slow_implementation(spark):
    from webquarry.llm.html_extract import nodes, path_scores

    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()] + [PAGE % ("<main>", "</main>")]
    for html in pages:
        found = nodes(html or "")
        assert path_scores(found) == pytest.approx(slow_scores(found))


def test_extract_edges(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>", "x"), (4, "u", "<article>" + "<p>word, word.</p>" * 3000, "x"), (5, "u", "<nav>only menu</nav>", "x")]
    got = {r.page_id: r for r in extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].text == "" and got[5].text == "" and got[4].n_chars == len("word, word.") * 3000 + 2999
    assert extract(spark.createDataFrame([], SCHEMA)).count() == 0

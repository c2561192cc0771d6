"""Engagement rules: orientation, navigation, hierarchy, calls to action, link graph, contact, dead ends, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import urls
from . import findings as fnd
from .relations import any_contains, any_rlike, homepages, links, words

SKILL = "engagement"


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "/+$", "")


def _finding(rows: DataFrame, rule: int, id_: Column | str, title: str, severity: str, confidence: float, evidence: Column, action: str, url: Column | None = None, page: Column | None = None) -> DataFrame:
    return fnd.made(rows, fnd.order(3, rule, page if page is not None else F.col("page_id")), SKILL, id_, SKILL, title, severity, confidence, evidence, F.array(url if url is not None else F.col("url")), action)


def with_home(page: DataFrame) -> DataFrame:
    """Pages with the homepage of their site; ``is_home`` for the page itself and pages of the same key."""
    joined = page.join(homepages(page), "site")
    keys = F.array_compact(F.array(F.col("url_key"), urls.equivalence_key(F.col("original_url"))))
    return joined.withColumn("is_home", F.coalesce((F.col("page_id") == F.col("home_id")) | F.array_contains(keys, F.col("home_key")), F.lit(False)))


def orientation(page: DataFrame) -> DataFrame:
    """ENG-001, ENG-001-TITLE, ENG-002 on the homepage."""
    home = page.filter("page_id = home_id")
    title, h1 = urls.strip(F.coalesce("title", F.lit(""))), urls.strip(F.coalesce(F.get("h1s", F.lit(0)), F.lit("")))
    weak_title = F.lower(title).isin(["", *lex.ENGAGEMENT_TITLES]) | (F.length(title) < 4)
    weak_h1 = F.lower(h1).isin(["", *lex.ENGAGEMENT_H1S]) | (F.size(F.split(h1, r"(?U)\s+")) < 2)
    intro = words(F.concat_ws(" ", F.coalesce("description", F.lit("")), F.substring(F.coalesce("body_text", F.lit("")), 1, 600)))
    seen = F.concat(F.lit("title '"), title, F.lit("', heading '"), h1, F.lit("'"))
    return fnd.union([
        _finding(home.filter(weak_title & weak_h1), 1, "ENG-001", "Homepage doesn't say what it is about", "high", 0.92, seen, "Name brand and offer in title and heading."),
        _finding(home.filter(weak_title & ~weak_h1), 2, "ENG-001-TITLE", "Homepage title is generic", "medium", 0.88, seen, "Name brand and offer in the title."),
        _finding(home.filter(intro < 10), 3, "ENG-002", "Homepage explains no product or service", "high", 0.90, F.concat(intro.cast("string"), F.lit(" words at the top of the homepage")), "Say in two sentences what is offered and to whom."),
    ])


def vague_anchor_counts(page: DataFrame) -> DataFrame:
    """``n_vague`` of each page: links whose text is vague, or internal ones without text."""
    vague = F.filter("links", lambda x: ~x["url"].isin("#", "", "javascript:void(0)") & (F.lower(urls.strip(x["text"])).isin(lex.VAGUE_ANCHORS) | ((urls.strip(x["text"]) == "") & x["is_internal"])))
    return page.withColumn("n_vague", F.size(vague)).withColumn("vague_sample", F.array_join(F.slice(F.transform(vague, lambda x: x["text"]), 1, 4), ", "))


def navigation(page: DataFrame) -> DataFrame:
    """ENG-003 on any page; ENG-004 where the homepage links to none of two or more other pages."""
    vague = vague_anchor_counts(page).filter("n_vague >= 2")
    first = _finding(vague, 4, "ENG-003", "Links have vague texts", "medium", 0.86, F.concat(F.col("n_vague").cast("string"), F.lit(" vague link texts: "), F.col("vague_sample")), "Let link texts name their targets.")
    others = page.filter(~F.col("is_home")).groupBy("site").agg(F.count_distinct("canonical").alias("n_others")).filter("n_others >= 2")
    targets = page.filter("is_home").select("site", F.explode("links").alias("l")).filter("l.is_internal").select("site", urls.equivalence_key(F.col("l.url")).alias("url_key"))
    reached = targets.join(page.select("site", "url_key").distinct(), ["site", "url_key"], "left_semi").select("site").distinct()
    lost = page.filter("page_id = home_id").join(others, "site").join(reached, "site", "left_anti")
    second = _finding(lost, 5, "ENG-004", "Homepage links to no other page", "high", 0.90, F.concat(F.lit("none of "), F.col("n_others").cast("string"), F.lit(" other pages is linked")), "Add a menu with the main sections.")
    return first.unionByName(second)


def level_skips(headings: Column) -> Column:
    """Neighbouring headings whose level goes down by more than one: structs of both levels."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(headings) - 2), lambda i: F.struct(F.get(headings, i)["level"].alias("a"), F.get(headings, i + 1)["level"].alias("b")))
    return F.when(F.size(headings) >= 2, F.filter(pairs, lambda p: p["b"] > p["a"] + 1)).otherwise(F.array().cast("array<struct<a:int,b:int>>"))


def hierarchy(page: DataFrame) -> DataFrame:
    """ENG-005 skipped levels, ENG-006 several main headings, ENG-007 long text without subheadings."""
    headed = page.filter(F.size("headings") > 0).withColumn("skips", level_skips(F.col("headings"))).withColumn("n_h1", F.size(F.filter("headings", lambda h: h["level"] == 1)))
    shown = F.array_join(F.transform(F.slice("skips", 1, 3), lambda p: F.concat(F.lit("H"), p["a"].cast("string"), F.lit("->H"), p["b"].cast("string"))), ", ")
    flat = (F.col("n_words") > 250) & (F.size(F.filter("headings", lambda h: h["level"].isin(2, 3))) == 0)
    return fnd.union([
        _finding(headed.filter(F.size("skips") > 0), 6, "ENG-005", "Heading levels are skipped", "medium", 0.88, shown, "Use heading levels one after the other."),
        _finding(headed.filter("n_h1 > 1"), 7, "ENG-006", "Several main headings", "low", 0.85, F.concat(F.col("n_h1").cast("string"), F.lit(" main headings")), "Keep one main heading."),
        _finding(headed.filter(flat), 8, "ENG-007", "Long text without subheadings", "low", 0.80, F.concat(F.col("n_words").cast("string"), F.lit(" words without a subheading")), "Break the text up with subheadings."),
    ])


def has_cta(links_: Column) -> Column:
    pattern = "(?i)" + "|".join(lex.CTA_ANCHORS)
    return F.exists(links_, lambda x: urls.strip(x["text"]).rlike(pattern) | any_contains(F.lower(x["url"]), lex.CTA_TARGETS))


def calls_to_action(page: DataFrame) -> DataFrame:
    """ENG-008: the homepage has no link that asks for an action."""
    bare = page.filter("page_id = home_id").filter(~has_cta(F.col("links")))
    return _finding(bare, 9, "ENG-008", "Homepage has no clear call to action", "high", 0.91, F.concat(F.lit("none of "), F.size("links").cast("string"), F.lit(" links asks for an action")), "Add a button for the main action.")


def aliases(page: DataFrame) -> DataFrame:
    """``site, alias, canonical``: all spellings under which a page was met (its URL, the requested one, redirects)."""
    spelled = F.array_distinct(F.filter(F.concat(F.array("url", "original_url"), F.coalesce("redirect_chain", F.array().cast("array<string>"))), lambda u: F.coalesce(u, F.lit("")) != ""))
    rows = page.select("site", "canonical", F.explode(spelled).alias("u"))
    return rows.select("site", "canonical", urls.canonical(F.col("u")).alias("alias")).unionByName(rows.select("site", "canonical", _bare(F.col("u")).alias("alias"))).groupBy("site", "alias").agg(F.min("canonical").alias("canonical"))


def in_links(page: DataFrame) -> DataFrame:
    """``site, canonical, n_in``: pages with the number of other pages that link to them, by any alias."""
    known = aliases(page)
    edges = links(page).select("site", "page_id", urls.canonical(F.col("target_url")).alias("alias")).distinct()
    source = page.select("site", "page_id", F.col("canonical").alias("source"))
    met = edges.join(known, ["site", "alias"]).join(source, ["site", "page_id"]).filter("canonical <> source")
    counted = met.groupBy("site", "canonical").agg(F.count_distinct("source").alias("n_in"))
    return page.select("site", "canonical").distinct().join(counted, ["site", "canonical"], "left").withColumn("n_in", F.coalesce("n_in", F.lit(0)))


def linking(page: DataFrame) -> DataFrame:
    """ENG-009: pages of sites with two pages or more that no other page links to; homepage and sibling locale roots apart."""
    sibling = F.coalesce((F.col("home_locale") != F.col("locale")), F.lit(False)) & F.col("is_locale_root")
    asked = page.filter("n_pages >= 2").filter((F.col("canonical") != F.col("home_canonical")) & ~F.coalesce(F.col("url_key") == F.col("home_key"), F.lit(False)) & ~sibling)
    linked = in_links(page).filter("n_in > 0")
    orphans = asked.groupBy("site", "canonical").agg(F.min("page_id").alias("page_id")).join(linked, ["site", "canonical"], "left_anti")
    return _finding(orphans, 10, "ENG-009", "No page links to this page", "medium", 0.94, F.concat(F.lit("no links to "), F.col("canonical")), "Link to the page from related pages.", F.col("canonical"))


def hubs(page: DataFrame, least: int = 4) -> DataFrame:
    """Pages that ``least`` pages or more link to."""
    return in_links(page).filter(F.col("n_in") >= least)


def _onward(page: DataFrame, also: Column | None = None) -> Column:
    own = _bare(F.col("url"))
    apart = F.array(own, F.lit("#"), F.lit(""), *([also] if also is not None else []))
    return F.size(F.filter("links", lambda x: x["is_internal"] & ~F.array_contains(apart, _bare(x["url"]))))


def continuation(page: DataFrame) -> DataFrame:
    """ENG-011: 150 words or more and no internal link but to itself or home."""
    home = _bare(F.col("home_url"))
    lost = page.filter((_bare(F.col("url")) != home) & (F.col("n_words") >= 150)).filter(_onward(page, home) == 0)
    return _finding(lost, 11, "ENG-011", "Long page leads nowhere", "medium", 0.84, F.concat(F.col("n_words").cast("string"), F.lit(" words without an onward link")), "Link to related pages at the end.")


def contact_signal() -> Column:
    """Whether a page shows a way to get in touch: its URL, a link, or an address or number in its text."""
    targets, anchors = [*lex.CONTACT_URLS, *lex.CONTACT_LINKS], lex.CONTACT_ANCHOR_WORDS
    link = F.exists("links", lambda x: F.lower(x["url"]).rlike("|".join(targets)) | F.lower(urls.strip(x["text"])).isin(lex.CONTACT_ANCHORS) | any_contains(F.lower(x["text"]), anchors))
    text = F.coalesce("body_text", F.lit(""))
    return any_rlike(F.lower("url"), lex.CONTACT_URLS) | link | text.rlike(lex.CONTACT_EMAIL) | text.rlike(lex.CONTACT_PHONE)


def contact(page: DataFrame) -> DataFrame:
    """ENG-012: no page of the site shows a way to get in touch."""
    none = page.groupBy("site").agg(F.bool_or(contact_signal()).alias("has_contact"), F.first("home_url").alias("home_url"), F.count(F.lit(1)).alias("n")).filter(~F.col("has_contact"))
    return _finding(none, 12, "ENG-012", "No way to get in touch", "high", 0.91, F.concat(F.lit("no contact on "), F.col("n").cast("string"), F.lit(" pages")), "Show an address, a number or a contact page.", F.col("home_url"), F.lit(0))


def conversion(page: DataFrame) -> DataFrame:
    """ENG-013: a page of prices or products without a link to act."""
    title = F.lower(F.coalesce("title", F.lit("")))
    asked = page.filter(any_rlike(F.lower("url"), lex.CONVERSION_PAGES) | title.contains("pricing") | title.contains("plans"))
    action = "|".join(lex.CONVERSION_ACTIONS)
    lost = asked.filter(~F.exists("links", lambda x: F.lower(urls.strip(x["text"])).rlike(action) | any_contains(F.lower(x["url"]), lex.CONVERSION_TARGETS)))
    return _finding(lost, 13, "ENG-013", "Prices or products without a next step", "high", 0.89, F.concat(F.lit("none of "), F.size("links").cast("string"), F.lit(" links is a next step")), "Link to checkout, sign-up or sales.")


def dead_ends(page: DataFrame) -> DataFrame:
    """ENG-014: a page that loaded, isn't meant to be the last one, and has no internal link to another page."""
    fine = F.coalesce("status_code", F.lit(0)) < 400
    terminal = any_contains(F.lower("url"), lex.TERMINAL_URLS) | any_contains(F.lower(F.coalesce("title", F.lit(""))), lex.TERMINAL_TITLES)
    lost = page.filter(fine & ~terminal).filter(_onward(page) == 0)
    return _finding(lost, 14, "ENG-014", "Dead end", "high", 0.95, F.concat(F.col("url"), F.lit(" links to no other page of the site")), "Add the usual menu or next steps.")


def context_retention(page: DataFrame) -> DataFrame:
    """ENG-015 no way home, ENG-016 no main heading, on pages below the root that aren't locale roots."""
    home = _bare(F.col("home_url"))
    root = F.regexp_extract("home_url", r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    segments = F.filter(F.split(F.regexp_extract("url", r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)", 1), "/"), lambda s: s != "")
    deep = page.filter((_bare(F.col("url")) != home) & ~F.col("is_locale_root") & (F.size(segments) > 0))
    brand = F.lower(F.substring_index("site", ".", 1))
    anchor = lambda x: F.lower(urls.strip(x["text"]))
    leads_home = lambda x: (
        _bare(x["url"]).isin("") | (_bare(x["url"]) == home) | (_bare(x["url"]) == root) | F.contains(F.lower(F.coalesce(x["rel"], F.lit(""))), F.lit("home"))
        | anchor(x).isin(lex.HOME_ANCHORS) | ((brand != "") & F.contains(anchor(x), brand) & (F.length(anchor(x)) < 30))
        | (F.coalesce(urls.host(x["url"]) == F.col("home_host"), F.lit(False)) & urls.is_locale_root(x["url"]))
    )
    lost = deep.filter(~F.exists("links", leads_home))
    headless = deep.filter(~F.exists("headings", lambda h: (h["level"] == 1) & (urls.strip(h["text"]) != "")))
    return fnd.union([
        _finding(lost, 15, "ENG-015", "Deep page has no way home", "medium", 0.90, F.concat(F.col("url"), F.lit(" has no link to "), F.col("home_url")), "Link the logo or a breadcrumb to the homepage."),
        _finding(headless, 16, "ENG-016", "Deep page has no main heading", "medium", 0.87, F.concat(F.col("url"), F.lit(" has no main heading")), "Add a main heading."),
    ])


RULES = {"orientation": orientation, "navigation": navigation, "hierarchy": hierarchy, "calls_to_action": calls_to_action, "linking": linking, "continuation": continuation, "contact": contact, "conversion": conversion, "dead_ends": dead_ends, "context_retention": context_retention}


def engagement_findings(page: DataFrame, threshold: float = 0.7) -> DataFrame:
    """All rules on pages with their homepages; filtered by confidence, repeated ones left out."""
    homed = page if "home_id" in page.columns else with_home(page)
    return fnd.distinct_within_skill(fnd.confident(fnd.union([rule(homed) for rule in RULES.values()]), threshold))


def metrics(page: DataFrame, found: DataFrame) -> DataFrame:
    """One row per site: pages, links, orphans, dead ends, call to action, contact, headings per page."""
    inner = F.size(F.filter("links", lambda x: x["is_internal"]))
    base = page.groupBy("site").agg(F.count(F.lit(1)).alias("pages_audited"), F.sum(inner).alias("internal_link_count"), F.sum(F.size("links") - inner).alias("external_link_count"), F.round(F.avg(F.size("headings")), 1).alias("avg_headings_per_page"))
    flags = found.groupBy("site").agg(F.count_if(F.col("id") == "ENG-009").alias("orphan_page_count"), F.count_if(F.col("id") == "ENG-014").alias("dead_end_count"), (F.count_if(F.col("id") == "ENG-008") == 0).alias("has_homepage_cta"), (F.count_if(F.col("id") == "ENG-012") == 0).alias("has_contact_channel"))
    return base.join(flags, "site", "left").fillna({"orphan_page_count": 0, "dead_end_count": 0}).withColumn("has_homepage_cta", F.coalesce("has_homepage_cta", F.lit(True))).withColumn("has_contact_channel", F.coalesce("has_contact_channel", F.lit(True)))

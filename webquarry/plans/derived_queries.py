"""Queries over tables that Spark derives from ``pages`` and ``documents``, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import urls
from ..operators import consistency, crawl, engagement, facts, findings as fnd, relations, structured, technical, trust
from ..sources import redirects, robots, sitemap
from . import derived
from .catalogue import _HOST, _in, query, table
from .storage import stored

_TREE = f"""n AS (SELECT page_id, {_HOST} AS site FROM pages), k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id) AS r FROM n), t AS (SELECT *, {derived.TREE_URL} AS url FROM k)"""
_HOSTS = f"s AS (SELECT DISTINCT {_HOST} AS site FROM pages)"

# URLs

#: Spellings of an address, what they are in normal form, and whether they are private; ``w`` is the host without www.
_SPELLINGS = [
    ("'HTTPS://' || upper(host) || '/Dir/' || id || '/'", "'https://' || host || '/Dir/' || id", "FALSE"), ("host || '/Dir/' || id", "'https://' || host || '/Dir/' || id", "FALSE"),
    ("'http://' || host || ':80/Dir?b=' || id || '#c'", "'http://' || host || '/Dir?b=' || id", "FALSE"), ("'https://user@' || host || ':8443/x/'", "'https://' || host || ':8443/x'", "FALSE"),
    ("'https://' || host || '/a;p=' || id", "'https://' || host || '/a'", "FALSE"), ("'ftp://' || host || '/' || id", "NULL", "FALSE"), ("'http://10.1.2.3/' || id", "NULL", "TRUE"),
    ("'http://172.' || CAST(page_id % 64 AS VARCHAR(20)) || '.0.9/' || id", "CASE WHEN page_id % 64 BETWEEN 16 AND 31 THEN NULL ELSE 'http://172.' || CAST(page_id % 64 AS VARCHAR(20)) || '.0.9/' || id END", "page_id % 64 BETWEEN 16 AND 31"),
    ("'mailto:a' || id || '@' || host", "NULL", "FALSE"), ("'https://' || host || '//'", "'https://' || host", "FALSE"),
]
_spelled = lambda k: derived._variant("page_id % 10", [s[k] for s in _SPELLINGS])


@query(f"WITH h AS (SELECT page_id, CAST(page_id AS VARCHAR) AS id, {_HOST} AS host FROM pages) SELECT page_id, {_spelled(1)} AS url_norm, {_spelled(2)} AS is_private, ({_spelled(1)}) IS NOT NULL AS is_valid FROM h")
def url_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of ten spellings of an address of each page's host, in normal form."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.col("page_id").cast("string").alias("id"), urls.host(F.col("url")).alias("host")).selectExpr("page_id", f"{_spelled(0)} AS u")
    return rows.select("page_id", urls.normalize(F.col("u")).alias("url_norm"), urls.is_private(F.col("u")).alias("is_private"), urls.is_valid(F.col("u")).alias("is_valid"))


_OTHERS = ["'https://' || w || '/au/'", "'http://www.' || w || '/in'", "'https://unrelated.org/in/'", "'https://' || w || '/in/p'"]


@query(f"WITH h AS (SELECT page_id, regexp_replace({_HOST}, '^www[.]', '') AS w FROM pages) SELECT page_id, page_id % 4 <> 2 AS same_site, page_id % 4 = 0 AS sibling, page_id % 4 = 1 AS equivalent, page_id % 4 <> 0 AS same_locale FROM h")
def url_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How an address of each page's host is related to another one."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(urls.host(F.col("url")), "^www[.]", "").alias("w")).selectExpr("page_id", "'https://' || w || '/in/' AS a", f"{derived._variant('page_id % 4', _OTHERS)} AS b")
    a, b = F.col("a"), F.col("b")
    return rows.select("page_id", urls.same_site(a, b).alias("same_site"), urls.is_regional_sibling(a, b).alias("sibling"), (urls.equivalence_key(a) == urls.equivalence_key(b)).alias("equivalent"), urls.same_locale(a, b).alias("same_locale"))


# Fetching, rendering, technical rules


@query("SELECT page_id, reason, page_id % 6 = 5 AS is_rendered FROM (SELECT page_id, " + derived._variant("page_id % 6", ["NULL" if r[2] is None else f"'{r[2]}'" for r in derived.RENDERING]) + " AS reason FROM pages)")
def rendering_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.parse_pages(derived.script_pages(table(spark, sf_dir, "pages"))).select("page_id", F.col("needs_rendering").alias("reason"), "is_rendered")


@query("SELECT page_id, 'STATIC_RENDERED_CONTENT_GAP' AS code FROM pages WHERE page_id % 6 = 5")
def rendering_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return technical.page_issues(relations.parse_pages(derived.script_pages(table(spark, sf_dir, "pages")))).filter("code LIKE 'STATIC%'").select("page_id", "code")


_v, _w, _x = (f"page_id % {n}" for n in (12, 7, 5))
_CODES = [
    (f"{_w} = 3", "HTTP_UNREACHABLE", "error"), (f"{_w} = 1", "HTTP_SERVER_ERROR", "error"), (f"{_w} = 0", "HTTP_NOT_FOUND", "error"), (f"{_w} = 2", "HTTP_CLIENT_ERROR", "warning"), (f"{_w} = 4", "ROBOTS_TXT_DISALLOWED", "warning"), (f"{_v} = 3", "ROBOTS_META_NOINDEX", "warning"),
    (f"{_v} = 0", "MISSING_TITLE", "error"), (f"{_v} = 1", "SHORT_TITLE", "warning"), (f"{_v} IN (2, 10, 11)", "MISSING_META_DESCRIPTION", "warning"), (f"{_v} IN (8, 10)", "MISSING_H1", "warning"), (f"{_v} = 9", "MULTIPLE_H1", "info"),
    (f"{_v} = 4", "MISSING_CANONICAL", "info"), (f"{_v} = 5", "CANONICAL_PROTOCOL_MISMATCH", "warning"), (f"{_v} = 6", "CANONICAL_DOMAIN_MISMATCH", "warning"), (f"{_v} = 7", "CANONICAL_URL_INVALID", "warning"), (f"{_v} = 10", "EMPTY_BODY_TEXT", "error"), (f"{_v} = 11", "LOW_BODY_TEXT", "warning"),
    (f"{_x} = 0", "EXCESSIVE_REDIRECT_CHAIN", "warning"), (f"{_x} = 1", "REDIRECT_LOOP", "error"),
]


@query(" UNION ALL ".join(f"SELECT page_id, '{code}' AS code, '{severity}' AS severity FROM pages WHERE {when}" for when, code, severity in _CODES))
def page_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of the derived pages: every rule of single pages but the rendering gap."""
    return technical.page_issues(relations.parse_pages(derived.tree_pages(table(spark, sf_dir, "pages")))).select("page_id", "code", "severity")


@query("SELECT page_id, unnest(list_filter([CASE WHEN page_id % 7 = 3 THEN 'FETCH_ERROR' END, CASE WHEN page_id % 9 = 0 THEN 'RESPONSE_TRUNCATED' END, CASE page_id % 7 WHEN 0 THEN 'HTTP_404' WHEN 1 THEN 'HTTP_500' WHEN 2 THEN 'HTTP_403' END, CASE WHEN page_id % 7 = 4 THEN 'ROBOTS_DISALLOWED' END], lambda x: x IS NOT NULL)) AS code FROM pages")
def fetch_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return technical.fetch_issues(derived.tree_pages(table(spark, sf_dir, "pages"))).select("page_id", "code")


@query("WITH i AS (" + " UNION ALL ".join(f"SELECT page_id, '{severity}' AS severity FROM pages WHERE {when}" for when, code, severity in _CODES) + f"""), h AS (SELECT page_id, {_HOST} AS site FROM pages), j AS (SELECT site, i.* FROM i JOIN h USING (page_id))
    SELECT CASE GROUPING(site) + GROUPING(page_id) WHEN 0 THEN 'page' WHEN 1 THEN 'site' ELSE 'corpus' END AS level, site, page_id, count_if(severity = 'error') AS errors, count_if(severity = 'warning') AS warnings, count_if(severity = 'info') AS infos FROM j GROUP BY GROUPING SETS ((site, page_id), (site), ())""")
def issue_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of the derived pages counted for pages, sites and the whole corpus in one pass."""
    return technical.rollup(technical.page_issues(relations.parse_pages(derived.tree_pages(table(spark, sf_dir, "pages")))))


# Redirects, structured data

_CHAINS = [
    *[(k, "h4", 4 - k, "ok") for k in range(4)], (4, "h4", 0, "ok"), (5, "h6", 2, "loop"), (6, "h5", 2, "loop"), (7, "h7", 0, "private"), (8, "h9", 1, "ok"), (9, "h9", 0, "ok"), (11, "h11", 0, "ok"),
]


@query(f"""WITH {_HOSTS}, c(k, last, n, outcome) AS (VALUES {', '.join(f"({k}, '{a}', {n}, '{o}')" for k, a, n, o in _CHAINS)}) SELECT site, 'https://' || site || '/h' || k AS url, 'https://' || site || '/' || last AS final_url, CAST(CASE WHEN n > 0 THEN n + 1 ELSE 0 END AS INTEGER) AS n_visited, outcome FROM s, c
    UNION ALL SELECT site, 'https://' || site || '/h10', 'https://' || site || CASE WHEN length(site) % 2 = 0 THEN '/c5' ELSE '/h10' END, CASE WHEN length(site) % 2 = 0 THEN 6 ELSE 0 END, CASE WHEN length(site) % 2 = 0 THEN 'too_many' ELSE 'ok' END FROM s""")
def redirect_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where twelve addresses of each host lead."""
    return redirects.resolve(*derived.redirect_hops(table(spark, sf_dir, "pages"))).select("site", "url", "final_url", F.size("redirect_chain").alias("n_visited"), "outcome")


@query("""WITH v AS (SELECT page_id, page_id % 6 AS v, CAST(page_id AS VARCHAR) AS id FROM pages) SELECT page_id, 0 AS pos, 'Organization' AS type, 'N' || id AS name, 'https://a.io/' || id || ' https://b.io' AS sites FROM v WHERE v = 0 UNION ALL SELECT page_id, 0, 'Product', 'P', '' FROM v WHERE v = 1 UNION ALL SELECT page_id, 1, 'Offer', NULL, 'https://c.io' FROM v WHERE v = 1
    UNION ALL SELECT page_id, 0, 'Person', 'G', '' FROM v WHERE v = 2 UNION ALL SELECT page_id, 1, NULL, 'untyped', '' FROM v WHERE v = 2 UNION ALL SELECT page_id, 0, 'Corporation', NULL, '' FROM v WHERE v = 5""")
def structured_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of a JSON document for each page: plain, listed, in a graph, malformed."""
    return structured.structured(derived.json_documents(table(spark, sf_dir, "pages"))).withColumn("sites", F.array_join("sites", " "))


@query("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS INTEGER) END AS k FROM events")
def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A property of each event by its variant path; every tenth text is cut, and so has none."""
    cut = F.when(F.col("event_id") % 10 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json(cut), "$.k", "int").alias("k"))


# robots.txt and sitemaps


def _shut(agent: str) -> str:
    own = "r = 3 OR (starts_with(CAST(r AS VARCHAR), '1') AND r NOT IN (1, 11))" if agent == "own" else "starts_with(CAST(r AS VARCHAR), '2') AND r <> 2"
    return f"NOT (length(site) % 4 IN (0, 3) AND ({own}))"


@query(f"WITH {_TREE} SELECT page_id, {_shut('own')} AS own, {_shut('any')} AS other FROM t")
def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which derived pages the robots.txt of their host allows to two user agents."""
    pages = table(spark, sf_dir, "pages")
    rows, rules = derived.tree_pages(pages).select("site", "page_id", "url"), derived.robots(pages)
    one = robots.allowed(rows, rules).select("page_id", F.col("allowed").alias("own"))
    return one.join(robots.allowed(rows, rules, "curl/8").select("page_id", F.col("allowed").alias("other")), "page_id")


@query(f"WITH {_HOSTS} SELECT site, length(site) % 4 IN (0, 3) AS found, CASE WHEN length(site) % 4 <> 2 THEN TRUE END AS allowed_for_agent, CASE WHEN length(site) % 4 = 3 THEN CAST(12 AS DOUBLE) END AS crawl_delay, CASE WHEN length(site) % 4 = 3 THEN 'https://' || site || '/sitemap.xml' ELSE '' END AS sitemaps FROM s")
def robots_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.inspect(derived.robots(table(spark, sf_dir, "pages"))).select("site", "found", "allowed_for_agent", "crawl_delay", F.array_join("sitemap_urls", " ").alias("sitemaps"))


#: Listed pages of each site in order: with an index, only four files of twenty pages are read.
_LISTED = f"""{_TREE}, a AS (SELECT site, page_id, regexp_replace(url, '/$', '') AS url, r, row_number() OVER (PARTITION BY site ORDER BY r) AS pos FROM t WHERE length(site) % 4 <> 2 AND r % 3 <> 0 AND (length(site) % 4 = 1 OR r <= 80)),
    c AS (SELECT site, count(*) AS total, count(*) <= {sitemap.SAMPLE} AS complete FROM a GROUP BY 1)"""


@query(f"WITH {_LISTED} SELECT site, url, CAST(pos AS INTEGER) AS pos, complete FROM a JOIN c USING (site) WHERE pos <= {sitemap.SAMPLE}")
def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitemap.discover(*derived.sitemaps(table(spark, sf_dir, "pages")))[1].select("site", "url", "pos", "complete")


@query(f"WITH {_LISTED} SELECT t.site, t.page_id FROM t JOIN c USING (site) LEFT JOIN a ON a.page_id = t.page_id WHERE c.complete AND a.page_id IS NULL")
def page_not_in_sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return technical.not_in_sitemap(derived.tree_pages(pages), sitemap.discover(*derived.sitemaps(pages))[1]).select("site", "page_id")


@query(f"""WITH {_LISTED}, {_HOSTS} SELECT site, unnest(list_filter([CASE WHEN length(site) % 4 IN (1, 2) THEN 'ROBOTS_TXT_NOT_FOUND' END, CASE WHEN length(site) % 4 = 3 THEN 'HIGH_CRAWL_DELAY' END, CASE WHEN coalesce(total, 0) = 0 THEN 'SITEMAP_NOT_FOUND' END], lambda x: x IS NOT NULL)) AS code
    FROM s LEFT JOIN c USING (site)""")
def site_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return technical.site_issues(robots.inspect(derived.robots(pages)), sitemap.discover(*derived.sitemaps(pages))[0]).select("site", "code")


# Crawl


@query(f"""WITH RECURSIVE {_TREE}, q(site, r, depth, way) AS (
    SELECT DISTINCT site, CAST(1 AS BIGINT), 0, [0] FROM t
    UNION ALL SELECT site, CAST(9 AS BIGINT), 1, [1, 1] FROM t WHERE r = 9
    UNION ALL SELECT q.site, c.r, q.depth + 1, list_concat([len(q.way) + 1], q.way[2:], [c.pos]) FROM q JOIN t USING (site, r), (SELECT 0 AS pos UNION ALL SELECT 1) p, LATERAL (SELECT 2 * q.r + p.pos AS r, p.pos AS pos) c
        WHERE q.depth < 2 AND t.page_id % 12 <> 10 AND {_shut('own').replace('r ', 'q.r ').replace('(r', '(q.r').replace('CAST(q.r', 'CAST(q.r').replace('length(site)', 'length(q.site)')}),
    f AS (SELECT q.*, t.url, row_number() OVER (PARTITION BY q.site ORDER BY q.way) AS place FROM q JOIN t USING (site, r))
    SELECT site, url, CAST(depth AS INTEGER) AS depth, CAST(place AS INTEGER) AS place, {_shut('own')} AS allowed FROM f WHERE place <= 10""")
def crawl_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl of each host's tree of links from its first page, with a seed from a sitemap and the gate of its robots.txt."""
    pages = table(spark, sf_dir, "pages")
    rows = stored(derived.tree_pages(pages), "tree")
    page = stored(relations.parse_pages(rows.drop("status_code", "redirect_chain")), "parsed")
    roots = rows.filter("r = 1").select("site", "url")
    gate = robots.allowed(rows, derived.robots(pages)).select("site", urls.canonical(F.col("url")).alias("canonical"), "allowed")
    seeds = rows.filter("r = 9").select("site", F.lit(1).alias("pos"), "url")
    return crawl.crawl(page, roots, allowed=gate, seeds=seeds).select("site", "url", "depth", "place", "allowed")


@query(f"WITH {_TREE} SELECT t.site, regexp_replace(t.url, '/$', '') AS canonical, CAST(count(p.r) AS BIGINT) AS n_in FROM t LEFT JOIN t p ON p.site = t.site AND t.r > 1 AND p.r = t.r // 2 AND p.page_id % 12 <> 10 GROUP BY ALL")
def in_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engagement.in_links(stored(relations.parse_pages(derived.tree_pages(table(spark, sf_dir, "pages"))), "parsed"))


@query(f"WITH {_TREE} SELECT t.site, regexp_replace(t.url, '/$', '') AS canonical, CAST(1 AS BIGINT) AS n_in FROM t JOIN t p ON p.site = t.site AND t.r > 1 AND p.r = t.r // 2 AND p.page_id % 12 <> 10")
def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that one page or more links to, by the operator that finds hubs."""
    return engagement.hubs(stored(relations.parse_pages(derived.tree_pages(table(spark, sf_dir, "pages"))), "parsed"), least=1)


# Entities, clarity, freshness


@query(f"""WITH {_HOSTS} SELECT site, CASE length(site) % 3 WHEN 0 THEN 'Org ' WHEN 1 THEN 'Maker ' ELSE 'Holder ' END || CAST(length(site) AS VARCHAR) AS name, CASE length(site) % 3 WHEN 0 THEN 'Leeds, UK' END AS location, CAST(CASE length(site) % 3 WHEN 0 THEN 1950 + length(site) WHEN 2 THEN 2019 END AS INTEGER) AS founding_year,
    CASE length(site) % 3 WHEN 0 THEN 'team@org.io' WHEN 2 THEN 'hello@kites.io' END AS contact_email, CASE length(site) % 3 WHEN 0 THEN '+44 20 7946 0958' END AS contact_phone, CASE length(site) % 3 WHEN 0 THEN 'software' END AS industry FROM s""")
def entity_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity profile of each host, from structured data, the site's name or the copyright line of derived pages."""
    page = stored(engagement.with_home(stored(relations.parse_pages(derived.brand_pages(table(spark, sf_dir, "pages"))), "parsed")), "pages")
    return trust.profiles(trust.entities(page)).select("site", "name", "location", "founding_year", "contact_email", "contact_phone", "industry")


_FOUND = [("length(site) % 3 IN (0, 2)", "EC-001", "high"), ("length(site) % 3 <> 0", "EC-002", "medium"), ("length(site) % 3 <> 0", "EC-003", "medium"), ("length(site) % 3 = 0", "CC-001", "high"), ("length(site) % 3 = 1", "CC-002", "medium"), ("length(site) % 3 <> 0", "CC-003", "high"), ("length(site) % 3 = 2", "FR-001", "high"), ("TRUE", "FR-002", "medium")]


@query(f"WITH {_HOSTS} " + " UNION ALL ".join(f"SELECT site, '{i}' AS id, '{s}' AS severity FROM s WHERE {w}" for w, i, s in _FOUND))
def trust_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = stored(engagement.with_home(stored(relations.parse_pages(derived.brand_pages(table(spark, sf_dir, "pages"))), "parsed")), "pages")
    return fnd.union([trust.entity_findings(trust.entities(page)), trust.clarity_findings(page), trust.freshness_findings(page)]).select("site", "id", "severity")


# Facts

_q = lambda p: p.replace("'", "''")
_TEXTS = "texts AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in derived.TEXTS.items()) + f""", lower(coalesce(source, 'none')) AS own FROM documents WHERE doc_id IS NOT NULL),
    placed AS (SELECT *, regexp_matches(url, '(?i){_q(lex.EDITORIAL_URL)}') AS editorial, regexp_matches(url, '(?i){_q(lex.LEGAL_URL)}') AS legal, regexp_matches(url, '(?i){_q(lex.ABOUT_URL)}') AS about FROM texts)"""
_STRIP = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _spans(kind: facts.Kind) -> str:
    """SQL: the spans of a kind with their windows: lengths of what lies between matches add up to places."""
    flag, w, parts = "(?i)" if kind.anycase else "", kind.window, []
    for k, p in enumerate(kind.patterns):
        grouped = p if p != facts.uncaptured(p) else f"({p})"
        full = _q(f"{flag}(?:{grouped})")
        parts.append(f"SELECT *, {k} AS k, regexp_extract_all(text, '{full}', 0) AS m, regexp_extract_all(text, '{full}', 1) AS v, string_split_regex(text, '{_q(flag + facts.uncaptured(p))}') AS g FROM placed")
    return f"""SELECT *, substr(text, greatest(start - {w}, 0) + 1, least(start, {w})) AS before, substr(text, start + length(raw) + 1, {w}) AS after,
        CASE WHEN start > {w} THEN '...' ELSE '' END || {_STRIP(f"substr(text, greatest(start - {w}, 0) + 1, least(start, {w}) + length(raw) + {w})")} || CASE WHEN start + length(raw) + {w} < length(text) THEN '...' ELSE '' END AS snippet
        FROM (SELECT * EXCLUDE (m, v, g, i), m[i] AS raw, v[i] AS val, i, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
              FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM ({" UNION ALL ".join(parts)})))"""


_KIND = {k.name: k for k in facts.KINDS}
_BRAND = f"regexp_matches(snippet, '(?i){_q(lex.THIRD_PARTY_BRANDS)}')"
_NEWS, _US = "(editorial AND NOT about)", "contains(lower(snippet), own)"
_YEAR = r"regexp_extract(val, '\b(19\d\d|20\d\d)\b', 1)"
_DIGITS = "regexp_replace(raw, '[^0-9]', '', 'g')"
_AMOUNT = r"regexp_extract(replace(val, ',', ''), '\d+(?:\.\d+)?', 0)"
_CURRENCY = "CASE " + " ".join(rf"WHEN contains(val, '{m}') OR regexp_matches(val, '(?i)(?:^|\s|\b){re.escape(m)}(?:\s|\b|$)') THEN '{c}'" for m, c in lex.CURRENCIES.items()) + " ELSE 'USD' END"
_NEAR = rf"lower({_STRIP('string_split_regex(right(before, 40), ' + chr(39) + facts._BREAKS + chr(39) + ')[-1]')} || ' ' || {_STRIP('string_split_regex(left(after, 40), ' + chr(39) + facts._BREAKS + chr(39) + ')[1]')})"
_FEE = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({_NEAR}, {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{n}'" for n, ws in lex.FEE_CATEGORIES.items()) + " " + " ".join(rf"WHEN regexp_matches(lower(val || ' ' || snippet), '\b(?:{'|'.join(map(re.escape, ws))})\b') THEN '{n}'" for n, ws in lex.FEE_CATEGORIES.items()) + " END"
_FOREIGN = " OR ".join([_BRAND, f"regexp_matches(snippet, '(?i){_q(lex.CUSTOMER_STORY)}')", *[f"(lower(regexp_extract(snippet, '{_q(p)}', 1)) <> '' AND lower(regexp_extract(snippet, '{_q(p)}', 1)) NOT IN {_in(lex.NON_ENTITY_WORDS)} AND NOT contains(own, lower(regexp_extract(snippet, '{_q(p)}', 1))) AND NOT contains(lower(regexp_extract(snippet, '{_q(p)}', 1)), own))" for p in facts.OTHERS]])
_DAY = rf"(regexp_matches({_STRIP('right(before, 30)')}, '(?i){_q(lex.MONTH_PREFIX)}') OR (regexp_matches({_STRIP('right(before, 30)')}, '[.?!]$') AND regexp_matches(val, '^\d{{1,2}}\s+[A-Z]')))"
_PLACE = "array_to_string(list_transform(regexp_extract_all(lower(" + _STRIP("val") + "), '[a-z0-9]+'), lambda w: CASE " + " ".join(f"WHEN w = '{a}' THEN '{b}'" for a, b in lex.LOCATION_SYNONYMS.items()) + " ELSE w END), ' ')"
#: For each kind: which spans count, and their value, number, currency and fee category.
_RULES = {
    "founding_year": (f"{_YEAR} <> '' AND NOT {_BRAND} AND (NOT {_NEWS} OR ({_US} AND regexp_matches(snippet, '{_q(facts._FOUNDED)}')))", _YEAR, f"CAST({_YEAR} AS DOUBLE)", "NULL", "NULL"),
    "headquarters": (f"(about OR NOT legal) AND length({_STRIP('val')}) BETWEEN 3 AND 49 AND NOT {_BRAND} AND NOT regexp_matches(snippet, '{_q(facts._JURISDICTION)}') AND (NOT {_NEWS} OR {_US}) AND (about OR length(regexp_replace(url, '/+$', '')) - length(replace(regexp_replace(url, '/+$', ''), '/', '')) <= 3 OR {_US} OR regexp_matches(snippet, '{_q(facts._CORPORATE)}'))", _PLACE, "NULL", "NULL", "NULL"),
    "price": (f"NOT editorial AND NOT {_BRAND}", f"printf('%.2f', CAST({_AMOUNT} AS DOUBLE)) || ' ' || {_CURRENCY}", f"CAST({_AMOUNT} AS DOUBLE)", _CURRENCY, _FEE),
    "email": ("NOT regexp_matches(lower(raw), '[.](png|jpg|jpeg|gif|webp)$')", "lower(raw)", "NULL", "NULL", "NULL"),
    "phone": (f"length({_DIGITS}) >= 7", _DIGITS, "NULL", "NULL", "NULL"),
    "metric": (f"NOT {_DAY} AND NOT ({_FOREIGN}) AND (NOT {_NEWS} OR {_US} OR regexp_matches(snippet, '{_q(facts._SCALE)}'))", f"lower({_STRIP('val')})", "NULL", "NULL", "NULL"),
}


def _facts_sql(name: str) -> str:
    when, value, number, code, fee = _RULES[name]
    n = list(_RULES).index(name)
    return f"SELECT site, page_id, url, [page_id, {n}, k, start] AS ord, '{name}' AS fact_type, {value} AS canonical_value, CAST({number} AS DOUBLE) AS numeric_value, CAST({code} AS VARCHAR) AS currency, CAST({fee} AS VARCHAR) AS fee_category, snippet FROM ({_spans(_KIND[name])}) WHERE {when}"


def _of_kind(name: str):  # noqa: ANN202
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = facts.facts(derived.fact_texts(table(spark, sf_dir, "documents")), [name])
        return rows.select("ord.page_id", "canonical_value", "numeric_value", "currency", "fee_category", "snippet")

    run.__name__ = f"facts_{name}"
    query(f"WITH {_TEXTS} SELECT page_id, canonical_value, numeric_value, currency, fee_category, snippet FROM ({_facts_sql(name)})")(run)


for _name in _RULES:
    _of_kind(_name)

@query(rf"SELECT conv_id, turn, regexp_replace(p, '[^0-9]', '', 'g') AS phone FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '{lex.PHONE}')) AS p FROM conversations)")
def facts_phone_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone numbers in turns of conversations."""
    none = F.lit(None).cast("string")
    found = F.explode(facts.text_facts(F.col("text"), none, none, ["phone"]))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", found.alias("f")).select("conv_id", "turn", F.col("f.canonical_value").alias("phone"))


_ALL = f"{_TEXTS}, f AS ({' UNION ALL '.join(_facts_sql(n) for n in _RULES)})"
_AGREES = r"""lambda l: CASE v.fact_type WHEN 'email' THEN TRUE WHEN 'founding_year' THEN l.x = v.numeric_value WHEN 'phone' THEN ends_with(l.v, v.canonical_value) OR ends_with(v.canonical_value, l.v)
    WHEN 'headquarters' THEN len(list_intersect(regexp_extract_all(l.v, '\w+'), regexp_extract_all(v.canonical_value, '\w+'))) > 0 WHEN 'price' THEN l.c = v.currency AND l.e IS NOT DISTINCT FROM v.fee_category AND abs(l.x - v.numeric_value) <= 0.01 ELSE lower(l.v) = lower(v.canonical_value) END"""
_LEAD = "{'v': v.canonical_value, 'x': v.numeric_value, 'c': v.currency, 'e': v.fee_category}"
#: Values one by one: each joins the first leader that it agrees with, or leads.
_CLUSTERED = f"""{_ALL}, d AS (SELECT site, fact_type, canonical_value, numeric_value, currency, fee_category, min(ord) AS ord FROM f GROUP BY ALL), v AS (SELECT *, row_number() OVER (PARTITION BY site, fact_type ORDER BY ord) AS n FROM d),
    fold(site, fact_type, n, leads, cluster) AS (
        SELECT site, fact_type, n, [{_LEAD}], 1 FROM v WHERE n = 1
        UNION ALL SELECT v.site, v.fact_type, v.n, CASE WHEN w.hit > 0 THEN fold.leads ELSE list_append(fold.leads, {_LEAD}) END, CASE WHEN w.hit > 0 THEN w.hit ELSE len(fold.leads) + 1 END
            FROM fold JOIN v ON v.site = fold.site AND v.fact_type = fold.fact_type AND v.n = fold.n + 1, LATERAL (SELECT coalesce(list_position(list_transform(fold.leads, {_AGREES}), TRUE), 0) AS hit) w),
    c AS (SELECT f.*, fold.cluster - 1 AS cluster, fold.leads[fold.cluster].v AS first_value FROM f JOIN v ON v.site = f.site AND v.fact_type = f.fact_type AND v.canonical_value = f.canonical_value AND v.numeric_value IS NOT DISTINCT FROM f.numeric_value AND v.currency IS NOT DISTINCT FROM f.currency AND v.fee_category IS NOT DISTINCT FROM f.fee_category
          JOIN fold ON fold.site = v.site AND fold.fact_type = v.fact_type AND fold.n = v.n)"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(facts.facts(derived.fact_texts(table(spark, sf_dir, "documents"))), "facts")


@query(f"WITH RECURSIVE {_CLUSTERED} SELECT site, fact_type, CAST(cluster AS INTEGER) AS cluster, any_value(first_value) AS first_value, count(*) AS n_facts, count(DISTINCT url) AS n_urls FROM c GROUP BY 1, 2, 3")
def fact_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the facts of each source."""
    return consistency.cluster_table(consistency.clusters(_facts(spark, sf_dir))).select("site", "fact_type", "cluster", "first_value", "n_facts", F.size("urls").cast("long").alias("n_urls"))


@query(f"WITH RECURSIVE {_CLUSTERED} SELECT site, fact_type, any_value(first_value) AS value FROM c GROUP BY 1, 2 HAVING max(cluster) = 0")
def fact_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency.consensus(_facts(spark, sf_dir))


@query(f"WITH {_ALL}, g AS (SELECT site, fact_type, min(ord) AS first_at, count(*) AS n FROM f GROUP BY 1, 2) SELECT site, count(*) AS total_fact_types, string_agg(fact_type, ' ' ORDER BY first_at) AS fact_types, CAST(sum(n) AS BIGINT) AS total_facts_recorded FROM g GROUP BY 1")
def fact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency.summary(_facts(spark, sf_dir)).select("site", "total_fact_types", F.array_join("fact_types", " ").alias("fact_types"), "total_facts_recorded")


_any = lambda text, words: "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"
_list = lambda text, named: "list_filter([" + ", ".join(f"CASE WHEN {_any(text, ws)} THEN '{n}' END" for n, ws in named.items()) + "], lambda x: x IS NOT NULL)"
_CONFLICTS = rf"""{_CLUSTERED}, t AS (SELECT site, fact_type, cluster, any_value(first_value) AS val, any_value(leads_at) AS lead, min(ord) AS ord, list_distinct(list(url)) AS urls, string_agg(snippet, ' ' ORDER BY ord) AS said FROM (
        SELECT c.*, l.leads[c.cluster + 1] AS leads_at FROM c JOIN (SELECT site, fact_type, max_by(leads, n) AS leads FROM fold GROUP BY 1, 2) l USING (site, fact_type)) GROUP BY 1, 2, 3),
    o AS (SELECT *, lower(said) AS low, {_any('lower(said)', lex.ANNUAL_WORDS)} AS yearly, {_any('lower(said)', lex.MONTHLY_WORDS)} AS monthly, {_list('lower(said)', {x: [x] for x in lex.TIERS})} AS tiers, {_list('lower(said)', lex.FEE_DESCRIPTORS)} AS fees, {_any('lower(said)', lex.PLAN_WORDS)} AS planned,
        list_distinct(regexp_extract_all(said, '\b[A-Z][a-zA-Z0-9]+(?:\s+[A-Z0-9][a-zA-Z0-9]+)+\b')) AS products, list_distinct(list_transform(urls, lambda u: CASE WHEN contains(u, '.org/en-us/') THEN 'en-us' ELSE '' END)) AS locales FROM t),
    pairs AS (SELECT a.site, a.fact_type, a.cluster AS cluster_a, b.cluster AS cluster_b, a.val AS value_a, b.val AS value_b FROM o a JOIN o b ON a.site = b.site AND a.fact_type = b.fact_type AND a.cluster < b.cluster
        WHERE CASE a.fact_type WHEN 'founding_year' THEN a.lead.x <> b.lead.x WHEN 'email' THEN FALSE WHEN 'phone' THEN NOT (ends_with(a.val, b.val) OR ends_with(b.val, a.val)) WHEN 'headquarters' THEN len(list_intersect(regexp_extract_all(a.val, '\w+'), regexp_extract_all(b.val, '\w+'))) = 0
              WHEN 'price' THEN NOT coalesce(a.lead.e <> b.lead.e, FALSE) AND (a.lead.c <> b.lead.c OR abs(a.lead.x - b.lead.x) > 0.01) ELSE lower(a.val) <> lower(b.val) END
          AND (len(list_filter(a.urls, lambda u: NOT list_contains(b.urls, u))) > 0 OR len(list_filter(b.urls, lambda u: NOT list_contains(a.urls, u))) > 0)
          AND NOT (a.fact_type = 'price' AND (({_any("a.low || ' ' || b.low", lex.DONATION_WORDS)}) OR (a.yearly AND NOT a.monthly AND b.monthly AND NOT b.yearly) OR (a.monthly AND NOT a.yearly AND b.yearly AND NOT b.monthly) OR (len(a.tiers) > 0 AND len(b.tiers) > 0 AND a.tiers <> b.tiers)
              OR coalesce(a.lead.e <> b.lead.e, FALSE) OR (len(a.fees) > 0 AND len(b.fees) > 0 AND len(list_intersect(a.fees, b.fees)) = 0) OR (len(a.fees) > 0 AND len(b.fees) = 0 AND b.planned) OR (len(b.fees) > 0 AND len(a.fees) = 0 AND a.planned)))
          AND NOT (a.fact_type = 'metric' AND (string_split(a.val, ' ')[-1] <> string_split(b.val, ' ')[-1] OR (len(a.products) > 0 AND len(b.products) > 0 AND len(list_intersect(a.products, b.products)) = 0)))
          AND NOT (a.fact_type IN ('headquarters', 'phone', 'price') AND NOT list_contains(a.locales, '') AND NOT list_contains(b.locales, '') AND len(list_intersect(a.locales, b.locales)) = 0))"""


@query(f"WITH RECURSIVE {_CONFLICTS} SELECT site, fact_type, CAST(cluster_a AS INTEGER) AS cluster_a, CAST(cluster_b AS INTEGER) AS cluster_b, value_a, value_b FROM pairs")
def fact_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of clusters of a source that contradict each other and aren't exempt."""
    found = stored(consistency.cluster_table(consistency.clusters(_facts(spark, sf_dir))), "clusters")
    return consistency.conflicts(found).select("site", "fact_type", "cluster_a", "cluster_b", "value_a", "value_b")


@query(f"""WITH RECURSIVE {_CONFLICTS}, y AS (SELECT site, fact_type, min(ord) AS first_at FROM t GROUP BY 1, 2)
    SELECT site, 'CO-' || lpad(CAST(row_number() OVER (PARTITION BY site ORDER BY first_at, cluster_a, cluster_b) AS VARCHAR), 3, '0') AS id, CASE WHEN fact_type IN {_in(lex.HIGH_CONFLICTS)} THEN 'high' ELSE 'medium' END AS severity FROM pairs JOIN y USING (site, fact_type)""")
def fact_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered findings of contradictions of each source."""
    return consistency.consistency_findings(_facts(spark, sf_dir)).select("site", "id", "severity")


# Scores

_SEVERE = {"critical": "doc_id % 401 = 0", "high": "doc_id % 97 = 0", "medium": "doc_id % 31 = 0", "low": "doc_id % 11 = 0"}


@query(f"""WITH c AS (SELECT source AS site, {', '.join(f'count_if({w}) AS {s}' for s, w in _SEVERE.items())} FROM documents GROUP BY 1), s AS (SELECT *, CAST(greatest(0.0, least(100.0, 100.0 - 25 * critical - 10 * high - 4 * medium - low)) AS DOUBLE) AS overall_score FROM c)
    SELECT site, overall_score, CASE WHEN overall_score >= 90 THEN 'A' WHEN overall_score >= 80 THEN 'B' WHEN overall_score >= 70 THEN 'C' WHEN overall_score >= 60 THEN 'D' ELSE 'F' END AS grade FROM s""")
def readiness_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and grade of each source, some of whose documents count as findings."""
    counts = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("site")).agg(*[F.count_if(F.expr(w)).alias(s) for s, w in _SEVERE.items()])
    return fnd.scored(counts).select("site", "overall_score", "grade")

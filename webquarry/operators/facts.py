"""Business facts in texts as relations: spans of patterns with the text around them, filters, normal forms.

Every kind of fact is a row of ``KINDS``: its patterns, the width of its window, its confidence, and column expressions that
say which spans count and what their normal form is.  One pass of a pattern over a text marks all its spans together with
their windows; no Python runs.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import urls

#: Marks that no text holds: they are blanked before texts are searched.
_OPEN, _FIELD, _CLOSE = "\x01", "\x02", "\x03"
_JURISDICTION = (
    r"(?i)\b(?:user|customer|party|parties|dispute|arbitration|court|courts|resident|citizen|jurisdiction|denominated currency)\s+(?:is\s+|are\s+)?(?:located|based)\s+in\b"
    r"|\b(?:governed\s+by|governing\s+law|venue|jurisdiction)\b"
)
_CORPORATE = r"(?i)\b(?:headquarter|headquartered|headquarters|corporate office|head office|offices?)\b"
_SCALE = r"(?i)\b(?:over|more than|serving|trusted by|scale|worldwide|globally|million|billion)\b"
_FOUNDED = r"(?i)\b(?:founded|established|started|est\.?)\b"
_ENTITY = r"\b([A-Z][a-zA-Z0-9_\-]+)"
#: Names that a text gives to others: subjects of what customers do, owners, those of whom it is told how.
OTHERS = [rf"{_ENTITY}\s+(?:{'|'.join(lex.CUSTOMER_VERBS)})\b", rf"{_ENTITY}['’]s\b", r"(?i)\b(?:see\s+how|how)\s+([A-Z][a-zA-Z0-9_\-]+)\b"]
_BREAKS = r"[.;\n•|\t]"

FACT = "fact_type string, raw_value string, canonical_value string, numeric_value double, currency string, fee_category string, snippet string, confidence double"


def uncaptured(pattern: str) -> str:
    """A pattern without capturing groups."""
    return re.sub(r"(?<!\\)\((?!\?)", "(?:", pattern)


def spans(text: Column, pattern: str, window: int, anycase: bool) -> Column:
    """All spans of a pattern in one pass: ``before, raw, value, after``, with up to ``window`` + 1 characters on each side.

    ``value`` is the first group of the pattern, or the span.  Windows are look-arounds, so that they may overlap
    other spans; the one behind is tried only where the pattern matches.
    """
    flag = "(?i)" if anycase else ""
    bare = f"(?:{flag}{uncaptured(pattern)})"
    value = pattern if pattern != uncaptured(pattern) else f"({pattern})"
    around = rf"(?={bare})(?<=(\A(?s:.{{0,{window}}})|(?s:.{{{window + 1}}})))((?:{flag}{value}))(?=((?s:.{{0,{window + 1}}})))"
    marked = F.regexp_replace(text, around, f"{_OPEN}$1{_FIELD}$2{_FIELD}$3{_FIELD}$4{_CLOSE}")
    found = F.regexp_extract_all(marked, F.lit(f"{_OPEN}([^{_CLOSE}]*){_CLOSE}"), F.lit(1))
    part = lambda x, k: F.element_at(F.split(x, _FIELD), k)
    return F.transform(found, lambda x: F.struct(part(x, 1).alias("before"), part(x, 2).alias("raw"), part(x, 3).alias("value"), part(x, 4).alias("after")))


def snippet(s: Column, window: int) -> Column:
    """The text around a span, dots where it is cut."""
    cut = lambda side: F.when(F.length(side) > window, "...").otherwise("")
    return F.concat(cut(s["before"]), urls.strip(F.concat(F.right(s["before"], F.lit(window)), s["raw"], F.left(s["after"], F.lit(window)))), cut(s["after"]))


def brand(url: Column, site_name: Column) -> Column:
    """The site name, or the first label of the host that means something, in lower case; else empty."""
    labels = F.filter(F.split(urls.host(url), r"\."), lambda p: ~p.isin(lex.GENERIC_HOST_LABELS))
    return F.coalesce(F.nullif(urls.strip(site_name), F.lit("")), F.get(labels, F.lit(0)), F.lit(""))


def has_word(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def first_of(table: dict[str, Column]) -> Column:
    """The first name whose condition holds."""
    return F.coalesce(*[F.when(c, F.lit(name)) for name, c in table.items()])


def year(raw: Column) -> Column:
    return F.nullif(F.regexp_extract(raw, r"\b(19\d\d|20\d\d)\b", 1), F.lit(""))


def location(raw: Column) -> Column:
    """Lower-case words with usual short forms written out; null under two characters."""
    short = F.create_map(*[F.lit(x) for pair in lex.LOCATION_SYNONYMS.items() for x in pair])
    words = F.transform(F.regexp_extract_all(F.lower(raw), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.coalesce(F.try_element_at(short, w), w))
    return F.when(F.length(urls.strip(raw)) >= 2, F.array_join(words, " "))


def digits(raw: Column) -> Column:
    """The digits of a phone number; null under seven."""
    only = F.regexp_replace(raw, "[^0-9]", "")
    return F.when(F.length(only) >= 7, only)


def currency(raw: Column) -> Column:
    """The first currency, in the order of the table, whose mark is in the text or is one of its words; else USD."""
    marks = lambda m: F.contains(raw, F.lit(m)) | raw.rlike(rf"(?i)(?:^|\s|\b){re.escape(m)}(?:\s|\b|$)")
    return F.coalesce(*[F.when(marks(m), F.lit(code)) for m, code in lex.CURRENCIES.items()], F.lit("USD"))


def amount(raw: Column) -> Column:
    return F.nullif(F.regexp_extract(F.replace(raw, F.lit(","), F.lit("")), r"\d+(?:\.\d+)?", 0), F.lit("")).cast("double")


def fee_category(s: Column, around: Column) -> Column:
    """The first category named right beside a price, else as a word of the text around it."""
    left = F.element_at(F.split(F.right(s["before"], F.lit(40)), _BREAKS, -1), -1)
    right = F.element_at(F.split(F.left(s["after"], F.lit(40)), _BREAKS, -1), 1)
    near = F.lower(F.concat(urls.strip(left), F.lit(" "), urls.strip(right)))
    wide = F.lower(F.concat(urls.strip(s["value"]), F.lit(" "), around))
    words = {name: rf"\b(?:{'|'.join(map(re.escape, ws))})\b" for name, ws in lex.FEE_CATEGORIES.items()}
    return F.coalesce(first_of({name: has_word(near, ws) for name, ws in lex.FEE_CATEGORIES.items()}), first_of({name: wide.rlike(p) for name, p in words.items()}))


def of_others(around: Column, own: Column) -> Column:
    """Whether a text speaks of another company or of a customer."""
    mine = F.lower(own)
    named = [F.lower(F.regexp_extract(around, p, 1)) for p in OTHERS]
    foreign = [(n != "") & ~n.isin(lex.NON_ENTITY_WORDS) & ~F.contains(mine, n) & ~F.contains(n, mine) for n in named]
    out = around.rlike("(?i)" + lex.THIRD_PARTY_BRANDS) | around.rlike("(?i)" + lex.CUSTOMER_STORY)
    for f in foreign:
        out = out | f
    return out


@dataclass(frozen=True)
class Context:
    """What is known of the page of a span."""

    url: Column
    own: Column

    @property
    def editorial(self) -> Column:
        return self.url.rlike("(?i)" + lex.EDITORIAL_URL)

    @property
    def legal(self) -> Column:
        return self.url.rlike("(?i)" + lex.LEGAL_URL)

    @property
    def about(self) -> Column:
        return self.url.rlike("(?i)" + lex.ABOUT_URL)

    @property
    def news(self) -> Column:
        return self.editorial & ~self.about

    @property
    def front(self) -> Column:
        """At most the host and one step below it."""
        bare = F.regexp_replace(self.url, "/+$", "")
        return F.length(bare) - F.length(F.replace(bare, F.lit("/"), F.lit(""))) <= 3

    def names_us(self, around: Column) -> Column:
        return (self.own != "") & F.contains(F.lower(around), self.own)


@dataclass(frozen=True)
class Kind:
    """A kind of fact: ``wanted(page, span, text around it)`` and ``normal(span, text around it)``, which gives value,
    number, currency and fee category."""

    name: str
    patterns: list[str]
    window: int
    confidence: float
    wanted: Callable[[Context, Column, Column], Column]
    normal: Callable[[Column, Column], tuple[Column, Column | None, Column | None, Column | None]]
    anycase: bool = True


def _branded(around: Column) -> Column:
    return around.rlike("(?i)" + lex.THIRD_PARTY_BRANDS)


def _dated(s: Column) -> Column:
    """Whether a number is a day of a month or a footnote."""
    before = urls.strip(F.right(s["before"], F.lit(30)))
    return before.rlike("(?i)" + lex.MONTH_PREFIX) | (before.rlike(r"[.?!]$") & urls.strip(s["value"]).rlike(r"^\d{1,2}\s+[A-Z]"))


def _raw(s: Column) -> Column:
    return urls.strip(s["value"])


#: In the order in which a page's facts are listed.
KINDS = [
    Kind(
        "founding_year", lex.FOUNDING, 60, 0.92,
        lambda p, s, a: year(s["value"]).isNotNull() & ~_branded(a) & (~p.news | (p.names_us(a) & a.rlike(_FOUNDED))),
        lambda s, a: (year(s["value"]), year(s["value"]).cast("double"), None, None),
    ),
    Kind(
        "headquarters", lex.HEADQUARTERS, 60, 0.85,
        lambda p, s, a: (p.about | ~p.legal) & F.length(_raw(s)).between(3, 49) & ~_branded(a) & ~a.rlike(_JURISDICTION) & (~p.news | p.names_us(a)) & (p.about | p.front | p.names_us(a) | a.rlike(_CORPORATE)),
        lambda s, a: (F.coalesce(location(_raw(s)), F.lit("")), None, None, None),
    ),
    Kind(
        "price", lex.PRICING, 80, 0.88,
        lambda p, s, a: ~p.editorial & ~_branded(a) & amount(_raw(s)).isNotNull(),
        lambda s, a: (F.format_string("%.2f %s", amount(_raw(s)), currency(_raw(s))), amount(_raw(s)), currency(_raw(s)), fee_category(s, a)),
    ),
    Kind("email", [lex.CLARITY_EMAIL], 60, 0.95, lambda p, s, a: ~has_end(F.lower(s["raw"]), lex.FACT_EMAIL_IMAGES), lambda s, a: (F.lower(s["raw"]), None, None, None), anycase=False),
    Kind("phone", [lex.PHONE], 60, 0.89, lambda p, s, a: digits(s["raw"]).isNotNull(), lambda s, a: (digits(s["raw"]), None, None, None), anycase=False),
    Kind("metric", [lex.METRIC], 80, 0.86, lambda p, s, a: ~_dated(s) & ~of_others(a, p.own) & (~p.news | p.names_us(a) | a.rlike(_SCALE)), lambda s, a: (F.lower(_raw(s)), None, None, None)),
]


def has_end(text: Column, ends: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(e) for e in ends]), lambda e: F.endswith(text, e))


def _fact(name: str, raw: Column, normal: tuple[Column, Column | None, Column | None, Column | None], around: Column, confidence: float | Column) -> Column:
    value, number, code, fee = normal
    none = F.lit(None)
    fields = [F.lit(name), raw, value, none if number is None else number, none if code is None else code, none if fee is None else fee, around, F.lit(confidence) if isinstance(confidence, float) else confidence]
    return F.struct(*[f.cast(kind.split()[1]).alias(kind.split()[0]) for f, kind in zip(fields, FACT.split(", "), strict=True)])


def text_facts(text: Column, url: Column, site_name: Column, kinds: list[str] | None = None) -> Column:
    """The facts of a text, as an array in the order of kinds, patterns and places; null texts have none.

    Control characters 01 to 03 count as blanks.
    """
    page = Context(url, F.lower(brand(url, site_name)))
    clear = F.coalesce(text, F.lit(""))
    for mark in (_OPEN, _FIELD, _CLOSE):
        clear = F.replace(clear, F.lit(mark), F.lit(" "))

    def of(kind: Kind) -> Column:
        every = F.concat(*[spans(clear, p, kind.window, kind.anycase) for p in kind.patterns])
        seen = F.transform(every, lambda s: F.struct(s.alias("s"), snippet(s, kind.window).alias("a")))
        kept = F.filter(seen, lambda x: F.coalesce(kind.wanted(page, x["s"], x["a"]), F.lit(False)))
        raw = (lambda s: F.lower(s["raw"])) if kind.name == "email" else _raw
        return F.transform(kept, lambda x: _fact(kind.name, raw(x["s"]), kind.normal(x["s"], x["a"]), x["a"], kind.confidence))

    found = [of(kind) for kind in KINDS if kinds is None or kind.name in kinds]
    return F.concat(*found)


def json_facts(document: Column) -> Column:
    """The facts of a JSON-LD object given as text, by variant paths; malformed text has none.

    Only strings count as names; other values are read as text.  An address is an object or a text.
    """
    v = F.try_parse_json(document)
    get = lambda path, kind="string": F.try_variant_get(v, path, kind)
    is_text = lambda path: F.schema_of_variant(F.coalesce(get(path, "variant"), F.parse_json(F.lit("null")))) == "STRING"
    is_object = F.startswith(F.schema_of_variant(F.coalesce(get("$.address", "variant"), F.parse_json(F.lit("null")))), F.lit("OBJECT"))
    kinds = F.lower(F.coalesce(get("$['@type']"), F.lit("")))
    name = urls.strip(get("$.name"))
    full = lambda x: F.nullif(x, F.lit(""))
    founded = F.coalesce(full(get("$.foundingDate")), full(get("$.foundingYear")))
    part = lambda p: F.coalesce(get(f"$.address.{p}"), F.lit(""))
    inner = F.regexp_replace(F.concat(part("addressLocality"), F.lit(", "), part("addressRegion"), F.lit(" "), part("addressCountry")), "^[, ]+|[, ]+$", "")
    address = F.when(is_object, inner).when(is_text("$.address"), get("$.address"))
    phone, mail = get("$.telephone"), F.lower(urls.strip(get("$.email")))
    plain = lambda value, number=None: (value, number, None, None)
    told = lambda what, value: F.concat(F.lit(f"structured data {what}: "), value)
    rows = [
        (has_word(kinds, lex.ORGANIZATION_TYPES) & is_text("$.name") & (F.length(name) > 1), _fact("organization_name", name, plain(F.lower(name)), told("name", name), 0.95)),
        (year(founded).isNotNull(), _fact("founding_year", founded, plain(year(founded), year(founded)), told("founding date", founded), 0.98)),
        (location(address).isNotNull(), _fact("headquarters", address, plain(location(address)), told("address", address), F.when(is_object, 0.96).otherwise(0.95))),
        (digits(phone).isNotNull(), _fact("phone", phone, plain(digits(phone)), told("telephone", phone), 0.98)),
        (mail != "", _fact("email", mail, plain(mail), told("email", mail), 0.98)),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(ok, F.lit(False)), f) for ok, f in rows]), lambda x: x.isNotNull())


def facts(pages: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """One row per fact of ``site, page_id, url, text`` (and ``meta_site_name``, ``json_ld``, where they are there).

    ``ord`` is the order of facts of a site: by page, JSON-LD before text.  Null and empty texts have no facts; repeated pages
    repeat theirs; an empty table gives an empty result; other columns are not looked at.
    """
    name = F.col("meta_site_name") if "meta_site_name" in pages.columns else F.lit(None).cast("string")
    found = text_facts(F.col("text"), F.col("url"), name, kinds)
    if "json_ld" in pages.columns and kinds is None:
        found = F.concat(F.flatten(F.transform(F.coalesce("json_ld", F.array().cast("array<string>")), json_facts)), found)
    rows = pages.select("site", "page_id", "url", F.posexplode(found).alias("pos", "f"))
    return rows.select("site", F.struct("page_id", "pos").alias("ord"), *[f"f.{x.split()[0]}" for x in FACT.split(", ")[:6]], F.col("url").alias("source_url"), "f.snippet", "f.confidence")

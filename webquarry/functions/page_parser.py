"""One pass over a page's HTML: everything that the rules look at."""

from __future__ import annotations

import json
import re
from typing import Any

from . import lexicons as lex, markup, urls

PAGE_SCHEMA = (
    "title string, description string, canonical_url string, robots_meta string, open_graph map<string,string>, twitter_card map<string,string>, extra map<string,string>, "
    "headings array<struct<level:int,text:string>>, links array<struct<url:string,text:string,is_internal:boolean,rel:string>>, body_text string, n_scripts int, "
    "meta_description string, meta_site_name string, meta_dates map<string,string>, h1s array<string>, h2s array<string>, clean_text string, footer_text string, "
    "nav_items array<string>, paragraphs array<string>, images array<struct<src:string,alt:string,title:string,caption:string,classes:array<string>,informative:boolean>>, "
    "copyright_statements array<string>, emails array<string>, phones array<string>, social_links array<string>, json_ld array<string>, "
    "organizations array<struct<type:string,name:string,description:string,email:string,phone:string,founding_year:int,address:string,same_as:array<string>>>, "
    "offerings array<string>, has_address boolean, has_contact boolean, "
    "parse_error string"
)

_SPACE = re.compile(r"\s+")
_COPYRIGHT = re.compile(lex.COPYRIGHT, re.I)
_EMAIL = re.compile(lex.EMAIL)
_SOCIAL = re.compile(lex.SOCIAL, re.I)
_INFORMATIVE = re.compile(lex.INFORMATIVE_IMAGE, re.I)
_HEADING = re.compile(r"h[1-6]$")
_INVISIBLE = frozenset(lex.INVISIBLE)
_NO_TEXT = frozenset("script style noscript svg".split())


def clean(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


def valid_email(text: str) -> str | None:
    """The address in lower case; null for file names and placeholders."""
    mail = text.strip().lower()
    return None if mail.endswith(tuple(lex.EMAIL_ASSET_SUFFIXES)) or any(p in mail for p in lex.EMAIL_PLACEHOLDERS) else mail


def _add(found: list[str], value: str | None) -> None:
    if value and value not in found:
        found.append(value)


class _Capture:
    """The text within an element that is open."""

    __slots__ = ("name", "attrs", "depth", "parts", "in_nav", "in_figure", "shown")

    def __init__(self, name: str, attrs: dict[str, str], depth: int):
        self.name, self.attrs, self.depth, self.parts = name, attrs, depth, []

    def joined(self) -> str:
        return clean("".join(self.parts))

    def spaced(self) -> str:
        return clean(" ".join(p.strip() for p in self.parts if p.strip()))


def _structured(raw: str) -> list[dict[str, Any]]:
    """Objects of a JSON-LD script, those of a graph by themselves; none of a malformed one."""
    try:
        data = json.loads(raw.strip())
    except ValueError:
        return []
    if isinstance(data, dict) and isinstance(data.get("@graph"), list):
        data = data["@graph"]
    return [x for x in (data if isinstance(data, list) else [data]) if isinstance(x, dict)]


def _organization(item: dict[str, Any]) -> dict[str, Any]:
    text = lambda v: str(v).strip() if v else None
    address = item.get("address")
    if isinstance(address, dict):
        address = ", ".join(str(v) for v in (address.get(k) for k in ("addressLocality", "addressRegion", "addressCountry")) if v)
    year = re.search(r"\b((?:19|20)\d{2})\b", str(item.get("foundingDate") or ""))
    same = item.get("sameAs") or []
    return {
        "type": str(item.get("@type", "")), "name": text(item.get("name")), "description": text(item.get("description")), "email": text(item.get("email")), "phone": text(item.get("telephone")),
        "founding_year": int(year[1]) if year else None, "address": address.strip() if isinstance(address, str) else None,
        "same_as": [same] if isinstance(same, str) else [s for s in same if isinstance(s, str)] if isinstance(same, list) else [],
    }


def parse(url: str, html: str | None, closed: bool = False) -> dict[str, Any]:
    """The fields of PAGE_SCHEMA.  Any input gives a row; null and empty pages have empty fields.  ``closed`` as in ``markup.tokens``."""
    page: dict[str, Any] = {
        "title": None, "description": None, "canonical_url": None, "robots_meta": None, "open_graph": {}, "twitter_card": {}, "extra": {}, "headings": [], "links": [], "body_text": "", "n_scripts": 0,
        "meta_description": None, "meta_site_name": None, "meta_dates": {}, "h1s": [], "h2s": [], "clean_text": "", "footer_text": "", "nav_items": [], "paragraphs": [], "images": [],
        "copyright_statements": [], "emails": [], "phones": [], "social_links": [], "json_ld": [], "organizations": [], "offerings": [], "has_address": False, "has_contact": False, "parse_error": None,
    }
    if not html:
        return page
    url = url or ""
    own_key = urls.py_site_key(urls.py_host(url))
    base, base_seen = url, False
    open_: list[_Capture] = []
    figures: list[dict[str, Any]] = []
    waiting: list[tuple[dict[str, Any], dict[str, Any]]] = []
    metas: list[dict[str, str]] = []
    anchors: list[tuple[str, str, str | None]] = []
    footers, paragraphs, objects = [], [], []
    visible: list[str] = []
    body_visible: list[str] = []
    shown: list[str] = []
    body_shown: list[str] = []
    nav_depths: list[int] = []
    has_body, title_seen, canonical = False, False, None
    ld_type = None

    for kind, name, source, path in markup.events(html, closed):
        if kind in ("text", "raw"):
            if kind == "raw" and name == "title" and not title_seen and "svg" not in path:
                title_seen = True
                page["title"] = clean(source) or None
            elif kind == "raw" and name == "script" and ld_type and source.strip():
                objects.extend(_structured(source))
            for c in open_:
                c.parts.append(source)
            if source.strip() and not (kind == "raw" and name == "title" and "head" in path):
                inside = "body" in path
                if not _INVISIBLE.intersection(path):
                    (body_visible if inside else visible).append(source.strip())
                if not _NO_TEXT.intersection(path):
                    (body_shown if inside else shown).append(source.strip())
        elif kind == "start":
            wanted = name in ("a", "meta", "link", "base", "img", "script", "li", "button", "p", "nav", "header", "footer", "div", "figure", "figcaption", "body") or _HEADING.match(name)
            if not wanted:
                continue
            attrs = markup.attributes(source, closed) if source else {}
            depth = len(path)
            if name == "body":
                has_body = True
            elif name == "meta":
                metas.append(attrs)
            elif name == "base" and "href" in attrs and not base_seen:
                base_seen, base = True, urls.urljoin(url, attrs["href"].strip())
            elif name == "link":
                if canonical is None and attrs.get("href") and re.search(r"\bcanonical\b", attrs.get("rel", ""), re.I):
                    canonical = attrs["href"].strip()
            elif name == "script":
                page["n_scripts"] += 1
                ld_type = "application/ld+json" in attrs.get("type", "").lower()
            elif name == "img":
                image = {"src": attrs.get("src") or attrs.get("data-src") or "", "alt": attrs.get("alt", "").strip(), "title": attrs.get("title", "").strip(), "caption": "", "classes": attrs.get("class", "").split()}
                image["informative"] = bool(_INFORMATIVE.search(f"{image['src']} {' '.join(image['classes'])} {image['title']}"))
                page["images"].append(image)
                if figures:
                    waiting.append((image, figures[-1]))
            elif name == "figure":
                figures.append({"depth": depth, "caption": None})
            elif name in ("nav", "header"):
                nav_depths.append(depth)
            else:
                if name in ("footer", "div") and not re.search("footer", attrs.get("class", ""), re.I):
                    continue
                c = _Capture(name, attrs, depth)
                c.in_nav = len(nav_depths)
                c.in_figure = figures[-1] if figures else None
                open_.append(c)
        elif kind == "end":
            depth = len(path)
            if name in ("nav", "header") and nav_depths and nav_depths[-1] == depth:
                nav_depths.pop()
            elif name == "figure" and figures and figures[-1]["depth"] == depth:
                figures.pop()
            while open_ and open_[-1].depth >= depth:
                c = open_.pop()
                if _HEADING.match(c.name):
                    if text := c.joined():
                        page["headings"].append((int(c.name[1]), text))
                    if c.name in ("h1", "h2") and (text := c.spaced()):
                        page[c.name + "s"].append(text)
                elif c.name == "a" and "href" in c.attrs:
                    anchors.append((c.attrs["href"].strip(), c.joined(), c.attrs.get("rel")))
                elif c.name == "p":
                    paragraphs.append((c.joined(), c.spaced()))
                elif c.name in ("footer", "div"):
                    footers.append(c.spaced())
                elif c.name == "figcaption" and c.in_figure is not None and c.in_figure["caption"] is None:
                    c.in_figure["caption"] = "".join(p.strip() for p in c.parts)
                if c.in_nav and c.name in ("a", "li", "button"):
                    text = c.spaced()
                    if 1 <= len(text.split()) <= 4 and len(text) <= 35 and text.lower() not in lex.NAV_STOP:
                        _add(page["nav_items"], text)
    for image, figure in waiting:
        image["caption"] = figure["caption"] or ""

    seen = set()
    for href, text, rel in anchors:
        if href.startswith("mailto:"):
            _add(page["emails"], valid_email(href.removeprefix("mailto:").split("?")[0]))
        elif href.startswith("tel:"):
            _add(page["phones"], href.removeprefix("tel:").strip())
        elif _SOCIAL.search(href):
            _add(page["social_links"], href)
        target = urls.py_resolve(base, href)
        if target and (target, text, rel) not in seen:
            seen.add((target, text, rel))
            page["links"].append((target, text, urls.py_site_key(urls.py_host(target)) == own_key, rel))
    for m in metas:
        if "content" not in m:
            continue
        content = clean(m["content"])
        by, prop, item = (m.get(k, "").strip().lower() for k in ("name", "property", "itemprop"))
        if "description" in (by, prop, item) and not page["description"]:
            page["description"] = content
        elif by in ("robots", "googlebot") and not page["robots_meta"]:
            page["robots_meta"] = content
        for prefix, into in (("og:", "open_graph"), ("twitter:", "twitter_card")):
            first, second = (prop, by) if prefix == "og:" else (by, prop)
            if key := next((k for k in (first, second) if k.startswith(prefix)), None):
                page[into][key] = content
        if by and by not in ("description", "robots", "googlebot") and not by.startswith(("og:", "twitter:")):
            page["extra"][by] = content
        any_name = by or prop or item
        if content:
            if (any_name in ("description", "og:description", "twitter:description") or any_name.endswith(":description")) and not page["meta_description"]:
                page["meta_description"] = content
            elif any_name in ("og:site_name", "application-name") and not page["meta_site_name"]:
                page["meta_site_name"] = content
            elif any(d in any_name for d in ("published", "modified", "updated", "date", "time")):
                page["meta_dates"][any_name] = content
    if canonical:
        page["canonical_url"] = urls.py_resolve(url, canonical) or canonical
    page["description"] = page["description"] or page["open_graph"].get("og:description") or page["twitter_card"].get("twitter:description") or None
    page["title"] = page["title"] or page["open_graph"].get("og:title")
    described = next((clean(d) for d in (x.get("description") for x in objects) if isinstance(d, str) and len(d.strip()) > 10), None)
    page["description"] = page["description"] or described or next((p for p, _ in paragraphs if len(p) >= 40 and not any(k in p.lower() for k in lex.PARAGRAPH_BOILERPLATE)), None)
    page["paragraphs"] = [p for _, p in paragraphs if len(p) >= 30]
    page["meta_description"] = page["meta_description"] or described or next((p for p in page["paragraphs"] if not any(k in p.lower() for k in lex.PARAGRAPH_BOILERPLATE_TRUST)), None)
    page["body_text"] = clean(" ".join(body_visible if has_body else visible))
    page["clean_text"] = clean(" ".join(body_shown if has_body else shown))
    page["footer_text"] = " ".join(footers)
    search = f"{page['footer_text']} {page['clean_text']}"
    for m in _COPYRIGHT.finditer(search):
        _add(page["copyright_statements"], m[0].strip())
    for m in _EMAIL.finditer(search):
        _add(page["emails"], valid_email(m[0]))
    for x in objects:
        kinds = str(x.get("@type", "")).lower()
        page["json_ld"].append(json.dumps(x, ensure_ascii=False, sort_keys=True))
        if any(k in kinds for k in lex.ORGANIZATION_TYPES):
            page["organizations"].append(_organization(x))
        if any(k in kinds for k in lex.OFFERING_TYPES) and x.get("name"):
            _add(page["offerings"], str(x["name"]))
        page["has_address"] |= bool(x.get("address"))
        page["has_contact"] |= bool(x.get("telephone") or x.get("email"))
    return page


def parse_safely(url: str, html: str | None, closed: bool = False) -> dict[str, Any]:
    """Like ``parse``; what a page breaks is in its ``parse_error``, never in the job."""
    try:
        page = parse(url, html, closed)
    except Exception as error:  # noqa: BLE001
        page = parse(url, None) | {"parse_error": f"{type(error).__name__}: {error}"}
    page["headings"] = [{"level": n, "text": t} for n, t in page["headings"]]
    page["links"] = [dict(zip(("url", "text", "is_internal", "rel"), x, strict=True)) for x in page["links"]]
    return page

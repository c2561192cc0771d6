"""A small HTML reader: events of tags and text with implied end tags, for pages of any quality."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.entities import html5

#: Elements without content (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup (fixed values).
RAW = frozenset("script style xmp iframe noembed noframes plaintext textarea title".split())
#: Raw elements in which character references still count (fixed values).
ESCAPABLE = frozenset("textarea title".split())
#: Start tags that end an open paragraph (fixed values).
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split()
)
#: Start tags that end an open element of the second set, up to one of the third (fixed values).
ENDS_ITEM = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist", "optgroup"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "tr": (frozenset({"tr", "td", "th", "caption"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "thead": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}), frozenset({"table"})),
    "tbody": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}), frozenset({"table"})),
    "tfoot": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}), frozenset({"table"})),
}
#: Elements of running text: an end tag of a block closes those that are open in it (fixed values).
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"  # comment
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*>?"  # declaration
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"  # tag
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"  # tag with a stray quote
    r"|</[^a-zA-Z>][^>]*>|</>"  # bogus comment
    r"|[^<]+|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}


_CLOSED = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+)|([a-zA-Z][a-zA-Z0-9]*));")


def unescape_closed(text: str) -> str:
    """Like ``unescape``, but references that no semicolon ends stay as they are."""
    return _CLOSED.sub(lambda m: m[0] if m[1] and m[1] + ";" not in html5 else unescape(m[0]), text)


def attributes(source: str, closed: bool = False) -> dict[str, str]:
    """Attributes of a tag by lower-case name; the first of equal names counts.  ``closed`` as in ``tokens``."""
    decode = unescape_closed if closed else unescape
    out: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(source):
        value = double or single or bare
        out.setdefault(name.lower(), decode(value) if "&" in value else value)
    return out


def tokens(html: str, closed: bool = False) -> Iterator[tuple[str, str, str]]:
    """("start" | "end" | "text" | "raw" | "comment", name, source): text with decoded references, raw content of RAW.

    HTML decodes old names such as ``&amp`` without a semicolon too; with ``closed`` only references that a semicolon ends.
    """
    decode = unescape_closed if closed else unescape
    at, n = 0, len(html)
    match = _TOKEN.match
    while at < n:
        m = match(html, at)
        if m is None:
            yield "text", "", decode(html[at:])
            return
        at = m.end()
        name = m[2] or m[5]
        if name:
            name = name.lower()
            if m[1] or m[4]:
                yield "end", name, ""
                continue
            source = (m[3] or m[6] or "").strip()
            yield "start", name, source
            if name in RAW:
                end = _RAW_END[name].search(html, at)
                content = html[at : end.start() if end else n]
                yield "raw", name, decode(content) if name in ESCAPABLE and "&" in content else content
                yield "end", name, ""
                at = end.end() if end else n
            continue
        text = m[0]
        if text.startswith("<![CDATA["):
            yield "text", "", text[9:].removesuffix("]]>")
        elif text.startswith(("<!", "<?", "</")):
            yield "comment", "", text
        else:
            yield "text", "", decode(text) if "&" in text else text


def events(html: str, closed: bool = False) -> Iterator[tuple[str, str, str, tuple[str, ...]]]:
    """Like ``tokens`` with balanced tags: implied ends are given, stray ends are not; with the open elements.

    The last item of each event is the path of elements that hold it (for a start or end tag: of its parent).
    """
    stack: list[str] = []

    def close(to: int) -> Iterator[tuple[str, str, str, tuple[str, ...]]]:
        while len(stack) > to:
            name = stack.pop()
            yield "end", name, "", tuple(stack)

    for kind, name, source in tokens(html, closed):
        if kind == "start":
            if name in ENDS_PARAGRAPH:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i] == "p":
                        yield from close(i)
                        break
                    if stack[i] not in INLINE:
                        break
            if name in ENDS_ITEM:
                ends, upto = ENDS_ITEM[name]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i] in upto:
                        break
                    if stack[i] in ends:
                        yield from close(i)
                        if name in ("td", "th", "li", "dt", "dd", "option"):
                            break
            yield "start", name, source, tuple(stack)
            if name in VOID:
                yield "end", name, "", tuple(stack)
            else:
                stack.append(name)
        elif kind == "end":
            if name in VOID:
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] == name:
                    yield from close(i)
                    break
                if name in INLINE and stack[i] not in INLINE:
                    break  # an inline end tag doesn't close blocks
        else:
            yield kind, name, source, tuple(stack)
    yield from close(0)

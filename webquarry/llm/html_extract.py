"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markup
from .session import tune

#: Elements that never hold main text, whatever their ratios (fixed values).
BOILERPLATE = frozenset("nav footer aside form script style noscript template button select option datalist textarea iframe object svg math canvas audio video head title dialog menu input label fieldset map search".split())
#: Words of class, id and role that mark parts around an article (fixed values).
MARKS = re.compile(
    r"(?:ads?|advert\w*|adsense|adslot|banner\w*|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|foot|footer|masthead|comments?|commentlist|disqus\w*|reply|replies|responses?|discussion|cookie\w*|consent|gdpr|notices?|alert\w*|popup|modal|overlay|newsletter|subscri\w*|signup|login|share|sharing|social\w*|related|recommend\w*|pagination|pager|widget\w*|toolbar|toc|copyright|legal|disclaimer|skip|skiplink|search\w*|tags?|complementary|contentinfo|navigation|dialog|hidden)",
    re.I,
)
#: Pairs of words that do so together (fixed values).
MARKED_PAIRS = frozenset({"side-bar", "site-header", "page-header", "skip-link"})
#: First words of names that tell how a part is laid out, not what it is (fixed values).
QUALIFIERS = frozenset("with without no not has have hide show is single layout page wrap wrapper".split())
#: Elements that begin and end a block of text (fixed values).
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that hold the article where they hold most of the content (fixed values).
ARTICLE = frozenset({"article", "main"})
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")
_SPACE = re.compile(r"\s+")


@dataclass
class Node:
    """A block of text: its root-to-leaf tag path, the numbers of the elements that hold it, its text and link text."""

    path: tuple[str, ...]
    holders: tuple[int, ...]
    text: str
    linked: int
    outside: bool
    inside_article: bool
    marked: tuple[int, ...] = ()


@dataclass
class _Open:
    name: str
    number: int
    outside: bool
    article: bool
    marked: bool = False


def is_mark(names: str) -> bool:
    """Whether a class, id or role names a part around an article: a whole name, or the first or last word of one that doesn't
    begin with a word of layout (``comments``, ``post-comments``; not ``no-comments``, ``with-sidebar``)."""
    for name in names.lower().split():
        parts = [x for x in re.split("[-_]+", name) if x]
        if not parts or len(parts) > 1 and parts[0] in QUALIFIERS and "-".join(parts[:2]) not in MARKED_PAIRS:
            continue
        if MARKS.fullmatch(parts[0]) or MARKS.fullmatch(parts[-1]) or "-".join(parts[:2]) in MARKED_PAIRS:
            return True
    return False


def nodes(html: str) -> list[Node]:
    """The blocks of a page in page order.  Text that runs on within one block is one node, whatever inline tags it has.

    What stands in an element that a class, id or role marks as something else is outside, unless that element holds 70 % of
    the page's other text, and a main heading or an article: then its name tells of the layout.
    """
    out: list[Node] = []
    stack: list[_Open] = []
    parts: list[str] = []
    linked = 0
    count = 0
    links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            parts.clear()
            if text:
                blocks = [o for o in stack if o.name not in markup.INLINE]
                out.append(Node(tuple(o.name for o in blocks), tuple(o.number for o in blocks), text, min(linked, len(text)), any(o.outside for o in stack), any(o.article for o in stack), tuple(o.number for o in stack if o.marked)))
        linked = 0

    for kind, name, source, _ in markup.events(html):
        if kind == "text":
            parts.append(source)
            if links:
                linked += len(source.strip())
        elif kind == "start":
            if name == "br":
                parts.append(" ")
                continue
            block = name in BLOCKS or name in BOILERPLATE
            if block:
                flush()
            if name in markup.VOID:
                continue
            outside, marked = name in BOILERPLATE, False
            if source and not outside and name not in ("html", "body"):
                has = markup.attributes(source)
                outside = "hidden" in has or has.get("aria-hidden") == "true"
                marked = is_mark(" ".join(has.get(k) or "" for k in ("class", "id", "role")))
            count += 1
            # A heading of the whole page stands around the article, one inside an article belongs to it.
            outside = outside or name == "header" and not any(o.article for o in stack)
            stack.append(_Open(name, count, outside, name in ARTICLE, marked))
            links += name == "a"
        elif kind == "end" and name not in markup.VOID:
            if name in BLOCKS or name in BOILERPLATE:
                flush()
            if stack:
                stack.pop()
            links -= name == "a"
    flush()
    total = sum(len(x.text) for x in out if not x.outside)
    held: dict[int, int] = {}
    heads: set[int] = set()
    for x in out:
        for h in x.marked if not x.outside else ():
            held[h] = held.get(h, 0) + len(x.text)
            if x.inside_article or "h1" in x.path:
                heads.add(h)
    for x in out:
        x.outside = x.outside or any(held[h] < 0.7 * total or h not in heads for h in x.marked)
    return out


def path_scores(found: list[Node], sigma: float = 1.0) -> list[float]:
    """A score for each node: the fused and smoothed ratios of its tag path.

    For each path, over all nodes that have it: characters for each node (text ratio) and punctuation marks for each
    node (punctuation ratio), both without the text of links.  The two are fused as their geometric mean with the
    share of text outside links, and smoothed over the page order with a Gaussian of ``sigma`` nodes.
    """
    length: dict[tuple[str, ...], float] = {}
    marks: dict[tuple[str, ...], float] = {}
    links: dict[tuple[str, ...], float] = {}
    size: dict[tuple[str, ...], int] = {}
    for x in found:
        length[x.path] = length.get(x.path, 0) + len(x.text)
        marks[x.path] = marks.get(x.path, 0) + len(_PUNCTUATION.findall(x.text))
        links[x.path] = links.get(x.path, 0) + x.linked
        size[x.path] = size.get(x.path, 0) + 1
    fused = {p: math.sqrt((length[p] - links[p]) / n * (1 + marks[p]) / n) * (1 - links[p] / length[p]) for p, n in size.items()}
    raw = [0.0 if x.outside else fused[x.path] for x in found]
    reach = int(3 * sigma)
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(reach + 1)]
    out = []
    for i in range(len(raw)):
        total = weight = 0.0
        for d in range(-reach, reach + 1):
            if 0 <= i + d < len(raw):
                total += kernel[abs(d)] * raw[i + d]
                weight += kernel[abs(d)]
        out.append(total / weight)
    return out


def headed(every: list[Node], chosen: list[Node]) -> list[Node]:
    """The chosen blocks, after the main heading of the page if it is the only one and stands before them."""
    heads = [k for k, x in enumerate(every) if "h1" in x.path]
    if len(heads) != 1 or not chosen or any(x is every[heads[0]] for x in chosen):
        return chosen
    first = next(k for k, x in enumerate(every) if x is chosen[0])
    return [every[heads[0]], *chosen] if heads[0] < first else chosen


def main_text(html: str | None) -> str:
    """The main text of a page: its blocks joined by line ends; empty if there is none.

    Paths whose score is at least the standard deviation of all scores are content.  The element that holds most of
    the content text most closely is the article; all of its blocks are kept, short ones too, except those in parts
    that are marked as something else.  Article and main elements break ties: where they hold most of the content too,
    the innermost one that does is the article, or, if it takes several, all of them are.  The page's only main heading
    belongs to the article where it stands before it.
    """
    if not html:
        return ""
    found = nodes(html)
    kept = [x for x in found if not x.outside]
    if not kept:
        return ""
    every = kept
    scores = [s for x, s in zip(found, path_scores(found), strict=True) if not x.outside]
    mean = sum(scores) / len(scores)
    threshold = min(math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores)), max(scores))
    content = {x.path for x, s in zip(kept, scores, strict=True) if s >= threshold}
    chosen = [x for x in kept if x.path in content]
    total = sum(len(x.text) for x in chosen)
    inside: dict[int, int] = {}
    depth: dict[int, int] = {}
    articles: set[int] = set()
    for x in chosen:
        for d, h in enumerate(x.holders):
            inside[h] = inside.get(h, 0) + len(x.text)
            depth[h] = d
            if x.path[d] in ARTICLE:
                articles.add(h)
    most = [h for h, n in inside.items() if n >= 0.7 * total]
    if sum(len(x.text) for x in chosen if x.inside_article) >= 0.7 * total:
        kept = [x for x in kept if x.inside_article]
        most = [h for h in most if h in articles]
        if not most:
            return "\n".join(x.text for x in headed(every, kept))
    if not most:
        return "\n".join(x.text for x in headed(every, chosen))
    root = max(most, key=lambda h: (depth[h], -h))
    return "\n".join(x.text for x in headed(every, [x for x in kept if root in x.holders]))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages``, row by row, without a shuffle.

    Null or empty html, and pages without main text, give the empty text; repeated rows give repeated rows; an empty
    table gives an empty result; null ids and urls are kept; other columns are not looked at.
    """
    tune(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")

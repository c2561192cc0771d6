"""URL functions as column expressions, and the same normal form in plain Python for the page parser."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable
from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lex

_IPV4 = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
_IPV6 = r"^(?=(?:[^:]*:){2})[0-9a-f:]+(?:\d+(?:\.\d+){3})?$"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """Binds a value once, so that nested expressions don't multiply in the plan."""
    return F.element_at(F.transform(F.array(value), then), 1)


def strip(c: Column) -> Column:
    """Without white space (of any script) at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _unbracket(c: Column) -> Column:
    return F.lower(F.regexp_replace(strip(c), r"^\[(.*)\]$", "$1"))


def host(target: Column) -> Column:
    """The host of a URL, ``//host``, bare host, host with port or address literal; null if there is none."""

    def of(raw: Column) -> Column:
        netloc = F.regexp_extract(raw, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)
        in_url = let(
            F.regexp_replace(netloc, r"^.*@", ""),
            lambda n: F.coalesce(F.nullif(F.lower(F.when(n.startswith("["), F.regexp_extract(n, r"^\[([^\]]*)\]", 1)).otherwise(F.substring_index(n, ":", 1))), F.lit("")), _unbracket(n)),
        )
        first = F.substring_index(raw, "/", 1)
        bare = F.when(raw.rlike(r"^\[[^\]]*\]"), F.lower(F.regexp_extract(raw, r"^\[([^\]]*)\]", 1))).when(F.length(first) - F.length(F.replace(first, F.lit(":"), F.lit(""))) == 1, _unbracket(F.substring_index(first, ":", 1))).otherwise(_unbracket(first))
        return F.nullif(F.when(raw.contains("://") | raw.startswith("//"), in_url).otherwise(bare), F.lit(""))

    return let(strip(target), of)


def is_ip(h: Column) -> Column:
    return h.rlike(_IPV4) | h.rlike(_IPV6)


def _ipv4_private(h: Column) -> Column:
    part = lambda i: F.split(h, r"\.").getItem(i).cast("int")
    a, b, c, d = (part(i) for i in range(4))
    return (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
        | ((a == 192) & (b == 0) & (c == 0) & ~d.isin(9, 10)) | ((a == 192) & (b == 0) & (c == 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    )


def _ipv6_private(h: Column) -> Column:
    """All outside 2000::/3, and the parts of it that are set aside."""
    first = F.coalesce(F.conv(F.nullif(F.substring_index(h, ":", 1), F.lit("")), 16, 10).cast("long"), F.lit(0))
    second = F.coalesce(F.conv(F.nullif(F.split(h, ":").getItem(1), F.lit("")), 16, 10).cast("long"), F.lit(0))
    return ~first.between(0x2000, 0x3FFF) | ((first == 0x2001) & ((second < 0x200) | (second == 0xDB8))) | (first == 0x2002) | ((first == 0x3FFF) & (second < 0x1000))


def host_is_private(h: Column) -> Column:
    """Whether a host (null: yes) names a private, local or reserved place; nothing is resolved."""
    named = h.isin(lex.PRIVATE_HOSTS) | F.exists(F.array(*[F.lit(s) for s in lex.PRIVATE_SUFFIXES]), lambda s: F.endswith(h, s))
    return F.coalesce(named | F.when(h.rlike(_IPV4), _ipv4_private(h)).when(h.rlike(_IPV6), _ipv6_private(h)).otherwise(False), F.lit(True))


def is_private(target: Column) -> Column:
    return let(host(target), host_is_private)


def site_key(h: Column) -> Column:
    """What two hosts of one site share: the last two labels; an address or a single label itself."""
    return F.when(is_ip(h), h).otherwise(F.substring_index(h, ".", -2))


def same_domain(a: Column, b: Column) -> Column:
    return F.coalesce(host(a) == host(b), F.lit(False))


def same_site(a: Column, b: Column) -> Column:
    return F.coalesce(let(host(a), site_key) == let(host(b), site_key), F.lit(False))


def normalize(url: Column, default_scheme: str = "https") -> Column:
    """The normal form of a web URL; null for everything that isn't a public one.

    Scheme and host in lower case, no user, fragment, parameters, default port or slashes at the end; the case of path
    and query stays.
    """

    def parts(full: Column) -> Column:
        pattern = r"^(?i)(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#[\s\S]*)?$"
        part = lambda i: F.regexp_extract(full, pattern, i)
        authority = F.regexp_replace(part(2), r"^[\s\S]*@", "")
        bracketed = authority.startswith("[")
        name = F.lower(F.when(bracketed, F.regexp_extract(authority, r"^\[([^\]]*)\]", 1)).otherwise(F.substring_index(authority, ":", 1)))
        port = F.when(bracketed, F.regexp_extract(authority, r"^\[[^\]]*\](?::(.*))?$", 1)).otherwise(F.regexp_extract(authority, r"^[^:]*:(.*)$", 1))
        path = F.regexp_replace(F.regexp_replace(part(3), r";[^/]*$", ""), r"/+$", "")
        return F.struct(full.rlike(pattern).alias("ok"), F.lower(part(1)).alias("scheme"), name.alias("host"), port.alias("port"), path.alias("path"), part(4).alias("query"))

    def join(p: Column) -> Column:
        port = F.nullif(F.regexp_replace(p["port"], r"^0+(?=\d)", ""), F.lit("0"))
        fine = p["ok"] & (p["host"] != "") & ~p["host"].rlike(r"[ \t\n]") & ~host_is_private(p["host"]) & p["port"].rlike(r"^\d*$") & (F.coalesce(F.nullif(p["port"], F.lit("")).try_cast("int"), F.lit(0)) <= 65535)
        usual = F.when(p["scheme"] == "http", F.lit("80")).otherwise(F.lit("443"))
        netloc = F.concat(F.when(p["host"].contains(":"), F.concat(F.lit("["), p["host"], F.lit("]"))).otherwise(p["host"]), F.when((F.coalesce(port, F.lit("")) != "") & (port != usual), F.concat(F.lit(":"), port)).otherwise(""))
        return F.when(fine, F.concat(p["scheme"], F.lit("://"), netloc, p["path"], F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise("")))

    def with_scheme(raw: Column) -> Column:
        scheme = F.regexp_extract(raw, r"^([a-zA-Z0-9+.-]+):", 1)
        full = F.when(scheme == "", F.concat(F.lit(f"{default_scheme}://"), raw)).when(F.lower(scheme).isin("http", "https"), raw)
        return let(let(F.translate(full, "\t\r\n", ""), parts), join)

    return let(F.nullif(strip(url), F.lit("")), with_scheme)


def is_valid(url: Column) -> Column:
    return normalize(url).isNotNull()


def canonical(url: Column) -> Column:
    """The normal form, or the text without slashes at the end; empty for null."""
    return F.coalesce(normalize(url), F.regexp_replace(strip(url), r"/+$", ""), F.lit(""))


def equivalence_key(url: Column) -> Column:
    """Equal for URLs that differ in scheme, ``www.``, case or slashes at the end only; null for null and empty ones."""

    def key(u: Column) -> Column:
        rest = F.regexp_replace(F.regexp_replace(F.lower(u), r"/+$", ""), r"^[\s\S]*?://", "")
        return F.nullif(F.regexp_replace(rest, r"^www\.", ""), F.lit(""))

    return let(canonical(url), key)


def _segments(url: Column) -> Column:
    path = F.when(url.contains("://") | url.startswith("//"), F.regexp_extract(url, r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)", 1)).otherwise(F.regexp_extract(url, r"^([^?#]*)", 1))
    return F.filter(F.transform(F.split(path, "/"), lambda s: F.lower(strip(s))), lambda s: s != "")


def _locale_of(first: Column) -> Column:
    letters = first.rlike(r"^[a-z]{2,4}[-_][a-z]{2,4}$") | first.rlike(r"^[a-z]{2,3}$")
    return F.when(first.isin(lex.NON_LOCALE_SEGMENTS), None).when(first.isin(lex.REGIONAL_SLUGS) | letters, first)


def locale(url: Column) -> Column:
    """The locale that the first path segment names; null if it names none."""
    return let(_segments(url), lambda s: _locale_of(F.get(s, 0)))


def is_locale_root(url: Column) -> Column:
    return F.coalesce(let(_segments(url), lambda s: (F.size(s) == 1) & _locale_of(F.get(s, 0)).isNotNull()), F.lit(False))


def same_locale(a: Column, b: Column) -> Column:
    return locale(a).eqNullSafe(locale(b))


def is_regional_sibling(root: Column, candidate: Column) -> Column:
    """Whether the root has a locale and the candidate, on the same site, another one."""
    return F.coalesce((locale(root) != locale(candidate)) & same_site(root, candidate), F.lit(False))


# The same in Python, for the page parser ---------------------------------------------------------------------------


def resolve(base: Column, href: Column) -> Column:
    """A reference against the address that it stands in, dot segments taken out of its path; not in normal form yet."""
    ref = strip(href)
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    tail = F.regexp_extract(ref, r"([?#].*)$", 1)
    own = F.regexp_extract(ref, "^([^?#]*)", 1)
    full = F.when(F.startswith(own, F.lit("/")), own).when(own == "", path).otherwise(F.concat(F.regexp_extract(path, "^(.*/)", 1), own))

    def plain(whole: Column) -> Column:
        parts = F.split(F.regexp_replace(whole, "^/", ""), "/")
        last = F.element_at(parts, -1)
        step = lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.array_append(a, x))
        kept = F.aggregate(parts, F.array().cast("array<string>"), step)
        return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))

    return (
        F.when(ref.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), ref)
        .when(F.startswith(ref, F.lit("//")), F.concat(F.regexp_extract(base, "^([^:]*:)", 1), ref))
        .otherwise(F.concat(origin, F.when((full == "") | (origin == ""), full).otherwise(let(full, plain)), F.when((own == "") & ~F.startswith(tail, F.lit("?")), F.concat(F.regexp_extract(base, r"(\?[^#]*)", 1), tail)).otherwise(tail)))
    )


def py_host(target: str) -> str:
    raw = target.strip()
    if "://" in raw or raw.startswith("//"):
        try:
            return (urlsplit(raw).hostname or urlsplit(raw).netloc).strip("[]").lower()
        except ValueError:
            return ""
    first = raw.split("/")[0]
    if raw.startswith("[") and "]" in raw:
        return raw[1 : raw.index("]")].lower()
    return (first.split(":")[0] if first.count(":") == 1 else first).strip().lower()


def py_private(name: str) -> bool:
    if not name or name in lex.PRIVATE_HOSTS or name.endswith(tuple(lex.PRIVATE_SUFFIXES)):
        return True
    try:
        ip = ipaddress.ip_address(name)
    except ValueError:
        return False
    return ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_unspecified or ip.is_reserved or ip.is_multicast


def py_site_key(name: str) -> str:
    try:
        ipaddress.ip_address(name)
        return name
    except ValueError:
        return ".".join(name.split(".")[-2:])


def py_normalize(url: str) -> str | None:
    raw = url.strip()
    scheme = re.match(r"([a-zA-Z0-9+.-]+):", raw)
    if scheme and scheme[1].lower() not in ("http", "https") or not raw:
        return None
    try:
        parts = urlsplit(raw if scheme else f"https://{raw}")
        name, port = parts.hostname or "", parts.port
    except ValueError:
        return None
    if py_private(name) or re.search(r"[ \t\n]", name):
        return None
    shown = f"[{name}]" if ":" in name else name
    if port and port != {"http": 80, "https": 443}[parts.scheme]:
        shown += f":{port}"
    path = re.sub(r"/+$", "", re.sub(r";[^/]*$", "", parts.path))
    return f"{parts.scheme}://{shown}{path}" + (f"?{parts.query}" if parts.query else "")


def py_resolve(base: str, href: str) -> str | None:
    """The normal form of a link on a page; null for fragments, other schemes and private targets."""
    href = href.strip()
    if not href or href.startswith("#") or re.match(lex.SKIPPED_SCHEMES, href, re.I):
        return None
    try:
        return py_normalize(urljoin(base, href))
    except ValueError:
        return None

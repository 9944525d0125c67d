"""URL rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters the URL path keeps unencoded but java.net.URLEncoder escapes:
# put them back after url_encode (WHATWG path percent-encode set).
_KEEP = [("%2F", "/"), ("%2C", ","), ("%21", "!"), ("%24", "$"), ("%26", "&"), ("%27", "'"),
         ("%28", "("), ("%29", ")"), ("%2B", "+"), ("%3A", ":"), ("%3B", ";"), ("%3D", "="),
         ("%40", "@"), ("%7E", "~"), ("%5B", "["), ("%5D", "]"), ("%7C", "|"), ("%25", "%"),
         ("%5C", "/")]


def _let(value: Column, f) -> Column:
    """``f(value)`` with the value worked out once, however often ``f`` names
    it: a Column that is used twice is otherwise two copies of its expression."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def encode_path(p: Column) -> Column:
    """Percent-encode a URL path the way browsers do: non-ASCII as UTF-8
    %XX (upper case), space as %20, the reserved sub-delims kept."""
    e = F.regexp_replace(F.url_encode(p), r"\+", "%20")
    for code, ch in _KEEP:
        e = F.replace(e, F.lit(code), F.lit(ch))
    return e


def encode_tail(t: Column) -> Column:
    """Percent-encode ``?query#fragment`` the way browsers do: non-ASCII as
    UTF-8, and space, quotes, < and > (in a query also ') as %XX."""
    keep = [*_KEEP[:-1], ("%23", "#"), ("%3F", "?"), ("%7B", "{"), ("%7D", "}"), ("%5E", "^"), ("%60", "`"), ("%5C", "\\")]
    e = F.regexp_replace(F.url_encode(t), r"\+", "%20")
    for code, ch in keep:
        e = F.replace(e, F.lit(code), F.lit(ch))

    def parts(e: Column) -> Column:
        query, after = F.regexp_extract(e, r"^([^#]*)", 1), F.regexp_extract(e, r"^[^#]*#(.*)$", 1)
        hash_ = F.when(e.contains("#"), F.lit("#")).otherwise(F.lit(""))
        return F.concat(F.replace(query, F.lit("'"), F.lit("%27")), hash_, F.replace(after, F.lit("`"), F.lit("%60")))

    return _let(e, parts)


def _remove_dot_segments(path: Column) -> Column:
    """RFC 3986 dot-segment removal over the split path (Catalyst aggregate)."""
    def walk(segs: Column) -> Column:
        out = F.aggregate(
            F.slice(segs, 2, F.greatest(F.size(segs) - 1, F.lit(0))),
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc)
            .otherwise(F.concat(acc, F.array(s))),
        )
        trailing = F.element_at(segs, -1).isin(".", "..")
        return _let(out, lambda o: F.concat(F.lit("/"), F.array_join(o, "/"), F.when(trailing & (F.size(o) > 0), F.lit("/")).otherwise(F.lit(""))))

    return _let(F.split(path, "/"), walk)


def _no_default_port(scheme: Column, host: Column) -> Column:
    return F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)


def absolutize(href: Column, base: Column) -> Column:
    """Resolve ``href`` against ``base``. Empty -> ''; hrefs with a
    scheme are kept (host lower-cased); protocol-relative, root-relative,
    query-only, fragment-only and relative paths (with dot segments) are
    resolved; the path is percent-encoded like a browser does."""
    def based(x: Column) -> Column:
        h, b = x["h"], x["b"]
        scheme = F.lower(F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
        base_host = F.regexp_extract(b, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
        base_path = F.regexp_extract(b, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
        base_query = F.regexp_extract(b, r"^[^?#]*(\?[^#]*)?", 1)
        path, tail = F.regexp_extract(h, r"^([^?#]*)", 1), F.regexp_extract(h, r"^[^?#]*(.*)$", 1)
        own, hier = r"^[A-Za-z][A-Za-z0-9+.-]*:", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"
        host, h_path, h_tail = (F.regexp_extract(h, hier + r, 1) for r in (r"([^/?#]*)", r"[^/?#]*([^?#]*)", r"[^/?#]*[^?#]*(.*)$"))
        part = lambda s, o, p, t: F.struct(s.alias("scheme"), o.alias("host"), p.alias("path"), t.alias("tail"))
        parts = (
            F.when(h.rlike(own), part(F.lower(F.regexp_extract(h, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), host, h_path, h_tail))
            .when(h.startswith("//"), part(scheme, host, h_path, h_tail))
            .when(h.startswith("/"), part(scheme, base_host, path, tail))
            .when(h.startswith("?"), part(scheme, base_host, base_path, h))
            .when(h.startswith("#"), part(scheme, base_host, base_path, F.concat(base_query, h)))
            .otherwise(part(scheme, base_host, F.concat(F.regexp_replace(F.when(base_path == "", F.lit("/")).otherwise(base_path), r"[^/]*$", ""), path), tail))
        )
        whole = _let(parts, lambda u: F.concat(
            u["scheme"], F.lit("://"), _no_default_port(u["scheme"], F.lower(u["host"])),
            encode_path(_remove_dot_segments(F.when(u["path"] == "", F.lit("/")).otherwise(u["path"]))), encode_tail(u["tail"])))
        other = h.rlike(own) & ~h.rlike(r"(?i)^https?://")
        return F.when(h == "", F.lit("")).when((scheme == "") | other, h).otherwise(whole)

    return _let(F.struct(F.trim(F.coalesce(href, F.lit(""))).alias("h"), F.coalesce(base, F.lit("")).alias("b")), based)


def host_of(url: Column) -> Column:
    """Host of a url, lower-cased, ``www.`` dropped, '' if unparsable."""
    h = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)", 1))
    return F.regexp_replace(h, r"^www\.", "")


# --- fixed values: scrapable-page messages and patterns -----------------------
MSG_NO_PAGE = "No page to work on."
MSG_BROWSER = "Browser pages cannot be scraped. Open a website in this tab."
MSG_STORE = "The Chrome Web Store cannot be scraped."
BROWSER_SCHEMES = (r"(?i)^(chrome|edge|brave|opera|vivaldi|about|devtools|view-source|chrome-extension|"
                   r"chrome-search|chrome-untrusted):")
STORE_URL = r"(?i)^https://(chrome\.google\.com/webstore|chromewebstore\.google\.com)"


def restricted_reason(url: Column) -> Column:
    """Why a page cannot be scraped ('' when it can)."""
    u = F.coalesce(url, F.lit(""))
    return (
        F.when(u == "", MSG_NO_PAGE)
        .when(u.rlike(BROWSER_SCHEMES), MSG_BROWSER)
        .when(u.rlike(STORE_URL), MSG_STORE)
        .otherwise("")
    )

"""URL columns: resolving, normalizing and splitting, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _SPLIT, i)


def host(url: Column) -> Column:
    """host[:port], with user data where there is some; '' if there is none."""
    return _part(url, 2)


def path(url: Column) -> Column:
    return _part(url, 3)


def _no_dots(p: Column) -> Column:
    """Without '.' and '..' segments; '..' takes the segment before it, at the root nothing."""
    parts = F.split(p, "/")
    last = F.element_at(parts, -1)
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == ".", acc).when(x == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)).otherwise(F.concat(acc, F.array(x))),
    )
    tail = F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    return F.when(p.contains("/.") | p.startswith("."), F.concat(F.array_join(folded, "/"), tail)).otherwise(p)


def resolve(url: Column, referer: Column) -> Column:
    """RFC 3986: url as read on the page `referer`."""
    base = F.concat(F.lower(_part(referer, 1)), F.lit("://"), host(referer))
    folder = F.regexp_replace(F.when(path(referer) == "", F.lit("/")).otherwise(path(referer)), r"[^/]*$", "")
    rest = F.concat(_part(url, 4), _part(url, 5))
    return (
        F.when(referer.isNull() | (_part(url, 1) != ""), url)
        .when(url == "", referer)
        .when(url.startswith("//"), F.concat(F.lower(_part(referer, 1)), F.lit(":"), url))
        .when(url.startswith("/"), F.concat(base, _no_dots(path(url)), rest))
        .when(url.startswith("?"), F.concat(base, path(referer), url))
        .when(url.startswith("#"), F.concat(base, path(referer), _part(referer, 4), url))
        .otherwise(F.concat(base, _no_dots(F.concat(folder, path(url))), rest))
    )


def unquote(url: Column) -> Column:
    """Percent escapes decoded; '+' and broken escapes stay."""
    safe = F.regexp_replace(F.replace(url, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(url.contains("%"), F.coalesce(F.try_url_decode(safe), url)).otherwise(url)


def normalize(url: Column, referer: Column | None = None) -> Column:
    """Resolved, scheme in lower case, an empty query or fragment mark dropped, unquoted, cut at the first '#', without '/' at the end.

    The host keeps its case; '%23' cuts like '#', because decoding comes first.
    """
    u = url if referer is None else resolve(url, referer)
    scheme = _part(u, 1)
    u = F.when(scheme != "", F.concat(F.lower(scheme), F.substring(u, F.length(scheme) + 1, 1 << 30))).otherwise(u)
    u = F.regexp_replace(F.regexp_replace(u, "#$", ""), r"\?(#|$)", "$1")
    return F.regexp_replace(F.regexp_replace(unquote(u), "(?s)#.*$", ""), "/+$", "")

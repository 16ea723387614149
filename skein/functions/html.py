"""HTML columns, by patterns: the text of a page, and its links."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

REMOVED = [r"(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)\s*>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"]
#: href in double quotes, single quotes or none; an anchor ends at its end tag, at the next anchor, or with the page.
ANCHOR = r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))[^>]*>(.*?)(?=</a\s*>|<a\s|\z)"
ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def _letter(entity: Column) -> Column:
    """The letter of one entity; an unknown name stays as it is, and a number beyond Unicode is U+FFFD."""
    hexadecimal = F.conv(F.regexp_extract(entity, "[xX]([0-9a-fA-F]+)", 1), 16, 10)
    code = F.when(entity.rlike("^&#[xX]"), hexadecimal).otherwise(F.regexp_extract(entity, "([0-9]+)", 1)).cast("int")
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    number = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))
    names = F.create_map(*[F.lit(x) for name, n in name2codepoint.items() for x in (f"&{name};", chr(n))])
    return F.when(entity.startswith("&#"), number).otherwise(F.coalesce(F.element_at(names, entity), entity))


def unescape(text: Column) -> Column:
    """Named entities of HTML 4 and numeric ones to letters, in one pass."""
    found = F.transform(F.regexp_extract_all(text, F.lit(ENTITY), 0), _letter)
    joined = F.array_join(F.zip_with(F.split(text, ENTITY, -1), found, lambda piece, letter: F.concat(piece, F.coalesce(letter, F.lit("")))), "")
    return F.when(text.rlike(ENTITY), joined).otherwise(text)


def html_text(html: Column) -> Column:
    """Text nodes joined without a separator; scripts, styles, comments and tags removed; trimmed."""
    for pattern in REMOVED:
        html = F.regexp_replace(html, pattern, "")
    # Bound to a lambda's variable, so that the pattern work above is done once.
    return F.regexp_replace(F.element_at(F.transform(F.array(html), unescape), 1), r"^\s+|\s+$", "")


def anchors(html: Column) -> Column:
    """Array of (href, text) of the links, in order."""
    href = lambda a: F.concat(*[F.regexp_extract(a, ANCHOR, i) for i in (1, 2, 3)])
    return F.transform(
        F.regexp_extract_all(html, F.lit(ANCHOR), 0),
        lambda a: F.struct(unescape(href(a)).alias("href"), unescape(F.regexp_replace(F.regexp_extract(a, ANCHOR, 4), REMOVED[2], "")).alias("text")),
    )

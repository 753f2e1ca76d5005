"""HTML columns: blocks, tags, character references. Everything is native."""

from __future__ import annotations

import html
import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.literal import LiteralMap, replace_matches, word_pattern
from quire.functions.rows import let
from quire.functions.text import as_col, collapse_space, strip

# The shape of a character reference in HTML 5, and the value of one that is none.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_REPLACED = "\ufffd"
# What sites put after a title, its page of pages, and before an author, the era; both have to go.
PAGE_MARK = r"\s*（\s*\d+\s*/\s*\d+\s*）\s*$"
ERA = r"^[（(][^）)]*[）)]"
#: Below this number references have values of their own, as the standard's table says.
_PLAIN = 0xA0

TAG = r"<[^>]+>"
_DROPPED = {
    "comment": r"(?s)<!--.*?-->",
    "script": r"(?is)<script\b[^>]*>.*?</script\s*>",
    "style": r"(?is)<style\b[^>]*>.*?</style\s*>",
}


def drop_blocks(c: str | Column, blocks: tuple[str, ...] = ("comment", "script", "style")) -> Column:
    """Remove comments and the blocks whose text is no page text."""
    out = as_col(c)
    for block in blocks:
        out = F.regexp_replace(out, _DROPPED[block], "")
    return out


def remove_tags(c: str | Column) -> Column:
    return F.regexp_replace(as_col(c), TAG, "")


def _numbered(body: Column) -> Column:
    """Value of `#123` or `#x7b`, with or without a semicolon."""
    digits = F.regexp_extract(body, "^#[xX]?0*([0-9a-fA-F]*)", 1)
    in_hex = body.rlike("^#[xX]")
    beyond = F.length(digits) > F.when(in_hex, 6).otherwise(7)
    in_base = [F.conv(F.concat(F.lit("0"), digits), base, 10).cast("int") for base in (16, 10)]
    number = F.when(beyond, F.lit(0x110000)).when(in_hex, in_base[0]).otherwise(in_base[1])
    low = F.split(F.lit("\ue000".join(html.unescape(f"&#{n};") for n in range(_PLAIN))), "\ue000", -1)

    def value(n: Column) -> Column:
        no_char = n.between(0xFDD0, 0xFDEF) | (F.pmod(n, F.lit(0x10000)) >= 0xFFFE)
        return (
            F.when(n < _PLAIN, F.get(low, n)).when((n > 0x10FFFF) | n.between(0xD800, 0xDFFF), _REPLACED).when(no_char, "")
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
        )

    return let(number, value)


def _named(body: Column, token: Column) -> Column:
    """Value of `amp;`; of `ampere` the longest name that needs no semicolon counts, and the rest stays."""
    names = html.entities.html5
    bare = {name: value for name, value in names.items() if not name.endswith(";")}
    start = F.regexp_extract(body, f"^({word_pattern(bare)})", 1)
    part = F.when(start != "", F.concat(LiteralMap(bare).get(start), F.substring(body, F.length(start) + 1, F.length(body))))
    return F.coalesce(LiteralMap(names).get(body), part, token)


def _reference(token: Column) -> Column:
    body = F.substring(token, 2, 40)
    return F.when(body.startswith("#"), _numbered(token.substr(F.lit(2), F.length(token)))).otherwise(_named(body, token))


def unescape_html(c: str | Column) -> Column:
    """Resolve character references, once; what names no character stays."""

    def resolved(text: Column) -> Column:
        return F.when(F.contains(text, F.lit("&")), replace_matches(text, REFERENCE, _reference)).otherwise(text)

    return let(as_col(c), resolved)


def strip_tags(c: str | Column, drop: tuple[str, ...] = ()) -> Column:
    """Text of an HTML fragment on one line."""
    return collapse_space(unescape_html(remove_tags(drop_blocks(c, drop))))


def clean_title(c: str | Column) -> Column:
    """Tags and references resolved, a trailing page mark such as `（1 / 3）` removed."""
    return _title_tail(unescape_html(remove_tags(c)))


def clean_author(c: str | Column) -> Column:
    """Leading era in brackets removed."""
    return strip(F.regexp_replace(as_col(c), ERA, ""))


def _title_tail(text: Column) -> Column:
    return strip(F.regexp_replace(strip(text), PAGE_MARK, ""))


#: How the text of an extracted fragment is cleaned once tags and references are resolved.
CLEANERS = {
    "raw": lambda text: text,
    "text": collapse_space,
    "title": _title_tail,
    "author": lambda text: clean_author(collapse_space(text)),
    "intro": lambda text: collapse_space(_title_tail(text)),
}


def unescape_array(arr: str | Column) -> Column:
    """References resolved in every element."""
    return F.transform(arr, unescape_html)

"""Tables of raw pages to tables of records, links, sections and texts.

Every operator works inside one row: a page is cut with regular expressions into arrays, cleaned and
exploded, so none of them shuffles. Patterns are arguments; a site is a set of patterns, not code.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.fallback import CONTENTS_HEADINGS, JUNK_CLASSES, sections_nested
from quire.functions.html import (
    CLEANERS,
    drop_blocks,
    remove_tags,
    unescape_array,
    unescape_html,
)
from quire.functions.rows import explode_rows, settle
from quire.functions.text import as_col, decode_title, is_blank, split_lines, strip

INTRO_LENGTH = 120
BLOCK_END = r"(?i)</p\s*>|<br\s*/?>"


@dataclass(frozen=True)
class Field:
    """One field of a card: first group of `pattern`, cleaned, optionally cut; `default` makes the value of an empty
    one from the card's raw fields."""

    pattern: str
    clean: str = "title"
    max_chars: int | None = None
    default: Callable[[Mapping[str, Column]], Column] | None = None


def first_group(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1)


def all_groups(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def extract_cards(
    pages: DataFrame, card: str, fields: Mapping[str, Field], id_field: str, html: str = "html"
) -> DataFrame:
    """Repeated cards of a page, one row each with its position; a card without an id is no record."""
    keys = [c for c in pages.columns if c != html]
    cards = explode_rows(pages, keys, all_groups(F.col(html), card), "card_idx", "_card")
    raw = cards.select(
        *keys,
        "card_idx",
        *[remove_tags(first_group(F.col("_card"), f.pattern)).alias(f"_{name}") for name, f in fields.items()],
    ).filter(F.col(f"_{id_field}") != "")
    out = []
    for name, f in fields.items():
        text = F.col(f"_{name}")
        value = text if f.clean == "raw" else CLEANERS[f.clean](unescape_html(text))
        value = F.substring(value, 1, f.max_chars) if f.max_chars else value
        if f.default is not None:
            value = F.coalesce(F.nullif(value, F.lit("")), f.default({n: F.col(f"_{n}") for n in fields}))
        out.append(value.alias(name))
    return raw.select(*keys, "card_idx", *out)


RULES = "host string, card string, field string, pattern string, clean string, max_chars int, is_id boolean"


def extract_by_rules(pages: DataFrame, rules: DataFrame, html: str = "html", host: str = "host") -> DataFrame:
    """Repeated cards of pages by the rules of their host: `card_idx`, `id` and a map `fields` of the other fields.

    rules (columns of RULES): a row per host and field; `card` is the host's pattern of a card and stands in each of
    its rows, `pattern` has the field in its first group, `clean` names one of CLEANERS, null is raw. The patterns are
    columns, so hosts need no code and no query of their own, and pages of all hosts go through one scan. Pages of
    hosts without rules are left out, and so are cards without an id. Empty fields stay empty.
    """
    keys = [c for c in pages.columns if c != html]
    said = F.struct("is_id", "field", "pattern", F.coalesce("clean", F.lit("raw")).alias("clean"), "max_chars")
    by_host = rules.groupBy(F.col("host").alias("_host")).agg(F.max("card").alias("_card"), F.sort_array(F.collect_list(said)).alias("_rules"))
    known = pages.join(by_host, F.col(host) == F.col("_host"))
    cards = F.regexp_extract_all(F.col(html), F.col("_card"), F.lit(1))
    one = explode_rows(known.select(*keys, "_rules", cards.alias("_cards")), [*keys, "_rules"], "_cards", "card_idx", "_text")

    def value(rule: Column) -> Column:
        raw = remove_tags(F.call_function("regexp_extract", F.col("_text"), rule["pattern"], F.lit(1)))
        cleaned = raw
        for name, clean in CLEANERS.items():
            if name != "raw":
                cleaned = F.when(rule["clean"] == name, clean(unescape_html(raw))).otherwise(cleaned)
        return F.when(rule["max_chars"].isNotNull(), F.substring(cleaned, F.lit(1), rule["max_chars"])).otherwise(cleaned)

    found = F.transform("_rules", lambda r: F.struct(r["is_id"].alias("is_id"), r["field"].alias("key"), value(r).alias("value")))
    values = settle(one.select(*keys, "card_idx", found.alias("_found")), "_found")
    own = F.get(F.filter("_found", lambda f: f["is_id"]), F.lit(0))["value"]
    rest = F.transform(F.filter("_found", lambda f: ~F.coalesce(f["is_id"], F.lit(False))), lambda f: F.struct(f["key"], f["value"]))
    return values.select(*keys, "card_idx", own.alias("id"), F.map_from_entries(rest).alias("fields")).filter("id != ''")


def extract_links(
    pages: DataFrame,
    pattern: str,
    target: int = 1,
    label: int = 2,
    own: Column | None = None,
    clean: str = "title",
    html: str | Column = "html",
) -> DataFrame:
    """Ordered links of a page: blank labels dropped, the first of equal (target, label) kept.

    `own` is a text per page that the whole match has to hold, e.g. the path of the book the contents
    page belongs to.
    """
    source = as_col(html)
    drop = [html] if isinstance(html, str) else []
    keys = [c for c in pages.columns if c not in drop]
    base = pages.select(
        *keys,
        all_groups(source, pattern, target).alias("_targets"),
        F.transform(all_groups(source, pattern, label), remove_tags).alias("_raw"),
        *([] if own is None else [all_groups(source, pattern, 0).alias("_whole")]),
    )
    whole = [] if own is None else ["_whole"]
    clean_labels = base.select(*keys, "_targets", *whole, unescape_array("_raw").alias("_labels"))
    matches = F.arrays_zip("_targets", "_labels", *whole)
    if own is not None:
        matches = F.filter(matches, lambda x: F.contains(x["_whole"], own))
    pairs = F.transform(
        matches, lambda x: F.struct(x["_targets"].alias("target"), CLEANERS[clean](x["_labels"]).alias("label"))
    )
    kept = F.array_distinct(F.filter(pairs, lambda x: x["target"].isNotNull() & (x["label"] != "")))
    return explode_rows(clean_labels, keys, kept, "link_idx", "_l").select(*keys, "link_idx", "_l.*")


def region(html: str | Column, start: str, stop: str) -> Column:
    """Text after the first match of `start` up to the next `stop` or the end."""
    return F.regexp_extract(as_col(html), f"(?s)(?:{start})(.*?)(?:{stop}|\\z)", 1)


# possessive throughout: a plain repeated group takes a stack frame per character of an unclosed heading
CONTENTS_HEADING = r"<h2\b[^>]*+>(?:[^<目]++|<(?!/?h2\b)|目(?![錄录]</h2>))*+目[錄录]</h2>"


def extract_region_links(
    pages: DataFrame,
    start: str = CONTENTS_HEADING,
    stop: str = r"<h[23][^>]*>",
    pattern: str = r'(?s)<a[^>]+href="/wiki/([^"]+)"[^>]*>(.*?)</a>',
    html: str = "html",
) -> DataFrame:
    """Links of one region of the page, e.g. of its contents list: decoded page names, first kept."""
    keys = [c for c in pages.columns if c != html]
    part = pages.select(*keys, region(html, start, stop).alias("_region"))
    links = part.select(
        *keys, all_groups(F.col("_region"), pattern, 1).alias("_targets"),
        F.transform(all_groups(F.col("_region"), pattern, 2), remove_tags).alias("_raw"),
    ).select(*keys, "_targets", unescape_array("_raw").alias("_labels"))
    names = F.transform(
        F.filter(
            F.transform(
                F.arrays_zip("_targets", "_labels"),
                lambda x: F.struct(x["_targets"].alias("t"), CLEANERS["text"](x["_labels"]).alias("l")),
            ),
            lambda x: x["t"].isNotNull() & (x["l"] != "") & ~x["l"].startswith("#"),
        ),
        lambda x: decode_title(x["t"]),
    )
    return explode_rows(links, keys, F.array_distinct(names), "link_idx", "title")


def extract_main_text(
    pages: DataFrame, container: str, title: str = r"(?s)<h1[^>]*>(.*?)</h1>", html: str = "html"
) -> DataFrame:
    """Text of the main container, one line per paragraph or break, and the page title.

    `container` holds one group. A page without it is an empty shell: empty text, empty title.
    """
    keys = [c for c in pages.columns if c != html]
    body = F.regexp_extract(html, container, 1)
    found = pages.select(
        *keys,
        body.alias("_body"),
        ((body != "") | F.col(html).rlike(container)).alias("_found"),
        remove_tags(F.regexp_extract(html, title, 1)).alias("_title"),
    )
    plain = found.select(
        *keys, "_found", "_title",
        remove_tags(F.regexp_replace(drop_blocks("_body"), BLOCK_END, "\n")).alias("_plain"),
    )
    clear = plain.select(
        *keys,
        F.when(F.col("_found"), CLEANERS["title"](unescape_html("_title"))).otherwise("").alias("title"),
        F.translate(unescape_html("_plain"), "\u3000\r", " ").alias("_text"),
    )
    lines = F.filter(F.transform(split_lines("_text"), strip), lambda ln: ln != "")
    return settle(clear.select(*keys, "title", F.array_join(lines, "\n").alias("text")), "title", "text")


def extract_cells(
    pages: DataFrame,
    tag: str = "td",
    css: str = "ctext",
    skip: str = r"width:\s*60px",
    html: str = "html",
    name: str = "lines",
) -> DataFrame:
    """Array of the non-empty cell texts of a page; cells whose attributes match `skip` are numbering."""
    keys = [c for c in pages.columns if c != html]
    pattern = f'(?s)<{tag} class="{css}"([^>]*)>(.*?)</{tag}>'
    cells = F.filter(
        F.arrays_zip(all_groups(F.col(html), pattern, 1).alias("a"), all_groups(F.col(html), pattern, 2).alias("b")),
        lambda c: ~c["a"].rlike(skip),
    )
    bodies = pages.select(*keys, F.transform(cells, lambda c: remove_tags(c["b"])).alias("_raw"))
    texts = bodies.select(*keys, unescape_array("_raw").alias("_texts"))
    return texts.select(
        *keys, F.filter(F.transform("_texts", CLEANERS["text"]), lambda t: t != "").alias(name)
    )


_OPEN, _CLOSE = "\x01", "\x02"


def html_chapters(
    pages: DataFrame,
    levels: Sequence[str] = ("h2", "h3", "h4"),
    junk: Sequence[str] = JUNK_CLASSES,
    html: str = "html",
) -> DataFrame:
    """Sections of a page at its headings, from the text of `p` and `li`.

    Text before the first heading is an untitled section, the contents list is dropped, and so are
    blocks of a junk class. Junk that nests its own tag is left to the Arrow function, page by page.
    """
    keys = [c for c in pages.columns if c != html]
    head = "|".join(levels)
    classes = "|".join(junk)
    junk_open = rf'<(\w+)\b[^>]*\bclass\s*=\s*"[^"]*(?:{classes})[^"]*"[^>]*>'
    junk_block = rf"(?is){junk_open}[^\x01\x02]*?</\1\s*>"

    marked = pages.select(
        *keys,
        F.col(html).alias("_html"),
        F.regexp_replace(
            F.translate(drop_blocks(html), _OPEN + _CLOSE, ""),
            rf"(?is)<({head})\b[^>]*>(.*?)</\1\s*>",
            f"{_OPEN}$2{_CLOSE}",
        ).alias("_marked"),
    )
    cleaned = marked.select(
        *keys,
        "_html",
        F.regexp_replace("_marked", junk_block, "").alias("_clean"),
        F.exists(
            F.regexp_extract_all("_marked", F.lit(junk_block), F.lit(0)), lambda b: b.rlike(r"(?is)^<(\w+)\b.*<\1\b")
        ).alias("_nested"),
    )
    hidden = F.regexp_replace("_clean", r"\x01[^\x02]*\x02", "").rlike(rf"(?is)<[^>]*\bclass\s*=[^>]*(?:{classes})")
    # heading and block ends become control characters, so one unescape serves the whole page
    plain = cleaned.select(
        *keys,
        F.when(F.col("_nested") | hidden, F.col("_html")).alias("_hard"),
        remove_tags(
            F.regexp_replace(
                F.regexp_replace(
                    F.regexp_replace(F.translate("_clean", "\x03\x04", ""), r"(?i)<br\s*/?>", "\n"),
                    r"(?i)</(?:p|li)\s*>",
                    "\x04",
                ),
                r"(?i)<(?:p|li)\b[^>]*>",
                "\x03",
            )
        ).alias("_text"),
    )
    pieces = plain.select(*keys, "_hard", F.split(unescape_html("_text"), _OPEN).alias("_pieces"))

    def section(piece: Column, i: Column) -> Column:
        heading = F.when(i == 0, "").otherwise(strip(F.substring_index(piece, _CLOSE, 1)))
        body = F.when(i == 0, piece).otherwise(F.substring_index(piece, _CLOSE, -1))
        blocks = F.split(body, "\x04")
        closed = F.slice(blocks, F.lit(1), F.size(blocks) - 1)
        lines = F.filter(
            F.transform(closed, lambda b: strip(F.substring_index(b, "\x03", -1))), lambda ln: ln != ""
        )
        return F.struct(heading.alias("title"), F.array_join(lines, "\n").alias("text"))

    native = F.filter(
        F.transform("_pieces", section),
        lambda s: ((s["title"] != "") | (s["text"] != "")) & ~s["title"].isin(*CONTENTS_HEADINGS),
    )
    parse = sections_nested(tuple(levels), tuple(junk))
    both = pieces.select(*keys, F.coalesce(parse(F.col("_hard")), native).alias("_sections"))
    return explode_rows(both, keys, "_sections", "chapter_idx", "_s").select(*keys, "chapter_idx", "_s.title", "_s.text")


def prefix_sections(sections: str | Column, page: str | Column) -> Column:
    """Titles of the sections of a sub-page: its name alone, or `name·section` when there are several."""
    arr, name = as_col(sections), as_col(page)
    many = F.size(arr) > 1
    return F.transform(
        arr,
        lambda s: F.struct(
            F.when(s["title"] == "", name)
            .when(many, F.concat_ws("·", name, s["title"]))
            .otherwise(s["title"])
            .alias("title"),
            s["text"].alias("text"),
        ),
    )


def drop_shells(chapters: DataFrame, text: str = "text") -> DataFrame:
    """Chapters that hold text; the position of a dropped shell stays free."""
    return chapters.filter(~is_blank(text))


def shell_counts(chapters: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    return chapters.groupBy(*keys).agg(
        F.count_if(~is_blank(text)).alias("kept"), F.count_if(is_blank(text)).alias("shells")
    )


def reject_page_bytes(files: DataFrame, content: str = "content") -> DataFrame:
    """Flag a web page that was served in place of the file, from its first 512 bytes."""
    head = F.lower(
        F.regexp_replace(F.decode(F.substring(F.col(content).cast("binary"), 1, 512), "ISO-8859-1"), r"^[ \t\n\r\f\x0b]+", "")
    )
    bad = head.startswith("<!doctype") | head.startswith("<html") | F.contains(head, F.lit("cloudflare"))
    return files.withColumn("is_page", bad)

"""Book text to chapters and paragraphs, without losing a character.

All splits happen inside the row that holds the book: lines, heading positions, slices, explode. No
operator here shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.rows import explode_rows
from quire.functions.text import SPACE_CLASS, as_col, split_lines, strip, strip_text

# What a stand-alone heading line looks like, and the bare markers.
MAX_HEADING = 80
ANGLE_HEADING = r"^《([^《》]{1,60})》$"
_S = SPACE_CLASS  # the rules count every Unicode space
NUMBERED_HEADING = (
    rf"^(?:第{_S}*[0-9一二三四五六七八九十百零〇]+{_S}*[卷章節节回篇部集]"
    rf"|[卷章節节回篇部集]{_S}*(?:之{_S}*)?[0-9一二三四五六七八九十百]+)$"
)
SEQUENCE_HEADING = rf"^[一二三四五六七八九十百〇零]{{1,3}}[、.．](?!{_S})[^\n][^，。；：！？!?“”\"'（）()]{{0,15}}$"
ENGLISH_HEADING = rf"(?i)^(?:CHAPTER|CHAP\.?){_S}+(?:[0-9]+|[IVXLCDM]+)\.?$"
BARE_HEADINGS = (
    "卷首", "序", "自序", "原序", "跋", "後記", "后记", "凡例",
    "目錄", "目录", "附錄", "附录", "補遺", "补遗", "題記", "题记",
)
RENDERED_MARK = rf"^==={_S}*(.+?){_S}*===$"
PARAGRAPH_BREAK = rf"\n{{2,}}|\n(?!{_S}|\z)"

# Licence marker lines around a public-domain text.
BOILERPLATE_START = r"\*{3}\s*START OF (?:THE|THIS) PROJECT GUTENBERG EBOOK"
BOILERPLATE_END = r"\*{3}\s*END OF (?:THE|THIS) PROJECT GUTENBERG EBOOK"

CHAPTERS = "array<struct<title:string,text:string>>"


def heading_title(line: Column) -> Column:
    """Title a line announces, null for a line of prose. The first rule that fits decides."""
    s = strip(line)
    rule = (
        F.when(s.rlike(ANGLE_HEADING), strip(F.regexp_extract(s, ANGLE_HEADING, 1)))
        .when(s.rlike(NUMBERED_HEADING) | s.rlike(SEQUENCE_HEADING) | s.rlike(ENGLISH_HEADING), s)
        .when(s.isin(*BARE_HEADINGS), s)
    )
    # the length is tested first: prose lines never reach a pattern
    return F.when((F.length(s) > 0) & (F.length(s) <= MAX_HEADING), rule)


def rendered_title(line: Column) -> Column:
    """Title of a `=== title ===` line."""
    return F.when(
        line.startswith("===") & line.rlike(RENDERED_MARK), strip(F.regexp_extract(line, RENDERED_MARK, 1))
    )


def _with_heads(books: DataFrame, lines: Column, rule: Callable[[Column], Column]) -> DataFrame:
    found = books.withColumn("_lines", lines)
    return found.withColumn(
        "_heads",
        F.filter(
            F.transform("_lines", lambda ln, i: F.struct(i.alias("at"), rule(ln).alias("title"))),
            lambda h: h["title"].isNotNull(),
        ),
    )


def _cut(books: DataFrame, name: str, fold_lead: bool, keep_heading: bool, trim: bool) -> DataFrame:
    """Chapters from `_lines` and `_heads`; the next head ends a chapter. No head: null."""
    heads, lines = F.col("_heads"), F.col("_lines")

    def chapter(h: Column, k: Column) -> Column:
        start = h["at"] if keep_heading else h["at"] + 1
        if fold_lead:
            start = F.when(k == 0, 0).otherwise(start)
        end = F.coalesce(F.get(heads, k + 1)["at"], F.size(lines))
        text = F.array_join(F.slice(lines, start + 1, end - start), "\n")
        return F.struct(h["title"].alias("title"), (strip_text(text) if trim else text).alias("text"))

    return books.withColumn(name, F.when(F.size(heads) > 0, F.transform(heads, chapter))).drop("_lines", "_heads")


def with_heading_chapters(
    books: DataFrame,
    content: str | Column = "content",
    rule: Callable[[Column], Column] = heading_title,
    name: str = "heading_chapters",
    lines: Column | None = None,
) -> DataFrame:
    """Add the chapters that stand-alone heading lines open; null when the text has none.

    The heading stays in its chapter and leading lines join chapter one, so the texts joined with a
    line feed are the input lines again. `lines` takes an array of lines in place of a text.
    """
    source = split_lines(content) if lines is None else lines
    return _cut(_with_heads(books, source, rule), name, fold_lead=True, keep_heading=True, trim=False)


def with_rendered_chapters(books: DataFrame, content: str | Column = "content", name: str = "rendered_chapters") -> DataFrame:
    """Add the chapters of a rendered text; marker lines go, text before the first one too."""
    return _cut(
        _with_heads(books, split_lines(content), rendered_title), name, fold_lead=False, keep_heading=False, trim=True
    )


def explode_chapters(books: DataFrame, chapters: str) -> DataFrame:
    """One row per chapter; the title and the text are those of the chapter."""
    keys = [c for c in books.columns if c not in (chapters, "chapter_idx", "title", "text")]
    return explode_rows(books, keys, chapters, "chapter_idx", "_c").select(*keys, "chapter_idx", "_c.title", "_c.text")


def split_headings(
    books: DataFrame, content: str = "content", rule: Callable[[Column], Column] = heading_title
) -> DataFrame:
    """One row per heading chapter; a book without headings yields none."""
    cut = with_heading_chapters(books, content, rule)
    return explode_chapters(cut.drop(content), "heading_chapters")


def split_rendered(books: DataFrame, content: str = "content") -> DataFrame:
    return explode_chapters(with_rendered_chapters(books, content).drop(content), "rendered_chapters")


def ensure_chapters(
    books: DataFrame,
    given: str | None = None,
    rendered: bool = False,
    rule: Callable[[Column], Column] = heading_title,
    content: str = "content",
    title: str = "title",
    id_: str = "id",
) -> DataFrame:
    """Every book gets chapters: those given, else its markers, else its headings, else one whole text.

    `from_headings` tells which chapters still carry their heading in the text.
    """
    cut = with_heading_chapters(books, content, rule)
    first = []
    if given:
        first.append(F.when(F.size(given) > 0, F.col(given)))
    if rendered:
        cut = with_rendered_chapters(cut, content)
        first.append(F.col("rendered_chapters"))
    whole = F.array(
        F.struct(
            F.coalesce(F.nullif(F.col(title), F.lit("")), F.col(id_).cast("string")).alias("title"),
            F.col(content).alias("text"),
        )
    )
    keys = [c for c in books.columns if c not in (content, given, title)]
    taken = F.coalesce(*first, F.lit(None).cast(CHAPTERS))
    return explode_chapters(
        cut.select(
            *keys,
            (taken.isNull() & F.col("heading_chapters").isNotNull()).alias("from_headings"),
            F.coalesce(*first, F.col("heading_chapters"), whole).alias("_chapters"),
        ),
        "_chapters",
    )


def strip_dup_heading(chapters: DataFrame, only: Column | None = None) -> DataFrame:
    """Drop the first line equal to the title, unless it is the only line."""
    lined = chapters.withColumn("_lines", split_lines("text")).withColumn(
        "_at", F.array_position(F.transform("_lines", strip), F.col("title"))
    )
    at, size = F.col("_at"), F.size("_lines")
    rest = F.concat(F.slice("_lines", F.lit(1), at.cast("int") - 1), F.slice("_lines", at.cast("int") + 1, size))
    hit = (at > 0) & (size > 1)
    if only is not None:
        hit = hit & only
    return lined.withColumn("text", F.when(hit, strip_text(F.array_join(rest, "\n"))).otherwise(F.col("text"))).drop(
        "_lines", "_at"
    )


def paragraph_array(text: str | Column, title: str | Column | None = None) -> Column:
    """Reader paragraphs: blank lines or a line feed before text; the title itself is no paragraph."""
    parts = F.filter(F.transform(F.split(as_col(text), PARAGRAPH_BREAK), strip), lambda p: p != "")
    if title is None:
        return parts
    t = F.coalesce(as_col(title), F.lit(""))
    return F.filter(parts, lambda p: (t == "") | ((p != t) & (p != F.concat(F.lit("《"), t, F.lit("》")))))


def paragraphs(chapters: DataFrame, text: str = "text", title: str | None = "title") -> DataFrame:
    keys = [c for c in chapters.columns if c != text]
    return explode_rows(chapters, keys, paragraph_array(text, title), "para_idx", "para")


def strip_boilerplate(
    books: DataFrame,
    start: str = BOILERPLATE_START,
    end: str = BOILERPLATE_END,
    content: str = "content",
) -> DataFrame:
    """Text between the marker lines.

    No start marker leaves the text as it is, no end marker keeps it to the end. `reason` is null or
    says why the book has no text.
    """
    unix = F.regexp_replace(content, r"\r\n?", "\n")
    after = F.regexp_replace("_text", rf"(?s)\A.*?(?i:(?:\A|(?<=\n)){start})[^\n]*(?:\n|\z)", "")
    before = F.regexp_replace(after, rf"(?s)(?i:(?:\A|(?<=\n)){end}).*\z", "")
    cut = books.withColumn("_text", unix).withColumn(
        content,
        strip_text(
            F.when(F.col("_text").rlike(rf"(?i)(?:\A|(?<=\n)){start}"), before).otherwise(F.col("_text")), r"[\n]"
        ),
    )
    return cut.withColumn("reason", F.when(F.col(content) == "", "no text after strip")).drop("_text")

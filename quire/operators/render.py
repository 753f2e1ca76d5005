"""Chapters to rendered books: merged text, measures, XHTML, manifests, lean views.

A book is written in parts of at most `PART_BYTES`, unless one chapter is larger: the usual book is one
part, a huge one is many, and its parts in order are the text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.script import ScriptTable
from quire.functions.text import is_blank, line_count, split_lines, strip, xml_clean, xml_escape
from quire.operators.ordering import CHUNK, number_chunk, number_within
from quire.sources.book_files import BookFiles

#: Bytes of a part.
PART_BYTES = 8 << 20

XHTML = (
    '<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml">\n'
    '<head><meta charset="utf-8"/><title>{t}</title></head>\n<body>\n<h1>{t}</h1>\n{b}\n</body>\n</html>\n'
)


def _title_or_number(suffix: str) -> Column:
    return F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("第"), F.col("ordinal").cast("string"), F.lit(suffix)))


def with_ordinals(chapters: DataFrame, keys: Sequence[str], order: str = "chapter_idx", suffix: str = "部分") -> DataFrame:
    """Number the chapters of a book from 1; an untitled one is called after its number."""
    numbered = number_within(chapters, keys, [order], number_chunk(order), "ordinal")
    return numbered.withColumn("title", _title_or_number(suffix))


def _in_parts(
    chapters: DataFrame, keys: Sequence[str], order: str, shape: Callable[[DataFrame], DataFrame], sep: str, part_bytes: int
) -> DataFrame:
    """(keys, part, first_chapter, n_chapters, _text, _last): the blocks of a book in order, joined part by part.

    `shape` adds the `_block` of a chapter and may use its `ordinal` and the book's `n_chapters`. Texts are shuffled
    once, to (book, chunk of positions); the chunk's place in the book comes from a summary row. Within a chunk the
    running sum of bytes is cut every half bound, and a block beyond half the bound is a part of its own, so no part
    is larger than the bound unless one block is.
    """
    keys = list(keys)
    rows = chapters.withColumn("_chunk", number_chunk(order))
    counts = rows.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    book = Window.partitionBy(*keys)
    earlier_chunks = book.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    summary = counts.select(
        *keys, "_chunk", F.coalesce(F.sum("_n").over(earlier_chunks), F.lit(0)).alias("_before"), F.sum("_n").over(book).alias("n_chapters")
    )
    local = Window.partitionBy(*keys, "_chunk").orderBy(order)
    placed = rows.join(summary, [*keys, "_chunk"]).withColumn("ordinal", F.col("_before") + F.row_number().over(local))
    shaped = shape(placed).select(*keys, "_chunk", order, "ordinal", "n_chapters", "_block")
    half = part_bytes / 2
    size = F.octet_length("_block") + len(sep.encode())
    earlier = local.rowsBetween(Window.unboundedPreceding, -1)
    large = (size > half).cast("int")
    cut = F.struct(
        (2 * F.coalesce(F.sum(large).over(earlier), F.lit(0)) + large).alias("large"),
        F.floor(F.coalesce(F.sum(F.when(size <= half, size)).over(earlier), F.lit(0)) / half).alias("half"),
    )
    fresh = ~F.lag("_cut").over(local).eqNullSafe(F.col("_cut"))
    numbered = shaped.withColumn("_cut", cut).withColumn("_fresh", fresh.cast("int"))
    numbered = numbered.withColumn("_nth", F.sum("_fresh").over(local.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return (
        numbered.groupBy(*keys, "_chunk", "_nth")
        .agg(
            F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), F.col("_block").alias("_b")))).alias("_blocks"),
            F.min("ordinal").alias("first_chapter"),
            (F.max("ordinal") == F.max("n_chapters")).alias("_last"),
            F.max("n_chapters").alias("n_chapters"),
        )
        .select(
            *keys,
            (F.col("_chunk") * CHUNK + F.col("_nth")).alias("part"),
            "first_chapter",
            "n_chapters",
            F.array_join(F.transform("_blocks", lambda b: b["_b"]), sep).alias("_text"),
            "_last",
        )
    )


def merge_chapters(
    chapters: DataFrame,
    keys: Sequence[str],
    sep: str = "\n",
    final_newline: bool = False,
    order: str = "chapter_idx",
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Chapter texts of a book in order, one row per part; the parts of a book joined are its content."""
    parts = _in_parts(chapters, keys, order, lambda c: c.withColumn("_block", F.col("text")), sep, part_bytes)
    end = F.when(F.col("_last"), "\n" if final_newline else "").otherwise(sep)
    return parts.select(*keys, "part", "first_chapter", "n_chapters", F.concat("_text", end).alias("content"))


def render_txt(
    chapters: DataFrame,
    keys: Sequence[str],
    books: DataFrame | None = None,
    order: str = "chapter_idx",
    part_bytes: int = PART_BYTES,
    convert: ScriptTable | None = None,
) -> DataFrame:
    """Text of a book: `=== title ===` blocks apart by a blank line, closed by a line feed.

    A book of one chapter is its content unchanged: `content` of `books` when given, else the text of
    the chapter. `convert` writes titles and texts in Simplified script.
    """

    def shape(placed: DataFrame) -> DataFrame:
        titled = placed.withColumn("title", _title_or_number("部分"))
        if convert is not None:
            titled = convert.to_simplified(titled, ["title", "text"])
        block = F.concat(F.lit("=== "), F.col("title"), F.lit(" ===\n"), F.col("text"))
        return titled.withColumn("_block", F.when(F.col("n_chapters") == 1, F.col("text")).otherwise(block))

    whole = _in_parts(chapters, keys, order, shape, "\n\n", part_bytes)
    single = F.col("_text")
    if books is not None and convert is None:
        whole = whole.join(books.select(*keys, F.col("content").alias("_content")), list(keys), "left")
        single = F.coalesce("_content", single)
    end = F.when(F.col("_last"), "\n").otherwise("\n\n")
    content = F.when(F.col("n_chapters") == 1, single).otherwise(F.concat("_text", end))
    return whole.select(*keys, "part", "first_chapter", "n_chapters", content.alias("content"))


def write_txt(rendered: DataFrame, path: str, file_name: str = "file_name") -> None:
    """One file per book, named by `file_name`, its parts in order; all files of the table appear, or none.

    A file has one writer, so the parts of a book meet in one task, which appends one after the other.
    """
    spark = rendered.sparkSession
    spark.dataSource.register(BookFiles)
    named = rendered.select(F.col(file_name).alias("name"), F.col("part").cast("bigint").alias("part"), F.col("content").cast("string").alias("content"))
    named.repartition("name").sortWithinPartitions("name", "part").write.format("book_files").mode("append").save(path)


def lean_chapters(chapters: DataFrame, keys: Sequence[str], order: str = "chapter_idx") -> DataFrame:
    """The lean view of books from their chapters: titles in order and measures, a row per chunk of positions.

    Only titles are gathered; of a text no more than its length leaves the scan.
    """
    slim = chapters.select(*keys, number_chunk(order).alias("part"), order, "title", F.length("text").cast("bigint").alias("_chars"))
    titles = F.transform(F.sort_array(F.collect_list(F.struct(order, "title"))), lambda c: c["title"])
    return slim.groupBy(*keys, "part").agg(
        F.sum("_chars").alias("chars"), F.count(F.lit(1)).cast("int").alias("n_chapters"), titles.alias("chapters")
    )


def book_stats(books: DataFrame, content: str = "content") -> DataFrame:
    """Code points and lines of every text."""
    return books.withColumn("chars", F.length(content)).withColumn("lines", line_count(content))


def chapter_stats(chapters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Measures of a book from its chapters."""
    return chapters.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("chapters"),
        F.sum(F.length("text")).alias("chars"),
        F.sum(line_count("text")).alias("lines"),
    )


def render_xhtml(chapters: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Chapter to XHTML: escaped paragraphs, lines that repeat the title left out."""
    cleaned = chapters.withColumn("_t", xml_clean(F.coalesce("title", F.lit("")))).withColumn(
        "_lines", split_lines(xml_clean("text"))
    )
    quoted = F.concat(F.lit("《"), F.col("_t"), F.lit("》"))
    body = F.array_join(
        F.transform(
            F.filter(F.transform("_lines", strip), lambda s: (s != "") & (s != F.col("_t")) & (s != quoted)),
            lambda s: F.concat(F.lit("<p>"), xml_escape(s), F.lit("</p>")),
        ),
        "\n",
    )
    fallback = F.concat(F.lit("第"), F.col(ordinal).cast("string"), F.lit("章"))
    title = xml_escape(F.coalesce(F.nullif("_t", F.lit("")), fallback))
    filled = cleaned.withColumn("_title", title).withColumn("_body", body)
    head, middle, rest, tail = (
        XHTML.split("{t}")[0], XHTML.split("{t}")[1], XHTML.split("{t}")[2].split("{b}")[0], XHTML.split("{b}")[1]
    )
    document = F.concat(F.lit(head), "_title", F.lit(middle), "_title", F.lit(rest), "_body", F.lit(tail))
    return filled.withColumn("xhtml", document).drop("_t", "_lines", "_title", "_body")


def book_manifest(chapters: DataFrame, keys: Sequence[str], order: str = "chapter_idx") -> DataFrame:
    """Files of a packed book in reading order.

    Chapters without text are left out, unless the book has no other; then its first one stays.
    """
    keys = list(keys)
    slim = chapters.select(*keys, order, xml_clean(F.coalesce("title", F.lit(""))).alias("title"), is_blank("text").alias("_blank"))
    kept = number_within(slim.filter(~F.col("_blank")), keys, [order], number_chunk(order), "play_order")
    lone = (
        slim.groupBy(*keys)
        .agg(F.min("_blank").alias("_all_blank"), F.min_by(F.struct(order, "title"), order).alias("_f"))
        .filter("_all_blank")
        .select(*keys, f"_f.{order}", "_f.title", F.lit(1).cast("bigint").alias("play_order"))
    )
    number = F.col("play_order").cast("string")
    return kept.drop("_blank").unionByName(lone).select(
        *keys,
        order,
        "play_order",
        F.concat(F.lit("chap"), number).alias("item_id"),
        F.concat(F.lit("chap_"), F.lpad(number, F.greatest(F.length(number), F.lit(4)), F.lit("0")), F.lit(".xhtml")).alias("href"),
        xml_escape(
            F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("第"), number, F.lit("章")))
        ).alias("label"),
    )


def lean(books: DataFrame, chapters: str = "chapters") -> DataFrame:
    """Drop the bulk columns; chapters become their titles, none becomes null."""
    keep = [c for c in books.columns if c not in ("content", "raw", chapters)]
    titles = F.when(F.size(chapters) > 0, F.transform(chapters, lambda c: c["title"]))
    return books.select(*keep, titles.alias("chapters"))


def book_json(books: DataFrame, keys: Sequence[str] = ("source", "id")) -> DataFrame:
    """JSON text of the lean view of every book."""
    fields = lean(books)
    return fields.select(*keys, F.to_json(F.struct(*fields.columns)).alias("json"))

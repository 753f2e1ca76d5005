"""Operators over the given tables, each table in the role of a book-corpus table.

pages are crawled pages, documents book texts, conversations chapters of books, part a catalogue,
events request logs and reading positions, lineitem contents entries, orders stored indexes, benchmark
a translation memory, labels keys already processed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.html import clean_title, strip_tags
from quire.functions.rows import explode_rows
from quire.functions.script import ScriptTable
from quire.functions.text import (
    decode_title, encode_title, error_message, full_key, has_cjk, is_challenge, latin_words, line_count,
    normalize_text, progress_pct, sanitize_filename, size_kb, size_mb, split_lines, store_key, strip, strip_text, trans_direction,
    url_host, url_param, xml_clean, xml_escape,
)
from quire.operators import bilingual as bi
from quire.operators import catalog as cat
from quire.operators import extract as ex
from quire.operators import library as lib
from quire.operators import logs, render, script, segment, snapshots, store
from quire.operators.ordering import first_per_key
from quire.session import checkpoint_dir, cut_lineage, spread
from quire.plans import flows, registry
from quire.sources import readers

ARTICLE = r"(?s)<article[^>]*>(.*?)</article>"
NAV_LINK = r'(?s)<a href="/([^"]*)">(.*?)</a>'
SHORT_LINE = 25
NOW = "1998-06-01 00:00:00"
LICENSE_LINE = r"(?:Licensed under|Released under|This work is licensed under)"
BREAK_HOURS = 24.0

# A small conversion table in Latin letters.
LATIN_SCRIPT = dict(
    t2s_chars={"e": "3", "a": "4", "o": "0", "é": "e"},
    s2t_chars={"s": "z", "t": "7"},
    t2s_phrases={"the": "THE", "qu": "KW", "sch": "SH"},
    s2t_phrases={"st": "ST"},
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark, d, *cols):
    return table(spark, d, "pages").select("page_id", *(cols or ("html",)))


def _books(spark, d):
    return table(spark, d, "documents").select(
        F.col("source"), F.col("doc_id").alias("id"), F.col("lang").alias("title"), F.col("text").alias("content")
    )


def _chapters(spark, d):
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("id"), F.col("turn").alias("chapter_idx"), F.col("role").alias("title"), "text"
    )


def _catalog(spark, d):
    return table(spark, d, "part").select(
        F.col("p_brand").alias("source"), F.col("p_partkey").alias("id"), F.col("p_name").alias("title")
    )


def _asked(spark, d):
    """Queries: every word of a title, every title in capitals with its type, every benchmark text."""
    part = table(spark, d, "part")
    words = part.select(F.explode(F.split("p_name", " ")).alias("query"))
    longer = part.select(F.upper(F.concat_ws(" ", "p_name", "p_type")).alias("query"))
    texts = table(spark, d, "benchmark").select(F.col("text").alias("query"))
    return words.union(longer).union(texts).distinct().select(F.sha1("query").alias("query_id"), "query")


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def short_line(line):
    s = strip(line)
    return F.when((F.length(s) > 0) & (F.length(s) < SHORT_LINE), s)


# ---- pages --------------------------------------------------------------

def q_strip_tags(spark, d):
    return _pages(spark, d).select("page_id", strip_tags("html", ("comment", "script", "style")).alias("text"))


def q_page_links(spark, d):
    return ex.extract_links(_pages(spark, d), NAV_LINK)


def q_page_cards(spark, d):
    fields = {"target": ex.Field(r'href="/([^"]*)"', "raw"), "label": ex.Field(r"(?s)<a[^>]*>(.*?)</a>", "intro", ex.INTRO_LENGTH)}
    return ex.extract_cards(_pages(spark, d), r"(?s)<li>(.*?)</li>", fields, "target")


def q_cards_by_rules(spark, d):
    """Three kinds of hosts, each with rules of its own from a table; pages of the fourth kind have none."""
    pages = table(spark, d, "pages").select("page_id", F.concat(F.lit("h"), (F.col("page_id") % 4).cast("string")).alias("host"), "html")
    link = r'href="/([^"]*)"'
    rules = [
        ("h0", r"(?s)<li>(.*?)</li>", "target", link, None, None, True),
        ("h0", r"(?s)<li>(.*?)</li>", "label", r"(?s)<a[^>]*>(.*?)</a>", "title", 3, False),
        ("h1", r"(?s)<h1>(.*?)</h1>", "name", r"(?s)\A(.*)\z", "text", 20, True),
        ("h2", r"(?s)<a ([^>]*>.*?)</a>", "target", link, "raw", None, True),
        ("h2", r"(?s)<a ([^>]*>.*?)</a>", "label", r"(?s)>(.*)\z", "text", None, False),
    ]
    found = ex.extract_by_rules(pages, spark.createDataFrame(rules, ex.RULES))
    return found.select("page_id", "host", "card_idx", "id", F.coalesce(F.col("fields")["label"], F.lit("")).alias("label"))


def q_nav_region_links(spark, d):
    return ex.extract_region_links(_pages(spark, d), "<nav[^>]*>", "</nav>", NAV_LINK)


def q_main_text(spark, d):
    return ex.drop_shells(ex.extract_main_text(_pages(spark, d), ARTICLE))


def q_page_sections(spark, d):
    return ex.html_chapters(spread(_pages(spark, d)), levels=("h1",))


def q_page_stats(spark, d):
    """Pages, chapters and code points per host: the flagship chain."""
    text = ex.extract_main_text(table(spark, d, "pages"), ARTICLE)
    books = text.select(url_host("url").alias("host"), F.col("page_id").alias("id"), "title", F.col("text").alias("content"))
    chapters = segment.ensure_chapters(books, rule=short_line)
    return chapters.groupBy("host").agg(
        F.count_if(F.col("chapter_idx") == 0).alias("pages"),
        F.count(F.lit(1)).alias("chapters"),
        F.sum(F.length("text").cast("bigint")).alias("chars"),
    )


def q_challenge_flags(spark, d):
    return _pages(spark, d).select(
        "page_id",
        is_challenge("html").alias("challenge"),
        is_challenge("html", ("la que", "of the", "und die")).alias("marked"),
    )


def q_reject_pages(spark, d):
    files = _pages(spark, d).select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").cast("binary").alias("content"))
    texts = table(spark, d, "documents").select(
        F.lit("text").alias("kind"), F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("content")
    )
    return ex.reject_page_bytes(files.unionByName(texts)).select("kind", "id", "is_page")


def q_shell_counts(spark, d):
    """Pages with and without an article of their language mark, per host."""
    text = ex.extract_main_text(_pages(spark, d, "url", "html"), r'(?s)lang="en".*?<article[^>]*>(.*?)</article>')
    return ex.shell_counts(text.withColumn("host", url_host("url")), ["host"])


def q_first_links(spark, d):
    """Where every link target is seen first over all pages."""
    links = ex.extract_links(_pages(spark, d), NAV_LINK)
    return first_per_key(links, ["target"], ["page_id", "link_idx"])


def q_page_cells(spark, d):
    """Lines of chapters laid out as numbered table cells, and read back."""
    chapters = table(spark, d, "conversations").select(
        "conv_id", "turn",
        F.array_join(
            F.transform(
                split_lines("text"),
                lambda ln, i: F.concat(
                    F.lit('<td class="ctext" style="width: 60px;">'), i.cast("string"),
                    F.lit('</td><td class="ctext"><i>'), ln, F.lit("</i>&middot;</td>"),
                ),
            ),
            "\n",
        ).alias("html"),
    )
    return explode_rows(ex.extract_cells(chapters), ["conv_id", "turn"], "lines", "line_idx", "line")


def q_card_notes(spark, d):
    """Record lists with an author in bold and a note after it."""
    lists = table(spark, d, "part").select(
        "p_partkey",
        F.concat(
            F.lit("<ul><li><a href='x'>none</a></li><li><a href=\"wiki.pl?res="), F.col("p_partkey").cast("string"), F.lit('">'), "p_name",
            F.lit('</a><span style="font-weight: bold;">（'), "p_type", F.lit("）"), "p_brand", F.lit("</span><br>\n note &amp; <i>"),
            F.col("p_size").cast("string"), F.lit("</i> </li></ul>"),
        ).alias("html"),
    )
    bold = r'<span style="font-weight: bold;">'
    fields = {
        "id": ex.Field(r"res=(\d+)", "raw"), "title": ex.Field(r"(?s)<a[^>]*>(.*?)</a>", "text"),
        "author": ex.Field(rf"(?s){bold}(.*?)</span>", "author"), "note": ex.Field(rf"(?s){bold}.*?</span>(.*)\z", "text"),
    }
    return ex.extract_cards(lists, r"(?s)<li>(.*?)</li>", fields, "id")


def q_clean_titles(spark, d):
    mark = F.concat(F.lit("<b>"), F.col("p_name"), F.lit("</b> &amp; （ "), F.col("p_size").cast("string"), F.lit(" / 50 ） "))
    return table(spark, d, "part").select("p_partkey", clean_title(mark).alias("title"))


def q_url_parts(spark, d):
    return _pages(spark, d, "url").select(
        "page_id", url_host("url").alias("host"), url_param("url", "page").alias("page"),
        encode_title("url").alias("encoded"), decode_title(encode_title("url")).alias("decoded"),
    )


def q_decode_text(spark, d):
    raw = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return raw.select("doc_id", readers.decode_text("content").alias("text"))


# ---- texts --------------------------------------------------------------

def q_split_chapters(spark, d):
    return segment.split_headings(_books(spark, d).select("id", "content"), rule=short_line)


def q_ensure_chapters(spark, d):
    return segment.ensure_chapters(_books(spark, d).drop("source"), rule=short_line)


def q_section_names(spark, d):
    """Chapters of a text as the sections of a page called after the source."""
    cut = segment.with_heading_chapters(table(spark, d, "documents").select("doc_id", "source", "text"), "text", short_line)
    untitled = F.transform(
        "heading_chapters",
        lambda c: F.struct(F.when(c["title"].startswith("L"), "").otherwise(c["title"]).alias("title"), c["text"].alias("text")),
    )
    named = cut.select("doc_id", ex.prefix_sections(untitled, "source").alias("sections"))
    return explode_rows(named, ["doc_id"], "sections", "chapter_idx", "_s").select("doc_id", "chapter_idx", "_s.title")


def q_render_converted(spark, d):
    return render.render_txt(_chapters(spark, d), ["id"], convert=ScriptTable(**LATIN_SCRIPT)).drop("first_chapter")


def q_rendered_roundtrip(spark, d):
    chapters = _chapters(spark, d)
    rendered = render.render_txt(chapters, ["id"]).select("id", "first_chapter", F.col("id").cast("string").alias("title"), "content")
    back = segment.ensure_chapters(rendered, rendered=True)
    idx = (F.col("first_chapter") - 1 + F.col("chapter_idx")).cast("int")
    return back.select("id", idx.alias("chapter_idx"), "title", strip_text("text").alias("text"))


def q_render_txt(spark, d):
    return render.render_txt(_chapters(spark, d), ["id"]).drop("first_chapter")


def q_txt_files(spark, d):
    """All books written to files and read back; a hundred books share a title, so their names are numbered."""
    chapters = _chapters(spark, d)
    name = F.concat(F.lit("b"), (F.col("id") % 7).cast("string"), F.lit(".txt"))
    names = chapters.select(F.lit("s").alias("source"), "id").distinct().withColumn("name", name)
    names = cat.dedup_names(names, spark.createDataFrame([], "name string")).select(F.col("id").cast("bigint").alias("id"), "file_name")
    path = f"{checkpoint_dir(spark)}/quire-books-{uuid.uuid4().hex}"
    render.write_txt(render.render_txt(chapters, ["id"], part_bytes=2048).join(names, "id"), path)
    files = readers.read_text_books(spark, path)
    file_name = F.concat("title", F.lit(".txt"))
    return files.select(file_name.alias("file_name"), F.length("content").alias("chars"), F.md5("content").alias("digest"))


def q_library_scan(spark, d):
    """Books written to a folder, and found there by a scan that opens none of them."""
    path = f"{checkpoint_dir(spark)}/quire-library-{uuid.uuid4().hex}"
    kind = F.when(F.col("id") % 3 == 0, ".txt.part").when(F.col("id") % 3 == 1, ".TXT").otherwise(".md")
    books = render.render_txt(_chapters(spark, d), ["id"]).withColumn("file_name", F.concat(F.lit("b"), F.col("id").cast("string"), kind))
    render.write_txt(books, path)
    return readers.scan_library(spark, path).select("rel", "length")


def q_library_increment(spark, d):
    """Two runs over a library folder: the second one has the books that came in between, and none twice."""
    base = f"{checkpoint_dir(spark)}/quire-library-{uuid.uuid4().hex}"
    books = render.render_txt(_chapters(spark, d), ["id"]).withColumn("file_name", F.concat(F.lit("b"), F.col("id").cast("string"), F.lit(".txt")))

    def keep(batch: DataFrame, number: int) -> None:
        found = batch.select("rel", F.md5("content").alias("digest"), F.lit(number).cast("bigint").alias("run"))
        found.write.mode("overwrite").parquet(f"{base}/found/{number}")

    for some in (F.col("id") % 3 < 2, F.col("id") % 3 == 2):
        render.write_txt(books.filter(some), f"{base}/library")
        stream = readers.library_stream(spark, f"{base}/library").writeStream.foreachBatch(keep)
        stream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/found")


def q_read_pages(spark, d):
    return readers.read_pages(spark, f"{d}/pages.parquet").select("page_id", url_host("url").alias("host"), F.md5("html").alias("digest"))


def q_registered_extractor(spark, d):
    """An extractor of the caller, by name: a page to its title as a catalogue row."""
    title = F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1)
    registry.register_extractor("titles", lambda pages: pages.select("page_id", title.alias("title")).filter("title != ''"))
    return registry.extract("titles", _pages(spark, d))


def q_get_books(spark, d):
    """Every second book of a store, asked for by its key; seven titles, so names are numbered."""
    chapters = F.sort_array(F.collect_list(F.struct("chapter_idx", "title", "text")))
    stored = _chapters(spark, d).groupBy("id").agg(
        F.transform(chapters, lambda c: F.struct(c["title"].alias("title"), c["text"].alias("text"))).alias("chapters")
    )
    stored = stored.select(
        F.lit("s").alias("source"), F.col("id").cast("string").alias("id"), F.concat(F.lit("b?"), (F.col("id") % 7).cast("string")).alias("title"),
        F.lit(None).cast("string").alias("content"), "chapters", F.lit(None).cast("binary").alias("raw"),
    )
    requests = stored.filter(F.col("id").cast("bigint") % 2 == 0).select("source", "id")
    books = flows.get_books(requests, stored)
    return books.select(F.col("id").cast("bigint").alias("id"), "name", "part", "n_chapters", F.md5("content").alias("digest"))


def q_merge_chapters(spark, d):
    merged = render.merge_chapters(_chapters(spark, d), ["id"], "\n", final_newline=True)
    return merged.select("id", "part", "n_chapters", "content", F.length("content").alias("chars"), line_count("content").alias("lines"))


def q_chapter_ordinals(spark, d):
    untitled = _chapters(spark, d).withColumn("title", F.when(F.col("title") == "user", "").otherwise(F.col("title")))
    return render.with_ordinals(untitled, ["id"]).select("id", "chapter_idx", "ordinal", "title")


def q_chapter_xhtml(spark, d):
    chapters = _chapters(spark, d).withColumn("text", F.concat(F.col("title"), F.lit("\n"), F.col("text"), F.lit(" <&>")))
    return render.render_xhtml(chapters.withColumn("ordinal", F.col("chapter_idx") + 1)).select("id", "chapter_idx", "xhtml")


def q_book_manifest(spark, d):
    """Replies of the assistant count as chapters without text."""
    chapters = _chapters(spark, d).withColumn("text", F.when(F.col("title") == "assistant", " ").otherwise(F.col("text")))
    return render.book_manifest(chapters, ["id"])


def q_strip_dup_heading(spark, d):
    chapters = _chapters(spark, d).withColumn("text", F.concat(F.col("title"), F.lit("\n"), F.col("text")))
    return segment.strip_dup_heading(chapters)


def q_paragraphs(spark, d):
    books = table(spark, d, "documents").select("doc_id", F.col("source").alias("title"), "text")
    return segment.paragraphs(books).select("doc_id", "para_idx", "para")


def q_strip_boilerplate(spark, d):
    books = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return segment.strip_boilerplate(books, start=LICENSE_LINE, end=r"(?:The|Die|La|El)\b")


def q_trans_direction(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", latin_words("text").alias("words"), trans_direction("text").alias("direction"), has_cjk("text").alias("cjk")
    )


def q_normalize_text(spark, d):
    dos = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\r\n")).alias("text"))
    return dos.select("doc_id", normalize_text("text").alias("text"))


def q_xml_text(spark, d):
    texts = table(spark, d, "documents").select("doc_id", F.concat("text", F.lit("\x01\x0c<&>")).alias("text"))
    return texts.select("doc_id", xml_escape(xml_clean("text")).alias("text"))


def q_book_stats(spark, d):
    books = render.book_stats(_books(spark, d))
    return books.groupBy("source").agg(
        F.count(F.lit(1)).alias("books"),
        F.sum(F.col("chars").cast("bigint")).alias("chars"),
        F.sum(F.col("lines").cast("bigint")).alias("lines"),
    )


def q_script_convert(spark, d):
    conv = ScriptTable(**LATIN_SCRIPT)
    return table(spark, d, "documents").select(
        "doc_id", conv.simplified("text").alias("simplified"), conv.traditional("text").alias("traditional")
    )


def q_script_vote(spark, d):
    chapters = segment.ensure_chapters(_books(spark, d).drop("source"), rule=short_line)
    return script.detect_script(chapters, ScriptTable(**LATIN_SCRIPT), ["id"])


def q_convert_away(spark, d):
    chapters = _chapters(spark, d)
    conv = ScriptTable(**LATIN_SCRIPT)
    return script.convert_away(chapters, script.detect_script(chapters, conv, ["id"]), conv, ["id"])


def q_lean_books(spark, d):
    """Titles and measures of books, without their texts."""
    out = render.lean_chapters(_chapters(spark, d), ["id"])
    return out.select("id", "part", "chars", "n_chapters", F.array_join("chapters", "|").alias("titles"))


# ---- catalogue ----------------------------------------------------------

def q_title_search(spark, d):
    found = cat.search_top(_catalog(spark, d), _asked(spark, d), cat.SEARCH_LIMIT)
    return found.select("query_id", "rank", "source", "id", "title")


def q_ranked_hits(spark, d):
    """All hits of the words of titles, uncut; every third title and every word of it are in CJK brackets."""
    odd = F.col("p_partkey") % 3 == 0
    title = F.when(odd, F.concat(F.lit("書"), F.col("p_name"), F.lit("書"))).otherwise(F.col("p_name"))
    part = table(spark, d, "part")
    catalog = part.select(F.col("p_brand").alias("source"), F.col("p_partkey").alias("id"), title.alias("title"))
    words = part.select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    asked = words.select(F.explode(F.array(F.col("word"), F.concat(F.lit("書"), F.col("word")))).alias("query"))
    asked = asked.select(F.sha1("query").alias("query_id"), "query")
    return cat.search_top(catalog, asked).select("query_id", "rank", "source", "id", "title")


def q_title_matches(spark, d):
    return cat.match_titles(_catalog(spark, d), _asked(spark, d))


def q_search_summary(spark, d):
    return cat.search_summary(_catalog(spark, d), _asked(spark, d), foreign=("Brand#1", "Brand#2")).select(
        "query_id", "hits", "foreign_hits"
    )


def q_registry_search(spark, d):
    """The uncut order of sources and answers, first 20."""
    hits = _catalog(spark, d).select(
        F.col("title").alias("query_id"), F.col("title").alias("query"), "title", "source", "id",
        F.col("source").alias("source_pos"), F.col("id").alias("hit_pos"),
    )
    return cat.limit_hits(hits, cat.CLI_LIMIT, mode="registry").select("query_id", "rank", "source", "id")


def q_search_hint(spark, d):
    """Every title in CJK brackets is a CJK query; brands with a failing answer did not respond."""
    part = _catalog(spark, d)
    summary = part.groupBy("title").agg(F.count_if(F.col("source") == "Brand#1").alias("foreign_hits")).select(
        F.col("title").alias("query_id"), F.concat(F.lit("書"), F.col("title")).alias("query"), "foreign_hits"
    )
    outcomes = part.select(
        F.col("title").alias("query_id"), F.when(F.col("source") == "Brand#2", "Brand#1").otherwise(F.col("source")).alias("source"),
        (F.length("title") > 10).alias("ok"),
    )
    translated = part.filter(F.col("title").startswith("b")).select(
        F.col("title").alias("query_id"), F.upper("title").alias("to"), F.lit("dict").alias("via")
    ).distinct()
    return cat.search_hint(summary, outcomes, translated, foreign=("Brand#1",)).select("query_id", "hint_kind", "hint")


def q_search_envelope(spark, d):
    catalog, asked = _catalog(spark, d), _asked(spark, d)
    matches = cut_lineage(cat.match_titles(catalog, asked))
    summary = cat.search_summary(catalog, asked, matches=matches)
    return cat.to_envelope(summary, cat.search_top(catalog, asked, cat.SEARCH_LIMIT, matches=matches))


def q_envelope_full(spark, d):
    """Answers with full hits, errors, hints, the translated title and the sources asked, one per title."""
    part = table(spark, d, "part")
    title = F.concat(F.lit("書"), "p_name")
    summary = part.groupBy(title.alias("query_id")).agg(F.count(F.lit(1)).alias("hits"))
    summary = summary.select("query_id", F.col("query_id").alias("query"), "hits", F.lit("look & see").alias("hint"))
    hits = part.select(
        title.alias("query_id"), title.alias("query"), F.col("p_brand").alias("source"), F.col("p_partkey").cast("string").alias("id"),
        F.col("p_name").alias("title"), F.concat(F.lit("http://h/"), F.col("p_partkey").cast("string")).alias("url"),
        F.col("p_type").alias("subtitle"), F.lit("txt").alias("format_hint"),
        F.create_map(F.lit("size"), F.col("p_size").cast("string")).alias("extra"),
    )
    hits = cat.limit_hits(hits)
    errors = part.filter("p_size = 7").select(title.alias("query_id"), F.col("p_brand").alias("source"), F.lit("late").alias("message")).distinct()
    translated = part.filter(F.col("p_name") < "m").select(title.alias("query_id"), F.col("p_name").alias("to"), F.lit("dict").alias("via")).distinct()
    asked = part.select(title.alias("query_id"), F.col("p_brand").alias("source"))
    return cat.to_envelope(summary, hits, errors, translated, asked)


def q_resolve_unique(spark, d):
    catalog = _catalog(spark, d)
    wanted = table(spark, d, "part").select(
        F.col("p_brand").alias("source"), F.when(F.col("p_size") > 25, F.upper("p_name")).otherwise(F.col("p_name")).alias("title")
    ).distinct()
    return cat.resolve_unique(wanted, catalog)


def q_editions(spark, d):
    return cat.editions(_catalog(spark, d))


def q_query_translate(spark, d):
    """Nations as queries, each put to every region as a source; the dictionary is nation to region."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    both = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    titles = both.filter("n_nationkey > 4").select(F.col("n_name").alias("zh"), F.col("r_name").alias("en"))
    people = table(spark, d, "customer").join(both, F.col("c_nationkey") == F.col("n_nationkey"))
    queries = people.select(F.col("c_custkey").alias("query_id"), F.col("n_name").alias("query"), F.col("r_name").alias("source"))
    return cat.translate_queries(queries, titles, foreign=("ASIA", "EUROPE"), needs=F.lit(True))


def q_source_labels(spark, d):
    names = table(spark, d, "nation").filter("n_nationkey < 20").select(
        F.col("n_nationkey").cast("string").alias("source"), F.col("n_name").alias("label")
    )
    rows = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("source"))
    return cat.with_labels(rows, names)


def q_source_errors(spark, d):
    """Languages ask sources; a source has answered where a labelled document is good."""
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("query_id"), "source")
    registry = docs.select("source").filter("source != 'src7'").distinct()
    outcomes = docs.join(table(spark, d, "labels"), "doc_id").select(
        "query_id", "source", ((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("ok"),
        F.when(F.col("toxic") == 1, "parse").otherwise("network").alias("kind"),
        F.lit("ValueError").alias("name"), F.lit("x").alias("detail"),
    )
    return cat.source_errors(docs, registry, outcomes)


def q_dedup_names(spark, d):
    part = table(spark, d, "part")
    imports = part.select(
        F.col("p_brand").alias("source"), F.col("p_partkey").alias("id"),
        F.concat(sanitize_filename("p_name"), F.lit(".txt")).alias("name"),
    )
    existing = part.select(F.concat("p_name", F.lit("("), F.col("p_size").cast("string"), F.lit(").txt")).alias("name"))
    return cat.dedup_names(imports, existing).select(F.col("id").cast("bigint").alias("id"), "source", "file_name")


def q_union_sources(spark, d):
    a = table(spark, d, "customer").select(
        F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("subtitle")
    )
    b = table(spark, d, "supplier").select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"))
    return cat.union_sources(a, b)


def q_validate_ids(spark, d):
    """Keys of documents as ids of sources with differing forms."""
    forms = {"src0": r"^[0-9]+\z", "src1": r"(?i)^\s*[0-9a-f]{32}\s*\z", "src2": r"(?s)^[^:]+:.+\z"}
    rows = table(spark, d, "documents").select(
        "doc_id", "source",
        F.when(F.col("n_chars") > 1000, F.col("doc_id").cast("string"))
        .when(F.col("n_chars") > 500, F.md5(F.col("doc_id").cast("string")))
        .otherwise(F.concat(F.lit("a/b:"), F.col("doc_id").cast("string"))).alias("id"),
    )
    return cat.validate_ids(rows, forms)


def q_route_sources(spark, d):
    groups = table(spark, d, "documents").filter(F.col("lang") == "es").select(F.col("lang").alias("category"), "source").distinct().filter(
        F.substring("source", -1, 1).isin("1", "3", "7")
    )
    docs = table(spark, d, "documents").select("doc_id", "source", F.nullif("lang", F.lit("en")).alias("license"))
    return cat.license_label(cat.route_sources(docs, groups, "es"))


def q_filter_ext(spark, d):
    paths = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit("."), F.substring("p_type", 1, 3)).alias("path"))
    return cat.filter_ext(paths, (".eco", ".sma"))


def q_record_json(spark, d):
    records = table(spark, d, "part").select(
        F.to_json(
            F.array(
                F.struct(
                    F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"),
                    F.nullif("p_type", F.lit("SMALL")).alias("author"), F.col("p_size").cast("string").alias("year"),
                    F.lit("txt").alias("extension"),
                    F.when(F.col("p_size") > 10, F.floor(F.col("p_retailprice") * 1000).cast("bigint").cast("string")).alias("filesize"),
                    F.when(F.col("p_type") != "ECONOMY", F.md5(F.col("p_partkey").cast("string"))).alias("md5"),
                )
            )
        ).alias("body")
    )
    return readers.parse_record_json(records, "body", "mirror.example.org").select("id", "title", "url", "subtitle", "format_hint")


def q_wiki_json(spark, d):
    body = table(spark, d, "documents").select(
        F.to_json(
            F.struct(
                F.struct(
                    F.array(
                        F.struct(
                            F.when(F.col("n_chars") > 300, F.concat_ws(" ", "lang", F.col("doc_id").cast("string"))).alias("title"),
                            F.concat(F.lit("<span>&quot;"), "text", F.lit("</span>")).alias("snippet"),
                            F.col("doc_id").alias("pageid"),
                        )
                    ).alias("search")
                ).alias("query")
            )
        ).alias("body")
    )
    return readers.parse_search_json(body, "body", "zh.example.org", "wiki").select("id", "url", "subtitle", F.col("extra")["pageid"].alias("pageid"))


def q_book_members(spark, d):
    """Chapters packed as XHTML members with a package file; its spine turns the order of the assistant's replies round."""
    conv = table(spark, d, "conversations")
    href = F.concat(F.lit("c"), F.col("turn").cast("string"), F.lit(".xhtml"))
    members = conv.select(
        F.col("conv_id").alias("book"), F.concat(F.lit("OEBPS/"), href).alias("path"), F.col("turn").alias("pos"),
        F.concat(F.lit("<html><body><h1>"), "role", F.lit("</h1>\n\n\n\n<p>"), "text", F.lit("</p></body></html>")).alias("content"),
    )
    nth = F.col("turn").cast("string")
    item = F.when(
        F.col("turn") % 2 == 0, F.concat(F.lit('<item id="i'), nth, F.lit('" media-type="x" href="'), href, F.lit('"/>'))
    ).otherwise(F.concat(F.lit('<opf:item href="'), href, F.lit("\"\n id=\"i"), nth, F.lit('"/>')))
    ref = F.when(F.col("role") == "assistant", F.concat(F.lit('<itemref idref="i'), nth, F.lit('"/>'))).otherwise("")
    package = conv.groupBy(F.col("conv_id").alias("book")).agg(
        F.sort_array(F.collect_list(F.struct(-F.col("turn"), item.alias("item"), ref.alias("ref")))).alias("e")
    )
    text = F.concat(
        F.lit('<package xmlns="http://www.idpf.org/2007/opf"><manifest>'), F.array_join("e.item", "\n"), F.lit("</manifest><spine>"),
        F.array_join("e.ref", ""), F.lit("</spine></package>"),
    )
    package = package.select("book", F.lit("OEBPS/content.opf").alias("path"), F.lit(-1).cast(members.schema["pos"].dataType).alias("pos"), text.alias("content"))
    return readers.members_to_chapters(members.unionByName(package))


def q_tree_listing(spark, d):
    """One stored listing per brand, a file each, read back as blobs and as catalogue rows."""
    path = f"{checkpoint_dir(spark)}/quire-listings-{uuid.uuid4().hex}"
    kind = F.when(F.col("p_size") % 5 == 0, "tree").otherwise("blob")
    ending = F.when(F.col("p_size") % 2 == 0, ".TXT").otherwise(".md")
    name = F.concat(F.lit("d/"), F.col("p_partkey").cast("string"), ending)
    entry = F.struct(name.alias("path"), kind.alias("type"), F.md5("p_name").alias("sha"), F.col("p_size").cast("bigint").alias("size"))
    listings = table(spark, d, "part").groupBy(F.replace("p_brand", F.lit("#"), F.lit("")).alias("repo")).agg(F.collect_list(entry).alias("tree"))
    files = listings.select(F.concat("repo", F.lit(".json")).alias("file_name"), F.lit(0).alias("part"), F.to_json(F.struct("tree")).alias("content"))
    render.write_txt(files, path)
    blobs = readers.read_tree_listing(spark, path).select(
        F.regexp_extract("listing", r"([^/]*)\.json\z", 1).alias("repo"), "path", "sha", "size"
    )
    repos = listings.select("repo", F.lit("main").alias("branch"), F.lit(None).cast("string").alias("note"), F.lit("").alias("license"))
    return readers.tree_catalog(blobs, repos).select("id", "title", "url", F.col("extra")["folder"].alias("folder"))


def q_file_paths(spark, d):
    from quire.functions.text import base_name, file_title, folder

    paths = table(spark, d, "part").select("p_partkey", F.concat_ws("/", "p_type", F.concat("p_name", F.lit(".TXT"))).alias("path"))
    return paths.select("p_partkey", file_title("path").alias("title"), folder("path").alias("folder"), base_name("path").alias("base"))


# ---- store --------------------------------------------------------------

def q_split_cached(spark, d):
    docs = table(spark, d, "documents").select("source", F.col("doc_id").alias("id"))
    return store.split_cached(docs, table(spark, d, "labels").select(F.col("doc_id").alias("id")), keys=["id"])


def q_pending_requests(spark, d):
    docs = table(spark, d, "documents").select("source", F.col("doc_id").alias("id"))
    return store.pending(docs, table(spark, d, "labels").select(F.col("doc_id").alias("id")), keys=["id"])


def q_delete_books(spark, d):
    gone = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return store.delete_books(table(spark, d, "documents").select("source", F.col("doc_id").alias("id"), "n_chars"), gone, on=["id"])


def q_store_upsert(spark, d):
    """All books, then new versions of the labelled ones, then tombstones for the toxic ones."""
    path = f"{checkpoint_dir(spark)}/quire-store-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select(
        "source", F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), F.col("n_chars").cast("int").alias("chars")
    )
    labels = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"), "toxic")
    for batch, (rows, dead) in enumerate(
        [
            (docs, False),
            (docs.join(labels, "id", "left_semi").withColumn("content", F.concat("content", F.lit("!"))), False),
            (docs.join(labels.filter("toxic = 1"), "id", "left_semi").select("source", "id"), True),
        ]
    ):
        saved = F.timestamp_micros(F.lit(batch))
        store.store_upsert(rows, path, batch, saved, dead)
    return store.read_store(spark, path).select("source", "id", "store_key", "chars", F.md5("content").alias("digest"), "batch_id")


def q_store_compacted(spark, d):
    """The same three batches, compacted after the second; superseded files are removed before reading."""
    path = f"{checkpoint_dir(spark)}/quire-store-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select("source", F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))
    labels = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"), "toxic")
    store.store_upsert(docs, path, 0, F.timestamp_micros(F.lit(0)))
    again = docs.join(labels, "id", "left_semi").withColumn("content", F.concat("content", F.lit("?")))
    store.store_upsert(again, path, 1, F.timestamp_micros(F.lit(1)))
    store.compact_store(spark, path)
    toxic = docs.join(labels.filter("toxic = 1"), "id", "left_semi").select("source", "id")
    store.store_upsert(toxic, path, 2, F.timestamp_micros(F.lit(2)), True)
    snapshots.remove_superseded(spark, path, versions=1, older_than_hours=0)
    return store.read_store(spark, path).select("source", "id", F.md5("content").alias("digest"), "batch_id")


def q_store_odd_keys(spark, d):
    """Books of null and empty sources, every labelled one twice in its batch, and one batch with tombstones."""
    path = f"{checkpoint_dir(spark)}/quire-store-{uuid.uuid4().hex}"
    source = F.when(F.col("source") == "src1", "").when(F.col("source") != "src2", F.col("source"))
    docs = table(spark, d, "documents").select(
        source.alias("source"), F.col("doc_id").cast("string").alias("id"), F.col("n_chars").cast("int").alias("chars"), F.lit(0).alias("us")
    )
    labels = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("dead"))
    again = docs.join(labels.select("id"), "id", "left_semi").withColumns({"chars": -F.col("chars"), "us": F.lit(1)})
    store.store_upsert(docs.unionByName(again), path, 0, F.timestamp_micros("us"))
    judged = docs.join(labels, "id").withColumn("chars", F.lit(0))
    store.store_upsert(judged.filter("dead OR source = ''"), path, 1, F.timestamp_micros(F.lit(2)), F.col("dead"))
    return store.read_store(spark, path).select("source", "id", "chars", "batch_id")


def q_toc_links(spark, d):
    """Links below a contents heading, which is the page's title set before its list of links."""
    heading = F.concat(F.lit("<h2>"), F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1), F.lit("目錄</h2><nav>"))
    wiki = F.replace(F.replace("html", F.lit("<nav>"), heading), F.lit('<a href="/'), F.lit('<a href="/wiki/'))
    found = table(spark, d, "pages").select("page_id", wiki.alias("html"))
    return ex.extract_region_links(found, stop="</nav>")


def q_default_headings(spark, d):
    """The built-in heading rules: one heading of each kind around a text, and a near miss that is none."""
    docs = table(spark, d, "documents")
    nth = F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 5
    heading = (
        F.when(kind == 0, F.concat(F.lit("《"), "source", F.lit("》"))).when(kind == 1, F.concat(F.lit("第"), nth, F.lit("章")))
        .when(kind == 2, F.concat(F.lit("三、"), "source")).when(kind == 3, F.concat(F.lit("CHAPTER "), nth)).otherwise("自序")
    )
    miss = F.concat(heading, F.when(kind == 2, F.lit("。")).otherwise(F.lit(" x")))
    content = F.concat_ws("\n", F.concat(F.lit("lead "), nth), heading, "text", miss, F.lit("后记"), F.lit("end"))
    return segment.split_headings(docs.select(F.col("doc_id").alias("id"), content.alias("content")))


def q_decode_legacy(spark, d):
    """Names followed by two characters in GB18030 bytes."""
    raw = table(spark, d, "part").select(
        "p_partkey", F.concat(F.col("p_name").cast("binary"), F.unhex(F.lit("".join(f"{b:02X}" for b in "渊海".encode("gb18030"))))).alias("content")
    )
    return raw.select("p_partkey", readers.decode_text("content").alias("text"))


def q_protected_words(spark, d):
    """Words in which one character is a name stay as they are; it is converted elsewhere."""
    conv = ScriptTable({"乾": "干", "陽": "阳"}, {})
    text = F.concat(F.lit("乾坤 "), "p_name", F.lit(" 乾杯 乾陽 陽 乾"))
    return table(spark, d, "part").select("p_partkey", conv.simplified(text).alias("text"))


def q_references(spark, d):
    """Numeric and rare named character references."""
    text = F.concat(F.lit("<b>&#"), (F.col("p_size") + 200).cast("string"), F.lit(";</b>&eacute;&#x41;"), "p_name", F.lit("&frac12;"))
    return table(spark, d, "part").select("p_partkey", strip_tags(text).alias("text"))


def q_page_subsections(spark, d):
    """Sections at h2 to h4, with page furniture that nests its own tag and a contents list."""
    name = F.col("p_name")
    html = F.concat(
        F.lit("<p>lead</p><h2>"), name, F.lit("</h2><p>"), F.col("p_type"), F.lit('</p><div class="navbox"><div>x</div><p>no</p></div>'),
        F.lit("<h3>二</h3><ul><li>"), F.col("p_brand"), F.lit("</li></ul><h4>目錄</h4><p>list</p><h4>last</h4><p>"), name, F.lit("<br/>z</p>"),
    )
    part = spread(table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand"))
    return ex.html_chapters(part.select("p_partkey", html.alias("html")))


def q_card_defaults(spark, d):
    """Records without a title or an author get the values made for them."""
    card = F.concat(
        F.lit("<li><i>"), F.col("p_partkey").cast("string"), F.lit("</i>"),
        F.when(F.col("p_size") > 20, F.concat(F.lit("<b>"), "p_name", F.lit("</b>"))).otherwise(""),
        F.when(F.col("p_size") < 40, F.concat(F.lit("<u>"), "p_brand", F.lit("</u>"))).otherwise(""), F.lit("</li>"),
    )
    fields = {
        "id": ex.Field(r"<i>(\d+)</i>", "raw"),
        "title": ex.Field(r"<b>(.*?)</b>", default=lambda raw: F.concat(F.lit("record #"), raw["id"])),
        "author": ex.Field(r"<u>(.*?)</u>", default=lambda raw: F.lit("nobody")),
    }
    pages = table(spark, d, "part").select("p_partkey", card.alias("html"))
    return ex.extract_cards(pages, r"(?s)<li>(.*?)</li>", fields, "id").select("p_partkey", "title", "author")


def q_library_cascade(spark, d):
    """Finished files of toxic documents go with their partials, other labelled ones lose the partial alone."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("rel"))
    part = F.concat("rel", F.lit(".part"))
    files = docs.select("rel").union(docs.filter("doc_id % 2 = 0").select(part))
    labels = table(spark, d, "labels").join(docs, "doc_id")
    gone = labels.select(F.when(F.col("toxic") == 1, F.col("rel")).otherwise(part).alias("rel"))
    kept, read = store.delete_library_rows(files, docs.select("rel", F.col("doc_id").alias("chapter")), gone)
    return kept.select(F.lit("file").alias("kind"), "rel").union(read.select(F.lit("position"), "rel"))


def q_translate_stored(spark, d):
    """Nations as queries: those of even regions are in the dictionary, a stored translation serves the others."""
    nation = table(spark, d, "nation")
    queries = nation.select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("國"), "n_name").alias("query"), F.lit("gutenberg").alias("source"))
    zh = F.concat(F.lit("國"), "n_name").alias("zh")
    titles = nation.filter("n_regionkey % 2 = 0").select(zh, F.lower("n_name").alias("en"))
    stored = nation.select(zh, F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("又"), "n_name")).otherwise(F.concat(F.lit("the "), "n_name")).alias("en"))
    return cat.translate_queries(queries, titles, stored=stored).select("query_id", "asked", "via")


def q_resume_plan(spark, d):
    lines = table(spark, d, "lineitem").select(
        F.lit("shop").alias("source"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos"), "l_returnflag"
    )
    done = lines.filter("l_returnflag != 'N'").select("source", "id", F.col("pos").alias("idx"))
    return store.resume_plan(lines, done).select("id", "pos")


def q_checkpoint_state(spark, d):
    """Finished lines leave checkpoints; orders of urgent priority ask for another edition."""
    lines = table(spark, d, "lineitem").select(
        F.lit("shop").alias("source"), F.col("l_orderkey").alias("id"), F.col("l_orderkey").cast("string").alias("title"),
        F.col("l_linenumber").alias("idx"), F.when(F.col("l_returnflag") != "N", "x").otherwise("").alias("text"),
    )
    expected = table(spark, d, "orders").select(
        F.lit("shop").alias("source"),
        F.when(F.col("o_orderpriority") == "1-URGENT", -F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("id"),
        F.col("o_orderkey").cast("string").alias("title"),
    )
    return store.checkpoint_state(expected, store.latest_checkpoints(lines)).select("id", "title", "resume_from", "restart")


def q_freshness(spark, d):
    index = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ts"), (F.col("o_orderstatus") == "F").alias("dead"),
        (F.col("o_totalprice") > 100000).alias("has_paths"),
        F.when(F.col("o_orderpriority") == "5-LOW", "gone").when(F.col("o_orderpriority") == "2-HIGH", "ok").otherwise("transient").alias("outcome"),
    )
    done = store.freshness(index, F.lit(NOW).cast("timestamp"), "365 days", "outcome")
    return done.select("o_orderkey", "action")


def q_sanitize_names(spark, d):
    return table(spark, d, "customer").select("c_custkey", sanitize_filename(F.concat(F.lit(" ."), "c_name", F.lit("?*"))).alias("file_name"))


def q_store_keys(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", store_key("source", F.col("doc_id").cast("string")).alias("store_key"), full_key("lang", "source", "text").alias("full_key")
    )


def q_size_labels(spark, d):
    return table(spark, d, "documents").select(
        "doc_id",
        size_mb(F.col("n_chars") * 1000).alias("size_mb"),
        size_kb("n_chars").alias("size_kb"),
        size_mb("lang").alias("bad"),
    )


# ---- library, logs ------------------------------------------------------

def q_latest_progress(spark, d):
    e = _events(spark, d)
    rel = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.when(F.col("event_type") == "view", ".txt.part").otherwise(".txt"))
    rows = e.select(rel.alias("rel"), F.col("event_id").cast("int").alias("chapter"), F.floor("value").cast("int").alias("pct"), "ts", "event_id")
    return lib.latest_progress(rows)


def q_progress_pct(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return _events(spark, d).select("event_id", progress_pct(k, F.floor("value").cast("int"), F.col("user_id").cast("int")).alias("pct"))


def q_shelf(spark, d):
    """Finished orders are books, open ones partials named after their customer."""
    orders = table(spark, d, "orders")
    name = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    files = orders.select(
        F.when(F.col("o_orderstatus") == "F", F.concat(name, F.lit(".txt")))
        .when(F.col("o_orderstatus") == "O", F.concat(name, F.lit(".txt.part")))
        .otherwise(F.concat(F.lit("x/"), F.col("o_orderkey").cast("string"), F.lit(".epub"))).alias("rel"),
        F.col("o_totalprice").cast("bigint").alias("length"),
    )
    files = first_per_key(files.select("rel", "length"), ["rel"], ["length"])
    e = _events(spark, d).select(
        F.concat(F.lit("c"), F.col("user_id").cast("string"), F.lit(".txt")).alias("rel"),
        F.lit(3).alias("chapter"), F.floor("value").cast("int").alias("pct"), "ts", "event_id",
    )
    counts = table(spark, d, "lineitem").select(F.concat(F.lit("c"), F.col("l_orderkey").cast("string"), F.lit(".txt")).alias("rel"))
    return lib.shelf(files, lib.latest_progress(e), lib.chapter_counts(counts))


def _fetch_log(spark, d):
    return _events(spark, d).select(
        F.col("user_id").alias("host"), "ts", F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("ok")
    )


def q_breaker_log(spark, d):
    return logs.breaker_log(_fetch_log(spark, d), window=BREAK_HOURS * 3600).select("host", "id", "ok", "state")


def q_pacing_audit(spark, d):
    return logs.pacing_audit(_fetch_log(spark, d), min_gap=3600.0).select("host", "id", "gap_us", "too_fast")


def q_job_status(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return logs.job_status(
        _events(spark, d).select(F.col("user_id").alias("job_id"), "ts", "event_id", F.col("event_type").alias("status"), k.alias("done"), F.lit(100).alias("total"))
    )


def q_error_category(spark, d):
    kind = F.when(F.col("event_type") == "error", "network").when(F.col("event_type") == "view", "verification").when(F.col("event_type") == "click", "parse").otherwise("other")
    return table(spark, d, "events").select("event_id", error_message(kind, "event_type", "props").alias("message"))


def q_classify_outcome(spark, d):
    status = (
        F.when(F.col("event_type") == "error", F.lit(None).cast("int")).when(F.col("event_type") == "view", 200)
        .when(F.col("event_type") == "click", 403).when(F.col("event_type") == "signup", 429).otherwise(500)
    )
    log = table(spark, d, "events").select(
        "event_id", status.alias("http_status"),
        F.when(F.col("value") > 20, "<title>Just a moment...</title>").otherwise("<p>text</p>").alias("body_head"),
        F.get_json_object("props", "$.k").alias("retry_after"),
    )
    return logs.classify_outcome(log).select("event_id", "outcome", "ok", "retry", F.col("wait_s").cast("int").alias("wait_s"))


# ---- translation memory -------------------------------------------------

def _paras_and_memory(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lit("").alias("title"), "text", trans_direction("text").alias("direction"))
    paras = segment.paragraphs(docs, title=None).drop("title")
    texts = table(spark, d, "benchmark").select("text", trans_direction("text").alias("direction"))
    lines = segment.paragraphs(texts, title=None).select("direction", "para").union(
        texts.select("direction", F.col("text").alias("para"))
    ).union(paras.filter(F.length("para") < SHORT_LINE).select("direction", "para"))
    memory = lines.select("direction", F.sha1("para").alias("para_sha"), F.concat(F.lit("* "), "para").alias("translation"))
    return paras, memory


def q_translation_memory(spark, d):
    return bi.apply_translation_memory(*_paras_and_memory(spark, d))


def q_bilingual(spark, d):
    """Translations kept per chapter: those of assistant turns have one paragraph too few."""
    chapters = _chapters(spark, d).select(F.col("id").cast("string").alias("rel"), F.col("chapter_idx"), "title", "text")
    direction = bi.chapter_direction("title", "text")
    trs = F.transform(segment.paragraph_array("text", "title"), lambda p: F.concat(F.lit("* "), p))
    stored = chapters.select(
        bi.chapter_key("rel", "chapter_idx", direction, "text").alias("chapter_key"),
        F.when(F.col("title") == "assistant", F.slice(trs, F.lit(1), F.greatest(F.size(trs) - 1, F.lit(0)))).otherwise(trs).alias("translations"),
    )
    return bi.bilingual(chapters, stored).select("rel", "chapter_idx", "direction", "translated", "para_idx", "block")


def q_ingest_stream(spark, d):
    from quire.streaming.ingest import ingest_stream

    base = f"{checkpoint_dir(spark)}/quire-ingest-{uuid.uuid4().hex}"
    pages = readers.stream_table(spark, f"{d}/pages.parquet")
    query = ingest_stream(pages, f"{base}/store", f"{base}/checkpoint", ARTICLE)
    query.awaitTermination()
    return store.read_store(spark, f"{base}/store").select("source", F.col("id").cast("bigint").alias("id"), "title", "content")


def q_ingest_batches(spark, d):
    """Pages come in three batches, known ones among them: each is stored by the first batch that has it."""
    from quire.streaming.ingest import ingest_stream

    base = f"{checkpoint_dir(spark)}/quire-ingest-{uuid.uuid4().hex}"
    pages = table(spark, d, "pages").select("page_id", "url", "html")
    third = F.col("page_id") % 3
    for coming in (third == 0, third <= 1, F.lit(True)):
        pages.filter(coming).write.mode("append").parquet(f"{base}/pages")
        stream = spark.readStream.schema(pages.schema).parquet(f"{base}/pages")
        ingest_stream(stream, f"{base}/store", f"{base}/checkpoint", ARTICLE).awaitTermination()
    stored = store.read_store(spark, f"{base}/store")
    return stored.select("source", F.col("id").cast("bigint").alias("id"), "batch_id", F.md5("content").alias("digest"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_") and callable(fn)
}

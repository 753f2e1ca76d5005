"""The two everyday chains: search titles, and get books in a format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.script import ScriptTable
from quire.functions.text import sanitize_filename
from quire.operators import catalog as cat
from quire.operators import render, segment
from quire.session import cut_lineage


def search(
    catalog: DataFrame,
    queries: DataFrame,
    titles: DataFrame,
    outcomes: DataFrame,
    category: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """One envelope per query over the sources of a category.

    catalog (source, id, title), queries (query_id, query), titles (zh, en) the title dictionary,
    outcomes (query_id, source, ok, kind, name, detail) how the sources answered. Foreign sources are
    asked for the standard foreign title of a CJK query. All hits are in the answer, or the first `limit`.
    """
    spark = catalog.sparkSession
    registry, groups = cat.sources_table(spark), cat.source_groups_table(spark)
    sources = cat.route_sources(registry, groups, category)
    here = catalog.join(sources.select("source"), "source", "left_semi")
    foreign = F.col("source").isin(*cat.FOREIGN_SOURCES)

    known = cat.translate_queries(
        queries.withColumn("source", F.lit(cat.FOREIGN_SOURCES[0])), titles
    ).filter(F.col("via").isNotNull())
    translated = known.select("query_id", F.col("asked").alias("to"), "via")
    # foreign sources are asked under the other name; the order of the hits stays that of the query
    own = queries.select("query_id", "query")
    abroad = own.join(translated, "query_id", "left").select("query_id", "query", F.coalesce("to", "query").alias("asked"))
    # every text is matched once, and all four readings below take from it
    texts = own.select("query").union(abroad.select("asked")).distinct()
    matches = cut_lineage(cat.match_titles(here, texts))
    hits = cut_lineage(
        cat.search_top(here.filter(~foreign), own, limit, matches)
        .unionByName(cat.search_top(here.filter(foreign), abroad, limit, matches))
        .drop("rank", "query")
    )
    counts = (
        cat.search_summary(here.filter(~foreign), own, matches=matches)
        .select("query_id", F.col("hits").alias("_near"))
        .join(
            cat.search_summary(here.filter(foreign), abroad, matches=matches).select("query_id", F.col("hits").alias("_far")),
            "query_id",
        )
    )
    summary = own.join(counts, "query_id").select(
        "query_id", "query", (F.col("_near") + F.col("_far")).alias("hits"), F.col("_far").alias("foreign_hits")
    )
    requested = own.select("query_id", F.explode(F.array(*[F.lit(n) for n, _ in cat.SOURCES])).alias("source"))
    requested = requested.join(sources.select("source"), "source", "left_semi")
    hinted = cat.search_hint(summary, outcomes, translated)
    top = cat.limit_hits(hits.join(own, "query_id"), limit)
    return cat.to_envelope(hinted, top, cat.source_errors(requested, registry, outcomes), translated, requested)


def get_books(
    requests: DataFrame, stored: DataFrame, fmt: str = "txt", convert: ScriptTable | None = None
) -> DataFrame:
    """Requested books that are in the store, rendered as `txt` or `epub` parts.

    requests (source, id); stored as `read_store` gives it. Books of one title get names of their own. Books still to be fetched are what
    `store.pending` returns for the same arguments.
    """
    keys = ["source", "id"]
    wanted = stored.join(requests.select(*keys).distinct(), keys, "left_semi").filter(F.col("raw").isNull())
    books = wanted.select(*keys, "title", "content", "chapters")
    chapters = segment.ensure_chapters(books, given="chapters")
    chapters = segment.strip_dup_heading(chapters, only=F.col("from_headings")).drop("from_headings")
    names = wanted.select(*keys, "title")
    if convert is not None:
        names = convert.to_simplified(names, ["title"])
    names = names.select(*keys, F.concat(sanitize_filename("title"), F.lit(f".{fmt}")).alias("name"))
    taken = names.sparkSession.createDataFrame([], "name string")
    names = cat.dedup_names(names, taken).select(*keys, F.col("file_name").alias("name"))
    if fmt == "txt":
        return render.render_txt(chapters, keys, None if convert else books, convert=convert).join(names, keys)
    if convert is not None:
        chapters = convert.to_simplified(chapters, ["title", "text"])
    files = render.book_manifest(chapters, keys).select(*keys, "chapter_idx", "play_order", "href")
    pages = chapters.join(files, [*keys, "chapter_idx"])
    return render.render_xhtml(pages, "play_order").select(*keys, "play_order", "href", "xhtml").join(names, keys)


def raw_books(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Requested books kept as original files, handed on byte for byte."""
    keys = ["source", "id"]
    files = stored.join(requests.select(*keys).distinct(), keys, "left_semi").filter(F.col("raw").isNotNull())
    name = F.concat(sanitize_filename("title"), F.lit("."), F.col("format"))
    return files.select(*keys, name.alias("name"), F.col("raw").alias("content"))

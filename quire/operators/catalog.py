"""Catalogue of editions: search, ranking, dictionaries, error reports, names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import error_message, full_key, has_cjk, strip
from quire.operators.ordering import hash_chunk, number_chunk, number_within, running_sum_within
from quire.session import cut_lineage

# Sources with their labels in registry order, the categories over them, the sources that
# index foreign titles, and the texts for a missing licence, an unknown and a silent source.
SOURCES = (
    ("biquge", "网络小说"), ("ctext", "中文古籍"), ("github", "古籍仓库"), ("gutenberg", "古登堡公版"),
    ("wikisource", "中文公版"), ("wikisource-en", "英文公版"), ("libgen", "电子书库"),
)
SOURCE_GROUPS = {
    "全部": None,
    "中文古籍": ("ctext", "github", "libgen"),
    "中文近代": ("wikisource", "libgen"),
    "网络小说": ("biquge", "libgen"),
    "外文原版": ("gutenberg", "wikisource-en", "libgen"),
}
FOREIGN_SOURCES = ("gutenberg", "wikisource-en", "libgen")
UNDECLARED_LICENSE = "未声明(权利状态不明，使用前自审)"
UNKNOWN_SOURCE = "unknown source"
NO_RESPONSE = "TimeoutError: source did not respond in 20s"
# Limits of a search that asks for one, and the texts of the advice.
SEARCH_LIMIT = 200
CLI_LIMIT = 20
HINTS = {
    "mt": ("外文源已按英文名「", "」检索仍无结果——系统译名可能不精确，可手动搜该书官方英文名"),
    "dict": ("外文源已按英文名「", "」检索仍无结果——此书可能尚未进入公版（古登堡/维基文库只有公版书）"),
    "plain": "外文原版源按英文书名索引，中文书名搜不到——试试英文原名直接搜",
}

GRAM = 3


# ---- dimension tables ---------------------------------------------------

def sources_table(spark) -> DataFrame:
    rows = [(n, label, i) for i, (n, label) in enumerate(SOURCES)]
    return spark.createDataFrame(rows, "source string, label string, source_pos int")


def source_groups_table(spark) -> DataFrame:
    rows = [(c, s) for c, names in SOURCE_GROUPS.items() for s in names or ()]
    return spark.createDataFrame(rows, "category string, source string")


# ---- projections and filters --------------------------------------------

def route_sources(df: DataFrame, groups: DataFrame, category: str | None) -> DataFrame:
    """Rows of the sources in a category; no category asks all."""
    if category is None:
        return df
    return df.join(groups.filter(F.col("category") == category).select("source"), "source", "left_semi")


def filter_ext(df: DataFrame, exts: Sequence[str] = (".txt",), path: str = "path") -> DataFrame:
    low = F.lower(path)
    keep = F.lit(False)
    for ext in exts:
        keep = keep | low.endswith(ext)
    return df.filter(keep)


# Form of an id per source; an unlisted source takes any.
ID_FORMS = {
    "biquge": r"^\s*[0-9]+\s*\z", "ctext": r"^[0-9]+\z", "gutenberg": r"^[0-9]+\z",
    "libgen": r"(?i)^\s*[0-9a-f]{32}\s*\z", "github": r"(?s)^[^:]+:.+\z",
}


def validate_ids(catalog: DataFrame, forms: Mapping[str, str] = ID_FORMS) -> DataFrame:
    """`ok` and, for a bad id, the `reason`."""
    ok, reason = F.lit(True), F.lit(None).cast("string")
    for source, form in forms.items():
        here = F.col("source") == source
        ok = F.when(here, F.col("id").rlike(form)).otherwise(ok)
        reason = F.when(here & ~F.col("id").rlike(form), F.concat(F.lit(f"bad {source} id: "), F.col("id"))).otherwise(reason)
    return catalog.withColumn("ok", ok).withColumn("reason", reason)


def license_label(df: DataFrame, column: str = "license") -> DataFrame:
    return df.withColumn(column, F.coalesce(F.nullif(column, F.lit("")), F.lit(UNDECLARED_LICENSE)))


def union_sources(*hits: DataFrame) -> DataFrame:
    """Hits of all sources, duplicates kept."""
    out = hits[0]
    for more in hits[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


# ---- title search -------------------------------------------------------

def _letters(text: str) -> Column:
    return F.array_remove(F.split(text, ""), "")


def _cuts(letters: str, k: int) -> Column:
    """All sequences of `k` of the letters; the whole text when it is shorter. Linear in the text."""
    places = F.sequence(F.lit(1), F.greatest(F.size(letters) - k + 1, F.lit(1)))
    return F.transform(places, lambda i: F.array_join(F.slice(F.col(letters), i, k), ""))


def contained_pairs(needles: DataFrame, haystacks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pairs (needle, haystack) of which the first is part of the second, without a nested loop.

    Both sides hold distinct, non-empty texts; `by` names columns that have to be equal. A needle can only
    lie in texts that hold every one of its grams. It is joined on the gram the fewest texts hold; a needle
    with a gram no text holds is settled without a join. A needle no longer than a gram is a gram itself
    and needs no test.
    """
    by = list(by)
    own = needles.withColumn("_l", _letters("needle")).select(
        *by, "needle", F.explode(F.array_distinct(_cuts("_l", GRAM))).alias("gram")
    )
    hay = haystacks.withColumn("_l", _letters("haystack")).select(
        *by, "haystack", F.explode(F.array_distinct(F.concat(*[_cuts("_l", k) for k in range(1, GRAM + 1)]))).alias("gram")
    )
    held = hay.join(own.select(*by, "gram"), [*by, "gram"], "left_semi").groupBy(*by, "gram").agg(
        F.count(F.lit(1)).alias("_texts")
    )
    texts = F.coalesce("_texts", F.lit(0))
    anchor = (
        own.join(held, [*by, "gram"], "left")
        .groupBy(*by, "needle")
        .agg(F.min(F.struct(texts.alias("n"), F.col("gram").alias("gram"))).alias("_a"))
        .filter(F.col("_a.n") > 0)
        .select(*by, "needle", F.col("_a.gram").alias("gram"))
    )
    return (
        hay.join(anchor, [*by, "gram"])
        .filter((F.length("needle") <= GRAM) | F.contains(F.col("haystack"), F.col("needle")))
        .select(*by, "needle", "haystack")
    )


def match_titles(catalog: DataFrame, queries: DataFrame) -> DataFrame:
    """Distinct (query, title) with one inside the other, trimmed and without regard to case.

    Works on distinct texts, so copies of a title are matched once. The distinct texts are needed several
    times and are materialised, so the catalogue itself is read once. Both directions run as one join.
    """
    titles = cut_lineage(
        catalog.select("title").distinct().withColumn("_t", F.lower(strip("title"))).filter("_t != ''")
    )
    asked = cut_lineage(
        queries.select("query").distinct().withColumn("_q", F.lower(strip("query"))).filter("_q != ''")
    )
    t, q = titles.select("_t").distinct(), asked.select("_q").distinct()

    def both(first: DataFrame, second: DataFrame, name: str) -> DataFrame:
        sides = [df.select(F.lit(side).alias("side"), F.col(df.columns[0]).alias(name)) for side, df in enumerate((first, second))]
        return sides[0].unionByName(sides[1])

    found = contained_pairs(both(q, t, "needle"), both(t, q, "haystack"), ["side"])
    # equal texts are found from either side
    once = found.filter((F.col("side") == 0) | (F.col("needle") != F.col("haystack")))
    q_first = F.col("side") == 0
    pairs = once.select(
        F.when(q_first, F.col("needle")).otherwise(F.col("haystack")).alias("_q"),
        F.when(q_first, F.col("haystack")).otherwise(F.col("needle")).alias("_t"),
    )
    return pairs.join(titles, "_t").join(asked, "_q").select("query", "title")


def _matched(catalog: DataFrame, queries: DataFrame, matches: DataFrame | None) -> DataFrame:
    """(query_id, query, title). A query is matched by `asked` where there is one, and ranked by `query`."""
    text = F.col("asked" if "asked" in queries.columns else "query")
    if matches is None:
        matches = match_titles(catalog, queries.select(text.alias("query")))
    found = matches.select(F.col("query").alias("_text"), "title")
    return queries.select("query_id", "query", text.alias("_text")).join(found, "_text").drop("_text")


def search_titles(catalog: DataFrame, queries: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """All editions a query matches. `matches` takes the result of `match_titles` when it is at hand."""
    return _matched(catalog, queries, matches).join(catalog, "title")


def _rank_columns(query: str = "query") -> tuple[Column, Column]:
    first = F.when(has_cjk(query) & has_cjk("title"), 0).otherwise(1)
    return first, F.col("title")


def rank_hits(hits: DataFrame, mode: str = "merged") -> DataFrame:
    """Hits of every query in order: titles in the script of a CJK query first, then by title.

    `mode="registry"` keeps the order of the sources and of their answers.
    """
    if mode == "registry":
        return hits.orderBy("query_id", "source_pos", "hit_pos")
    return hits.orderBy("query_id", *_rank_columns(), "source", "id")


def _first(df: DataFrame, keys: Sequence[str], order: Sequence, n: int | None, name: str) -> DataFrame:
    """Rows numbered per key; with `n` only the first of them, which tasks cut before the shuffle."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return out if n is None else out.filter(F.col(name) <= n)


def limit_hits(hits: DataFrame, n: int | None = None, mode: str = "merged") -> DataFrame:
    """Hits per query with their `rank`, all of them or the first `n`."""
    order = ["source_pos", "hit_pos"] if mode == "registry" else [*_rank_columns(), F.col("source"), F.col("id")]
    return _first(hits, ["query_id"], order, n, "rank")


def search_top(
    catalog: DataFrame, queries: DataFrame, n: int | None = None, matches: DataFrame | None = None
) -> DataFrame:
    """Ranked hits per query, all of them or the first `n`, without joining more than can be among them.

    Hits are ordered by title and then by (source, id), and every title has an edition. So the first `n` hits
    of a query text lie in its first `n` titles, and in the first `n` editions of each. Texts are ranked once,
    however many queries ask them. `matches` may be those of a larger catalogue.
    """
    text = F.col("asked" if "asked" in queries.columns else "query")
    if matches is None:
        matches = match_titles(catalog, queries.select(text.alias("query")))
    here = catalog.select("title").distinct()
    found = matches.select(F.col("query").alias("_text"), "title").join(here, "title", "left_semi")
    keys = ["query", "_text"]
    asked = queries.select("query", text.alias("_text")).distinct()
    titles = _first(asked.join(found, "_text"), keys, _rank_columns(), n, "_n").drop("_n")
    editions_ = catalog if n is None else _first(catalog, ["title"], ["source", "id"], n, "_n").drop("_n")
    order = [*_rank_columns(), F.col("source"), F.col("id")]
    hits = _first(titles.join(editions_, "title"), keys, order, n, "rank")
    return queries.select("query_id", "query", text.alias("_text")).join(hits, keys).drop("_text")


def search_summary(
    catalog: DataFrame,
    queries: DataFrame,
    foreign: Sequence[str] = FOREIGN_SOURCES,
    matches: DataFrame | None = None,
) -> DataFrame:
    """Hits per query before the limit, from counts per title; a query without hits has zero."""
    # the counts are of this catalogue; `matches` may be those of a larger one
    counts = catalog.groupBy("title").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("source").isin(*foreign)).alias("_f")
    )
    hits = _matched(catalog, queries, matches).join(counts, "title").groupBy("query_id").agg(
        F.sum("_n").alias("_n"), F.sum("_f").alias("_f")
    )
    return queries.select("query_id", "query").join(hits, "query_id", "left").select(
        "query_id", "query", F.coalesce("_n", F.lit(0)).alias("hits"), F.coalesce("_f", F.lit(0)).alias("foreign_hits")
    )


def search_hint(summary: DataFrame, outcomes: DataFrame, translated: DataFrame | None = None, foreign: Sequence[str] = FOREIGN_SOURCES) -> DataFrame:
    """Advice for a CJK query that foreign sources answered without a hit.

    outcomes (query_id, source, ok), translated (query_id, to, via).
    """
    answered = outcomes.groupBy("query_id").agg(
        F.bool_or(F.col("source").isin(*foreign) & F.col("ok")).alias("foreign_ok")
    )
    out = summary.join(answered, "query_id", "left")
    if translated is None:
        out = out.withColumn("to", F.lit(None).cast("string")).withColumn("via", F.lit(None).cast("string"))
    else:
        out = out.join(translated.select("query_id", "to", "via"), "query_id", "left")
    wanted = has_cjk("query") & F.coalesce("foreign_ok", F.lit(False)) & (F.col("foreign_hits") == 0)
    kind = F.when(~wanted, "none").when(F.col("via") == "mt", "mt").when(F.col("via").isNotNull(), "dict").otherwise("plain")
    text = F.lit("")
    for via in ("mt", "dict"):
        head, tail = HINTS[via]
        text = F.when(F.col("hint_kind") == via, F.concat(F.lit(head), F.col("to"), F.lit(tail))).otherwise(text)
    text = F.when(F.col("hint_kind") == "plain", HINTS["plain"]).otherwise(text)
    return out.withColumn("hint_kind", kind).withColumn("hint", text)


# ---- dictionaries -------------------------------------------------------

def translate_queries(
    queries: DataFrame,
    titles: DataFrame,
    foreign: Sequence[str] = FOREIGN_SOURCES,
    needs: Column | None = None,
    stored: DataFrame | None = None,
) -> DataFrame:
    """Query each source is asked: the standard foreign title where the source needs one.

    queries (query_id, query, source); titles (zh, en); stored (zh, en), translations kept from elsewhere that
    serve where the dictionary has no title (`via` is mt), unless they still hold CJK. Only CJK queries are looked
    up, unless `needs` says otherwise. Unknown titles are asked as they are.
    """
    known = titles.groupBy("zh").agg(F.min("en").alias("_en"))
    asks = (has_cjk("query") if needs is None else needs) & F.col("source").isin(*foreign)
    # rows not looked up get keys of their own: a shared null would gather them in one task
    own_key = F.concat(F.lit("\x00"), F.xxhash64(*queries.columns).cast("string"))
    looked = queries.withColumn("_key", F.when(asks, F.col("query")).otherwise(own_key)).join(
        known, F.col("_key") == F.col("zh"), "left"
    )
    kept = F.lit(None).cast("string")
    if stored is not None:
        second = stored.filter(~has_cjk("en")).groupBy(F.col("zh").alias("_zh")).agg(F.min("en").alias("_mt"))
        # keys of their own again for rows that the dictionary has settled
        looked = looked.withColumn("_key", F.when(F.col("_en").isNull(), F.col("_key")).otherwise(own_key))
        looked = looked.join(second, F.col("_key") == F.col("_zh"), "left")
        kept = F.col("_mt")
    return looked.select(
        *queries.columns,
        F.coalesce(F.col("_en"), kept, F.col("query")).alias("asked"),
        F.when(F.col("_en").isNotNull(), "dict").when(kept.isNotNull(), "mt").alias("via"),
    )


def with_labels(df: DataFrame, sources: DataFrame) -> DataFrame:
    """Display label of a source, its name when it has none."""
    names = sources.select("source", F.col("label").alias("_label"))
    return df.join(names, "source", "left").withColumn("label", F.coalesce("_label", F.col("source"))).drop("_label")


# ---- error reports, unique titles ---------------------------------------

def source_errors(requested: DataFrame, registry: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row per asked source that gave no answer, with the reason.

    requested (query_id, source); registry (source); outcomes (query_id, source, ok, kind, name, detail).
    """
    none = F.lit(None).cast("string")
    error = F.struct(F.col("kind").alias("kind"), F.col("name").alias("name"), F.col("detail").alias("detail"))
    asked = requested.select(
        "query_id", "source", F.lit(True).alias("_asked"), F.lit(False).alias("ok"), none.alias("kind"),
        none.alias("name"), none.alias("detail"),
    )
    said = outcomes.select("query_id", "source", F.lit(False).alias("_asked"), "ok", "kind", "name", "detail")
    # one aggregate settles asked, answered and failed; partial sums come first, so a hot source is small
    state = (
        asked.unionByName(said)
        .groupBy("query_id", "source")
        .agg(
            F.bool_or("_asked").alias("_asked"),
            F.bool_or("ok").alias("_ok"),
            F.min(F.when(~F.col("_asked") & ~F.col("ok"), error)).alias("_e"),
        )
        .filter("_asked")
    )
    known = registry.select("source").distinct().withColumn("_known", F.lit(True))
    text = F.when(F.col("_e").isNull(), NO_RESPONSE).otherwise(error_message("_e.kind", "_e.name", "_e.detail"))
    return (
        state.join(known, "source", "left")
        .filter(F.col("_known").isNull() | ~F.col("_ok"))
        .select("query_id", "source", F.when(F.col("_known").isNull(), UNKNOWN_SOURCE).otherwise(text).alias("message"))
    )


def resolve_unique(titles: DataFrame, catalog: DataFrame) -> DataFrame:
    """Id behind an exact title: `ok`, `missing` or `ambiguous`. Editions are counted before the join."""
    found = catalog.groupBy("source", "title").agg(F.count(F.lit(1)).alias("hits"), F.min("id").alias("_id"))
    hits = F.coalesce("hits", F.lit(0))
    return titles.join(found, ["source", "title"], "left").select(
        *titles.columns,
        hits.alias("hits"),
        F.when(hits == 1, F.col("_id")).alias("id"),
        F.when(hits == 1, "ok").when(hits == 0, "missing").otherwise("ambiguous").alias("status"),
    )


def editions(catalog: DataFrame) -> DataFrame:
    """Editions per title. The ids themselves stay rows of the catalogue: a title may have any number."""
    return (
        catalog.select("source", "title", "id").distinct()
        .groupBy("source", "title")
        .agg(F.count(F.lit(1)).alias("editions"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
        .withColumn("ambiguous", F.col("editions") > 1)
    )


# ---- file names ---------------------------------------------------------

def dedup_names(imports: DataFrame, existing: DataFrame) -> DataFrame:
    """Free file name for every import: `stem.ext`, then `stem(1).ext`, `stem(2).ext` …

    imports (source, id, name); existing (name). Copies of a name are numbered in the order of their
    store key, and a number that a stored or an imported file already carries is skipped. A name asked
    for as it is goes to its first import, so generated names never meet one. Nothing is collected per
    name: the k-th import takes the k-th free number, found by merging the imports with the taken
    numbers and counting the taken ones passed.
    """
    ext = r"(\.[^.]*)\z"
    stem = F.regexp_replace("name", ext, "")
    named = imports.withColumn("_key", full_key("source", "id"))
    ranked = cut_lineage(
        number_within(named, ["name"], ["_key"], hash_chunk("_key"), "_nth").withColumn("_k", F.col("_nth") - 1)
    )
    # numbers taken per name: 0 is the plain name, n is `stem(n).ext`
    known = existing.select("name").distinct()
    wanted = ranked.filter(F.col("_k") == 0).select("name")  # one row per name
    copy = r"\A(.*)\(([1-9][0-9]{0,17})\)((?:\.[^.]*)?)\z"
    numbered = known.unionByName(wanted).distinct().filter(F.col("name").rlike("(?s)" + copy)).select(
        F.concat(F.regexp_extract("name", "(?s)" + copy, 1), F.regexp_extract("name", "(?s)" + copy, 3)).alias("name"),
        F.regexp_extract("name", "(?s)" + copy, 2).cast("bigint").alias("_number"),
    )
    taken = known.select("name", F.lit(0).cast("bigint").alias("_number")).unionByName(numbered)
    taken = taken.join(wanted, "name", "left_semi")
    taken = cut_lineage(taken)
    places = number_within(taken, ["name"], ["_number"], number_chunk("_number"), "_nth")
    # free numbers below a taken one: imports before that count are numbered below it
    passed = places.select(
        "name", (F.col("_number") - F.col("_nth") + 1).alias("_k"), F.lit(0).alias("_side"), F.lit(1).alias("_one"),
        F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("id"),
        F.lit("").alias("_key"),
    )
    asked = ranked.select(
        "name", "_k", F.lit(1).alias("_side"), F.lit(0).alias("_one"),
        F.col("source").cast("string").alias("source"), F.col("id").cast("string").alias("id"), "_key",
    )
    merged = running_sum_within(
        asked.unionByName(passed), ["name"], ["_k", "_side", "_key"], number_chunk("_k"), F.col("_one"), "_taken"
    ).filter(F.col("_side") == 1)
    number = F.col("_k") + F.col("_taken")
    return merged.select(
        "source",
        "id",
        "name",
        F.when(number == 0, F.col("name"))
        .otherwise(F.concat(stem, F.lit("("), number.cast("string"), F.lit(")"), F.regexp_extract("name", ext, 1)))
        .alias("file_name"),
    )


# ---- envelope -----------------------------------------------------------

#: Fields of a hit in the answer, those the hits have.
HIT_FIELDS = ("source", "id", "title", "url", "subtitle", "format_hint", "extra")


def to_envelope(
    summary: DataFrame,
    top: DataFrame,
    errors: DataFrame | None = None,
    translated: DataFrame | None = None,
    requested: DataFrame | None = None,
) -> DataFrame:
    """One JSON text per query: count, hint, errors and the ranked results; a limit of the search bounds them.

    translated (query_id, to, via) adds the title that foreign sources were asked for, requested (query_id, source)
    the sources asked; there is at most one of the former and one of the latter per source for a query.
    """
    fields = [f for f in HIT_FIELDS if f in top.columns]
    hit = F.struct(*[F.col(f) for f in fields])
    results = top.groupBy("query_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", hit.alias("hit"))), lambda a, b: a["rank"] - b["rank"]),
            lambda r: r["hit"],
        ).alias("results")
    )
    out = summary.join(results, "query_id", "left")
    if errors is None:
        out = out.withColumn("errors", F.create_map().cast("map<string,string>"))
    else:
        # one entry per registered source at most
        per_query = errors.groupBy("query_id").agg(
            F.map_from_entries(F.array_sort(F.collect_set(F.struct("source", "message")))).alias("errors")
        )
        out = out.join(per_query, "query_id", "left").withColumn(
            "errors", F.coalesce("errors", F.create_map().cast("map<string,string>"))
        )
    more = []
    if translated is not None:
        names = translated.select("query_id", F.struct("to", "via").alias("translated"))
        out = out.join(names, "query_id", "left")
        more.append("translated")
    if requested is not None:
        asked = requested.groupBy("query_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))
        out = out.join(asked, "query_id", "left")
        more.append("sources")
    hint = F.col("hint") if "hint" in summary.columns else F.lit("")
    empty = F.array().cast(top.select(F.array(hit)).schema[0].dataType)
    return out.select(
        "query_id",
        F.to_json(
            F.struct(
                "query", F.col("hits").alias("count"), "errors", hint.alias("hint"),
                F.coalesce("results", empty).alias("results"), *more,
            )
        ).alias("envelope"),
    )

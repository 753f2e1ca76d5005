"""Exact duplicates by deterministic block naming.

A normalised text is cut into blocks of a fixed number of code points. The distinct blocks are sorted and named
by integers; then adjacent names are paired, the distinct pairs sorted and named, and so on until one name is
left. Two texts with as many blocks have the same name exactly if they are equal. Block contents are shuffled
once, for their distinct set; occurrences travel as 64-bit hashes, and blocks whose hash is shared by different
contents are told apart by content, so no name depends on luck.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import SPACE, materialise

#: Code points of a block.
BLOCK = 1024


def _named(distinct: DataFrame, *keys: str) -> DataFrame:
    """Integer names in sorted order within each part; every part has its own range of integers."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def name_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = BLOCK,
    block_hash: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """Per row: uid, id, text_sha256, n_blocks, name. Rows have equal (n_blocks, name) exactly if their texts are
    equal after each run of ASCII white space is replaced by one space; a null text counts as empty.

    Repeated rows get a row each (uid tells them apart); other columns of `docs` are not read.
    """
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE + "+", " ")
    base = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    cut = F.regexp_extract_all("t", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    cut = F.when(F.col("t") == "", F.array(F.lit(""))).otherwise(cut)
    cut_rows = base.select("id", F.sha2("t", 256).alias("text_sha256"), cut.alias("b")).select(
        F.monotonically_increasing_id().alias("uid"),
        "id",
        "text_sha256",
        F.size("b").alias("n_blocks"),
        F.transform("b", lambda x: block_hash(x)).alias("h"),
        "b",
    )
    rows = materialise(cut_rows.drop("b"), "rows")
    contents = base.select(F.explode(cut).alias("b")).select(block_hash(F.col("b")).alias("h"), "b").distinct()
    names = materialise(_named(contents, "h", "b").select("h", "name"), "names")
    clash = materialise(names.groupBy("h").count().filter("count > 1").select("h"), "clash")
    if clash.isEmpty():
        current = rows.select("uid", "n_blocks", F.posexplode("h").alias("pos", "h")).join(names, "h").drop("h")
    else:
        rows = materialise(cut_rows, "rows")  # with the contents, as hashes alone do not tell all blocks apart
        current = _by_content(rows, names, clash)
        rows = rows.drop("b")
    current = materialise(current.select("uid", "n_blocks", "pos", "name"), "level")
    longest, reach, done = rows.agg(F.max("n_blocks")).first()[0] or 1, 1, []
    while True:
        done.append(current.filter(F.col("n_blocks") <= reach).select("uid", "name"))
        if reach >= longest:
            break
        pairs = materialise(
            current.filter(F.col("n_blocks") > reach)
            .groupBy("uid", "n_blocks", F.shiftright("pos", 1).alias("pos"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
            ),
            "pairs",
        )
        names = materialise(_named(pairs.select("left", "right").distinct(), "left", "right"), "names")
        current = materialise(pairs.join(names, ["left", "right"]).drop("left", "right"), "level")
        reach *= 2
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    return rows.drop("h").join(found, "uid")


def _by_content(rows: DataFrame, names: DataFrame, clash: DataFrame) -> DataFrame:
    """Names where some hashes stand for several contents: those blocks are named by content."""
    at = rows.select("uid", "n_blocks", F.posexplode(F.arrays_zip("h", "b")).alias("pos", "x"))
    at = at.select("uid", "n_blocks", "pos", "x.h", "x.b")
    shared = materialise(at.join(clash, "h", "left_semi"), "shared")
    told = materialise(_named(shared.select("h", "b").distinct(), "h", "b"), "told")
    # negative names meet no other name; -1 is kept for a missing right half
    apart = shared.join(told, ["h", "b"]).withColumn("name", -F.col("name") - 2)
    plain = at.drop("b").join(clash, "h", "left_anti").join(names, "h")
    return plain.select("uid", "n_blocks", "pos", "name").union(apart.select("uid", "n_blocks", "pos", "name"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest id stays; null ids come last, and of rows that repeat an id one
    stays. An empty table gives an empty result.
    """
    named = materialise(name_texts(docs, id_col, text_col, **options), "named")
    first = F.min(F.struct(F.col("id").isNull().alias("absent"), "id", "uid"))
    groups = materialise(
        named.groupBy("n_blocks", "name")
        .agg(first.alias("first"), F.count("*").alias("group_size"))
        .select("n_blocks", "name", F.col("first.id").alias("keep_id"), F.col("first.uid").alias("keep_uid"), "group_size"),
        "groups",
    )
    return named.join(groups, ["n_blocks", "name"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256"
    )

"""Paragraphs next to their stored translations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.rows import explode_rows
from quire.functions.text import as_col, full_key, trans_direction
from quire.operators.segment import paragraph_array


def chapter_direction(title: str | Column, text: str | Column) -> Column:
    return trans_direction(F.concat_ws("\n", F.coalesce(as_col(title), F.lit("")), as_col(text)))


def apply_translation_memory(paras: DataFrame, memory: DataFrame) -> DataFrame:
    """Add `translation`, null where the memory has none.

    paras (…, para, direction); memory (direction, para_sha, translation). The memory is reduced to one
    row per key before the join, so no paragraph is multiplied.
    """
    known = memory.groupBy("direction", "para_sha").agg(F.min("translation").alias("translation"))
    return paras.withColumn("para_sha", F.sha1("para")).join(known, ["direction", "para_sha"], "left").select(
        *paras.columns, "translation"
    )


def translate_missing(paras: DataFrame, provider: Callable[[Column], Column]) -> DataFrame:
    """Fill what the memory lacks with a provider of the user, an Arrow function from text to text or null.

    The provider sees every missing text once, however often the paragraph occurs.
    """
    missing = paras.filter(F.col("translation").isNull()).select("direction", "para").distinct()
    done = missing.withColumn("_new", provider(F.col("para")))
    return paras.join(done, ["direction", "para"], "left").select(
        *[c for c in paras.columns if c != "translation"], F.coalesce("translation", "_new").alias("translation")
    )


def memory_rows(paras: DataFrame) -> DataFrame:
    """Rows of the memory from translated paragraphs."""
    known = paras.filter(F.col("translation").isNotNull())
    return known.select("direction", F.sha1("para").alias("para_sha"), "translation").distinct()


def interleave(paras: DataFrame) -> DataFrame:
    return paras.withColumn("block", F.concat_ws("\n", "para", "translation"))


def chapter_key(rel: str | Column, idx: str | Column, direction: str | Column, text: str | Column) -> Column:
    """Key of the stored translation of a chapter; direction and text are part of it."""
    return full_key(rel, as_col(idx).cast("string"), direction, text)


def bilingual(chapters: DataFrame, stored: DataFrame, keys: Sequence[str] = ("rel", "chapter_idx")) -> DataFrame:
    """Paragraphs of chapters with translations kept per chapter; one whose length differs is rejected.

    chapters (rel, chapter_idx, title, text); stored (chapter_key, translations).
    """
    rel, idx = keys
    known = stored.groupBy("chapter_key").agg(F.min("translations").alias("_trs"))
    open_ = chapters.withColumn("direction", chapter_direction("title", "text")).withColumn(
        "_paras", paragraph_array("text", "title")
    )
    joined = open_.withColumn("chapter_key", chapter_key(rel, idx, "direction", "text")).join(known, "chapter_key", "left")
    fits = F.coalesce(F.size("_trs") == F.size("_paras"), F.lit(False))
    given = F.when(fits, F.col("_trs")).otherwise(F.array().cast("array<string>"))
    zipped = F.arrays_zip(F.col("_paras").alias("para"), given.alias("translation"))
    keyed = joined.withColumn("translated", fits)
    return explode_rows(keyed, [rel, idx, "direction", "translated"], zipped, "para_idx", "_p").select(
        rel, idx, "direction", "translated", "para_idx", "_p.para", "_p.translation",
        F.concat_ws("\n", "_p.para", F.nullif("_p.translation", F.lit(""))).alias("block"),
    )

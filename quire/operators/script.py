"""Script of a book: which one it is written in, and the other one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.script import ScriptTable
from quire.functions.text import is_blank

PROBE_CHAPTERS = 2
PROBE_CHARS = 800


def changed_chars(a: Column, b: Column) -> Column:
    """Positions that differ, plus the difference in length."""
    shorter = F.least(F.length(a), F.length(b))
    differ = F.zip_with(
        F.split(F.substring(a, F.lit(1), shorter), ""),
        F.split(F.substring(b, F.lit(1), shorter), ""),
        lambda x, y: F.when(x != y, 1).otherwise(0),
    )
    return F.aggregate(differ, F.abs(F.length(a) - F.length(b)), lambda acc, x: acc + x)


def detect_script(
    chapters: DataFrame, table: ScriptTable, keys: Sequence[str], order: str = "chapter_idx"
) -> DataFrame:
    """`simp` or `trad` per book, by which direction changes more of its first text; null without text."""
    probes = chapters.groupBy(*keys).agg(
        F.min_by(
            F.when(F.col(order) < PROBE_CHAPTERS, F.substring("text", 1, PROBE_CHARS)),
            F.when((F.col(order) < PROBE_CHAPTERS) & ~is_blank(F.substring("text", 1, PROBE_CHARS)), F.col(order)),
        ).alias("probe")
    )
    both = probes.withColumn("_s", table.simplified("probe")).withColumn("_t", table.traditional("probe"))
    votes = both.select(
        *keys,
        "probe",
        changed_chars(F.col("probe"), F.col("_s")).alias("t2s_changes"),
        changed_chars(F.col("probe"), F.col("_t")).alias("s2t_changes"),
    )
    base = F.when(F.col("probe").isNull(), None).when(F.col("s2t_changes") >= F.col("t2s_changes"), "simp").otherwise("trad")
    return votes.select(*keys, "t2s_changes", "s2t_changes", base.alias("base"))


def convert_away(
    chapters: DataFrame, base: DataFrame, table: ScriptTable, keys: Sequence[str], cols: Sequence[str] = ("title", "text")
) -> DataFrame:
    """Chapters in the script their book is not written in."""
    known = chapters.join(base.select(*keys, F.col("base").alias("_base")), list(keys), "left")
    simp = F.coalesce(F.col("_base") == "simp", F.lit(False))
    return known.withColumns(
        {c: F.when(simp, table.traditional(c)).otherwise(table.simplified(c)) for c in cols}
    ).drop("_base")

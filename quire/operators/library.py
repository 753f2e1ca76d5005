"""The local library: shelf, reading positions, whole-book progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import progress_key, progress_pct, size_kb


def latest_progress(progress_events: DataFrame) -> DataFrame:
    """Position per book: the latest event counts, a partial and its finished book are one."""
    return (
        progress_events.groupBy(progress_key("rel").alias("rel"))
        .agg(F.max_by(F.struct("chapter", "pct"), F.struct("ts", "event_id")).alias("_p"))
        .select("rel", "_p.chapter", "_p.pct")
    )


def chapter_counts(chapters: DataFrame) -> DataFrame:
    return chapters.groupBy("rel").agg(F.count(F.lit(1)).alias("chapters"))


def shelf(files: DataFrame, progress: DataFrame, counts: DataFrame) -> DataFrame:
    """Books of the library with their positions.

    files (rel, length); progress (rel, chapter, pct), one row per book; counts (rel, chapters). A
    partial is hidden once the finished book of its title exists; a file that cannot be read has no
    count and so no percentage.
    """
    name = F.substring_index("rel", "/", -1)
    is_part = F.col("rel").endswith(".txt.part")
    listed = files.select(
        "rel",
        "length",
        is_part.alias("partial"),
        F.when(is_part, F.regexp_replace(name, r"\.txt\.part\z", "")).otherwise(F.regexp_replace(name, r"\.[^.]*\z", "")).alias("title"),
        F.when(is_part, "txt").otherwise(F.lower(F.substring_index(name, ".", -1))).alias("format"),
    )
    finished = listed.filter("not partial").select(F.col("rel").alias("_finished")).distinct()
    # finished books look for nothing; a key of their own keeps them apart in the shuffle
    target = F.when(F.col("partial"), F.concat("title", F.lit(".txt"))).otherwise(F.concat(F.lit("\x00"), F.col("rel")))
    shown = listed.withColumn("_target", target).join(finished, F.col("_target") == F.col("_finished"), "left_anti")
    return (
        shown.withColumn("_key", F.when(F.col("partial"), progress_key("rel")).otherwise(F.col("rel")))
        .join(progress.select(F.col("rel").alias("_key"), "chapter", "pct"), "_key", "left")
        .join(counts, "rel", "left")
        .select(
            "rel", "title", "format", size_kb("length").alias("size_kb"), "chapters", "partial", "chapter", "pct",
            F.when(F.col("chapter").isNotNull(), progress_pct("chapter", "pct", "chapters")).alias("progress_pct"),
        )
    )

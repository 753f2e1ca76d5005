"""Ordered work inside a group that stays parallel when one group holds most of the rows.

A plain window puts a whole group into one task. Here the order is cut into chunks by a monotone
expression of the order columns (position ranges, time ranges, hash prefixes). The window runs per
(group, chunk); what one chunk hands to the next is a summary row, and only those summaries meet per
group. Both sides of the final join are partitioned by (group, chunk), so no row moves twice. The input
is read twice, once for its narrow columns; callers materialise an input that is costly to compute.
Keys and order are expected to be set; a row without them stays, ordered within its chunk only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions per chunk where the order column is a whole number.
CHUNK = 1 << 14
#: Seconds per chunk where it is a time.
CHUNK_SECONDS = 60.0


def number_chunk(c: str | Column, size: int = CHUNK) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.floor(col / F.lit(size))


def time_chunk(c: str | Column, seconds: float) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.floor(F.unix_micros(col.cast("timestamp")) / F.lit(int(seconds * 1_000_000)))


def hash_chunk(key: str | Column, digits: int = 4) -> Column:
    """Prefix of a hexadecimal hash: evenly filled and in the order of the hash."""
    return F.substring(F.col(key) if isinstance(key, str) else key, 1, digits)


def running_sum_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, value: Column, name: str
) -> DataFrame:
    """Sum of `value` from the start of the group up to and including the row."""
    keys = list(keys)
    rows = df.withColumn("_chunk", chunk).withColumn("_value", value)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys, "_chunk")
        .agg(F.sum("_value").alias("_total"))
        .select(*keys, "_chunk", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    )
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("_local", F.sum("_value").over(local))
        .join(offsets, [*keys, "_chunk"], "left")
        .withColumn(name, F.col("_local") + F.coalesce("_offset", F.lit(0)))
        .drop("_chunk", "_value", "_local", "_offset")
    )


def number_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, name: str
) -> DataFrame:
    """1, 2, 3 … inside every group."""
    return running_sum_within(df, keys, order, chunk, F.lit(1).cast("bigint"), name)


def previous_within(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    fields: Sequence[str],
    n: int = 1,
    name: str = "previous",
) -> DataFrame:
    """Array of the up to `n` rows just before each row in its group, oldest first."""
    keys = list(keys)
    rows = df.withColumn("_chunk", chunk).withColumn("_fields", F.struct(*fields))
    if n == 1:
        tails = rows.groupBy(*keys, "_chunk").agg(F.array(F.max_by("_fields", F.struct(*order))).alias("_tail"))
    else:
        back = Window.partitionBy(*keys, "_chunk").orderBy(*[F.desc(o) for o in order])
        tails = (
            rows.select(*keys, "_chunk", *order, "_fields")
            .withColumn("_back", F.row_number().over(back))
            .filter(F.col("_back") <= n)
            .groupBy(*keys, "_chunk")
            .agg(F.reverse(F.sort_array(F.collect_list(F.struct("_back", "_fields")))).alias("_tail"))
            .select(*keys, "_chunk", F.transform("_tail", lambda t: t["_fields"]).alias("_tail"))
        )
    # every chunk present holds at least one row, so n chunks back are enough
    across = Window.partitionBy(*keys).orderBy("_chunk")
    empty = F.slice("_tail", F.lit(1), F.lit(0))
    carried = F.concat(*[F.coalesce(F.lag("_tail", k).over(across), empty) for k in range(n, 0, -1)])
    carry = tails.select(*keys, "_chunk", carried.alias("_carry"))
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    near = F.filter(F.array(*[F.lag("_fields", k).over(local) for k in range(n, 0, -1)]), lambda f: f.isNotNull())
    seen = F.concat(F.coalesce("_carry", F.slice("_near", F.lit(1), F.lit(0))), "_near")
    return (
        rows.withColumn("_near", near)
        .join(carry, [*keys, "_chunk"], "left")
        .withColumn(name, F.slice(seen, F.greatest(F.size(seen) - n + 1, F.lit(1)), F.lit(n)))
        .drop("_chunk", "_fields", "_near", "_carry")
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key: a partial aggregate, so a hot key shrinks before it is shuffled."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
        .select(*df.columns)
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key, as `first_per_key`."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
        .select(*df.columns)
    )

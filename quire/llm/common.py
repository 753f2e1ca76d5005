"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.session import checkpoint_dir

#: ASCII white space as a Java character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Most rows of a side that is broadcast; larger sides are shuffled.
BROADCAST_ROWS = 20_000


def release_memory() -> None:
    """Give what earlier tasks of this worker have freed back to the system: workers are used again, stage after stage."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder name in the cluster's shared folder, removed when the driver's file system closes."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/quire-{tag}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialise(df: DataFrame, tag: str = "step") -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint if the rows, counted, are within the bound; otherwise the join shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def in_order(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Add `part` and `place` (0-based within the part): rows are in ascending key order over (part, place).

    The parts come from a range shuffle, so no task holds more than its share of the distinct keys.
    """
    spread = materialise(df.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "ordered")
    return spread.withColumn("place", F.row_number().over(W.partitionBy("part").orderBy(*keys)) - 1)


def ranked(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Add `rank`, the 0-based place in the order of the keys over the whole table."""
    rows = in_order(df, *keys)
    # one row per part: as many as the shuffle has partitions
    before = rows.groupBy("part").agg(F.count("*").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    )
    return rows.join(small(before.drop("n")), "part").withColumn("rank", F.col("before") + F.col("place")).drop(
        "before", "part", "place"
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node that links reach.

    Alternating large-star and small-star rounds; each round is written to the shared folder. The smallest
    neighbour of a node is aggregated before the join, so a node with very many links is split like any other key.
    """
    links = materialise(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links"
    )

    def star(pairs: DataFrame) -> DataFrame:
        least = materialise(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")
        return pairs.join(least, "u")

    state = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = materialise(large.filter("u <> v").distinct(), "large")
        near = star(large)
        near = near.select("u", F.col("m").alias("v")).union(
            near.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        links = materialise(near.distinct(), "links")
        now = tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state:
            break
        state = now
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())

"""Incremental ingestion, reading positions and download checkpoints as streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire import schemas
from quire.functions.text import progress_key, url_host
from quire.operators import store
from quire.operators.extract import drop_shells, extract_main_text
from quire.operators.library import latest_progress
from quire.operators.render import book_stats


def ingest_stream(
    pages: DataFrame, store_path: str, checkpoint: str, container: str, first_batch: int = 0
) -> StreamingQuery:
    """Pages not stored yet go to the content store as books; restarting goes on where it stopped.

    pages (page_id, url, html). Known pages are left out before their text is extracted; they are found in those
    buckets of the key index that the batch's keys fall into. A page that comes twice in a batch is stored once. `first_batch` keeps batch numbers unique when a store outlives a
    checkpoint folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        number = first_batch + batch_id
        asked = batch.select(
            url_host("url").alias("source"), F.col("page_id").cast("string").alias("id"), "url", "html"
        )
        fresh = store.pending(asked, store.known_keys(batch.sparkSession, store_path, asked.select("source", "id"), number))
        text = drop_shells(extract_main_text(fresh, container))
        books = book_stats(text.withColumnRenamed("text", "content")).withColumn("format", F.lit("txt"))
        store.store_upsert(books, store_path, number)

    return (
        pages.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def progress_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Latest position per book and batch, kept as versions; `read_progress` resolves them by time."""

    def write(batch: DataFrame, batch_id: int) -> None:
        latest = batch.groupBy(progress_key("rel").alias("rel")).agg(
            F.max(F.struct("ts", "event_id", "chapter", "pct")).alias("_p")
        )
        (
            latest.select("rel", "_p.chapter", "_p.pct", "_p.ts", "_p.event_id", F.lit(batch_id).alias("batch_id"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(path)
        )

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    return latest_progress(spark.read.schema(schemas.PROGRESS).parquet(path))


def checkpoint_stream(chapter_events: DataFrame) -> DataFrame:
    """Streaming form of the last good position per partial download; update mode."""
    return store.latest_checkpoints(chapter_events)

from datetime import datetime, timedelta, timezone

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quire import schemas
from quire.operators import library, store
from quire.plans.queries import ARTICLE, q_ingest_stream
from quire.sources import readers
from quire.streaming import ingest


def test_ingest_is_incremental(spark, tmp_path, sf_dir):
    source, path, checkpoint = (str(tmp_path / n) for n in ("pages", "store", "checkpoint"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    pages.filter("page_id % 2 = 0").coalesce(1).write.parquet(source)

    def run():
        stream = spark.readStream.schema(schemas.PAGES).parquet(source)
        ingest.ingest_stream(stream, path, checkpoint, ARTICLE).awaitTermination()

    run()
    first = store.store_versions(spark, path).count()
    # known pages come again together with new ones
    pages.coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    versions = store.store_versions(spark, path)
    assert first == pages.filter("page_id % 2 = 0").count()
    assert versions.count() == pages.count() == store.read_store(spark, path).count()
    assert versions.groupBy("batch_id").count().count() == 2


def test_progress_stream_equals_batch(spark, tmp_path):
    t0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
    events = spark.createDataFrame(
        [(f"b{i % 3}.txt" + (".part" if i % 2 else ""), i, i, t0 + timedelta(minutes=(i * 7) % 23), i) for i in range(60)], schemas.PROGRESS
    )
    source, path = str(tmp_path / "events"), str(tmp_path / "progress")
    for part in range(3):
        events.filter(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schemas.PROGRESS).parquet(source)
        ingest.progress_stream(stream, path, str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(rows(ingest.read_progress(spark, path))) == sorted(rows(library.latest_progress(events)))


def test_checkpoint_stream(spark, tmp_path):
    schema = "source string, id string, title string, idx int, text string"
    source = str(tmp_path / "chapters")
    spark.createDataFrame([("s", "1", "t", i, "" if i == 3 else "x") for i in range(4)], schema).write.parquet(source)
    query = (
        ingest.checkpoint_stream(spark.readStream.schema(schema).parquet(source))
        .writeStream.outputMode("update").format("memory").queryName("marks").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert rows(spark.table("marks")) == [("s", "1", "t", 2)]


def test_ingest_keeps_pages_without_a_host(spark, tmp_path):
    source, path = str(tmp_path / "pages"), str(tmp_path / "store")
    page = "<article>text {}</article>"
    data = [(1, "no host", page.format(1)), (2, None, page.format(2)), (3, "http://h/x", page.format(3)), (3, "http://h/x", page.format(3))]
    for run in range(2):
        spark.createDataFrame(data, schemas.PAGES).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schemas.PAGES).parquet(source)
        ingest.ingest_stream(stream, path, str(tmp_path / "checkpoint"), ARTICLE).awaitTermination()
        assert store.store_versions(spark, path).count() == 3
    assert sorted(r["content"] for r in store.read_store(spark, path).collect()) == ["text 1", "text 2", "text 3"]


def test_ingest_reads_a_table_of_one_file_and_of_a_folder(spark, tmp_path, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages.repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    (tmp_path / "documents.parquet").mkdir()
    got = [sorted(rows(q_ingest_stream(spark, d), "source", "id", "title", "content")) for d in (sf_dir, str(tmp_path))]
    assert got[0] == got[1] and len(got[0]) == pages.count()


def test_only_a_missing_store_counts_as_empty(spark, tmp_path):
    asked = spark.createDataFrame([("s", "1")], "source string, id string")
    assert store.known_keys(spark, str(tmp_path / "none"), asked, 1).count() == 0
    with pytest.raises(Exception):
        store.known_keys(spark, "nosuchscheme://x/y", asked, 1)


def test_a_library_of_many_files_is_listed_by_a_few_tasks_a_core(spark, tmp_path):
    library = tmp_path / "library"
    library.mkdir()
    for i in range(80):
        (library / f"b{i}.txt").write_text(f"text {i}")
    found = readers.library_stream(spark, str(library)).writeStream.foreachBatch(lambda batch, _: batch.write.parquet(str(tmp_path / "found")))
    query = found.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "found")).select("rel").distinct().count() == 80
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(str(query.runId)) for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages) <= 4 * spark.sparkContext.defaultParallelism

import re
from datetime import datetime, timedelta, timezone

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quire.operators import bilingual as bi
from quire.operators import library, snapshots, store
from quire.operators.segment import paragraphs
from quire.plans.registry import extract, register_extractor

NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)


def books(spark, *bs):
    return spark.createDataFrame(list(bs), "source string, id string, content string")


def at(n):
    return F.timestamp_micros(F.lit(n))


def test_versions_retries_tombstones_and_compaction(spark, tmp_path):
    path = str(tmp_path / "store")
    store.store_upsert(books(spark, ("s", "1", "old"), ("s", "2", "two"), ("t", "1", "other")), path, 0, at(0))
    for _ in range(2):  # a retried batch replaces itself
        store.store_upsert(books(spark, ("s", "1", "new")), path, 1, at(1))
    store.store_upsert(books(spark, ("s", "2", None)), path, 2, at(2), deleted=True)
    want = [("s", "1", "new"), ("t", "1", "other")]
    assert rows(store.read_store(spark, path).orderBy("source", "id"), "source", "id", "content") == want
    assert store.store_versions(spark, path).count() == 5
    store.compact(spark, path, str(tmp_path / "compact"))
    assert rows(store.read_store(spark, str(tmp_path / "compact")).orderBy("source", "id"), "source", "id", "content") == want
    assert store.store_versions(spark, str(tmp_path / "compact")).count() == 2
    # a part of another schema is a miss
    other = {"part": "gone", "schema": 9, "batches": [7], "bits": 0, "rows": 1, "keys": 1, "dead": 0}
    snapshots.commit(spark, path, lambda parts: [*parts, other])
    assert rows(store.read_store(spark, path).orderBy("source", "id"), "source", "id", "content") == want


def test_null_and_empty_keys_and_repeated_ones(spark, tmp_path):
    path = str(tmp_path / "store")
    first = books(spark, ("", "1", "a"), (None, "1", "b"), ("h", "2", "y"), ("h", "2", "z"), ("h", None, "c"), ("h", "2", "y"))
    store.store_upsert(first, path, 0, at(0))
    got = rows(store.read_store(spark, path), "source", "id", "content")
    assert len(got) == 4 and {g[:2] for g in got} == {("", "1"), (None, "1"), ("h", "2"), ("h", None)}
    again = str(tmp_path / "again")
    store.store_upsert(first.repartition(3), again, 0, at(0))
    assert set(rows(store.read_store(spark, again), "source", "id", "content")) == set(got)
    mixed = spark.createDataFrame([("", "1", "new", False), (None, "1", "dead", True), ("h", "2", "both", False), ("h", "2", None, True)], "source string, id string, content string, gone boolean")
    store.store_upsert(mixed, path, 1, at(1), F.col("gone"))
    assert set(rows(store.read_store(spark, path), "source", "id", "content")) == {("", "1", "new"), ("h", None, "c")}
    have = store.read_store(spark, path)
    asked = books(spark, ("", "1", ""), (None, "1", ""), ("h", None, ""))
    assert rows(store.pending(asked, have), "source", "id") == [(None, "1")]
    assert sorted(rows(store.split_cached(asked, have), "cached")) == [(False,), (True,), (True,)]


def keyed(spark, start, end, text="x"):
    return spark.range(start, end).select(
        F.concat(F.lit("host"), F.col("id") % 3).alias("source"), F.col("id").cast("string").alias("id"), F.lit(text).alias("content")
    )


def test_readers_see_whole_batches(spark, tmp_path):
    path = str(tmp_path / "store")
    assert store.read_store(spark, path).count() == 0 and snapshots.snapshot(spark, path)["version"] == 0
    store.store_upsert(keyed(spark, 0, 10), path, 0, at(0))
    before = store.read_store(spark, path)
    # a batch that fails while it is written is never seen, and its files go
    broken = keyed(spark, 0, 10).withColumn("content", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.store_upsert(broken, path, 1, at(1))
    assert store.read_store(spark, path).count() == 10 and snapshots.snapshot(spark, path)["version"] == 1
    store.store_upsert(keyed(spark, 5, 15, "new"), path, 1, at(1))
    store.compact_store(spark, path)
    assert snapshots.snapshot(spark, path)["version"] == 3 and len(snapshots.live_parts(spark, path)) == 1
    assert before.filter("content = 'x'").count() == 10  # the older version can still be read
    assert store.read_store(spark, path).groupBy("content").count().collect() and store.read_store(spark, path).count() == 15
    assert len(snapshots.remove_superseded(spark, path, versions=1)) == 0  # too young
    gone = snapshots.remove_superseded(spark, path, versions=1, older_than_hours=0)
    assert len(gone) == 3 and len(list((tmp_path / "store" / "data").iterdir())) == 1
    assert sorted(rows(store.read_store(spark, path).groupBy("content").count())) == [("new", 10), ("x", 5)]
    store.store_upsert(keyed(spark, 0, 3, "retried"), path, 1, at(9))  # taken up by the compaction
    assert store.read_store(spark, path).filter("content = 'retried'").count() == 0


def test_a_second_writer_starts_from_the_first_ones_version(spark, tmp_path):
    path, calls = str(tmp_path / "store"), []

    def change(parts):
        if not calls:
            calls.append(snapshots.commit(spark, path, lambda p: [*p, {"part": "other"}]))
        return [*parts, {"part": "own"}]

    assert snapshots.commit(spark, path, change) == 2
    assert [p["part"] for p in snapshots.snapshot(spark, path)["parts"]] == ["other", "own"]


@pytest.mark.parametrize("probes", [0, 1000])
def test_keys_are_found_in_their_buckets_of_the_index(spark, tmp_path, monkeypatch, probes):
    monkeypatch.setattr(snapshots, "BUCKET_KEYS", 16)
    monkeypatch.setattr(snapshots, "PROBES", probes)
    path = str(tmp_path / "store")
    store.store_upsert(keyed(spark, 0, 200).repartition(3), path, 0, at(0))
    store.store_upsert(keyed(spark, 150, 160), path, 1, at(1), deleted=True)
    store.store_upsert(books(spark, (None, "1", "n"), ("", "1", "e")), path, 2, at(2))
    bits = {p["batches"][0]: p["bits"] for p in snapshots.live_parts(spark, path)}
    assert bits == {0: 4, 1: 0, 2: 0}
    data = list((tmp_path / "store" / "data").glob("part=0-*/*.parquet"))
    assert len(data) == 3  # rows stay in the tasks that have them
    asked = keyed(spark, 148, 152).select("source", "id").union(books(spark, (None, "1", ""), ("x", "1", "")).select("source", "id"))
    found = store.known_keys(spark, path, asked, 3)
    assert set(rows(found.join(asked, ["source", "id"], "left_semi"))) == {("host1", "148"), ("host2", "149")}
    assert rows(store.pending(asked.filter("id = '1'"), found)) == [("x", "1")]
    assert all("/keys/" in f for f in found.inputFiles())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ IN", plan) and ("In(h, [" in plan) == bool(probes)
    assert store.known_keys(spark, path, asked, 0).count() == 0
    assert store.read_store(spark, path).count() == 192


@pytest.mark.parametrize("n", [0, 1])
def test_empty_batches(spark, tmp_path, n):
    path = str(tmp_path / "store")
    store.store_upsert(keyed(spark, 0, n), path, 0, at(0))
    store.store_upsert(keyed(spark, 0, 0), path, 1, at(1))
    store.compact_store(spark, path)
    assert store.read_store(spark, path).count() == store.store_versions(spark, path).count() == n
    assert store.known_keys(spark, path, keyed(spark, 0, 2).select("source", "id"), 5).count() == n


def test_cached_and_pending(spark):
    asked, have = books(spark, ("s", "1", ""), ("s", "2", "")), books(spark, ("s", "1", ""), ("s", "1", ""), ("t", "2", ""))
    assert rows(store.split_cached(asked, have).orderBy("id"), "id", "cached") == [("1", True), ("2", False)]
    assert rows(store.split_cached(asked, have, force=True).orderBy("id"), "cached") == [(False,), (False,)]
    assert rows(store.pending(asked, have), "id") == [("2",)]


def test_resume(spark):
    events = spark.createDataFrame([("s", "7", "書", i, "" if i == 1 else "x") for i in range(4)], "source string, id string, title string, idx int, text string")
    marks = store.latest_checkpoints(events)
    toc = spark.createDataFrame([("s", "7", i) for i in range(6)] + [("s", "9", 0)], "source string, id string, pos int")
    assert sorted(rows(store.resume_plan(toc, marks), "id", "pos")) == [("7", 4), ("7", 5), ("9", 0)]
    from_three = store.latest_checkpoints(events.filter("idx < 3"))
    assert sorted(rows(store.resume_plan(toc.filter("id = '7'"), from_three), "pos")) == [(3,), (4,), (5,)]


def test_checkpoint_states(spark):
    marks = spark.createDataFrame(
        [("s", "7", "書", "txt", 4), ("s", None, "旧", "txt", 2), ("t", "1", "別", "txt", 9), ("s", "5", "壊", "txt", None)],
        "source string, id string, title string, fmt string, idx int",
    )
    expected = spark.createDataFrame(
        [("s", "7", "書"), ("s", "8", "書"), ("s", "3", "旧"), ("s", "1", "別"), ("s", "5", "壊"), ("s", "6", "新")], "source string, id string, title string"
    )
    got = rows(store.checkpoint_state(expected, marks), "id", "resume_from", "restart")
    assert sorted(got) == [("1", 0, True), ("3", 3, False), ("5", 0, True), ("6", 0, False), ("7", 5, False), ("8", 0, True)]


def test_deletion_cascades(spark):
    files = spark.createDataFrame([("a.txt",), ("a.txt.part",), ("b.txt.part",), ("b.txt",), ("c.epub",), ("c.txt.part",)], "rel string")
    progress = spark.createDataFrame([("a.txt", 1), ("b.txt", 2), ("c.epub", 3)], "rel string, chapter int")
    gone = spark.createDataFrame([("a.txt",), ("b.txt.part",), ("c.epub",)], "rel string")
    kept, read = store.delete_library_rows(files, progress, gone)
    assert rows(kept) == [("b.txt",)]
    assert rows(read) == []
    assert rows(store.delete_books(books(spark, ("s", "1", ""), ("s", "2", "")), books(spark, ("s", "1", ""))), "id") == [("2",)]


@pytest.mark.parametrize(
    "age, dead, paths, outcome, action",
    [
        (timedelta(seconds=60), True, True, None, "refuse"), (timedelta(days=6), False, True, None, "fresh"),
        (timedelta(days=8), False, True, "transient", "stale"), (timedelta(days=8), False, False, "transient", "fail"),
        (timedelta(days=8), True, True, "ok", "refreshed"), (timedelta(days=8), False, True, "gone", "mark_dead"),
        (None, None, False, None, "refresh"), (timedelta(days=7), False, True, None, "refresh"),
    ],
)
def test_freshness(spark, age, dead, paths, outcome, action):
    df = spark.createDataFrame([(NOW - age if age else None, dead, paths, outcome)], "ts timestamp, dead boolean, has_paths boolean, outcome string")
    assert store.freshness(df, F.lit(NOW), "7 days", "outcome").first()["action"] == action


def test_progress_and_shelf(spark):
    t = [datetime(2024, 1, d, tzinfo=timezone.utc) for d in (1, 2, 3)]
    events = spark.createDataFrame(
        [("連.txt", 1, 100, t[2], 1), ("連.txt.part", 3, 500, t[1], 2), ("完.txt", 0, 0, t[0], 3), ("完.txt", 2, 250, t[0], 4)],
        "rel string, chapter int, pct int, ts timestamp, event_id long",
    )
    latest = library.latest_progress(events)
    assert sorted(rows(latest)) == [("完.txt", 2, 250), ("連.txt", 1, 100)]
    files = spark.createDataFrame([("連.txt.part", 10), ("完.txt", 5000), ("完.txt.part", 10), ("d/e.EPUB", 2048)], "rel string, length long")
    chapters = spark.createDataFrame([("連.txt.part",)] * 5 + [("完.txt",)] * 4, "rel string")
    got = rows(library.shelf(files, latest, library.chapter_counts(chapters)).orderBy("rel"))
    assert got == [
        ("d/e.EPUB", "e", "epub", 2, None, False, None, None, None),
        ("完.txt", "完", "txt", 4, 4, False, 2, 250, 56),
        ("連.txt.part", "連", "txt", 1, 5, True, 1, 100, 22),
    ]


def test_translation_memory(spark):
    chapters = spark.createDataFrame([("r", 0, "T", "T\n\none\n\ntwo"), ("r", 1, "U", "x\n\ny")], "rel string, chapter_idx int, title string, text string")
    paras = paragraphs(chapters).withColumn("direction", F.lit("zh2en"))
    memory = spark.createDataFrame([("zh2en", "one", "eins"), ("en2zh", "two", "zwei"), ("zh2en", "one", "eins")], "direction string, p string, translation string")
    memory = memory.select("direction", F.sha1("p").alias("para_sha"), "translation")
    got = rows(bi.interleave(bi.apply_translation_memory(paras, memory)).orderBy("chapter_idx", "para_idx"), "para", "translation", "block")
    assert got == [("one", "eins", "one\neins"), ("two", None, "two"), ("x", None, "x"), ("y", None, "y")]
    keyed = chapters.withColumn("k", bi.chapter_key("rel", "chapter_idx", F.lit("zh2en"), "text"))
    stored = keyed.select(F.col("k").alias("chapter_key"), F.when(F.col("chapter_idx") == 0, F.array(F.lit("eins"), F.lit(None))).otherwise(F.array(F.lit("a"))).alias("translations"))
    got = rows(bi.bilingual(chapters, stored).orderBy("chapter_idx", "para_idx"), "translated", "block")
    assert got == [(True, "one\neins"), (True, "two"), (False, "x"), (False, "y")]


def test_registered_extractor(spark):
    register_extractor("upper", lambda df: df.select(F.upper("html").alias("x")))
    assert rows(extract("upper", spark.createDataFrame([("a",)], "html string"))) == [("A",)]
    with pytest.raises(KeyError):
        extract("none", None)

import json

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from quire.functions.script import ScriptTable
from quire.operators import bilingual as bi
from quire.operators import catalog as cat
from quire.operators import render, store
from quire.plans import flows
from quire.streaming.hooks import watch


def test_search_flow(spark):
    catalog = spark.createDataFrame(
        [
            ("gutenberg", "1", "Pride and Prejudice"), ("gutenberg", "2", "Other"), ("ctext", "3", "傲慢与偏见 注"),
            ("biquge", "4", "傲慢与偏见"), ("github", "5", "Pride and Prejudice"),
        ],
        "source string, id string, title string",
    )
    queries = spark.createDataFrame([(1, "傲慢与偏见"), (2, "表外书"), (3, "other")], "query_id int, query string")
    titles = spark.createDataFrame([("傲慢与偏见", "Pride and Prejudice")], "zh string, en string")
    outcomes = spark.createDataFrame(
        [(q, s, True, None, None, None) for q in (1, 2, 3) for s in ("ctext", "github", "gutenberg", "biquge", "wikisource", "wikisource-en")]
        + [(1, "libgen", False, "network", "x", "y")],
        "query_id int, source string, ok boolean, kind string, name string, detail string",
    )
    got = {r[0]: json.loads(r[1]) for r in flows.search(catalog, queries, titles, outcomes).collect()}
    assert [h["id"] for h in got[1]["results"]] == ["4", "3", "1"] and got[1]["count"] == 3 and got[1]["hint"] == ""
    assert got[2]["count"] == 0 and got[2]["hint"].startswith("外文原版源")
    assert [h["id"] for h in got[3]["results"]] == ["2"]
    assert list(got[1]["errors"]) == ["libgen"]
    assert got[1]["translated"] == {"to": "Pride and Prejudice", "via": "dict"} and "translated" not in got[2]
    assert got[1]["sources"] == sorted(n for n, _ in cat.SOURCES)
    classics = {r[0]: json.loads(r[1]) for r in flows.search(catalog, queries, titles, outcomes, "中文古籍", 1).collect()}
    assert [h["id"] for h in classics[1]["results"]] == ["3"] and classics[1]["count"] == 1


@pytest.fixture
def stored(spark, tmp_path):
    books = spark.createDataFrame(
        [
            ("s", "1", "書/一", "lead\n序\n正文\n跋\n後記文", None, None, "txt"),
            ("s", "2", "plain", "no structure\n", None, None, "txt"),
            ("s", "3", "given", "x\ny", [("甲", "x"), ("", "y")], None, "txt"),
            ("s", "4", "file", None, None, bytearray(b"%PDF"), "pdf"),
            ("s", "5", "not asked", "z", None, None, "txt"),
        ],
        "source string, id string, title string, content string, chapters array<struct<title:string,text:string>>, raw binary, format string",
    )
    store.store_upsert(books, str(tmp_path / "store"), 0)
    return store.read_store(spark, str(tmp_path / "store"))


def test_get_flow(spark, stored):
    asked = spark.createDataFrame([("s", str(i)) for i in (1, 2, 3, 4, 9)], "source string, id string")
    assert rows(store.pending(asked, stored), "id") == [("9",)]
    got = {r["id"]: (r["name"], r["content"]) for r in flows.get_books(asked, stored).collect()}
    assert got == {
        "1": ("書_一.txt", "=== 序 ===\nlead\n正文\n\n=== 跋 ===\n後記文\n"),
        "2": ("plain.txt", "no structure\n"),
        "3": ("given.txt", "=== 甲 ===\nx\n\n=== 第2部分 ===\ny\n"),
    }
    simple = flows.get_books(asked, stored, convert=ScriptTable({"書": "书", "後": "后", "記": "记"}, {})).collect()
    assert {r["id"]: (r["name"], r["content"]) for r in simple}["1"] == ("书_一.txt", "=== 序 ===\nlead\n正文\n\n=== 跋 ===\n后记文\n")
    pages = rows(flows.get_books(asked, stored, "epub").orderBy("id", "play_order"), "id", "href", "name")
    assert pages == [
        ("1", "chap_0001.xhtml", "書_一.epub"), ("1", "chap_0002.xhtml", "書_一.epub"), ("2", "chap_0001.xhtml", "plain.epub"),
        ("3", "chap_0001.xhtml", "given.epub"), ("3", "chap_0002.xhtml", "given.epub"),
    ]
    assert rows(flows.raw_books(asked, stored), "name", "content") == [("file.pdf", bytearray(b"%PDF"))]
    lean = json.loads(render.book_json(stored.filter("id = '3'").select("source", "id", "title", "content", "chapters", "raw")).first()["json"])
    assert lean == {"source": "s", "id": "3", "title": "given", "chapters": ["甲", ""]}


def test_provider_fills_the_memory(spark):
    @F.pandas_udf("string")
    def shout(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t == "bad" else t.upper())

    paras = spark.createDataFrame(
        [(0, "zh2en", "one", "eins"), (1, "zh2en", "two", None), (2, "zh2en", "bad", None), (3, "zh2en", "two", None)],
        "para_idx int, direction string, para string, translation string",
    )
    out = bi.translate_missing(paras, shout)
    assert rows(out.orderBy("para_idx"), "translation") == [("eins",), ("TWO",), (None,), ("TWO",)]
    assert sorted(rows(bi.memory_rows(out), "translation")) == [("TWO",), ("eins",)]


def test_progress_hook(spark, tmp_path):
    seen = []
    hook = watch(spark, lambda name, batch, n: seen.append((name, batch, n)))
    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    query = stream.writeStream.format("noop").queryName("watched").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    import time

    for _ in range(50):
        if seen:
            break
        time.sleep(0.2)
    spark.streams.removeListener(hook)
    assert ("watched", 0, 5) in seen

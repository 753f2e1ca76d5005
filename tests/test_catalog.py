import json
import random
from collections import defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quire.functions.text import full_key
from quire.operators import catalog as cat
from quire.sources import readers


def brute_pairs(titles, queries):
    out = set()
    for q in set(queries):
        for t in set(titles):
            a, b = q.strip().lower(), t.strip().lower()
            if a and b and (a in b or b in a):
                out.add((q, t))
    return out


def frames(spark, titles, queries):
    catalog = spark.createDataFrame([(f"s{i % 3}", f"{i:04d}", t) for i, t in enumerate(titles)], "source string, id string, title string")
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(dict.fromkeys(queries))], "query_id int, query string")
    return catalog, asked


@pytest.mark.parametrize("seed", range(4))
def test_matching_equals_the_nested_loop(spark, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abAB 書") for _ in range(n))
    titles = [word(rng.randrange(0, 12)) for _ in range(80)] + ["hot title"] * 30
    queries = [word(rng.randrange(0, 9)) for _ in range(40)] + ["HOT title with more", "t", "", "ot "]
    catalog, asked = frames(spark, titles, queries)
    assert set(rows(cat.match_titles(catalog, asked))) == brute_pairs(titles, queries)


def test_title_examples(spark):
    catalog, asked = frames(spark, ["渊海子平", "Book", "八字提要"], ["渊海子平 全本", "BOOK", "python"])
    assert set(rows(cat.match_titles(catalog, asked))) == {("渊海子平 全本", "渊海子平"), ("BOOK", "Book")}
    paths = spark.createDataFrame([("r", "国学/渊海子平.txt"), ("r", "a/x.PDF"), ("r", "B.TXT"), ("q", "z.txt")], "repo string, path string")
    repos = spark.createDataFrame([("r", "main", "n", None)], "repo string, branch string, note string, license string")
    got = rows(readers.tree_catalog(paths, repos).orderBy("id"), "id", "title", "url")
    assert got == [
        ("r:B.TXT", "B", "https://github.com/r/blob/main/B.TXT"),
        ("r:国学/渊海子平.txt", "渊海子平", "https://github.com/r/blob/main/%E5%9B%BD%E5%AD%A6/%E6%B8%8A%E6%B5%B7%E5%AD%90%E5%B9%B3.txt"),
    ]


@pytest.mark.parametrize("n", [1, 5, 500])
def test_top_hits_equal_ranked_hits(spark, n):
    titles = ["書 red", "red", "red", "red hat", "RED", "blue"] * 9
    catalog, asked = frames(spark, titles, ["red", "書 red hat", "none"])
    want = defaultdict(list)
    for i, q in enumerate(["red", "書 red hat", "none"]):
        hits = [(0 if "書" in q and "書" in t else 1, t, f"s{k % 3}", f"{k:04d}") for k, t in enumerate(titles) if brute_pairs([t], [q])]
        want[i] = [h[1:] for h in sorted(hits)][:n]
    got = defaultdict(list)
    for r in cat.search_top(catalog, asked, n).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["title"], r["source"], r["id"]))
    assert got == {k: v for k, v in want.items() if v}
    flat = cat.limit_hits(cat.search_titles(catalog, asked), n).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"]) for r in flat] == [(q, h[2]) for q in sorted(got) for h in got[q]]


def test_hints(spark):
    q = [(1, "傲慢", 0, 0), (2, "傲慢", 0, 0), (3, "傲慢", 5, 2), (4, "傲慢", 0, 0), (5, "pride", 0, 0), (6, "傲慢", 0, 0)]
    summary = spark.createDataFrame(q, "query_id int, query string, hits int, foreign_hits int")
    outcomes = spark.createDataFrame(
        [(i, "gutenberg", i != 4) for i in range(1, 7)] + [(4, "ctext", True)], "query_id int, source string, ok boolean"
    )
    translated = spark.createDataFrame([(2, "Pride", "mt"), (6, "Pride and Prejudice", "dict")], "query_id int, to string, via string")
    got = rows(cat.search_hint(summary, outcomes, translated).orderBy("query_id"), "hint_kind", "hint")
    assert [g[0] for g in got] == ["plain", "mt", "none", "none", "none", "dict"]
    assert "Pride" in got[1][1] and "Pride and Prejudice" in got[5][1] and got[2][1] == ""
    alone = rows(cat.search_hint(summary, outcomes).orderBy("query_id"), "hint_kind")
    assert [a[0] for a in alone] == ["plain", "plain", "none", "none", "none", "plain"]


def test_envelope(spark):
    catalog, asked = frames(spark, ["red", "red", "blue"], ["red", "none"])
    summary = cat.search_summary(catalog, asked).withColumn("hint", F.lit("h"))
    errors = spark.createDataFrame([(0, "s9", "down"), (0, "s1", "slow")], "query_id int, source string, message string")
    got = {r[0]: json.loads(r[1]) for r in cat.to_envelope(summary, cat.search_top(catalog, asked, 1), errors).collect()}
    assert got[0] == {
        "query": "red", "count": 2, "errors": {"s1": "slow", "s9": "down"}, "hint": "h",
        "results": [{"source": "s0", "id": "0000", "title": "red"}],
    }
    assert got[1]["count"] == 0 and got[1]["results"] == [] and got[1]["errors"] == {}


def test_translation_of_queries(spark):
    titles = spark.createDataFrame([("傲慢与偏见", "Pride and Prejudice")], "zh string, en string")
    queries = spark.createDataFrame(
        [(1, "傲慢与偏见", "gutenberg"), (1, "傲慢与偏见", "ctext"), (2, "表外", "libgen"), (3, "plain", "libgen")],
        "query_id int, query string, source string",
    )
    got = rows(cat.translate_queries(queries, titles).orderBy("query_id", "source"), "source", "asked", "via")
    assert got == [("ctext", "傲慢与偏见", None), ("gutenberg", "Pride and Prejudice", "dict"), ("libgen", "表外", None), ("libgen", "plain", None)]


def test_sources(spark):
    assert rows(cat.sources_table(spark).orderBy("source_pos"), "source")[0] == ("biquge",)
    hits = spark.createDataFrame([("ctext", 1), ("biquge", 2), ("new", 3)], "source string, n int")
    groups = cat.source_groups_table(spark)
    assert rows(cat.route_sources(hits, groups, "中文古籍"), "n") == [(1,)]
    assert cat.route_sources(hits, groups, None).count() == 3
    assert sorted(rows(cat.with_labels(hits, cat.sources_table(spark)), "label")) == [("new",), ("中文古籍",), ("网络小说",)]
    requested = spark.createDataFrame([(1, "ctext"), (1, "biquge"), (1, "nope"), (1, "libgen")], "query_id int, source string")
    outcomes = spark.createDataFrame(
        [(1, "ctext", True, None, None, None), (1, "libgen", False, "other", "KeyError", "x")],
        "query_id int, source string, ok boolean, kind string, name string, detail string",
    )
    got = rows(cat.source_errors(requested, cat.sources_table(spark), outcomes).orderBy("source"), "source", "message")
    assert got == [("biquge", cat.NO_RESPONSE), ("libgen", "KeyError: x"), ("nope", cat.UNKNOWN_SOURCE)]


@pytest.mark.parametrize(
    "source, id_, ok",
    [
        ("libgen", "d41d8cd98f00b204e9800998ecf8427e", True), ("libgen", "short", False), ("libgen", "Z" * 32, False),
        ("ctext", "12", True), ("ctext", "1x", False), ("ctext", "", False), ("github", "o/r:p.txt", True), ("github", "o/r:", False),
        ("github", ":p", False), ("other", "anything", True),
    ],
)
def test_ids(spark, source, id_, ok):
    df = spark.createDataFrame([(source, id_)], "source string, id string")
    row = cat.validate_ids(df).first()
    assert row["ok"] is ok and (row["reason"] is None) is ok


def brute_names(imports, existing):
    """Names asked for go to their first import; the others take the next free number."""
    taken, out, wanted = set(existing), {}, {n for _, _, n in imports}
    for source, id_, name in imports:
        stem, dot, ext = name.rpartition(".")
        k, cand = 0, name
        while cand in taken or (k and cand in wanted):
            k += 1
            cand = f"{stem}({k}).{ext}"
        taken.add(cand)
        out[(source, id_)] = cand
    return out


def test_names(spark):
    rng = random.Random(5)
    names = ["a.txt", "a(1).txt", "a(3).txt", "b.epub", "a(1)(1).txt"]
    imports = [("s", str(i), rng.choice(names[:1] * 6 + names)) for i in range(120)]
    existing = ["a.txt", "a(2).txt", "a(7).txt", "b(1).txt", "b(2).epub", "a(1)(2).txt"]
    df = spark.createDataFrame(imports, "source string, id string, name string")
    keys = {(r["source"], r["id"]): r["k"] for r in df.select("source", "id", full_key("source", "id").alias("k")).collect()}
    got = {(r["source"], r["id"]): r["file_name"] for r in cat.dedup_names(df, spark.createDataFrame([(e,) for e in existing], "name string")).collect()}
    assert got == brute_names(sorted(imports, key=lambda i: keys[i[:2]]), existing)
    assert len(set(got.values())) == len(imports) and not set(got.values()) & set(existing)


def test_unique_titles(spark):
    catalog = spark.createDataFrame([("s", "1", "a"), ("s", "2", "a"), ("s", "3", "b"), ("t", "4", "a")], "source string, id string, title string")
    wanted = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "c"), ("t", "a")], "source string, title string")
    got = rows(cat.resolve_unique(wanted, catalog).orderBy("source", "title"), "id", "status")
    assert got == [(None, "ambiguous"), ("3", "ok"), (None, "missing"), ("4", "ok")]
    assert sorted(rows(cat.editions(catalog), "editions", "ambiguous")) == [(1, False), (1, False), (2, True)]


def test_json_answers(spark):
    body = json.dumps({"query": {"search": [{"title": "吶喊 x", "snippet": "<b>a</b>&quot; " + "y" * 200, "pageid": 7}, {"title": ""}]}})
    df = spark.createDataFrame([(body,), ("not json",)], "body string")
    got = rows(readers.parse_search_json(df, "body", "zh.wikisource.org", "wikisource"), "id", "url", "subtitle", "extra")
    assert got[0][:2] == ("吶喊 x", "https://zh.wikisource.org/wiki/%E5%90%B6%E5%96%8A_x") and len(got) == 1
    assert got[0][2].startswith('a" yy') and len(got[0][2]) == 120 and got[0][3] == {"lang": "zh", "pageid": "7"}
    body = json.dumps([{"md5": "m", "title": "t", "author": "a", "year": "", "filesize": "2500000", "extension": "pdf"}, {"title": "x"}, {"md5": "n"}])
    got = rows(readers.parse_record_json(spark.createDataFrame([(body,)], "body string"), "body", "h"), "id", "title", "subtitle", "format_hint")
    assert got == [("m", "t", "a / 2.5MB", "pdf"), ("n", "untitled", "", "bin")]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "渊海子平.txt").write_bytes("渊海子平".encode("gb18030"))
    (tmp_path / "b.txt").write_text("plain")
    (tmp_path / "c.epub").write_bytes(b"x" * 3000)
    (tmp_path / "d.txt.part").write_text("x")
    (tmp_path / ".hidden.txt").write_text("x")
    (tmp_path / "e.pdf").write_text("x")
    got = rows(readers.read_text_books(spark, str(tmp_path)).orderBy("title"), "title", "content")
    assert got == [("b", "plain"), ("渊海子平", "渊海子平")]
    scan = readers.scan_library(spark, str(tmp_path))
    assert sorted(r[0] for r in rows(scan, "rel")) == ["b.txt", "c.epub", "d.txt.part", "sub/渊海子平.txt"]
    tree = {"tree": [{"path": "a/b.txt", "type": "blob", "size": 3}, {"path": "a", "type": "tree"}], "truncated": False}
    (tmp_path / "tree.json").write_text(json.dumps(tree))
    assert rows(readers.read_tree_listing(spark, str(tmp_path / "tree.json")), "path", "size") == [("a/b.txt", 3)]

from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quire.functions.script import ScriptTable
from quire.operators import ordering, render, script, segment
from quire.sources import readers


def books(spark, *texts):
    return spark.createDataFrame([(i, f"t{i}", t) for i, t in enumerate(texts)], "id int, title string, content string")


@pytest.mark.parametrize(
    "text, titles",
    [
        ("淵海子平\n基礎\n五干屬陽，喜合。\n《論天干》\n甲木參天。\n《論地支》\n子丑合土。", ["論天干", "論地支"]),
        ("卷之一 天干\n正文一\n卷二\n正文二\n第3章\n正文三", ["卷二", "第3章"]),
        ("導言一句。\n一、天道\n正文\n二、天干\n正文\n三、地支\n正文", ["一、天道", "二、天干", "三、地支"]),
        ("CHAPTER I\na\nCHAPTER II\nb\niii\nChapter 12\nc\nCHAP. IV\nd", ["CHAPTER I", "CHAPTER II", "Chapter 12", "CHAP. IV"]),
        ("序\n正文\n　跋　\n正文", ["序", "跋"]),
        ("《論五行》各有所喜所害例\n第二十三章節錄\n二、寅中火土長生，得際遇，經營發財。\nCHAPTER I was a busy time for Alice.", []),
        ("", []),
    ],
)
def test_headings(spark, text, titles):
    got = segment.split_headings(books(spark, text)).orderBy("chapter_idx").collect()
    assert [r["title"] for r in got] == titles
    if titles:
        assert "\n".join(r["text"] for r in got) == text
    whole = segment.ensure_chapters(books(spark, text)).orderBy("chapter_idx").collect()
    assert "\n".join(r["text"] for r in whole) == text
    assert all(r["from_headings"] == bool(titles) for r in whole)


@pytest.mark.parametrize("partitions", [1, 7])
def test_split_is_lossless_on_documents(spark, sf_dir, partitions):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(partitions)
    rule = lambda line: F.when(F.length(segment.strip(line)).between(1, 24), segment.strip(line))
    cut = segment.with_heading_chapters(docs.select("doc_id", "text"), "text", rule)
    joined = F.array_join(F.transform("heading_chapters", lambda c: c["text"]), "\n")
    assert cut.filter(F.col("heading_chapters").isNotNull() & (joined != F.col("text"))).count() == 0
    assert cut.filter(F.col("heading_chapters").isNotNull()).count() > 0


def test_split_rendered(spark):
    text = "lead is dropped\n=== 卷一 ===\n正文一。\n\n=== 卷二 ===\n正文二。\n"
    got = rows(segment.split_rendered(books(spark, text)).orderBy("chapter_idx"), "title", "text")
    assert got == [("卷一", "正文一。"), ("卷二", "正文二。")]
    assert segment.split_rendered(books(spark, "=== x\n======\nplain")).count() == 0


def chapters(spark, *cs):
    return spark.createDataFrame([(b, i, t, x) for b, i, t, x in cs], "id int, chapter_idx int, title string, text string")


@pytest.mark.parametrize("part_bytes", [1, 45, 60, 1 << 20])
def test_render_parts_join_to_the_same_text(spark, part_bytes, monkeypatch):
    monkeypatch.setattr(ordering.number_chunk, "__defaults__", (3,))  # the book lies in two chunks
    cs = [(1, i, f"c{i}" if i != 1 else "", f"text {i}") for i in range(5)] + [(2, 0, "only", "as it is\n")]
    out = render.render_txt(chapters(spark, *cs), ["id"], part_bytes=part_bytes).orderBy("id", "part").collect()
    assert [r["first_chapter"] for r in out if r["id"] == 1][0] == 1 and len({(r["id"], r["part"]) for r in out}) == len(out)
    assert all(len(r["content"].encode()) <= part_bytes or r["content"].count("===") <= 2 for r in out)
    book = "".join(r["content"] for r in out if r["id"] == 1)
    want = "\n\n".join(f"=== {t or f'第{i + 1}部分'} ===\n{x}" for _, i, t, x in cs[:5]) + "\n"
    assert book == want
    assert [r["content"] for r in out if r["id"] == 2] == ["as it is\n"]
    merged = render.merge_chapters(chapters(spark, *cs[:5]), ["id"], "\n\n", part_bytes=part_bytes).orderBy("part").collect()
    assert "".join(r["content"] for r in merged) == "\n\n".join(x for *_, x in cs[:5])
    closed = render.merge_chapters(chapters(spark, *cs[:5]), ["id"], "\n", True, part_bytes=part_bytes).orderBy("part").collect()
    assert "".join(r["content"] for r in closed) == "\n".join(x for *_, x in cs[:5]) + "\n"


def test_render_single_chapter_uses_the_content(spark):
    one = chapters(spark, (1, 0, "t", "body"))
    content = spark.createDataFrame([(1, "whole content\n")], "id int, content string")
    assert render.render_txt(one, ["id"], content).first()["content"] == "whole content\n"


def test_write_txt(spark, tmp_path):
    out = render.render_txt(chapters(spark, (1, 0, "a", "x"), (1, 1, "b", "y")), ["id"]).withColumn("file_name", F.lit("book.txt"))
    render.write_txt(out, str(tmp_path / "out"))
    names = lambda: sorted(f.name for f in (tmp_path / "out").rglob("*") if f.is_file())
    assert names() == ["book.txt"] and (tmp_path / "out" / "book.txt").read_text() == "=== a ===\nx\n\n=== b ===\ny\n"
    more = chapters(spark, *[(i, 0, "t", f"é {i}") for i in range(20)], *[(99, i, "t", "x" * 50) for i in range(30)])
    out = render.render_txt(more, ["id"], part_bytes=200).withColumn("file_name", F.concat(F.col("id").cast("string"), F.lit(".txt")))
    assert out.filter("id = 99").count() > 5
    render.write_txt(out, str(tmp_path / "out"))
    assert len(names()) == 22 and (tmp_path / "out" / "7.txt").read_text() == "é 7"
    assert (tmp_path / "out" / "99.txt").read_text() == "\n\n".join(["=== t ===\n" + "x" * 50] * 30) + "\n"
    # one task that fails: no file of the table appears
    broken = out.withColumn("file_name", F.when(F.col("id") == 3, "a/b").otherwise(F.concat(F.lit("new"), F.col("file_name"))))
    with pytest.raises(Exception, match="no file name"):
        render.write_txt(broken, str(tmp_path / "out"))
    assert len(names()) == 22


def test_rendering_shuffles_texts_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = render.render_txt(chapters(spark, (1, 0, "a", "x"), (1, 1, "b", "y")), ["id"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [line for line in plan.split("\n") if "Exchange" in line]
    below = [plan.split("\n")[i + 1 :] for i, line in enumerate(plan.split("\n")) if "Exchange" in line]
    assert len(exchanges) == 4  # the texts, and three of narrow rows
    assert sum("text#" in "".join(lines[:2]) for lines in below) == 1


def test_strip_dup_heading(spark):
    got = rows(
        segment.strip_dup_heading(
            chapters(spark, (1, 0, "t", "lead\n t \nbody\nt"), (1, 1, "t", "t"), (1, 2, "t", "《t》\nbody"), (1, 3, "t", ""))
        ).orderBy("chapter_idx"),
        "text",
    )
    assert got == [("lead\nbody\nt",), ("t",), ("《t》\nbody",), ("",)]


def test_paragraphs(spark):
    c = chapters(spark, (1, 0, "Low Tide", "Low Tide\n\nBoats lay dry.\nGulls walked between them; nobody hurried.\nA bell rang.\n\nThen the water came.\n"))
    got = rows(segment.paragraphs(c).orderBy("para_idx"), "para")
    assert got == [("Boats lay dry.",), ("Gulls walked between them; nobody hurried.",), ("A bell rang.",), ("Then the water came.",)]
    c = chapters(spark, (1, 0, "題", "《題》\n一段\n　續行\n\n\n二段"))
    assert rows(segment.paragraphs(c).orderBy("para_idx"), "para") == [("一段\n　續行",), ("二段",)]


def test_boilerplate(spark):
    text = "Header\r\n*** START OF THE PROJECT GUTENBERG EBOOK ALICE ***\r\n\r\nBody one.\r\n*** start of day\r\n*** END OF THIS PROJECT GUTENBERG EBOOK ALICE ***\r\nlicense"
    cases = [text, "a page that says nothing of rights\n", "x\n*** START OF THE PROJECT GUTENBERG EBOOK A ***\nno end", "*** START OF THE PROJECT GUTENBERG EBOOK A ***\n*** END OF THE PROJECT GUTENBERG EBOOK"]
    got = rows(segment.strip_boilerplate(books(spark, *cases)).orderBy("id"), "content", "reason")
    assert got == [
        ("Body one.\n*** start of day", None),
        ("a page that says nothing of rights", None),
        ("no end", None),
        ("", "no text after strip"),
    ]


def test_xhtml(spark):
    c = chapters(spark, (1, 0, "論天干", "《論天干》\n5 < 6 && 7 > 3\n\n論天干\x01\nend"), (1, 1, "", "x"))
    got = [r[0] for r in render.render_xhtml(c.withColumn("ordinal", F.col("chapter_idx") + 1)).orderBy("chapter_idx").select("xhtml").collect()]
    assert "<h1>論天干</h1>\n<p>5 &lt; 6 &amp;&amp; 7 &gt; 3</p>\n<p>end</p>\n</body>" in got[0]
    assert "<title>第2章</title>" in got[1]
    import xml.dom.minidom

    for document in got:
        xml.dom.minidom.parseString(document.replace("<!DOCTYPE html>\n", ""))


def test_manifest(spark):
    cs = [(1, i, f"c{i}", "" if i % 2 else "x") for i in range(6)] + [(2, 3, "", " "), (2, 5, "b", "")]
    got = rows(render.book_manifest(chapters(spark, *cs), ["id"]).orderBy("id", "play_order"))
    assert got == [
        (1, 0, 1, "chap1", "chap_0001.xhtml", "c0"),
        (1, 2, 2, "chap2", "chap_0002.xhtml", "c2"),
        (1, 4, 3, "chap3", "chap_0003.xhtml", "c4"),
        (2, 3, 1, "chap1", "chap_0001.xhtml", "第1章"),
    ]


def test_lean(spark):
    df = spark.createDataFrame(
        [("s", "1", "body", [("一", "x"), ("二", "y")], None), ("s", "2", "body", [], None)],
        "source string, id string, content string, chapters array<struct<title:string,text:string>>, raw binary",
    )
    out = render.lean(df)
    assert out.columns == ["source", "id", "chapters"]
    assert rows(out.orderBy("id"), "chapters") == [(["一", "二"],), (None,)]


TABLE = dict(
    t2s_chars=dict(zip("淵幹爲陽淨乾後漢書見謂之", "渊干为阳净干后汉书见谓之")),
    s2t_chars=dict(zip("渊为阳净后汉书谓", "淵爲陽淨後漢書謂")),
    t2s_phrases={"頭髮": "头发", "乾杯": "干杯"},
)


@pytest.mark.parametrize(
    "text, want",
    [
        ("淵海子平", "渊海子平"), ("乾下乾上", "乾下乾上"), ("乾乾淨淨", "干干净净"), ("乾杯", "干杯"),
        ("天干地支", "天干地支"), ("夫乾，健也", "夫乾，健也"), ("《乾》", "《乾》"), ("頭髮", "头发"), ("plain", "plain"),
    ],
)
def test_simplified(spark, text, want):
    df = spark.createDataFrame([(text,)], "c string").select(ScriptTable(**TABLE).simplified("c"))
    assert df.first()[0] == want


def test_overlapping_phrases_take_the_leftmost_longest(spark):
    table = ScriptTable({"c": "C"}, {}, {"ab": "1", "bcd": "2", "abc": "3"})
    df = spark.createDataFrame([("abcd bcd abd c",), (None,)], "c string").select(table.simplified("c").alias("t"))
    assert rows(df) == [("3d 2 1d C",), (None,)]


@pytest.mark.parametrize("phrases", [{}, {"乾杯": "干杯!"}])
def test_private_use_characters_stay(spark, phrases):
    own = "\ue000乾\ue001坤 \ue0ff\ue000 乾坤\ue0ff乾\ue0fe \U000f0000淵"
    df = spark.createDataFrame([(own,)], "c string").select(ScriptTable({"乾": "干", "淵": "渊"}, {}, phrases).simplified("c"))
    assert df.first()[0] == "\ue000干\ue001坤 \ue0ff\ue000 乾坤\ue0ff干\ue0fe \U000f0000渊"


def test_load_checks_the_size(spark):
    conv = spark.createDataFrame([("t2s_char", "淵", "渊"), ("s2t_char", "渊", "淵")], "kind string, from string, to string")
    assert spark.createDataFrame([("淵",)], "c string").select(ScriptTable.load(conv).simplified("c")).first()[0] == "渊"
    with pytest.raises(ValueError):
        ScriptTable.load(conv, limit=1)


def test_script_vote_and_conversion(spark):
    cs = chapters(
        spark,
        (1, 0, "後", "漢水之陽，淨淵見月。"), (1, 1, "漢", "漢"),
        (2, 0, "乾", "阳春为书，谓后净渊。"),
        (3, 0, "x", " "), (3, 1, "y", ""), (3, 2, "z", "漢書"),
    )
    table = ScriptTable(**TABLE)
    base = script.detect_script(cs, table, ["id"])
    assert rows(base.orderBy("id"), "id", "base") == [(1, "trad"), (2, "simp"), (3, None)]
    away = rows(script.convert_away(cs, base, table, ["id"]).orderBy("id", "chapter_idx"), "title", "text")
    assert away[0] == ("后", "汉水之阳，净渊见月。")
    assert away[2][1] == "陽春爲書，謂後淨淵。"
    rendered = render.render_txt(cs.filter("id = 1"), ["id"], convert=table).first()["content"]
    assert rendered == "=== 后 ===\n汉水之阳，净渊见月。\n\n=== 汉 ===\n汉\n"


def test_package_spine(spark):
    page = "<html><body><p>{}</p></body></html>"
    opf = """<package><metadata id="m"/><manifest>
      <item id="two" href="t/b.xhtml"/><item
        href="a.xhtml" media-type="x" id="one"/><opf:item id="two" href="b.xhtml"/><item id="css" href="s.css"/></manifest>
      <spine toc="ncx"><itemref linear="no" idref="two"/><itemref idref="gone"/><itemref idref="c.html"/><itemref idref="one"/></spine></package>"""
    members = [("p", f"x/{n}", i, page.format(n)) for i, n in enumerate(("a.xhtml", "b.xhtml", "left.xhtml"))]
    members += [("p", "c.html", 3, page.format("c")), ("p", "x/p.opf", 4, opf), ("p", "later.opf", 5, "<itemref idref='x/a.xhtml'/>")]
    members += [("root", "p.opf", 0, opf), ("root", "a.xhtml", 1, page.format("A")), ("root", "b.xhtml", 2, page.format("B"))]
    members += [("bad", "p.opf", 0, "<package <item <itemref"), ("bad", "z.xhtml", 1, page.format("z")), ("bad", "y.xhtml", 2, page.format("y"))]
    df = spark.createDataFrame(members, "book string, path string, pos int, content string")
    got = sorted(rows(readers.members_to_chapters(df), "book", "chapter_idx", "text"))
    assert got == [
        ("bad", 0, "z"), ("bad", 1, "y"), ("p", 0, "b.xhtml"), ("p", 1, "c"), ("p", 2, "a.xhtml"), ("root", 0, "B"), ("root", 1, "A"),
    ]
    assert sorted(rows(readers.package_spine(df).filter("book = 'p'"), "spine_pos", "base", "href")) == [
        (0, "x", "b.xhtml"), (1, "x", "gone"), (2, "x", "c.html"), (3, "x", "a.xhtml"),
    ]


def test_members(spark):
    page = "<html><body><h1>{t}</h1>\n\n\n\n<p>{x}</p></body></html>"
    members = spark.createDataFrame(
        [
            ("b", "OEBPS/a.xhtml", 0, page.format(t="A", x="one")),
            ("b", "OEBPS/b.xhtml", 1, page.format(t="B", x="two")),
            ("b", "c.html", 2, "<p>no body\r</p>"),
            ("b", "style.css", 3, "x"),
            ("p", "z.html", 0, page.format(t="Z", x="last")),
            ("p", "empty.html", 1, "<body> </body>"),
        ],
        "book string, path string, pos int, content string",
    )
    spine = spark.createDataFrame(
        [("b", 0, "OEBPS", "b.xhtml"), ("b", 1, "OEBPS", "c.html"), ("b", 2, "OEBPS", "gone.xhtml"), ("b", 3, "OEBPS", "a.xhtml"), ("p", 0, "", "nothing.html")],
        "book string, spine_pos int, base string, href string",
    )
    got = rows(readers.members_to_chapters(members, spine).orderBy("book", "chapter_idx"))
    assert got == [
        ("b", 0, "B", "two"), ("b", 1, "c.html", "no body"), ("b", 2, "A", "one"), ("p", 0, "Z", "last"),
    ]
    plain = rows(readers.members_to_chapters(members).filter("book = 'b'").orderBy("chapter_idx"), "title")
    assert plain == [("A",), ("B",), ("c.html",)]


def test_library_changes(spark):
    schema = "rel string, length long, modificationTime timestamp"
    day = [datetime(2024, 1, d) for d in (1, 2)]
    seen = spark.createDataFrame([("a.txt", 1, day[0]), ("b.txt", 1, day[0]), ("gone.txt", 1, day[0])], schema)
    now = spark.createDataFrame([("a.txt", 1, day[0]), ("b.txt", 1, day[1]), ("c/d.epub", 3, day[0])], schema)
    assert sorted(rows(readers.library_changes(now, seen), "rel")) == [("b.txt",), ("c/d.epub",)]

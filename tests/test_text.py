import pytest
from conftest import rows
from pyspark.sql import functions as F

from quire.functions import html, text
from quire.sources import readers


def one(spark, value, fn, type_="string"):
    df = spark.createDataFrame([(value,)], f"c {type_}")
    return df.select(fn("c")).first()[0]


@pytest.mark.parametrize(
    "name, want",
    [("春江：月夜（上）?*", "春江_月夜（上）"), ("x|y<z>w", "x_y_z_w"), (" . ", "untitled"), ("", "untitled")],
)
def test_sanitize(spark, name, want):
    assert one(spark, name, text.sanitize_filename) == want


@pytest.mark.parametrize(
    "value",
    ["", "\n", "a", "a\n", "a\n\nb", "a\r\nb\rc\n", "x y\x1cz\x85", "a\n\n", "\r\n", " 　 ", "a\x0bb\x0c"],
)
def test_lines_and_strip_agree_with_python(spark, value):
    df = spark.createDataFrame([(value,)], "c string").select(
        text.split_lines("c"), text.line_count("c"), text.strip("c"), text.collapse_space("c"), text.strip_text("c"),
        text.is_blank("c"),
    )
    lines, count, stripped, collapsed, whole, blank = df.first()
    assert lines == value.splitlines()
    assert count == len(value.splitlines())
    assert stripped == whole == value.strip()
    assert blank is (not value.strip())
    assert collapsed == " ".join(value.split())


@pytest.mark.parametrize("n", [0, 1, 49_999, 50_000, 150_000, 250_000, 350_000, 450_000, 650_000, 950_000, 1_250_000, 99_950_000, 123_456_789])
def test_size_label_rounds_like_binary(spark, n):
    assert one(spark, str(n), text.size_mb) == (f"{n / 1e6:.1f}MB" if n else "")


def test_size_label_not_a_number(spark):
    assert one(spark, "12x", text.size_mb) == ""
    assert one(spark, 100, text.size_kb, "bigint") == 1
    assert one(spark, 5000, text.size_kb, "bigint") == 4


@pytest.mark.parametrize(
    "page, want",
    [
        ("<b>just a moment</b>, the page is loading", True),
        ("<h1>Please Confirm That You Are Human</h1>", True),
        ("<img src='/a/challenge-platform/b.png'>", True),
        ("<label>验证图案</label>", True),
        ("<p>plain text of a book</p>", False),
        ("", False),
        ("x" * 8192 + "just a moment", False),
    ],
)
def test_challenge(spark, page, want):
    assert one(spark, page, text.is_challenge) is want


def test_direction(spark):
    assert one(spark, " ".join(["word"] * 15), text.trans_direction) == "en2zh"
    assert one(spark, " ".join(["word"] * 14), text.trans_direction) == "zh2en"


def test_titles_and_authors(spark):
    assert one(spark, "第一章 <b>绯红</b>&amp;（1 / 1）", html.clean_title) == "第一章 绯红&"
    assert one(spark, "第一更（完）", html.clean_title) == "第一更（完）"
    assert one(spark, "（宋）徐子平", html.clean_author) == "徐子平"


@pytest.mark.parametrize(
    "value",
    [
        "&amp;lt;", "&eacute;t&eacute;", "&#20013;&#x6587;", "a & b", "&copy 1", "&quot;x&quot;", "&nbsp;y", "&notit;", "&ampx", "&amp&amp;",
        "AT&T", "?a=1&ref=x", "&#0;&#13;&#128;&#x9f;", "&#xD800;&#x110000;&#99999999999999999999;&#xFFFFFFFFFFF;", "&#xfdd0;&#65534;x",
        "&#1;&#x1F600;", "&#00065;&#x00041", "&;&&#;&#x;", "&NotEqualTilde;&fjlig;", "&notinx;&not", "&" + "a" * 40 + ";", "&am p;", "&lt&gt", "",
    ],
)
def test_unescape_agrees_with_python(spark, value):
    import html as std

    assert one(spark, value, html.unescape_html) == std.unescape(value)


def test_references_take_no_python(spark):
    import html as std

    names = [f"&{n}{x}" for n in std.entities.html5 for x in ("", "x")]
    df = spark.createDataFrame([(n,) for n in names], "c string").select("c", html.unescape_html("c").alias("t"))
    assert all(r.t == std.unescape(r.c) for r in df.collect())
    assert "EvalPython" not in df._jdf.queryExecution().toString()


def test_url_parts(spark):
    from urllib.parse import quote, unquote

    for value in ("吶喊/自序 a+b~c*", "100%"):
        assert one(spark, value, text.encode_title) == quote(value, safe="")
    assert one(spark, "a+b_%E5%90%B6", text.decode_title) == unquote("a+b_%E5%90%B6").replace("_", " ")
    assert one(spark, "https://h:8080/wiki.pl?if=gb&res=12", lambda c: text.url_param(c, "res")) == "12"
    assert one(spark, "https://h:8080/wiki.pl?if=gb", text.url_host) == "h:8080"
    assert one(spark, "国学/八字/渊海子平.TXT", text.file_title) == "渊海子平"
    assert one(spark, "国学/八字/渊海子平.TXT", text.folder) == "国学/八字"
    assert one(spark, "a.txt", text.folder) == ""


def test_progress(spark):
    df = spark.createDataFrame([(0, 0, 10), (9, 1000, 10), (4, 500, 10), (3, 0, 1), (0, 45, 3)], "ch int, pct int, n int")
    got = [r[0] for r in df.select(text.progress_pct("ch", "pct", "n")).collect()]
    assert got == [1, 100, 45, None, 2]
    assert one(spark, "a.txt.part", text.progress_key) == "a.txt"


@pytest.mark.parametrize("charset", ["utf-8", "gb18030", "big5"])
def test_decode(spark, charset):
    book = "渊海子平五行" if charset != "big5" else "鬚龘"
    raw = book.encode(charset)
    expected = raw.decode("gb18030") if charset == "big5" and _decodes(raw, "gb18030") else book
    df = spark.createDataFrame([(bytearray(raw),)], "c binary").select(readers.decode_text("c").alias("t"))
    assert rows(df) == [(expected,)]


def _decodes(raw, charset):
    try:
        raw.decode(charset)
        return True
    except UnicodeDecodeError:
        return False


def test_decode_broken_bytes(spark):
    raw = b"ok \xff\xff"
    df = spark.createDataFrame([(bytearray(raw),), (None,)], "c binary").select(readers.decode_text("c").alias("t"))
    assert rows(df) == [(raw.decode("utf-8", errors="replace"),), (None,)]


def test_xml(spark):
    df = spark.createDataFrame([("a\x01\x0c<b>&\n",)], "c string").select(text.xml_escape(text.xml_clean(F.col("c"))))
    assert df.first()[0] == "a&lt;b&gt;&amp;\n"

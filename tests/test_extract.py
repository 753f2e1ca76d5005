"""Pages of an invented garden-seed catalogue and its almanac, cut by patterns of their own."""

import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quire.functions.html import strip_tags
from quire.operators import extract as ex
from quire.operators.segment import with_heading_chapters
from quire.plans.queries import q_page_sections, q_page_subsections


def pages(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page_id int, html string")


SEED = r"(?s)<section\s+data-seed>(.*?)</section>"
SEED_FIELDS = {
    "sku": ex.Field(r'data-sku="([A-Z]+-[0-9]+)"', "raw"),
    "title": ex.Field(r"(?s)<h4>(.*?)</h4>"),
    "author": ex.Field(r"(?s)<dd>(.*?)</dd>", "author"),
    "intro": ex.Field(r"(?s)<blockquote>(.*?)</blockquote>", "intro", 30),
    "season": ex.Field(r"(?s)<kbd>(.*?)</kbd>"),
}


def test_cards_take_their_fields_and_skip_those_without_a_key(spark):
    html = (
        '<section data-seed><i data-sku="PEA-12"></i><h4>Green &amp; <u>sweet</u> pea（ 3 / 9 ）</h4><dd>（old）Gr&ouml;ner</dd>'
        "<blockquote>climbs\n\n  high and wide across the trellis</blockquote></section>"
        "<section data-seed><h4>unlabelled bag</h4></section>"
        '<section data-seed><i data-sku="FIG-3"></i><kbd> autumn </kbd></section>'
    )
    got = ex.extract_cards(pages(spark, html), SEED, SEED_FIELDS, "sku").orderBy("card_idx")
    assert rows(got, "card_idx", "sku", "title", "author", "intro", "season") == [
        (0, "PEA-12", "Green & sweet pea", "Gröner", "climbs high and wide across th", ""),
        (2, "FIG-3", "", "", "", "autumn"),
    ]


def test_a_note_is_the_rest_of_the_card(spark):
    html = '<p class=row><q data-n="41"></q><strong>（new）Ida Moor</strong> sown <em>in</em>\n March</p>'
    mark = "<strong>"
    fields = {
        "n": ex.Field(r'data-n="(\d+)"', "raw"),
        "author": ex.Field(rf"(?s){mark}(.*?)</strong>", "author"),
        "note": ex.Field(rf"(?s){mark}.*?</strong>(.*)\z", "text"),
    }
    got = ex.extract_cards(pages(spark, html), r"(?s)<p class=row>(.*?)</p>", fields, "n")
    assert rows(got, "n", "author", "note") == [("41", "Ida Moor", "sown in March")]


def test_links_keep_their_order_and_belong_to_one_bed(spark):
    html = (
        '<a rel=bed href="bed-a/r3">Row three（2 / 2）</a><a rel=bed href="bed-b/r9">elsewhere</a>'
        '<a rel=bed href="bed-a/r1"><i> Row &eacute;toile </i></a><a rel=bed href="bed-a/r3">Row three</a><a rel=bed href="bed-a/r2">  </a>'
    )
    beds = pages(spark, html, "<p>fallow</p>").withColumn("bed", F.lit('href="bed-a/'))
    got = ex.extract_links(beds, r'(?s)<a rel=bed href="bed-\w/(r\d)">(.*?)</a>', own=F.col("bed"))
    assert rows(got.orderBy("link_idx"), "link_idx", "target", "label") == [(0, "r3", "Row three"), (1, "r1", "Row étoile")]


def almanac(heading, *names):
    items = "".join(f'<li><a title=t href="/wiki/{n}">{i}. month</a>' for i, n in enumerate(names))
    return f'<a href="/wiki/Cover">cover</a>{heading}<ul>{items}<li><a href="#top">up</a></ul><h2>Notes</h2><a href="/wiki/Back">b</a>'


@pytest.mark.parametrize("heading", ["<h2>目录</h2>", "<h2 id=c><b>總</b>目錄</h2>", "<h2>Preface<h2>目 目錄</h2>", '<h2 data-x="目">本書目录</h2>'])
def test_contents_region(spark, heading):
    html = almanac(heading, "May_frost", "Caf%C3%A9_rain+sun", "May_frost")
    got = ex.extract_region_links(pages(spark, html, "<h2>Index</h2><p>目录</p>"))
    assert rows(got.orderBy("link_idx"), "page_id", "title") == [(0, "May frost"), (0, "Café rain+sun")]


def test_an_open_heading_of_a_megabyte_is_survived(spark):
    long = "<h2>" + "petal <i>x</i> 目 " * 60_000
    many = "<h2>leaf " * 20_000
    start = time.time()
    got = ex.extract_region_links(pages(spark, long, many, long + almanac("<h2>目录</h2>", "June")))
    assert rows(got, "page_id", "title") == [(2, "June")]
    assert time.time() - start < 60


def test_main_text_of_a_container(spark):
    html = (
        "<h1>Moss（4 / 7）</h1><main data-leaf><p>soft &amp; green</p>\r\n<p>　deep&nbsp;shade<br/> slow &lt;<BR></p>"
        "<!-- <p>cut</p> --><script>let p='</p>'</script></main>"
    )
    out = ex.extract_main_text(pages(spark, html, "<h1>Bare</h1><p>no leaf</p>"), r"(?s)<main data-leaf>(.*?)</main>")
    assert rows(out.orderBy("page_id"), "title", "text") == [("Moss", "soft & green\ndeep\xa0shade\nslow <"), ("", "")]
    assert rows(ex.drop_shells(out), "page_id") == [(0,)]
    assert rows(ex.shell_counts(out.withColumn("g", F.lit("plot")), ["g"])) == [("plot", 1, 1)]


def test_cells_become_lines(spark):
    cell = '<th class="plot"{}>{}</th>'
    html = cell.format(' style="width: 60px;"', "1") + cell.format("", "《春耕》") + cell.format("", "turn<b> the</b>\n soil &copy;") + cell.format("", " ")
    cells = ex.extract_cells(pages(spark, html, "<i></i>"), tag="th", css="plot")
    assert rows(cells.orderBy("page_id"), "lines") == [(["《春耕》", "turn the soil ©"],), ([],)]
    cut = with_heading_chapters(cells, lines=F.col("lines")).orderBy("page_id")
    assert cut.first()["heading_chapters"][0]["title"] == "春耕"


PLOTS = (
    "<p>gate</p><h3>North bed<em></em></h3><p>kale&nbsp;<br>leek</p>"
    '<aside class="side noprint"><p>advert</p></aside><h2>目录</h2><ul><li>skip</li></ul><h4>South bed</h4><li>chard</li><p>beet</p>'
)


def test_sections_are_the_same_on_both_paths(spark):
    want = [("", "gate"), ("North bed", "kale\xa0\nleek"), ("South bed", "chard\nbeet")]
    deep = PLOTS.replace("<p>advert</p>", "<aside>in</aside><p>advert</p>")
    single = PLOTS.replace('"side noprint"', "'side noprint'")
    got = ex.html_chapters(pages(spark, PLOTS, deep, single, "<p> </p>")).orderBy("page_id", "chapter_idx").collect()
    for page in (0, 1, 2):
        assert [(r["title"], r["text"]) for r in got if r["page_id"] == page] == want
    assert all(r["page_id"] < 3 for r in got)


def test_marks_inside_a_heading_do_not_count(spark):
    html = '<h3>Orchard<small class="mw-editsection">(change)</small></h3><li>pear</li>'
    nested = html + '<table class="navbox"><tr><table></table></tr></table>'
    got = ex.html_chapters(pages(spark, html, nested)).orderBy("page_id")
    assert rows(got, "title", "text") == [("Orchard", "pear")] * 2


def test_names_of_sections(spark):
    data = [("bed", [("", "a")]), ("row", [("", "a"), ("end", "b")]), ("plot", [("gate", "a")])]
    df = spark.createDataFrame(data, "page string, s array<struct<title:string,text:string>>")
    named = df.select("page", F.transform(ex.prefix_sections("s", "page"), lambda c: c["title"]))
    assert rows(named) == [("bed", ["bed"]), ("row", ["row", "row·end"]), ("plot", ["gate"])]


def test_a_web_page_served_for_a_file(spark):
    heads = {b"\t\n<!docType html><p>": True, b" <hTmL lang=x>": True, b"PK\x03 via CloudFlare": True, b"PK\x03\x04": False,
             b"." * 512 + b"cloudflare": False, b"": False}
    df = spark.createDataFrame([(i, bytearray(h)) for i, h in enumerate(heads)], "id int, content binary")
    assert [g[0] for g in rows(ex.reject_page_bytes(df).orderBy("id"), "is_page")] == list(heads.values())


def test_blocks_without_text_are_dropped(spark):
    df = spark.createDataFrame([("<div>fern<style>p{a:'<b>'}</style>\n\tmoss</div><!-- ivy -->&hellip;",)], "c string")
    assert df.select(strip_tags("c", ("comment", "script", "style"))).first()[0] == "fern moss…"


def test_rules_of_a_table(spark):
    pages = spark.createDataFrame(
        [("a", "<li>1|one &amp; <b>two</b></li><li>|none</li><li>22|x</li>"), ("b", "<p>z=7</p><p>y=8 （1/2）</p>"), ("c", "<li>5|no rules</li>"), ("a", None)],
        "host string, html string",
    )
    rules = spark.createDataFrame(
        [
            ("a", "<li>(.*?)</li>", "key", r"(\d*)\|", None, None, True), ("a", "<li>(.*?)</li>", "text", r"\|(.*)", "text", 5, False),
            ("b", "<p>(.*?)</p>", "key", "(.)=", "raw", None, True), ("b", "<p>(.*?)</p>", "n", "=(.*)", "title", None, None),
            ("unasked", "x", "key", "(x)", None, None, True),
        ],
        ex.RULES,
    )
    got = ex.extract_by_rules(pages, rules).orderBy("host", "card_idx")
    assert got.columns == ["host", "card_idx", "id", "fields"]
    assert rows(got) == [
        ("a", 0, "1", {"text": "one &"}), ("a", 2, "22", {"text": "x"}), ("b", 0, "z", {"n": "7"}), ("b", 1, "y", {"n": "8"}),
    ]
    assert ex.extract_by_rules(pages, rules.limit(0)).count() == 0


def test_pages_of_one_file_are_cut_by_all_cores(spark, sf_dir):
    for query, key in ((q_page_subsections, "p_partkey"), (q_page_sections, "page_id")):
        at = query(spark, sf_dir).select(key, F.spark_partition_id().alias("task")).distinct()
        assert at.select("task").distinct().count() >= spark.sparkContext.defaultParallelism

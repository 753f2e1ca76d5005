"""Scans of files that already exist. Nothing here goes to a network."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schemas
from quire.functions.fallback import decode_legacy
from quire.functions.html import remove_tags, strip_tags
from quire.functions.rows import explode_rows
from quire.functions.text import as_col, encode_title, file_title, folder, size_mb, strip, strip_text
from quire.operators.catalog import UNDECLARED_LICENSE
from quire.operators.ordering import number_chunk, number_within

SNIPPET = 120
MEMBER_EXT = r"(?i)\.(?:xhtml|html)\z"


def decode_text(c: str | Column) -> Column:
    """Bytes to text: UTF-8 natively; only rows that are no UTF-8 reach the Arrow function."""
    data = as_col(c)
    text = data.cast("string")
    valid = F.is_valid_utf8(text)
    return F.coalesce(F.when(valid, text), decode_legacy(F.when(~valid, data)))


def read_text_books(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    )
    return files.select(F.col("path"), file_title("path").alias("title"), decode_text("content").alias("content"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PAGES).parquet(path)


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream of its files, whether its path is a folder or one file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    alone = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile()
    # a plain path is taken as the base of partition folders, which a file cannot be; a pattern is not
    pattern = f"{path[:-1]}[{path[-1]}]" if alone else path
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(pattern)


def read_tree_listing(spark: SparkSession, path: str) -> DataFrame:
    """Blob paths of stored repository listings, one listing per file."""
    listing = spark.read.schema(schemas.TREE).json(path, multiLine=True)
    return (
        listing.select(F.input_file_name().alias("listing"), F.explode("tree").alias("entry"))
        .filter(F.col("entry.type") == "blob")
        .select("listing", "entry.path", "entry.sha", "entry.size")
    )


def tree_catalog(paths: DataFrame, repos: DataFrame) -> DataFrame:
    """Catalogue rows of the text files of repositories.

    paths (repo, path); repos (repo, branch, note, license).
    """
    texts = paths.filter(F.lower("path").endswith(".txt")).withColumn("title", file_title("path"))
    license_ = F.coalesce(F.nullif("license", F.lit("")), F.lit(UNDECLARED_LICENSE))
    return texts.filter("title != ''").join(repos, "repo").select(
        F.lit("github").alias("source"),
        F.concat_ws(":", "repo", "path").alias("id"),
        "title",
        F.concat(
            F.lit("https://github.com/"), "repo", F.lit("/blob/"), "branch", F.lit("/"), encode_title("path", keep_slash=True)
        ).alias("url"),
        F.coalesce("note", F.lit("")).alias("subtitle"),
        F.lit("txt").alias("format_hint"),
        F.create_map(
            F.lit("repo"), F.col("repo"), F.lit("folder"), folder("path"), F.lit("license"), license_
        ).alias("extra"),
    )


def parse_search_json(df: DataFrame, column: str, host: str, source: str) -> DataFrame:
    """Search answers of a wiki to catalogue rows; an entry without a title is none."""
    keys = [c for c in df.columns if c != column]
    hits = (
        df.select(*keys, F.explode(F.from_json(column, schemas.WIKI_SEARCH)["query"]["search"]).alias("h"))
        .filter(F.coalesce(F.col("h.title"), F.lit("")) != "")
        .select(*keys, "h.*")
    )
    return hits.select(
        *keys,
        F.lit(source).alias("source"),
        F.col("title").alias("id"),
        "title",
        F.concat(F.lit(f"https://{host}/wiki/"), encode_title(F.replace("title", F.lit(" "), F.lit("_")))).alias("url"),
        F.substring(strip_tags(F.coalesce("snippet", F.lit(""))), 1, SNIPPET).alias("subtitle"),
        F.lit("txt").alias("format_hint"),
        F.create_map(
            F.lit("lang"), F.lit(host.split(".")[0]), F.lit("pageid"), F.col("pageid").cast("string")
        ).alias("extra"),
    )


def parse_record_json(df: DataFrame, column: str, mirror: str, source: str = "libgen") -> DataFrame:
    """Book records of a JSON array to catalogue rows; a record without an md5 is dropped."""
    keys = [c for c in df.columns if c != column]
    rows = (
        df.select(*keys, F.explode(F.from_json(column, schemas.RECORDS)).alias("r"))
        .select(*keys, "r.*")
        .filter(F.coalesce("md5", F.lit("")) != "")
    )
    said = [F.coalesce("author", F.lit("")), F.coalesce("year", F.lit("")), F.coalesce(size_mb("filesize"), F.lit(""))]
    ext = F.coalesce("extension", F.lit("bin"))
    return rows.select(
        *keys,
        F.lit(source).alias("source"),
        F.col("md5").alias("id"),
        F.coalesce("title", F.lit("untitled")).alias("title"),
        F.concat(F.lit(f"https://{mirror}/book/index.php?md5="), F.col("md5")).alias("url"),
        F.array_join(F.filter(F.array(*said), lambda x: x != ""), " / ").alias("subtitle"),
        ext.alias("format_hint"),
        F.create_map(
            F.lit("mirror"), F.lit(mirror), F.lit("extension"), ext, F.lit("md5"), F.col("md5")
        ).alias("extra"),
    )


def _attribute(element: Column, name: str) -> Column:
    """Value of an attribute of a start tag, wherever it stands in it; empty without one."""
    return F.regexp_extract(element, rf"(?s)\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1)


def _elements(xml: Column, name: str) -> Column:
    return F.regexp_extract_all(xml, F.lit(rf"<(?:[\w.-]+:)?{name}\b[^>]*>"), F.lit(0))


def package_spine(members: DataFrame) -> DataFrame:
    """(book, spine_pos, base, href): reading order as the package file of each packed book states it.

    members (book, path, pos, content), the package file among them: the first member called `.opf`. Its manifest
    names a file for each id, its spine lists ids; an id without a manifest entry counts as a file name. Start tags
    are cut with patterns, since an XML parser would end the job at the first damaged file.
    """
    package = (
        members.filter(F.col("path").endswith(".opf"))
        .groupBy("book")
        .agg(F.min_by(F.struct("path", "content"), "pos").alias("_p"))
        .select("book", F.regexp_extract("_p.path", r"\A(.*)/[^/]*\z", 1).alias("base"), F.col("_p.content").alias("xml"))
    )
    items = explode_rows(package, ["book"], _elements(F.col("xml"), "item"), "_at", "_e").select(
        "book", "_at", _attribute(F.col("_e"), "id").alias("idref"), _attribute(F.col("_e"), "href").alias("_href")
    )
    # of items with one id the last counts
    manifest = items.filter("idref != '' AND _href != ''").groupBy("book", "idref").agg(F.max_by("_href", "_at").alias("_href"))
    refs = explode_rows(package, ["book", "base"], _elements(F.col("xml"), "itemref"), "spine_pos", "_e")
    refs = refs.select("book", "spine_pos", "base", _attribute(F.col("_e"), "idref").alias("idref")).filter("idref != ''")
    return refs.join(manifest, ["book", "idref"], "left").select("book", "spine_pos", "base", F.coalesce("_href", "idref").alias("href"))


def members_to_chapters(members: DataFrame, spine: DataFrame | None = None) -> DataFrame:
    """Unpacked members of packed books to chapters.

    members (book, path, pos, content); spine (book, spine_pos, base, href), by default that of the package files
    among the members. The spine gives the order when it names at least one member of the book, else the order of the
    members stands. Order is settled on names alone; contents are joined to it once.
    """
    pages = members.filter(F.col("path").rlike(MEMBER_EXT)).select("book", "path", "pos", "content")
    names = pages.select("book", "path", "pos")
    spine = package_spine(members) if spine is None else spine
    full = F.trim(F.concat_ws("/", F.nullif("base", F.lit("")), "href"), F.lit("/"))
    # the path below the manifest's folder goes before the bare one
    tried = spine.select("book", "spine_pos", F.explode(F.array(
        F.struct(F.lit(0).alias("pref"), full.alias("path")),
        F.struct(F.lit(1).alias("pref"), F.col("href").alias("path")),
    )).alias("_c")).select("book", "spine_pos", "_c.*")
    resolved = (
        tried.join(names.select("book", "path"), ["book", "path"])
        .groupBy("book", "spine_pos")
        .agg(F.min_by("path", "pref").alias("path"))
    )
    led = resolved.select("book", F.lit(True).alias("_led")).distinct()
    places = names.join(resolved, ["book", "path"], "left").join(led, "book", "left")
    places = places.withColumn("_at", F.when(F.col("_led"), F.col("spine_pos")).otherwise(F.col("pos")))
    ordered = pages.drop("pos").join(places.filter("_at IS NOT NULL").select("book", "path", "_at"), ["book", "path"])
    body = F.regexp_extract("content", r"(?s)<body[^>]*>(.*?)</body>", 1)
    has_body = F.col("content").rlike(r"(?s)<body[^>]*>.*?</body>")
    plain = F.replace(remove_tags(F.when(has_body, body).otherwise(F.col("content"))), F.lit("\r"), F.lit(""))
    heading = r"(?s)<h[1-3][^>]*>(.*?)</h[1-3]>"
    parsed = ordered.select(
        "book",
        "_at",
        strip_text(F.regexp_replace(plain, r"\n{3,}", "\n\n")).alias("text"),
        F.when(F.col("content").rlike(heading), strip(remove_tags(F.regexp_extract("content", heading, 1))))
        .otherwise(F.col("path"))
        .alias("title"),
    ).filter("text != ''")
    led = F.startswith("text", "title")
    rest = F.ltrim(F.substring("text", F.length("title") + 1, F.length("text")), F.lit("\n"))
    chapters = parsed.withColumn("text", F.when(led, rest).otherwise(F.col("text")))
    return number_within(chapters, ["book"], ["_at"], number_chunk("_at"), "_n").select(
        "book", (F.col("_n") - 1).cast("int").alias("chapter_idx"), "title", "text"
    )


def _book_files(files: DataFrame, path: str) -> DataFrame:
    """Files that are books, with `rel`, their path below the folder."""
    name = F.substring_index("path", "/", -1)
    root = urlparse(path).path.rstrip("/") + "/"  # paths of files have a scheme, and not always as it was given
    rel = F.substring("path", F.instr("path", root) + len(root), F.length("path"))
    is_book = ~name.startswith(".") & (F.lower(name).rlike(r"\.(?:txt|epub)\z") | name.endswith(".txt.part"))
    return files.filter(is_book).withColumn("rel", rel)


def scan_library(spark: SparkSession, path: str) -> DataFrame:
    """Book files below a folder: path, size and time only, no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return _book_files(files.select("path", "length", "modificationTime"), path).select("rel", "length", "modificationTime")


def library_stream(spark: SparkSession, path: str) -> DataFrame:
    """Book files below a folder as a stream: each file once, with its content, when it is first seen.

    What has been seen is in the checkpoint of the query that reads the stream, so a second run has the new files
    alone. A file that is written again under its name counts as seen; `library_changes` finds it.

    Spark lists the new files of a batch one by one and by default with a task for each, up to 10,000, which take
    longer than the reading; the session is set to a few tasks a core instead.
    """
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(4 * spark.sparkContext.defaultParallelism))
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path)
    return _book_files(files, path).select("rel", "length", "modificationTime", "content")


def library_changes(listing: DataFrame, seen: DataFrame) -> DataFrame:
    """Files of a listing that are new or differ in size or time from what was seen (rel, length, modificationTime)."""
    keys = ["rel", "length", "modificationTime"]
    return listing.join(seen.select(*keys).distinct(), keys, "left_anti")

"""WARC archives with a two-level capture index.

Pages are range-partitioned by their reversed-host URL key. Each task writes one archive of gzip members, one index
file (its sorted capture lines, cut into compressed blocks) and a sparse directory (first key, offset and length
of each block). A lookup finds the part by the parts' first keys, binary-searches the part's directory, reads
one block, binary-searches its lines, and reads the record's byte range.

File names carry a token of the attempt, and only the parts that the manifest lists are read, so a retried or
speculative task does no harm.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialise, shared_path

#: Payloads below this size are always stored.
LEAST_BYTES = 100
#: Capture lines of an index block.
BLOCK_LINES = 512
#: Bytes of payload of an archive, about; sets the number of parts.
PART_BYTES = 64 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "stem string, first_key string, first_id long, captures long, blocks long"
#: Stands for a null id in the order of captures.
NO_ID = -(1 << 63)


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels reversed and comma-joined, then `)` and the rest, lower case, without blanks
    and control characters; null gives `)`."""
    url = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"[\x00-\x20\x7f]", "")
    url = F.regexp_replace(url, r"^[a-z][a-z0-9+.-]*://", "")
    authority = F.regexp_replace(F.regexp_extract(url, r"^[^/?#]*", 0), r"^.*@|:[0-9]*$", "")
    rest = F.regexp_extract(url, r"(?s)^[^/?#]*([^#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(authority, r"\.")), ","), F.lit(")"), rest)


def _record(kind: str, page: int | None, url: str, payload: bytes, digest: str, refers: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'null' if page is None else page}>",
        f"WARC-Target-URI: {' '.join(url.split())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers}>"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers and payload of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = next(int(x[16:]) for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
    return {"fields": fields, "payload": payload, "length": length}


def _number(urn: str | None) -> int | None:
    text = urn[len("<urn:page:") : -1] if urn else "null"
    return None if text == "null" else int(text)


def with_kinds(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """(id, url, html, digest, key, first): `first` is the page that holds the payload, null for pages stored in full."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest")
    ).withColumn("key", url_key(F.col("url")))
    large = rows.filter(F.octet_length("html") >= least)
    groups = large.groupBy("digest").agg(F.min("id").alias("keeper"), F.count("*").alias("n"))
    again = materialise(groups.filter("n > 1 AND keeper IS NOT NULL").drop("n"), "again")
    # only repeated payloads are joined: the others take a key of their own, so no page waits on a shared key
    joined = rows.join(again, "digest", "left")
    repeats = (F.octet_length("html") >= least) & (F.col("id").isNull() | (F.col("id") > F.col("keeper")))
    return joined.select("id", "url", "html", "digest", "key", F.when(repeats, F.col("keeper")).alias("first"))


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_BYTES, parts: int | None = None
) -> DataFrame:
    """Write archives and index below `folder`; returns the manifest, one row per part.

    Of equal payloads of at least `least` bytes the page with the smallest id is a response, the others are
    revisits; rows that repeat the smallest id are responses too, and a page with a null id revisits unless all
    ids of its group are null. Null html is an empty payload, null url an empty one.
    """
    from quire.llm.sharedfs import open_fs

    rows = with_kinds(pages, id_col, url_col, html_col, least)
    if parts is None:
        size = pages.agg(F.sum(F.octet_length(html_col))).first()[0] or 0
        parts = max(int(size // PART_BYTES) + 1, 12)
    ordered = rows.repartitionByRange(parts, "key", "id", "digest").sortWithinPartitions("key", "id", "digest")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stem, at, n, lines, first = f"part-{uuid.uuid4().hex}", 0, 0, [], None
        directory: list[list] = []
        system, path = open_fs(folder)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{stem}.warc.gz", compression=None) as out, system.open_output_stream(
            f"{path}/{stem}.idx", compression=None
        ) as index:
            place = 0

            def flush() -> int:
                block = zlib.compress("\n".join(lines).encode(), 6)
                directory.append([*_order(lines[0]), place, len(block)])
                index.write(block)
                lines.clear()
                return place + len(block)

            for batch in batches:
                id_, url, html, digest, key, keeper = (batch.column(c) for c in ("id", "url", "html", "digest", "key", "first"))
                for i in range(batch.num_rows):  # one payload at a time
                    page, refers = id_[i].as_py(), keeper[i].as_py()
                    payload = html[i].as_buffer().to_pybytes()
                    kind = "response" if refers is None else "revisit"
                    record = _record(kind, page, url[i].as_py(), payload, digest[i].as_py(), refers)
                    record = gzip.compress(record, 6, mtime=0)
                    out.write(record)
                    lines.append(f"{key[i].as_py()} {NO_ID if page is None else page} {at} {len(record)}")
                    first = _order(lines[0]) if first is None else first
                    at, n = at + len(record), n + 1
                    if len(lines) >= BLOCK_LINES:
                        place = flush()
            if lines:
                flush()
        with system.open_output_stream(f"{path}/{stem}.dir", compression=None) as sparse:
            sparse.write(json.dumps(directory).encode())
        if n:
            yield pa.RecordBatch.from_pylist([{"stem": stem, "first_key": first[0], "first_id": first[1], "captures": n, "blocks": len(directory)}])

    return materialise(ordered.mapInArrow(write, MANIFEST), "manifest")


def _order(line: str) -> tuple[str, int]:
    key, page, _ = line.split(" ", 2)
    return key, int(page)


class CaptureIndex:
    """Lookup in the written index; keeps the directory and the block it used last."""

    def __init__(self, folder: str, parts: list[tuple[str, str, int]]):
        from quire.llm.sharedfs import open_fs

        self.system, self.path = open_fs(folder)
        self.parts = sorted(((key, page), stem) for stem, key, page in parts)
        self.part_firsts = [first for first, _ in self.parts]
        self.stem = self.block = self.archive = None
        self.directory, self.firsts, self.lines, self.orders = [], [], [], []

    def _read(self, name: str, offset: int, length: int) -> bytes:
        with self.system.open_input_file(f"{self.path}/{name}") as file:
            return file.read_at(length, offset)

    def _open(self, stem: str) -> None:
        if stem != self.stem:
            with self.system.open_input_stream(f"{self.path}/{stem}.dir", compression=None) as file:
                self.directory = json.loads(file.read())
            self.firsts = [(d[0], d[1]) for d in self.directory]
            self.stem, self.block = stem, None
            if self.archive:
                self.archive.close()
            self.archive = self.system.open_input_file(f"{self.path}/{stem}.warc.gz")

    def _load(self, block: int) -> None:
        if block != self.block:
            _, _, offset, length = self.directory[block]
            self.lines = zlib.decompress(self._read(f"{self.stem}.idx", offset, length)).decode().split("\n")
            self.orders = [_order(line) for line in self.lines]
            self.block = block

    def captures(self, key: str, page: int | None = None, every: bool = False) -> Iterator[tuple[str, int, int]]:
        """(archive, offset, length) of the captures of a page under a key, or of every page under it.

        The captures of one key may run over blocks and parts; both are searched by (key, id).
        """
        low = (key, NO_ID if every or page is None else page)
        high = (key, (1 << 63) if every else low[1])
        for part in range(max(0, bisect.bisect_left(self.part_firsts, low) - 1), bisect.bisect_right(self.part_firsts, high)):
            self._open(self.parts[part][1])
            for block in range(max(0, bisect.bisect_left(self.firsts, low) - 1), bisect.bisect_right(self.firsts, high)):
                self._load(block)
                for i in range(bisect.bisect_left(self.orders, low), bisect.bisect_right(self.orders, high)):
                    offset, length = self.lines[i].rsplit(" ", 2)[1:]
                    yield self.stem, int(offset), int(length)

    def record(self, offset: int, length: int) -> dict:
        """The record at a byte range of the archive opened last."""
        return parse_record(gzip.decompress(self.archive.read_at(length, offset)))


def lookup(requests: DataFrame, folder: str, manifest: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Captures of the requested (url, id) rows, read from the archives through the index.

    Per distinct request and capture: id, url, payload_bytes, payload_digest, record_type, refers_to. A response's
    digest is taken from its payload and must be that of its header; a revisit has its header's.
    """
    parts = [tuple(r) for r in manifest.select("stem", "first_key", "first_id").collect()]  # one row per archive
    asked = requests.select(url_key(F.col(url_col)).alias("key"), F.col(id_col).alias("id")).distinct()
    asked = asked.repartitionByRange(max(len(parts), 1), "key", "id").sortWithinPartitions("key", "id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CaptureIndex(folder, parts)
        for batch in batches:
            out = []
            for key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for _, offset, length in index.captures(key, page):
                    got = index.record(offset, length)
                    fields, digest = got["fields"], got["fields"]["WARC-Payload-Digest"].removeprefix("sha256:")
                    kind = fields["WARC-Type"]
                    if kind == "response":
                        found = hashlib.sha256(got["payload"]).hexdigest()
                        if found != digest or len(got["payload"]) != got["length"]:
                            raise ValueError(f"damaged record of page {page}")
                    out.append((page, fields["WARC-Target-URI"], got["length"], digest, kind, _number(fields.get("WARC-Refers-To"))))
            columns = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    names = ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return asked.mapInArrow(
        read, "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    ).withColumnRenamed("id", id_col)


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages to archives in the shared folder and read each back through the index."""
    folder = shared_path(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder, id_col, url_col, html_col)
    return lookup(pages, folder, manifest, id_col, url_col)

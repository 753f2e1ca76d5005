"""Snapshots of a keyed table: parts, an index of their keys, and a pointer to the parts that count.

    data/part=<part>/            rows of a part, in as many files as the tasks that wrote them
    keys/part=<part>/bucket=<b>  its keys: narrow, one row per key, sorted by their hash
    manifest/<version>.json      the parts of a version; the highest version is the table

A part becomes visible when a manifest names it, so readers see whole batches or nothing, and a manifest is put in
place by renaming a finished file. How many buckets an index has is chosen for each part by its number of keys, so a
bucket stays of one size however large the table becomes; buckets are prefixes of the key's hash, so those of a part
are halves, quarters ... of those of a smaller one. One writer at a time is expected; a second one notices the other's
version and starts from that. Folders that no manifest names are removed by `remove_superseded`.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schemas

KEYS = ["source", "id"]
#: 3: parts, key index and manifests; before it, folders of buckets and batches.
SCHEMA_VERSION = 3
#: Keys of a bucket of an index, about.
BUCKET_KEYS = 1 << 18
#: Up to so many asked keys are looked for by their hashes, beyond by their buckets alone.
PROBES = 1000
#: Times a commit starts again from another writer's version.
RETRIES = 20
ROW = f"{schemas.STORE}, row bigint, tie bigint, part string"
INDEX = (
    "h bigint, source string, id string, saved_ts timestamp, batch_id bigint, deleted boolean, tie bigint, row bigint, "
    "part string, bucket int"
)


def key_hash(source: str | Column = "source", id_: str | Column = "id") -> Column:
    """Hash of a key; null and empty are told apart by the key itself."""
    return F.xxhash64(source, id_)


def _prefix(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits).cast("int") if bits else F.lit(0)


# --- manifests ------------------------------------------------------------------------------------------------


def _open(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, where = _open(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """{version, parts} of the latest version, or of an older one that has not been removed; no table has no parts."""
    found = [n for n in _names(spark, f"{path}/manifest") if n.endswith(".json") and not n.startswith(".")]
    if version is not None:
        found = [n for n in found if n == f"{version:020d}.json"]
    if not found:
        return {"version": 0, "parts": []}
    fs, where = _open(spark, f"{path}/manifest/{found[-1]}")
    stream = fs.open(where)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, change: Callable[[list[dict]], list[dict]]) -> int:
    """Make `change(parts)` the parts of the next version, and return its number."""
    for _ in range(RETRIES):
        now = snapshot(spark, path)
        version = now["version"] + 1
        text = json.dumps({"version": version, "parts": change(now["parts"])})
        fs, made = _open(spark, f"{path}/manifest/.{uuid.uuid4().hex}")
        _, final = _open(spark, f"{path}/manifest/{version:020d}.json")
        out = fs.create(made, False)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.exists(final) and fs.rename(made, final):
            return version
        fs.delete(made, False)  # another writer was first
    raise RuntimeError(f"{path}: {RETRIES} commits of others came first")


def remove_superseded(spark: SparkSession, path: str, versions: int = 1, older_than_hours: float = 24.0) -> list[str]:
    """Delete manifests before the last `versions`, and parts that none of those left names; returns the parts.

    A part that is being written is not named yet, so younger folders than `older_than_hours` stay.
    """
    manifests = [n for n in _names(spark, f"{path}/manifest") if n.endswith(".json") and not n.startswith(".")]
    named = {f"part={p['part']}" for n in manifests[-versions:] for p in snapshot(spark, path, int(n[:20]))["parts"]}
    for name in manifests[:-versions]:
        fs, where = _open(spark, f"{path}/manifest/{name}")
        fs.delete(where, False)
    before, gone = (time.time() - older_than_hours * 3600) * 1000, set()
    for kind in ("data", "keys"):
        for name in set(_names(spark, f"{path}/{kind}")) - named:
            fs, where = _open(spark, f"{path}/{kind}/{name}")
            if fs.getFileStatus(where).getModificationTime() <= before:
                fs.delete(where, True)
                gone.add(name.removeprefix("part="))
    return sorted(gone)


# --- parts ----------------------------------------------------------------------------------------------------


def _folder(path: str, kind: str, part: str) -> str:
    return f"{path}/{kind}/part={part}"


def _read(spark: SparkSession, path: str, kind: str, parts: list[str]) -> DataFrame:
    schema = ROW if kind == "data" else INDEX
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/{kind}").parquet(*[_folder(path, kind, p) for p in parts])


def write_part(rows: DataFrame, path: str, batches: Sequence[int]) -> dict:
    """Write rows (columns of schemas.STORE) and the index of their keys; nothing is visible before a commit.

    Rows stay in the tasks that have them. Of rows with one key the latest counts, a tombstone before a book of the
    same time, then the larger hash of the row; this is settled on the narrow columns alone.
    """
    spark = rows.sparkSession
    part = f"{batches[-1]}-{uuid.uuid4().hex}"
    said = [c for c in rows.columns if c != "saved_ts"]
    numbered = rows.withColumns({"row": F.monotonically_increasing_id(), "tie": F.xxhash64(*said)})
    numbered.write.parquet(_folder(path, "data", part))
    staged = _read(spark, path, "data", [part])
    n = staged.count()
    bits = (n // BUCKET_KEYS).bit_length()
    order = ["saved_ts", "batch_id", "deleted", "tie", "row"]
    best = staged.groupBy(*KEYS).agg(F.max(F.struct(*order)).alias("v"))
    index = best.select(key_hash().alias("h"), *KEYS, "v.*").withColumn("bucket", _prefix(F.col("h"), bits))
    (
        index.repartitionByRange(1 << bits, "bucket", "h")
        .sortWithinPartitions("bucket", "h")
        .write.partitionBy("bucket")
        .option("parquet.bloom.filter.enabled#h", "true")
        .option("parquet.bloom.filter.expected.ndv#h", str(BUCKET_KEYS))
        .option("parquet.block.size", str(1 << 21))
        .parquet(_folder(path, "keys", part))
    )
    keys, dead = _read(spark, path, "keys", [part]).agg(F.count("*"), F.count_if("deleted")).first()
    return {
        "part": part, "schema": SCHEMA_VERSION, "batches": [int(b) for b in batches], "bits": bits, "rows": n, "keys": keys, "dead": dead,
    }


def live_parts(spark: SparkSession, path: str) -> list[dict]:
    """Parts of the latest version; those of another schema are misses."""
    return [p for p in snapshot(spark, path)["parts"] if p["schema"] == SCHEMA_VERSION]


def read_index(spark: SparkSession, path: str, parts: list[dict], asked: DataFrame | None = None) -> DataFrame:
    """Index rows of the parts. `asked` (source, id) leaves out buckets, and row groups, that hold none of its keys."""
    parts, wanted, hashes = [p for p in parts if p["rows"]], None, None
    most = max((p["bits"] for p in parts), default=0)
    if asked is not None and parts:
        h = asked.select(key_hash().alias("h")).distinct()
        some = [r[0] for r in h.limit(PROBES + 1).collect()]
        if len(some) <= PROBES:
            hashes = some
            wanted = {(x % (1 << 64)) >> (64 - most) if most else 0 for x in some}
        else:  # as many numbers as an index has buckets, at most
            wanted = {r[0] for r in h.select(_prefix(F.col("h"), most)).distinct().collect()}
    frames = []
    for bits in sorted({p["bits"] for p in parts}):
        rows = _read(spark, path, "keys", [p["part"] for p in parts if p["bits"] == bits])
        if wanted is not None:
            rows = rows.filter(F.col("bucket").isin(sorted({w >> (most - bits) for w in wanted})))
        frames.append(rows if hashes is None else rows.filter(F.col("h").isin(hashes)))
    return reduce(DataFrame.unionByName, frames) if frames else _read(spark, path, "keys", [])


def winners(index: DataFrame) -> DataFrame:
    """(source, id, saved_ts, batch_id, deleted, part, row): the version of every key that counts."""
    order = ["saved_ts", "batch_id", "deleted", "tie", "part", "row"]
    return index.groupBy(*KEYS).agg(F.max(F.struct(*order)).alias("_v")).select(*KEYS, "_v.*").drop("tie")


def read_rows(spark: SparkSession, path: str, parts: list[dict]) -> DataFrame:
    """One row per part and key, tombstones among them."""
    repeated = [p for p in parts if p["rows"] > p["keys"]]
    whole = _read(spark, path, "data", [p["part"] for p in parts if p["rows"] == p["keys"]])
    if not repeated:
        return whole
    rows = _read(spark, path, "data", [p["part"] for p in repeated])
    counting = read_index(spark, path, repeated).select("part", "row")
    return whole.unionByName(rows.join(counting, ["part", "row"], "left_semi"))


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The current row of every key. One part without tombstones is a plain scan; else texts are shuffled once at most."""
    parts = live_parts(spark, path)
    if len(parts) == 1 and parts[0]["rows"] == parts[0]["keys"] and not parts[0]["dead"]:
        return read_rows(spark, path, parts)
    chosen = winners(read_index(spark, path, parts)).filter("NOT deleted").select("part", "row")
    rows = _read(spark, path, "data", [p["part"] for p in parts if p["rows"]])
    return rows.join(chosen, ["part", "row"], "left_semi").select(rows.columns)

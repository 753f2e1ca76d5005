"""Content store keyed by (source, id): append-only versions, incremental plans, freshness."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schemas
from quire.functions.text import progress_key, store_key
from quire.operators import snapshots
from quire.operators.snapshots import KEYS, SCHEMA_VERSION

#: Columns of a part that are no columns of the store.
_OWN = ("part", "row", "tie")


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def _as_store(books: DataFrame, batch_id: int, saved_ts: Column | None, deleted: Column) -> DataFrame:
    has = set(books.columns)
    named = {
        "schema_version": F.lit(SCHEMA_VERSION),
        "store_key": store_key("source", "id"),
        "saved_ts": F.current_timestamp() if saved_ts is None else saved_ts,
        "deleted": deleted,
        "batch_id": F.lit(batch_id),
    }
    out = []
    for field in (f.strip().split(" ", 1) for f in _fields(schemas.STORE)):
        name, type_ = field
        value = named.get(name, F.col(name) if name in has else F.lit(None))
        out.append(value.cast(type_).alias(name))
    return books.select(*out)


def _fields(schema: str) -> list[str]:
    """Top-level fields of a schema text."""
    out, depth, start = [], 0, 0
    for at, char in enumerate(schema):
        depth += (char == "<") - (char == ">")
        if char == "," and depth == 0:
            out.append(schema[start:at])
            start = at + 1
    return [*out, schema[start:]]


def store_upsert(
    books: DataFrame, path: str, batch_id: int, saved_ts: Column | None = None, deleted: bool | Column = False
) -> None:
    """Write the versions of one batch, one call per batch; readers see all of it or nothing.

    A retried batch takes the place of its first attempt, unless a compaction has taken that up: then it is done.
    `deleted` may be a column, so books and tombstones go into one batch. Of rows with one key the latest counts, a
    tombstone before a book of the same time, then the larger hash of the row, so retries agree. Texts are not
    shuffled: a batch is written by the tasks that have it.
    """
    spark = books.sparkSession
    if any(batch_id in p["batches"] and len(p["batches"]) > 1 for p in snapshots.live_parts(spark, path)):
        return
    flag = deleted if isinstance(deleted, Column) else F.lit(deleted)
    part = snapshots.write_part(_as_store(books, batch_id, saved_ts, flag), path, [batch_id])
    snapshots.commit(spark, path, lambda parts: [p for p in parts if p["batches"] != [batch_id]] + [part])


def store_versions(spark: SparkSession, path: str) -> DataFrame:
    """Every version that counts in its batch, tombstones among them."""
    return snapshots.read_rows(spark, path, snapshots.live_parts(spark, path)).drop(*_OWN)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The current version of every book. A batch holds one row per key; null keys are keys like any other."""
    return snapshots.read_current(spark, path).drop(*_OWN)


def known_keys(spark: SparkSession, path: str, asked: DataFrame, before: int) -> DataFrame:
    """Keys (source, id) among the asked ones that batches before this one have stored; reads index files only."""
    parts = [p for p in snapshots.live_parts(spark, path) if min(p["batches"]) < before]
    index = snapshots.read_index(spark, path, parts, asked).filter(F.col("batch_id") < before)
    return snapshots.winners(index).filter("NOT deleted").select(*KEYS)


def compact_store(spark: SparkSession, path: str) -> None:
    """Put the current versions into one part; what is committed meanwhile stays beside it.

    Readers of an older version go on until `snapshots.remove_superseded` takes its files away.
    """
    taken = snapshots.live_parts(spark, path)
    if not taken:
        return
    batches = sorted({b for p in taken for b in p["batches"]})
    # a batch number of its own marks the part as compacted even if it holds one batch
    part = snapshots.write_part(read_store(spark, path).hint("rebalance"), path, [-1, *[b for b in batches if b != -1]])
    names = {p["part"] for p in taken}
    snapshots.commit(spark, path, lambda parts: [p for p in parts if p["part"] not in names] + [part])


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Current versions to a new folder; the one being read is left alone."""
    if snapshots.live_parts(spark, target):
        raise ValueError(f"{target} is a store already")
    batches = sorted({-1, *(b for p in snapshots.live_parts(spark, path) for b in p["batches"])})
    part = snapshots.write_part(read_store(spark, path).hint("rebalance"), target, batches)
    snapshots.commit(spark, target, lambda parts: [*parts, part])


def split_cached(requests: DataFrame, stored: DataFrame, force: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """Requests with `cached`. `force` has all of them done again."""
    if force:
        return requests.withColumn("cached", F.lit(False))
    known = stored.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct().withColumn("_hit", F.lit(True))
    same = reduce(lambda a, b: a & b, [requests[k].eqNullSafe(known[f"_{k}"]) for k in keys])
    return requests.join(known, same, "left").select(*requests.columns, F.col("_hit").isNotNull().alias("cached"))


def pending(requests: DataFrame, stored: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    known = stored.select(*keys).distinct()
    return requests.join(known, _same(requests, known, keys), "left_anti")


def resume_plan(toc: DataFrame, checkpoints: DataFrame, pos: str = "pos") -> DataFrame:
    """Contents entries after the last good checkpoint of their book; shells before it stay skipped."""
    last = checkpoints.groupBy(*KEYS).agg(F.max("idx").alias("_idx"))
    return toc.join(last, KEYS, "left").filter(F.col(pos) > F.coalesce("_idx", F.lit(-1))).drop("_idx")


def latest_checkpoints(chapter_events: DataFrame) -> DataFrame:
    """Last position with text per partial download; shells leave no checkpoint.

    chapter_events (source, id, title, idx, text).
    """
    return chapter_events.filter(F.length("text") > 0).groupBy("source", "id", "title").agg(F.max("idx").alias("idx"))


def checkpoint_state(expected: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Where each expected download goes on.

    A checkpoint is found by title and counts when its source matches and its id is absent or equal;
    any other one is damaged or belongs to another edition, and the download restarts at 0.
    """
    known = checkpoints.groupBy("title").agg(
        F.count(F.lit(1)).alias("_seen")
    )
    exact = checkpoints.filter("id is not null and idx is not null").groupBy("title", "source", "id").agg(
        F.max("idx").alias("_exact")
    )
    by_source = checkpoints.filter("id is null and idx is not null").groupBy("title", "source").agg(
        F.max("idx").alias("_any")
    )
    idx = F.greatest("_exact", "_any")
    return (
        expected.join(exact, ["title", "source", "id"], "left")
        .join(by_source, ["title", "source"], "left")
        .join(known, "title", "left")
        .select(
            *expected.columns,
            F.coalesce(idx + 1, F.lit(0)).alias("resume_from"),
            (idx.isNull() & F.col("_seen").isNotNull()).alias("restart"),
        )
    )


def delete_books(table: DataFrame, keys: DataFrame, on: Sequence[str] = KEYS) -> DataFrame:
    """Rows whose book is not deleted."""
    return table.join(keys.select(*on).distinct(), list(on), "left_anti")


def delete_library_rows(files: DataFrame, progress: DataFrame, rels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Library files and reading positions left after deleting `rels`.

    A finished book takes its partial along, a partial takes only itself; both take the position.
    """
    gone = rels.select("rel").distinct()
    partial = F.concat(F.regexp_replace("rel", r"(?i)\.(?:txt|epub)\z", ""), F.lit(".txt.part"))
    leftovers = gone.filter(~F.col("rel").endswith(".part")).select(partial.alias("rel"))
    positions = gone.select(progress_key("rel").alias("_key"))
    kept = files.join(gone.unionByName(leftovers).distinct(), "rel", "left_anti")
    read = progress.withColumn("_key", progress_key("rel")).join(positions.distinct(), "_key", "left_anti").drop("_key")
    return kept, read


def freshness(index: DataFrame, now: Column, ttl: str, outcome: str | None = None) -> DataFrame:
    """What to do with an index of age `now - ts`.

    index (ts, dead, has_paths and, once refreshed, `outcome` in ok / gone / transient).
    """
    young = F.col("ts").isNotNull() & (now - F.expr(f"interval {ttl}") < F.col("ts"))
    dead = F.coalesce("dead", F.lit(False))
    action = F.when(young & dead, "refuse").when(young, "fresh")
    if outcome is None:
        return index.withColumn("action", action.otherwise("refresh"))
    result = F.col(outcome)
    return index.withColumn(
        "action",
        action.when(result == "ok", "refreshed")
        .when(result == "gone", "mark_dead")
        .when((result == "transient") & F.col("has_paths"), "stale")
        .when(result == "transient", "fail")
        .otherwise("refresh"),
    )

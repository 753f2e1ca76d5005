"""Fetch logs: outcome classes, pacing, circuit breaker, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import is_challenge
from quire.operators.ordering import CHUNK_SECONDS, number_within, previous_within, running_sum_within, time_chunk
from quire.session import cut_lineage

MIN_GAP = 2.0
BREAK_FAILS = 3
BREAK_WINDOW = 300.0
RATE_LIMIT_WAIT = 10.0


def classify_outcome(fetch_log: DataFrame) -> DataFrame:
    """Class of an attempt and what follows: success, retry or not, seconds to wait after a rate limit.

    fetch_log (http_status, null for a network error; body_head; retry_after).
    """
    code, page = F.col("http_status"), is_challenge(F.coalesce("body_head", F.lit("")))
    outcome = (
        F.when(code.isNull(), "network")
        .when((code == 200) & page, "verification")
        .when(code == 200, "ok")
        .when((code == 403) & page, "verification")
        .when(code == 403, "blocked")
        .when(code == 429, "rate_limited")
        .otherwise("http_error")
    )
    asked = F.greatest(F.lit(RATE_LIMIT_WAIT), F.coalesce(F.col("retry_after").try_cast("double"), F.lit(RATE_LIMIT_WAIT)))
    return fetch_log.withColumn("outcome", outcome).withColumns(
        {
            "ok": F.col("outcome") == "ok",
            "retry": F.col("outcome").isin("network", "rate_limited", "http_error"),
            "wait_s": F.when(F.col("outcome") == "rate_limited", asked),
        }
    )


def pacing_audit(
    fetch_log: DataFrame, min_gap: float = MIN_GAP, chunk_seconds: float = CHUNK_SECONDS
) -> DataFrame:
    """Gap to the previous request on the same host and whether it is below the minimum.

    fetch_log (host, ts, id).
    """
    log = fetch_log.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    seen = previous_within(log, ["host"], ["_us", "id"], time_chunk("ts", chunk_seconds), ["_us"], 1, "_prev")
    gap = F.col("_us") - F.get("_prev", F.lit(0))["_us"]
    return seen.withColumn("gap_us", gap).withColumn(
        "too_fast", F.coalesce(F.col("gap_us") < int(min_gap * 1_000_000), F.lit(False))
    ).drop("_us", "_prev")


def breaker_log(
    fetch_log: DataFrame,
    fails: int = BREAK_FAILS,
    window: float = BREAK_WINDOW,
    segment_limit: int = 10_000,
    chunk_seconds: float = CHUNK_SECONDS,
) -> DataFrame:
    """Circuit breaker per host over a log: `state` is opened, refused or closed.

    fetch_log (host, ts, id, ok); one row is one attempt. The `fails`-th failure in a row opens the
    breaker for `window` seconds and clears the count; attempts while it is open are refused and change
    nothing; a success clears the count.

    Only a failure preceded by `fails - 1` failures can open the breaker, and it does so when that
    short run starts at or after the end of the last opening. So the ordered work is on those
    candidates alone. They fall into segments wherever a candidate starts after every earlier one has
    expired; segments are folded in parallel. A segment beyond `segment_limit` (a host that failed for
    weeks) is settled by following "next candidate" pointers in doubling steps, so no host, however
    busy, is one task's work. Openings are at least a window apart, so each log row meets at most two.
    """
    width = int(window * 1_000_000)
    log = fetch_log.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn(
        "_slot", F.floor(F.col("_us") / F.lit(width))
    )
    # ordered work is cut finer than the window, which may be long
    part = F.col("_part")
    slim = log.select("host", "_us", "id", "ok", time_chunk("ts", chunk_seconds).alias("_part"))
    if fails > 1:
        slim = previous_within(slim, ["host"], ["_us", "id"], part, ["_us", "ok"], fails - 1, "_prev")
        failing = (F.size("_prev") == fails - 1) & F.forall("_prev", lambda p: ~p["ok"])
        start = F.get("_prev", F.lit(0))["_us"]
    else:
        failing, start = F.lit(True), F.col("_us")
    # a fraction of the log, read several times below
    candidates = cut_lineage(
        slim.filter(~F.col("ok")).filter(failing).select("host", "_us", "id", "_part", start.alias("_start"))
    )

    order = ["_us", "id"]
    linked = previous_within(candidates, ["host"], order, part, ["_us"], 1, "_prev")
    last = F.get("_prev", F.lit(0))["_us"]
    opens = F.when(last.isNull() | (F.col("_start") >= last + width), 1).otherwise(0)
    segments = cut_lineage(
        running_sum_within(
            linked.withColumn("_cut", opens).drop("_prev"), ["host"], order, part, F.col("_cut"), "_segment"
        ).drop("_cut")
    )
    sizes = segments.groupBy("host", "_segment").agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.filter(F.col("_n") > segment_limit).select("host", "_segment")
    trips = _fold_segments(segments.join(large, ["host", "_segment"], "left_anti"), width)
    if not large.isEmpty():
        trips = trips.unionByName(_chase_segments(segments.join(large, ["host", "_segment"], "left_semi"), width))

    # an opening touches its own slot and the next one; each holds at most one opening
    slots = (
        trips.select(
            "host", F.struct("_us", "id").alias("_trip"),
            F.explode(F.array(F.lit(0), F.lit(1))).alias("_later"),
            F.floor(F.col("_us") / F.lit(width)).alias("_s"),
        )
        .groupBy("host", (F.col("_s") + F.col("_later")).alias("_slot"))
        .agg(
            F.max(F.when(F.col("_later") == 0, F.col("_trip"))).alias("_here"),
            F.max(F.when(F.col("_later") == 1, F.col("_trip"))).alias("_before"),
        )
    )
    at = F.struct("_us", "id")
    refused = F.coalesce(F.col("_us") < F.col("_before._us") + width, F.lit(False)) | F.coalesce(
        at > F.col("_here"), F.lit(False)
    )
    opened = F.coalesce(at == F.col("_here"), F.lit(False))
    return log.join(slots, ["host", "_slot"], "left").select(
        *fetch_log.columns,
        F.when(opened, "opened").when(refused, "refused").otherwise("closed").alias("state"),
    )


def _fold_segments(segments: DataFrame, width: int) -> DataFrame:
    """Openings of small segments: one ordered fold each."""
    trip = F.struct(F.col("_us"), F.col("id"))
    ordered = segments.groupBy("host", "_segment").agg(
        F.sort_array(F.collect_list(F.struct("_us", "id", "_start"))).alias("_c")
    )
    id_type = segments.schema["id"].dataType.simpleString()
    zero = F.struct(
        F.lit(None).cast("bigint").alias("until"), F.array().cast(f"array<struct<_us:bigint,id:{id_type}>>").alias("trips")
    )

    def step(acc: Column, c: Column) -> Column:
        opens = acc["until"].isNull() | (c["_start"] >= acc["until"])
        return F.struct(
            F.when(opens, c["_us"] + width).otherwise(acc["until"]).alias("until"),
            F.when(opens, F.array_append(acc["trips"], F.struct(c["_us"].alias("_us"), c["id"].alias("id"))))
            .otherwise(acc["trips"])
            .alias("trips"),
        )

    return ordered.select("host", F.explode(F.aggregate("_c", zero, step)["trips"]).alias("_t")).select(
        "host", "_t._us", "_t.id"
    )


def _chase_segments(segments: DataFrame, width: int) -> DataFrame:
    """Openings of huge segments: the first candidate, then the next one that starts after it expired.

    Candidates are numbered; the number of the next opening follows from a merge of the expiry times
    with the starts. The chain is walked by doubling: after k rounds 2^k openings are known.
    """
    keys = ["host", "_segment"]
    nodes = number_within(segments, keys, ["_us", "id"], F.col("_part"), "_n").select(*keys, "_n", "_us", "id", "_start")
    nodes = cut_lineage(nodes)
    starts = nodes.select(*keys, F.col("_start").alias("_v"), F.lit(1).alias("_side"), F.lit(1).alias("_one"), "_n")
    ends = nodes.select(*keys, (F.col("_us") + width).alias("_v"), F.lit(0).alias("_side"), F.lit(0).alias("_one"), "_n")
    merged = running_sum_within(
        starts.unionByName(ends), keys, ["_v", "_side", "_n"], F.floor(F.col("_v") / F.lit(int(CHUNK_SECONDS * 1_000_000))), F.col("_one"), "_seen"
    )
    jump = cut_lineage(
        merged.filter(F.col("_side") == 0).select(*keys, "_n", (F.col("_seen") + 1).alias("_to"))
        .join(nodes.select(*keys, F.col("_n").alias("_to")), [*keys, "_to"], "left_semi")
        .select(*keys, "_n", "_to")
    )
    reached = cut_lineage(nodes.filter(F.col("_n") == 1).select(*keys, "_n"))
    known = reached.count()
    while True:
        landed = reached.join(jump, [*keys, "_n"]).select(*keys, F.col("_to").alias("_n"))
        reached = cut_lineage(reached.unionByName(landed).distinct())
        now = reached.count()
        if now == known:
            break
        known = now
        onward = jump.select(*keys, F.col("_n").alias("_to"), F.col("_to").alias("_far"))
        jump = cut_lineage(jump.join(onward, [*keys, "_to"]).select(*keys, "_n", F.col("_far").alias("_to")))
    return nodes.join(reached, [*keys, "_n"], "left_semi").select("host", "_us", "id")


def latest_jobs(job_events: DataFrame) -> DataFrame:
    """Last known state per job.

    job_events (job_id, ts, event_id, status, done, total).
    """
    return (
        job_events.groupBy("job_id")
        .agg(F.max_by(F.struct("status", "done", "total"), F.struct("ts", "event_id")).alias("_s"))
        .select("job_id", "_s.*")
    )


def job_status(job_events: DataFrame) -> DataFrame:
    """Jobs and their progress by state."""
    return latest_jobs(job_events).groupBy("status").agg(
        F.count(F.lit(1)).alias("jobs"), F.sum("done").alias("done"), F.sum("total").alias("total")
    )

import random
from datetime import datetime, timedelta, timezone

import pytest
from conftest import rows

from quire.operators import logs

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def brute(attempts, fails, window):
    """(host, seconds, id, ok) in order, one state per attempt."""
    out, state = {}, {}
    for host, s, id_, ok in sorted(attempts, key=lambda a: (a[0], a[1], a[2])):
        n, until = state.get(host, (0, None))
        if until is not None and s < until:
            out[id_] = "refused"
            continue
        n = 0 if ok else (0 if until is not None else n) + 1
        if n >= fails:
            out[id_], state[host] = "opened", (0, s + window)
        else:
            out[id_], state[host] = "closed", (n, None)
    return out


def log(spark, attempts):
    return spark.createDataFrame(
        [(h, T0 + timedelta(seconds=s), i, ok) for h, s, i, ok in attempts], "host string, ts timestamp, id long, ok boolean"
    )


def attempts(seed, n=600, bad=0.6, span=3000):
    rng = random.Random(seed)
    return [(rng.choice(["a", "a", "a", "b", "c"]), rng.randrange(span), i, rng.random() > bad) for i in range(n)]


@pytest.mark.parametrize("seed, bad, window, fails, limit", [
    (1, 0.6, 300, 3, 10_000), (2, 0.95, 30, 3, 1), (3, 0.3, 300, 3, 1), (4, 0.8, 7, 2, 2), (5, 0.5, 50, 1, 3), (6, 1.0, 20, 4, 1),
])
def test_breaker_against_a_loop(spark, seed, bad, window, fails, limit):
    data = attempts(seed, bad=bad)
    got = {r["id"]: r["state"] for r in logs.breaker_log(log(spark, data), fails, window, limit).collect()}
    assert got == brute(data, fails, window)


def test_breaker_example(spark):
    data = [("h", 0, 0, False), ("h", 1, 1, False), ("h", 2, 2, False), ("h", 3, 3, True), ("h", 302, 4, True)] + [
        ("h", 303 + i, 5 + i, False) for i in range(4)
    ]
    got = rows(logs.breaker_log(log(spark, data)).orderBy("id"), "state")
    assert [g[0] for g in got] == ["closed", "closed", "opened", "refused", "closed", "closed", "closed", "opened", "refused"]


def test_breaker_without_failures(spark):
    assert rows(logs.breaker_log(log(spark, [("h", 1, 1, True)])), "state") == [("closed",)]


def test_pacing(spark):
    data = [("a", 0, 1, True), ("a", 1, 2, True), ("a", 4000, 3, True), ("b", 5, 4, True)]
    got = rows(logs.pacing_audit(log(spark, data)).orderBy("id"), "gap_us", "too_fast")
    assert got == [(None, False), (1_000_000, True), (3999_000_000, False), (None, False)]


def test_outcomes(spark):
    df = spark.createDataFrame(
        [
            (1, 200, "<p>x</p>", None), (2, 200, "Just a moment", None), (3, 403, "cf-challenge", None), (4, 403, "no", None),
            (5, 429, "", "30"), (6, 429, "", "soon"), (7, 503, "", None), (8, None, None, None), (9, 429, "", "3"),
        ],
        "id int, http_status int, body_head string, retry_after string",
    )
    got = rows(logs.classify_outcome(df).orderBy("id"), "outcome", "ok", "retry", "wait_s")
    assert got == [
        ("ok", True, False, None), ("verification", False, False, None), ("verification", False, False, None),
        ("blocked", False, False, None), ("rate_limited", False, True, 30.0), ("rate_limited", False, True, 10.0),
        ("http_error", False, True, None), ("network", False, True, None), ("rate_limited", False, True, 10.0),
    ]


def test_jobs(spark):
    df = spark.createDataFrame(
        [("j1", 1, 1, "running", 1, 10), ("j1", 2, 2, "done", 10, 10), ("j2", 1, 3, "running", 4, 9), ("j2", 1, 2, "queued", 0, 9)],
        "job_id string, ts int, event_id int, status string, done int, total int",
    )
    assert sorted(rows(logs.job_status(df))) == [("done", 1, 10, 10), ("running", 1, 4, 9)]

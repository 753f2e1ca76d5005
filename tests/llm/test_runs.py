"""Periodic runs against plain comparison at every period."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import runs


def plain_runs(words):
    """(start, period, length) by start, then period: every stretch at every period, the smallest period of each."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i > start and i - start + q >= max(6, 4 * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted((s, q, n) for (s, n), q in found.items())


def plain_collapse(words, found):
    gone = {i for s, q, n in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_words(rng):
    n, kind = rng.choice([0, 1, 5, 6, 7, 8, 20, 60, 150, 400]), rng.randrange(6)
    if kind == 0:
        return rng.choices("ab", k=n)
    if kind == 1:
        return rng.choices("abcdefghij", k=n)
    if kind == 2:
        unit = rng.choices("abc", k=rng.randrange(1, max(2, n // 3 + 1)))
        out = [unit[i % len(unit)] for i in range(n)]
        if n and rng.random() < 0.5:
            out[rng.randrange(n)] = "z"
        return out
    if kind == 3:
        out = []
        while len(out) < n:
            out += rng.choices("abcd", k=rng.randrange(1, 9)) * rng.randrange(1, 9)
        return out[:n]
    if kind == 4:
        return ["a"] * n
    return ((rng.choices("ab", k=rng.randrange(1, 5)) * rng.randrange(4, 7) + rng.choices("ab", k=3)) * 10)[:n]


def merged(fragments):
    by, out = {}, []
    for f in fragments:
        by.setdefault(f["period"], []).append([f["start"], f["stop"]])
    for period, spans in by.items():
        joined = []
        for a, b in sorted(spans):
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(b, joined[-1][1])
            else:
                joined.append([a, b])
        out += [(a, period, b - a + period) for a, b in joined if b - a + period >= max(6, 4 * period)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(8))
def test_fragments(seed):
    rng = random.Random(seed)
    for tile in (16, 32, 64, runs.TILE):
        texts = [random_words(rng) for _ in range(12)]
        plain, n, found = runs.text_fragments(pa.array([" \n".join(t) + " " * (i % 2) for i, t in enumerate(texts)], pa.string()), tile)
        assert plain.to_pylist() == [" ".join(t) for t in texts] and n.to_pylist() == [len(t) for t in texts]
        for words, fragments in zip(texts, found.to_pylist()):
            assert merged(fragments) == plain_runs(words)


def test_fragments_are_compared_word_by_word():
    words = np.array([ord(c) for c in "abcab" * 9 + "xy" + "ab" * 7])
    tile = runs.Tile(words)
    assert tile._exact(0, 10, 5) == [(0, 10, 5)]
    # what a wrong hash would propose is cut to the stretches that are right
    assert tile._exact(0, len(words) - 5, 5) == [(0, 40, 5)]


def test_long_texts_cost_no_square():
    one = np.zeros(400_000, np.int64)
    rows = runs.long_fragments(one)
    assert len(rows) < 20 and {p for _, _, p in rows.tolist()} == {1}
    long = np.random.default_rng(0).integers(0, 50_000, 600_000)
    long[200_000:400_000] = np.resize(np.arange(30_000), 200_000)
    start, stop, period = zip(*runs.long_fragments(long).tolist())
    assert set(period) == {30_000} and min(start) == 200_000 and max(stop) + 30_000 == 400_000


def test_documents(spark):
    rng = random.Random(7)
    texts = [random_words(rng) for _ in range(60)]
    rows = [(i, " \n\t".join(t), "own", "own") for i, t in enumerate(texts)]
    rows += [(100, None, "own", None), (101, "", None, "own"), (102, " \n ", None, None), (None, "a b " * 9, "own", "own")]
    rows += [(3, rows[3][1], "own", "own"), (103, "é é é é é é É", "", ""), (104, "a a a a a\x0ba", "", "")]
    rows += [(105, "long way " * 40000 + "end", "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, uid string").repartition(4)
    got = runs.collapse_runs(docs, tile=512)
    assert got.columns == ["doc_id", "text", "uid", "runs", "n_words"]
    key = lambda r: (str(r[0]), r[1], str(r[2]), r[3], r[4])
    have = [(r["doc_id"], r["text"], r["uid"], [(x["start"], x["period"], x["length"]) for x in r["runs"]], r["n_words"]) for r in got.collect()]
    want = []
    for doc, text, _, uid in rows:
        words = (text or "").encode().split()
        found = plain_runs(words) if doc != 105 else [(0, 2, 80000)]
        want.append((doc, plain_collapse([w.decode() for w in words], found), uid, found, len(words)))
    assert sorted(have, key=key) == sorted(want, key=key)
    assert runs.collapse_runs(docs.limit(0)).count() == 0
    only = runs.collapse_runs(docs.select("text"))
    assert only.columns == ["text", "runs", "n_words"] and only.count() == len(rows)

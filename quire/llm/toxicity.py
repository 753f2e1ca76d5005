"""Toxicity by class-conditional Kneser-Ney models.

Expressions are the distinct byte n-grams of the lower-cased text (per PIECE of a longer text), so a passage that
a document repeats counts once. Each class has an interpolated Kneser-Ney model: at the top order the number of
documents that hold an expression, continuation counts below it, and at order SHARED counts that both classes
share, so an expression that one class has hardly seen is judged by what both have seen of its end. A text's
evidence is the sum of the log-likelihood ratios of its expressions over the square root of their number (the
spread of such a sum grows with that root); a logistic curve fitted on labelled rows kept out of the counts turns
it into a score.

The fit takes at most MAX_ROWS labelled rows, those with the smallest hash of their id; every document is scored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialise, release_memory

#: Bound of the labelled rows the models are fitted on.
MAX_ROWS = 20_000
ORDER, SHARED, DISCOUNT = 4, 1, 3.0
#: One labelled row in so many is kept for the logistic curve.
CALIBRATION = 4
#: Bytes of text that are turned into n-grams at once.
PIECE = 1 << 20
_PLAIN = bytes(0x20 if b in b"\t\n\x0b\x0c\r" else b for b in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _bytes(text: str | None) -> bytes:
    return (text or "").lower().encode().translate(_PLAIN)


def _grams(raw: bytes, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(part, packed n-gram) of the distinct n-grams of each part of `raw`; parts lie one after another."""
    a = np.frombuffer(raw, np.uint8).astype(np.uint64)
    n = max(len(a) - ORDER + 1, 0)
    packed = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)[:n]
    part = packed.copy()
    for j in range(ORDER):
        packed = (packed << np.uint64(8)) | a[j : j + n]
    inside = np.arange(n) <= (np.cumsum(lengths) - ORDER)[part.astype(np.int64)]
    packed = np.sort(packed[inside])
    packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])] if len(packed) else packed
    return (packed >> np.uint64(8 * ORDER)).astype(np.int64), packed & np.uint64((1 << 8 * ORDER) - 1)


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], bytes, list[int]]]:
    """(places, bytes, lengths) of padded texts, about PIECE bytes each; a longer text comes in several pieces."""
    pad = b" " * (ORDER - 1)
    at, parts, lengths, held = [], [], [], 0
    for i, text in enumerate(texts):
        raw = pad + _bytes(text) + b" "
        for start in range(0, max(len(raw) - ORDER + 1, 1), PIECE):
            part = raw[start : start + PIECE + ORDER - 1]
            at.append(i)
            parts.append(part)
            lengths.append(len(part))
            held += len(part)
            if held >= PIECE:
                yield at, b"".join(parts), lengths
                at, parts, lengths, held = [], [], [], 0
    if at:
        yield at, b"".join(parts), lengths


class _Table:
    """Values of n-grams in a hashed table."""

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(10, int(4 * len(grams)).bit_length()))
        slot = (grams * _MULTIPLIER) >> self.shift
        _, first = np.unique(slot, return_index=True)
        size = 1 << (64 - int(self.shift))
        self.keys, self.values = np.full(size, np.uint64(2**64 - 1)), np.zeros(size, np.float32)
        self.keys[slot[first]], self.values[slot[first]] = grams[first], values[first]
        rest = np.setdiff1d(np.arange(len(grams)), first)
        rest = rest[np.argsort(grams[rest])]
        self.rest, self.rest_values = grams[rest], values[rest].astype(np.float32)

    def __call__(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each n-gram, 0 if there is none, and whether there is one."""
        slot = (grams * _MULTIPLIER) >> self.shift
        held = self.keys[slot]
        known = held == grams
        out = np.where(known, self.values[slot], np.float32(0))
        if len(self.rest):
            other = np.flatnonzero(~known & (held != np.uint64(2**64 - 1)))
            at = np.minimum(np.searchsorted(self.rest, grams[other]), len(self.rest) - 1)
            known[other] = self.rest[at] == grams[other]
            out[other] = np.where(known[other], self.rest_values[at], np.float32(0))
        return out, known


def _mask(k: int) -> np.uint64:
    return np.uint64((1 << 8 * k) - 1)


class Model:
    """Log-likelihood ratio of every n-gram: one that neither class has seen is judged by its history and its end."""

    def __init__(self, seen: dict[int, tuple[np.ndarray, np.ndarray]], passed: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.seen = {k: _Table(*x) for k, x in seen.items()}
        self.passed = {k: _Table(*x) for k, x in passed.items()}

    def ratios(self, grams: np.ndarray, k: int = ORDER) -> np.ndarray:
        if k == SHARED:
            return np.zeros(len(grams), np.float32)
        out, known = self.seen[k](grams)
        other = np.flatnonzero(~known)
        if len(other):
            unseen = grams[other]
            out[other] = self.passed[k](unseen >> np.uint64(8))[0] + self.ratios(unseen & _mask(k - 1), k - 1)
        return out

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        for at, raw, lengths in _pieces(texts):
            part, grams = _grams(raw, lengths)
            np.add.at(total, at, np.bincount(part, self.ratios(grams), len(at)))
            np.add.at(n, at, np.bincount(part, minlength=len(at)))
        return total / np.sqrt(np.maximum(n, 1))


def _lookup(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(asked), values.dtype)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], 0)


def _histories(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Histories of sorted n-grams, the sum of their counts and the part of it that is passed on to the lower order."""
    if not len(grams):
        return grams, counts, counts
    h, start = np.unique(grams >> np.uint64(8), return_index=True)
    return h, np.add.reduceat(counts, start), np.add.reduceat(np.minimum(counts, DISCOUNT), start)


def fit_ratios(counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Model from (sorted n-grams, counts) of class 0 and class 1."""
    ends = [np.unique(g & _mask(SHARED), return_inverse=True) + (n,) for g, n in counts.values()]
    both = np.union1d(ends[0][0], ends[1][0])
    shared = np.zeros(len(both))
    for keys, inverse, n in ends:
        shared[np.searchsorted(both, keys)] += np.bincount(inverse, n, len(keys))
    h, total, _ = _histories(both, shared)
    floor = (shared + 0.5) / (_lookup(h, total, both >> np.uint64(8)) + 128)
    levels = {}
    for label, (top, n) in counts.items():
        levels[label] = {ORDER: (top, n.astype(np.float64))}
        for k in range(ORDER - 1, SHARED, -1):
            keys, types = np.unique(levels[label][k + 1][0] & _mask(k), return_counts=True)
            levels[label][k] = keys, types.astype(np.float64)
    seen, passed = {}, {}
    lower, p = both, {0: floor, 1: floor}
    for k in range(SHARED + 1, ORDER + 1):
        grams = np.union1d(levels[0][k][0], levels[1][k][0])
        histories, end = np.unique(grams >> np.uint64(8)), np.searchsorted(lower, grams & _mask(k - 1))
        weight = {}
        for label in (0, 1):
            keys, values = levels[label][k]
            h, total, handed = _histories(keys, values)
            total, handed = (_lookup(h, x, histories) for x in (total, handed))
            # a history that the class has not seen passes everything on
            weight[label] = np.where(total > 0, handed / np.maximum(total, 1), 1.0)
            at = np.searchsorted(histories, grams >> np.uint64(8))
            kept = np.maximum(_lookup(keys, values, grams) - DISCOUNT, 0)
            p[label] = kept / np.maximum(total[at], 1) + weight[label][at] * p[label][end]
        seen[k] = grams, np.log(p[1]) - np.log(p[0])
        passed[k] = histories, np.log(weight[1]) - np.log(weight[0])
        lower = grams
    return Model(seen, passed)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve with a slight penalty on the slope; without both classes a constant."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    if not len(y) or y.min() == y.max():
        return 0.0, float(np.log(share / (1 - share))) if len(y) else -50.0
    mean, sd = x.mean(), max(x.std(), 1e-9)
    a, w = np.stack([(x - mean) / sd, np.ones_like(x)], 1), np.array([0.0, np.log(share / (1 - share))])

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5e-2 * w[0] ** 2)

    at, fallen = loss(w), True
    while fallen:
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        slope = a.T @ (p - y) + np.array([1e-2 * w[0], 0])
        curve = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(curve, slope)
        # a whole step may overshoot where one class lies close and the other is spread: halve it until the loss falls
        tries = (w - step / 2**k for k in range(40))
        after = next((v for v in tries if loss(v) < at - 1e-9 * (1 + at)), None)
        fallen = after is not None
        if fallen:
            w, at = after, loss(after)
    return float(w[0] / sd), float(w[1] - w[0] * mean / sd)


def held_out(id_col: Column) -> Column:
    """Documents whose labels are never used: crc32 of the id as text has remainder 0 by 5; a null id counts as ''."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """(text, y, calibrates) of the labelled rows used; several labels of an id count as toxic if one is."""
    ids = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(F.col(label_col)).alias("y"))
    )
    present = docs.select(F.col(id_col).alias("id")).distinct()
    order = F.xxhash64(F.lit("fit"), "id")
    chosen = materialise(ids.join(present, "id", "left_semi").orderBy(order, "id").limit(most), "chosen")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # at most `most` ids, so the documents stay where they are
    rows = texts.join(F.broadcast(chosen), "id")
    return rows.select("text", (F.col("y") >= 1).cast("int").alias("y"), (F.pmod(F.xxhash64(F.lit("curve"), "id"), F.lit(CALIBRATION)) == 0).alias("calibrates"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list[np.ndarray]] = {0: [], 1: []}

    def combined(y: int) -> pa.RecordBatch:
        keys, n = (np.concatenate(x) for x in zip(*sums[y]))
        keys, inverse = np.unique(keys, return_inverse=True)
        n = np.bincount(inverse, n).astype(np.int64)
        sums[y] = [(keys, n)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), y, np.int32)), pa.array(keys.astype(np.int64)), pa.array(n)], ["y", "gram", "n"])

    for batch in batches:
        texts, labels = batch.column("text").to_pylist(), batch.column("y").to_pylist()
        for y in (0, 1):
            for _, raw, lengths in _pieces([t for t, label in zip(texts, labels) if label == y]):
                sums[y].append(np.unique(_grams(raw, lengths)[1], return_counts=True))
                if len(sums[y]) > 16:
                    combined(y)
    for y in (0, 1):
        if sums[y]:
            yield combined(y)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MAX_ROWS):
    """(model, slope, offset) from at most `most` labelled documents."""
    rows = training_rows(docs, labels, id_col, text_col, label_col, most)
    rows = materialise(rows, "labelled")
    found = rows.filter("NOT calibrates").select("text", "y").mapInArrow(_count, "y int, gram long, n long")
    table = found.groupBy("y", "gram").agg(F.sum("n").alias("n")).toArrow()
    y, grams, n = (table.column(c).to_numpy() for c in ("y", "gram", "n"))
    counts = {}
    for label in (0, 1):
        of = np.flatnonzero(y == label)
        of = of[np.argsort(grams[of])]
        counts[label] = grams[of].astype(np.uint64), n[of]
    model = fit_ratios(counts)
    curve = rows.filter("calibrates").select("y", _evidence(F.col("text"), model, rows).alias("x")).toArrow()
    return model, *_logistic(curve.column("x").to_numpy(), curve.column("y").to_numpy())


def _evidence(text: Column, model: Model, df: DataFrame) -> Column:
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def evidence(texts: pa.Array) -> pa.Array:
        out = pa.array(sent.value.evidence(texts.to_pylist()))
        release_memory()
        return out

    return evidence(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MAX_ROWS, score_col: str = "toxicity") -> DataFrame:
    """The documents with `score_col`, 0 to 1, higher where label 1 is likelier; a column of that name is replaced.

    Only the text enters a score; equal texts score alike, null counts as empty. Labels without id or value are
    ignored. Without labelled rows every score is (almost) 0; with one class it is that class's share.
    """
    model, slope, offset = fit(docs, labels, id_col, text_col, label_col, most)
    made = f"evidence_{uuid.uuid4().hex}"
    scored = docs.withColumn(made, _evidence(F.col(text_col), model, docs))
    return scored.withColumn(score_col, 1 / (1 + F.exp(-(F.col(made) * slope + offset)))).drop(made)

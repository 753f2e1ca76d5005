"""Periodic runs of words, found in tiles per octave of periods and stitched over the whole corpus.

A run of exponent 4 and more is a stretch of words with smallest period q. For the periods P <= q < 2P of an octave a
document is cut into overlapping tiles, which grow with the octave, and each tile is solved by itself: at every P-th
word, a boundary, the Z-function towards all offsets of the octave at once is tested for at least P equal words
(prefix hashes of the tile), boundaries in a row that agree at one offset are joined, and their ends are found with
the two Z-values, forwards and backwards, by bisection. What a tile sees of a stretch is a fragment; fragments whose
words have a shorter period are left to its octave. Fragments are shuffled by document and period, where overlapping
ones are stitched; only then is the length known and judged. Short documents share a tile, apart by unique marks.

Equal words are told by exact numbers. Hashes only propose: every fragment is compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import materialise

#: Words of a tile, and octaves' spans that it has at least; bytes of text that are solved together, about.
TILE, SPANS, GROUP = 1 << 16, 16, 1 << 22
#: Fewest words and periods of a run.
LEAST_WORDS, LEAST_PERIODS = 6, 4
FRAGMENTS = "array<struct<period: bigint, start: bigint, stop: bigint>>"
_PRIME = np.uint64((1 << 31) - 1)
_BASES = (1_103_515_245, 1_768_841_653)


def _mod(x: np.ndarray) -> np.ndarray:
    """Remainder of values below 2^62 by the prime 2^31 - 1."""
    x = (x & _PRIME) + (x >> np.uint64(31))
    x = (x & _PRIME) + (x >> np.uint64(31))
    return np.where(x >= _PRIME, x - _PRIME, x)


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1); each list is kept at the largest length asked for."""
    if len(_powers.get(base, ())) < n:
        out = np.ones(1, np.uint64)
        while len(out) < n:
            out = np.concatenate([out, _mod(out * np.uint64(pow(base, len(out), int(_PRIME))))])
        _powers[base] = out
    return _powers[base]


_factor = np.zeros(2, np.int64)


def _smallest_factor(n: int) -> np.ndarray:
    """Smallest prime factor of each number below n, at least."""
    global _factor
    if len(_factor) < n:
        size = 1 << max(10, (n - 1).bit_length())
        out = np.arange(size)
        for p in range(2, int(size**0.5) + 1):
            if out[p] == p:
                multiples = out[p * p :: p]
                multiples[multiples == np.arange(p * p, size, p)] = p
        _factor = out
    return _factor


class Tile:
    """Words (numbers) of a tile with prefix hashes. Ends that are `cut` are not the document's."""

    def __init__(self, words: np.ndarray, cut_left: bool = False, cut_right: bool = False):
        self.words, self.n, self.cut_left, self.cut_right = words, len(words), cut_left, cut_right
        self.sums, self.back = [], []
        for i, base in enumerate(_BASES):
            x = (words.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64((0xBF58476D1CE4E5B9, 0x94D049BB133111EB)[i])
            x = ((x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(34)
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(_mod(x * _power(base, self.n)[: self.n]), out=sums[1:])
            self.sums.append(_mod(sums))
            self.back.append(_power(pow(base, -1, int(_PRIME)), self.n + 1)[: self.n + 1])

    def head(self, n: int) -> Tile:
        """The tile's first n words."""
        out = object.__new__(Tile)
        out.words, out.n, out.cut_left, out.cut_right = self.words[:n], n, self.cut_left, False
        out.sums, out.back = [s[: n + 1] for s in self.sums], [b[: n + 1] for b in self.back]
        return out

    def _hash(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        sums = self.sums[which]
        return _mod((sums[end] + _PRIME - sums[start]) * self.back[which][start])

    def _same(self, start: np.ndarray, length: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Whether `length` words from `start` are those `shift` words on."""
        out = np.ones(len(start), bool)
        for which in range(len(_BASES)):
            out &= self._hash(which, start, start + length) == self._hash(which, start + shift, start + shift + length)
        return out

    def _boundaries(self, octave: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, last, period): boundaries in a row, two at least, from each of which `octave` words recur."""
        count = self.n - octave + 1
        rows = -(-(count - octave) // octave)
        if rows < 1:
            none = np.zeros(0, np.int64)
            return none, none, none
        sums, back = self.sums[0], self.back[0]
        ahead = np.full((rows + 1) * octave, _PRIME, np.uint64)  # of every word; the prime is no hash
        ahead[:count] = _mod((sums[octave:] + _PRIME - sums[:count]) * back[:count])
        at = ahead[: rows * octave : octave]
        found = np.flatnonzero(ahead[octave:].reshape(rows, octave) == at[:, None])
        row, offset = np.divmod(found, octave)
        order = np.lexsort((row, offset))
        row, offset = row[order], offset[order]
        begins = np.ones(len(row), bool)
        begins[1:] = (offset[1:] != offset[:-1]) | (row[1:] != row[:-1] + 1)
        first = np.flatnonzero(begins)
        last = np.append(first[1:], len(row)) - 1
        twice = last > first
        first, last = first[twice], last[twice]
        return row[first] * octave, row[last] * octave, offset[first] + octave

    def _ends(self, start: np.ndarray, stop: np.ndarray, period: np.ndarray, octave: int) -> tuple[np.ndarray, np.ndarray]:
        """The stretch of words that equal those a period on, from the boundaries to its ends in the tile."""
        start, stop, step = start.copy(), stop.copy(), octave >> 1
        while step:
            fits = np.flatnonzero(start >= step)
            more = fits[self._same(start[fits] - step, np.full(len(fits), step), period[fits])]
            start[more] -= step
            fits = np.flatnonzero(stop + step + period <= self.n)
            more = fits[self._same(stop[fits], np.full(len(fits), step), period[fits])]
            stop[more] += step
            step >>= 1
        return start, stop

    def _keeps(self, start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Fragments that are long enough, or reach an end where the tile was cut."""
        keeps = stop - start + period >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
        if self.cut_left:
            keeps |= start == 0
        if self.cut_right:
            keeps |= stop + period == self.n
        return keeps

    def _primitive(self, start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Whether no divisor of the period is one of the fragment's words, which span the period twice."""
        out = np.ones(len(start), bool)
        factor, rest = _smallest_factor(int(period.max()) + 1 if len(period) else 2), period.copy()
        while True:
            open_ = np.flatnonzero(out & (rest > 1))
            if not len(open_):
                return out
            prime = factor[rest[open_]]
            shorter = period[open_] // prime
            s = start[open_]
            out[open_] = ~self._same(s, stop[open_] + period[open_] - s - shorter, shorter)
            rest[open_] //= prime

    def _exact(self, start: int, stop: int, period: int) -> list[tuple[int, int, int]]:
        """The fragment, compared word by word; where a hash was wrong, the stretches that are right."""
        same = self.words[start:stop] == self.words[start + period : stop + period]
        if same.all():
            return [(start, stop, period)]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]])))
        pairs = edges.reshape(-1, 2) + start
        keeps = self._keeps(pairs[:, 0], pairs[:, 1], np.full(len(pairs), period))
        return [(int(a), int(b), period) for a, b in pairs[keeps]]

    def fragments(self, octave: int) -> np.ndarray:
        """Rows (start, stop, period): words from start to stop equal those a period of the octave on."""
        start, last, period = self._boundaries(octave)
        start, stop = self._ends(start, last + octave, period, octave)
        for test in (self._keeps, self._primitive):
            holds = test(start, stop, period)
            start, stop, period = start[holds], stop[holds], period[holds]
        rows = [x for f in zip(start.tolist(), stop.tolist(), period.tolist()) for x in self._exact(*f)]
        return np.array(rows, np.int64).reshape(-1, 3)


def _octaves(n: int) -> Iterator[int]:
    octave = 1
    while max(LEAST_WORDS, LEAST_PERIODS * octave) <= n:
        yield octave
        octave *= 2


def long_fragments(words: np.ndarray, tile: int = TILE) -> np.ndarray:
    """Fragments of one document, tile by tile. Tiles overlap so far that a stretch is seen wherever it is cut."""
    out = [np.zeros((0, 3), np.int64)]
    for octave in _octaves(len(words)):
        core = max(tile, SPANS * octave)
        for begin in range(0, len(words), core):
            low, high = max(0, begin - 3 * octave), min(len(words), begin + core + 5 * octave)
            found = Tile(words[low:high], low > 0, high < len(words)).fragments(octave)
            out.append(found + np.array([low, low, 0]))
            if high == len(words):
                break
    return np.concatenate(out)


def short_fragments(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(document, fragments) of documents that share a tile."""
    order = np.argsort([-len(t) for t in texts], kind="stable")
    lengths = np.array([len(texts[i]) for i in order], np.int64)
    begin = np.cumsum(lengths + 1) - lengths - 1
    words = np.concatenate([x for k, i in enumerate(order) for x in (texts[i], [-1 - k])]) if texts else np.zeros(0, np.int64)
    found = [np.zeros((0, 3), np.int64)]
    whole = Tile(words)
    for octave in _octaves(int(lengths[0]) if len(lengths) else 0):
        long_enough = int(np.searchsorted(-lengths, -max(LEAST_WORDS, LEAST_PERIODS * octave), "right"))
        found.append(whole.head(int(begin[long_enough - 1] + lengths[long_enough - 1])).fragments(octave))
    rows = np.concatenate(found)
    doc = np.searchsorted(begin, rows[:, 0], "right") - 1
    rows = rows - np.column_stack([begin[doc], begin[doc], np.zeros(len(doc), np.int64)])
    return order[doc], rows


def _numbered(texts: pa.Array) -> tuple[pa.Array, list[np.ndarray]]:
    """The texts with single spaces, and the numbers of their words; equal words, and no others, have equal numbers."""
    cut = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts.cast(pa.string()).fill_null("")))
    plain = pc.binary_join(cut, " ")
    codes = cut.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = cut.offsets.to_numpy()
    parts = [codes[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    return plain, [p if size else p[:0] for p, size in zip(parts, pc.binary_length(plain).to_pylist())]


def text_fragments(texts: pa.Array, tile: int = TILE) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The texts with single spaces, their numbers of words and their fragments."""
    plain, words = _numbered(texts)
    short = [i for i, w in enumerate(words) if len(w) <= tile]
    doc, rows = short_fragments([words[i] for i in short])
    docs, found = [np.array(short, np.int64)[doc] if len(doc) else doc], [rows]
    for i, w in enumerate(words):
        if len(w) > tile:
            found.append(long_fragments(w, tile))
            docs.append(np.full(len(found[-1]), i))
    doc, rows = np.concatenate(docs), np.concatenate(found)
    order = np.argsort(doc, kind="stable")
    start, stop, period = (pa.array(rows[order, k]) for k in range(3))
    ends = np.concatenate([[0], np.cumsum(np.bincount(doc.astype(np.int64), minlength=len(words)))])
    structs = pa.StructArray.from_arrays([period, start, stop], ["period", "start", "stop"])
    return plain, pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)


def _by_size(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about GROUP bytes."""
    size = np.concatenate([[0], np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, size[at] + GROUP, "right")) - 1)
        yield at, to
        at = to


def stitch(fragments: DataFrame) -> DataFrame:
    """(uid, period, start, length) of the runs among fragments (uid, period, start, stop)."""
    before = Window.partitionBy("uid", "period").orderBy("start", "stop")
    reached = F.max("stop").over(before.rowsBetween(Window.unboundedPreceding, -1))
    marked = fragments.withColumn("fresh", (reached.isNull() | (F.col("start") > reached)).cast("int"))
    islands = marked.withColumn("island", F.sum("fresh").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    whole = islands.groupBy("uid", "period", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    length = F.col("stop") - F.col("start") + F.col("period")
    return whole.select("uid", "period", "start", length.alias("length")).filter(
        F.col("length") >= F.greatest(F.lit(LEAST_WORDS), LEAST_PERIODS * F.col("period"))
    )


def _collapsed(texts: pa.Array, runs: pa.Array) -> pa.Array:
    """The texts, words between single spaces, without the words that a run holds after its first period."""
    out = []
    for at, to in _by_size(texts):
        cut = pc.split_pattern(texts.slice(at, to - at), " ")
        words, offsets = cut.flatten(), cut.offsets.to_numpy()
        some = runs.slice(at, to - at)
        edges = np.zeros(len(words) + 1, np.int64)
        spans = some.flatten()
        begin = np.repeat(offsets[:-1], pc.list_value_length(some).to_numpy(zero_copy_only=False))
        start, period, length = (spans.field(n).to_numpy(zero_copy_only=False) for n in ("start", "period", "length"))
        np.add.at(edges, begin + start + period, 1)
        np.add.at(edges, begin + start + length, -1)
        keeps = np.cumsum(edges)[:-1] == 0
        ends = np.concatenate([[0], np.cumsum(keeps)])[offsets]
        out.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.filter(pa.array(keeps))), " "))
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def collapse_runs(docs: DataFrame, text_col: str = "text", tile: int = TILE) -> DataFrame:
    """The documents with `runs`, `n_words` and the text without repetitions; columns of these names are replaced.

    Words are what stands between ASCII white space. `runs` has (start, period, length) in words, by start, then
    period: stretches of smallest period q and max(6, 4 q) words or more that no neighbour prolongs. The text keeps
    the words that no run holds after its first period, joined by single spaces. Null and empty texts have no words,
    no runs and an empty text; rows that repeat are documents of their own; an empty table gives an empty one.
    """
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(*others) if others else F.struct(F.lit(None).cast("int").alias("none"))
    rows = docs.select(row.alias("row"), F.col(text_col).cast("string").alias("text"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, to in _by_size(batch.column(1)):
                found = text_fragments(batch.column(1).slice(at, to - at), tile)
                ids = pa.array(np.arange(uid, uid + to - at))
                uid += to - at
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), ids, *found], ["row", "uid", "text", "n_words", "fragments"]
                )

    schema = f"row {rows.schema['row'].dataType.simpleString()}, uid long, text string, n_words long, fragments {FRAGMENTS}"
    # written once: the numbers of the rows stay, and only texts with fragments are shuffled
    solved = materialise(rows.mapInArrow(solve, schema), "runs")
    some = F.size("fragments") > 0
    runs = stitch(solved.filter(some).select("uid", F.inline("fragments")))
    runs = runs.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    none = F.array().cast("array<struct<start: bigint, period: bigint, length: bigint>>")
    quiet = solved.filter(~some).select("row", "text", "n_words", none.alias("runs"))
    busy = solved.filter(some).join(runs, "uid", "left").withColumn("runs", F.coalesce("runs", none))
    collapsed = F.arrow_udf(_collapsed, "string")
    busy = busy.select("row", collapsed(F.col("text"), F.col("runs")).alias("text"), "n_words", "runs")
    made = ("runs", "n_words")
    columns = [F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in made]
    return quiet.unionByName(busy).select(*columns, *made)

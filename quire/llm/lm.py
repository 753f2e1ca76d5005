"""Language-model scores from an Elias-Fano n-gram trie.

Level 1 holds the hashes of the training words in rising order with their counts; a word's place is its number.
Level 2 holds, for each context word, the numbers of the words seen after it. They are made one rising sequence by
adding, to each context's words, the last value before them; pointers to the contexts' beginnings are a rising
sequence too, and all three are Elias-Fano coded. A bigram is found by successor search among the values of its
context. Its smoothed probability (absolute discounting towards the add-one unigram) and the context's backoff
weight are quantised to one of 256 levels per shard.

Both levels are cut into shards by ranges of word hashes, built by one task each and written to the cluster's shared
folder, where the scoring tasks map them into memory: nothing of the model passes through the driver but its list
of files. The counts that build a shard are combined per task before the shuffle, so frequent words weigh no more
than rare ones.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import materialise, shared_path
from quire.llm.elias_fano import EliasFano
from quire.llm.wordhash import mix, word_hashes

DISCOUNT = 0.75
#: Code points of training text of a shard, about, and the fewest shards.
SHARD_CHARS, LEAST_SHARDS = 16_000_000, 16
#: Distinct n-grams that a counting task holds before it passes their counts on.
HELD = 1 << 21
#: Hash of the token that ends a text; no word has it but by chance.
END = np.uint64(0xE2D0F7E47)
_CONTEXT = np.uint64(32)


def _tokens(texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first, offsets, hashes) with the end token after the words of each text."""
    for first, last, offsets, words in word_hashes(texts):
        n = last - first
        hashes = np.insert(words, offsets[1:], END)
        yield first, np.asarray(offsets, np.int64) + np.arange(n + 1), hashes


def _previous(offsets: np.ndarray, numbers: np.ndarray, start: int) -> np.ndarray:
    """Number of the token before each token; `start` before the first of a text."""
    before = np.concatenate([[start], numbers[:-1]])
    before[offsets[:-1]] = start
    return before


# --- files -----------------------------------------------------------------------------------------------------


def _write(folder: str, name: str, arrays: dict[str, np.ndarray]) -> str:
    from quire.llm.sharedfs import open_fs

    head, at = {}, 0
    for key, a in arrays.items():
        head[key] = (a.dtype.str, at, len(a))
        at += -(-a.nbytes // 8) * 8
    first = json.dumps(head).encode()
    first += b" " * (-len(first) % 8)
    system, path = open_fs(folder)
    system.create_dir(path, recursive=True)
    file = f"{name}-{uuid.uuid4().hex}.level"
    with system.open_output_stream(f"{path}/{file}", compression=None) as out:
        out.write(np.array([len(first)], "<i8").tobytes() + first)
        for a in arrays.values():
            out.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
    return file


def _open(folder: str, file: str) -> dict[str, np.ndarray]:
    from pyarrow import fs

    from quire.llm.sharedfs import open_fs

    system, path = open_fs(folder)
    path = f"{path}/{file}"
    if not isinstance(system, fs.LocalFileSystem):  # a store that cannot be mapped: a copy can
        local = tempfile.NamedTemporaryFile(delete=False)
        with system.open_input_stream(path, compression=None) as source:
            while block := source.read(1 << 22):
                local.write(block)
        local.close()
        path = local.name
    with pa.memory_map(path) as file_:
        raw = file_.read_buffer()
    (length,) = np.frombuffer(raw, "<i8", 1)
    head = json.loads(raw.slice(8, int(length)).to_pybytes())
    base = 8 + int(length)
    return {k: np.frombuffer(raw, np.dtype(t), n, base + at) for k, (t, at, n) in head.items()}


def _named(prefix: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{prefix}.{k}": v for k, v in arrays.items()}


def _part(prefix: str, arrays: dict[str, np.ndarray]) -> EliasFano:
    return EliasFano({k[len(prefix) + 1 :]: v for k, v in arrays.items() if k.startswith(prefix + ".")})


def _pack(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Rising keys as differences with their bytes transposed, and counts; both compressed."""
    steps = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    codec = pa.Codec("zstd", 1)
    return codec.compress(steps.tobytes(), asbytes=True), codec.compress(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)


def _unpack(n: int, keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    codec = pa.Codec("zstd")
    steps = np.frombuffer(codec.decompress(keys, n * 8), np.uint8).reshape(8, n).T
    c = np.frombuffer(codec.decompress(counts, n * 4), np.uint8).reshape(4, n).T
    return np.cumsum(np.ascontiguousarray(steps).view(np.uint64).ravel(), dtype=np.uint64), np.ascontiguousarray(c).view("<u4").ravel()


_SCORES = T.StructType(
    [T.StructField(n, t) for n, t in (("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()))]
)
PACKED = "shard int, n long, keys binary, counts binary"


class _Counter:
    """Counts of 64-bit keys that are passed on as one packed row per shard."""

    def __init__(self, shard_of):
        self.shard_of, self.held, self.size = shard_of, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(np.unique(keys, return_counts=True))
        self.size += len(self.held[-1][0])
        if self.size >= HELD:
            self._combine()
            if self.size >= HELD // 2:
                yield from self.flush()

    def _combine(self) -> None:
        keys, n = _summed(self.held)
        self.held, self.size = [(keys, n)], len(keys)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        self._combine()
        keys, n = self.held[0]
        shard = self.shard_of(keys)
        starts = np.flatnonzero(np.diff(shard, prepend=-1))
        rows = []
        for s, e in zip(starts, np.append(starts[1:], len(keys))):
            rows.append((int(shard[s]), int(e - s), *_pack(keys[s:e], n[s:e])))
        self.held, self.size = [], 0
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["shard", "n", "keys", "counts"])


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[start], np.add.reduceat(n, start)


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    columns = (table.column(c).to_pylist() for c in ("n", "keys", "counts"))
    return _summed([_unpack(*x) for x in zip(*columns)])


# --- the model -------------------------------------------------------------------------------------------------


class Trie:
    """Mapped shards of both levels, by a spec whose files are (first number, level-1 file, level-2 file) per shard."""

    def __init__(self, spec: dict):
        self.spec, self.shards, self.maps = spec, {}, {}
        self.bases = np.array([f[0] for f in spec["files"]], np.int64)
        self.words, self.tokens = spec["words"], spec["tokens"]
        self.start = self.words  # the number before the first token of a text

    def _level(self, shard: int, level: int) -> dict:
        if (shard, level) not in self.maps:
            arrays = _open(self.spec["folder"], self.spec["files"][shard][level])
            parts = {p: _part(p, arrays) for p in (("hash",) if level == 1 else ("pointer", "child"))}
            self.maps[shard, level] = {**arrays, **parts}
        return self.maps[shard, level]

    def _each(self, shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
        for s, e in zip(cuts, np.append(cuts[1:], len(order))):
            yield int(shard[order[s]]), order[s:e]

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, count) of each word hash."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for s, at in self._each(_shard(hashes, self.spec["bits"])):
            if self.spec["files"][s][1] is None:
                continue
            level = self._level(s, 1)
            found = level["hash"].find(hashes[at] - level["first"][0])
            hit = found >= 0
            number[at[hit]], count[at[hit]] = found[hit] + self.bases[s], level["count"][found[hit]]
        return number, count

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count + 1.0) / (self.tokens + self.words + 1.0)

    def counts_of(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), np.int64)
        for s, at in self._each(_owner(self.bases, self.spec, numbers)):
            out[at] = self._level(s, 1)["count"][numbers[at] - self.bases[s]]
        return out

    def bigram(self, context: np.ndarray, word: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log10 probability of words (number or -1, with their counts) after contexts (number or -1)."""
        out = np.log10(self.unigram(count))
        known = np.flatnonzero(context >= 0)
        for s, at in self._each(_owner(self.bases, self.spec, context[known])):
            at = known[at]
            if self.spec["files"][s][2] is None:
                continue
            level = self._level(s, 2)
            local = context[at] - self.bases[s]
            begin = level["pointer"].access(local).astype(np.int64) - local
            before = np.where(begin > 0, level["child"].access(np.maximum(begin - 1, 0)), np.uint64(0))
            seen = np.flatnonzero(word[at] >= 0)
            value = before[seen] + np.uint64(1) + word[at[seen]].astype(np.uint64)
            place = level["child"].find(value)
            # a value beyond the context's own words belongs to a later context
            end = level["pointer"].access(local[seen] + 1).astype(np.int64) - (local[seen] + 1)
            hit = (place >= begin[seen]) & (place < end)
            out[at] += level["weights"][level["weight"][local]]
            out[at[seen[hit]]] = level["values"][level["value"][place[hit]]]
        return out


def _owner(bases: np.ndarray, spec: dict, numbers: np.ndarray) -> np.ndarray:
    """Shard of each word number; the number before a text belongs to the last shard that has words."""
    shard = np.searchsorted(bases, numbers, side="right") - 1
    return np.minimum(shard, spec["last"])


def _shard(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(level of each value, mean of each level): 256 levels of about as many values."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(256)
    edges = np.unique(np.quantile(values, np.linspace(0, 1, 257)[1:-1]))
    level = np.searchsorted(edges, values)
    n = np.bincount(level, minlength=256)
    return level.astype(np.uint8), np.bincount(level, values, 256) / np.maximum(n, 1)


_tries: dict[str, Trie] = {}


def _trie(spec: dict) -> Trie:
    if spec["token"] not in _tries:
        _tries.clear()
        _tries[spec["token"]] = Trie(spec)
    return _tries[spec["token"]]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for _, offsets, hashes in _tokens(batch.column(0).cast(pa.binary()).to_pylist()):
            yield offsets, hashes


def train(docs: DataFrame, text_col: str = "text") -> dict:
    """Build the trie of all texts of `docs` in the shared folder; returns its list of files.

    Null and empty texts are an end token alone. Without rows the model knows no word.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"))
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(LEAST_SHARDS - 1, chars // SHARD_CHARS).bit_length()
    folder = shared_path(spark, "trie")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(lambda keys: _shard(keys, bits))
        for _, hashes in _texts(batches):
            yield from counter.add(hashes)
        yield from counter.flush()

    def build_words(table: pa.Table) -> pa.Table:
        hashes, n = _merged(table)
        shard = table.column("shard")[0].as_py()
        first = shard << (64 - bits)
        # values below 2 ** 63 relative to the shard's first hash
        file = _write(folder, f"words-{shard}", {**_named("hash", EliasFano.build(hashes - np.uint64(first))), "count": n.astype("<u4") if n.max() < 2**32 else n, "first": np.array([first], np.uint64)})
        return pa.Table.from_pylist([{"shard": shard, "file": file, "n": len(hashes), "tokens": int(n.sum())}])

    words = texts.mapInArrow(count_words, PACKED).groupBy("shard").applyInArrow(build_words, "shard long, file string, n long, tokens long")
    listed = {r.shard: r for r in materialise(words, "words").collect()}  # one row per shard
    files, base = [], 0
    for s in range(1 << bits):
        files.append([base, listed[s].file if s in listed else None, None])
        base += listed[s].n if s in listed else 0
    spec = {
        "token": uuid.uuid4().hex, "folder": folder, "bits": bits, "files": files, "words": base,
        "tokens": sum(r.tokens for r in listed.values()), "last": max(listed, default=0),
    }
    if not listed:
        return spec

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(spec)
        counter = _Counter(lambda keys: _owner(trie.bases, spec, (keys >> _CONTEXT).astype(np.int64)))
        for offsets, hashes in _texts(batches):
            distinct, place = np.unique(hashes, return_inverse=True)
            numbers = trie.numbers(distinct)[0][place]
            context = _previous(offsets, numbers, trie.start)
            yield from counter.add((context.astype(np.uint64) << _CONTEXT) | numbers.astype(np.uint64))
        yield from counter.flush()

    def build_pairs(table: pa.Table) -> pa.Table:
        trie, shard = _trie(spec), table.column("shard")[0].as_py()
        keys, n = _merged(table)
        base, size = files[shard][0], listed[shard].n + (shard == spec["last"])
        local, word = (keys >> _CONTEXT).astype(np.int64) - base, (keys & np.uint64(2**32 - 1)).astype(np.int64)
        types, total = np.bincount(local, minlength=size), np.bincount(local, n, size)
        begin = np.concatenate([[0], np.cumsum(types)])
        last = np.where(types > 0, word[np.maximum(begin[1:] - 1, 0)] + 1, 0)
        before = np.concatenate([[0], np.cumsum(last)])[:-1]
        lower = trie.unigram(trie.counts_of(word))
        weight = np.where(types > 0, DISCOUNT * types / np.maximum(total, 1), 1.0)
        p = np.maximum(n - DISCOUNT, 0) / total[local] + weight[local] * lower
        value, values = _quantised(np.log10(p))
        level, levels = _quantised(np.log10(weight))
        file = _write(
            folder,
            f"pairs-{shard}",
            {
                **_named("pointer", EliasFano.build(begin.astype(np.uint64) + np.arange(size + 1, dtype=np.uint64))),
                **_named("child", EliasFano.build((before[local] + word + 1).astype(np.uint64))),
                "value": value, "values": values, "weight": level, "weights": levels,
            },
        )
        return pa.Table.from_pylist([{"shard": shard, "file": file}])

    pairs = texts.mapInArrow(count_pairs, PACKED).groupBy("shard").applyInArrow(build_pairs, "shard long, file string")
    for r in materialise(pairs, "pairs").collect():
        files[r.shard][2] = r.file
    # the numbers of the words stay; a new name makes workers open the second level
    return {**spec, "token": uuid.uuid4().hex}


def score_texts(docs: DataFrame, spec: dict, text_col: str = "text", out_col: str = "lm") -> DataFrame:
    """The documents with `out_col`, a struct of n_tokens, n_known, base_score and score (log10 of the text).

    base_score is the add-one unigram score, exact; score is the trie's. A column of that name is replaced.
    """

    @F.arrow_udf(_SCORES)
    def scored(texts: pa.Array) -> pa.Array:
        trie, raw = _trie(spec), texts.cast(pa.binary()).to_pylist()
        n, known, base, score = (np.zeros(len(raw), t) for t in (np.int64, np.int64, float, float))
        for first, offsets, hashes in _tokens(raw):
            distinct, place = np.unique(hashes, return_inverse=True)
            number, count = trie.numbers(distinct)
            number, count = number[place], count[place]
            context = _previous(offsets, number, trie.start)
            # unknown words are one; each distinct pair is looked up once
            pair, index, back = np.unique(((context + 1).astype(np.uint64) << _CONTEXT) | (number + 1).astype(np.uint64), return_index=True, return_inverse=True)
            p = trie.bigram(context[index], number[index], count[index])[back]
            at = slice(first, first + len(offsets) - 1)
            n[at] = np.diff(offsets)
            known[at] = np.add.reduceat((count > 0).astype(np.int64), offsets[:-1])
            base[at] = np.add.reduceat(np.log10(trie.unigram(count)), offsets[:-1])
            score[at] = np.add.reduceat(p, offsets[:-1])
        return pa.StructArray.from_arrays([pa.array(x) for x in (n, known, base, score)], ["n_tokens", "n_known", "base_score", "score"])

    return docs.withColumn(out_col, scored(F.col(text_col)))


def held_out(id_col: Column) -> Column:
    """Documents the model is not trained on: crc32 of the id as text has remainder 2 by 7; a null id counts as ''."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 7 == 2

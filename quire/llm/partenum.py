"""N-gram Jaccard join by PartEnum signatures.

A document's set is its distinct word shingles. Sets fall into bands of sizes. Two sets of a band that are similar
enough differ in at most k features; the feature domain is split at the first level into N1 parts, each into three
subparts, and every pair of subparts of a part is a signature. At most k // 2 parts hold two differences or more, so
at least 1 + SLACK of the parts agree in a pair of subparts: similar sets share a signature. A set whose larger
partners can lie in the next band has that band's signatures too.

A set's cells are four bits of each subpart's sum: two sets differ in at least as many features as they differ in
cells, so a pair that differs in more cells than two similar sets of their sizes can is no link. Sets that share a signature and pass this test form
candidate clusters; within a cluster all pairs are compared exactly, block by block, and only a spanning forest of
the links leaves a task. Documents with equal sets travel as one. To find the shared signatures, a task ties the sets that share one among its own documents and passes on one
of them, so a signature that very many sets share reaches a shard once per task.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import WORD, components, materialise, release_memory
from quire.llm.wordhash import mix, word_hashes

#: Parts beyond k // 2 + 1. A set in which more parts than this have an empty pair of subparts signs these as well.
SLACK = 1
#: Sets of a block within a cluster, and features compared at once.
BLOCK, COLUMNS = 128, 8192
#: Bits of a cell.
PLANES = 4
#: Bits of the filters that keep texts and signatures in question; their size is fixed, false hits only cost time.
FILTER_BITS = 1 << 27
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Signatures a task holds before it passes them on; code points of text of a shard of signatures, and fewest shards.
HELD = 1 << 20
SHARD_CHARS, LEAST_SHARDS = 16_000_000, 16
#: Signatures of a shard of cells, shared or not, and fewest such shards of a band. A set's cells are in a shard once
#: for all its signatures there, so shards of one band repeat fewer of them than shards of all bands.
CELL_SIGNATURES, LEAST_CELL_SHARDS = 1 << 22, 1
#: Shard number of the rows that hold what is shared within a task.
TIES = -1
SIGNED = "id long, text_hash long, n long, name long, shard int, sigs binary, places binary, names binary"


@dataclass(frozen=True)
class Bands:
    """Size bands for a similarity in percent; the bands' upper ends grow by the cube of its inverse."""

    percent: int

    def ends(self) -> np.ndarray:
        ends, low = [], 1
        while low < 1 << 40:
            ends.append(max(low, int(low * (100 / self.percent) ** 3)))
            low = ends[-1] + 1
        return np.array(ends, np.int64)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends(), sizes)

    def differences(self, bands: np.ndarray) -> np.ndarray:
        """Most differing features of two similar sets whose larger one lies in the band."""
        return 2 * self.ends()[bands] * (100 - self.percent) // (100 + self.percent)

    def parts(self, bands: np.ndarray) -> np.ndarray:
        return self.differences(bands) // 2 + 1 + SLACK

    def column(self, size: Column) -> Column:
        """`of` a column of sizes."""
        ends = F.array(*[F.lit(end).cast("long") for end in self.ends().tolist()])
        return F.size(F.filter(ends, lambda end: end < size))


def shingle_sets(texts: list[bytes | None], width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than `width` are one shingle, no words none."""
    for first, last, offsets, words in word_hashes(texts):
        n = len(words) - width + 1
        rolled = np.zeros(max(n, 0), np.uint64)
        for j in range(width):
            if n > 0:
                rolled = mix(rolled + words[j : j + n], 3 + j)
        for t in range(last - first):
            start, end = int(offsets[t]), int(offsets[t + 1])
            if end - start >= width:
                yield np.unique(rolled[start : end - width + 1])
            elif end > start:
                h = np.zeros(1, np.uint64)
                for j in range(start, end):
                    h = mix(h + words[j], 100 + (end - start))
                yield h
            else:
                yield np.zeros(0, np.uint64)


def set_name(features: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    return int(mix(np.array([mix(features, 50).sum(dtype=np.uint64) + np.uint64(len(features))]), 51).view(np.int64)[0])


def signatures(sets: list[np.ndarray], percent: int) -> list[list[tuple[np.ndarray, int, bytes]]]:
    """Per set and band: signatures as 64-bit values, the band's number, and the cells as bit planes."""
    bands, sizes = Bands(percent), np.array([len(s) for s in sets], np.int64)
    lowest, highest = bands.of(sizes), bands.of(sizes * 100 // percent)
    jobs = [(i, b) for i in np.flatnonzero(sizes).tolist() for b in range(lowest[i], highest[i] + 1)]
    out: list[list[tuple[np.ndarray, int, bytes]]] = [[] for _ in sets]
    k = bands.differences(np.array([b for _, b in jobs], np.int64)) if jobs else np.zeros(0, np.int64)
    jobs = [j for j, x in zip(jobs, k) if x]  # without a difference only equal sets are similar
    if not jobs:
        return out
    parts = bands.parts(np.array([b for _, b in jobs], np.int64))
    offset = np.concatenate([[0], np.cumsum(parts * 3)])
    features = np.concatenate([sets[i] for i, _ in jobs])
    lengths = sizes[[i for i, _ in jobs]]
    sub = (mix(features, 60) % np.repeat(parts * 3, lengths).astype(np.uint64)).astype(np.int64) + np.repeat(offset[:-1], lengths)
    sums, n = np.zeros(offset[-1], np.uint64), np.bincount(sub, minlength=offset[-1]).reshape(-1, 3)
    np.add.at(sums, sub, mix(features, 61))
    sums = sums.reshape(-1, 3)
    band = np.repeat(np.array([b for _, b in jobs], np.uint64), parts)
    begin = np.concatenate([[0], np.cumsum(parts)])
    number = (np.arange(begin[-1]) - np.repeat(begin[:-1], parts)).astype(np.uint64)
    signed, empty = [], []
    for p, (a, b) in enumerate(PAIRS):
        place = mix(mix(number + np.uint64(1), 70 + p) + band, 73)
        signed.append(mix(mix(sums[:, a], 74) + place, 75) + mix(sums[:, b], 76))
        empty.append((n[:, a] + n[:, b]) == 0)
    signed, empty = np.stack(signed, 1), np.stack(empty, 1)
    open_ = np.add.reduceat(empty.any(1).astype(np.int64), begin[:-1]) > SLACK
    keep = ~empty | np.repeat(open_, parts)[:, None]
    cell = mix(sums.reshape(-1), 78) >> np.uint64(20)
    planes = [(cell & np.uint64(1 << b)).astype(bool) for b in range(PLANES)]
    for j, (i, b) in enumerate(jobs):
        rows, cells = slice(begin[j], begin[j + 1]), slice(offset[j], offset[j + 1])
        packed = b"".join(np.packbits(plane[cells]).tobytes() for plane in planes)
        out[i].append((mix(signed[rows][keep[rows]], 77), b, packed))
    return out


def _binary(texts: pa.Array) -> list[bytes | None]:
    return texts.cast(pa.binary()).to_pylist()


def _transposed(x: np.ndarray) -> bytes:
    return pa.Codec("zstd", 1).compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), asbytes=True)


def _restored(raw: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    plain = pa.Codec("zstd").decompress(raw, n * size)
    return np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(size, n).T).view(kind).ravel()


def _runs(sigs: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct signatures in order, a name for each, the names and signatures of sets that share one)."""
    order = np.argsort(sigs)
    sigs, names = sigs[order], names[order]
    first = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]]))
    leader = np.repeat(names[first], np.diff(np.append(first, len(sigs))))
    apart = np.flatnonzero(leader != names)
    shared = np.unique(np.concatenate([leader[apart], names[apart]]))
    return sigs[first], names[first], shared, np.unique(sigs[apart])


def _packed(sigs: list[np.ndarray], names: list[int], bits: int) -> pa.RecordBatch:
    """One row per shard, and one with the names and signatures shared within."""
    distinct, leader, shared, ties = _runs(np.concatenate(sigs), np.repeat(np.array(names, np.int64), [len(x) for x in sigs]))
    shard = (distinct >> np.uint64(64 - bits)).astype(np.int64)
    start = np.flatnonzero(np.diff(shard, prepend=-1))
    rows = [(len(ties), TIES, ties.tobytes(), None, shared.tobytes())]
    for s, e in zip(start, np.append(start[1:], len(shard))):
        known, place = np.unique(leader[s:e], return_inverse=True)
        steps = np.diff(distinct[s:e], prepend=np.uint64(0))
        rows.append((e - s, shard[s], _transposed(steps), _transposed(place.astype(np.uint32)), known.tobytes()))
    n, shards, *binary = zip(*rows)
    none = pa.nulls(len(rows), pa.int64())
    columns = [none, none, pa.array(n, pa.int64()), none, pa.array(shards, pa.int32()), *[pa.array(x, pa.binary()) for x in binary]]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SIGNED.split(", ")])


def signed_documents(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(id, text_hash, n, name) of every row, name null for an empty set; rows with a shard hold signatures instead."""
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    bits = max(LEAST_SHARDS - 1, chars // SHARD_CHARS).bit_length()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        sigs, owners, held = [], [], 0
        for batch in batches:
            start, sets, features = 0, [], 0
            for i, found in enumerate(shingle_sets(_binary(batch.column(2)), width)):
                sets.append(found)
                features += len(found)
                if features < 200_000 and i + 1 < batch.num_rows:
                    continue
                names = [set_name(x) if len(x) else None for x in sets]
                none = pa.nulls(len(sets), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(start, len(sets)) for c in (0, 1)),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array(names, pa.int64()),
                        pa.nulls(len(sets), pa.int32()),
                        none,
                        none,
                        none,
                    ],
                    [x.split()[0] for x in SIGNED.split(", ")],
                )
                new = {n: x for n, x in zip(names, sets) if n is not None}  # equal sets sign once
                for name, bands in zip(new, signatures(list(new.values()), percent)):
                    for x, *_ in bands:
                        sigs.append(x)
                        owners.append(name)
                        held += len(x)
                start, sets, features = start + len(sets), [], 0
                if held >= HELD:
                    yield _packed(sigs, owners, bits)
                    sigs, owners, held = [], [], 0
        if held:
            yield _packed(sigs, owners, bits)

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(sign, SIGNED)


def _shared(written: DataFrame) -> DataFrame:
    """(what, value): names of sets that share a signature (0), and the shared signatures (1)."""

    def rows(names: np.ndarray, sigs: np.ndarray) -> list[pa.Array]:
        what = np.concatenate([np.zeros(len(names), np.int32), np.ones(len(sigs), np.int32)])
        return [pa.array(what), pa.array(np.concatenate([names, sigs.view(np.int64)]))]

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sigs, names in zip(batch.column(0), batch.column(1)):
                sigs, names = np.frombuffer(sigs.as_buffer(), np.uint64), np.frombuffer(names.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays(rows(names, sigs), ["what", "value"])

    def between(table: pa.Table) -> pa.Table:
        release_memory()
        sigs, names = [], []
        for n, s, p, known in zip(*(table.column(c).to_pylist() for c in ("n", "sigs", "places", "names"))):
            sigs.append(np.cumsum(_restored(s, n, np.uint64), dtype=np.uint64))
            names.append(np.frombuffer(known, np.int64)[_restored(p, n, np.uint32)])
        *_, shared, tied = _runs(np.concatenate(sigs), np.concatenate(names))
        return pa.table(rows(shared, tied), names=["what", "value"])

    own = written.filter(F.col("shard") == TIES).select("sigs", "names").mapInArrow(within, "what int, value long")
    packed = written.filter(F.col("shard") > TIES).select("shard", "n", "sigs", "places", "names")
    return materialise(own.union(packed.groupBy("shard").applyInArrow(between, "what int, value long")), "shared")


class _Filter:
    """A bit per hash value: no member is missed, others hit by chance."""

    def __init__(self, values: DataFrame):
        slot = F.pmod("value", F.lit(FILTER_BITS)) + 1
        bits = values.select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("bit"))
        self.table = np.zeros(FILTER_BITS // 8, np.uint8)
        for r in bits.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map")).collect():  # FILTER_BITS in all
            at = (r["bucket"] - 1) * 4096
            self.table[at : at + 4096] = np.frombuffer(bytes(r["map"]), np.uint8)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        slot = values.astype(np.int64) % FILTER_BITS
        return (self.table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _chosen_sets(docs: DataFrame, text_col: str, width: int, signed: DataFrame, names: DataFrame):
    """(texts, function over their batches): the sets of about these names, each once per task.

    Of the texts of a name those with the smallest hash are taken; they are found by a filter of fixed size.
    """
    chosen = signed.join(names, "name").groupBy("name").agg(F.min("text_hash").alias("value"))
    sent = docs.sparkSession.sparkContext.broadcast(_Filter(chosen))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
        release_memory()
        seen: set[int] = set()
        for batch in batches:
            texts = batch.column(1).filter(pa.array(sent.value(batch.column(0).to_numpy())))
            found: dict[int, np.ndarray] = {}
            held = 0
            for x in shingle_sets(_binary(texts), width):
                if len(x) and (name := set_name(x)) not in seen:
                    seen.add(name)
                    found[name] = x
                    held += len(x)
                if held >= 200_000:
                    yield list(found), list(found.values())
                    found, held = {}, 0
            if found:
                yield list(found), list(found.values())
            if len(seen) > 100_000:
                seen.clear()

    texts = docs.select(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).alias("text"))
    return texts, sets


def _in_blocks(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Rows with (key, low, high, block): every two rows of a key meet under one (key, low, high), sorted by it."""
    counts = materialise(rows.groupBy(key).agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"), F.count("*").alias("rows")), "sizes")
    held = rows.join(counts.filter("rows > 1").drop("rows"), key)
    held = held.withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = held.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", "blocks")
    return held.repartition(key, "low", "high").sortWithinPartitions(key, "low", "high")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, low, high) and the rows under it that follow each other; the first four columns are these and block."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            if key != row[:3]:
                if len(held) > 1:
                    yield key, held
                key, held = row[:3], []
            held.append(row[3:])
    if len(held) > 1:
        yield key, held


def _forest(pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for x, y in pairs:
        rx, ry = find(x), find(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            kept.append((x, y))
    return kept


class _Sets:
    """Components of numbered sets while links are added."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def of(self, some: np.ndarray) -> np.ndarray:
        root = self.root[some]
        while (root != self.root[root]).any():
            root = self.root[root]
        self.root[some] = root
        return root

    def join(self, roots: np.ndarray) -> None:
        self.root[roots] = roots.min()


def _flat(rows: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values) of a binary column, without an object for each row."""
    _, offsets, data = rows.buffers()
    offsets = np.frombuffer(offsets, np.int32)[rows.offset : rows.offset + len(rows) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return np.diff(offsets) // np.dtype(kind).itemsize, raw[offsets[0] : offsets[-1]].copy().view(kind)


def _joined(pieces: list[np.ndarray]) -> np.ndarray:
    out = np.concatenate(pieces)
    pieces.clear()  # what is joined is not held twice
    return out


def cell_shards(sizes: DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Per band the number of its shards of cells and the number of its first one, for the sets' sizes (n)."""
    bands = Bands(percent)
    low, high = bands.column(F.col("n")), bands.column(F.expr(f"n * 100 div {percent}"))
    sets = np.zeros(len(bands.ends()), np.int64)
    for r in sizes.groupBy(low.alias("low"), high.alias("high")).count().collect():  # a row or two per band
        sets[r["low"] : r["high"] + 1] += r["count"]
    signed = sets * bands.parts(np.arange(len(sets))) * len(PAIRS)
    shards = np.maximum(LEAST_CELL_SHARDS, -(-signed // CELL_SIGNATURES))
    return shards, np.cumsum(shards) - shards


def close_sets(starts: np.ndarray, sigs: np.ndarray, n: np.ndarray, places: np.ndarray, cells: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Ties that connect all pairs of sets which share a signature and are within the bounds of sizes and cells.

    Set i has the signatures from starts[i] to starts[i + 1], and the cells from places[i] to places[i + 1]. Pairs
    that are connected already are not compared again.
    """
    order = np.argsort(sigs, kind="stable")
    owner, sig = np.repeat(np.arange(len(n), dtype=np.int32), np.diff(starts))[order], sigs[order]
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    end = np.append(start[1:], len(sig))
    several = end - start > 1
    start, end, wide = start[several], end[several], np.diff(places)
    del order, sig
    joined, ties, seen = _Sets(len(n)), [], set()
    for s, e in zip(start.tolist(), end.tolist()):
        run = np.unique(owner[s:e]).astype(np.int64)
        if len(run) < 2 or (known := hashlib.blake2b(run, digest_size=16).digest()) in seen:
            continue  # the same sets were compared under another signature
        seen.add(known)
        width = wide[run[0]]
        run = run[wide[run] == width]  # another length is another band
        planes = cells[places[run][:, None] + np.arange(width)].reshape(len(run), PLANES, -1)
        for i in range(len(run) - 1):
            roots = joined.of(run[i:])
            rest = i + np.flatnonzero(roots != roots[0])
            if not len(rest):
                continue
            size, sizes = n[run[i]], n[run[rest]]
            rest = rest[np.minimum(size, sizes) * 100 >= np.maximum(size, sizes) * percent]
            differ = np.bitwise_count(np.bitwise_or.reduce(planes[rest] ^ planes[i], 1)).sum(1, dtype=np.int64)
            close = rest[differ <= (size + n[run[rest]]) * (100 - percent) // (100 + percent)]
            if len(close):
                _, one = np.unique(joined.of(run[close]), return_index=True)  # a tie to each component is enough
                ties += [(int(run[i]), int(run[j])) for j in close[one]]
                joined.join(np.append(joined.of(run[close]), roots[0]))
    return ties


def candidate_clusters(docs: DataFrame, text_col: str, width: int, percent: int, written: DataFrame, signed: DataFrame) -> DataFrame:
    """(node, root): names that are connected by shared signatures and close cells."""
    shared = _shared(written)
    names = materialise(shared.filter("what = 0").select(F.col("value").alias("name")).distinct(), "names")
    texts, sets = _chosen_sets(docs, text_col, width, signed, names)
    tied = docs.sparkSession.sparkContext.broadcast(_Filter(shared.filter("what = 1").select("value")))

    distinct = signed.join(names, "name").select("name", "n").distinct()
    count, first = cell_shards(distinct, percent)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for of, features in sets(batches):
            rows = []
            for name, x, bands in zip(of, features, signatures(features, percent)):
                for sigs, band, packed in bands:
                    sigs = np.sort(sigs[tied.value(sigs.view(np.int64))])
                    # the upper half of a signature, scaled to the number of shards, keeps their order
                    shard = first[band] + ((sigs >> np.uint64(32)).astype(np.int64) * count[band] >> 32)
                    cut = np.flatnonzero(np.diff(shard, prepend=-1))
                    for s, e in zip(cut, np.append(cut[1:], len(sigs))):
                        rows.append((int(shard[s]), name, len(x), packed, sigs[s:e].tobytes()))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["shard", "name", "n", "cells", "sigs"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        held: list[list[np.ndarray]] = [[] for _ in range(6)]
        for batch in batches:
            columns = [batch.column(c).to_numpy().copy() for c in ("name", "n")]
            for c, kind in (("cells", np.uint8), ("sigs", np.uint64)):
                columns += _flat(batch.column(c), kind)
            for pieces, column in zip(held, columns):
                pieces.append(column)
        names, n, wide, planes, signed_by, sigs = map(_joined, held)
        once = np.unique(names, return_index=True)[1]
        if len(once) < len(names):  # a name may come from several tasks
            one = np.zeros(len(names), bool)
            one[once] = True
            planes, sigs = planes[np.repeat(one, wide)], sigs[np.repeat(one, signed_by)]
            names, n, wide, signed_by = names[one], n[one], wide[one], signed_by[one]
        starts, places = (np.concatenate([[0], np.cumsum(x)]) for x in (signed_by, wide))
        ties = np.array(close_sets(starts, sigs, n.astype(np.int64), places, planes, percent), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(names[ties[:, c]]) for c in (0, 1)], ["a", "b"])

    rows = texts.mapInArrow(cells, "shard int, name long, n int, cells binary, sigs binary")
    return materialise(components(rows.groupBy("shard").applyInArrow(close, "a long, b long")), "clusters")


def _candidate_sets(docs: DataFrame, text_col: str, width: int, signed: DataFrame, clusters: DataFrame) -> DataFrame:
    """(root, name, features): one row per name of a cluster, its sorted feature hashes packed."""
    clusters = clusters.withColumnRenamed("node", "name")
    texts, sets = _chosen_sets(docs, text_col, width, signed, clusters.select("name"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, features in sets(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array([x.tobytes() for x in features], pa.binary())], ["name", "features"]
            )

    found = texts.mapInArrow(packed, "name long, features binary")
    return found.join(clusters, "name").groupBy("root", "name").agg(F.first("features").alias("features"))


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of similar sets, between the two lists or within the first; every pair is compared."""
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets])
    _, feature = np.unique(np.concatenate(sets), return_inverse=True)
    row, shared = np.repeat(np.arange(len(sets)), sizes), np.zeros((len(left), len(right or left)), np.float32)
    order = np.argsort(feature, kind="stable")
    feature, row = feature[order], row[order]
    for start in range(0, int(feature[-1]) + 1, COLUMNS):
        s, e = np.searchsorted(feature, [start, start + COLUMNS])
        dense = np.zeros((len(sets), COLUMNS), np.float32)
        dense[row[s:e], feature[s:e] - start] = 1
        shared += dense[: len(left)] @ dense[len(left) if right else 0 :].T
    inter = shared.astype(np.int64)
    union = sizes[: len(left), None] + sizes[None, len(left) if right else 0 :] - inter
    similar = 100 * inter >= percent * union
    return np.nonzero(similar if right else np.triu(similar, 1))


def verified_links(members: DataFrame, percent: int) -> DataFrame:
    """(a, b, links) from (root, name, features): a forest of the links between names, and (name, null, its links)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for (_, low, high), held in _groups(batches):
            sets = [(block, name, np.frombuffer(raw, np.uint64)) for block, name, raw in held]
            one = [(n, x) for b, n, x in sets if b == low]
            two = one if low == high else [(n, x) for b, n, x in sets if b == high]
            if not one or not two:
                continue
            a, b = linked([x for _, x in one], None if low == high else [x for _, x in two], percent)
            pairs = [(one[i][0], two[j][0]) for i, j in zip(a.tolist(), b.tolist())]
            degree = Counter(x for pair in pairs for x in pair)
            rows = [(x, y, 0) for x, y in _forest(iter(pairs))] + [(x, None, n) for x, n in degree.items()]
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "links"])

    blocks = _in_blocks(materialise(members, "members"), "root", BLOCK)
    return blocks.select("root", "low", "high", "block", "name", "features").mapInArrow(compare, "a long, b long, links long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Per row: id, text_hash, n_shingles, component_id, n_links, root (the component's name, null without words).

    Sets of `width`-word shingles with A-Z lower-cased are linked at 100 * intersection >= percent * union.
    component_id is the smallest id that links reach; n_links counts the different sets a row's set is linked
    with (rows of equal sets are in one component and count once). Rows without words, null texts included, are
    linked with nothing and keep their own id. Null ids are never the smallest unless all are null.
    """
    written = materialise(signed_documents(docs, id_col, text_col, width, percent), "signed")
    signed = written.filter("shard IS NULL").select("id", "text_hash", "n", "name")
    clusters = candidate_clusters(docs, text_col, width, percent, written, signed)
    found = materialise(verified_links(_candidate_sets(docs, text_col, width, signed, clusters), percent), "links")
    roots = materialise(components(found.filter("b IS NOT NULL").select("a", "b")), "roots")
    degrees = found.filter("b IS NULL").groupBy("a").agg(F.sum("links").alias("n_links"))
    names = signed.filter("n > 0").groupBy("name").agg(F.min("id").alias("least"))
    names = names.join(roots, F.col("name") == F.col("node"), "left").join(degrees, F.col("name") == F.col("a"), "left")
    names = materialise(names.select("name", "least", F.coalesce("root", "name").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "names")
    least = materialise(names.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    names = materialise(names.join(least, "root").select("name", "root", "component_id", "n_links"), "names")
    # rows without a set look nothing up, so they take no part in the join
    some = signed.filter("n > 0").join(names, "name").select("id", "text_hash", "n", "component_id", "n_links", "root")
    none = signed.filter("n = 0").select("id", "text_hash", "n", F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("root"))
    return some.union(none).withColumnRenamed("id", id_col).withColumnRenamed("n", "n_shingles")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near duplicates: of each component the row with the smallest id stays.

    Null ids come last; of rows that share the id, the smallest text hash decides, and of rows that repeat both one
    stays. Rows without words all stay. The columns are those of `docs`.
    """
    joined = materialise(jaccard_components(docs, id_col, text_col, width, percent), "joined").filter("root IS NOT NULL")
    key = [F.col(id_col).isNull().alias("absent"), F.coalesce(F.col(id_col), F.lit(0)).cast("long").alias("id"), F.col("text_hash")]
    stay = joined.groupBy("root").agg(F.min(F.struct(*key)).alias("k")).select("k.*")
    stay = materialise(stay, "stay")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = ["absent", "id", "text_hash"]
    rows = docs.select(
        F.struct(F.col("*")).alias("row"), key[0], key[1], F.xxhash64(text).alias("text_hash"), text.rlike(WORD).alias("worded")
    )
    kept = rows.filter("worded").join(stay, keys, "left_semi")
    repeated = joined.groupBy(*[k.alias(n) for k, n in zip(key, keys)]).count().filter("count > 1").join(stay, keys, "left_semi")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates(keys)
    return kept.select("row.*").union(rows.filter("NOT worded").select("row.*"))

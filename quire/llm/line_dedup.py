"""Removal of lines that many documents share, by a sharded minimal perfect hash.

Documents per line key are counted with sums that are combined per batch before the shuffle. The keys found in at
least `least` documents are spread over shards by their hash; each shard is a minimal perfect hash with an array
of fingerprints and one of counts. Documents are then read once more and probe these arrays, so no line is
shuffled to be joined. Shards are sent to the workers in blocks of at most BLOCK_BYTES; beyond one block, the
documents are passed once per block.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialise, release_memory

SPACES = b" \t\n\x0b\x0c\r"
#: Keys of a shard, on average.
SHARD_KEYS = 1 << 16
#: Most bytes of the arrays that are sent to the workers at once.
BLOCK_BYTES = 64 << 20
#: Line keys that a counting task holds before it passes their sums on.
HELD = 200_000
LEVELS, SLACK = 32, 2


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends and with A-Z in lower case."""
    return line.strip(SPACES).lower()


def _hashes(keys: list[bytes]) -> np.ndarray:
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<u8").reshape(-1, 2)


def _mixed(x: np.ndarray, level: int) -> np.ndarray:
    x = x ^ np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: per level a bit for each slot that one key alone has taken."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest  # slots per level, words of all levels, keys left over
        ones = np.bitwise_count(bits).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, words = [], []
        for level in range(LEVELS):
            if not len(keys):
                break
            size = -(-max(64, SLACK * len(keys)) // 64) * 64
            slot = (_mixed(keys, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(slot, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            keys = keys[~alone[slot]]
        return cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, "<u8"), np.sort(keys))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """A number below the count of keys for each key of the set; -1 or any such number for others."""
        out = np.full(len(keys), -1, np.int64)
        open_, start = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            bit = start + (_mixed(keys[open_], level) % np.uint64(size)).astype(np.int64)
            word, offset = self.bits[bit >> 6], (bit & 63).astype(np.uint64)
            hit = (word >> offset) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << offset) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = (self.before[bit >> 6] + below)[hit]
            open_ = open_[~hit]
            start += size
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[at] == keys[open_]
            out[open_[hit]] = self.before[-1] + at[hit]
        return out


def line_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(h1, h2, n): documents that hold each line key of at least one code point; h1 and h2 are its 128-bit hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                held.update({line_key(line) for line in (text or b"").split(b"\n")})
                if len(held) >= HELD:
                    yield sums(held)
        yield sums(held)

    def sums(held: Counter) -> pa.RecordBatch:
        held.pop(b"", None)
        h, n = _hashes(list(held)), np.fromiter(held.values(), np.int64, len(held))
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(h[:, 0].copy().view("<i8")), pa.array(h[:, 1].copy().view("<i8")), pa.array(n)], ["h1", "h2", "n"]
        )

    parts = docs.select(text_col).mapInArrow(count, "h1 long, h2 long, n long")
    return parts.groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def build_shards(counts: DataFrame) -> DataFrame:
    """(shard, width, sizes, bits, rest, prints, counts): arrays of the line keys in `counts` (h1, h2, n).

    The leading `width` bits of h1 are a key's shard.
    """
    total = counts.count()
    shards = 1 << max(0, (total // SHARD_KEYS).bit_length())
    width = shards.bit_length() - 1

    def build(table: pa.Table) -> pa.Table:
        h1, h2 = (table.column(c).to_numpy().view("<u8") for c in ("h1", "h2"))
        hashed = PerfectHash.build(h1)
        at = hashed.index(h1)
        prints, n = np.zeros(len(h1), "<u8"), np.zeros(len(h1), "<u4")
        prints[at], n[at] = h2, np.minimum(table.column("n").to_numpy(), 2**32 - 1)
        arrays = [hashed.sizes, hashed.bits, hashed.rest, prints, n]
        return pa.table(
            [pa.array([table.column("shard")[0].as_py()], pa.int32()), pa.array([width], pa.int32()), *[pa.array([a.tobytes()]) for a in arrays]],
            names=["shard", "width", "sizes", "bits", "rest", "prints", "counts"],
        )

    shard = F.shiftrightunsigned("h1", 64 - width).cast("int") if width else F.lit(0)
    return counts.withColumn("shard", shard).groupBy("shard").applyInArrow(
        build, "shard int, width int, sizes binary, bits binary, rest binary, prints binary, counts binary"
    )


class Probe:
    """Arrays of some shards; others hold none of the keys asked for."""

    def __init__(self, rows: list[tuple]):
        self.shards = {}
        for shard, sizes, bits, rest, prints, n in rows:
            hashed = PerfectHash(np.frombuffer(sizes, "<i8"), np.frombuffer(bits, "<u8"), np.frombuffer(rest, "<u8"))
            self.shards[shard] = hashed, np.frombuffer(prints, "<u8"), np.frombuffer(n, "<u4")

    def counts(self, h: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        shard = (h[:, 0] >> np.uint64(64 - width)).astype(np.int64) if width else np.zeros(len(h), np.int64)
        for s in np.unique(shard).tolist():
            if s not in self.shards:
                continue
            hashed, prints, n = self.shards[s]
            of = np.flatnonzero(shard == s)
            at = hashed.index(h[of, 0])
            found = at >= 0
            found[found] = prints[at[found]] == h[of[found], 1]
            out[of[found]] = n[at[found]]
        return out


def drop_common_lines(docs: DataFrame, text_col: str = "text", least: int = 10) -> DataFrame:
    """The documents without the lines whose key is found in at least `least` documents.

    A text is cut at line feeds; null and empty texts are one empty line. A key is the line without ASCII white
    space at its ends and with A-Z lower-cased; empty keys always stay. Each row counts as a document. The columns
    n_lines (before) and n_dropped are added, or replaced if the table has columns of these names; a null text
    becomes an empty one.
    """
    shards = materialise(build_shards(materialise(line_counts(docs, text_col).filter(F.col("n") >= least), "lines")), "shards")
    arrays = ("sizes", "bits", "rest", "prints", "counts")
    sizes = shards.select("shard", "width", sum((F.octet_length(c) for c in arrays), F.lit(0)).alias("bytes")).collect()
    width = sizes[0].width if sizes else 0
    blocks, held = [[]], 0
    for s in sorted(sizes):
        if held and held + s.bytes > BLOCK_BYTES:
            blocks.append([])
            held = 0
        blocks[-1].append(s.shard)
        held += s.bytes
    out = docs.withColumn("n_lines", F.lit(None).cast("long")).withColumn("n_dropped", F.lit(0).cast("long"))
    for i, block in enumerate(blocks):
        out = out if i == 0 else materialise(out, "lines")
        rows = [tuple(r) for r in shards.filter(F.col("shard").isin(block)).drop("width").collect()] if block else []
        out = _probed(out, text_col, rows, width)
    return out


def _probed(docs: DataFrame, text_col: str, rows: list[tuple], width: int) -> DataFrame:
    sent, token = docs.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex
    made = f"cleaned_{token}"

    @F.arrow_udf("text string, n_lines long, n_dropped long")
    def cleaned(texts: pa.Array) -> pa.Array:
        probe = _probe(token, sent.value)
        lines = [(t or b"").split(b"\n") for t in texts.cast(pa.binary()).to_pylist()]
        keys = [line_key(x) for doc in lines for x in doc]
        common = (probe.counts(_hashes(keys), width) > 0).tolist() if keys else []
        kept, n, dropped, at = [], [], [], 0
        for doc in lines:
            stays = [x for x, gone, key in zip(doc, common[at : at + len(doc)], keys[at : at + len(doc)]) if not (gone and key)]
            at += len(doc)
            kept.append(b"\n".join(stays))
            n.append(len(doc))
            dropped.append(len(doc) - len(stays))
        release_memory()
        return pa.StructArray.from_arrays(
            [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())],
            ["text", "n_lines", "n_dropped"],
        )

    done = docs.withColumn(made, cleaned(F.col(text_col)))
    return done.withColumns(
        {
            text_col: F.col(f"{made}.text"),
            "n_lines": F.coalesce("n_lines", f"{made}.n_lines"),
            "n_dropped": F.col("n_dropped") + F.col(f"{made}.n_dropped"),
        }
    ).drop(made)


_built: dict[str, Probe] = {}


def _probe(token: str, rows: list[tuple]) -> Probe:
    """One block's arrays at a time stay in a worker."""
    if token not in _built:
        _built.clear()
        _built[token] = Probe(rows)
    return _built[token]

"""Packing against a plain version of the method, the tokenizers library and the rules of a packing."""

import heapq
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import packing
from quire.llm.bpe import Codec
from quire.llm.queries import QUERIES, _tokenizer


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(_tokenizer())


def plain_differencing(sizes, windows):
    """The method on whole tuples of sums; returns the sums, fullest first."""
    heap = [(-s, i, [s] + [0] * (windows - 1)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = sorted((x + y for x, y in zip(a, b[::-1])), reverse=True)
        heapq.heappush(heap, (both[-1] - both[0], n, both))
        n += 1
    return heap[0][2]


@pytest.mark.parametrize("seed", range(6))
def test_differencing(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(1, 300) for _ in range(rng.randrange(1, 60))]
    windows = rng.randrange(1, 12)
    got = packing.differencing(np.array(sizes), windows)
    assert sorted(i for w in got for i in w) == list(range(len(sizes)))
    sums = sorted((sum(sizes[i] for i in w) for w in got), reverse=True)
    assert sums + [0] * (windows - len(sums)) == plain_differencing(sizes, windows)


def test_the_number_of_windows_rises():
    sizes = np.array([60] * 10)  # six windows of 100 would do by the total, but two items exceed one
    assert [len(w) for w in packing.balanced(sizes, 100)] == [1] * 10
    many = np.random.default_rng(0).integers(1, 400, 3000)
    windows = packing.balanced(many, 4096)
    sums = np.array([many[w].sum() for w in windows])
    assert sums.max() <= 4096 and sums.max() - sums.min() < 100


def rules(lengths, pieces, sequences, capacity):
    """Every token lies in one piece, sequences have no gap and are full or of a power of two."""
    covered, filled = defaultdict(list), defaultdict(list)
    for doc, start, length, sequence, offset in pieces:
        assert length > 0
        covered[doc].append((start, length))
        filled[sequence].append((offset, length))
    for parts, total in [(covered[d], n) for d, n in enumerate(lengths)] + [(p, None) for p in filled.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        if total is None:
            assert at <= capacity and (at == capacity or at & (at - 1) == 0)
        else:
            assert at == total
    assert sorted(filled) == list(range(sequences))


@pytest.mark.parametrize("lengths", [[], [1], [64], [65, 64, 1, 1], [63] * 40, [1] * 1000, [5000, 3, 70, 64, 128], [33] * 17])
def test_plan(lengths):
    pieces, sequences = packing.plan(np.array(lengths, np.int64), 64)
    rules(lengths, pieces.tolist(), sequences, 64)


def test_most_documents_stay_whole():
    lengths = np.random.default_rng(1).integers(1, 1200, 4000)
    pieces, sequences = packing.plan(lengths, 4096)
    rules(lengths.tolist(), pieces.tolist(), sequences, 4096)
    cut = np.bincount(pieces[:, 0]) > 1
    assert cut.mean() < 0.05


ODD = [
    "", "  ", None, "a\x1cb c", "<|startoftext|>hi <|STARTOFTEXT|> x<|endoftext|>", "Σας ΑΣ é", "　x\xa0y\x85z",
    "S<|startoftext|>", "don't stop 12a,b.. »q«,x", "\x1c\n<|STARTOFTEXT|> q", "x" * 3000, "one\x0btwo\rthree", "a,b;c (d) ½²",
]


def test_ids_are_those_of_the_library(library, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 40)  # the memory starts anew
    with open(_tokenizer(), encoding="utf-8") as file:
        encoder = packing.ChunkIds(Codec(file.read()))
    rng = random.Random(3)
    for _ in range(4):
        texts = [rng.choice(ODD) for _ in range(8)] + [" ".join(rng.choices(["Tea,", "the", "déjà-vu", "x1y", "naïve."], k=40))]
        ids, ends = encoder.encode(texts)
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert encoder.encode([])[0].tolist() == []


def test_documents(spark, library, tmp_path):
    rng = random.Random(9)
    rows = [(i, t, "own", i) for i, t in enumerate(ODD)]
    rows += [(100 + i, " ".join(rng.choices(["tea", "Rain,", "déjà", "x9"], k=rng.randrange(1, 90))), "own", 0) for i in range(60)]
    rows += [(None, "no id", None, None), (7, ODD[7], "own", 7), (500, "word " * 30000, "long", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, length long").repartition(3)
    got = packing.pack_documents(docs, _tokenizer(), capacity=256, group_tokens=3000)
    assert got.columns == ["doc_id", "row", *(f.split()[0] for f in packing.PIECE.split(", "))]
    pieces = got.collect()
    want = sorted([*library.encode(t or "", add_special_tokens=False).ids, 2] for _, t, _, _ in rows)
    sequences = defaultdict(list)
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"]
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 256 or at & (at - 1) == 0 and at < 256
    # rows that repeat cannot be told apart, so their pieces are put together by place
    by_doc = defaultdict(lambda: defaultdict(list))
    for p in pieces:
        by_doc[p["doc_id"]][p["start"]].append(np.frombuffer(p["ids"], "<u4").tolist())
    single = sorted(sum((parts[s][0] for s in sorted(parts)), []) for d, parts in by_doc.items() if d != 7)
    assert single == sorted(w for (d, *_), w in zip(rows, [[*library.encode(t or "", add_special_tokens=False).ids, 2] for _, t, _, _ in rows]) if d != 7)
    assert sum(p["length"] for p in pieces) == sum(map(len, want))
    assert packing.pack_documents(docs.limit(0), _tokenizer()).count() == 0
    again = packing.pack_documents(docs, _tokenizer(), capacity=256, group_tokens=3000).collect()
    assert sorted(map(str, again)) == sorted(map(str, pieces))


def test_query(spark, sf_dir, library):
    got = QUERIES["op13_pack_windows"](spark, sf_dir)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    pieces, by_doc, filled = got.collect(), defaultdict(list), defaultdict(int)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        filled[p["sequence_id"]] += p["length"]
    assert by_doc.keys() == docs.keys()
    for doc, text in docs.items():
        ids, at = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4"), 0
        for p in sorted(by_doc[doc], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    assert all(n == 4096 or n & (n - 1) == 0 and n < 4096 for n in filled.values())
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0

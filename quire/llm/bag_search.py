"""Ranked lexical search with bag deduplication.

Documents are cut down to the vocabulary of the items that are asked: a sorted vector of terms and their counts, and
m, the share of the score that the document's length takes. Documents with the same vector and m have the same score
for every item, so they are one class: classes meet by the hash of both and are told apart by their content, each
keeps its first members by id only, and each is scored once. A task scores its classes against all items of a block,
a batch at a time, and passes on the best of each item; the members of these classes, in order of their ids, are then
ranked. All arithmetic but a term's weight is in 64-bit integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import materialise

#: Bytes of items that are asked together; more items are asked block by block.
ITEM_BYTES = 4 << 20
#: Bytes of text that are cut up together; cells of scores, and single contributions, that are held at once.
GROUP, CELLS = 1 << 22, 1 << 21
#: Every byte that ends a term becomes a blank, A-Z become a-z, bytes of other letters stay.
_TERMS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
_LAST = np.iinfo(np.int64).max


def _terms(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(ends, terms): all terms of the texts one after another, and where each text's end."""
    texts = pa.concat_arrays([texts.fill_null("")])  # a fresh array starts at its buffers' begin
    if len(texts) == 0:
        return np.zeros(0, np.int64), pa.array([], pa.string())
    _, offsets, data = texts.buffers()
    clean = pa.py_buffer((data.to_pybytes() if data else b"").translate(_TERMS))
    cut = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pa.StringArray.from_buffers(len(texts), offsets, clean)))
    flat, ends = cut.flatten(), cut.offsets.to_numpy().astype(np.int64)
    full = pc.binary_length(flat).to_numpy() > 0  # a text without terms is one empty string
    ends = np.concatenate([[0], np.cumsum(full)])[ends]
    return ends[1:], flat.filter(pa.array(full))


class Items:
    """Terms of a block of items: which items ask a term, and how often."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.uids = np.array([r[0] for r in rows], np.int64)
        ends, terms = _terms(pa.array([r[1] for r in rows], pa.string()))
        coded = terms.dictionary_encode()
        self.vocabulary = coded.dictionary
        term = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        item = np.repeat(np.arange(len(rows)), np.diff(ends, prepend=0))
        pairs, self.asked = np.unique(term * max(1, len(rows)) + item, return_counts=True)
        term, self.item = np.divmod(pairs, max(1, len(rows)))
        self.begin = np.searchsorted(term, np.arange(len(self.vocabulary) + 1))


def _vectors(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Number of terms of each text, and its vector: numbers of vocabulary terms, rising, then their counts."""
    ends, terms = _terms(texts)
    counts = np.diff(ends, prepend=0)
    number = pc.index_in(terms, value_set=vocabulary)
    known = number.is_valid().to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(texts)), counts)[known]
    size = max(1, len(vocabulary))
    pairs, tf = np.unique(doc * size + number.drop_null().to_numpy().astype(np.int64), return_counts=True)
    doc, term = np.divmod(pairs, size)
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
    term, tf = term.astype("<u4"), tf.astype("<u4")
    return counts, [term[a:b].tobytes() + tf[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]


def _entries(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vector, term, tf) of all vectors."""
    raw = [np.frombuffer(v, "<u4").reshape(2, -1) for v in vectors.to_pylist()]
    of = np.repeat(np.arange(len(raw)), [v.shape[1] for v in raw])
    both = np.concatenate(raw, axis=1).astype(np.int64) if raw else np.zeros((2, 0), np.int64)
    return of, both[0], both[1]


class Best:
    """The best classes of each item so far: by score, then by the first member's id."""

    def __init__(self, items: Items, weight: np.ndarray, k: int):
        self.items, self.weight, self.k = items, weight, k
        self.item, self.score, self.first = (np.zeros(0, np.int64) for _ in range(3))
        self.members: list = []
        self.least = np.ones(len(items.uids), np.int64)

    def _scores(self, m: np.ndarray, of: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        items, out = self.items, np.zeros(len(m) * len(self.items.uids), np.int64)
        value = self.weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[of]))
        askers = items.begin[term + 1] - items.begin[term]
        before = np.cumsum(askers) - askers
        total, at = int(askers.sum()), 0
        while at < len(term):  # as many entries at once as make CELLS contributions
            to = max(at + 1, int(np.searchsorted(before, before[at] + CELLS, "right")) - 1) if total - before[at] > CELLS else len(term)
            n = askers[at:to]
            place = np.arange(int(n.sum())) - np.repeat(before[at:to] - before[at] - items.begin[term[at:to]], n)
            cell = np.repeat(of[at:to] * len(items.uids), n) + items.item[place]
            np.add.at(out, cell, np.repeat(value[at:to], n) * items.asked[place])
            at = to
        return out.reshape(len(m), -1)

    def add(self, vectors: pa.Array, m: np.ndarray, first: np.ndarray, members: pa.Array) -> None:
        step = max(1, CELLS // max(1, len(self.items.uids)))
        for at in range(0, len(vectors), step):
            part = slice(at, at + step)
            scores = self._scores(m[part], *_entries(vectors.slice(at, step)))
            if len(scores) > self.k:
                kth = np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k]
                self.least = np.maximum(self.least, kth)
            of, item = np.nonzero(scores >= self.least)
            self._keep(item, scores[of, item], first[part][of], of, members.slice(at, step))

    def _keep(self, item: np.ndarray, score: np.ndarray, first: np.ndarray, of: np.ndarray, members: pa.Array) -> None:
        old = len(self.item)
        item, score, first = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.first, first)))
        order = np.lexsort((first, -score, item))
        grouped = item[order]
        nth = np.arange(len(order)) - np.searchsorted(grouped, grouped)
        kept = order[nth < self.k]
        fresh = kept[kept >= old] - old
        new = dict(zip(fresh.tolist(), members.take(pa.array(of[fresh])).to_pylist()))
        self.members = [self.members[i] if i < old else new[i - old] for i in kept.tolist()]
        self.item, self.score, self.first = item[kept], score[kept], first[kept]
        full, count = np.unique(self.item, return_counts=True)
        full, end = full[count == self.k], np.cumsum(count)[count == self.k]
        self.least[full] = np.maximum(self.least[full], self.score[end - 1])

    def rows(self) -> pa.RecordBatch:
        members = pa.array(self.members, pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(self.items.uids[self.item]), pa.array(self.score), members], ["uid", "score", "members"])


def _by_size(texts: pa.Array) -> Iterator[tuple[int, int]]:
    size = np.concatenate([[0], np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, size[at] + GROUP, "right")) - 1)
        yield at, to
        at = to


def vectors(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, n, vector) of the documents (doc_id, text) with a term at least."""
    vocabulary = items.vocabulary

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in _by_size(batch.column(1)):
                n, made = _vectors(batch.column(1).slice(at, to - at), vocabulary)
                has = pa.array(n > 0)
                columns = [batch.column(0).slice(at, to - at), pa.array(n.astype(np.int64)), pa.array(made, pa.binary())]
                yield pa.RecordBatch.from_arrays([c.filter(has) for c in columns], ["doc_id", "n", "vector"])

    return docs.mapInArrow(cut, "doc_id long, n long, vector binary")


def document_counts(found: DataFrame, terms: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary: summed per task, then per term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(terms, np.int64)
        for batch in batches:
            out += np.bincount(_entries(batch.column(0))[1], minlength=terms)
        held = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(out[held])], ["term", "df"])

    df = np.zeros(terms, np.int64)
    for term, n in found.select("vector").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        df[term] = n  # a row for each term of a block of items
    return df


def classes(found: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(vector, m, members): documents of equal vector and m are one class, with its first k ids, null ids last."""
    m = F.expr(f"25 + (75L * n * {n_docs}L) div {n_terms}L")
    keyed = found.filter(F.octet_length("vector") > 0).select("doc_id", "vector", m.alias("m"))
    keyed = keyed.withColumn("h", F.xxhash64("vector", "m"))
    # no task passes on more than k rows of a class; the content stands beside its hash in the key
    place = F.row_number().over(Window.partitionBy("h", "m", "vector").orderBy(F.col("doc_id").asc_nulls_last()))
    first = keyed.withColumn("place", place).filter(F.col("place") <= k)
    members = F.sort_array(F.collect_list(F.struct("place", "doc_id")))
    return first.groupBy("h", "m", "vector").agg(F.transform(members, lambda x: x.doc_id).alias("members")).drop("h")


def best_of_block(found: DataFrame, items: Items, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(uid, doc_id, score): each task's best documents of each item."""
    df = document_counts(found, len(items.vocabulary)).tolist()
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df], np.int64)
    sent = found.sparkSession.sparkContext.broadcast((items, weight))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(*sent.value, k)
        for batch in batches:
            m, vector, members = (batch.column(c) for c in ("m", "vector", "members"))
            first = pc.fill_null(pc.list_element(members, 0), _LAST).to_numpy(zero_copy_only=False)
            best.add(vector, m.to_numpy(zero_copy_only=False), first, members)
        yield best.rows()

    scored = classes(found, n_docs, n_terms, k).select("m", "vector", "members")
    scored = scored.mapInArrow(score, "uid long, score long, members array<long>")
    return scored.select("uid", F.explode("members").alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents (doc_id, text) of each item (item_id, text), best first.

    A term is a stretch of ASCII letters, digits and characters beyond ASCII; A-Z count as a-z. A document's score is
    the sum over the item's terms, repeats included, of weight * ((10**9 * tf) div (1000 * tf + 8 * m)); equal scores
    are ranked by rising doc_id, null ids last. Documents that score 0 are left out, so null and empty texts are never
    found and items without terms have no rows. Rows that repeat are documents, and items, of their own. doc_id is an
    integer. Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = materialise(items.select(F.monotonically_increasing_id().alias("uid"), "item_id", F.col("text").cast("string").alias("text")), "items")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, counts, found = -(-size // ITEM_BYTES), None, []
    for i in range(blocks):
        # as many bytes as a block has on average; one item is one row at least
        part = asked.filter(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == i)
        block = Items([tuple(r) for r in part.select("uid", "text").collect()])
        cut = materialise(vectors(docs, block), "vectors")
        counts = counts or cut.agg(F.count("*"), F.sum("n")).first()
        if counts[0]:
            found.append(best_of_block(cut, block, *counts, k))
    if not found:
        return asked.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    best = reduce(DataFrame.unionByName, found)
    order = Window.partitionBy("uid").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("uid", "item_id"), "uid").select("item_id", "rank", "doc_id", "score")

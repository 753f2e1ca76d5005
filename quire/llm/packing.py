"""Packing of documents into sequences by Karmarkar-Karp multiway differencing.

Each task packs its own documents in groups of about GROUP_TOKENS tokens, so no text and no id is shuffled. A
document gives its whole sequences first; what is left of it, shorter than a sequence, is one item. Every item
begins as a partial partition of one filled window; the two partial partitions with the largest imbalance (fullest
less emptiest window) are merged, the fullest windows of one with the emptiest of the other, until one partition is
left. Its windows are nearly equal. If one exceeds the capacity, the number of windows rises and the group is
partitioned again.

What the windows then lack is filled by cutting up a few of them: the emptiest are taken apart and poured into the
gaps of the others, which end up full, and the last tokens of a group become sequences whose lengths are powers of
two, which need no padding.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bpe import NEVER, Codec

#: Tokens that are packed together, about.
GROUP_TOKENS = 1 << 21
#: Code points of text that are encoded together, about, and chunks of text whose ids a worker remembers.
TEXT_GROUP, REMEMBERED = 1 << 23, 1_000_000
#: Most code points of a word that is merged beside others.
LONG = 64
#: Blanks of Latin-1 that are no ASCII white space, and those of ASCII that the tokenizer's pattern does not take for one.
ODD_BLANKS = "\x1c\x1d\x1e\x1f\x85\xa0"
#: Pieces of an output batch.
ROWS = 2048
PIECE = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class PairRanks:
    """Rank of a pair of ids, by open addressing."""

    BITS = 19

    def __init__(self, codec: Codec):
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.ranks = np.full(1 << self.BITS, NEVER, np.int64)
        waiting, slot = np.arange(len(codec.pairs)), self._slot(codec.pairs)
        while len(waiting):
            free = waiting[self.keys[slot[waiting]] < 0]
            self.keys[slot[free]] = codec.pairs[free]  # the last of those that want one slot has it
            waiting = waiting[self.keys[slot[waiting]] != codec.pairs[waiting]]
            slot[waiting] = slot[waiting] + 1 & (1 << self.BITS) - 1
        self.ranks[slot] = codec.ranks

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        slot = self._slot(key)
        out, met = self.ranks[slot], self.keys[slot]
        open_ = np.flatnonzero((met != key) & (met >= 0))
        out[met != key] = NEVER
        while len(open_):
            slot[open_] = slot[open_] + 1 & (1 << self.BITS) - 1
            met = self.keys[slot[open_]]
            hit = open_[met == key[open_]]
            out[hit] = self.ranks[slot[hit]]
            open_ = open_[(met != key[open_]) & (met >= 0)]
        return out


class ChunkIds:
    """Ids of the chunks between blanks, in one array; a chunk is encoded when it is first met."""

    def __init__(self, codec: Codec):
        self.codec, self.pair_ranks = codec, PairRanks(codec)
        self.letters = np.array([codec.inner, codec.last], np.int64)
        # chunks are in lower case, so a text has none of these
        self.special = {token: "S" + token for token in codec.special}
        self._start_anew()

    def _start_anew(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int32)
        self._append(["", *self.special.values()], np.array([*self.codec.special.values()], np.uint32), [0, *[1] * len(self.special)])

    def _append(self, chunks: list[str], ids: np.ndarray, lengths) -> None:
        n = len(self.begin) - 1
        self.index.update(zip(chunks, range(n, n + len(chunks))))
        self.flat = np.concatenate([self.flat, ids])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(lengths, dtype=np.int32)])

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks one after another, and where each begins and the last ends."""
        lengths = self.begin[at + 1] - self.begin[at]
        before = np.zeros(len(at) + 1, np.int32)
        np.cumsum(lengths, out=before[1:])
        source = np.repeat(self.begin[at] - before[:-1], lengths)
        source += np.arange(before[-1], dtype=np.int32)
        return self.flat[source], before

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another and how many each has: all words side by side, a merge of each a round."""
        raw = [w.encode() for w in words]
        n = np.fromiter(map(len, raw), np.int64, len(raw))
        text = np.frombuffer(b"".join(raw), np.uint8)
        first = np.cumsum(n) - n
        last = np.zeros(len(text), np.int64)
        last[first + n - 1] = 1
        parts = self.letters[last, text]
        ranks = np.full(len(parts), NEVER, np.int64)  # of a part and the next of its word
        pair = np.flatnonzero(last[:-1] == 0)
        ranks[pair] = self.pair_ranks.of(parts[pair], parts[pair + 1])
        word, counts = np.arange(len(words)), np.zeros(len(words), np.int64)
        done, of = [], []
        while len(word):
            first = np.cumsum(n) - n
            least = np.minimum.reduceat(ranks, first)
            goes_on = least < NEVER
            if not goes_on.all():
                inside = np.repeat(goes_on, n)
                done.append(parts[~inside])
                of.append(np.repeat(word[~goes_on], n[~goes_on]))
                counts[word[~goes_on]] = n[~goes_on]
                parts, ranks, word, n, least = parts[inside], ranks[inside], word[goes_on], n[goes_on], least[goes_on]
                if not len(word):
                    break
                first = np.cumsum(n) - n
            same = np.flatnonzero(ranks == np.repeat(least, n))
            at = same[np.searchsorted(same, first)]  # the leftmost of each word
            parts[at] = self.codec.merged[least]
            stays = np.ones(len(parts), bool)
            stays[at + 1] = False
            n = n - 1
            at = at - np.arange(len(at))
            ranks = ranks[stays]
            parts = parts[stays]
            first, end = np.cumsum(n) - n, np.cumsum(n) - 1
            ranks[at] = NEVER
            right, left = np.flatnonzero(at < end), np.flatnonzero(at > first)
            ranks[at[right]] = self.pair_ranks.of(parts[at[right]], parts[at[right] + 1])
            ranks[at[left] - 1] = self.pair_ranks.of(parts[at[left] - 1], parts[at[left]])
        order = np.argsort(np.concatenate(of), kind="stable") if of else np.zeros(0, np.int64)
        return (np.concatenate(done)[order] if done else parts).astype(np.uint32), counts

    def _learn(self, chunks: list[str]) -> None:
        """Encode the words of the chunks, all together, then put the chunks that are not one word together from them."""
        index, cut = self.index, self.codec._words
        mixed = [c for c in chunks if not c.isalpha()]
        cuts = [cut(c) for c in mixed]
        words = dict.fromkeys(c for c in chunks if c.isalpha())
        words.update(dict.fromkeys(w for some in cuts for w in some))
        new = [w for w in words if w not in index]
        long = [w for w in new if len(w) > LONG]
        for w in long:  # a queue of ranks instead of rounds
            (packed,) = self.codec.merge_words([w])
            self._append([w], np.frombuffer(packed, "<u4"), [len(packed) // 4])
        short = [w for w in new if len(w) <= LONG]
        self._append(short, *self._merge(short))
        at = np.fromiter((index[w] for some in cuts for w in some), np.int64)
        ends = np.cumsum(np.fromiter(map(len, cuts), np.int64, len(cuts)))
        ids, before = self._gather(at)
        rest = np.array([c not in index for c in mixed], bool)  # a word of one chunk may be another as a whole
        bounds = before[np.concatenate([[0], ends])]
        size = np.diff(bounds)
        self._append([c for c, r in zip(mixed, rest) if r], ids[np.repeat(rest, size)], size[rest])

    def _plain(self, text: str) -> bool:
        """Whether the text can be cut at ASCII white space and around its marks: neither changes a word."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return "'" not in text and not any(map(text.__contains__, ODD_BLANKS))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the end of each text's."""
        codec, normal, plain = self.codec, [], []
        for text in texts:
            text = text or ""
            if any(map(text.__contains__, codec.special)):
                parts = codec.at_special.split(text)
                normal.append(" ".join([self.special[p] if i % 2 else " ".join(codec._chunks(p)) for i, p in enumerate(parts)]))
                plain.append(False)
            elif self._plain(text):
                normal.append(text.lower())  # composed already
                plain.append(True)
            else:
                normal.append(" ".join(codec._chunks(text)))
                plain.append(False)
        normal, plain = pa.array(normal, pa.string()), pa.array(plain, pa.bool_())
        # fewer different chunks: words without their commas and stops
        marked = pa.compute.replace_substring_regex(normal.filter(plain), r"([^\x09-\x0d\x20\pL\pN]+)", r" \1 ")
        normal = pa.compute.replace_with_mask(normal, plain, marked)
        chunks = pa.compute.ascii_split_whitespace(normal)
        ends = chunks.offsets.to_numpy()[1:]
        coded = chunks.flatten().dictionary_encode()
        asked = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.index) > REMEMBERED:
            self._start_anew()
        at = list(map(self.index.get, asked))
        new = [c for c, i in zip(asked, at) if i is None]
        if new:
            self._learn(new)
            at = [self.index[c] if i is None else i for c, i in zip(asked, at)]
        at = np.array(at, np.int64)
        ids, before = self._gather(at[coded.indices.to_numpy(zero_copy_only=False)] if len(at) else at)
        return ids, before[ends]


@functools.lru_cache(1)
def _encoder(spec: str) -> ChunkIds:
    return ChunkIds(Codec(spec))


def differencing(sizes: np.ndarray, windows: int) -> list[list[int]]:
    """Items of each of at most `windows` windows, fullest first."""
    left = np.full(2 * len(sizes), -1, np.int64)
    right = left.copy()
    nodes = len(sizes)

    def imbalance(sums: np.ndarray) -> int:
        return int(sums[0] - (sums[-1] if len(sums) == windows else 0))

    heap = [(-int(s), i, np.array([s]), np.array([i])) for i, s in enumerate(sizes.tolist())]
    if windows == 1:
        return [list(range(len(sizes)))] if len(sizes) else []
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, a, of_a = heapq.heappop(heap)
        _, _, b, of_b = heapq.heappop(heap)
        both = len(a) + len(b) - windows  # windows filled in both partitions
        if both > 0:
            b, of_b = b[::-1], of_b[::-1]
            alone, shared = len(a) - both, np.arange(nodes, nodes + both)
            left[shared], right[shared] = of_a[alone:], of_b[:both]
            nodes += both
            sums = np.concatenate([a[:alone], a[alone:] + b[:both], b[both:]])
            of = np.concatenate([of_a[:alone], shared, of_b[both:]])
        else:
            sums, of = np.concatenate([a, b]), np.concatenate([of_a, of_b])
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        heapq.heappush(heap, (-imbalance(sums), count, sums, of[order]))
        count += 1
    out = []
    for node in heap[0][3].tolist() if heap else []:
        items, open_ = [], [node]
        while open_:
            node = open_.pop()
            if left[node] < 0:
                items.append(node)
            else:
                open_ += [int(right[node]), int(left[node])]
        out.append(items)
    return out


def balanced(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Windows of at most `capacity`, from the least number that the total needs upwards. No item exceeds it."""
    total = int(sizes.sum())
    windows = -(-total // capacity)
    while True:
        out = differencing(sizes, windows)
        over = max((int(sizes[w].sum()) for w in out), default=0) - capacity
        if over <= 0:
            return out
        # with so many windows the mean falls by what the fullest is over
        windows = min(len(sizes), max(windows + 1, -(-total // max(1, total // windows - over))))


def plan(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths, and the number of sequences."""
    whole, rest = lengths // capacity, lengths % capacity
    doc = np.repeat(np.arange(len(lengths)), whole)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)
    pieces = [np.column_stack([doc, nth * capacity, np.full(len(doc), capacity), np.arange(len(doc)), np.zeros(len(doc), np.int64)])]
    sequence = len(doc)
    items = np.flatnonzero(rest)
    windows = [items[w] for w in balanced(rest[items], capacity)]
    gaps = len(windows) * capacity - int(rest.sum())
    kept = len(windows) + -gaps // capacity  # the emptiest windows are poured into the others
    poured = [[int(i), int(whole[i]) * capacity, int(rest[i])] for w in windows[kept:] for i in w][::-1]
    rows: list[tuple[int, int, int, int, int]] = []

    def pour(offset: int, room: int) -> None:
        while room:
            i, start, left = poured.pop()
            taken = min(left, room)
            rows.append((i, start, taken, sequence, offset))
            if taken < left:
                poured.append([i, start + taken, left - taken])
            offset, room = offset + taken, room - taken

    for w in windows[:kept]:
        size = rest[w]
        offset = np.cumsum(size) - size
        pieces.append(np.column_stack([w, whole[w] * capacity, size, np.full(len(w), sequence), offset]))
        filled = int(size.sum())
        pour(filled, capacity - filled)
        sequence += 1
    tail = sum(p[2] for p in poured)
    for bit in reversed(range(tail.bit_length())):
        if tail >> bit & 1:
            pour(0, 1 << bit)
            sequence += 1
    pieces.append(np.array(rows, np.int64).reshape(-1, 5))
    return np.concatenate(pieces), sequence


def pack_documents(
    docs: DataFrame, path: str, text_col: str = "text", capacity: int = 4096, end_id: int = 2, group_tokens: int = GROUP_TOKENS
) -> DataFrame:
    """One row per piece: the document's other columns, and those of PIECE, which replace columns of these names.

    A document is the ids of its text by the tokenizer file, then `end_id`; null and empty texts are that id alone.
    start counts the document's ids before the piece, offset the sequence's. sequence_id is unique: the number of the
    task's partition and one within it, so a task that runs again gives the same rows. Rows that repeat are documents
    of their own, an empty table has no pieces. A text of any length is encoded by the task that reads it.
    """
    with open(path, encoding="utf-8") as file:
        spec = file.read()
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(*others) if others else F.struct(F.lit(None).cast("int").alias("none"))
    rows = docs.select(row.alias("row"), F.col(text_col).cast("string").alias("text"))

    def packed(rows: pa.Array, ids: list[np.ndarray], first: int) -> Iterator[pa.RecordBatch]:
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        pieces, _ = plan(lengths, capacity)
        for at in range(0, len(pieces), ROWS):
            some = pieces[at : at + ROWS]
            doc = some[:, 0]
            cut = [ids[d][s : s + n].tobytes() for d, s, n in some[:, :3].tolist()]
            columns = [rows.take(pa.array(doc)), *map(pa.array, (some[:, 1], some[:, 2], lengths[doc], some[:, 3] + first, some[:, 4]))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cut, pa.binary())], ["row", *names])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        encoder, held, kept, tokens = _encoder(spec), [], [], 0
        end = np.array([end_id], np.uint32)
        for batch in batches:
            texts = batch.column(1)
            size = np.cumsum(np.concatenate([[0], pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)]))
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(size, size[at] + TEXT_GROUP, "right")) - 1)
                ids, ends = encoder.encode(texts.slice(at, to - at).to_pylist())
                held += [np.concatenate([x, end]) for x in np.split(ids, ends[:-1])]
                kept.append(batch.column(0).slice(at, to - at))
                tokens += len(ids) + to - at
                at = to
                if tokens >= group_tokens:
                    yield from packed(pa.concat_arrays(kept), held, first)
                    first += len(held) + tokens  # no group has as many sequences as documents and tokens
                    held, kept, tokens = [], [], 0
        if held:
            yield from packed(pa.concat_arrays(kept), held, first)

    names = [f.split()[0] for f in PIECE.split(", ")]
    schema = f"row {rows.schema['row'].dataType.simpleString()}, {PIECE}"
    pieces = rows.mapInArrow(pack, schema)
    return pieces.select(*[F.col("row")[c].alias(c) for c in others if c not in names], *names)

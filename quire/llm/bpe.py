"""BPE encoding and decoding with a public tokenizer file.

Text is split at special tokens, normalised (NFC, lower case per character) and cut into words. A word's parts
are held in contiguous arrays of boundaries, ids and ranks of adjacent pairs: the smallest rank is looked up by a
scan, the boundary between its two parts is deleted and the ranks beside it are refreshed, until no pair has a
rank. The new words of a batch are merged side by side, one row of the arrays for each word. Words longer than
SCAN parts use a queue of ranks instead of scans, with the same merges. Ids are stored packed, as little-endian
unsigned 32-bit integers in a binary column.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import release_memory

#: Most parts of a word whose ranks are scanned.
SCAN = 256
#: Most words, with and without punctuation, that a worker remembers; beyond it the memory starts anew.
REMEMBERED = 800_000
#: Characters of text whose new words are merged together, and most words side by side.
GROUP, ROWS = 1 << 21, 1 << 14
#: Stands for no rank.
NEVER = 1 << 29


def _byte_letters() -> list[str]:
    """The visible character that stands for each byte: itself if printable Latin-1, else the next from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Codec:
    """Encoder and decoder of one tokenizer file of the kind BPE with word ends."""

    def __init__(self, spec: str):
        import regex

        parsed = json.loads(spec)
        model, letters = parsed["model"], _byte_letters()
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        steps = [s for s in parsed["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split"]
        self.cut = regex.compile(steps[0]["pattern"]["Regex"]).findall
        self.inner, self.last = [vocab[c] for c in letters], [vocab[c + end] for c in letters]
        pairs = {}
        for rank, (a, b) in enumerate(model["merges"]):
            pairs.setdefault(vocab[a] << 32 | vocab[b], rank)
        self.merged = np.array([vocab[a + b] for a, b in model["merges"]] + [0], np.int64)
        self.pairs = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.pairs.tolist()], np.int64)
        self.pair_ranks = pairs
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        names = {i: t for t, i in {**vocab, **self.special}.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.known: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right  # a missing part is -1, and so is its key
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], NEVER)

    def merge(self, ids: np.ndarray) -> np.ndarray:
        """Merge the parts of each row (padded with -1) by rank, the leftmost of equal ranks first."""
        done = np.full(ids.shape, -1, np.int64)
        rows, ranks = np.arange(len(ids)), self._rank(ids[:, :-1], ids[:, 1:])
        while len(rows):
            each = np.arange(len(rows))
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            least = ranks[each, at] if ranks.shape[1] else np.full(len(rows), NEVER)
            ended, going = np.flatnonzero(least == NEVER), np.flatnonzero(least != NEVER)
            done[rows[ended], : ids.shape[1]] = ids[ended]
            rows, ids, ranks, at, least = rows[going], ids[going], ranks[going], at[going], least[going]
            each, column = np.arange(len(rows)), np.arange(ids.shape[1] - 1)
            # the boundary after part `at` goes: its right neighbour and its rank leave the arrays
            ids = np.take_along_axis(ids, column + (column > at[:, None]), 1)
            ids[each, at] = new = self.merged[least]
            column = column[:-1]
            ranks = np.take_along_axis(ranks, column + (column >= at[:, None]), 1)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < ids.shape[1] - 1)
            ranks[left, at[left] - 1] = self._rank(ids[left, at[left] - 1], new[left])
            ranks[right, at[right]] = self._rank(new[right], ids[right, at[right] + 1])
        return done

    def merge_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word."""
        raw = [w.encode() for w in words]
        order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
        out: list = [None] * len(raw)
        while order and len(raw[order[-1]]) > SCAN:
            i = order.pop()
            parts = [self.inner[b] for b in raw[i]]
            parts[-1] = self.last[raw[i][-1]]
            out[i] = np.array(self._merge_long(parts), "<u4").tobytes()
        inner, last = np.array(self.inner, np.int64), np.array(self.last, np.int64)
        for start in range(0, len(order), ROWS):
            some = order[start : start + ROWS]  # of similar lengths
            length = np.array([len(raw[i]) for i in some])
            inside = np.arange(length[-1]) < length[:, None]
            ids = np.full(inside.shape, -1, np.int64)
            flat = np.frombuffer(b"".join([raw[i] for i in some]), np.uint8)
            ids[inside] = inner[flat]
            ids[np.arange(len(some)), length - 1] = last[flat[np.cumsum(length) - 1]]
            parts = self.merge(ids)
            kept = parts >= 0
            packed, ends = parts[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(1))).tolist()
            begin = 0
            for i, end in zip(some, ends):
                out[i] = packed[begin:end]
                begin = end
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank = self.pair_ranks.get
        queue = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i] << 32 | ids[i + 1], NEVER)) != NEVER]
        heapq.heapify(queue)
        while queue:
            least, i, left, right = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of the two has been merged since
            ids[i], ids[j] = int(self.merged[least]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := rank(ids[a] << 32 | ids[b], NEVER)) != NEVER:
                    heapq.heappush(queue, (r, a, ids[a], ids[b]))
        return [x for x in ids if x >= 0]

    def _chunks(self, text: str) -> list[str]:
        """The text, normalised, between blanks; every word lies in one chunk."""
        # lower case is per character: a final sigma is not told apart
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        # the separators U+001C to U+001F are no white space for the pattern
        plain = not any(c in text for c in "\x1c\x1d\x1e\x1f")
        return text.split() if plain else text.split(" ")

    def _words(self, chunk: str) -> list[str]:
        if chunk.isalpha():
            return [chunk]
        if chunk[-1:] in (".", ",") and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.cut(chunk)

    def _learn(self, chunks: set[str]) -> None:
        """Encode the chunks that are not remembered, their new words all together."""
        known = self.known
        new = [c for c in chunks if c not in known]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list(chunks)
        cuts = [self._words(c) for c in new]
        words = list({w for cut in cuts for w in cut if w not in known})
        known.update(zip(words, self.merge_words(words)))
        for chunk, cut in zip(new, cuts):
            if len(cut) != 1 or cut[0] != chunk:
                known[chunk] = b"".join([known[w] for w in cut])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        start = 0
        while start < len(texts):
            end, held = start, 0
            while end < len(texts) and (end == start or held < GROUP):
                held += len(texts[end] or "")
                end += 1
            # a text is a list of parts: chunks, and between them the special tokens it names
            cut: list[list] = []
            for text in texts[start:end]:
                if text and any(token in text for token in self.special):
                    parts = self.at_special.split(text)
                    cut.append([self.special[p] if i % 2 else self._chunks(p) for i, p in enumerate(parts)])
                else:
                    cut.append([self._chunks(text)] if text else [])
            asked: set[str] = set()
            for parts in cut:
                for part in parts:
                    if isinstance(part, list):
                        asked.update(part)
            self._learn(asked)
            known = self.known.__getitem__
            for parts in cut:
                packed = [b"".join(map(known, p)) if isinstance(p, list) else p.to_bytes(4, "little") for p in parts]
                out.append(b"".join(packed))
            start = end
        return out

    def decode(self, packed: bytes) -> str:
        return " ".join(map(self.names.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@functools.lru_cache(2)
def _codec(spec: str) -> Codec:
    return Codec(spec)


def encode(text: Column, path: str) -> Column:
    """Packed ids of a text (binary); a null text counts as empty and has no ids."""
    with open(path, encoding="utf-8") as file:
        spec = file.read()

    @F.arrow_udf("binary")
    def encoded(texts: pa.Array) -> pa.Array:
        codec = _codec(spec)
        out = pa.array(codec.encode(texts.to_pylist()), pa.binary())
        release_memory()
        return out

    return encoded(text)


def decode(packed: Column, path: str) -> Column:
    """Text of packed ids: the tokens joined by spaces, as the file names no decoder; null ids give an empty text."""
    with open(path, encoding="utf-8") as file:
        spec = file.read()

    @F.arrow_udf("string")
    def decoded(ids: pa.Array) -> pa.Array:
        codec = _codec(spec)
        return pa.array([codec.decode(p) if p else "" for p in ids.to_pylist()], pa.string())

    return decoded(packed)


def unpack(packed: Column) -> Column:
    """The ids as array<long>, without Python."""
    n = (F.octet_length(packed) / 4).cast("int")

    def at(i: Column) -> Column:
        digits = F.hex(F.substring(packed, i * 4 + 1, F.lit(4)))
        return F.conv(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in (3, 2, 1, 0)]), 16, 10).cast("long")

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<long>"))


def encode_documents(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """The documents with ids (packed), n_tokens and decoded; columns of these names are replaced.

    Null and empty texts have no tokens and decode to an empty text; rows that repeat are encoded alike.
    """
    with_ids = docs.withColumn("ids", encode(F.col(text_col), path))
    with_ids = with_ids.withColumn("n_tokens", F.floor(F.octet_length("ids") / 4).cast("long"))
    return with_ids.withColumn("decoded", decode(F.col("ids"), path))

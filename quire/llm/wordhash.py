"""64-bit hashes of the words of many texts at once, with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed together, about; longer texts are cut between words.
PIECE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x2545F4914F6CDD1D  # odd, so its powers have inverses


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread 64-bit values; one-to-one for a given seed."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTER = mix(np.arange(256, dtype=np.uint64), 1)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + (1 << 16))
        _powers[:] = [
            np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(b))]), dtype=np.uint64)
            for b in (_BASE, pow(_BASE, -1, 2**64))
        ]
    return _powers


def _hash_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words of a byte string that ends with a space; A-Z count as a-z."""
    a = np.frombuffer(raw.lower(), np.uint8)
    space = _SPACE[a]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[::2], edge[1::2]
    up, down = _power_tables(len(a))
    run = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_LETTER[a] * up[: len(a)], out=run[1:])
    return starts, mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64), 2)


def _cuts(raw: bytes) -> Iterator[bytes]:
    at = 0
    while len(raw) - at > 2 * PIECE:
        end = at + PIECE
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def word_hashes(texts: list[bytes | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, offsets, hashes): word i of text first + t is hashes[offsets[t] + i]; texts come in order."""
    first, parts, held = 0, [], 0

    def done(last: int) -> tuple[int, int, np.ndarray, np.ndarray]:
        raw = b" ".join(parts) + b" "
        starts, hashes = _hash_words(raw)
        begins = np.cumsum([0] + [len(p) + 1 for p in parts])
        return first, last, np.searchsorted(starts, begins), hashes

    for i, text in enumerate(texts):
        text = text or b""
        if len(text) > 2 * PIECE:
            if parts:
                yield done(i)
            hashes = np.concatenate([_hash_words(piece + b" ")[1] for piece in _cuts(text)])
            yield i, i + 1, np.array([0, len(hashes)]), hashes
            first, parts, held = i + 1, [], 0
            continue
        parts.append(text)
        held += len(text)
        if held >= PIECE:
            yield done(i + 1)
            first, parts, held = i + 1, [], 0
    if parts:
        yield done(len(texts))

"""Vectorised word and shingle hashes over batches of texts (numpy).

Texts are laid end to end in one byte buffer, so a batch costs a fixed number
of array passes however many texts it holds.  Buffers are about a MiB, which
keeps the passes inside the processor's caches and memory bounded; only a
longer single text makes a longer buffer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
#: Odd multipliers of the hashes.
WORD_BASE = 0x9E3779B97F4A7C15
GRAM_BASE = 0xC2B2AE3D27D4EB4F
BUFFER = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    """Powers of the word base and of its inverse modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(WORD_BASE, -1, 1 << 64)
            step = np.full(n, WORD_BASE, dtype=U)
            back = np.full(n, inverse, dtype=U)
            step[0] = back[0] = 1
            self.up, self.down = np.multiply.accumulate(step), np.multiply.accumulate(back)
        return self.up[:n], self.down[:n]


_POWERS = None


def batches(texts: list[str | None], limit: int = BUFFER) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, encoded texts) of at most ``limit`` bytes, or one text."""
    start, size, held = 0, 0, []
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > limit:
            yield start, held
            start, size, held = i, 0, []
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield start, held


def words_of(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, offsets of each text's words, begin and end bytes, and text begins in the buffer."""
    global _POWERS
    _POWERS = _POWERS or _Powers()
    buffer = np.frombuffer(b"\n".join([*raws, b""]), dtype=np.uint8)
    lengths = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws))
    begins = np.concatenate(([0], np.cumsum(lengths + 1)))
    inside = np.concatenate(([False], _IS_WORD[buffer], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edges[::2], edges[1::2]
    up, down = _POWERS.upto(len(buffer) + 1)
    sums = np.concatenate((np.zeros(1, dtype=U), np.cumsum((_LOWER[buffer].astype(U) + U(1)) * up[: len(buffer)], dtype=U)))
    hashes = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(U))
    return hashes, np.searchsorted(first, begins), first, last, begins


def shingles_of(words: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words of each text and their offsets.

    A text of fewer words, but not none, is one shingle.
    """
    counts = np.diff(offsets)
    each = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    where = np.concatenate(([0], np.cumsum(each)))
    if not len(words):
        return words, where
    powers = [U(pow(GRAM_BASE, i, 1 << 64)) for i in range(size)]
    padded = np.concatenate((words, np.zeros(size, dtype=U)))
    full = padded[: len(words)] * powers[0]
    for i in range(1, size):
        full += padded[i : i + len(words)] * powers[i]
    for doc in np.flatnonzero((counts > 0) & (counts < size)):
        a, b = offsets[doc], offsets[doc + 1]
        full[a] = sum((int(w) * int(p) for w, p in zip(words[a:b], powers, strict=False)), int(b - a)) % (1 << 64)
    at = np.arange(where[-1]) - np.repeat(where[:-1], each) + np.repeat(offsets[:-1], each)
    return mix(full[at]), where

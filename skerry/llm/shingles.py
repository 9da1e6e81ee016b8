"""Word shingles as 64-bit hashes, many texts at a time, for use inside Python workers.

A word's hash is the first 64 bits of its BLAKE2b digest, so no texts collide by
construction: two given words are told apart but for a chance of 2 ** -64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)

#: Bytes that end words where words are letters, digits, underscores and what isn't ASCII.
MARKS = bytes(b for b in range(128) if not (chr(b).isalnum() or b == 0x5F))

_AS_BLANKS = {b"": None, MARKS: bytes(0x20 if b in MARKS else b for b in range(256))}


class _Words(dict):
    """Hashes of words, kept up to a number; new words are hashed when they are asked for."""

    def __missing__(self, word: bytes) -> int:
        found = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            if len(self) >= 1 << 17:
                self.clear()
            self[word] = found
        return found


_words = _Words()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(texts: list[bytes], marks: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, bytes of each word, where each text's words begin; one more at the end).

    Words lie between blanks, that is space and tab to carriage return, and ``marks``.
    """
    hashes, sizes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
    for text in texts:
        words = text.translate(_AS_BLANKS[marks]).split()
        hashes.append(np.fromiter(map(_words.__getitem__, words), np.uint64, len(words)))
        sizes.append(np.fromiter(map(len, words), np.int64, len(words)))
        counts.append(len(words))
    return np.concatenate(hashes), np.concatenate(sizes), np.cumsum([0, *counts]).astype(np.int64)


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` words."""
    out = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        out = mixed(out * _ODD + hashes[k : k + len(out)])
    return out


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each text; a short text is one shingle, one without words none.

    Words lie between blanks, with A-Z in lower case.
    """
    hashes, _, begin = words_of([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts])
    runs = rolled(hashes, width)
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        elif b > a:
            yield mixed(rolled(hashes[a:b], b - a) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return next(shingle_sets([text], width))

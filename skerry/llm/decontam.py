"""Benchmark decontamination by SimHash over item-sized windows.

For each benchmark item of w words, every window of w words of every document is
looked at.  A window's fingerprint is the SimHash (128 bits) of its word shingles,
weighted by the root of their bytes in UTF-8: as its angle goes by squares of weights,
it then follows the similarity below.  Item fingerprints are indexed by 8 blocks of 16
bits: two fingerprints within RADIUS bits agree on some block up to RADIUS // 8
bits, and each item is filed under all block values that near, so a lookup by
exact block values finds every item within the radius.  Candidates are then
compared exactly: similarity is the weighted Jaccard similarity of the two
multisets of shingles, weights being bytes.

Windows of which less than THRESHOLD by weight are shingles of any item at all
can't be similar enough to one; they get no fingerprint.  That loses nothing.

Words are runs of ASCII letters, digits, underscores and non-ASCII characters, in
lower case.  Items of fewer
words than a shingle are one shingle; documents shorter than an item are one
window.  Null and empty texts and items match nothing.  Equal documents give equal
rows; an item counts once however often its row is repeated, equal items with other keys each their own.
Of windows equally similar to an item the first is given.  Null ids are ids like any
other, extra columns are kept by ``drop_contaminated`` and ignored by ``contaminated``.
Empty tables match nothing.  Very long texts are held whole, one at a time.

Items come to the driver ITEM_BLOCK at a time and go to all tasks, so they have to be
a benchmark, not a corpus.  The documents are read once, their words hashed once, and
each run of them meets one block of items after the other.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm import shingles
from skerry.plans.shipping import ship

WIDTH = 5
THRESHOLD = 0.8
BLOCKS = 8
RADIUS = 31
ITEM_BLOCK = 2000
BITMAP_BITS = 20
SLICE = 256
STRETCH = 4096

class Shingled(NamedTuple):
    """Shingles of one width of a text, with the bytes of each."""

    hashes: np.ndarray
    weights: np.ndarray


def hashed_words(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and bytes of the words."""
    hashes, sizes, _ = shingles.words_of([(text or "").lower().encode("utf-8", "surrogatepass")], shingles.MARKS)
    return hashes, sizes


def weights_of(sizes: np.ndarray, width: int) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(sizes)])
    return sums[width:] - sums[:-width]


def _bits(hashes: np.ndarray) -> np.ndarray:
    """128 bits of each shingle, as 0 and 1."""
    both = np.stack([shingles.mixed(hashes), shingles.mixed(~hashes)], axis=1)
    return np.unpackbits(both.astype("<u8").view(np.uint8), axis=1)


def fingerprints(hashes: np.ndarray, weights: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The SimHash of each window hashes[first : first + count], as BLOCKS numbers of 16 bits.

    Votes are differences of running sums, taken over stretches of the text.
    """
    out = np.zeros((len(first), BLOCKS), np.uint16)
    order = np.argsort(first, kind="stable")
    while len(order):
        low = int(first[order[0]])
        near = int(np.searchsorted(first[order], low + STRETCH))
        now, order = order[:near], order[near:]
        high = int((first[now] + count[now]).max())
        signs = (2 * _bits(hashes[low:high]).astype(np.int64) - 1) * np.rint(16 * np.sqrt(weights[low:high, None])).astype(np.int64)
        sums = np.concatenate([np.zeros((1, signs.shape[1]), np.int64), np.cumsum(signs, axis=0)])
        for some in np.array_split(now, -(-len(now) // STRETCH)):
            votes = sums[first[some] + count[some] - low] - sums[first[some] - low]
            out[some] = np.packbits(votes > 0, axis=1).view(np.uint16)
    return out


def similarity(a: Shingled, b: Shingled) -> float:
    """Weighted Jaccard similarity of two multisets."""
    tokens, back = np.unique(np.concatenate([a.hashes, b.hashes]), return_inverse=True)
    in_a = np.bincount(back[: len(a.hashes)], a.weights, len(tokens))
    in_b = np.bincount(back[len(a.hashes) :], b.weights, len(tokens))
    return float(np.minimum(in_a, in_b).sum() / np.maximum(in_a, in_b).sum())


def hashed_slices(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The words of SLICE texts at a time."""
    for begin in range(0, len(texts), SLICE):
        coded = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts[begin : begin + SLICE]]
        yield shingles.words_of(coded, shingles.MARKS)


class Index:
    """Items by the blocks of their fingerprints."""

    def __init__(self, texts: tuple[str | None, ...]):
        self.sizes, self.items, prints, self.numbers = [], [], [], []
        for number, text in enumerate(texts):
            hashes, words = hashed_words(text)
            if len(words):
                width = min(WIDTH, len(words))
                found = Shingled(shingles.rolled(hashes, width), weights_of(words, width))
                self.numbers.append(number)
                self.sizes.append(len(words))
                self.items.append(found)
                prints.append(fingerprints(*found, np.array([0]), np.array([len(found.hashes)]))[0])
        self.prints = np.array(prints, np.uint16).reshape(-1, BLOCKS)
        self.widths = {}
        for size, item in zip(self.sizes, self.items, strict=True):
            self.widths.setdefault(min(WIDTH, size), []).append(item.hashes)
        self.widths = {width: np.unique(np.concatenate(known)) for width, known in self.widths.items()}
        self.bitmaps = {}
        for width, known in self.widths.items():
            self.bitmaps[width] = np.zeros(1 << BITMAP_BITS, bool)
            self.bitmaps[width][(known >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)] = True
        near = [sum(1 << b for b in some) for n in range(RADIUS // BLOCKS + 1) for some in combinations(range(16), n)]
        masks = np.array(near, np.uint16)
        self.filed = []
        for b in range(BLOCKS):
            values = (self.prints[:, b][:, None] ^ masks).ravel()
            order = np.argsort(values, kind="stable")
            self.filed.append((values[order], (order // len(masks)).astype(np.int32)))

    def near(self, prints: np.ndarray) -> np.ndarray:
        """(row of ``prints``, item) of all pairs within the radius."""
        pairs = []
        for b, (values, items) in enumerate(self.filed):
            low, high = np.searchsorted(values, prints[:, b], "left"), np.searchsorted(values, prints[:, b], "right")
            counts = high - low
            rows = np.repeat(np.arange(len(prints)), counts)
            at = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
            pairs.append(rows * len(self.items) + items[at])
        both = np.unique(np.concatenate(pairs))
        rows, items = np.divmod(both, max(1, len(self.items)))
        apart = np.bitwise_count(prints[rows] ^ self.prints[items]).sum(axis=1)
        return np.stack([rows, items], axis=1)[apart <= RADIUS]

    def all_matches(self, texts: list[str | None]) -> Iterator[dict[int, tuple[float, int, int]]]:
        """For each text, ``matches``."""
        for some in hashed_slices(texts):
            yield from self.matches_in(some)

    def matches_in(self, some: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[dict[int, tuple[float, int, int]]]:
        """For each hashed text, ``matches``; texts without a shingle of any item are told apart all at once."""
        hashes, sizes, borders = some
        starts = borders[:-1]
        hit = np.zeros(len(starts), bool)
        for width in self.widths:
            found = np.flatnonzero(self._known(shingles.rolled(hashes, width), width))
            owner = np.searchsorted(starts, found, "right") - 1
            hit[owner[found + width <= borders[owner + 1]]] = True
        for i, (a, b) in enumerate(zip(starts.tolist(), borders[1:].tolist(), strict=True)):
            yield self.matches(hashes[a:b], sizes[a:b]) if hit[i] else {}

    def _known(self, runs: np.ndarray, width: int) -> np.ndarray:
        """Which runs are shingles of an item: a bitmap of the hashes' first bits, then the exact table."""
        known, first = self.widths[width], self.bitmaps[width]
        out = first[(runs >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)]
        at = np.flatnonzero(out)
        out[at] = known[np.minimum(np.searchsorted(known, runs[at]), len(known) - 1)] == runs[at]
        return out

    def matches(self, hashes: np.ndarray, words: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """For each item that a window is similar to: the best similarity, the window's first word and its size."""
        out: dict[int, tuple[float, int, int]] = {}
        for width in self.widths:
            if len(words) < width:
                continue
            runs = shingles.rolled(hashes, width)
            hit = self._known(runs, width)
            if not hit.any():
                continue
            weights = weights_of(words, width)
            total, covered = (np.concatenate([[0], np.cumsum(x)]) for x in (weights, weights * hit))
            starts, sizes = [], []
            for size in {s for s in self.sizes if min(WIDTH, s) == width}:
                count = max(1, min(size, len(words)) - width + 1)
                inside, all_ = covered[count:] - covered[:-count], total[count:] - total[:-count]
                found = np.flatnonzero(inside >= THRESHOLD * all_)
                starts.append(found)
                sizes.append(np.full(len(found), size))
            first, size = np.concatenate(starts), np.concatenate(sizes)
            if not len(first):
                continue
            prints = fingerprints(runs, weights, first, np.minimum(size, len(words)) - width + 1)
            for row, item in self.near(prints).tolist():
                if self.sizes[item] == size[row]:
                    p, end = int(first[row]), int(first[row]) + min(int(size[row]), len(words)) - width + 1
                    alike = similarity(Shingled(runs[p:end], weights[p:end]), self.items[item])
                    number = self.numbers[item]
                    if alike >= THRESHOLD and alike > out.get(number, (0.0,))[0]:
                        out[number] = alike, p, min(int(size[row]), len(words))
        return out


#: The indexes of the items that a worker looks for just now, by the job's name.
_HELD: dict[str, list[Index]] = {}


def _indexes(name: str, blocks: list[tuple]) -> list[Index]:
    """One index a block, built once in a worker for any number of blocks; those of other jobs go."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = [Index(texts) for texts in blocks]
    return _HELD[name]


def item_blocks(items: DataFrame, key: str, text: str) -> list[tuple[list, tuple]]:
    """(keys, texts) of ITEM_BLOCK items or so at a time."""
    each = items.select(F.col(key).alias("key"), F.col(text).alias("text")).distinct()
    blocks = -(-each.count() // ITEM_BLOCK)
    block = F.pmod(F.xxhash64("key", "text"), F.lit(max(blocks, 1)))
    out = []
    for b in range(blocks):
        rows = sorted(each.where(block == b).collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        out.append(([r[0] for r in rows], tuple(r[1] for r in rows)))
    return out


def _by_batch(name: str, blocks: list[tuple], batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[list[tuple]]]]:
    """Each batch and, for each of its rows, (block, item, match) of all items found; each text is hashed once."""
    for batch in batches:
        held = list(hashed_slices(batch.column(batch.schema.get_field_index(column)).to_pylist()))
        found: list[list[tuple]] = [[] for _ in range(batch.num_rows)]
        for b, index in enumerate(_indexes(name, blocks)):
            for row, hits in enumerate(hits for some in held for hits in index.matches_in(some)):
                found[row] += [(b, i, best) for i, best in sorted(hits.items())]
        yield batch, found


def contaminated(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(key, item_key, ``similarity``, ``window_start``, ``window_words``): the best window for each pair found."""
    from pyspark.sql.pandas.types import to_arrow_type

    ship(docs.sparkSession)
    blocks = item_blocks(items, item_key, item_text)
    shared, name = docs.sparkSession.sparkContext.broadcast(blocks), uuid.uuid4().hex
    types = [docs.schema[key].dataType, items.schema[item_key].dataType]
    schema = f"`{key}` {types[0].simpleString()}, `{item_key}` {types[1].simpleString()}, similarity double, window_start long, window_words long"
    kinds = [*map(to_arrow_type, types), pa.float64(), pa.int64(), pa.int64()]
    names = [key, item_key, "similarity", "window_start", "window_words"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = [numbers for numbers, _ in shared.value]
        for batch, found in _by_batch(name, [texts for _, texts in shared.value], rows, "_text"):
            out = [(doc, keys[b][i], *best) for doc, hits in zip(batch.column(0).to_pylist(), found, strict=True) for b, i, best in hits]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, of which no window is similar to an item; no shuffle."""
    ship(docs.sparkSession)
    shared, name = docs.sparkSession.sparkContext.broadcast([texts for _, texts in item_blocks(items, item_key, item_text)]), uuid.uuid4().hex

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _by_batch(name, shared.value, rows, text):
            yield batch.filter(pa.array([not hits for hits in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

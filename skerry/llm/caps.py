"""Near-duplicate embeddings by spherical-cap filters of structured random product codes.

1. Equal vectors are one class.
2. A code is a random rotation and, for each half of the rotated space, a list of random
   directions; each pair of directions, one of each half, is a filter.  A vector is list-decoded to
   all filters whose inner product with it reaches its own cap height, that is
   its NEAREST-th highest inner product.  The halves' products are sorted, and of a sum's rank follows which
   pairs can be among the highest, so no filter is passed over.  This is done for TABLES codes.
3. Classes are joined on filters.  Filters with one class are left out before vectors are
   sent; those with more than BLOCK are cut into blocks, and pairs of blocks go to different tasks.
4. Pairs are verified by their cosine in double precision.  A pair that shares several
   filters counts in the first one only.  Tasks add up links by class and return a spanning
   forest of what they found, never all pairs.

A link is found if its vectors share a filter.  For 64 dimensions, of random pairs at cosine 0.95 three in
10,000 share none, at 0.97 none in 4,000 (simulated); no pair below the threshold is ever linked.
Within a filter all pairs are compared, in matrix products: groups of near copies that are not equal
take time in proportion to the square of their size.

Vectors that are null, empty or zero or hold null or non-finite components link with nothing, as
do rows with a null id (their component is null).  Vectors of different lengths don't link.
Repeated rows are several vectors, which link; so are rows with equal ids and different vectors, which link if they
are near enough.  Ties don't matter, as all links count.  An empty table gives an empty table; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.operators.components import connected_components
from skerry.plans.cuts import cut
from skerry.plans.shipping import ship
from skerry.plans.skew import looked_up

TABLES, NEAREST, SEED = 4, 6, 11
#: Directions of a half at 64 dimensions or more; with fewer dimensions there are fewer, as caps hold more of them.
CODE_BITS = 10
LEAST_DIM = 16
#: Classes of a filter that are compared in one task.
BLOCK = 1 << 15
#: Vectors that are decoded together.
SLICE = 1024
#: Groups up to this size are compared pair by pair, larger ones in square tiles.
SMALL, TILE = 48, 1024


@lru_cache(maxsize=4)
def _codes(dim: int) -> tuple[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Directions of a half, and for each table the rotation and the directions of both halves."""
    rng = np.random.default_rng([SEED, dim])
    padded = max(LEAST_DIM, dim + dim % 2)
    half = padded // 2
    size = 1 << min(CODE_BITS, max(2, round(half * CODE_BITS / 32)))

    def directions() -> np.ndarray:
        found = rng.standard_normal((half, size))
        return found / np.linalg.norm(found, axis=0)

    return size, [(np.linalg.qr(rng.standard_normal((padded, padded)))[0][:dim], directions(), directions()) for _ in range(TABLES)]


def decoded(unit: np.ndarray) -> np.ndarray:
    """The filters of each unit vector: TABLES * NEAREST numbers, in which the dimension is coded as well."""
    dim = unit.shape[1]
    size, tables = _codes(dim)
    # the sum of the i-th and the j-th highest is below at least i * j sums (from 1)
    pairs = np.array([(i, j) for i in range(NEAREST) for j in range(NEAREST) if (i + 1) * (j + 1) <= NEAREST and i < size and j < size])
    out = []
    for t, (rotation, first, second) in enumerate(tables):
        turned = unit @ rotation
        best = []
        for part, code in ((turned[:, : len(first)], first), (turned[:, len(first) :], second)):
            product = part @ code
            most = min(NEAREST, size)
            place = np.argpartition(-product, most - 1, axis=1)[:, :most]
            value = np.take_along_axis(product, place, 1)
            order = np.argsort(-value, axis=1, kind="stable")
            best.append((np.take_along_axis(place, order, 1), np.take_along_axis(value, order, 1)))
        (p, u), (q, v) = best
        sums = u[:, pairs[:, 0]] + v[:, pairs[:, 1]]
        top = np.argsort(-sums, axis=1, kind="stable")[:, :NEAREST]
        number = p[:, pairs[:, 0]].astype(np.int64) * size + q[:, pairs[:, 1]]
        out.append(np.take_along_axis(number, top, 1) + ((dim * TABLES + t) << (2 * CODE_BITS)))
    return np.concatenate(out, axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as unit vectors; scaled first, so that no square over- or underflows."""
    found = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    found = found / np.abs(found).max(axis=1, keepdims=True)
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def _by_length(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.diff(batch.column("vec").offsets.to_numpy())
    for size in np.unique(sizes):
        yield batch if (sizes == size).all() else batch.filter(pa.array(sizes == size))


def _decode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for part in _by_length(batch) if batch.num_rows else ():
            unit = _matrix(part.column("vec"))
            filters = np.concatenate([decoded(unit[s : s + SLICE]) for s in range(0, len(unit), SLICE)])
            lists = pa.ListArray.from_arrays(np.arange(0, filters.size + 1, filters.shape[1], dtype=np.int32), pa.array(filters.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "filters"])


class _Forest:
    """Union by numbers 0 to n - 1; the smaller root stays."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def unite(self, first: np.ndarray, second: np.ndarray) -> None:
        for a, b in zip(first.tolist(), second.tolist(), strict=True):
            a, b = self.root(a), self.root(b)
            self.up[max(a, b)] = min(a, b)

    def roots(self, places: np.ndarray) -> np.ndarray:
        return np.array([self.root(x) for x in places.tolist()], dtype=np.int64)


class _Shared:
    """The filters that each row shares with other rows, and which pairs share one before a given filter."""

    def __init__(self, column: pa.Array) -> None:
        self.begin = column.offsets.to_numpy()
        self.begin = self.begin - self.begin[0]
        self.values = column.flatten().to_numpy()

    def _before(self, rows: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``rows``, filter) for all filters of these rows below their limits."""
        sizes = self.begin[rows + 1] - self.begin[rows]
        which = np.repeat(np.arange(len(rows)), sizes)
        at = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.begin[rows], sizes)
        low = self.values[at] < limit[which]
        return which[low], self.values[at[low]]

    def pairs(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """For each pair of rows, whether they share a filter below the limit."""
        out = np.zeros(len(a), bool)
        for s in range(0, len(a), 1 << 16):
            part = slice(s, s + (1 << 16))
            (p, x), (q, y) = self._before(a[part], limit[part]), self._before(b[part], limit[part])
            rank = np.unique(np.concatenate([x, y]), return_inverse=True)[1].astype(np.int64)
            base = len(rank) + 1
            both = np.intersect1d(p * base + rank[: len(x)], q * base + rank[len(x) :], assume_unique=True)
            out[s + both // base] = True
        return out

    def tile(self, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        """The same for all pairs of two lists of rows, by bits for the filters that occur on both sides."""
        (p, x), (q, y) = (self._before(rows, np.full(len(rows), limit)) for rows in (a, b))
        common = np.intersect1d(x, y)
        out = np.zeros((len(a), len(b)), bool)
        for s in range(0, len(common), 64):
            some = common[s : s + 64]
            words = []
            for which, values, n in ((p, x, len(a)), (q, y, len(b))):
                place = np.searchsorted(some, values)
                held = (place < len(some)) & (some[np.minimum(place, len(some) - 1)] == values)
                bits = np.zeros(n, np.uint64)
                np.bitwise_or.at(bits, which[held], np.uint64(1) << place[held].astype(np.uint64))
                words.append(bits)
            out |= (words[0][:, None] & words[1][None, :]) != 0
        return out


def _verified(batch: pa.RecordBatch, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links by class, and each class's root in the forest, for whole groups of rows (filter, i, j) of vectors of one length."""
    n = batch.num_rows
    f, i, j, own, copies = (batch.column(c).to_numpy() for c in ("f", "i", "j", "own", "n"))
    unit, shared = _matrix(batch.column("vec")), _Shared(batch.column("shared"))
    new = np.ones(n, bool)
    new[1:] = (f[1:] != f[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], n)
    group = np.cumsum(new) - 1
    links, forest = np.zeros(n, np.int64), _Forest(n)

    def count(a: np.ndarray, b: np.ndarray) -> None:
        """Pairs that are linked: all join the forest, and those that meet here first are counted."""
        forest.unite(a, b)
        first = ~shared.pairs(a, b, f[a])
        np.add.at(links, a[first], copies[b[first]])
        np.add.at(links, b[first], copies[a[first]])

    large = ends - begins > SMALL
    for d in range(1, SMALL):
        a = np.flatnonzero((group[d:] == group[:-d]) & ~large[group[d:]])
        if not len(a):
            break
        a = a[(i[a] == j[a]) | (own[a] != own[a + d])]
        near = a[np.einsum("ij,ij->i", unit[a], unit[a + d]) >= threshold]
        if len(near):
            count(near, near + d)
    for begin, end in zip(begins[large], ends[large], strict=True):
        rows = np.arange(begin, end)
        same = i[begin] == j[begin]
        left, right = (rows, rows) if same else (rows[own[rows] == i[begin]], rows[own[rows] == j[begin]])
        for s in range(0, len(left), TILE):
            for t in range(s if same else 0, len(right), TILE):
                a, b = left[s : s + TILE], right[t : t + TILE]
                near = unit[a] @ unit[b].T >= threshold
                if same and s == t:
                    near = np.triu(near, 1)
                if np.count_nonzero(near) <= near.size // 64:
                    p, q = np.nonzero(near)
                    count(a[p], b[q])
                    continue
                while True:
                    apart = near & (forest.roots(a)[:, None] != forest.roots(b)[None, :])
                    p = np.flatnonzero(apart.any(axis=1))
                    if not len(p):
                        break
                    forest.unite(a[p], b[apart[p].argmax(axis=1)])
                first = near & ~shared.tile(a, b, int(f[begin]))
                links[a] += first @ copies[b]
                links[b] += copies[a] @ first
    root = forest.roots(np.arange(n))
    told = np.flatnonzero((links > 0) | (root != np.arange(n)))
    node = batch.select(["id", "ka", "kb"])
    mine, its = node.take(pa.array(told)), node.take(pa.array(root[told]))
    yield pa.RecordBatch.from_arrays([*mine.columns, pa.array(links[told]), *its.columns], names=["id", "ka", "kb", "links", "id2", "ka2", "kb2"])


def _verify(threshold: float):
    def whole_groups(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in rows:
            if not batch.num_rows:
                continue
            key = [batch.column(c).to_numpy() for c in ("f", "i", "j")]
            last = np.logical_and.reduce([k == k[-1] for k in key])
            begin = batch.num_rows - int(last[::-1].argmin() or batch.num_rows)  # where the last group begins; at 0 it may have begun before
            if begin or (held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in ("f", "i", "j"))):
                yield from together([*held, batch.slice(0, begin)])
                held = []
            held.append(batch.slice(begin))
        yield from together(held)

    def together(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [p for p in parts if p.num_rows]
        if parts:
            for part in _by_length(pa.concat_batches(parts)):
                yield from _verified(part, threshold)

    return whole_groups


def _vector(column: Column, kind: T.DataType) -> Column:
    """The vector with one zero instead of two, or null if it can link with nothing."""
    element = kind.elementType.simpleString()
    element = element if element in ("float", "double") else "double"
    zero = F.lit(0).cast(element)
    finite = F.forall(column, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.when(finite & F.exists(column, lambda x: x != 0), F.transform(column, lambda x: x.cast(element) + zero))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """(key, n_links, component_id, kept) for each row: how many other rows have a cosine of ``threshold`` or more, and the smallest id reachable by links."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(key).cast("long").alias("id"), _vector(F.col(embedding), vectors.schema[embedding].dataType).alias("vec"))
    hashes = [F.xxhash64("vec").alias("ka"), F.xxhash64(F.lit("2"), "vec").alias("kb")]
    known = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull())
    grouped = known.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "n", "vec", *hashes)
    classes = cut(grouped.mapInArrow(_decode, T.StructType([*grouped.schema.fields, T.StructField("filters", T.ArrayType(T.LongType()))])))

    entries = classes.select(F.explode("filters").alias("f"), "ka", "kb")
    sizes = cut(entries.groupBy("f").agg(F.count("*").alias("m")).where("m > 1").withColumn("weight", F.col("m")))
    met = looked_up(entries, sizes, ("f",), "weight", F.xxhash64("ka", "kb")).where(F.col("m").isNotNull())
    lists = met.groupBy("ka", "kb").agg(F.sort_array(F.collect_list(F.struct("f", "m"))).alias("met"))
    sent = classes.drop("filters").join(lists, ["ka", "kb"])
    sent = sent.select("id", "ka", "kb", "n", "vec", F.col("met.f").alias("shared"), F.inline("met"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    sent = sent.withColumn("own", F.pmod(F.xxhash64("ka", "kb"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = sent.select("f", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "ka", "kb", "n", "vec", "shared")
    sorted_cells = cells.repartition("f", "i", "j").sortWithinPartitions("f", "i", "j")
    found = cut(sorted_cells.mapInArrow(_verify(threshold), "id long, ka long, kb long, links long, id2 long, ka2 long, kb2 long"))

    links = found.groupBy("ka", "kb").agg(F.sum("links").alias("links"))
    # a class is known by its vector; its smallest id comes first, so the smallest node has the smallest id
    edges = found.select(F.struct("id", "ka", "kb").alias("a"), F.struct(F.col("id2").alias("id"), F.col("ka2").alias("ka"), F.col("kb2").alias("kb")).alias("b")).where("a != b")
    components = connected_components(edges).select(F.col("node.ka").alias("ka"), F.col("node.kb").alias("kb"), F.col("component.id").alias("component_id"))
    told = classes.select("id", "ka", "kb", "n").join(links, ["ka", "kb"], "left").join(components, ["ka", "kb"], "left")
    told = cut(told.select("ka", "kb", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), F.col("n").alias("weight")))
    slim = rows.select("id", F.when(F.col("id").isNotNull() & F.col("vec").isNotNull(), F.struct(*hashes)).alias("h")).select("id", "h.ka", "h.kb")
    out = looked_up(slim, told, ("ka", "kb"), "weight", F.xxhash64("id"))
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))

"""A uniform shuffle into shards of exact sizes, in DataFrame operations only.

The rows are first dealt into a fixed number of parts by a hash of the key, and
the parts are counted.  The communication matrix, how many rows of each part go
to each shard, is then drawn from its exact law: row by row a multivariate
hypergeometric draw from what the shards still have to take, so each row of the
matrix adds up to its part and each column to its shard.  Each part permutes its
rows and hands out runs of them as the matrix says; after the exchange each shard
permutes what it got.  Shard sizes are at most one apart.

The matrix has PARTS x shards numbers whatever the size of the table; only the
part counts come to the driver.  Permutations are orders by a keyed hash, so a
task that is run again gives the same rows.  Ranks within a shard are taken bucket
by bucket, with the buckets before added, so no task holds a whole shard.

Null text counts as empty: size 8, checksum 0.  Rows with equal keys are told apart
by their text alone, equal rows are interchangeable.  A null key is a key like any
other.  Very long texts are read once for their size and checksum and take no part in
the exchanges.  Tables with fewer rows than shards leave shards empty; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import lgamma, log, log1p, pi

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 512
BUCKETS = 64
#: From so many rows on numpy has no hypergeometric draw.
NUMPY_LIMIT = 10**9


def communication_matrix(parts: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """How many rows of each part go to each shard; entry by entry exact integers."""
    total = int(sum(parts))
    left = np.full(shards, total // shards, np.int64)
    left[: total % shards] += 1
    draw = np.random.default_rng(seed)
    matrix = np.zeros((len(parts), shards), np.int64)
    for p, rows in enumerate(parts):
        rest, open_ = int(left.sum()), int(rows)
        for s in range(shards):
            if not open_:
                break
            rest -= int(left[s])
            matrix[p, s] = _hypergeometric(draw, int(left[s]), rest, open_)
            open_ -= int(matrix[p, s])
        left -= matrix[p]
    return matrix


def _log_binomial(x: int, n: int, p: float) -> float:
    """Logarithm of the binomial probability in Loader's saddle-point form, which keeps its digits for any n."""
    if x == 0 or x == n:
        return n * (log1p(-p) if x == 0 else log(p))

    def stirling(k: int) -> float:
        """log(k!) less Stirling's formula."""
        return lgamma(k + 1) - (k + 0.5) * log(k) + k - 0.5 * log(2 * pi) if k < 16 else 1 / (12 * k) - 1 / (360 * k**3) + 1 / (1260 * k**5) - 1 / (1680 * k**7)

    def deviance(k: int, mean: float) -> float:
        return k * log1p((k - mean) / mean) - (k - mean)

    corrections = stirling(n) - stirling(x) - stirling(n - x)
    return corrections - deviance(x, n * p) - deviance(n - x, n * (1 - p)) + 0.5 * log(n / (2 * pi * x * (n - x)))


def _hypergeometric(draw: np.random.Generator, good: int, bad: int, size: int) -> int:
    """How many of ``size`` rows drawn from ``good + bad`` are good.

    Up to numpy's limit it draws itself.  Beyond, two binomial draws given their sum
    follow the same law: the smaller side is drawn, and kept with the probability,
    by its maximum, that the larger side makes up the rest.  Five in seven are kept
    at least, whatever the size.
    """
    if size in (0, good + bad) or not good or not bad:
        return min(size, good) if size and good else 0
    if good + bad < NUMPY_LIMIT:
        return int(draw.hypergeometric(good, bad, size))
    if good > bad:
        return size - _hypergeometric(draw, bad, good, size)
    p = size / (good + bad)
    likeliest = _log_binomial(min(int((bad + 1) * p), bad), bad, p)
    while True:
        x = int(draw.binomial(good, p))
        if 0 <= size - x <= bad and log(1 - draw.random()) <= _log_binomial(size - x, bad, p) - likeliest:
            return x


def _keyed(seed: int, step: str, columns: Sequence[str]) -> Column:
    return F.xxhash64(F.lit(f"{seed}:{step}"), *(F.col(c) for c in columns))


def shuffled(rows: DataFrame, identity: Sequence[str], shards: int, seed: int = 17) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``.

    ``identity``: the columns that tell rows apart; rows equal in all of them are
    interchangeable.  All columns take part in the exchanges, so select what is
    needed first.  Columns named ``shard`` or ``slot`` are replaced; any other name will do.
    """
    spark, names = rows.sparkSession, rows.columns
    wanted = [n for n in names if n not in ("shard", "slot")]
    # columns go by their places meanwhile, so that no name clashes
    rows = rows.toDF(*(f"_{i}" for i in range(len(names))))
    identity = [f"_{names.index(c)}" for c in identity]
    part = F.pmod(_keyed(seed, "part", identity), F.lit(PARTS)).cast("int")
    counted = {r["p"]: r["n"] for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    parts = [counted.get(p, 0) for p in range(PARTS)]
    ends = np.cumsum(communication_matrix(parts, shards, seed), axis=1)
    plan = spark.createDataFrame([(p, [int(x) for x in ends[p]]) for p in range(PARTS)], "_part int, _ends array<long>")

    local = Window.partitionBy("_part").orderBy("_order", *identity)
    dealt = rows.withColumns({"_part": part, "_order": _keyed(seed, "local", identity)}).withColumn("_rank", F.row_number().over(local))
    # PARTS rows of `shards` numbers each: a size that never grows
    sent = dealt.join(F.broadcast(plan), "_part").withColumn("shard", F.size(F.filter("_ends", lambda end: end < F.col("_rank"))))

    again = _keyed(seed, "again", identity)
    bucketed = sent.drop("_part", "_order", "_rank", "_ends").withColumns({"_order": again, "_bucket": F.pmod(again, F.lit(BUCKETS)).cast("int")})
    within = Window.partitionBy("shard", "_bucket").orderBy("_order", *identity)
    ranked = bucketed.withColumn("_rank", F.row_number().over(within))
    # one row for each shard and bucket
    sizes = ranked.groupBy("shard", "_bucket").agg(F.max("_rank").cast("long").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (
        ranked.join(F.broadcast(offsets), ["shard", "_bucket"])
        .withColumn("slot", F.col("_before") + F.col("_rank") - 1)
        .select(*(F.col(f"_{names.index(n)}").alias(n) for n in wanted), "shard", "slot")
    )


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 17, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents' keys with size, checksum, shard and slot."""
    whole = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(
        F.col(key),
        (F.octet_length(whole).cast("long") + 8).alias("size"),
        F.crc32(F.encode(whole, "UTF-8")).cast("long").alias("text_crc32"),
    )
    return shuffled(slim, (key, "size", "text_crc32"), shards, seed)

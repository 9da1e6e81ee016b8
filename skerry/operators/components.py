"""Connected components of an edge table, by rounds of min-label contraction.

Each round replaces every edge by one to the smaller neighbour found so far (the
large-star and small-star steps of Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014), so chains shrink by halves.  Links and labels stay
in tables; only a row of counters comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.plans.cuts import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a > b): each node hands its smallest neighbour on."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    led = both.join(least, "u")
    if large:
        led = led.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        led = led.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return led.where(F.col("a") > F.col("b")).distinct()


def _state(edges: DataFrame) -> tuple[int, int, int]:
    """Edges, nodes with an edge down, and a checksum of the edge set."""
    row = edges.groupBy("a").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).agg(
        F.sum("n"), F.count("*"), F.expr("bit_xor(x)")
    ).first()
    return row[0] or 0, row[1], row[2] or 0


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node that occurs in ``edges``; the component is its smallest node.

    Null ends and loops are ignored, except that the node of a loop is returned.
    """
    known = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = known.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    pairs = cut(pairs)
    loops = pairs.where("a = b").select("a")
    now = pairs.where("a > b")
    before = _state(now)
    while True:
        # a star already: each node has one edge down, and no centre has one
        if before[0] == before[1] and now.join(now.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
        now = cut(_star(_star(now, large=True), large=False))
        after = _state(now)
        if after == before:
            break
        before = after
    labels = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    centres = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    alone = loops.join(labels, loops["a"] == labels["node"], "left_anti").join(
        centres.select(F.col("node").alias("c")), F.col("a") == F.col("c"), "left_anti"
    )
    return labels.union(centres).union(alone.select(F.col("a").alias("node"), F.col("a").alias("component")))

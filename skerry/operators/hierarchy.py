"""Class hierarchies: edges (child, parent), in which a class may have several parents.

Pairs of a class and its ancestor are a set: each round joins only the pairs that the round before
found with the edges and keeps those not known yet, so classes with many paths between them cost no more
than others, and any number of levels will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.plans.cuts import cut


class CycleError(ValueError):
    """The edges lead back to where they began."""


def leaves(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """Classes without children (GR02)."""
    return concepts.join(edges.select(F.col("parent").alias("concept_id")), "concept_id", "left_anti")


def top_level(edges: DataFrame) -> DataFrame:
    """Parents without parents (GR02)."""
    return edges.select(F.col("parent").alias("concept_id")).distinct().join(edges.select(F.col("child").alias("concept_id")), "concept_id", "left_anti")


def _doubled(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(ancestors, cycle): all (concept_id, ancestor) pairs, or the pairs of classes that are their own ancestors.

    A round that joins what is new with all pairs known doubles the levels covered, so a chain of n levels takes log2(n) rounds.
    Each pair is found anew in no round: what is known is left out before it is written.
    """
    known = fresh = cut(edges.select(F.col("child").alias("concept_id"), F.col("parent").alias("ancestor")).where("child IS NOT NULL AND parent IS NOT NULL").distinct())
    while not fresh.isEmpty():
        loops = fresh.where("concept_id = ancestor")
        if not loops.isEmpty():
            return known, loops
        way = lambda t, a, b: t.select(F.col("concept_id").alias(a), F.col("ancestor").alias(b))
        up = way(fresh, "concept_id", "via").join(way(known, "via", "ancestor"), "via").select("concept_id", "ancestor")
        down = way(known, "concept_id", "via").join(way(fresh, "via", "ancestor"), "via").select("concept_id", "ancestor")
        fresh = cut(up.union(down).distinct().join(known, ["concept_id", "ancestor"], "left_anti"))
        known = cut(known.union(fresh))
    return known, None


def closure(edges: DataFrame) -> DataFrame:
    """(concept_id, ancestor), each once (GR03); a cycle raises CycleError."""
    known, cycle = _doubled(edges)
    if cycle is not None:
        raise CycleError("a class is its own ancestor")
    return known


def levels(edges: DataFrame) -> DataFrame:
    """(concept_id, ancestor, level), each once, for each length of a path up; a cycle raises CycleError."""
    check_acyclic(edges)
    links = cut(edges.select("child", "parent").distinct())
    now = links.select(F.col("child").alias("concept_id"), F.col("parent").alias("ancestor"))
    out, level = now.withColumn("level", F.lit(1)), 1
    while not now.isEmpty():
        level += 1
        now = cut(now.join(links, F.col("ancestor") == F.col("child")).select("concept_id", F.col("parent").alias("ancestor")).distinct())
        out = out.union(now.withColumn("level", F.lit(level)))
        if level % 16 == 0:
            out = cut(out)
    return out


def depths(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """The longest path to the top, 0 for classes without parents (GR04).

    Round by round the classes without a parent left are taken off, so a class's round is its depth: one row
    a class, however many paths there are.  A cycle raises CycleError.
    """
    links = cut(edges.select("child", "parent").distinct())
    left = cut(links.select(F.col("child").alias("concept_id")).distinct())
    done, depth = None, 1
    while not left.isEmpty():
        open_ = links.join(left.withColumnRenamed("concept_id", "parent"), "parent", "left_semi").select(F.col("child").alias("concept_id"))
        now = left.join(open_, "concept_id", "left_anti").withColumn("depth", F.lit(depth))
        rest = cut(left.join(open_, "concept_id", "left_semi"))
        if rest.count() == left.count():
            raise CycleError("a class is its own ancestor")
        done = now if done is None else done.union(now)
        left, depth = rest, depth + 1
        if depth % 16 == 0:
            done = cut(done)  # a chain of many levels would make a plan of as many unions
    if done is None:
        return concepts.select("concept_id", F.lit(0).alias("depth"))
    return concepts.join(done, "concept_id", "left").select("concept_id", F.coalesce("depth", F.lit(0)).alias("depth"))


def check_acyclic(edges: DataFrame) -> None:
    """Raise CycleError if a class is its own ancestor (GR05)."""
    closure(edges)


def leaves_under(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """(ancestor, concept_id) for each leaf below a class (GR07)."""
    return closure(edges).join(leaves(concepts, edges), "concept_id", "left_semi").select("ancestor", "concept_id")


def internal_truth(truth: DataFrame, concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """A class is true of a document if any leaf below it is (GR08)."""
    below = leaves_under(concepts, edges)
    return truth.join(below, "concept_id").groupBy("document_id", "ancestor").agg(F.bool_or("matched").alias("matched"))


def next_to_ask(edges: DataFrame, asked: DataFrame, yes: DataFrame) -> DataFrame:
    """Top classes and children of classes answered yes, unless asked already (GR09); (document_id, concept_id)."""
    top = asked.select("document_id").distinct().crossJoin(F.broadcast(top_level(edges)))
    children = yes.join(F.broadcast(edges), yes["concept_id"] == edges["parent"]).select("document_id", F.col("child").alias("concept_id"))
    return top.union(children).distinct().join(asked, ["document_id", "concept_id"], "left_anti")


def structure(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """Each class with its parents and children and whether it is a leaf (OT29)."""
    parents = edges.groupBy(F.col("child").alias("concept_id")).agg(F.array_sort(F.collect_set("parent")).alias("parents"))
    children = edges.groupBy(F.col("parent").alias("concept_id")).agg(F.array_sort(F.collect_set("child")).alias("children"))
    return (
        concepts.join(parents, "concept_id", "left")
        .join(children, "concept_id", "left")
        .select("concept_id", F.coalesce("parents", F.array().cast("array<int>")).alias("parents"), F.coalesce("children", F.array().cast("array<int>")).alias("children"))
        .withColumn("is_leaf", F.size("children") == 0)
    )

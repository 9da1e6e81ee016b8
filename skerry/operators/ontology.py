"""Classes, relations, code trees and their versions as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.operators.hierarchy import check_acyclic
from skerry.plans.runs import snapshot_hash
from skerry.sources.sheets import upserted


def replaced_relations(concepts: DataFrame, relations: DataFrame, rows: DataFrame, predicate: str) -> DataFrame:
    """All relations of a predicate replaced by ``rows`` (child, parent), once they are known to be sound (GR06)."""
    if not rows.where("child = parent").isEmpty():
        raise ValueError("a class can't be related to itself")
    ends = rows.select(F.col("child").alias("concept_id")).union(rows.select(F.col("parent").alias("concept_id")))
    if not ends.join(concepts, "concept_id", "left_anti").isEmpty():
        raise ValueError("a relation names an unknown class")
    check_acyclic(rows)
    own = rows.select("child", "parent").distinct().withColumn("predicate", F.lit(predicate))
    return relations.where(F.col("predicate") != predicate).unionByName(own)


def upserted_concepts(concepts: DataFrame, rows: DataFrame, reword: bool = True) -> DataFrame:
    """Classes added or changed by name; rewording can be refused (ON01, SRC21)."""
    if not reword:
        old = concepts.select("name", F.col("definition").alias("_old"))
        if not rows.join(old, "name").where(~F.col("definition").eqNullSafe(F.col("_old"))).isEmpty():
            raise ValueError("an existing class would be reworded")
    return upserted(concepts, rows.select(*concepts.columns), ["name"])


def replaced_group(members: DataFrame, group: str, rows: DataFrame) -> DataFrame:
    """A group's members and weights replaced as a whole (OT24)."""
    own = rows.select(F.lit(group).alias("group"), "concept_id", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    return members.where(F.col("group") != group).unionByName(own)


def mint(snapshots: DataFrame, concepts: DataFrame) -> DataFrame:
    """Snapshots with one more if the wording isn't there yet (ON02, ON07); (version, content_hash)."""
    new = snapshot_hash(concepts).join(snapshots, "content_hash", "left_anti")
    last = snapshots.agg(F.coalesce(F.max("version"), F.lit(0)).alias("_last"))
    return snapshots.unionByName(new.crossJoin(last).select((F.col("_last") + 1).cast("int").alias("version"), "content_hash"))


def live_version(snapshots: DataFrame, concepts: DataFrame) -> DataFrame:
    """The version that the live wording is; null when it was edited since (OT33)."""
    return snapshot_hash(concepts).join(snapshots, "content_hash", "left").agg(F.max("version").alias("version"))


def resolved(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``requests`` with ``resolved``: the number that ``version`` (``latest`` or ``vN``) stands for, null where it is refused (ON03)."""
    # one row
    newest = F.broadcast(snapshots.agg(F.max("version").alias("_newest")))
    known = snapshots.select(F.col("version").alias("_known")).distinct()
    asked = requests.withColumn("_asked", F.when(F.col("version").rlike("^v[0-9]+$"), F.expr("try_cast(substring(version, 2) AS int)")))
    found = asked.join(known, F.col("_asked") == F.col("_known"), "left").crossJoin(newest)
    return found.select(*requests.columns, F.when(F.col("version") == "latest", F.col("_newest")).otherwise(F.col("_known")).alias("resolved"))


def resolve(version: str, known: list[int]) -> int:
    """``latest`` or ``vN`` as a number; others are refused (ON03)."""
    if version == "latest" and known:
        return max(known)
    if version.startswith("v") and version[1:].isdigit() and int(version[1:]) in known:
        return int(version[1:])
    raise ValueError(f"unknown version {version!r}")


def upserted_codes(codes: DataFrame, rows: DataFrame) -> DataFrame:
    """A code tree with rows added or renamed, and every code linked to its parent anew (ON06)."""
    from skerry.operators.matching import code_tree

    names = upserted(codes.select("system", "code", "name"), rows.select("system", "code", "name"), ["system", "code"])
    return code_tree(names.select("system", "code")).join(names, ["system", "code"])


def version_leaves(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """A version's leaves with their wording (RT11)."""
    return concepts.join(edges.select(F.col("parent").alias("concept_id")), "concept_id", "left_anti")


def refuse_reworded(then: DataFrame, now: DataFrame, leaves: DataFrame) -> None:
    """Refuse to reuse results if a leaf was reworded since (OT09)."""
    from skerry.plans.runs import stale_concepts

    if not stale_concepts(then, now).join(leaves, "concept_id", "left_semi").isEmpty():
        raise ValueError("a class was reworded since; its results can't be reused")


def document_status(labels: DataFrame, leaves: DataFrame) -> DataFrame:
    """Which documents carry a label for every leaf (BK04)."""
    counted = labels.join(leaves, "concept_id", "left_semi").groupBy("document_id").agg(F.countDistinct("concept_id").alias("labelled"))
    return counted.crossJoin(leaves.agg(F.count("*").alias("leaves"))).withColumn("complete", F.col("labelled") == F.col("leaves"))

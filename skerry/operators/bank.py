"""The label bank: upserts, adjudication, observations, staleness, annotation sets, reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.operators.metrics import PAIR, clean
from skerry.plans.blocks import in_blocks
from skerry.sources.sheets import upserted

TRUSTED = ("human", "adjudicated", "imported")


def label(bank: DataFrame, rows: DataFrame, version: str) -> DataFrame:
    """The bank with ``rows`` written over it, stamped with the ontology's version (BK01)."""
    return upserted(bank, rows.withColumn("version", F.lit(version)).select(*bank.columns), PAIR)


def adjudicate(bank: DataFrame, rulings: DataFrame, version: str) -> DataFrame:
    """Rulings make labels trusted and current again (BK02)."""
    rows = rulings.select(*PAIR, "matched").withColumns({"source": F.lit("adjudicated"), "version": F.lit(version)})
    rest = [c for c in bank.columns if c not in rows.columns]
    kept = bank.select(*PAIR, *rest) if rest else bank.select(*PAIR)
    return upserted(bank, rows.join(kept, PAIR, "left").select(*bank.columns), PAIR)


def observe(observations: DataFrame, rows: DataFrame, key: tuple[str, ...] = ("concept_id", "place_id", "occurred_on")) -> DataFrame:
    """Observations with the new ones added once (BK03); null parts of the key are equal to each other."""
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in key]
    fresh = rows.dropDuplicates(list(key)).alias("n").join(observations.alias("o"), same, "left_anti")
    return observations.unionByName(fresh)


def stale(bank: DataFrame, reworded: DataFrame) -> DataFrame:
    """Labels whose class was reworded since they were made; ``reworded``: version, concept_id (BK07)."""
    return bank.join(reworded, ["version", "concept_id"], "left_semi")


def trusted(bank: DataFrame, reworded: DataFrame) -> DataFrame:
    """Labels that count as truth (FLT12, OT23)."""
    return bank.where(F.col("source").isin(*TRUSTED)).join(reworded, ["version", "concept_id"], "left_anti").select(*PAIR, "matched")


def pending_adjudication(bank: DataFrame, limit: int) -> DataFrame:
    """Machine labels waiting for a ruling (BK07)."""
    return bank.where("source = 'machine'").orderBy(*PAIR).limit(limit)


def import_annotations(sets: DataFrame, rows: DataFrame, name: str, documents: DataFrame, leaves: DataFrame, replace: bool = False) -> DataFrame:
    """An annotation set extended or replaced by ``rows``, all or nothing (SRC18)."""
    unknown = rows.join(documents, "document_id", "left_anti").select("document_id").union(rows.join(leaves, "concept_id", "left_anti").select("document_id"))
    if not unknown.isEmpty():
        raise ValueError("a row names an unknown document or class; nothing was imported")
    own = rows.select(F.lit(name).alias("set"), *PAIR, "matched")
    rest = sets.where(F.col("set") != name) if replace else sets
    return upserted(rest, own, ["set", *PAIR])


def annotation_sets(names: DataFrame, sets: DataFrame) -> DataFrame:
    """Every set with its counts, empty ones too (JN08)."""
    counted = sets.groupBy("set").agg(F.count("*").alias("labels"), F.countDistinct("document_id").alias("documents"), F.count_if("matched").alias("positives"))
    return names.join(counted, "set", "left").fillna(0, ["labels", "documents", "positives"])


def import_links(links: DataFrame, rows: DataFrame, concepts: DataFrame, codes: DataFrame) -> DataFrame:
    """Links by name, all or nothing (SRC19); imported links are manual."""
    named = rows.join(concepts.select("concept_id", "concept"), "concept", "left").join(codes.select("system", "code", F.lit(True).alias("_known")), ["system", "code"], "left")
    if not named.where("concept_id IS NULL OR _known IS NULL").isEmpty():
        raise ValueError("a row names an unknown class or code; nothing was imported")
    own = named.select("concept_id", "system", "code", F.lit(None).cast("int").alias("linked_run"))
    return upserted(links, own, ["concept_id", "system", "code"])


def tick_link(links: DataFrame, concept: int, system: str, code: str, on: bool) -> DataFrame:
    """A link set or removed by hand; an automatic one that is ticked becomes manual (RT05)."""
    rest = links.where(~((F.col("concept_id") == concept) & (F.col("system") == system) & (F.col("code") == code)))
    if not on:
        return rest
    return rest.unionByName(links.sparkSession.createDataFrame([(concept, system, code, None)], links.select("concept_id", "system", "code", "linked_run").schema))


def reviews_to_export(matches: DataFrame, reviews: DataFrame, most: int = 5) -> DataFrame:
    """For entries still pending, the earliest matches without a review (SRC20)."""
    from pyspark.sql import Window

    confirmed = reviews.where("confirmed").select("entry_id").distinct()
    open_ = matches.join(confirmed, "entry_id", "left_anti").join(reviews.where("confirmed IS NOT NULL"), ["entry_id", "url"], "left_anti")
    place = F.row_number().over(Window.partitionBy("entry_id").orderBy("first_seen", F.asc_nulls_last("url")))
    return open_.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")


def first_reviews_to_export(members: DataFrame, matches: DataFrame, reviews: DataFrame, most: int = 5) -> DataFrame:
    """``reviews_to_export`` where entries share matches: ``members``: entry_id, key columns; ``matches``: the key columns, url, first_seen.

    Rows of a key differ by url.  An entry with n reviews needs the first most + n matches of each of its keys, so no
    entry meets all of them.
    """
    from pyspark.sql import Window

    key = [c for c in members.columns if c != "entry_id"]
    reviewed = reviews.where("confirmed IS NOT NULL").groupBy("entry_id").agg(F.countDistinct("url").alias("_reviewed"))
    open_ = members.join(reviews.where("confirmed").select("entry_id").distinct(), "entry_id", "left_anti").join(reviewed, "entry_id", "left")
    wanted = open_.select("entry_id", *key, (F.coalesce("_reviewed", F.lit(0)) + most).alias("_most"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("first_seen", F.asc_nulls_last("url")))
    first = matches.join(wanted.groupBy(*key).agg(F.max("_most").alias("_largest")), key).withColumn("_n", place).where("_n <= _largest").drop("_largest")
    offered = wanted.join(first, key).where("_n <= _most").select("entry_id", "url", "first_seen").distinct()
    return reviews_to_export(offered, reviews, most)


def import_reviews(reviews: DataFrame, rows: DataFrame) -> DataFrame:
    """Answers written over by (entry, address); blank ones are skipped (SRC20)."""
    return upserted(reviews, rows.where("confirmed IS NOT NULL").select(*reviews.columns), ["entry_id", "url"])


def supporting_documents(observations: DataFrame, truth: DataFrame, dated: DataFrame) -> DataFrame:
    """Documents with a positive label that fit an observation; its null place or day fits all (JN21).

    ``dated``: document_id, place_id, occurred_on.
    """
    positive = truth.where("matched").select(*PAIR).join(dated, "document_id")
    # four rows at most: whether place and day are asked for
    kinds = observations.select(F.col("place_id").isNotNull().alias("_at"), F.col("occurred_on").isNotNull().alias("_on")).distinct()
    known = (~F.col("_at") | F.col("place_id").isNotNull()) & (~F.col("_on") | F.col("occurred_on").isNotNull())
    offered = positive.crossJoin(F.broadcast(kinds)).where(known).select(
        F.col("concept_id").alias("_concept"), F.when(F.col("_at"), F.col("place_id")).alias("_place"), F.when(F.col("_on"), F.col("occurred_on")).alias("_day"), "document_id"
    )
    keyed = observations.where("concept_id IS NOT NULL").withColumns({"_c": F.col("concept_id"), "_p": F.col("place_id"), "_d": F.col("occurred_on")})
    blocks = in_blocks(keyed, ["_c", "_p", "_d"], observations.columns)
    fits = (F.col("_concept") == F.col("_c")) & F.col("_place").eqNullSafe(F.col("_p")) & F.col("_day").eqNullSafe(F.col("_d"))
    return offered.join(blocks, fits).select(F.inline("members"), "document_id")


def observation_recall(observations: DataFrame, pool: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Observations whose class was ranked at all, and those with a match of class and place (JN22)."""
    ranked = observations.join(pool.select("concept_id").distinct(), "concept_id", "left_semi")
    hits = clean(verdicts).where("matched").select("concept_id", "place_id").distinct().withColumn("_hit", F.lit(True))
    return ranked.join(hits, ["concept_id", "place_id"], "left").agg(F.count("*").alias("observations"), F.count("_hit").alias("detected"))


def error_rows(truth: DataFrame, verdicts: DataFrame, notes: DataFrame) -> DataFrame:
    """Wrong verdicts with what was said and the label's note (JN26)."""
    wrong = truth.withColumnRenamed("matched", "expected").join(clean(verdicts), PAIR).where(F.col("expected") != F.col("matched"))
    return wrong.join(notes, PAIR, "left")


def truth_of(bank: DataFrame, reworded: DataFrame, sets: DataFrame, name: str | None = None) -> DataFrame:
    """The human truth, or that of a named annotation set (BK05)."""
    return trusted(bank, reworded) if name is None else sets.where(F.col("set") == name).select(*PAIR, "matched")

"""Matching feed records to classes by linked codes and themes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tier_code(event: str = "event_code", base: str = "base_code", root: str = "root_code") -> Column:
    """The code of the first tier that carries one; an event code equal to its base counts as none (FLT01, FLT02).

    That tier decides, matched or not: there is no falling through to a coarser one.
    """
    blank = F.lit("")
    own = F.when(F.col(event).eqNullSafe(F.col(base)), None).otherwise(F.nullif(F.col(event), blank))
    return F.coalesce(own, F.nullif(F.col(base), blank), F.nullif(F.col(root), blank))


def fallback_chain(code: Column) -> Column:
    """A code and its coarser prefixes down to two digits, finest first (FLT04)."""
    sizes = F.sequence(F.length(code), F.lit(2), F.lit(-1))
    return F.when(F.length(code) >= 2, F.transform(sizes, lambda n: F.substring(code, F.lit(1), n))).otherwise(F.array(code))


def matched_events(events: DataFrame, links: DataFrame) -> DataFrame:
    """Events whose deciding code is linked, with the class (JN03, first half); links are a small dimension for AQE to size up."""
    cameo = links.where("system = 'cameo'").select("concept_id", F.col("code").alias("_code")).distinct()
    return events.withColumn("_code", tier_code()).join(cameo, "_code").withColumnRenamed("_code", "code")


def matched_articles(articles: DataFrame, links: DataFrame) -> DataFrame:
    """Articles with a linked theme; one row for each theme and class (FLT06 as a bridge table)."""
    themes = links.where("system = 'theme'").select("concept_id", F.col("code").alias("theme")).distinct()
    carried = articles.select("document_id", F.explode(F.array_distinct("themes")).alias("theme"))
    return carried.join(themes, "theme").select("document_id", "concept_id", F.col("theme").alias("code"))


def matching_documents(events: DataFrame, articles: DataFrame, links: DataFrame) -> DataFrame:
    """One class and code for each document; a coded event shadows themes, the smallest event id decides (JN03, SET02)."""
    by_event = matched_events(events, links).select("document_id", "concept_id", "code", F.lit(0).alias("way"), F.col("feed_event_id").alias("place"))
    by_theme = matched_articles(articles, links).select("document_id", "concept_id", "code", F.lit(1).alias("way"), F.lit(0).cast("long").alias("place"))
    first = F.min(F.struct("way", "place", "concept_id", "code")).alias("m")
    best = by_event.unionByName(by_theme).groupBy("document_id").agg(first)
    return best.select("document_id", "m.concept_id", "m.code", F.when(F.col("m.way") == 0, "cameo").otherwise("theme").alias("system"))


def carried_codes(events: DataFrame, articles: DataFrame, links: DataFrame) -> DataFrame:
    """Linked codes each document carries, once each (OT01)."""
    linked = links.select("system", "code").distinct()
    by_event = events.select("document_id", F.lit("cameo").alias("system"), tier_code().alias("code"))
    by_theme = articles.select("document_id", F.lit("theme").alias("system"), F.explode("themes").alias("code"))
    return by_event.unionByName(by_theme).join(linked, ["system", "code"], "left_semi").distinct()


def filter_preview(events: DataFrame, links: DataFrame) -> DataFrame:
    """How much of a feed the links keep (FLT19)."""
    codes = links.where("system = 'cameo'").select(F.col("code").alias("_code")).distinct()
    marked = events.withColumn("_code", tier_code()).join(codes.withColumn("_linked", F.lit(True)), "_code", "left")
    sums = marked.agg(
        F.count("*").alias("events"),
        F.count_if("_linked").alias("kept"),
        F.countDistinct("document_id").alias("documents"),
        F.countDistinct(F.when(F.col("_linked"), F.col("document_id"))).alias("documents_kept"),
    )
    return sums.withColumn("share", F.round(F.try_divide(F.col("kept").cast("double"), F.col("events").cast("double")), 6))


def code_report(events: DataFrame, articles: DataFrame, links: DataFrame) -> DataFrame:
    """Documents admitted by each code, and those that no other code admits (AGG15)."""
    carried = carried_codes(events, articles, links)
    alone = carried.groupBy("document_id").agg(F.count("*").alias("codes"))
    return carried.join(alone, "document_id").groupBy("system", "code").agg(F.count("*").alias("admitted"), F.count_if(F.col("codes") == 1).alias("only_this"))


def link_confusion(events: DataFrame, articles: DataFrame, links: DataFrame, truth: DataFrame) -> DataFrame:
    """Each link's hits and misses on labelled documents, and the hits that it alone makes (AGG13)."""
    hits = carried_codes(events, articles, links).join(links.select("concept_id", "system", "code").distinct(), ["system", "code"])
    keyed = hits.groupBy("document_id", "concept_id").agg(F.count("*").alias("ways"))
    judged = hits.join(keyed, ["document_id", "concept_id"]).join(truth, ["document_id", "concept_id"])
    return judged.groupBy("concept_id", "system", "code").agg(
        F.count_if("matched").alias("true_positives"), F.count_if(~F.col("matched")).alias("false_positives"), F.count_if(F.col("matched") & (F.col("ways") == 1)).alias("unique_true_positives")
    )


def code_tree(codes: DataFrame) -> DataFrame:
    """Codes with their parent, the code without its last character if that is a code (JN25)."""
    parents = codes.select("system", F.col("code").alias("_up"), F.col("code").alias("parent"))
    up = codes.withColumn("_up", F.expr("substring(code, 1, length(code) - 1)"))
    return up.join(parents, ["system", "_up"], "left").select("system", "code", "parent", F.length("code").alias("level"))


def covered(scope: Column, wanted: Column) -> Column:
    """Whether a slice done for ``scope`` covers ``wanted``; a null scope kept everything (FLT07)."""
    return scope.isNull() | (F.size(F.array_except(wanted, scope)) == 0)


def widened(scope: Column, wanted: Column) -> Column:
    """The union of both, sorted; null stays null (SET06)."""
    return F.array_sort(F.array_union(scope, wanted))


def replace_links(current: DataFrame, proposed: DataFrame, run: int) -> DataFrame:
    """Automatic links replaced by proposals, manual ones kept and never doubled (RT04)."""
    manual = current.where("linked_run IS NULL")
    added = proposed.join(manual.select("concept_id", "system", "code"), ["concept_id", "system", "code"], "left_anti")
    return manual.select("concept_id", "system", "code", "linked_run").unionByName(added.select("concept_id", "system", "code", F.lit(run).alias("linked_run")))

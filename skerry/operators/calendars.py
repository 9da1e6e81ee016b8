"""Known events with windows, followed from the feed to a match.

Windows are whole days; a feed record meets an entry on (place, day), an equi-join
that Spark partitions by key, and no range condition is left over.  Entries with equal windows
share one: what it holds is worked out once, and where a result is by entry, entries meet it last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.operators.metrics import clean
from skerry.plans.blocks import in_blocks

STAGES = ["in_feed", "passed_filter", "fetched", "retrieved", "judged", "matched"]
SLICES_PER_DAY = 96


def entry_days(calendar: DataFrame, before: int, after: int, key: str = "entry_id") -> DataFrame:
    """(key, place_id, day) for each day of each window, from ``before`` days ahead of the start to ``after`` behind it."""
    days = F.sequence(F.date_sub("starts_on", before), F.date_add("starts_on", after))
    return calendar.select(key, "place_id", F.explode(days).alias("day"))


def shared_windows(calendar: DataFrame, by: tuple[str, ...] = ("entry_id",)) -> tuple[DataFrame, DataFrame]:
    """(members, windows) of a calendar: ``members`` has ``by`` once each with its window, ``windows`` the places and first days of each window.

    Entries with equal places and first days have the same window, so there are no more
    windows than places times days unless entries have several rows.  Rows
    without a place or a day hold nothing.
    """
    dated = F.col("place_id").isNotNull() & F.col("starts_on").isNotNull()
    spans = calendar.groupBy(*by).agg(F.array_sort(F.collect_set(F.when(dated, F.struct("place_id", "starts_on")))).alias("_spans"))
    # its first member names a window; a struct is never null
    named = spans.groupBy("_spans").agg(F.min(F.struct(*by)).alias("window"))
    windows = named.select("window", F.explode("_spans").alias("_s")).select("window", "_s.place_id", "_s.starts_on")
    return spans.join(named, "_spans").select(*by, "window"), windows


def sightings(events: DataFrame, articles: DataFrame) -> DataFrame:
    """(document_id, place_id, day), once each: where and when either feed tells of a document."""
    coded = events.select("document_id", "place_id", F.to_date("occurred_at").alias("day"))
    told = articles.select("document_id", F.explode("place_ids").alias("place_id"), F.col("published_on").alias("day"))
    return coded.unionByName(told).distinct()


def window_sightings(windows: DataFrame, events: DataFrame, articles: DataFrame, before: int = 3, after: int = 3) -> DataFrame:
    """(window, document_id, first_seen): documents of either feed in each of the ``shared_windows``."""
    met = sightings(events, articles).join(entry_days(windows, before, after, "window"), ["place_id", "day"])
    return met.groupBy("window", "document_id").agg(F.min("day").alias("first_seen"))


def for_each_entry(found: DataFrame, members: DataFrame, key: list[str]) -> DataFrame:
    """Each row of ``found`` for each entry of its ``key`` in ``members`` (``key`` and entry_id), by blocks of entries."""
    return found.join(in_blocks(members, key, ["entry_id"]), key).select(F.inline("members"), *(c for c in found.columns if c not in key))


def window_documents(calendar: DataFrame, events: DataFrame, articles: DataFrame, before: int = 3, after: int = 3) -> DataFrame:
    """(entry_id, document_id, first_seen): documents of either feed at the place within the window (JN05, SET03).

    Nothing is shuffled after entries multiply the documents of their window.
    """
    members, windows = shared_windows(calendar)
    return for_each_entry(window_sightings(windows, events, articles, before, after), members, ["window"])


def days_to_ingest(calendar: DataFrame, before: int = 3, after: int = 3) -> DataFrame:
    """Each day that a window touches, with the places it needs (ST09)."""
    return entry_days(calendar, before, after).groupBy("day").agg(F.array_sort(F.collect_set("place_id")).alias("places"))


def stage_counts(
    calendar: DataFrame, members: DataFrame, seen: DataFrame, passed: DataFrame, articles: DataFrame, shown: DataFrame, verdicts: DataFrame
) -> DataFrame:
    """Documents of each entry at each stage, the first match, and the stage that lost it (AGG32, DD02).

    ``members``: entry_id, window; ``seen``: window, document_id, first_seen (``shared_windows``, ``window_sightings``).
    Copies read their representative; retrieved means shown, judged means a verdict.  What a window's documents
    are is counted by window, what was said of them by window and class: entries meet counts.
    """
    usable = articles.where(F.col("body").isNotNull() & ~F.col("is_junk")).select("document_id", F.coalesce("duplicate_of", "document_id").alias("rep"))
    known = passed.select("document_id").distinct().withColumn("passed", F.lit(True)).join(usable, "document_id", "left")
    found = seen.join(known, "document_id", "left")
    plain = found.groupBy("window").agg(
        F.count("*").alias("_documents"), F.count_if("passed").alias("_passed"), F.count("rep").alias("_reps"), F.countDistinct("rep").alias("unique_documents")
    )
    reps = usable.select("rep").distinct()
    offered = shown.select(F.col("document_id").alias("rep"), "concept_id").distinct().join(reps, "rep", "left_semi").withColumn("was_shown", F.lit(True))
    said = verdicts.select(F.col("document_id").alias("rep"), "concept_id", "matched").join(reps, "rep", "left_semi")
    told = said.groupBy("rep", "concept_id").agg(F.count("*").alias("_verdicts"), F.count_if("matched").alias("_hits"))
    answers = offered.join(told, ["rep", "concept_id"], "full")
    rows = calendar.select("entry_id", "concept_id").join(members, "entry_id")
    asked = found.where("rep IS NOT NULL").join(answers, "rep").join(rows.select("window", "concept_id").distinct(), ["window", "concept_id"], "left_semi")
    # a document with several verdicts counts once for each
    times = F.coalesce("_verdicts", F.lit(1).cast("long"))
    by_class = asked.groupBy("window", "concept_id").agg(
        F.sum(times - 1).alias("_more"),
        F.sum(F.when(F.col("was_shown"), times)).alias("_shown"),
        F.sum(F.when(F.col("was_shown"), F.col("_verdicts"))).alias("_judged"),
        F.sum(F.when(F.col("was_shown"), F.col("_hits"))).alias("_matched"),
        F.min(F.when(F.col("was_shown") & (F.col("_hits") > 0), F.col("first_seen"))).alias("_first"),
    )
    more = F.coalesce("_more", F.lit(0).cast("long"))
    counts = rows.join(plain, "window").join(by_class, ["window", "concept_id"], "left").groupBy("entry_id").agg(
        F.sum(F.col("_documents") + more).alias("in_feed"),
        F.sum(F.col("_passed") + more).alias("passed_filter"),
        F.sum(F.col("_reps") + more).alias("fetched"),
        F.sum("_shown").alias("retrieved"),
        F.sum("_judged").alias("judged"),
        F.sum("_matched").alias("matched"),
        F.min("_first").alias("first_match"),
        F.max("unique_documents").alias("unique_documents"),
    )
    every = calendar.select("entry_id", "kind").join(counts, "entry_id", "left")
    named = {c: F.coalesce(c, F.lit(0).cast("long")) for c in [*STAGES, "unique_documents"]}
    lost = F.when(F.lit(False), "")
    for stage in STAGES:
        lost = lost.when(F.col(stage) == 0, stage)
    return every.withColumns(named).withColumn("lost_at", lost)


def summary(stages: DataFrame) -> DataFrame:
    """Entries, detections and losses by kind (AGG31)."""
    detected = F.col("matched") > 0
    return stages.groupBy("kind").agg(
        F.count("*").alias("entries"),
        F.count_if(detected).alias("detected"),
        F.round(F.avg(detected.cast("double")), 6).alias("rate"),
        *(F.count_if(F.col("lost_at") == s).alias(f"lost_at_{s}") for s in STAGES),
    )


def lead_times(stages: DataFrame, calendar: DataFrame) -> DataFrame:
    """Days by which a detected precursor was seen before its disruption (JN23)."""
    targets = calendar.select(F.col("entry_id").alias("precursor_of"), F.col("starts_on").alias("target_starts"))
    reached = stages.select(F.col("entry_id").alias("precursor_of"), (F.col("matched") > 0).alias("disruption_detected"))
    seen = stages.where(F.col("first_match").isNotNull()).select("entry_id", "first_match")
    early = calendar.where("kind = 'precursor' AND precursor_of IS NOT NULL").select("entry_id", "precursor_of")
    joined = early.join(seen, "entry_id").join(targets, "precursor_of").join(reached, "precursor_of")
    return joined.select("entry_id", "precursor_of", F.datediff("target_starts", "first_match").alias("lead_days"), "disruption_detected")


def verified(matches: DataFrame, by: str = "entry_id") -> DataFrame:
    """True if a match was confirmed, false if all were refuted, else null (AGG33); ``confirmed`` is null while pending."""
    return matches.groupBy(by).agg(
        F.when(F.bool_or(F.coalesce("confirmed", F.lit(False))), True).when(F.bool_and(F.coalesce(~F.col("confirmed"), F.lit(False))), False).alias("verified")
    )


def readiness(calendar: DataFrame, slices: DataFrame, before: int = 3, after: int = 3, feeds: tuple[str, ...] = ("export", "gkg")) -> DataFrame:
    """Whether all slices of both feeds in a window are done, and whether the source published none (ST07, ST08).

    ``slices``: feed, day, status; counted by day first, so entries meet days, not slices.
    """
    done = F.col("status").isin("ok", "empty", "missing")
    daily = slices.groupBy("feed", "day").agg(F.count_if(done).alias("done"), F.count_if(done & (F.col("status") != "missing")).alias("published"))
    windows = entry_days(calendar, before, after).select("entry_id", "day").distinct()
    per_feed = windows.join(daily, "day").groupBy("entry_id", "feed").agg(F.sum("done").alias("done"), F.sum("published").alias("published"))
    needed = SLICES_PER_DAY * (before + after + 1)
    per_entry = per_feed.groupBy("entry_id").agg(F.count_if(F.col("done") >= needed).alias("complete"), F.sum("published").alias("published"))
    joined = calendar.select("entry_id").join(per_entry, "entry_id", "left")
    return joined.select(
        "entry_id", (F.coalesce("complete", F.lit(0)) == len(feeds)).alias("ready"), (F.coalesce("published", F.lit(0)) == 0).alias("unobservable")
    )


def detections(verdicts: DataFrame, truth: DataFrame, seen: DataFrame, minimum: float = 0.0) -> DataFrame:
    """Matched verdicts as events by concept, place and day, with their documents' labels (JN20, AGG11)."""
    found = clean(verdicts).where(F.col("matched") & (F.coalesce("confidence", F.lit(0.0)) >= minimum))
    labelled = found.drop("matched").join(truth.withColumnRenamed("matched", "confirmed"), ["document_id", "concept_id"], "left")
    dated = labelled.join(seen, "document_id", "left")
    events = dated.groupBy("concept_id", "place_id", "occurred_on").agg(
        F.countDistinct("document_id").alias("documents"),
        F.count_if("confirmed").alias("confirmed"),
        F.count_if(~F.col("confirmed")).alias("rejected"),
        F.max("confidence").alias("max_confidence"),
    )
    status = F.when(F.col("confirmed") > 0, "confirmed").when((F.col("rejected") > 0) & (F.col("rejected") == F.col("documents")), "rejected").otherwise("unverified")
    return events.withColumn("verification", status)

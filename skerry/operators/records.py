"""Lookups over run records, link snapshots, code texts and fetch states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.operators import ranking
from skerry.operators.metrics import PAIR
from skerry.plans.cuts import cut


def with_text_key(rows: DataFrame, fields: str, key: str = "text_key") -> DataFrame:
    """Rows embedded from a set of fields, whatever the wording (FLT14); a text key is ``fields@digest``."""
    return rows.where(F.col(key).startswith(f"{fields}@"))


def processed_entries(calendar: DataFrame, processed: DataFrame) -> DataFrame:
    """Calendar entries whose window was worked through (FLT21)."""
    return calendar.join(processed.select("entry_id").distinct(), "entry_id", "left_semi")


def without_record(verdicts: DataFrame, shown: DataFrame) -> DataFrame:
    """Runs that have verdicts but no record of what was shown (JN10); (run_id)."""
    return verdicts.select("run_id").distinct().join(shown.select("run_id").distinct(), "run_id", "left_anti")


def reusable_runs(runs: DataFrame, stored: DataFrame) -> DataFrame:
    """For each run the newest earlier one with its key that has stored results (JN12); (run_id, source_run_id)."""
    able = runs.join(stored.select("run_id").distinct(), "run_id", "left_semi").select(F.col("run_id").alias("source_run_id"), "key")
    earlier = runs.join(able, "key").where("source_run_id < run_id")
    return earlier.groupBy("run_id").agg(F.max("source_run_id").alias("source_run_id"))


def top_codes(scored: DataFrame, limit: int, by: str = "concept_id") -> DataFrame:
    """The codes nearest to each class (TOP02); (concept_id, code, score)."""
    return ranking.budget(scored, limit, [by], "score", ("code",))


def labelled_documents(truth: DataFrame, limit: int | None = None) -> DataFrame:
    """Documents with labels, those with most positives first (TOP10)."""
    counted = truth.groupBy("document_id").agg(F.count_if("matched").alias("positives"), F.count("*").alias("labels"))
    ordered = counted.orderBy(F.desc("positives"), "document_id")
    return ordered.limit(limit) if limit else ordered


def link_set(live: DataFrame, snapshots: DataFrame, version: str | None = None) -> DataFrame:
    """The links of a snapshot, or the live ones (OT02); (concept_id, system, code)."""
    rows = live if version is None else snapshots.where(F.col("version") == version)
    return rows.select("concept_id", "system", "code").distinct()


def has_links(links: DataFrame) -> DataFrame:
    """One row: whether there is any link (OT03); at most one row is read."""
    return links.limit(1).agg((F.count("*") > 0).alias("any_link"))


def snapshot_uses(snapshots: DataFrame, runs: DataFrame, live: DataFrame) -> DataFrame:
    """Each link snapshot with the runs made with it, and whether it is what is live now (OT34).

    Link sets are compared by the number and a commutative hash of their links.
    """
    link = F.xxhash64("concept_id", "system", "code")
    marks = (F.count("*").alias("links"), F.bit_xor(link).alias("mark"))
    each = snapshots.select("version", "concept_id", "system", "code").distinct().groupBy("version").agg(*marks)
    now = live.select("concept_id", "system", "code").distinct().agg(*marks).withColumn("_live", F.lit(True))
    users = runs.groupBy("version").agg(F.array_sort(F.collect_set("run_id")).alias("runs"))
    joined = each.join(now, ["links", "mark"], "left").join(users, "version", "left")
    return joined.select("version", "links", F.coalesce("runs", F.array().cast("array<int>")).alias("runs"), F.coalesce("_live", F.lit(False)).alias("is_live"))


def stage_versions(runs: DataFrame, versions: DataFrame) -> DataFrame:
    """Each run's version of every stage, null for a stage that it hasn't (OT18); ``versions``: run_id, stage, version."""
    wide = versions.groupBy("run_id").pivot("stage", ["filter", "retrieval", "judge"]).agg(F.max("version"))
    return runs.select("run_id").join(wide, "run_id", "left")


def retrieval_versions(runs: DataFrame) -> DataFrame:
    """Retrieval versions over runs, newest first, with the cutoffs their runs were made with (OT30).

    ``runs``: run_id, version, min_score, margin, max_k.
    """
    presets = F.array_sort(F.collect_set(F.struct("min_score", "margin", "max_k")))
    grouped = runs.groupBy("version").agg(F.max("run_id").alias("newest_run"), F.count("*").alias("runs"), presets.alias("cutoffs"))
    return grouped.orderBy(F.desc("newest_run"))


def judged_runs(verdicts: DataFrame) -> DataFrame:
    """Runs that judged, with their verdicts (OT31)."""
    return verdicts.groupBy("run_id").agg(F.count("*").alias("verdicts"))


def both_cutoffs(pool: DataFrame, truth: DataFrame, asked: dict, own: dict) -> DataFrame:
    """The report of the cutoff asked for beside that of the run's own, worked out once if they are equal (OT32)."""

    def report(cutoff: dict) -> DataFrame:
        return ranking.cutoff_report(ranking.adaptive(pool, cutoff["min_score"], cutoff["margin"], cutoff["max_k"]), truth)

    first = report(asked).withColumn("cutoff", F.lit("asked"))
    if asked == own:
        return first.withColumn("cutoff", F.explode(F.array(F.lit("asked"), F.lit("own"))))
    return first.unionByName(report(own).withColumn("cutoff", F.lit("own")))


def live_cutoffs(documents: DataFrame, leaves: DataFrame, truth: DataFrame, asked: dict, own: dict, size: int = 20) -> DataFrame:
    """Both cutoffs of the live version: documents and leaves (with their vectors) are ranked here, once (AGG42, OT32)."""
    return both_cutoffs(cut(ranking.pool(documents, leaves, size)), truth, asked, own)


def proposable_texts(codes: DataFrame, readable: Column, uses: Column, least: int = 10_000) -> DataFrame:
    """(code, text) of themes that may be proposed: no taxonomy terms, used often enough (OT19, FLT17)."""
    return codes.where(~F.col("code").startswith("TAX_") & (uses >= least)).select("code", readable.alias("text"))


def unfetched(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """How many of these documents were never fetched (OT21)."""
    return documents.join(ids.distinct(), "document_id", "left_semi").agg(F.count_if(F.col("fetched_at").isNull()).alias("unfetched"))


def window_slices(calendar: DataFrame, slices: DataFrame, before: int = 3, after: int = 3) -> DataFrame:
    """Slices of each entry's window by feed, with how many are done for a scope that covers the entry's place (OT22).

    ``slices``: feed, slot (quarter hours), status, scope (places or null for all).
    """
    first, last = F.unix_date("starts_on") - before, F.unix_date("ends_on") + after + 1
    # an entry meets the slices of its days only
    days = calendar.select("entry_id", "place_id", F.explode(F.sequence(first, last - 1)).alias("day"))
    placed = slices.withColumn("day", F.floor(F.col("slot") / 96).cast("int"))
    done = F.col("status").isin("ok", "empty") & (F.col("scope").isNull() | F.array_contains("scope", F.col("place_id")))
    return days.join(placed, "day").groupBy("entry_id", "feed").agg(F.count("*").alias("slices"), F.count_if(done).alias("covered"))


def needed(rows: DataFrame, *columns: str) -> DataFrame:
    """The columns a scan needs, and so all it reads (SRC28); a columnar scan streams by itself."""
    return rows.select(*columns)


def to_drain(pending: DataFrame, deferred: DataFrame, budget: int) -> DataFrame:
    """The next documents to fetch, oldest first, without those that are held back until later (ST11).

    ``pending``: document_id, first_seen; ``deferred``: document_id.
    """
    return pending.join(deferred, "document_id", "left_anti").orderBy("first_seen", "document_id").limit(budget)


def wait_seconds(failures: Column, to_next: Column, base: int = 30, most: int = 900) -> Column:
    """How long a poller waits: until the next boundary, or after failures a time that doubles up to ``most`` (ST06)."""
    return F.when(failures == 0, to_next).otherwise(F.least(F.lit(most), base * F.pow(F.lit(2), F.least(failures - 1, F.lit(30)))).cast("long"))


def run_calendar_recall(entries: DataFrame, processed: DataFrame, matched: DataFrame) -> DataFrame:
    """Share of a run's own processed events that it detected (OT17, EV05); ``matched``: entry_id."""
    events = processed_entries(entries.where("kind = 'event'"), processed)
    hits = events.join(matched.select("entry_id").distinct().withColumn("_hit", F.lit(True)), "entry_id", "left")
    counted = hits.agg(F.count("*").alias("events"), F.count("_hit").alias("detected"))
    return counted.withColumn("recall", F.when(F.col("events") > 0, F.round(F.col("detected") / F.col("events"), 6)))


def pair_priorities(queue: DataFrame, limit: int) -> DataFrame:
    """The first of the labelling queue (TOP06)."""
    return queue.orderBy(F.desc("priority"), *PAIR).limit(limit)

"""Evaluations put together from several operators: of a calendar, of links on it, of a live retrieval version, of a run on the sample."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions.rates import rate, wilson
from skerry.operators import calendars as C
from skerry.operators import metrics as M
from skerry.operators import records
from skerry.operators import sampling as S


@dataclass(frozen=True)
class CalendarEvaluation:
    """Frames of one run on a calendar; ``entries`` has the stages of each processed entry."""

    entries: DataFrame
    not_processed: DataFrame
    summary: DataFrame
    lead_times: DataFrame
    cost: DataFrame


def evaluate_calendar(
    calendar: DataFrame, processed: DataFrame, events: DataFrame, articles: DataFrame, passed: DataFrame, shown: DataFrame, verdicts: DataFrame,
    reviews: DataFrame | None = None, before: int = 3, after: int = 3,
) -> CalendarEvaluation:
    """One run against a calendar, entry by entry and in sum (EV05).

    Only entries whose window the run processed are scored.  ``shown`` and ``verdicts``
    are the run's; ``reviews``, if there are any, (entry_id, document_id, confirmed) as
    people confirmed or refuted matches, gives ``verified``.  The cost is the whole
    run's, so windows that share documents aren't counted twice.
    """
    own = records.processed_entries(calendar, processed)
    members, windows = C.shared_windows(own)
    seen = C.window_sightings(windows, events, articles, before, after)
    stages = C.stage_counts(own, members, seen, passed, articles, shown, verdicts)
    if reviews is not None:
        stages = stages.join(C.verified(reviews), "entry_id", "left")
    missing = calendar.join(processed.select("entry_id"), "entry_id", "left_anti").select("entry_id")
    return CalendarEvaluation(stages, missing, C.summary(stages), C.lead_times(stages, own), M.judging_cost(verdicts))


def reach(calendar: DataFrame, members: DataFrame, seen: DataFrame, carried: DataFrame, links: DataFrame) -> DataFrame:
    """Each entry with whether any of its documents was seen, any link reaches it, and a link of its own class does (AGG14).

    ``calendar``: entry_id, kind, concept_id; ``members``: entry_id, concept_id, window; ``seen``: window, document_id;
    ``carried``: document_id, system, code.  What a window and a class in it have is found before entries meet it.
    """
    codes = window_codes(seen, carried)
    own = own_codes(members, codes, links).select("window", "concept_id").distinct().withColumn("own", F.lit(True))
    some = seen.select("window").distinct().join(codes.select("window").distinct().withColumn("any", F.lit(True)), "window", "left").withColumn("some", F.lit(True))
    met = members.join(some, "window").join(own, ["window", "concept_id"], "left")
    # an entry with several rows has several classes or windows
    found = met.groupBy("entry_id").agg(*(F.bool_or(c).alias(c) for c in ("some", "any", "own")))
    flags = {"observable": "some", "reached": "any", "reached_by_own_class": "own"}
    joined = calendar.select("entry_id", "kind", "concept_id").join(found, "entry_id", "left")
    return joined.select("entry_id", "kind", "concept_id", *(F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()))


def window_codes(seen: DataFrame, carried: DataFrame) -> DataFrame:
    """(window, system, code): the codes that documents of a window carry."""
    return seen.select("window", "document_id").join(carried, "document_id").select("window", "system", "code").distinct()


def own_codes(members: DataFrame, codes: DataFrame, links: DataFrame) -> DataFrame:
    """(window, concept_id, system, code): the codes of a window by which each class of its entries reaches it (AGG14)."""
    classed = codes.join(members.select("window", "concept_id").distinct(), "window")
    return classed.join(links.select("concept_id", "system", "code").distinct(), ["concept_id", "system", "code"], "left_semi").select("window", "concept_id", "system", "code")


def reach_by_kind(reached: DataFrame) -> DataFrame:
    """Entries of each kind, and how many can be seen and are reached (AGG14), from ``reach``."""
    flags = ("observable", "reached", "reached_by_own_class")
    return reached.groupBy("kind").agg(F.count("*").alias("entries"), *(F.count_if(c).alias(c) for c in flags))


def missed_by_own_class(reached: DataFrame) -> DataFrame:
    """Entries that could be seen and that no link of their own class reaches (AGG14), from ``reach``."""
    return reached.where("observable AND NOT reached_by_own_class").select("entry_id", "kind", "concept_id")


def _with_ranks(pool: DataFrame, truth: DataFrame) -> DataFrame:
    """Positives of ranked documents with their rank and whether they were kept."""
    ranked = pool.select("document_id").distinct()
    positives = truth.where("matched").select(*M.PAIR).join(ranked, "document_id", "left_semi")
    return positives.join(pool.select(*M.PAIR, "rank", "kept"), M.PAIR, "left")


def live_report(pool: DataFrame, truth: DataFrame, digits: int = 6) -> DataFrame:
    """One row: a retrieval version on all labelled documents, ranked afresh (AGG42).

    ``pool``: document_id, concept_id, rank, kept, of the labelled documents whose
    vectors are known; documents without any are counted and not scored.
    """
    labelled = truth.select("document_id").distinct()
    ranked = pool.select("document_id").distinct()
    counts = labelled.join(ranked.withColumn("_r", F.lit(True)), "document_id", "left").agg(F.count("*").alias("labelled"), F.count("_r").alias("ranked"))
    kept = pool.where("kept").select(*M.PAIR).join(truth, M.PAIR, "left")
    sums = kept.agg(F.count("*").alias("pairs_kept"), F.count("matched").alias("kept_labelled"), F.count_if("matched").alias("kept_positive"))
    hits = _with_ranks(pool, truth).agg(F.count("*").alias("positives"), F.count("rank").alias("in_pool"), F.count_if("kept").alias("found"))
    low, high = wilson(F.col("found"), F.col("positives"))
    pool_low, pool_high = wilson(F.col("in_pool"), F.col("positives"))
    figures = {
        "not_embedded": F.col("labelled") - F.col("ranked"),
        "pairs_per_document": rate(F.col("pairs_kept"), F.col("ranked")),
        "recall": rate(F.col("found"), F.col("positives")),
        "recall_low": low,
        "recall_high": high,
        "pool_recall": rate(F.col("in_pool"), F.col("positives")),
        "pool_recall_low": pool_low,
        "pool_recall_high": pool_high,
        "lost_to_cutoff": F.col("in_pool") - F.col("found"),
        "never_ranked": F.col("positives") - F.col("in_pool"),
    }
    whole = {"not_embedded", "lost_to_cutoff", "never_ranked"}
    # single rows
    row = counts.crossJoin(sums).crossJoin(hits)
    return row.select(*row.columns, *((c if n in whole else F.round(c, digits)).alias(n) for n, c in figures.items()))


def live_recall_curve(pool: DataFrame, truth: DataFrame) -> DataFrame:
    """(k, recall) of a live version for each k up to the largest rank (AGG42)."""
    ranked = pool.select("document_id").distinct()
    return M.recall_curve(truth.join(ranked, "document_id", "left_semi"), pool)


def live_classes(pool: DataFrame, truth: DataFrame) -> DataFrame:
    """Positives of each class, those in the pool and those kept; the classes that lose most come first (AGG42)."""
    counted = _with_ranks(pool, truth).groupBy("concept_id").agg(F.count("*").alias("positives"), F.count("rank").alias("in_pool"), F.count_if("kept").alias("kept"))
    return counted.orderBy(F.col("kept") - F.col("positives"), "concept_id")


def labelled_sample(order: DataFrame, labels: DataFrame, leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(truth over the labelled prefix of a frozen order, documents labelled out of turn).

    A document is labelled when it has a label on every leaf.
    """
    on_leaves = labels.join(F.broadcast(leaves.select("concept_id").distinct()), "concept_id", "left_semi").select(*M.PAIR, "matched")
    needed = leaves.select("concept_id").distinct().agg(F.count("*").alias("_needed"))
    complete = on_leaves.groupBy("document_id").agg(F.count_distinct("concept_id").alias("_n")).join(needed, F.col("_n") == F.col("_needed")).select("document_id")
    placed = S.labelled_prefix(order, complete)
    truth = on_leaves.join(placed.where("in_prefix").select("document_id", "position"), "document_id")
    return truth, placed.where("NOT in_prefix").select("document_id")


def run_on_sample(order: DataFrame, labels: DataFrame, leaves: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores, errors, documents labelled out of turn) of a run on the labelled prefix of the sample (EV03).

    ``errors``: each pair the run got wrong, by the document's position from 1.  A pair
    without a clean verdict counts as a no.
    """
    truth, out_of_turn = labelled_sample(order, labels, leaves)
    said = M.answers(truth, verdicts)
    scores = M.with_intervals(M.confusion(said))
    kind = F.when(F.col("predicted"), "false positive").otherwise("false negative")
    wrong = said.where(F.col("predicted") != F.col("matched")).select((F.col("position") + 1).alias("position"), *M.PAIR, kind.alias("kind"))
    return scores, wrong.orderBy("position", "concept_id"), out_of_turn

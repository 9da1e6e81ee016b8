"""Scores of verdicts and rankings against labels.

Pairs are keyed by (document_id, concept_id).  All operators aggregate once over
an equi-join on the key; Catalyst's partial aggregates keep what is shuffled small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions.rates import mcnemar, rate, wilson

PAIR = ["document_id", "concept_id"]


def clean(verdicts: DataFrame) -> DataFrame:
    """Verdicts without an error and with an answer (FLT13)."""
    return verdicts.where(F.col("error").isNull() & F.col("matched").isNotNull())


def answers(asked: DataFrame, verdicts: DataFrame, to: str = "predicted") -> DataFrame:
    """Each asked pair with its clean answer; a pair without one is a no (JN15, JN16)."""
    given = clean(verdicts).select(*PAIR, F.col("matched").alias(to))
    return asked.join(given, PAIR, "left").withColumn(to, F.coalesce(to, F.lit(False)))


def confusion_counts(expected: Column, predicted: Column) -> list[Column]:
    return [
        F.count_if(expected & predicted).alias("tp"),
        F.count_if(~expected & predicted).alias("fp"),
        F.count_if(~expected & ~predicted).alias("tn"),
        F.count_if(expected & ~predicted).alias("fn"),
    ]


def with_scores(counts: DataFrame, digits: int = 6) -> DataFrame:
    """Precision, recall, F1 and accuracy beside tp, fp, tn and fn."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.withColumns(
        {
            "n": tp + fp + tn + fn,
            "precision": F.round(rate(tp, tp + fp), digits),
            "recall": F.round(rate(tp, tp + fn), digits),
            "f1": F.round(rate(2 * tp, 2 * tp + fp + fn), digits),
            "accuracy": F.round(rate(tp + tn, tp + fp + tn + fn), digits),
        }
    )


def confusion(pairs: DataFrame, expected: str = "matched", predicted: str = "predicted", by: tuple[str, ...] = ()) -> DataFrame:
    """AGG09, for each value of ``by``."""
    return with_scores(pairs.groupBy(*by).agg(*confusion_counts(F.col(expected), F.col(predicted))))


def with_intervals(scored: DataFrame, digits: int = 6) -> DataFrame:
    """Wilson intervals of precision and recall (AGG16)."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    (p_low, p_high), (r_low, r_high) = wilson(tp, tp + fp), wilson(tp, tp + fn)
    named = {"precision_low": p_low, "precision_high": p_high, "recall_low": r_low, "recall_high": r_high}
    return scored.withColumns({k: F.round(v, digits) for k, v in named.items()})


def paired(truth: DataFrame, a: DataFrame, b: DataFrame, digits: int = 6) -> DataFrame:
    """McNemar's test of two runs on the labelled pairs that both answered (AGG21, JN17)."""
    both = (
        truth.join(clean(a).select(*PAIR, F.col("matched").alias("a")), PAIR).join(clean(b).select(*PAIR, F.col("matched").alias("b")), PAIR)
    )
    right_a, right_b = F.col("a") == F.col("matched"), F.col("b") == F.col("matched")
    counted = both.agg(
        F.count("*").alias("n_pairs"),
        F.count_if(right_a & right_b).alias("both_correct"),
        F.count_if(right_a & ~right_b).alias("only_a_correct"),
        F.count_if(right_b & ~right_a).alias("only_b_correct"),
        F.count_if(~right_a & ~right_b).alias("both_wrong"),
    )
    statistic, p = mcnemar(F.col("only_a_correct"), F.col("only_b_correct"))
    return counted.select(
        "*", (F.col("only_a_correct") + F.col("only_b_correct")).alias("discordant"), F.round(statistic, digits).alias("statistic"), F.round(p, digits).alias("p_value")
    )


def calibration(rows: DataFrame, confidence: str = "confidence", correct: str = "correct", bins: int = 5, digits: int = 6) -> DataFrame:
    """Equal bins of confidence, the last one closed; empty bins have a null accuracy (AGG22)."""
    spark = rows.sparkSession
    inside = rows.where(F.col(confidence).between(0, 1))
    number = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    found = inside.groupBy(number.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy"))
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").select(
        "bin",
        F.round(F.col("bin") / bins, 3).alias("low"),
        F.round((F.col("bin") + 1) / bins, 3).alias("high"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"),
        F.round("accuracy", digits).alias("accuracy"),
    )


def retrieval_metrics(truth: DataFrame, pool: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), digits: int = 6) -> DataFrame:
    """Recall at k, MRR over all positives, precision over labelled candidates, coverage, cutoff recall (AGG23)."""
    joined = truth.join(pool.select(*PAIR, "rank", "selected", F.lit(True).alias("in_pool")), PAIR, "full")
    positive, ranked = F.coalesce(F.col("matched"), F.lit(False)), F.col("in_pool").isNotNull()
    labelled = ranked & F.col("matched").isNotNull()
    sums = joined.agg(
        F.count_if(positive).alias("n_positives"),
        F.count_if(positive & ranked).alias("n_positives_ranked"),
        F.count_if(labelled).alias("labelled_candidates"),
        F.count_if(ranked).alias("total_candidates"),
        F.count_if(labelled & positive).alias("true_positives"),
        F.count_if(positive & ranked & F.col("selected")).alias("kept"),
        F.sum(F.when(positive & ranked, 1 / F.col("rank"))).alias("reciprocal"),
        *(F.count_if(positive & (F.col("rank") <= k)).alias(f"at_{k}") for k in ks),
    )
    n = F.col("n_positives")
    return sums.select(
        *(F.round(rate(F.col(f"at_{k}"), n), digits).alias(f"recall_at_{k}") for k in ks),
        F.round(rate(F.coalesce("reciprocal", F.lit(0.0)), n), digits).alias("mrr"),
        "n_positives",
        "n_positives_ranked",
        F.round(rate(F.col("true_positives"), F.col("labelled_candidates")), digits).alias("precision"),
        F.round(rate(F.col("labelled_candidates"), F.col("total_candidates")), digits).alias("coverage"),
        "labelled_candidates",
        "total_candidates",
        F.round(rate(F.col("kept"), F.col("n_positives_ranked")), digits).alias("cutoff_recall"),
    )


def recall_curve(truth: DataFrame, pool: DataFrame, digits: int = 6) -> DataFrame:
    """Recall at every k up to the largest rank (AGG24): counts by rank, then a running sum over ranks, not over rows."""
    positives = truth.where("matched")
    hits = positives.join(pool.select(*PAIR, "rank"), PAIR).groupBy("rank").agg(F.count("*").alias("hits"))
    size = pool.agg(F.max("rank").alias("size"))
    total = positives.agg(F.count("*").alias("total"))
    ks = size.select(F.explode(F.sequence(F.lit(1), "size")).alias("k"))
    from pyspark.sql import Window

    so_far = F.sum(F.coalesce("hits", F.lit(0))).over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return ks.join(hits, F.col("k") == F.col("rank"), "left").crossJoin(total).select("k", F.round(rate(so_far, F.col("total")), digits).alias("recall"))


def shown_metrics(truth: DataFrame, shown: DataFrame, digits: int = 6) -> DataFrame:
    """Recall, precision and coverage of what was shown, on documents with a shown record (AGG25)."""
    covered = shown.select("document_id").distinct()
    on = truth.join(covered, "document_id", "left_semi")
    both = on.join(shown.select(*PAIR, F.lit(True).alias("was_shown")).distinct(), PAIR, "left")
    seen = F.col("was_shown").isNotNull()
    sums = both.agg(
        F.count_if("matched").alias("positives"), F.count_if(F.col("matched") & seen).alias("shown_positives"), F.count_if(seen).alias("labelled_shown")
    )
    total = shown.select(*PAIR).distinct().agg(F.count("*").alias("shown_pairs"))
    return sums.crossJoin(total).select(
        "positives",
        "shown_positives",
        F.round(rate(F.col("shown_positives"), F.col("positives")), digits).alias("recall"),
        F.round(rate(F.col("shown_positives"), F.col("labelled_shown")), digits).alias("precision"),
        F.round(rate(F.col("labelled_shown"), F.col("shown_pairs")), digits).alias("coverage"),
    )


def liveness(verdicts: DataFrame) -> DataFrame:
    """Errors, unparsed and clean verdicts of each run (AGG26)."""
    failed, silent = F.col("error").isNotNull(), F.col("error").isNull() & F.col("matched").isNull()
    return (
        verdicts.groupBy("run_id")
        .agg(F.count("*").alias("verdicts"), F.count_if(failed).alias("errors"), F.count_if(silent).alias("unparsed"))
        .withColumn("clean", F.col("verdicts") - F.col("errors") - F.col("unparsed"))
        .withColumn("ok", (F.col("errors") == 0) & (F.col("unparsed") == 0) & (F.col("verdicts") > 0))
    )


def determinism(a: DataFrame, b: DataFrame, digits: int = 6) -> DataFrame:
    """Agreement and flips of two runs over pairs both answered (AGG27)."""
    both = clean(a).select(*PAIR, F.col("matched").alias("a")).join(clean(b).select(*PAIR, F.col("matched").alias("b")), PAIR)
    counted = both.agg(F.count("*").alias("shared"), F.count_if(F.col("a") != F.col("b")).alias("flips"))
    return counted.withColumn("agreement", F.round(rate(F.col("shared") - F.col("flips"), F.col("shared")), digits))


def cross_document(verdicts: DataFrame, digits: int = 6) -> DataFrame:
    """How far documents on the same concept and place agree, for groups of two or more (AGG28)."""
    grouped = clean(verdicts).groupBy("concept_id", "place_id").agg(F.count("*").alias("n"), F.count_if("matched").alias("yes"))
    return grouped.where("n >= 2").withColumn("agreement", F.round(rate(F.greatest("yes", F.col("n") - F.col("yes")), F.col("n")), digits))


def usable_confidence(verdicts: DataFrame, digits: int = 6) -> DataFrame:
    """Whether a run's confidence carries a signal: enough values, spread, and a share inside the ends (AGG29)."""
    rows = verdicts.where(F.col("confidence").isNotNull() & F.col("error").isNull())
    inner = (F.col("confidence") > 0.15) & (F.col("confidence") < 0.85)
    stats = rows.groupBy("run_id").agg(
        F.count("*").alias("n"), F.stddev_pop("confidence").alias("spread"), F.avg(inner.cast("double")).alias("interior")
    )
    usable = (F.col("n") >= 20) & (F.col("spread") >= 0.05) & (F.col("interior") >= 0.05)
    return stats.select("run_id", "n", F.round("spread", digits).alias("spread"), F.round("interior", digits).alias("interior"), usable.alias("usable"))


def judging_cost(verdicts: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Pairs, documents, tokens and seconds spent (AGG05)."""
    return verdicts.groupBy(*by).agg(
        F.count("*").alias("pairs"),
        F.countDistinct("document_id").alias("documents"),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"),
        F.round(F.coalesce(F.sum("seconds"), F.lit(0.0)), 3).alias("seconds"),
    )


def voted(samples: DataFrame, by: list[str], how: str = "majority", matched: str = "matched", order: str = "sample") -> DataFrame:
    """One answer from several samples of each group: majority, unanimous or any (AGG34).

    ``first_sample``: the first sample that agrees with the answer, else the first.
    """
    yes, n = F.count_if(matched), F.count("*")
    counted = samples.groupBy(*by).agg(
        n.alias("samples"),
        yes.alias("yes"),
        F.min(order).alias("_any"),
        F.min(F.when(F.col(matched), F.col(order))).alias("_yes"),
        F.min(F.when(~F.col(matched), F.col(order))).alias("_no"),
    )
    rules = {"majority": F.col("yes") * 2 > F.col("samples"), "unanimous": F.col("yes") == F.col("samples"), "any": F.col("yes") > 0}
    winner = rules[how]
    agreeing = F.when(winner, F.col("yes")).otherwise(F.col("samples") - F.col("yes"))
    return counted.select(
        *by,
        "samples",
        winner.alias("matched"),
        F.round(rate(agreeing, F.col("samples")), 6).alias("vote_fraction"),
        F.coalesce(F.when(winner, F.col("_yes")).otherwise(F.col("_no")), "_any").alias("first_sample"),
    )

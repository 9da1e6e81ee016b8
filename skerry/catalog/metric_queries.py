"""Scores, intervals, votes and cost over the role tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skerry.catalog.roles import Catalog
from skerry.operators import metrics as M

catalog = Catalog()
add = catalog.add

_RATE = "CAST({0} AS DOUBLE) / nullif({1}, 0)"


def _rate(a: str, b: str) -> str:
    return f"round(CAST({a} AS DOUBLE) / nullif({b}, 0), 6)"


_SCORES = f"""tp, fp, tn, fn, tp + fp + tn + fn AS n, {_rate('tp', '(tp + fp)')} AS precision, {_rate('tp', '(tp + fn)')} AS recall,
    {_rate('2 * tp', '(2 * tp + fp + fn)')} AS f1, {_rate('tp + tn', '(tp + fp + tn + fn)')} AS accuracy"""
_COUNTS = """count_if(matched AND predicted) AS tp, count_if(NOT matched AND predicted) AS fp,
    count_if(NOT matched AND NOT predicted) AS tn, count_if(matched AND NOT predicted) AS fn"""
_ANSWERED = """SELECT t.document_id, t.concept_id, t.matched, coalesce(v.matched, false) AS predicted FROM {truth} t
    LEFT JOIN (SELECT * FROM {verdicts} WHERE run_id = 1 AND error IS NULL AND matched IS NOT NULL) v USING (document_id, concept_id)"""


def _wilson(k: str, n: str, sign: str) -> str:
    p = f"(CAST({k} AS DOUBLE) / nullif({n}, 0))"
    half = f"1.96E0 * sqrt({p} * (1 - {p}) / ({n}) + 3.8416E0 / (4E0 * ({n}) * ({n}))) / (1 + 3.8416E0 / ({n}))"
    centre = f"(({p} + 3.8416E0 / (2E0 * ({n}))) / (1 + 3.8416E0 / ({n})))"
    inner = f"{centre} {sign} {half}"
    return f"round(CASE WHEN {n} > 0 THEN {'greatest(0E0, ' if sign == '-' else 'least(1E0, '}{inner}) END, 6)"


@add("AGG09_confusion", "truth verdicts", f"WITH a AS ({_ANSWERED}), c AS (SELECT {_COUNTS} FROM a) SELECT {_SCORES} FROM c")
def _(truth, verdicts):
    return M.confusion(M.answers(truth, verdicts.where("run_id = 1")))


@add(
    "AGG16_wilson",
    "truth verdicts",
    f"""WITH a AS ({_ANSWERED}), c AS (SELECT concept_id, {_COUNTS} FROM a GROUP BY concept_id)
    SELECT concept_id, {_SCORES}, {_wilson('tp', '(tp + fp)', '-')} AS precision_low, {_wilson('tp', '(tp + fp)', '+')} AS precision_high,
    {_wilson('tp', '(tp + fn)', '-')} AS recall_low, {_wilson('tp', '(tp + fn)', '+')} AS recall_high FROM c""",
)
def _(truth, verdicts):
    return M.with_intervals(M.confusion(M.answers(truth, verdicts.where("run_id = 1")), by=("concept_id",)))


@add(
    "AGG10_breakdown_family",
    "truth verdicts edges",
    f"""WITH a AS ({_ANSWERED}), up AS (SELECT DISTINCT e.child, f.parent AS family FROM {{edges}} e JOIN {{edges}} f ON e.parent = f.child),
    c AS (SELECT family, {_COUNTS} FROM a JOIN up ON concept_id = child GROUP BY family) SELECT family, {_SCORES} FROM c""",
)
def _(truth, verdicts, edges):
    from skerry.operators.hierarchy import closure, top_level

    family = closure(edges).join(top_level(edges).withColumnRenamed("concept_id", "ancestor"), "ancestor", "left_semi")
    pairs = M.answers(truth, verdicts.where("run_id = 1")).join(F.broadcast(family.select(F.col("concept_id"), F.col("ancestor").alias("family"))), "concept_id")
    return M.confusion(pairs, by=("family",))


@add(
    "TOP08_worst_slices",
    "truth verdicts",
    f"""WITH a AS ({_ANSWERED}), c AS (SELECT concept_id, {_COUNTS} FROM a GROUP BY concept_id), s AS (SELECT concept_id, {_SCORES} FROM c)
    SELECT concept_id, f1, row_number() OVER (ORDER BY f1 ASC NULLS LAST, concept_id) AS place FROM s ORDER BY place LIMIT 10""",
)
def _(truth, verdicts):
    """The ten worst concepts; undefined F1 last."""
    from pyspark.sql import Window

    scored = M.confusion(M.answers(truth, verdicts.where("run_id = 1")), by=("concept_id",))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("f1"), "concept_id")).cast("long")
    return scored.select("concept_id", "f1", place.alias("place")).orderBy("place").limit(10)


@add(
    "AGG21_mcnemar",
    "truth verdicts",
    """WITH v AS (SELECT * FROM {verdicts} WHERE error IS NULL AND matched IS NOT NULL), b AS (
      SELECT t.matched AS m, x.matched AS a, y.matched AS b FROM {truth} t JOIN v x ON x.run_id = 1 AND x.document_id = t.document_id AND x.concept_id = t.concept_id
      JOIN v y ON y.run_id = 2 AND y.document_id = t.document_id AND y.concept_id = t.concept_id),
    c AS (SELECT count(*) AS n_pairs, count_if(a = m AND b = m) AS both_correct, count_if(a = m AND b <> m) AS only_a_correct,
      count_if(a <> m AND b = m) AS only_b_correct, count_if(a <> m AND b <> m) AS both_wrong FROM b)
    SELECT *, only_a_correct + only_b_correct AS discordant,
      round(pow(abs(only_a_correct - only_b_correct) - 1E0, 2) / nullif(only_a_correct + only_b_correct, 0), 6) AS statistic FROM c""",
)
def _(truth, verdicts):
    """Without the p value, for which DuckDB has no function; tests hold it against Python's."""
    return M.paired(truth, verdicts.where("run_id = 1"), verdicts.where("run_id = 2")).drop("p_value")


@add("EV01_paired_p_value", "truth verdicts")
def _(truth, verdicts):
    return M.paired(truth, verdicts.where("run_id = 1"), verdicts.where("run_id = 2"))


@add(
    "AGG22_calibration",
    "truth verdicts",
    """WITH r AS (SELECT v.confidence, v.matched = t.matched AS correct FROM {verdicts} v JOIN {truth} t USING (document_id, concept_id)
      WHERE v.run_id = 1 AND v.error IS NULL AND v.matched IS NOT NULL AND v.confidence BETWEEN 0 AND 1),
    b AS (SELECT CAST(r_regionkey AS INT) AS bin FROM {region})
    SELECT bin, round(bin / 5, 3) AS low, round((bin + 1) / 5, 3) AS high, count(correct) AS n, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy
    FROM b LEFT JOIN r ON least(CAST(floor(confidence * 5) AS INT), 4) = bin GROUP BY bin""",
)
def _(truth, verdicts):
    rows = M.clean(verdicts.where("run_id = 1")).withColumnRenamed("matched", "said").join(truth, M.PAIR)
    return M.calibration(rows.withColumn("correct", F.col("said") == F.col("matched")))


_POOLED = "SELECT t.matched, p.rank, p.selected, p.document_id IS NOT NULL AS in_pool FROM {truth} t FULL JOIN {pool} p USING (document_id, concept_id)"


@add(
    "AGG23_retrieval_metrics",
    "truth pool",
    f"""WITH j AS ({_POOLED}), s AS (SELECT count_if(matched) AS n_positives, count_if(matched AND in_pool) AS n_positives_ranked,
      count_if(matched IS NOT NULL AND in_pool) AS labelled_candidates, count_if(in_pool) AS total_candidates,
      count_if(matched AND in_pool AND selected) AS kept, sum(CASE WHEN matched AND in_pool THEN 1E0 / rank END) AS rr,
      count_if(matched AND rank <= 1) AS a1, count_if(matched AND rank <= 3) AS a3, count_if(matched AND rank <= 5) AS a5, count_if(matched AND rank <= 10) AS a10 FROM j)
    SELECT {_rate('a1', 'n_positives')} AS recall_at_1, {_rate('a3', 'n_positives')} AS recall_at_3, {_rate('a5', 'n_positives')} AS recall_at_5,
      {_rate('a10', 'n_positives')} AS recall_at_10, {_rate('coalesce(rr, 0)', 'n_positives')} AS mrr, n_positives, n_positives_ranked,
      {_rate('n_positives_ranked', 'labelled_candidates')} AS precision, {_rate('labelled_candidates', 'total_candidates')} AS coverage,
      labelled_candidates, total_candidates, {_rate('kept', 'n_positives_ranked')} AS cutoff_recall FROM s""",
)
def _(truth, pool):
    return M.retrieval_metrics(truth, pool)


@add(
    "AGG24_recall_curve",
    "truth pool",
    """WITH k AS (SELECT DISTINCT rank AS k FROM {pool}), h AS (SELECT p.rank FROM {truth} t JOIN {pool} p USING (document_id, concept_id) WHERE t.matched)
    SELECT k, round((SELECT count(*) FROM h WHERE rank <= k) / CAST((SELECT count_if(matched) FROM {truth}) AS DOUBLE), 6) AS recall FROM k""",
)
def _(truth, pool):
    return M.recall_curve(truth, pool)


@add(
    "AGG25_shown_metrics",
    "truth shown",
    f"""WITH s AS (SELECT DISTINCT document_id, concept_id FROM {{shown}} WHERE run_id = 1), o AS (
      SELECT t.matched, s.document_id IS NOT NULL AS seen FROM {{truth}} t LEFT JOIN s USING (document_id, concept_id) WHERE t.document_id IN (SELECT document_id FROM s)),
    c AS (SELECT count_if(matched) AS positives, count_if(matched AND seen) AS shown_positives, count_if(seen) AS labelled_shown FROM o), n AS (SELECT count(*) AS shown_pairs FROM s)
    SELECT positives, shown_positives, {_rate('shown_positives', 'positives')} AS recall, {_rate('shown_positives', 'labelled_shown')} AS precision,
      {_rate('labelled_shown', 'shown_pairs')} AS coverage FROM c, n""",
)
def _(truth, shown):
    return M.shown_metrics(truth, shown.where("run_id = 1"))


@add(
    "AGG26_liveness",
    "verdicts",
    """SELECT run_id, count(*) AS verdicts, count(error) AS errors, count_if(error IS NULL AND matched IS NULL) AS unparsed,
      count_if(error IS NULL AND matched IS NOT NULL) AS clean, count_if(error IS NULL AND matched IS NOT NULL) = count(*) AS ok FROM {verdicts} GROUP BY run_id""",
)
def _(verdicts):
    return M.liveness(verdicts)


@add(
    "AGG27_determinism",
    "verdicts",
    """WITH v AS (SELECT * FROM {verdicts} WHERE error IS NULL AND matched IS NOT NULL), j AS (
      SELECT x.matched AS a, y.matched AS b FROM v x JOIN v y USING (document_id, concept_id) WHERE x.run_id = 1 AND y.run_id = 2)
    SELECT count(*) AS shared, count_if(a <> b) AS flips, round(CAST(count_if(a = b) AS DOUBLE) / nullif(count(*), 0), 6) AS agreement FROM j""",
)
def _(verdicts):
    return M.determinism(verdicts.where("run_id = 1"), verdicts.where("run_id = 2"))


@add(
    "AGG28_cross_document",
    "verdicts",
    """SELECT concept_id, place_id, count(*) AS n, count_if(matched) AS yes,
      round(CAST(greatest(count_if(matched), count(*) - count_if(matched)) AS DOUBLE) / count(*), 6) AS agreement
    FROM {verdicts} WHERE run_id = 1 AND error IS NULL AND matched IS NOT NULL GROUP BY concept_id, place_id HAVING count(*) >= 2""",
)
def _(verdicts):
    return M.cross_document(verdicts.where("run_id = 1"))


@add(
    "AGG29_usable_confidence",
    "verdicts",
    """WITH s AS (SELECT run_id, count(*) AS n, stddev_pop(confidence) AS sp, avg(CASE WHEN confidence > 0.15 AND confidence < 0.85 THEN 1E0 ELSE 0E0 END) AS i
      FROM {verdicts} WHERE confidence IS NOT NULL AND error IS NULL GROUP BY run_id)
    SELECT run_id, n, round(sp, 6) AS spread, round(i, 6) AS interior, n >= 20 AND sp >= 0.05 AND i >= 0.05 AS usable FROM s""",
)
def _(verdicts):
    return M.usable_confidence(verdicts)


@add(
    "AGG05_judging_cost",
    "verdicts",
    """SELECT run_id, count(*) AS pairs, count(DISTINCT document_id) AS documents, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(seconds), 3) AS seconds
    FROM {verdicts} GROUP BY run_id""",
)
def _(verdicts):
    return M.judging_cost(verdicts)


for _how, _rule in (("majority", "2 * yes > n"), ("unanimous", "yes = n"), ("any", "yes > 0")):

    @add(
        f"AGG34_vote_{_how}",
        "conversations",
        f"""WITH s AS (SELECT conv_id, turn, length(text) % 3 > 0 AS matched FROM {{conversations}}),
        c AS (SELECT conv_id, count(*) AS n, count_if(matched) AS yes FROM s GROUP BY conv_id),
        w AS (SELECT *, {_rule} AS win FROM c)
        SELECT w.conv_id, w.n AS samples, w.win AS matched, round(CAST(CASE WHEN w.win THEN w.yes ELSE w.n - w.yes END AS DOUBLE) / w.n, 6) AS vote_fraction,
          coalesce(min(s.turn) FILTER (WHERE s.matched = w.win), min(s.turn)) AS first_sample
        FROM w JOIN s USING (conv_id) GROUP BY w.conv_id, w.n, w.win, w.yes""",
    )
    def _(conversations, how=_how):
        samples = conversations.select("conv_id", "turn", (F.length("text") % 3 > 0).alias("matched"))
        return M.voted(samples, ["conv_id"], how, order="turn")


@add(
    "AGG40_newest_run_wins",
    "verdicts truth",
    """WITH v AS (SELECT *, row_number() OVER (PARTITION BY document_id, concept_id ORDER BY run_id DESC) AS r FROM {verdicts} WHERE error IS NULL AND matched IS NOT NULL),
    j AS (SELECT t.matched, v.matched AS predicted FROM v JOIN {truth} t USING (document_id, concept_id) WHERE r = 1), c AS (SELECT """
    + _COUNTS
    + " FROM j) SELECT "
    + _SCORES
    + " FROM c",
)
def _(verdicts, truth):
    """The newest run's answer for each pair (max_by keeps this a hash aggregation without a window)."""
    newest = M.clean(verdicts).groupBy(*M.PAIR).agg(F.max_by("matched", "run_id").alias("predicted"))
    return M.confusion(newest.join(truth, M.PAIR))


@add(
    "AGG30_bank_stats",
    "labels_all",
    """SELECT source, matched, source IN ('human', 'adjudicated', 'imported') AS trusted, count(*) AS n, count_if(stale) AS stale FROM {labels_all} GROUP BY source, matched""",
)
def _(labels):
    """Labels by source and polarity."""
    trusted = F.col("source").isin("human", "adjudicated", "imported")
    return labels.groupBy("source", "matched").agg(F.first(trusted).alias("trusted"), F.count("*").alias("n"), F.count_if("stale").alias("stale"))


@add("FLT12_trusted_labels", "labels_all", "SELECT document_id, concept_id, matched FROM {labels_all} WHERE source IN ('human', 'adjudicated', 'imported') AND NOT stale")
def _(labels):
    return labels.where(F.col("source").isin("human", "adjudicated", "imported") & ~F.col("stale")).select(*M.PAIR, "matched")


@add("FLT13_clean_verdicts", "verdicts", "SELECT run_id, document_id, concept_id, matched FROM {verdicts} WHERE error IS NULL AND matched IS NOT NULL")
def _(verdicts):
    return M.clean(verdicts).select("run_id", *M.PAIR, "matched")


@add(
    "JN16_answers_of_shown",
    "shown verdicts",
    """SELECT s.document_id, s.concept_id, coalesce(v.matched, false) AS predicted FROM {shown} s
    LEFT JOIN (SELECT * FROM {verdicts} WHERE run_id = 1 AND error IS NULL AND matched IS NOT NULL) v USING (document_id, concept_id) WHERE s.run_id = 1""",
)
def _(shown, verdicts):
    return M.answers(shown.where("run_id = 1").select(*M.PAIR), verdicts.where("run_id = 1"))


@add(
    "AGG35_errors_by_concept",
    "truth verdicts",
    """WITH j AS (SELECT t.concept_id, t.matched, v.matched AS said FROM {truth} t JOIN {verdicts} v USING (document_id, concept_id)
      WHERE v.run_id = 1 AND v.error IS NULL AND v.matched IS NOT NULL AND v.matched <> t.matched)
    SELECT concept_id, count_if(said) AS false_positives, count_if(NOT said) AS false_negatives, count(*) AS errors FROM j GROUP BY concept_id""",
)
def _(truth, verdicts):
    wrong = truth.join(M.clean(verdicts.where("run_id = 1")).select(*M.PAIR, F.col("matched").alias("said")), M.PAIR).where("said <> matched")
    return wrong.groupBy("concept_id").agg(
        F.count_if("said").alias("false_positives"), F.count_if(~F.col("said")).alias("false_negatives"), F.count("*").alias("errors")
    )


@add(
    "TOP07_confident_errors",
    "truth verdicts",
    """SELECT t.document_id, t.concept_id, v.confidence FROM {truth} t JOIN {verdicts} v USING (document_id, concept_id)
    WHERE v.run_id = 1 AND v.error IS NULL AND v.matched IS NOT NULL AND v.matched <> t.matched ORDER BY coalesce(v.confidence, 0) DESC, document_id, concept_id LIMIT 50""",
)
def _(truth, verdicts):
    """The fifty most confident errors."""
    wrong = truth.join(M.clean(verdicts.where("run_id = 1")).select(*M.PAIR, F.col("matched").alias("said"), "confidence"), M.PAIR).where("said <> matched")
    return wrong.orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), *M.PAIR).limit(50).select(*M.PAIR, "confidence")

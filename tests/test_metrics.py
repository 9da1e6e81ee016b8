import math
import random

import pytest
from pyspark.sql import functions as F

from skerry.functions.rates import erfc, mcnemar, wilson
from skerry.operators import metrics as M
from skerry.operators import sampling as S

PAIRS = "document_id long, concept_id int, matched boolean"


def test_wilson_by_hand_and_at_the_ends(spark):
    rows = spark.createDataFrame([(8, 10), (0, 5), (5, 5), (0, 0)], "k long, n long")
    low, high = wilson(F.col("k"), F.col("n"))
    got = [(r.low, r.high) for r in rows.select(low.alias("low"), high.alias("high")).collect()]

    def by_hand(k, n, z=1.96):
        p = k / n
        d = 1 + z * z / n
        c, h = (p + z * z / (2 * n)) / d, z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
        return max(0.0, c - h), min(1.0, c + h)

    for (low, high), (k, n) in zip(got, [(8, 10), (0, 5), (5, 5)], strict=False):
        assert (low, high) == pytest.approx(by_hand(k, n))
    assert got[3] == (None, None)


def test_erfc_and_mcnemar_agree_with_python(spark):
    xs = [0.0, 0.1, 0.5, 1.0, 2.0, 3.5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(erfc(F.col("x"))).collect()]
    assert got == pytest.approx([math.erfc(x) for x in xs], rel=1e-6)
    s, p = mcnemar(F.col("b"), F.col("c"))
    rows = spark.createDataFrame([(20, 5), (3, 3), (0, 0)], "b long, c long").select(s.alias("s"), p.alias("p")).collect()
    assert rows[0].s == pytest.approx(14**2 / 25) and rows[0].p == pytest.approx(math.erfc(math.sqrt(14**2 / 25 / 2)), rel=1e-5)
    assert rows[1].s == pytest.approx(1 / 6)
    assert rows[2].s is None and rows[2].p is None


def test_missing_and_failed_verdicts_are_no(spark):
    truth = spark.createDataFrame([(1, 1, True), (2, 1, True), (3, 1, False)], PAIRS)
    verdicts = spark.createDataFrame([(1, 1, True, None), (2, 1, True, "timeout"), (3, 1, None, None)], PAIRS + ", error string")
    row = M.confusion(M.answers(truth, verdicts)).first()
    assert (row.tp, row.fp, row.tn, row.fn) == (1, 0, 1, 1)
    assert row.precision == 1.0 and row.recall == 0.5


def test_undefined_rates_are_null(spark):
    row = M.confusion(spark.createDataFrame([], "matched boolean, predicted boolean")).first()
    assert (row.n, row.precision, row.recall, row.f1, row.accuracy) == (0, None, None, None, None)


def test_calibration_keeps_empty_bins_and_closes_the_last(spark):
    rows = spark.createDataFrame([(0.1, True), (1.0, True), (0.81, False)], "confidence double, correct boolean")
    got = {r.bin: (r.n, r.accuracy) for r in M.calibration(rows).collect()}
    assert got == {0: (1, 1.0), 1: (0, None), 2: (0, None), 3: (0, None), 4: (2, 0.5)}


def test_votes(spark):
    rows = spark.createDataFrame([(1, 0, True), (1, 1, False), (1, 2, False), (2, 0, True), (2, 1, False)], "k int, sample int, matched boolean")
    got = {how: {r.k: (r.matched, r.vote_fraction, r.first_sample) for r in M.voted(rows, ["k"], how).collect()} for how in ("majority", "unanimous", "any")}
    assert got["majority"] == {1: (False, 0.666667, 1), 2: (False, 0.5, 1)}
    assert got["unanimous"][1][0] is False and got["any"][1] == (True, 0.333333, 0)


def test_bootstrap_covers_the_score(spark):
    rng = random.Random(5)
    rows = [(d, c, rng.random() < 0.5, rng.random() < 0.5) for d in range(200) for c in range(5)]
    pairs = spark.createDataFrame(rows, "document_id long, concept_id int, matched boolean, predicted boolean")
    a, b = (S.bootstrap_scores(S.document_counts(pairs), seed=1).first() for _ in range(2))
    assert a == b
    assert a.f1_low < a.f1 < a.f1_high and a.f1_high - a.f1_low < 0.15


def test_singletons_are_pooled(spark):
    counts = spark.createDataFrame([(d, d, 1, d % 2, 0) for d in range(40)], "document_id long, w long, tp long, fp long, fn long")
    row = S.bootstrap_scores(counts, stratum="w").first()
    assert row.precision_low < row.precision_high

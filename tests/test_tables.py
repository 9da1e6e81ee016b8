"""Keyed tables and published stages: crashes, replays, races."""

import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.operators import reports
from skerry.operators import sampling as S
from skerry.plans import keyed, store
from skerry.plans.keyed import KeyedTable


def rows_of(spark, ids, value="a"):
    return spark.createDataFrame([(i, f"day{i % 3}", value) for i in ids], "id long, day string, value string")


def test_batches_read_their_buckets_only_and_add_each_key_once(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, f"file://{tmp_path}/t", ["id"], by=("day",), buckets=16)
    assert table.read() is None and table.of_keys(rows_of(spark, [1])) is None
    assert table.insert(rows_of(spark, [*range(100), *range(50)]), "one") == 100
    assert table.insert(rows_of(spark, range(100), "replayed"), "one") == 0, "a batch counts once, whatever it holds"
    assert table.insert(rows_of(spark, range(90, 110), "b"), "two") == 10
    assert table.insert(rows_of(spark, []), "three") == 0
    got = {r.id: r.value for r in table.read().collect()}
    assert got == {i: "a" if i < 100 else "b" for i in range(110)}
    seen = []
    whole = KeyedTable._read
    monkeypatch.setattr(KeyedTable, "_read", lambda self, commits, buckets=None: seen.append(buckets) or whole(self, commits, buckets))
    assert table.insert(rows_of(spark, [500]), "four") == 1 and len(seen[0]) == 1
    assert {r.id for r in table.of_keys(rows_of(spark, [3, 500, 999])).collect()} == {3, 500}
    table.compact()
    assert table.read().count() == 111 and len(table._commits()) == 1
    assert table.insert(rows_of(spark, [500, 501]), "five") == 1 and table.read().count() == 112


def test_a_crash_before_the_commit_adds_nothing(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, f"file://{tmp_path}/t", ["id"])
    table.insert(rows_of(spark, range(5)), "one")

    def dies(self, content):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(keyed.Manifest, "put", dies)
        with pytest.raises(RuntimeError):
            table.insert(rows_of(spark, range(5, 10)), "two")
    assert table.read().count() == 5, "what was written without a commit isn't there"
    assert table.insert(rows_of(spark, range(3, 10)), "two") == 5 and table.read().count() == 10
    nulls = spark.createDataFrame([(None, "d", "x"), (None, "d", "y")], "id long, day string, value string")
    assert table.insert(nulls, "three") == 1 and table.insert(nulls, "four") == 0


def test_two_runs_of_one_key_leave_one_result(spark, tmp_path):
    root, made, got, ready = f"file://{tmp_path}/runs", [], {}, threading.Barrier(2)

    def candidates(config):
        ready.wait(timeout=60)  # both have seen that nothing is there
        made.append(1)
        return spark.createDataFrame([(len(made), 1, True), (9, 9, False)], "document_id long, concept_id int, selected boolean")

    def run(name):
        record = store.execute(spark, root, {}, candidates, lambda config, offers: offers.withColumn("matched", F.lit(True)))
        got[name] = record, sorted(r.document_id for r in record["verdicts"].collect())

    threads = [threading.Thread(target=run, args=(i,)) for i in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(made) == 2 and got[0][1] == got[1][1] and got[0][1] in ([1], [2])
    assert sorted(got[i][0]["reused"]["candidates"] for i in range(2)) == [False, True]
    assert len(list((tmp_path / "runs" / "candidates").glob("*-*"))) == 1, "the loser's table is dropped"


def test_an_empty_manifest_is_taken_over(spark, tmp_path, monkeypatch):
    manifest = store.Manifest(spark, f"file://{tmp_path}/m.json")
    (tmp_path / "m.json").write_text("")
    assert manifest.read() is None
    monkeypatch.setattr(store.Manifest, "STALE", 0.3)
    time.sleep(0.4)
    assert manifest.put({"data": "x"}) and manifest.read() == {"data": "x"} and not manifest.put({"data": "y"})


def test_failures_name_their_stage(spark, tmp_path):
    root = f"file://{tmp_path}/runs"
    with pytest.raises(ZeroDivisionError):
        store.execute(spark, root, {}, lambda c: spark.range(1).selectExpr("id AS document_id"), lambda c, p: p, retrieval=lambda c, p: 1 / 0)
    row = spark.read.parquet(f"{root}/runs").first()
    assert (row.stage, row.error) == ("retrieval", "ZeroDivisionError: division by zero")


@pytest.mark.parametrize("size", [4096, 7])
def test_parts_of_a_bootstrap_have_the_law_of_the_whole(spark, monkeypatch, size):
    monkeypatch.setattr(S, "CELLS", size)
    rng = np.random.default_rng(5)
    values = rng.integers(0, 12, (60, 2))
    n = rng.integers(1, 30, 60)
    cells = spark.createDataFrame([(int(a), int(b), int(k)) for (a, b), k in zip(values, n, strict=True)], "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    drawn = S.resampled(cells, ["a", "b"], 3000, seed=2)
    again = S.resampled(cells.repartition(5), ["a", "b"], 3000, seed=2)
    got = np.array([[r.a, r.b] for r in drawn.orderBy("r").collect()])
    assert (got == np.array([[r.a, r.b] for r in again.orderBy("r").collect()])).all()
    units = np.repeat(values, n, axis=0)
    mean, covariance = len(units) * units.mean(axis=0), len(units) * np.cov(units.T, bias=True)
    assert np.abs(got.mean(axis=0) - mean).max() < 5 * np.sqrt(covariance.max() / 3000)
    assert np.abs(np.cov(got.T) / covariance - 1).max() < 0.35 and np.abs(np.diag(np.cov(got.T)) / np.diag(covariance) - 1).max() < 0.12


def test_strata_are_drawn_apart(spark, monkeypatch):
    monkeypatch.setattr(S, "CELLS", 3)
    cells = spark.createDataFrame([("x", i, 2) for i in range(10)] + [("y", 1000, 4)], "s string, a long, n long")
    got = {r.a for r in S.resampled(cells, ["a"], 200, stratum="s").collect()}
    assert all(4000 <= a <= 4000 + 20 * 9 for a in got) and len(got) > 20


def test_paired_bootstrap_of_equal_runs_has_no_difference(spark):
    truth = spark.createDataFrame([(d, c, (d + c) % 3 == 0) for d in range(40) for c in range(5)], "document_id long, concept_id int, matched boolean")
    said = truth.select("document_id", "concept_id", F.lit(0.5).alias("confidence"), (F.col("document_id") % 2 == 0).alias("matched"), F.lit(None).cast("string").alias("error"))
    row = reports.paired_bootstrap(truth, said, said).first()
    assert (row.documents, row.difference, row.low, row.high, row.improvement) == (40, 0.0, 0.0, 0.0, False)

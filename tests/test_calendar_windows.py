"""Calendar queries on entries that repeat, overlap or miss parts, against their SQL, and what their plans shuffle."""

import shutil
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from skerry import catalog
from skerry.catalog import roles
from skerry.operators import bank
from skerry.plans import blocks
from tests.compare import duck_rows, spark_rows

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def odd(sf_dir, tmp_path_factory):
    """The small tables with keys of customers that are missing, negative or there several times, at other places too."""
    folder = tmp_path_factory.mktemp("odd")
    for file in Path(sf_dir).glob("*.parquet"):
        shutil.copy(file, folder / file.name)
    table = pq.read_table(folder / "customer.parquet")
    rows = table.to_pylist()
    more = [r | {"c_nationkey": (r["c_nationkey"] + 1) % 25} for r in rows[:20]] + rows[10:30]
    more += [r | {"c_custkey": -r["c_custkey"]} for r in rows[30:40]] + [rows[40] | {"c_custkey": None}, rows[41] | {"c_nationkey": None}, rows[42] | {"c_custkey": 100_000, "c_nationkey": None}]
    (folder / "customer.parquet").unlink()
    pq.write_table(pa.Table.from_pylist(rows + more, table.schema), folder / "customer.parquet")
    return str(folder)


@pytest.fixture
def crowded(spark):
    """Ten thousand entries over six windows, and forty documents at their places: 400,000 pairs at most."""
    # coalesced, as a range is partitioned by its ids and needs no shuffle
    calendar = spark.range(10_000).coalesce(4).selectExpr("id AS entry_id", "CAST(id % 2 AS INT) AS place_id", "DATE '2024-01-10' + CAST(id % 3 AS INT) AS starts_on", "CAST(id % 5 AS INT) AS concept_id", "'event' AS kind")
    coded = spark.range(400).selectExpr("id AS feed_event_id", "id % 40 AS document_id", "CAST(id % 2 AS INT) AS place_id", "TIMESTAMP '2024-01-10 12:00:00' + make_interval(0, 0, 0, CAST(id DIV 40 AS INT)) AS occurred_at", "lpad(CAST(id % 20 AS STRING), 2, '0') AS root_code")
    return calendar, coded


def run_on(monkeypatch, spark, name, **frames):
    """A registered query over the given frames."""
    monkeypatch.setattr(roles, "frame", lambda spark, folder, role: frames[role])
    return QUERIES[name](spark, "")


def most_rows(df):
    """(most rows that any shuffle of the executed plan wrote, rows of the result)."""
    spark = df.sparkSession
    n = len(df.collect())
    execution = df._jdf.queryExecution().executedPlan()
    found = []

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        if kind == "ShuffleExchangeExec":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(execution)
    assert spark is not None
    return max(found, default=0), n


def agrees(spark, name, folder):
    assert spark_rows(QUERIES[name](spark, folder)) == duck_rows(folder, SQL[name])


def test_preview_counts_documents_once_a_window(spark, odd, crowded, monkeypatch):
    agrees(spark, "OT13_calendar_preview", odd)
    calendar, coded = crowded
    shuffled, rows = most_rows(run_on(monkeypatch, spark, "OT13_calendar_preview", calendar=calendar, coded=coded))
    assert rows == 10_000 and shuffled <= 10_000


def test_export_ranks_the_matches_of_a_day_once(spark, odd, crowded, monkeypatch):
    agrees(spark, "SRC20_reviews_to_export", odd)
    calendar, coded = crowded
    more = coded.crossJoin(spark.range(20).selectExpr("id * 1000 AS shift")).selectExpr("feed_event_id", "document_id + shift AS document_id", "place_id", "occurred_at")
    shuffled, rows = most_rows(run_on(monkeypatch, spark, "SRC20_reviews_to_export", calendar=calendar, coded=more))
    assert rows == 5 * 6_666 and shuffled <= 5 * 10_000


def test_export_goes_on_behind_reviewed_matches(spark):
    matches = spark.createDataFrame([("k", f"u{i:02d}", i) for i in range(20)] + [("l", "u03", 3), ("l", "v", 0)], "key string, url string, first_seen int")
    members = spark.createDataFrame([(1, "k"), (2, "k"), (2, "l"), (3, "k"), (4, "m")], "entry_id int, key string")
    reviews = spark.createDataFrame([(1, "u00", False), (1, "u02", False), (1, "gone", False), (2, "u03", False), (2, "u04", None), (3, "u19", True)], "entry_id int, url string, confirmed boolean")
    got = bank.first_reviews_to_export(members, matches, reviews, 3)
    plain = bank.reviews_to_export(members.join(matches, "key").drop("key").distinct(), reviews, 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) != []
    assert [(r.entry_id, r.url) for r in got.orderBy("entry_id", "first_seen", "url").collect()] == [(1, "u01"), (1, "u03"), (1, "u04"), (2, "u00"), (2, "v"), (2, "u01")]


def short_tables(spark, crowded):
    """``crowded`` with codes, a few articles and links."""
    calendar, coded = crowded
    coded = coded.selectExpr("*", "concat(root_code, '1') AS base_code", "concat(root_code, '1', CAST(feed_event_id % 3 AS STRING)) AS event_code")
    articles = spark.range(30).selectExpr(
        "id AS document_id", "IF(id % 7 = 0, NULL, 'text') AS body", "IF(id % 5 = 0, 'de', 'en') AS lang", "'s' AS source", "DATE '2024-01-09' + CAST(id % 4 AS INT) AS published_on", "array(concat('T', CAST(id % 3 AS STRING)), 'X') AS themes",
        "array(CAST(id % 2 AS INT), 0) AS place_ids", "CASE WHEN id % 9 = 1 THEN id - 1 END AS duplicate_of", "id % 11 = 3 AS is_junk",
    )
    links = spark.createDataFrame([(0, "cameo", "0011", None), (1, "theme", "T1", 1), (2, "cameo", "0711", 1), (1, "cameo", "0310", None)], "concept_id int, system string, code string, linked_run int")
    return {"calendar": calendar, "coded": coded, "articles": articles, "links": links}


def test_outcomes_count_entries_by_window(spark, odd, crowded, monkeypatch):
    agrees(spark, "AGG12_code_outcomes", odd)
    shuffled, rows = most_rows(run_on(monkeypatch, spark, "AGG12_code_outcomes", **short_tables(spark, crowded)))
    assert rows > 0 and shuffled <= 10_000


@pytest.mark.parametrize("name", ["AGG14_missed_by_own_class", "AGG14_reach_by_kind", "AGG14_own_codes"])
def test_reach_is_found_by_window(spark, odd, crowded, monkeypatch, name):
    agrees(spark, name, odd)
    shuffled, rows = most_rows(run_on(monkeypatch, spark, name, **short_tables(spark, crowded)))
    assert rows > 0 and shuffled <= 10_000


@pytest.fixture(scope="module")
def repeated(odd, tmp_path_factory):
    """``odd`` with a region twice, so that run 1 has two verdicts for each pair."""
    folder = tmp_path_factory.mktemp("repeated")
    for file in Path(odd).glob("*.parquet"):
        shutil.copy(file, folder / file.name)
    regions = pq.read_table(folder / "region.parquet")
    (folder / "region.parquet").unlink()
    pq.write_table(pa.concat_tables([regions, regions.slice(0, 1)]), folder / "region.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["AGG31_calendar_summary", "EV05_calendar_summary", "EV05_calendar_entries", "AGG32_stage_counts", "JN23_lead_times"])
def test_stages_are_counted_by_window(spark, odd, repeated, crowded, monkeypatch, name):
    for folder in (odd, repeated):
        agrees(spark, name, folder)
    pairs = spark.range(30).crossJoin(spark.range(5).withColumnRenamed("id", "c"))
    shown = pairs.where("id % 2 = 0").selectExpr("1 AS run_id", "id AS document_id", "CAST(c AS INT) AS concept_id")
    verdicts = pairs.selectExpr("1 AS run_id", "id AS document_id", "CAST(c AS INT) AS concept_id", "id % 3 = 0 AS matched", "CAST(NULL AS STRING) AS error", "0.5D AS confidence", "1L AS tokens", "0.5D AS seconds", "0L AS place_id")
    tables = short_tables(spark, crowded)
    tables["calendar"] = tables["calendar"].selectExpr("*", "IF(entry_id % 4 = 1, entry_id + 1, NULL) AS precursor_of").withColumn("kind", F.expr("IF(entry_id % 4 = 1, 'precursor', kind)"))
    shuffled, rows = most_rows(run_on(monkeypatch, spark, name, **tables, shown=shown, verdicts=verdicts))
    assert rows > 0 and shuffled <= 10_000


@pytest.mark.parametrize("name", ["JN05_window_documents", "WIN13_first_of_representative"])
def test_entries_meet_documents_last(spark, odd, crowded, monkeypatch, name):
    agrees(spark, name, odd)
    tables = short_tables(spark, crowded)
    shuffled, rows = most_rows(run_on(monkeypatch, spark, name, calendar=tables["calendar"], coded=tables["coded"], articles=tables["articles"]))
    assert rows > 100_000 and shuffled <= 10_000


def test_events_meet_entries_in_blocks(spark, odd, monkeypatch):
    agrees(spark, "JN04_events_in_window", odd)  # some windows end before they start
    monkeypatch.setattr(blocks, "BLOCK", 7)
    agrees(spark, "JN04_events_in_window", odd)
    agrees(spark, "JN05_window_documents", odd)


@pytest.mark.parametrize("name", ["SET08_all_window_documents", "WIN12_owned_documents"])
def test_documents_meet_places_and_days(spark, odd, crowded, monkeypatch, name):
    agrees(spark, name, odd)
    tables = short_tables(spark, crowded)
    assert most_met(run_on(monkeypatch, spark, name, calendar=tables["calendar"], coded=tables["coded"], articles=tables["articles"])) <= 10_000


def test_events_of_a_day_are_counted_once(spark, odd, crowded, monkeypatch):
    agrees(spark, "FLT15_whole_day_window", odd)
    calendar, coded = crowded
    wide = coded.crossJoin(spark.range(100)).drop("id")
    shuffled, rows = most_rows(run_on(monkeypatch, spark, "FLT15_whole_day_window", calendar=calendar, coded=wide))
    assert rows > 0 and shuffled <= 10_000


def most_met(df):
    """The most rows that any join of the executed plan gave."""
    df.collect()
    found = []

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        if kind.endswith("JoinExec"):
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return max(found)


def test_observations_meet_documents_that_fit_in_blocks(spark, odd, monkeypatch):
    agrees(spark, "JN21_supporting_documents", odd)
    monkeypatch.setattr(blocks, "BLOCK", 3)
    agrees(spark, "JN21_supporting_documents", odd)
    monkeypatch.undo()
    seen = spark.range(2_000).selectExpr("id AS entry_id", "1 AS concept_id", "IF(id % 4 = 0, NULL, CAST(id % 10 AS INT)) AS place_id", "IF(id % 3 = 0, NULL, DATE '2024-01-01' + CAST(id % 7 AS INT)) AS occurred_on")
    dated = spark.range(100).selectExpr("id AS document_id", "IF(id % 9 = 0, NULL, id % 10) AS place_id", "IF(id % 8 = 0, NULL, DATE '2024-01-01' + CAST(id % 7 AS INT)) AS occurred_on")
    truth = spark.range(100).selectExpr("id AS document_id", "1 AS concept_id", "id % 2 = 0 AS matched")
    got = bank.supporting_documents(seen, truth, dated)
    assert got.columns == [*seen.columns, "document_id"]
    documents = dated.collect()
    want = sorted(
        (o.entry_id, d.document_id) for o in seen.collect() for d in documents
        if d.document_id % 2 == 0 and (o.place_id is None or o.place_id == d.place_id) and (o.occurred_on is None or o.occurred_on == d.occurred_on)
    )
    assert sorted((r.entry_id, r.document_id) for r in got.collect()) == want != []
    assert most_met(got) <= len(want) / 10

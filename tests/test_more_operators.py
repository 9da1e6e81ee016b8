import pytest
from pyspark.sql import functions as F

from skerry.functions import lint
from skerry.operators import bank, judging, ontology, reports, strategies
from skerry.plans import store
from skerry.sources import fetching, turtle


class Site:
    def __init__(self, pages):
        self.pages = pages

    def get(self, url):
        status, body = self.pages.get(url, (404, b""))
        if status is None:
            raise ConnectionError("down")
        return status, body


def test_fetching(spark):
    site = Site({"http://a/1": (200, b"x"), "http://a/2": (503, b""), "http://b/1": (None, b""), "http://b/2": (200, b"y" * 99)})
    urls = spark.createDataFrame([(u,) for u in ("http://a/1", "http://a/2", "http://a/3", "http://b/1", "http://b/2")], "url string")
    got = {r.url: (r.status, r.body and bytes(r.body), r.error) for r in fetching.fetched(urls, site, pause=0.0, limit=50).collect()}
    assert got["http://a/1"] == (200, b"x", None) and got["http://a/2"] == (503, None, "status 503") and got["http://a/3"][0] == 404
    assert got["http://b/1"] == (None, None, "ConnectionError: down") and got["http://b/2"][2] == "too large"
    assert fetching.latest_stamp("1 http://x/20240101001500.zip\n2 http://x/20240101000000.zip") == "20240101001500"
    state = spark.createDataFrame([("u", 2), ("v", 2)], "url string, failures int")
    now = {r.url: (r.failures, r.final) for r in fetching.retry_state(state, spark.createDataFrame([("u", "x"), ("v", None), ("w", "x")], "url string, error string")).collect()}
    assert now == {"u": (3, True), "v": (0, False), "w": (1, False)}


def test_turtle_round_trip():
    concepts = [{"name": 'Say "hi" . \n now', "definition": "d;\\", "inclusion": None, "exclusion": "e"}, {"name": "B", "definition": None, "inclusion": None, "exclusion": None}, {"name": "b", "definition": "x c:B", "inclusion": "i", "exclusion": None}]
    relations = [("b", "B"), ("b", 'Say "hi" . \n now'), ("B", 'Say "hi" . \n now')]
    got, links = turtle.read(turtle.write(concepts, relations))
    assert got == concepts and sorted(links) == sorted(relations)


def test_ontology_tables(spark):
    concepts = spark.createDataFrame([(1, "a", "d"), (2, "b", "e")], "concept_id int, name string, definition string")
    edges = spark.createDataFrame([(1, 2, "subclass")], "child int, parent int, predicate string")
    pairs = lambda *rows: spark.createDataFrame(list(rows), "child int, parent int")
    assert [tuple(r) for r in ontology.replaced_relations(concepts, edges, pairs((2, 1)), "subclass").collect()] == [(2, 1, "subclass")]
    for bad in ((1, 1),), ((1, 9),), ((1, 2), (2, 1)):
        with pytest.raises(ValueError):
            ontology.replaced_relations(concepts, edges, pairs(*bad), "subclass")
    snapshots = ontology.mint(spark.createDataFrame([], "version int, content_hash string"), concepts)
    assert ontology.mint(snapshots, concepts).count() == 1 and ontology.live_version(snapshots, concepts).first()[0] == 1
    other = concepts.withColumn("definition", F.lit("new"))
    assert ontology.mint(snapshots, other).agg(F.max("version")).first()[0] == 2 and ontology.live_version(snapshots, other).first()[0] is None
    with pytest.raises(ValueError):
        ontology.upserted_concepts(concepts, other, reword=False)
    assert ontology.resolve("latest", [1, 3]) == 3 and ontology.resolve("v1", [1, 3]) == 1
    with pytest.raises(ValueError):
        ontology.resolve("v2", [1, 3])
    codes = ontology.upserted_codes(spark.createDataFrame([("s", "14", "x")], "system string, code string, name string"), spark.createDataFrame([("s", "145", "y"), ("s", "14", "z")], "system string, code string, name string"))
    assert {(r.code, r.parent, r.name) for r in codes.collect()} == {("14", None, "z"), ("145", "14", "y")}


def test_bank(spark):
    kind = "document_id long, concept_id int, matched boolean, source string, version string"
    labels = spark.createDataFrame([(1, 1, True, "machine", "v1"), (2, 1, True, "human", "v1")], kind)
    ruled = bank.adjudicate(labels, spark.createDataFrame([(1, 1, False)], "document_id long, concept_id int, matched boolean"), "v2")
    assert {tuple(r) for r in ruled.collect()} == {(1, 1, False, "adjudicated", "v2"), (2, 1, True, "human", "v1")}
    reworded = spark.createDataFrame([("v1", 1)], "version string, concept_id int")
    assert [r.document_id for r in bank.trusted(ruled, reworded).collect()] == [1] and [r.document_id for r in bank.stale(ruled, reworded).collect()] == [2]
    seen = spark.createDataFrame([(1, None, "d")], "concept_id int, place_id int, occurred_on string")
    assert bank.observe(seen, seen.union(seen)).count() == 1
    with pytest.raises(ValueError):
        bank.import_annotations(spark.createDataFrame([], "set string, document_id long, concept_id int, matched boolean"), labels, "m", labels.where("document_id = 1").select("document_id"), labels.select("concept_id").distinct())
    links = spark.createDataFrame([(1, "s", "1", 4), (2, "s", "1", 4)], "concept_id int, system string, code string, linked_run int")
    assert {(r.concept_id, r.linked_run) for r in bank.tick_link(links, 1, "s", "1", True).collect()} == {(1, None), (2, 4)}
    assert bank.tick_link(links, 1, "s", "1", False).count() == 1


def test_routing_asks_children_of_yes_only(spark):
    class Yes:
        name = "yes"

        def answer(self, prompts):
            return ['{"results": [{"concept_id": 10, "matched": true}]}' for _ in prompts]

    articles = spark.createDataFrame([(1, "text")], "document_id long, body string")
    concepts = spark.createDataFrame([(1, "leaf1"), (2, "leaf2"), (3, "leaf3"), (10, "top"), (11, "other")], "concept_id int, name string")
    edges = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "child int, parent int")
    shown, answers = strategies.routed(articles, concepts, edges, Yes())
    assert sorted(tuple(r) for r in shown.collect()) == [(1, 1), (1, 2)]
    assert {(r.concept_id, r.matched) for r in answers.collect()} == {(10, True), (11, False)}


def test_lint_and_prefixes(spark):
    rows = spark.createDataFrame([(1, "Violent protest", "People use violence. " * 5, None, "x"), (2, "Mass protest", "People protest. " * 6, None, ""), (3, "Plain", None, None, "x")], "concept_id int, name string, definition string, inclusion string, exclusion string")
    got = {(r.concept_id, r.check) for r in lint.findings(rows).collect()}
    assert got == {(2, "strength_drift"), (2, "no_exclusions"), (3, "missing_definition")}
    assert lint.prefixes("hub/nomic-embed-text:latest")[0] == "search_document: " and lint.prefixes("x") == ("", "")
    with pytest.raises(ValueError):
        lint.concept_text("title")


def test_runs_are_reused_by_key(spark, tmp_path):
    made = []

    def candidates(config):
        made.append("candidates")
        return spark.createDataFrame([(1, 1)], "document_id long, concept_id int")

    def judge(config, pool):
        made.append("judge")
        return pool.withColumn("matched", F.lit(True))

    root = f"file://{tmp_path}/runs"
    store.execute(spark, root, {}, candidates, judge)
    again = store.execute(spark, root, {"judge": {"host": "b"}}, candidates, judge)
    assert made == ["candidates", "judge"] and again["reused"] == {"candidates": True, "retrieval": True, "judge": True}
    store.execute(spark, root, {"judge": {"samples": 3}}, candidates, judge)
    assert made == ["candidates", "judge", "judge"]
    with pytest.raises(ZeroDivisionError):
        store.execute(spark, root, {"judge": {"samples": 5}}, candidates, lambda c, p: 1 / 0)
    assert spark.read.parquet(f"{root}/runs").where("error IS NOT NULL").count() == 1


def test_reports(spark):
    rows = spark.createDataFrame([(1, None, "a|b")], "n long, f double, t string")
    assert reports.markdown(rows, ["n", "f", "t"]) == "| n | f | t |\n|-|-|-|\n| 1 | - | a\\|b |\n"
    scored = spark.createDataFrame([(10, 0.6, 0.4)], "n long, precision double, recall double")
    gates = {r.figure: r.gate for r in reports.regression(scored, {"precision": 0.61, "recall": 0.5}).collect()}
    assert gates == {"precision": "pass", "recall": "fail"}
    assert reports.interval(0.1, 0.25) == "[0.100, 0.250]" and reports.number(None) == "-"


def test_paired_bootstrap_sees_an_improvement(spark):
    truth = spark.createDataFrame([(d, c, c == 0) for d in range(60) for c in range(4)], "document_id long, concept_id int, matched boolean")
    said = lambda wrong: truth.select("document_id", "concept_id", F.when(F.col("document_id") % wrong == 0, ~F.col("matched")).otherwise(F.col("matched")).alias("matched"), F.lit(None).cast("string").alias("error"))
    row = reports.paired_bootstrap(truth, said(2), said(6)).first()
    assert row.improvement and 0 < row.low <= row.difference <= row.high
    assert not reports.paired_bootstrap(truth, said(3), said(3)).first().improvement


def test_batched_cost_adds_up(spark):
    calls = spark.createDataFrame([(1, 10), (2, 7)], "document_id long, tokens long")
    pairs = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 5)], "document_id long, concept_id int")
    assert {tuple(r) for r in judging.batched_cost(calls, pairs).collect()} == {(1, 1, 4), (1, 2, 3), (1, 3, 3), (2, 5, 7)}


def test_versions_and_pins():
    from skerry.plans import runs

    assert runs.retrieval_version({}, [(1, "a"), (2, "b")]) == runs.retrieval_version({"judge": {"samples": 3}}, [(2, "b"), (1, "a")]) != runs.retrieval_version({}, [(1, "a")])
    prompts = {"pair": "ask"}
    runs.check_prompts({"pair": runs.stable_hash("ask")}, prompts)
    with pytest.raises(runs.DriftError):
        runs.check_prompts({"pair": runs.stable_hash("other")}, prompts)
    assert runs.source_fingerprint(runs.sweep) != runs.source_fingerprint(runs.stage_keys)
    assert runs.own_cutoff({})["max_k"] == 15 and runs.judging_copy({"judge": {"model": "a"}}, model="b")["judge"]["model"] == "b"


def test_leaderboard_leaves_partial_runs_unscored(spark):
    truth = spark.createDataFrame([(1, 1, True), (2, 1, False)], "document_id long, concept_id int, matched boolean")
    verdicts = spark.createDataFrame([(1, 1, 1, True, None), (1, 2, 1, True, None), (2, 1, 1, True, None)], "run_id int, document_id long, concept_id int, matched boolean, error string")
    assert [(r.run_id, r.covered, r.f1) for r in reports.live_leaderboard(truth, verdicts).collect()] == [(1, 2, 0.666667), (2, 1, None)]


def test_observations_places_and_manifests(spark, tmp_path):
    from skerry.sources import sheets

    rows = spark.createDataFrame([("A", "deu", "2024-01-02"), ("A", "", "2024-01-02"), ("A", "XXX", ""), ("Q", "DEU", "")], "concept string, locus_iso3 string, occurred_on string")
    concepts, places = spark.createDataFrame([(1, "A")], "concept_id int, concept string"), spark.createDataFrame([(7, "DEU")], "place_id int, iso3 string")
    good, bad = sheets.import_observations(rows, concepts, places)
    assert {(r.concept_id, r.place_id) for r in good.collect()} == {(1, 7), (1, None)} and bad.count() == 2
    seed = spark.createDataFrame([("DE", "DEU", "Germany"), ("AT", "AUT", "Austria")], "iso2 string, iso3 string, name string")
    added = sheets.seeded_places(places, seed, {"AT": "AU"}).collect()
    assert [(r.iso3, r.fips) for r in added] == [("AUT", "AU")]
    sheets.write_manifest(spark.createDataFrame([(0, 5)], "position int, document_id long"), f"file://{tmp_path}/m", seed="0")
    assert sheets.read_manifest(spark, f"file://{tmp_path}/m", "position int, document_id long, seed string").first() == (0, 5, "0")

"""The bank, strategies, reports and lint over the role tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skerry.catalog.matching_queries import _vectors
from skerry.catalog.roles import Catalog
from skerry.functions import lint
from skerry.operators import bank, matching, reports, strategies
from skerry.operators import calendars as C
from skerry.operators import metrics as M
from skerry.operators import sampling as S
from skerry.operators.judging import HashChat, HashEmbedder

catalog = Catalog()
add = catalog.add

PAIR = M.PAIR


@add("BK01_upserted_labels", "labels_all verdicts", """SELECT coalesce(v.document_id, l.document_id) AS document_id, coalesce(v.concept_id, l.concept_id) AS concept_id, CASE WHEN v.document_id IS NULL THEN l.matched ELSE v.matched END AS matched,
      CASE WHEN v.document_id IS NULL THEN l.source ELSE 'human' END AS source, CASE WHEN v.document_id IS NULL THEN 'v1' ELSE 'v2' END AS version
    FROM {labels_all} l FULL JOIN (SELECT * FROM {verdicts} WHERE run_id = 2 AND confidence > 0.9 AND error IS NULL AND matched IS NOT NULL) v ON v.document_id = l.document_id AND v.concept_id = l.concept_id""")
def _(labels, verdicts):
    """Confident answers of a run written over the bank, as if confirmed by hand."""
    old = labels.select(*PAIR, "matched", "source", F.lit("v1").alias("version"))
    rows = M.clean(verdicts.where("run_id = 2 AND confidence > 0.9")).select(*PAIR, "matched", F.lit("human").alias("source"))
    return bank.label(old, rows, "v2")


@add("BK07_stale_labels", "labels_all", "SELECT document_id, concept_id FROM {labels_all} WHERE stale AND concept_id < 20")
def _(labels):
    """Two versions of the ontology; half of the classes were reworded since the first."""
    stamped = labels.withColumn("version", F.when(F.col("stale"), "v1").otherwise("v2"))
    reworded = labels.where("concept_id < 20").select("concept_id").distinct().withColumn("version", F.lit("v1"))
    return bank.stale(stamped, reworded).select(*PAIR)


@add("JN08_annotation_sets", "labels_all", "SELECT s AS set, count(l.document_id) AS labels, count(DISTINCT l.document_id) AS documents, count_if(l.matched) AS positives FROM (SELECT unnest(['human', 'machine', 'imported', 'adjudicated', 'empty']) AS s) n LEFT JOIN {labels_all} l ON l.source = s GROUP BY s")
def _(labels):
    names = labels.sparkSession.createDataFrame([(s,) for s in ("human", "machine", "imported", "adjudicated", "empty")], "set string")
    return bank.annotation_sets(names, labels.withColumnRenamed("source", "set"))


@add(
    "JN22_observation_recall",
    "calendar pool verdicts",
    """WITH o AS (SELECT DISTINCT concept_id, CAST(place_id AS BIGINT) AS place_id FROM {calendar}), h AS (SELECT DISTINCT concept_id, place_id FROM {verdicts} WHERE run_id = 1 AND error IS NULL AND matched)
    SELECT count(*) AS observations, count(h.concept_id) AS detected FROM o LEFT JOIN h USING (concept_id, place_id) WHERE o.concept_id IN (SELECT concept_id FROM {pool})""",
)
def _(calendar, pool, verdicts):
    seen = calendar.select("concept_id", F.col("place_id").cast("long").alias("place_id")).distinct()
    return bank.observation_recall(seen, pool, verdicts.where("run_id = 1"))


@add("JN26_error_rows", "truth verdicts labels_all", "SELECT t.document_id, t.concept_id, t.matched AS expected, v.matched, v.confidence, l.source FROM {truth} t JOIN {verdicts} v USING (document_id, concept_id) LEFT JOIN {labels_all} l USING (document_id, concept_id) WHERE v.run_id = 1 AND v.error IS NULL AND v.matched IS NOT NULL AND v.matched <> t.matched")
def _(truth, verdicts, labels):
    rows = bank.error_rows(truth, verdicts.where("run_id = 1"), labels.select(*PAIR, "source"))
    return rows.select(*PAIR, "expected", "matched", "confidence", "source")


@add("SRC20_reviews_to_export", "calendar coded", """WITH m AS (SELECT DISTINCT c.entry_id, 'u' || e.document_id AS url, CAST(e.occurred_at AS DATE) AS first_seen FROM {calendar} c JOIN {coded} e ON e.place_id = c.place_id AND CAST(e.occurred_at AS DATE) = c.starts_on),
    r AS (SELECT entry_id, url, row_number() OVER (PARTITION BY entry_id ORDER BY first_seen, url) AS n FROM m WHERE entry_id % 3 <> 0) SELECT entry_id, url FROM r WHERE n <= 5""")
def _(calendar, coded):
    """A third of the entries has a confirmed review already."""
    days = coded.select("place_id", F.to_date("occurred_at").alias("starts_on"), F.concat(F.lit("u"), F.col("document_id").cast("string")).alias("url")).distinct()
    matches = days.withColumn("first_seen", F.col("starts_on"))
    reviews = calendar.where("entry_id % 3 = 0").select("entry_id", F.lit("other").alias("url"), F.lit(True).alias("confirmed"))
    members = calendar.where("entry_id IS NOT NULL").select("entry_id", "place_id", "starts_on").distinct()
    return bank.first_reviews_to_export(members, matches, reviews).select("entry_id", "url")


@add(
    "FN28_lint",
    "part",
    """WITH c AS (SELECT p_partkey AS concept_id, p_type, p_size FROM {part}),
    f AS (SELECT concept_id, 'missing_definition' AS "check", 'warning' AS severity FROM c WHERE p_size % 5 = 0
      UNION ALL SELECT concept_id, 'thin_definition', 'info' FROM c WHERE p_size % 5 <> 0
      UNION ALL SELECT concept_id, 'no_exclusions', 'info' FROM c WHERE p_size % 2 = 0
      UNION ALL SELECT concept_id, 'strength_drift', 'warning' FROM c WHERE p_size % 5 IN (1, 2)) SELECT * FROM f""",
)
def _(part):
    """Names that promise much, with definitions that are missing, that keep the promise, or that don't."""
    definition = F.when(F.col("p_size") % 5 == 0, "").when(F.col("p_size") % 5 <= 2, "people gather in a place").otherwise("at least ten people")
    concepts = part.select(
        F.col("p_partkey").alias("concept_id"), F.concat(F.lit("Major "), F.lower("p_name")).alias("name"), definition.alias("definition"), F.lit(None).cast("string").alias("inclusion"),
        F.when(F.col("p_size") % 2 == 0, " ").otherwise("rehearsals").alias("exclusion"),
    )
    return lint.findings(concepts)


@add("FN11_concept_text", "part", "SELECT p_partkey AS concept_id, trim(p_name || chr(10) || p_type) AS text FROM {part}")
def _(part):
    concepts = part.select(F.col("p_partkey").alias("concept_id"), F.concat(F.lit(" "), "p_name").alias("name"), F.col("p_type").alias("definition"), F.lit(None).cast("string").alias("inclusion"))
    return concepts.select("concept_id", lint.concept_text("name+definition+inclusion").alias("text"))


@add("FN29_robots", "orders", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE o_orderkey % 3 <> 0 END AS allowed FROM {orders}")
def _(orders):
    status = F.when(F.col("o_orderkey") % 4 == 1, 503).when(F.col("o_orderkey") % 4 == 2, 404).when(F.col("o_orderkey") % 4 == 3, 200)
    return orders.select("o_orderkey", lint.robots_allowed(status, F.col("o_orderkey") % 3 == 0).alias("allowed"))


@add("AGG43_run_evaluation", "truth verdicts pool shown")
def _(truth, verdicts, pool, shown):
    """All figures of one run; each is held against SQL in its own query."""
    return reports.evaluate_run(truth, verdicts.where("run_id = 1"), pool, shown.where("run_id = 1"))


@add("AGG19_paired_bootstrap", "truth verdicts")
def _(truth, verdicts):
    return reports.paired_bootstrap(truth, verdicts.where("run_id = 1"), verdicts.where("run_id = 2"))


@add("AGG39_sample_status", "truth verdicts")
def _(truth, verdicts):
    return reports.sample_status(S.bootstrap_scores(S.document_counts(M.answers(truth, verdicts.where("run_id = 1")))))


@add("EV02_compared_arms", "truth verdicts")
def _(truth, verdicts):
    return reports.compare_arms(truth, verdicts, 1, [1, 2])


@add(
    "AGG12_code_outcomes",
    "calendar coded articles links",
    """WITH w AS (SELECT DISTINCT c.entry_id, c.kind, s.document_id FROM {calendar} c JOIN (SELECT document_id, place_id, CAST(occurred_at AS DATE) AS day FROM {coded} UNION SELECT document_id, unnest(place_ids), published_on FROM {articles}) s
      ON s.place_id = c.place_id AND s.day BETWEEN c.starts_on - 3 AND c.starts_on + 3),
    k AS (SELECT DISTINCT document_id, system, code FROM (SELECT document_id, 'cameo' AS system, coalesce(CASE WHEN event_code IS DISTINCT FROM base_code THEN event_code END, base_code, root_code) AS code FROM {coded}
      UNION ALL SELECT document_id, 'theme', unnest(themes) FROM {articles}) c WHERE (system, code) IN (SELECT (system, code) FROM {links}))
    SELECT system, code, count(DISTINCT document_id) AS documents, count(DISTINCT CASE WHEN kind = 'event' THEN entry_id END) AS events, count(DISTINCT CASE WHEN kind = 'control' THEN entry_id END) AS controls
    FROM k JOIN w USING (document_id) GROUP BY system, code""",
)
def _(calendar, coded, articles, links):
    members, windows = C.shared_windows(calendar, ("entry_id", "kind"))
    return reports.code_outcomes(matching.carried_codes(coded, articles, links), members, C.window_sightings(windows, coded, articles))

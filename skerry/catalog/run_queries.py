"""Runs, judging, sources, snapshots, streams and the smaller operators over the role tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skerry.catalog.roles import Catalog
from skerry.functions.rates import rate
from skerry.operators import hierarchy, judging
from skerry.operators import matching as K
from skerry.operators import metrics as M
from skerry.operators import ranking as R
from skerry.operators import sampling as S
from skerry.plans import runs
from skerry.sources import feeds, html_text
from skerry.streaming import ingest

catalog = Catalog()
add = catalog.add

PAIR = M.PAIR


@add(
    "SRC02_article_lines",
    "documents",
    """SELECT 'r' || doc_id AS record_id, 'http://x.example/' || doc_id AS url, array_to_string(list_sort(list_distinct(['T' || doc_id % 5, 'U' || doc_id % 3])), ',') AS themes,
      CASE WHEN doc_id % 2 = 0 THEN 'C' || doc_id % 7 ELSE 'D' || doc_id % 4 END AS countries FROM {documents} WHERE doc_id % 6 <> 5""",
)
def _(documents):
    """Lines made from the documents' ids, in either form, some of another collection."""
    i = F.col("doc_id").cast("string")
    theme = F.concat(F.lit("T"), (F.col("doc_id") % 5).cast("string"), F.lit("{0};U"), (F.col("doc_id") % 3).cast("string"), F.lit("{0};"))
    even = F.col("doc_id") % 2 == 0
    place = F.concat(F.lit("4#x#"), F.when(even, F.concat(F.lit("C"), (F.col("doc_id") % 7).cast("string"))).otherwise(F.concat(F.lit("D"), (F.col("doc_id") % 4).cast("string"))), F.lit("#1#2;1#y"))
    blank = F.lit("")
    fields = [
        F.concat(F.lit("r"), i), F.lit("20240101000000"), F.when(F.col("doc_id") % 6 == 5, "2").otherwise("1"), F.lit("s"), F.concat(F.lit("http://x.example/"), i), blank, blank,
        F.when(even, F.replace(theme, F.lit("{0}"), blank)).otherwise(blank), F.when(even, blank).otherwise(F.replace(theme, F.lit("{0}"), F.lit(",17"))),
        F.when(even, place).otherwise(blank), F.when(even, blank).otherwise(place),
    ]
    lines = documents.select(F.concat_ws("\t", *fields).alias("line"))
    return feeds.article_rows(lines).select("record_id", "url", F.array_join("themes", ",").alias("themes"), F.array_join("countries", ",").alias("countries"))


@add("SRC11_extracted_pages", "pages")
def _(pages):
    """Texts of the first extractor that passes the gate; tests compare with a reading by hand."""
    return html_text.extracted(pages).select("page_id", "method", "error", F.length("body").alias("body_chars"))


@add("SRC12_body_limit", "documents", "SELECT doc_id, length(substr(text, 1, 2000)) AS chars, md5(substr(text, 1, 2000)) AS digest FROM {documents}")
def _(documents):
    """What a model with a short context is shown; the whole text stays in the table."""
    cut = F.substring("text", 1, 2000)
    return documents.select("doc_id", F.length(cut).cast("long").alias("chars"), F.md5(cut).alias("digest"))


@add("SRC29_insert_absent", "pages documents", "SELECT DISTINCT 'p' || page_id AS url FROM {pages} WHERE page_id NOT IN (SELECT doc_id FROM {documents} WHERE lang = 'en')")
def _(pages, documents):
    there = documents.where("lang = 'en'").select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("url"))
    return feeds.insert_absent(there, pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("url")), ["url"])


@add("SRC30_stored_events", "coded places", "SELECT feed_event_id, p.place_id AS place_id FROM {coded} c LEFT JOIN {places} p ON p.place_id = c.place_id AND p.region_id < 3")
def _(coded, places):
    rows = coded.select("feed_event_id", "place_id").dropDuplicates(["feed_event_id"])
    known = places.where("region_id < 3").select("place_id", F.lit(True).alias("_known"))
    return rows.join(known, "place_id", "left").select("feed_event_id", F.when(F.col("_known"), F.col("place_id")).alias("place_id"))


@add("JD01_pending_pairs", "pool verdicts", "SELECT document_id, concept_id FROM {pool} WHERE selected AND (document_id, concept_id) NOT IN (SELECT (document_id, concept_id) FROM {verdicts} WHERE run_id = 1)")
def _(pool, verdicts):
    return judging.pending(pool.where("selected").select(*PAIR), verdicts.where("run_id = 1"))


@add(
    "JD03_cost_split",
    "pool",
    """SELECT document_id, concept_id, (1000 + document_id) // n + CASE WHEN r = 1 THEN (1000 + document_id) % n ELSE 0 END AS tokens FROM (
      SELECT document_id, concept_id, count(*) OVER (PARTITION BY document_id) AS n, row_number() OVER (PARTITION BY document_id ORDER BY concept_id) AS r FROM {pool} WHERE selected) s""",
)
def _(pool):
    kept = pool.where("selected").select(*PAIR)
    calls = kept.select("document_id").distinct().withColumn("tokens", 1000 + F.col("document_id"))
    return judging.batched_cost(calls, kept)


@add("JD05_best_event", "verdicts", "SELECT document_id, concept_id, run_id AS ordinal FROM (SELECT *, row_number() OVER (PARTITION BY document_id, concept_id ORDER BY coalesce(confidence, 0) DESC, run_id) AS n FROM {verdicts}) v WHERE n = 1")
def _(verdicts):
    return judging.best_event(verdicts.select(*PAIR, "confidence", F.col("run_id").alias("ordinal")))


@add("JD06_no_body", "verdicts articles", "SELECT v.run_id, count(*) AS verdicts, count_if(a.document_id IS NULL) AS without_body FROM {verdicts} v LEFT JOIN {articles} a USING (document_id) GROUP BY v.run_id")
def _(verdicts, articles):
    joined = verdicts.join(articles.select("document_id", F.lit(True).alias("_has")), "document_id", "left")
    return joined.groupBy("run_id").agg(F.count("*").alias("verdicts"), F.count_if(F.col("_has").isNull()).alias("without_body"))


@add("RT01_missing_vectors", "articles vectors", "SELECT document_id AS object_id FROM {articles} WHERE document_id NOT IN (SELECT vec_id FROM {vectors})")
def _(articles, vectors):
    objects = articles.select(F.col("document_id").alias("object_id"), F.lit("body").alias("text_key"))
    cache = vectors.select(F.col("vec_id").alias("object_id"), F.lit("body").alias("text_key"))
    return judging.missing_vectors(objects, cache).select("object_id")


@add(
    "RT03_similarity_run",
    "embeddings",
    """WITH c AS (SELECT label AS concept_id, min(vec_id) AS vec_id FROM {embeddings} GROUP BY label), v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM {embeddings}),
    s AS (SELECT concept_id, v.vec_id AS code_id, round(list_dot_product(v.e, x.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(x.e, x.e))), 6) AS score FROM c JOIN v x USING (vec_id), v)
    SELECT concept_id, code_id, score FROM s WHERE score >= 0.45""",
)
def _(embeddings):
    """Classes against codes, those at least 0.45 alike (JN06)."""
    concepts = embeddings.groupBy(F.col("label").alias("concept_id")).agg(F.min_by("embedding", "vec_id").alias("leaf_vector"))
    codes = embeddings.select(F.col("vec_id").alias("document_id"), F.col("embedding").alias("vector"))
    found = R.similar(codes, concepts, 0.45)
    return found.select("concept_id", F.col("document_id").alias("code_id"), "score")


@add("ON04_stale_concepts", "part", "SELECT p_partkey AS concept_id FROM {part} WHERE p_size % 4 = 0 OR p_size > 45")
def _(part):
    """Then: as it is.  Now: some reworded, some gone, some with other blanks only."""
    then = part.select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("name"), F.col("p_type").alias("definition"))
    changed = F.when(F.col("p_size") % 4 == 0, F.concat("p_type", F.lit("!"))).otherwise(F.concat(F.lit(" "), "p_type", F.lit(" ")))
    now = part.where("p_size <= 45").select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("name"), changed.alias("definition"))
    return runs.stale_concepts(then, now)


@add(
    "ON02_snapshot_hash",
    "part",
    f"""WITH d AS (SELECT sha256(p_partkey || chr(30) || p_name || chr(31) || p_type) AS h FROM {{part}})
    SELECT substr(sha256(concat_ws(',', {", ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT)" for i in range(8))})), 1, 16) AS content_hash FROM d""",
)
def _(part):
    return runs.snapshot_hash(part.select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("name"), F.col("p_type").alias("definition")))


@add(
    "ST02_catch_up",
    "slices",
    """WITH p AS (SELECT feed, slot, CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status FROM {slices} WHERE slot > 100),
    n AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY slot) AS n, max(CASE WHEN status = 'pending' THEN 1 ELSE 0 END) OVER (PARTITION BY feed ORDER BY slot) AS stop FROM p)
    SELECT feed, slot, status FROM n WHERE n <= 32 AND stop = 0""",
)
def _(slices):
    """From slot 100 on; failed slices count as not there yet."""
    marks = slices.select("feed").distinct().withColumn("watermark", F.lit(100).cast("long"))
    return ingest.catch_up(slices.withColumn("status", F.when(F.col("status") == "failed", "pending").otherwise(F.col("status"))), marks)


@add(
    "ST04_slice_status",
    "slices",
    """SELECT feed, slot, CASE WHEN slot % 31 = 0 THEN 'failed' WHEN slot % 7 <> 0 AND events > 3 THEN 'ok' WHEN slot % 7 <> 0 THEN 'empty' WHEN slot * 10 >= 10800 THEN 'missing' ELSE 'pending' END AS status FROM {slices}""",
)
def _(slices):
    rows = F.when(F.col("events") > 3, F.col("events")).otherwise(0)
    return slices.select("feed", "slot", ingest.slice_status(F.col("slot") % 7 != 0, F.col("slot") % 31 == 0, rows, F.col("slot") * 10).alias("status"))


@add("ST10_slice_counts", "events", "SELECT strftime(time_bucket(INTERVAL 15 MINUTES, ts), '%Y-%m-%d %H:%M:%S') AS slice_start, event_type, count(*) AS n FROM {events} GROUP BY 1, 2")
def _(events):
    return ingest.slice_counts(events).withColumn("slice_start", F.date_format("slice_start", "yyyy-MM-dd HH:mm:ss"))


@add("EXT_sliding_counts", "events", "SELECT strftime(time_bucket(INTERVAL 15 MINUTES, ts) - INTERVAL 1 MINUTE * 15 * k, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n FROM {events}, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY 1")
def _(events):
    return ingest.sliding_counts(events).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@add(
    "EXT_sessions",
    "events",
    """WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM {events}),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def _(events):
    return ingest.sessions(events).withColumn("session_start", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss"))


@add("ST15_late_documents", "pool articles", "SELECT count(*) AS late FROM {articles} WHERE body IS NOT NULL AND NOT is_junk AND duplicate_of IS NULL AND document_id NOT IN (SELECT document_id FROM {pool})")
def _(pool, articles):
    usable = articles.where("body IS NOT NULL AND NOT is_junk AND duplicate_of IS NULL")
    return usable.join(pool, "document_id", "left_anti").agg(F.count("*").alias("late"))


@add("ST12_retry_state", "events", "SELECT user_id, count(*) AS failures, count(*) >= 3 AS final FROM {events} WHERE event_type = 'error' GROUP BY user_id")
def _(events):
    """A third failure is final."""
    return events.where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("failures"), (F.count("*") >= 3).alias("final"))


@add(
    "WIN14_recovered_calls",
    "verdicts",
    "SELECT run_id, document_id, concept_id, CAST(dense_rank() OVER (PARTITION BY run_id, document_id ORDER BY tokens, seconds, concept_id // 10) AS INT) AS call FROM {verdicts}",
)
def _(verdicts):
    w = Window.partitionBy("run_id", "document_id").orderBy("tokens", "seconds", F.floor(F.col("concept_id") / 10))
    return verdicts.select("run_id", *PAIR, F.dense_rank().over(w).alias("call"))


@add("WIN11_next_ordinal", "verdicts", "SELECT document_id, CAST(coalesce(max(concept_id) + 1, 0) AS INT) AS ordinal FROM {verdicts} GROUP BY document_id")
def _(verdicts):
    return verdicts.groupBy("document_id").agg(F.coalesce(F.max("concept_id") + 1, F.lit(0)).alias("ordinal"))


@add("WIN15_trial_bands", "articles pool", "SELECT document_id, CASE WHEN document_id IN (SELECT document_id FROM {pool} WHERE selected) THEN 0 WHEN document_id IN (SELECT document_id FROM {pool}) THEN 1 ELSE 2 END AS band FROM {articles} WHERE body IS NOT NULL ORDER BY band, document_id LIMIT 40")
def _(articles, pool):
    """Forty articles for a trial, those with selected candidates first."""
    bands = pool.groupBy("document_id").agg(F.max(F.when(F.col("selected"), 0).otherwise(1)).alias("_1"), F.bool_or("selected").alias("_any"))
    joined = articles.where("body IS NOT NULL").join(bands, "document_id", "left")
    band = F.when(F.col("_any"), 0).when(F.col("_any").isNotNull(), 1).otherwise(2)
    return joined.select("document_id", band.alias("band")).orderBy("band", "document_id").limit(40)


@add("OT04_versions", "verdicts", "SELECT run_id % 2 AS version, string_agg(DISTINCT CAST(run_id AS VARCHAR), ',' ORDER BY CAST(run_id AS VARCHAR) DESC) AS runs, count(*) AS verdicts FROM {verdicts} GROUP BY run_id % 2")
def _(verdicts):
    grouped = verdicts.groupBy((F.col("run_id") % 2).alias("version")).agg(F.collect_set("run_id").alias("r"), F.count("*").alias("verdicts"))
    return grouped.select("version", F.array_join(F.sort_array("r", asc=False), ",").alias("runs"), "verdicts")


@add("OT06_labels_per_concept", "labels_all", "SELECT concept_id, count(*) AS labels, count_if(matched) AS positives FROM {labels_all} GROUP BY concept_id")
def _(labels):
    return labels.groupBy("concept_id").agg(F.count("*").alias("labels"), F.count_if("matched").alias("positives"))


@add("OT07_shown_record", "shown", "SELECT run_id, count(DISTINCT (document_id, concept_id)) AS pairs, count(DISTINCT document_id) AS documents FROM {shown} GROUP BY run_id")
def _(shown):
    return shown.groupBy("run_id").agg(F.countDistinct(*PAIR).alias("pairs"), F.countDistinct("document_id").alias("documents"))


@add("OT08_usable_on_shown", "shown verdicts", "SELECT document_id, concept_id, matched FROM {verdicts} WHERE run_id = 1 AND error IS NULL AND matched IS NOT NULL AND (document_id, concept_id) IN (SELECT (document_id, concept_id) FROM {shown} WHERE run_id = 1)")
def _(shown, verdicts):
    return M.clean(verdicts.where("run_id = 1")).select(*PAIR, "matched").join(shown.where("run_id = 1"), PAIR, "left_semi")


@add("OT13_calendar_preview", "calendar coded", "SELECT c.entry_id, count(DISTINCT e.document_id) AS in_feed, count(DISTINCT CASE WHEN e.root_code < '11' THEN e.document_id END) AS passing FROM {calendar} c LEFT JOIN {coded} e ON e.place_id = c.place_id AND CAST(e.occurred_at AS DATE) BETWEEN c.starts_on - 3 AND c.starts_on + 3 GROUP BY c.entry_id")
def _(calendar, coded):
    from skerry.operators.calendars import entry_days, shared_windows

    members, windows = shared_windows(calendar)
    daily = coded.groupBy("place_id", F.to_date("occurred_at").alias("day"), "document_id").agg(F.bool_or(F.col("root_code") < "11").alias("passes"))
    met = daily.join(entry_days(windows, 3, 3, "window"), ["place_id", "day"]).groupBy("window", "document_id").agg(F.bool_or("passes").alias("passes"))
    counts = met.groupBy("window").agg(F.count("document_id").alias("in_feed"), F.count(F.when(F.col("passes"), F.col("document_id"))).alias("passing"))
    # an entry without any has a row as well
    return members.join(counts, "window", "left").select("entry_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("in_feed", "passing")))


@add("OT20_documents_per_run", "shown", "SELECT run_id, count(DISTINCT document_id) AS documents FROM {shown} GROUP BY run_id")
def _(shown):
    return shown.groupBy("run_id").agg(F.countDistinct("document_id").alias("documents"))


@add("OT28_leaf_families", "concepts edges", """WITH u AS (SELECT child, parent FROM {edges} UNION SELECT a.child, b.parent FROM {edges} a JOIN {edges} b ON a.parent = b.child)
    SELECT c.concept_id, array_to_string(list_sort(list(u.parent)), ',') AS families FROM {concepts} c JOIN u ON u.child = c.concept_id
    WHERE c.concept_id NOT IN (SELECT parent FROM {edges}) AND u.parent NOT IN (SELECT child FROM {edges}) GROUP BY c.concept_id""")
def _(concepts, edges):
    up = hierarchy.closure(edges).join(hierarchy.top_level(edges).withColumnRenamed("concept_id", "ancestor"), "ancestor", "left_semi")
    leafs = hierarchy.leaves(concepts, edges).join(up, "concept_id")
    return leafs.groupBy("concept_id").agg(F.array_join(F.array_sort(F.collect_list("ancestor")), ",").alias("families"))


@add("OT15_missed_positives", "truth pool", "SELECT document_id, concept_id FROM {truth} WHERE matched AND (document_id, concept_id) NOT IN (SELECT (document_id, concept_id) FROM {pool} WHERE selected)")
def _(truth, pool):
    return truth.where("matched").select(*PAIR).join(pool.where("selected"), PAIR, "left_anti")


@add("AGG36_found_by_class", "truth pool", "SELECT t.concept_id, count(*) AS positives, count(p.rank) AS in_pool, count_if(p.selected) AS kept FROM {truth} t LEFT JOIN {pool} p USING (document_id, concept_id) WHERE t.matched GROUP BY t.concept_id")
def _(truth, pool):
    joined = truth.where("matched").join(pool.select(*PAIR, "rank", "selected"), PAIR, "left")
    return joined.groupBy("concept_id").agg(F.count("*").alias("positives"), F.count("rank").alias("in_pool"), F.count_if("selected").alias("kept"))


@add(
    "AGG37_recall_by_level",
    "truth shown edges concepts",
    """WITH u AS (SELECT child, parent, 1 AS level FROM {edges} UNION SELECT a.child, b.parent, 2 FROM {edges} a JOIN {edges} b ON a.parent = b.child),
    l AS (SELECT * FROM u WHERE child NOT IN (SELECT parent FROM {edges})),
    t AS (SELECT document_id, level, parent, bool_or(matched) AS m FROM {truth} JOIN l ON concept_id = child GROUP BY 1, 2, 3),
    s AS (SELECT DISTINCT document_id, level, parent FROM {shown} JOIN l ON concept_id = child WHERE run_id = 1)
    SELECT level, count_if(m) AS positives, count_if(m AND s.parent IS NOT NULL) AS reached, round(CAST(count_if(m AND s.parent IS NOT NULL) AS DOUBLE) / nullif(count_if(m), 0), 6) AS recall
    FROM t LEFT JOIN s USING (document_id, level, parent) GROUP BY level""",
)
def _(truth, shown, edges, concepts):
    """Whether a true class above the leaves was reached, by its distance."""
    up = hierarchy.levels(edges).join(hierarchy.leaves(concepts, edges), "concept_id", "left_semi")
    key = ["document_id", "level", "ancestor"]
    true = truth.join(up, "concept_id").groupBy(*key).agg(F.bool_or("matched").alias("m"))
    reached = shown.where("run_id = 1").join(up, "concept_id").select(*key).distinct().withColumn("r", F.lit(True))
    hit = F.col("m") & F.col("r").isNotNull()
    sums = true.join(reached, key, "left").groupBy("level").agg(F.count_if("m").alias("positives"), F.count_if(hit).alias("reached"))
    return sums.withColumn("recall", F.round(rate(F.col("reached"), F.col("positives")), 6))


@add(
    "AGG44_sample_coverage",
    "labels_all verdicts",
    "SELECT count(DISTINCT document_id) AS sample, count(DISTINCT CASE WHEN document_id IN (SELECT document_id FROM {verdicts} WHERE run_id = 2) THEN document_id END) AS covered FROM {labels_all}",
)
def _(labels, verdicts):
    sample = labels.select("document_id").distinct().join(verdicts.where("run_id = 2").select("document_id").distinct().withColumn("c", F.lit(1)), "document_id", "left")
    return sample.agg(F.count("*").alias("sample"), F.count("c").alias("covered"))


@add(
    "AGG46_regression_gate",
    "truth verdicts",
    """WITH j AS (SELECT t.matched AS m, coalesce(v.matched, false) AS p FROM {truth} t LEFT JOIN (SELECT * FROM {verdicts} WHERE run_id = 2 AND error IS NULL AND matched IS NOT NULL) v USING (document_id, concept_id)),
    c AS (SELECT count(*) AS n, count_if(m AND p) AS tp, count_if(NOT m AND p) AS fp, count_if(m AND NOT p) AS fn FROM j)
    SELECT n, CASE WHEN n = 0 THEN 'inconclusive' WHEN round(2E0 * tp / nullif(2 * tp + fp + fn, 0), 6) >= 0.65 - 0.02 THEN 'pass' ELSE 'fail' END AS gate FROM c""",
)
def _(truth, verdicts):
    """F1 has to stay within 0.02 of a floor of 0.65."""
    scored = M.confusion(M.answers(truth, verdicts.where("run_id = 2")))
    return scored.select("n", F.when(F.col("n") == 0, "inconclusive").when(F.col("f1") >= 0.65 - 0.02, "pass").otherwise("fail").alias("gate"))


@add("AGG47_truth_summary", "truth", "SELECT count(*) AS labels, count_if(matched) AS positives, count(DISTINCT document_id) AS documents, count(DISTINCT concept_id) AS concepts FROM {truth}")
def _(truth):
    return truth.agg(F.count("*").alias("labels"), F.count_if("matched").alias("positives"), F.countDistinct("document_id").alias("documents"), F.countDistinct("concept_id").alias("concepts"))


@add(
    "AGG45_detection_summary",
    "verdicts truth",
    """SELECT CASE WHEN t.matched THEN 'confirmed' WHEN NOT t.matched THEN 'rejected' ELSE 'unverified' END AS verification, count(*) AS detections, count(DISTINCT v.document_id) AS documents
    FROM {verdicts} v LEFT JOIN {truth} t USING (document_id, concept_id) WHERE v.run_id = 1 AND v.error IS NULL AND v.matched GROUP BY 1""",
)
def _(verdicts, truth):
    found = M.clean(verdicts.where("run_id = 1")).where("matched").select(*PAIR).join(truth, PAIR, "left")
    status = F.when(F.col("matched"), "confirmed").when(~F.col("matched"), "rejected").otherwise("unverified")
    return found.groupBy(status.alias("verification")).agg(F.count("*").alias("detections"), F.countDistinct("document_id").alias("documents"))


@add("AGG17_pair_bootstrap", "truth verdicts")
def _(truth, verdicts):
    """F1 limits from resampling labelled pairs."""
    pairs = M.answers(truth, verdicts.where("run_id = 1")).withColumn("document_id", F.monotonically_increasing_id())
    return S.bootstrap_scores(S.document_counts(pairs), replicates=400).select("documents", "f1", "f1_low", "f1_high")


@add("TOP04_leaderboard", "truth verdicts", """WITH j AS (SELECT r.run_id, t.matched AS m, coalesce(v.matched, false) AS p FROM {truth} t CROSS JOIN (SELECT DISTINCT run_id FROM {verdicts}) r
      LEFT JOIN (SELECT * FROM {verdicts} WHERE error IS NULL AND matched IS NOT NULL) v ON v.run_id = r.run_id AND v.document_id = t.document_id AND v.concept_id = t.concept_id),
    c AS (SELECT run_id, count(*) AS n_labels, count_if(m AND p) AS tp, count_if(NOT m AND p) AS fp, count_if(m AND NOT p) AS fn FROM j GROUP BY run_id)
    SELECT run_id, n_labels, round(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def _(truth, verdicts):
    """Every run on all labels; a missing verdict is a no, so runs needn't be crossed with labels."""
    said = M.clean(verdicts).select("run_id", *PAIR, F.col("matched").alias("p")).join(truth, PAIR)
    total = truth.agg(F.count("*").alias("n_labels"), F.count_if("matched").alias("positives"))
    runs_ = verdicts.select("run_id").distinct()
    sums = said.groupBy("run_id").agg(F.count_if(F.col("matched") & F.col("p")).alias("tp"), F.count_if(~F.col("matched") & F.col("p")).alias("fp"))
    joined = runs_.join(sums, "run_id", "left").fillna(0, ["tp", "fp"]).crossJoin(F.broadcast(total))
    fn = F.col("positives") - F.col("tp")
    f1 = F.round(rate(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + fn), 6)
    return joined.select("run_id", "n_labels", f1.alias("f1")).orderBy(F.desc_nulls_last("f1"), F.desc("n_labels"), "run_id")

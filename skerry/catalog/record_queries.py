"""Sources, sinks, label imports, records of runs and judge modes over the role tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.catalog.calendar_queries import _QUEUE
from skerry.catalog.matching_queries import _SCORED as _RANKED_LEAVES
from skerry.catalog.matching_queries import _vectors
from skerry.catalog.roles import Catalog
from skerry.functions import feed_time, replies
from skerry.operators import bank, components, minhash, ontology, ranking, records, reports, strategies
from skerry.operators import metrics as M
from skerry.operators import sampling as S
from skerry.plans import runs, store
from skerry.plans.cuts import shared_folder
from skerry.plans.keyed import KeyedTable
from skerry.sources import feeds, fetching, sheets, slices

catalog = Catalog()
add = catalog.add
PAIR = M.PAIR


def _s(column: str, by: int) -> F.Column:
    """A column's remainder as text."""
    return (F.col(column) % by).cast("string")


def _file(rows: DataFrame, kind: str, **options) -> str:
    """The rows written to the shared folder; the path."""
    path = f"{shared_folder(rows.sparkSession)}/query-{uuid.uuid4().hex}"
    getattr(rows.write.options(**options), kind)(path)
    return path


# sources and sinks


@add(
    "SRC01_export_rows",
    "documents",
    """SELECT 'e' || doc_id AS event_id, '20240101' AS day, CASE WHEN doc_id % 3 = 0 THEN '' ELSE '1' || doc_id % 5 || doc_id % 3 END AS event_code, '1' || doc_id % 5 AS base_code, '01' AS root_code,
      'C' || doc_id % 7 AS country, 'http://x.example/' || doc_id AS url, '1' || doc_id % 5 || CASE WHEN doc_id % 3 = 0 THEN '' ELSE CAST(doc_id % 3 AS VARCHAR) END AS code
      FROM {documents} WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0""",
)
def _(documents):
    """Lines of 61 columns; some without an address, some too short."""
    base = F.concat(F.lit("1"), _s("doc_id", 5))
    filled = {
        0: F.concat(F.lit("e"), F.col("doc_id").cast("string")), 1: F.lit("20240101"), 26: F.when(F.col("doc_id") % 3 == 0, base).otherwise(F.concat(base, _s("doc_id", 3))),
        27: base, 28: F.lit("01"), 53: F.concat(F.lit("C"), _s("doc_id", 7)), 60: F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat(F.lit("http://x.example/"), F.col("doc_id").cast("string"))),
    }
    whole = F.concat_ws("\t", *(filled.get(i, F.lit("")) for i in range(feeds.EXPORT_WIDTH)))
    return feeds.export_rows(documents.select(F.when(F.col("doc_id") % 11 == 0, F.substring_index(whole, "\t", 50)).otherwise(whole).alias("line")))


@add("SRC03_location_countries", "documents", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE array_to_string(list_sort(list_distinct(['C' || doc_id % 7, 'D' || doc_id % 5])), ',') END AS countries FROM {documents}")
def _(documents):
    field = F.concat(F.lit("4#x#C"), _s("doc_id", 7), F.lit("#1#2;1#y;3##;2#z#D"), _s("doc_id", 5), F.lit("##;4#w#C"), _s("doc_id", 7))
    return documents.select("doc_id", F.array_join(feeds.location_countries(F.when(F.col("doc_id") % 4 == 0, "1#y").otherwise(field)), ",").alias("countries"))


@add("SRC04_theme_names", "documents", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN array_to_string(list_sort(list_distinct(['A' || doc_id % 3, 'B'])), ',') ELSE array_to_string(list_sort(list_distinct(['V' || doc_id % 3, 'W'])), ',') END AS themes FROM {documents}")
def _(documents):
    first = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("B;A"), _s("doc_id", 3), F.lit(";B;"))).otherwise("")
    return documents.select("doc_id", F.array_join(feeds.theme_names(first, F.concat(F.lit("W,12;V"), _s("doc_id", 3), F.lit(",700;W,90"))), ",").alias("themes"))


@add("SRC07_code_lookup", "part", "SELECT lpad(CAST(p_partkey % 1000 AS VARCHAR), CAST(2 + p_partkey % 3 AS INT), '0') AS code, 'N' || p_partkey AS name FROM {part} WHERE p_partkey % 9 <> 0")
def _(part):
    """A table with codes of two to four digits and some that aren't codes."""
    code = F.lpad(_s("p_partkey", 1000), (2 + F.col("p_partkey") % 3).cast("int"), "0")
    rows = part.select(F.when(F.col("p_partkey") % 9 == 0, F.concat(code, F.lit("x"))).otherwise(code), F.concat(F.lit(" N"), F.col("p_partkey").cast("string"), F.lit(" ")))
    lines = rows.select(F.concat_ws("\t", *rows.columns).alias("value"))
    return feeds.code_lookup(part.sparkSession, _file(lines, "text"))


@add("SRC08_theme_lookup", "part", "SELECT 'T' || p_partkey AS theme, p_partkey * 7 AS uses FROM {part} WHERE p_partkey % 6 <> 0")
def _(part):
    number = F.when(F.col("p_partkey") % 6 == 0, "many").otherwise((F.col("p_partkey") * 7).cast("string"))
    lines = part.select(F.concat_ws("\t", F.concat(F.lit("T"), F.col("p_partkey").cast("string")), number).alias("value"))
    return feeds.theme_lookup(part.sparkSession, _file(lines, "text"))


@add("SRC09_seeded_places", "nation", "SELECT n_nationkey AS iso3, CASE WHEN n_nationkey % 10 = 1 THEN 'UK' WHEN n_nationkey % 10 = 2 THEN 'GM' ELSE 'N' || n_nationkey % 10 END AS fips FROM {nation} WHERE n_nationkey % 4 <> 0")
def _(nation):
    iso2 = F.when(F.col("n_nationkey") % 10 == 1, "GB").when(F.col("n_nationkey") % 10 == 2, "DE").otherwise(F.concat(F.lit("N"), _s("n_nationkey", 10)))
    rows = nation.select(iso2.alias("iso2"), F.col("n_nationkey").alias("iso3"), F.col("n_name").alias("name"))
    there = nation.where("n_nationkey % 4 = 0").select(F.col("n_nationkey").alias("iso3"))
    return sheets.seeded_places(there, rows.union(rows), {"GB": "UK", "DE": "GM"}).select("iso3", "fips")


@add("SRC14_calendar", "calendar", "SELECT CAST(entry_id AS VARCHAR) AS id, kind, 'P' || place_id || ',Q' AS countries, starts_on, ends_on FROM {calendar}")
def _(calendar):
    """A sheet written, read back and checked as a whole."""
    sheet = calendar.select(
        F.concat(F.lit(" "), F.col("entry_id").cast("string")).alias("id"), "kind", F.col("concept_id").cast("string").alias("concept"),
        F.concat(F.lit("P"), F.col("place_id").cast("string"), F.lit(" | Q")).alias("country_iso3"), F.col("starts_on").cast("string").alias("date"),
        F.col("ends_on").cast("string").alias("end_date"), F.lit("").alias("precursor_of"), F.lit("a, \"b\"").alias("description"), F.lit("s").alias("sources"), F.lit("n").alias("notes"),
    )
    read = sheets.read_calendar(calendar.sparkSession, _file(sheet, "csv", header=True, escape='"'))
    return read.select("id", "kind", F.array_join("countries", ",").alias("countries"), "starts_on", "ends_on")


_LABEL_CELLS = "SELECT document_id, concept_id, matched FROM {labels_all} WHERE document_id % 3 = 0"


@add(
    "SRC15_import_labels",
    "labels_all documents",
    f"""SELECT c.concept_id, d.doc_id AS document_id, count(*) AS labels, count_if(matched) AS positives FROM ({_LABEL_CELLS}) c
      LEFT JOIN {{documents}} d ON d.doc_id = c.document_id WHERE c.concept_id < 30 AND NOT (d.doc_id IS NOT NULL AND c.concept_id % 4 = 0) GROUP BY ALL""",
)
def _(labels, documents):
    """Labels by address and name; those of known documents that are there already are left out."""
    url = F.concat(F.lit("u"), F.col("document_id").cast("string"))
    rows = labels.where("document_id % 3 = 0").select(url.alias("document_url"), F.concat(F.lit(" c"), F.col("concept_id").cast("string")).alias("concept"), F.when(F.col("matched"), "Yes").otherwise("0").alias("matched"), "source")
    known = documents.select(F.col("doc_id").alias("document_id"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"))
    concepts = documents.sparkSession.range(30).select(F.col("id").cast("int").alias("concept_id"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("concept"))
    there = labels.where("concept_id % 4 = 0").select(*PAIR)
    found = sheets.import_labels(rows, known, concepts, there)["labels"]
    return found.groupBy("concept_id", "document_id").agg(F.count("*").alias("labels"), F.count_if("matched").alias("positives"))


@add("SRC16_import_observations", "calendar", "SELECT DISTINCT concept_id, CASE WHEN place_id % 5 = 0 THEN NULL ELSE place_id END AS place_id, starts_on AS occurred_on FROM {calendar} WHERE place_id % 5 = 0 OR place_id < 20")
def _(calendar):
    iso3 = F.when(F.col("place_id") % 5 == 0, " ").otherwise(F.concat(F.lit("p"), F.col("place_id").cast("string")))
    rows = calendar.select(F.concat(F.col("concept_id").cast("string"), F.lit(" ")).alias("concept"), iso3.alias("locus_iso3"), F.col("starts_on").cast("string").alias("occurred_on"))
    concepts = calendar.select("concept_id", F.col("concept_id").cast("string").alias("concept")).distinct()
    places = calendar.where("place_id < 20").select("place_id", F.concat(F.lit("P"), F.col("place_id").cast("string")).alias("iso3")).distinct()
    return sheets.import_observations(rows, concepts, places)[0]


@add(
    "SRC17_whole_document_labels",
    "documents",
    "SELECT doc_id AS document_id, c.concept_id, doc_id % 4 <> 0 AND (c.concept_id = doc_id % 6 OR c.concept_id = 2) AS matched FROM {documents}, (SELECT CAST(unnest(range(6)) AS INT) AS concept_id) c WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0",
)
def _(documents):
    """Some rows are blank, some say none, some name a class that isn't there."""
    listed = F.concat(F.lit("c"), _s("doc_id", 6), F.lit("; c2 ;"))
    names = F.when(F.col("doc_id") % 5 == 0, " ").when(F.col("doc_id") % 7 == 0, "c1;zz").when(F.col("doc_id") % 4 == 0, "None").otherwise(listed)
    leaves = documents.sparkSession.range(6).select(F.col("id").cast("int").alias("concept_id"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("concept"))
    return sheets.whole_document_labels(documents.select(F.col("doc_id").alias("document_id"), names.alias("concepts")), leaves)


@add("SRC18_annotation_set", "labels_all", "SELECT 's' AS set, document_id, concept_id, CASE WHEN concept_id % 2 = 0 THEN NOT matched ELSE matched END AS matched FROM {labels_all} WHERE concept_id < 20")
def _(labels):
    """A set extended by rows of which some are there already."""
    before = labels.where("concept_id < 20").select(F.lit("s").alias("set"), *PAIR, "matched")
    rows = labels.where("concept_id < 20 AND concept_id % 2 = 0").select(*PAIR, (~F.col("matched")).alias("matched"))
    return bank.import_annotations(before, rows, "s", labels.select("document_id").distinct(), labels.select("concept_id").distinct())


@add("SRC19_imported_links", "links", "SELECT DISTINCT concept_id, system, code FROM {links}")
def _(links):
    plain = links.where("linked_run IS NOT NULL")
    concepts = links.select("concept_id", F.col("concept_id").cast("string").alias("concept")).distinct()
    rows = links.where("linked_run IS NULL").select(F.col("concept_id").cast("string").alias("concept"), "system", "code")
    return bank.import_links(plain, rows, concepts, links.select("system", "code").distinct()).select("concept_id", "system", "code").distinct()


@add("SRC24_manifest", "calendar", "SELECT row_number() OVER (ORDER BY entry_id) AS position, entry_id, 'seed 3' AS drawn FROM {calendar}")
def _(calendar):
    order = S._positions(calendar.select("entry_id"), ["entry_id"])
    order = order.select((F.col("position") - order.agg(F.min("position")).first()[0] + 1).cast("long").alias("position"), "entry_id")
    path = f"{shared_folder(calendar.sparkSession)}/query-{uuid.uuid4().hex}"
    sheets.write_manifest(order, path, drawn="seed 3")
    return sheets.read_manifest(calendar.sparkSession, path, "position long, entry_id long, drawn string")


@add("SRC25_run_metrics", "verdicts", "SELECT run_id, CASE WHEN run_id = 1 THEN count(*) ELSE -1 END AS n FROM {verdicts} GROUP BY run_id")
def _(verdicts):
    """All runs written, then one replaced."""
    spark = verdicts.sparkSession
    path = f"{shared_folder(spark)}/query-{uuid.uuid4().hex}"
    counts = verdicts.groupBy("run_id").agg(F.count("*").alias("n"))
    sheets.write_run_metrics(counts.withColumn("n", F.lit(-1).cast("long")), path)
    sheets.write_run_metrics(counts.where("run_id = 1"), path)
    return spark.read.parquet(path).select(F.col("run_id").cast("int"), "n")


@add("SRC26_csv_sink", "documents", "SELECT doc_id, lang, source FROM {documents} WHERE doc_id % 3 = 0")
def _(documents):
    path = f"{shared_folder(documents.sparkSession)}/query-{uuid.uuid4().hex}"
    sheets.write_csv(documents.where("doc_id % 3 = 0").select("doc_id", "lang", "source"), path)
    return documents.sparkSession.read.csv(path, header=True, schema="doc_id long, lang string, source string")


@add("SRC28_needed_columns", "lineitem", "SELECT l_orderkey, l_quantity FROM {lineitem} WHERE l_quantity > 40")
def _(lineitem):
    return records.needed(lineitem.where("l_quantity > 40"), "l_orderkey", "l_quantity")


# lookups


@add("FLT14_text_key", "documents", "SELECT doc_id FROM {documents} WHERE doc_id % 3 = 1")
def _(documents):
    keys = F.concat(F.element_at(F.array(F.lit("name"), F.lit("definition"), F.lit("name+definition")), (F.col("doc_id") % 3 + 1).cast("int")), F.lit("@abc"))
    return records.with_text_key(documents.withColumn("text_key", keys), "definition").select("doc_id")


@add("FLT21_processed_entries", "calendar", "SELECT entry_id, kind FROM {calendar} WHERE entry_id % 3 = 0")
def _(calendar):
    done = calendar.where("entry_id % 3 = 0").select("entry_id")
    return records.processed_entries(calendar, done.union(done)).select("entry_id", "kind")


@add("JN10_without_record", "verdicts shown", "SELECT DISTINCT run_id FROM {verdicts} WHERE run_id NOT IN (SELECT run_id FROM {shown} WHERE run_id = 2)")
def _(verdicts, shown):
    return records.without_record(verdicts, shown.where("run_id = 2"))


_RUNS = "SELECT CAST(n_nationkey AS INT) AS run_id, 'k' || n_nationkey % 4 AS key FROM {nation}"


def _runs(nation: DataFrame) -> DataFrame:
    return nation.select(F.col("n_nationkey").cast("int").alias("run_id"), F.concat(F.lit("k"), _s("n_nationkey", 4)).alias("key"))


@add("JN12_reusable_runs", "nation", f"WITH r AS ({_RUNS}) SELECT a.run_id, max(b.run_id) AS source_run_id FROM r a JOIN r b ON a.key = b.key AND b.run_id < a.run_id AND b.run_id % 3 <> 0 GROUP BY a.run_id")
def _(nation):
    rows = _runs(nation)
    return records.reusable_runs(rows, rows.where("run_id % 3 <> 0").select("run_id"))


_SCORED = "SELECT CAST(p_partkey % 20 AS INT) AS concept_id, 'c' || p_partkey AS code, (p_partkey * 37 % 101) / 100.0E0 AS score FROM {part}"


@add("TOP02_top_codes", "part", f"SELECT * FROM ({_SCORED}) s QUALIFY row_number() OVER (PARTITION BY concept_id ORDER BY score DESC, code) <= 4")
def _(part):
    scored = part.select((F.col("p_partkey") % 20).cast("int").alias("concept_id"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("code"), (F.col("p_partkey") * 37 % 101 / 100.0).alias("score"))
    return records.top_codes(scored, 4).select("concept_id", "code", "score")


@add("TOP10_labelled_documents", "truth", "SELECT document_id, count_if(matched) AS positives, count(*) AS labels FROM {truth} GROUP BY document_id")
def _(truth):
    return records.labelled_documents(truth)


@add("OT02_link_set", "links", "SELECT DISTINCT concept_id, system, code FROM {links} WHERE linked_run = 2 AND system = 'cameo'")
def _(links):
    snapshots = links.where("linked_run = 2 AND system = 'cameo'").withColumn("version", F.lit("f1")).unionByName(links.withColumn("version", F.lit("f2")))
    return records.link_set(links, snapshots, "f1")


@add("OT03_any_link", "links", "SELECT count(*) > 0 AS any_link FROM {links} WHERE system = 'theme'")
def _(links):
    return records.has_links(links.where("system = 'theme'"))


@add("OT34_snapshot_uses", "links nation", "SELECT v.version, (SELECT count(*) FROM (SELECT DISTINCT concept_id, system, code FROM {links} WHERE v.version = 'f2' OR system = 'theme')) AS links, (SELECT string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) FROM {nation} WHERE 'f' || (1 + n_nationkey % 2) = v.version) AS runs, v.version = 'f2' AS is_live FROM (SELECT unnest(['f1', 'f2']) AS version) v")
def _(links, nation):
    themes = links.where("system = 'theme'").withColumn("version", F.lit("f1"))
    used = nation.select(F.col("n_nationkey").cast("int").alias("run_id"), F.concat(F.lit("f"), (1 + F.col("n_nationkey") % 2).cast("string")).alias("version"))
    return records.snapshot_uses(themes.unionByName(links.withColumn("version", F.lit("f2"))), used, links).withColumn("runs", F.array_join("runs", ","))


@add("OT18_stage_versions", "nation", f"WITH r AS ({_RUNS}) SELECT run_id, 'filter' || run_id % 2 AS filter, 'retrieval' || run_id % 3 AS retrieval, CASE WHEN run_id % 5 <> 0 THEN 'judge' || run_id % 4 END AS judge FROM r")
def _(nation):
    rows = _runs(nation)
    made = [rows.where(f"'{stage}' <> 'judge' OR run_id % 5 <> 0").select("run_id", F.lit(stage).alias("stage"), F.concat(F.lit(stage), _s("run_id", n)).alias("version")) for stage, n in (("filter", 2), ("retrieval", 3), ("judge", 4))]
    return records.stage_versions(rows, made[0].union(made[1]).union(made[2]))


@add("OT30_retrieval_versions", "nation", f"WITH r AS ({_RUNS}) SELECT key AS version, max(run_id) AS newest_run, count(*) AS runs, count(DISTINCT run_id % 3) AS cutoffs FROM r GROUP BY key")
def _(nation):
    rows = _runs(nation).select("run_id", F.col("key").alias("version"), (F.col("run_id") % 3 / 10).alias("min_score"), F.lit(0.1).alias("margin"), F.lit(15).alias("max_k"))
    return records.retrieval_versions(rows).withColumn("cutoffs", F.size("cutoffs").cast("long"))


@add("OT31_judged_runs", "verdicts", "SELECT run_id, count(*) AS verdicts FROM {verdicts} GROUP BY run_id")
def _(verdicts):
    return records.judged_runs(verdicts)


def _cutoff_sql(name: str, scored: str, truth: str, least: float, margin: float, most: int) -> str:
    """One cutoff's report: AGG41's, for a pool and labels in SQL."""
    return f"""SELECT s.*, h.*, '{name}' AS cutoff FROM (
      SELECT CAST(sum(kept) AS BIGINT) AS pairs, round(avg(kept), 6) AS per_document, count_if(kept = 0) AS documents_with_none, count(*) AS documents
      FROM (SELECT document_id, count_if(kept) AS kept FROM (SELECT *, score >= greatest({least}, max(score) OVER (PARTITION BY document_id) - {margin}) AND rank <= {most} AS kept FROM {scored}) k GROUP BY document_id) d) s,
      (SELECT count(*) AS positives, count(k.kept) AS in_pool, count_if(k.kept) AS kept_positives FROM {truth} t
       LEFT JOIN (SELECT *, score >= greatest({least}, max(score) OVER (PARTITION BY document_id) - {margin}) AND rank <= {most} AS kept FROM {scored}) k USING (document_id, concept_id) WHERE t.matched) h"""


@add("OT32_both_cutoffs", "pool truth", _cutoff_sql("asked", "{pool}", "{truth}", 0.3, 0.2, 3) + " UNION ALL " + _cutoff_sql("own", "{pool}", "{truth}", 0.25, 0.1, 15))
def _(pool, truth):
    scored = pool.select(*PAIR, "score", "rank")
    return records.both_cutoffs(scored, truth, {"min_score": 0.3, "margin": 0.2, "max_k": 3}, {"min_score": 0.25, "margin": 0.1, "max_k": 15})


@add(
    "AGG42_live_cutoffs",
    "embeddings",
    _RANKED_LEAVES + ", p AS (SELECT document_id, concept_id, score, rank FROM r WHERE rank <= 8), t AS (SELECT vec_id AS document_id, label AS concept_id, vec_id % 3 <> 0 AS matched FROM {embeddings}) "
    + _cutoff_sql("asked", "p", "t", 0.0, 0.2, 3) + " UNION ALL " + _cutoff_sql("own", "p", "t", 0.1, 0.1, 5),
)
def _(embeddings):
    """Vectors ranked against the live leaves, and two cutoffs of that one pool; the labels are the vectors' own."""
    documents, leaves = _vectors(embeddings)
    truth = embeddings.select(F.col("vec_id").alias("document_id"), F.col("label").alias("concept_id"), (F.col("vec_id") % 3 != 0).alias("matched"))
    return records.live_cutoffs(documents.drop("own"), leaves, truth, {"min_score": 0.0, "margin": 0.2, "max_k": 3}, {"min_score": 0.1, "margin": 0.1, "max_k": 5}, 8)


@add("OT19_proposable_texts", "articles", "SELECT code, lower(code) AS text FROM (SELECT unnest(themes) AS code FROM {articles}) t GROUP BY code HAVING count(*) >= 20 AND code NOT LIKE 'TAX%'")
def _(articles):
    codes = articles.select(F.explode("themes").alias("code")).groupBy("code").agg(F.count("*").alias("uses"))
    return records.proposable_texts(codes, F.lower("code"), F.col("uses"), 20)


@add("OT21_unfetched", "articles", "SELECT count(*) AS unfetched FROM {articles} WHERE document_id % 2 = 0 AND document_id % 5 = 0")
def _(articles):
    dated = articles.withColumn("fetched_at", F.when(F.col("document_id") % 5 != 0, F.col("published_on")))
    return records.unfetched(dated, articles.where("document_id % 2 = 0").select("document_id"))


@add(
    "OT22_window_slices",
    "calendar slices",
    """SELECT entry_id, feed, count(*) AS slices, count_if(status IN ('ok', 'empty') AND (slot % 3 = 0 OR place_id = slot % 25)) AS covered
      FROM {calendar} c JOIN {slices} s ON s.slot // 96 BETWEEN datediff('day', DATE '1970-01-01', starts_on) - 19723 - 3 AND datediff('day', DATE '1970-01-01', ends_on) - 19723 + 3 GROUP BY entry_id, feed""",
)
def _(calendar, slices):
    """Slots count from 2024 on, the 19,723rd day."""
    scoped = slices.select("feed", (F.col("slot") + 19723 * 96).alias("slot"), "status", F.when(F.col("slot") % 3 != 0, F.array((F.col("slot") % 25).cast("long"))).alias("scope"))
    return records.window_slices(calendar.withColumn("place_id", F.col("place_id").cast("long")), scoped)


@add("OT17_calendar_recall", "calendar", "SELECT count(*) AS events, count_if(entry_id % 5 < 2) AS detected, round(count_if(entry_id % 5 < 2) / count(*), 6) AS recall FROM {calendar} WHERE kind = 'event' AND entry_id % 3 = 0")
def _(calendar):
    return records.run_calendar_recall(calendar, calendar.where("entry_id % 3 = 0"), calendar.where("entry_id % 5 < 2").select("entry_id"))


@add("ST11_to_drain", "articles", "SELECT document_id FROM {articles} WHERE document_id % 4 <> 1 ORDER BY published_on, document_id LIMIT 50")
def _(articles):
    """The budget is the feature."""
    waiting = articles.select("document_id", F.col("published_on").alias("first_seen"))
    return records.to_drain(waiting, articles.where("document_id % 4 = 1").select("document_id"), 50).select("document_id")


@add("ST06_backoff", "nation", "SELECT n_nationkey, CAST(CASE WHEN n_nationkey = 0 THEN 77 ELSE least(900, 30 * pow(2, n_nationkey - 1)) END AS BIGINT) AS seconds FROM {nation}")
def _(nation):
    return nation.select("n_nationkey", records.wait_seconds(F.col("n_nationkey"), F.lit(77).cast("long")).cast("long").alias("seconds"))


# labels, links, versions


@add("BK02_adjudicated", "labels_all", "SELECT document_id, concept_id, CASE WHEN source = 'machine' THEN NOT matched ELSE matched END AS matched, CASE WHEN source = 'machine' THEN 'adjudicated' ELSE source END AS source, CASE WHEN source = 'machine' THEN 'v2' ELSE 'v1' END AS version FROM {labels_all}")
def _(labels):
    before = labels.select(*PAIR, "matched", "source", F.lit("v1").alias("version"))
    rulings = before.where("source = 'machine'").select(*PAIR, (~F.col("matched")).alias("matched"))
    return bank.adjudicate(before, rulings, "v2")


@add("BK03_observed", "calendar", "SELECT DISTINCT concept_id, CASE WHEN place_id % 4 = 0 THEN NULL ELSE place_id END AS place_id, starts_on AS occurred_on FROM {calendar}")
def _(calendar):
    rows = calendar.select("concept_id", F.when(F.col("place_id") % 4 != 0, F.col("place_id")).alias("place_id"), F.col("starts_on").alias("occurred_on"))
    return bank.observe(rows.where("concept_id % 2 = 0").distinct(), rows)


@add("BK04_document_status", "labels_all", "SELECT document_id, count(DISTINCT concept_id) AS labelled, 5 AS leaves, count(DISTINCT concept_id) = 5 AS complete FROM {labels_all} WHERE concept_id < 5 GROUP BY document_id")
def _(labels):
    found = ontology.document_status(labels, labels.sparkSession.range(5).select(F.col("id").cast("int").alias("concept_id")))
    return found.withColumn("leaves", F.col("leaves").cast("int"))


@add("BK05_truth_of_a_set", "labels_all", "SELECT document_id, concept_id, matched FROM {labels_all} WHERE source = 'imported'")
def _(labels):
    sets = labels.select(F.col("source").alias("set"), *PAIR, "matched")
    return bank.truth_of(labels, labels.where("false"), sets, "imported")


@add("OT23_trusted_labels", "labels_all", "SELECT document_id, concept_id, matched FROM {labels_all} WHERE source <> 'machine' AND NOT (concept_id % 3 = 0 AND document_id % 2 = 0)")
def _(labels):
    held = labels.withColumn("version", F.concat(F.lit("v"), _s("document_id", 2)))
    reworded = labels.where("concept_id % 3 = 0").select(F.lit("v0").alias("version"), "concept_id").distinct()
    return bank.trusted(held, reworded)


@add("RT05_ticked_link", "links", "SELECT concept_id, system, code FROM {links} WHERE NOT (concept_id = 3 AND system = 'theme') UNION ALL SELECT 3, 'theme', 'T3'")
def _(links):
    """An automatic link ticked by hand and another removed."""
    plain = links.select("concept_id", "system", "code", "linked_run")
    ticked = bank.tick_link(plain, 3, "theme", "T3", on=True)
    return bank.tick_link(bank.tick_link(ticked, 3, "theme", "T9", on=True), 3, "theme", "T9", on=False).select("concept_id", "system", "code")


@add("JN21_supporting_documents", "calendar truth", "SELECT o.entry_id, t.document_id FROM {calendar} o JOIN {truth} t ON t.matched AND o.concept_id = t.concept_id AND (o.place_id % 6 = 0 OR o.place_id = t.document_id % 25) AND o.starts_on = DATE '2024-01-01' + CAST(t.document_id % 28 AS INT)")
def _(calendar, truth):
    dated = truth.select("document_id", (F.col("document_id") % 25).alias("place_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("document_id") % 28).cast("int")).alias("occurred_on")).distinct()
    rows = calendar.where("place_id IS NOT NULL").select("entry_id", "concept_id", F.when(F.col("place_id") % 6 != 0, F.col("place_id")).alias("place_id"), F.col("starts_on").alias("occurred_on"))
    return bank.supporting_documents(rows, truth, dated).select("entry_id", "document_id")


def _named(concepts: DataFrame) -> DataFrame:
    return concepts.select("concept_id", F.concat(F.lit("c"), F.col("concept_id").cast("string")).alias("name"), F.lit("d").alias("definition"))


@add("JN24_reworded", "concepts", "SELECT concept_id FROM {concepts} WHERE concept_id % 7 IN (1, 2)")
def _(concepts):
    then = _named(concepts)
    now = then.where("concept_id % 7 <> 2").withColumn("definition", F.when(F.col("concept_id") % 7 == 1, "e").otherwise(F.concat("definition", F.lit(" "))))
    return runs.stale_concepts(then, now)


@add("ON01_upserted_concepts", "concepts", "SELECT 'c' || concept_id AS name, CASE WHEN concept_id % 3 = 0 THEN 'new' ELSE 'd' END AS definition FROM {concepts}")
def _(concepts):
    rows = _named(concepts).select("name", "definition")
    half = rows.where("substring(name, 2) % 3 = 0").withColumn("definition", F.lit("new"))
    return ontology.upserted_concepts(rows.where("substring(name, 2) % 2 = 0"), half.unionByName(rows.where("substring(name, 2) % 2 <> 0 AND substring(name, 2) % 3 <> 0")))


@add("ON06_code_tree", "links", "SELECT DISTINCT l.code, (SELECT max(p.code) FROM {links} p WHERE p.system = 'cameo' AND p.code = left(l.code, length(l.code) - 1)) AS parent, CASE WHEN l.code LIKE '1%' THEN 'new' ELSE 'old' END AS name FROM {links} l WHERE system = 'cameo'")
def _(links):
    codes = links.where("system = 'cameo'").select("system", "code").distinct()
    rows = codes.where(F.col("code").startswith("1")).withColumn("name", F.lit("new"))
    return ontology.upserted_codes(codes.withColumn("name", F.lit("old")), rows).select("code", "parent", "name")


@add("OT33_live_version", "concepts", "SELECT 2 AS version")
def _(concepts):
    one = _named(concepts)
    marks = one.select(F.lit("x").alias("content_hash"), F.lit(1).alias("version")).limit(1)
    return ontology.live_version(ontology.mint(marks.select("version", "content_hash"), one), one)


@add("RT11_version_leaves", "concepts edges", "SELECT concept_id, 'c' || concept_id AS name FROM {concepts} WHERE concept_id NOT IN (SELECT parent FROM {edges})")
def _(concepts, edges):
    return ontology.version_leaves(_named(concepts), edges).select("concept_id", "name")


@add("GR06_replaced_relations", "concepts edges", "SELECT child, parent, 'is_a' AS predicate FROM {edges} UNION ALL SELECT child, parent, 'part_of' FROM {edges} WHERE child % 2 = 0")
def _(concepts, edges):
    before = edges.where("child % 2 = 0").withColumn("predicate", F.lit("part_of")).unionByName(edges.where("child % 2 = 1").withColumn("predicate", F.lit("is_a")))
    return ontology.replaced_relations(concepts, before, edges, "is_a")


@add("OT24_replaced_group", "concepts", "SELECT CASE WHEN concept_id % 2 = 0 THEN 'a' ELSE 'b' END AS grp, concept_id, CASE WHEN concept_id % 2 = 1 THEN 3.0E0 WHEN concept_id % 4 = 0 THEN 1.0E0 ELSE 2.0E0 END AS weight FROM {concepts}")
def _(concepts):
    members = concepts.select(F.when(F.col("concept_id") % 3 == 0, "a").otherwise("b").alias("group"), "concept_id", F.lit(9.0).alias("weight")).where("group = 'a'")
    odd = concepts.where("concept_id % 2 = 1").select(F.lit("b").alias("group"), "concept_id", F.lit(3.0).alias("weight"))
    rows = concepts.where("concept_id % 2 = 0").select("concept_id", F.when(F.col("concept_id") % 4 != 0, 2.0).alias("weight"))
    return ontology.replaced_group(members.unionByName(odd), "a", rows).withColumnRenamed("group", "grp")


@add(
    "GR10_components",
    "edges",
    """SELECT node, component FROM (WITH RECURSIVE e AS (SELECT child AS a, parent AS b FROM {edges} UNION SELECT parent, child FROM {edges}),
      r(node, other) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a) SELECT node, min(other) AS component FROM r GROUP BY node)""",
)
def _(edges):
    return components.connected_components(edges, "child", "parent")


# runs, judging, sampling


@add("JN15_answers", "truth verdicts", "SELECT t.document_id, t.concept_id, t.matched, coalesce(v.matched, false) AS predicted FROM {truth} t LEFT JOIN (SELECT * FROM {verdicts} WHERE run_id = 1 AND error IS NULL AND matched IS NOT NULL) v USING (document_id, concept_id)")
def _(truth, verdicts):
    return M.answers(truth, verdicts.where("run_id = 1")).select(*PAIR, "matched", "predicted")


@add("FN22_events", "documents", "SELECT doc_id, i AS ordinal, 'w' || i AS what, CASE WHEN doc_id % 2 = 0 THEN 'planned' ELSE 'occurred' END AS status, CASE WHEN doc_id % 3 = 0 THEN 'DE' END AS country FROM {documents}, range(8) r(i) WHERE i < doc_id % 11 AND doc_id % 5 <> 4")
def _(documents):
    """Up to ten events, of which eight are read; some replies are no JSON, some events of no known status."""
    one = F.transform(
        F.sequence(F.lit(0), (F.col("doc_id") % 11).cast("int")),
        lambda i: F.concat(
            F.lit('{"what": "w'), i.cast("string"), F.lit('", "status": "'),
            F.when(i == (F.col("doc_id") % 11).cast("int"), "guessed").when(F.col("doc_id") % 2 == 0, "PLANNED").otherwise("occurred"),
            F.lit('", "country": "'), F.when(F.col("doc_id") % 3 == 0, "de").otherwise("Germany"), F.lit('"}'),
        ),
    )
    reply = F.when(F.col("doc_id") % 5 == 4, "none, sorry").otherwise(F.concat(F.lit('Here: {"events": ['), F.array_join(one, ", "), F.lit("]} done")))
    return documents.select("doc_id", F.posexplode(replies.event_list(reply)).alias("ordinal", "e")).select("doc_id", F.col("ordinal").cast("long"), "e.*")


@add("FN23_choices", "documents", "SELECT doc_id, CASE WHEN doc_id % 6 < 4 THEN CAST(doc_id % 6 AS INT) END AS choice FROM {documents}")
def _(documents):
    reply = F.concat(F.lit('I say {"choice": '), _s("doc_id", 6), F.lit("}"))
    return documents.select("doc_id", replies.choice(reply, F.array(*map(F.lit, range(4)))).alias("choice"))


@add("RT07_flat_selection", "pool", "SELECT document_id, concept_id FROM {pool} WHERE selected")
def _(pool):
    return strategies.flat(pool)


@add("RT10_stored_retrieval", "shown", "SELECT run_id, document_id, concept_id, 0 AS offer, 1 AS rank FROM {shown}")
def _(shown):
    offers = shown.select("run_id", "document_id", F.lit(0).alias("offer"), "concept_id", F.lit(1).alias("rank"))
    return store.loaded_retrieval(store.stored_retrieval(offers))


@add("JN29_copied_retrievals", "shown", "SELECT 2 AS run_id, document_id, concept_id FROM {shown} WHERE run_id = 1 EXCEPT SELECT run_id, document_id, concept_id FROM {shown} WHERE run_id = 2")
def _(shown):
    return strategies.copied(shown.where("run_id = 1"), shown, 2).select("run_id", *PAIR)


@add("RN08_recovered_shown", "verdicts", "SELECT DISTINCT run_id, document_id, concept_id, CAST(dense_rank() OVER (PARTITION BY run_id, document_id ORDER BY concept_id // 10) - 1 AS INT) AS offer FROM {verdicts}")
def _(verdicts):
    return store.recovered_shown(verdicts.withColumn("created_at", F.floor(F.col("concept_id") / 10)))


@add("RN03_reused_stage", "pool", "SELECT document_id, concept_id, true AS reused FROM {pool} WHERE selected")
def _(pool):
    """A stage made once and found again under its key."""
    spark, root = pool.sparkSession, f"{shared_folder(pool.sparkSession)}/query-{uuid.uuid4().hex}"
    key = runs.stage_keys({})["candidates"]
    store.reused(spark, root, "candidates", key, lambda: pool.where("selected").select(*PAIR))
    found, reused = store.reused(spark, root, "candidates", key, lambda: pool.where("false").select(*PAIR))
    return found.withColumn("reused", F.lit(reused))


@add(
    "RN05_sweep",
    "nation",
    """WITH h AS (SELECT n_nationkey AS run_id, 10 * (1 + n_nationkey % 3) AS size, CASE n_nationkey % 2 WHEN 0 THEN 'pair' ELSE 'batch' END AS mode FROM {nation} WHERE n_nationkey % 4 <> 0),
    a AS (SELECT * FROM (SELECT unnest([10, 20, 40]) AS size) x, (SELECT unnest(['pair', 'batch', 'extract']) AS mode) y)
    SELECT a.size || '/' || a.mode AS setting, min(run_id) AS run_id FROM a LEFT JOIN h USING (size, mode) GROUP BY 1""",
)
def _(nation):
    """Nine runs of a sweep, and which of the runs so far did them; some of these failed, and all ran on hosts of their own."""
    n = F.col("n_nationkey")
    mode = F.when(n % 2 == 0, "pair").otherwise("batch")
    config = F.concat(F.lit('{"candidates": {"pool_size": '), (10 * (1 + n % 3)).cast("string"), F.lit('}, "judge": {"host": "h'), n.cast("string"), F.lit('", "mode": "'), mode, F.lit('"}}'))
    history = nation.select(n.alias("run_id"), config.alias("config"), F.when(n % 4 == 0, "failed").otherwise("done").alias("status"))
    return runs.sweep_status(history, {}, {"candidates.pool_size": [10, 20, 40], "judge.mode": ["pair", "batch", "extract"]}).select("setting", "run_id")


@add("FN26_stable_hash", "part", """SELECT p_partkey, substr(sha256('{"a":' || p_partkey || ',"b":"' || p_partkey % 3 || '"}'), 1, 12) AS hash FROM {part}""")
def _(part):
    """Of each part's settings, whatever the order and blanks of their JSON."""
    value = F.concat(F.lit('{"b": "'), _s("p_partkey", 3), F.lit('",  "a": '), F.col("p_partkey").cast("string"), F.lit("}"))
    return part.select("p_partkey", runs.stable_hashes(value).alias("hash"))


@add(
    "ON03_resolved",
    "part region",
    """WITH q AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'latest' WHEN 1 THEN 'v' || p_partkey % 8 ELSE 'x' || p_partkey END AS version FROM {part})
    SELECT p_partkey, version, CAST(CASE WHEN version = 'latest' THEN (SELECT max(r_regionkey) FROM {region}) WHEN version LIKE 'v%' THEN r_regionkey END AS INT) AS resolved FROM q LEFT JOIN {region} ON version = 'v' || r_regionkey""",
)
def _(part, region):
    """Versions that parts ask for, of the snapshots there are; others are refused."""
    k = F.col("p_partkey")
    version = F.when(k % 3 == 0, "latest").when(k % 3 == 1, F.concat(F.lit("v"), _s("p_partkey", 8))).otherwise(F.concat(F.lit("x"), k.cast("string")))
    return ontology.resolved(part.select("p_partkey", version.alias("version")), region.select(F.col("r_regionkey").cast("int").alias("version")))


@add("TOP06_labelling_queue", "verdicts pool labels_all", f"{_QUEUE} ORDER BY priority DESC, document_id, concept_id LIMIT 100")
def _(verdicts, pool, labels):
    """The first hundred of BK06's queue; the limit is the feature."""
    ready = M.usable_confidence(verdicts).where("usable").select("run_id")
    return records.pair_priorities(S.queue(verdicts, pool.where("selected"), labels, ready), 100).select(*PAIR, "priority", "reason")


@add("ST03_backfill", "slices", "SELECT feed, slot FROM {slices} WHERE slot BETWEEN 100 AND 900 AND status NOT IN ('ok', 'empty', 'missing')")
def _(slices):
    return store.backfill(slices, 100, 900)


@add("ST16_repaired_places", "coded", "SELECT feed_event_id, CASE WHEN feed_event_id % 3 = 0 THEN CASE WHEN feed_event_id % 2 = 0 THEN place_id END ELSE place_id END AS place_id FROM {coded}")
def _(coded):
    """Places lost on a third of the events, half of which are in the slice read again."""
    lost = coded.select("feed_event_id", F.when(F.col("feed_event_id") % 3 != 0, F.col("place_id")).alias("place_id"))
    return store.repaired_places(lost, coded.where("feed_event_id % 2 = 0").select("feed_event_id", "place_id"))


@add("AGG01_share", "truth", "SELECT count_if(matched) AS part, count(*) AS whole, round(count_if(matched) / count(*), 6) AS share FROM {truth}")
def _(truth):
    return reports.share(truth.where("matched"), truth)


@add(
    "EV04_live_leaderboard",
    "truth verdicts",
    """SELECT run_id, (SELECT count(DISTINCT document_id) FROM {truth}) AS sample, count(DISTINCT v.document_id) AS covered,
      CASE WHEN count(DISTINCT v.document_id) = (SELECT count(DISTINCT document_id) FROM {truth}) THEN round(2.0 * count_if(v.error IS NULL AND v.matched AND t.matched)
        / (count_if(v.error IS NULL AND v.matched AND t.matched) + count_if(v.error IS NULL AND v.matched AND NOT t.matched) + (SELECT count_if(matched) FROM {truth})), 6) END AS f1
      FROM {verdicts} v LEFT JOIN {truth} t USING (document_id, concept_id) WHERE v.document_id IN (SELECT document_id FROM {truth}) GROUP BY run_id""",
)
def _(truth, verdicts):
    return reports.live_leaderboard(truth, verdicts)


@add("EV06_regression", "truth verdicts", "SELECT 'share' AS figure, round(count_if(matched) / count(*), 6) AS value, CASE WHEN round(count_if(matched) / count(*), 6) >= 0.3 - 0.02 THEN 'pass' ELSE 'fail' END AS gate FROM {truth}")
def _(truth, verdicts):
    now = reports.share(truth.where("matched"), truth).withColumn("n", F.col("whole"))
    return reports.regression(now, {"share": 0.3})


@add(
    "ST12_failure_states",
    "events",
    """SELECT CAST(user_id AS VARCHAR) AS url, CASE WHEN t = 'error' THEN coalesce(n, 0) + 1 ELSE 0 END AS failures, t = 'error' AND coalesce(n, 0) + 1 >= 3 AS final
      FROM (SELECT user_id, arg_max(event_type, event_id) AS t FROM {events} GROUP BY user_id) l LEFT JOIN (SELECT user_id, count(*) AS n FROM {events} WHERE event_type = 'error' AND event_id % 2 = 0 GROUP BY user_id) f USING (user_id)""",
)
def _(events):
    """Failures so far, and how the last attempt ended."""
    url = F.col("user_id").cast("string").alias("url")
    before = events.where("event_type = 'error' AND event_id % 2 = 0").groupBy(url).agg(F.count("*").cast("int").alias("failures"))
    last = events.groupBy(url).agg(F.max_by("event_type", "event_id").alias("last"))
    return fetching.retry_state(before, last.select("url", F.when(F.col("last") == "error", "refused").alias("error")))


@add("SRC13_outcomes", "documents", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'failed' WHEN doc_id % 4 = 0 THEN 'junk' ELSE 'ok' END AS outcome FROM {documents}")
def _(documents):
    rows = documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "timeout").alias("error"), F.when(F.col("doc_id") % 4 == 0, "too_thin").alias("reason"))
    return fetching.outcome(rows).select("doc_id", "outcome")


_SLOTS = "SELECT unnest(generate_series((SELECT min(t) FROM s), (SELECT max(t) FROM s), INTERVAL 15 MINUTES)) AS t"


@add(
    "SRC06_slice_source",
    "events",
    f"""WITH s AS (SELECT time_bucket(INTERVAL 15 MINUTES, ts) AS t, count(*) AS n, sum(event_id) AS ids FROM {{events}} GROUP BY 1)
    SELECT strftime(a.t, '%Y%m%d%H%M%S') AS slice_key, CASE WHEN n IS NULL THEN 'missing' ELSE 'ok' END AS status, coalesce(n, 0) AS rows, CAST(coalesce(ids, 0) AS BIGINT) AS ids FROM ({_SLOTS}) a LEFT JOIN s ON a.t = s.t""",
)
def _(events):
    """Each quarter hour's events as a zipped slice of a feed, read back by the source; quarters without events aren't published."""
    spark = events.sparkSession
    base = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    fields = [F.lit("")] * 61
    fields[0], fields[60] = F.col("event_id").cast("string"), F.lit("http://x.example/")
    system, path = fetching.file_system(base)
    system.create_dir(path, recursive=True)
    lines = events.select(feed_time.floor_stamp(F.col("ts")).alias("slice_key"), F.concat_ws("\t", *fields).alias("line"))
    ends = slices.write_slices(lines, base, "export").agg(F.min("slice_key").alias("first"), F.max("slice_key").alias("last")).first()
    fetching.Note(f"{base}/{slices.LISTING}").write(f"1 0 http://x.example/{ends['last']}.{slices.FILES['export']}")
    rows = spark.read.format(slices.registered(spark)).options(base=base, feed="export", start=ends["first"]).load()
    named = slices.lines(rows).select("slice_key", F.get(F.split("line", "\t"), F.lit(0)).cast("long").alias("event_id")).groupBy("slice_key").agg(F.sum("event_id").alias("ids"))
    return slices.states(rows).join(named, "slice_key", "left").select("slice_key", "status", "rows", F.coalesce("ids", F.lit(0)).alias("ids"))


@add(
    "ST05_keyed_batches",
    "events",
    "SELECT user_id, min(event_id) % 4 AS batch, count(*) OVER () AS users FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 4, event_id) AS n FROM {events}) e WHERE n = 1 GROUP BY user_id",
)
def _(events):
    """Users seen first in one of four batches, each of which is replayed once."""
    table = KeyedTable(events.sparkSession, f"{shared_folder(events.sparkSession)}/keyed-{uuid.uuid4().hex}", ["user_id"])
    for batch in (0, 1, 1, 2, 0, 3):
        table.insert(events.where(F.col("event_id") % 4 == batch).select("user_id", F.lit(batch).cast("long").alias("batch")), f"b{batch}")
    rows = table.read()
    return rows.crossJoin(rows.agg(F.count("*").alias("users")))


@add("JN27_compared_share", "embeddings")
def _(embeddings):
    """How many pairs of vectors the similarity join at 0.92 compares in full; tests hold its pairs against all pairs."""
    return ranking.near_pairs(embeddings.select(F.col("vec_id").alias("concept_id"), F.col("embedding").alias("vector")), 0.92, counts=True)


@add(
    "DD01_batches",
    "documents",
)
def _(documents):
    """Near copies of the documents taken in by three batches; tests hold the grouping against the rule in plain Python."""
    spark = documents.sparkSession
    index = minhash.CopyIndex(spark, f"{shared_folder(spark)}/copies-{uuid.uuid4().hex}")
    for batch in range(3):
        state = index.add(documents.where(F.col("doc_id") % 3 == batch).select(F.col("doc_id").alias("document_id"), F.col("text").alias("body")), f"b{batch}")
    return state.select("document_id", "duplicate_of")

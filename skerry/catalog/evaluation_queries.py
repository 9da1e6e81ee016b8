"""Evaluations of calendars, links, live versions and samples, and the judges' questions, over the role tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skerry.catalog.calendar_queries import STAGES
from skerry.catalog.roles import Catalog
from skerry.functions import prompts
from skerry.operators import calendars as C
from skerry.operators import evaluations as E
from skerry.operators import matching

catalog = Catalog()
add = catalog.add

_REACH = """w AS (SELECT DISTINCT c.entry_id, c.concept_id, s.document_id FROM {calendar} c JOIN (
      SELECT document_id, place_id, CAST(occurred_at AS DATE) AS day FROM {coded} UNION SELECT document_id, unnest(place_ids), published_on FROM {articles}) s
      ON s.place_id = c.place_id AND s.day BETWEEN c.starts_on - 3 AND c.starts_on + 3),
    k AS (SELECT DISTINCT document_id, system, code FROM (
      SELECT document_id, 'cameo' AS system, coalesce(CASE WHEN event_code IS DISTINCT FROM base_code THEN event_code END, base_code, root_code) AS code FROM {coded}
      UNION ALL SELECT document_id, 'theme', unnest(themes) FROM {articles}) c WHERE (system, code) IN (SELECT (system, code) FROM {links})),
    m AS (SELECT DISTINCT entry_id, concept_id, system, code FROM w JOIN k USING (document_id)),
    o AS (SELECT DISTINCT entry_id FROM m SEMI JOIN {links} l ON l.concept_id = m.concept_id AND l.system = m.system AND l.code = m.code),
    r AS (SELECT entry_id, kind, concept_id, entry_id IN (SELECT entry_id FROM w) AS observable, entry_id IN (SELECT entry_id FROM m) AS reached,
      entry_id IN (SELECT entry_id FROM o) AS reached_by_own_class FROM {calendar})"""


def _reach(calendar, coded, articles, links):
    members, windows = C.shared_windows(calendar, ("entry_id", "concept_id"))
    seen = C.window_sightings(windows, coded, articles)
    return E.reach(calendar, members, seen, matching.carried_codes(coded, articles, links), links)


@add(
    "AGG14_reach_by_kind",
    "calendar coded articles links",
    f"WITH {_REACH} SELECT kind, count(*) AS entries, count_if(observable) AS observable, count_if(reached) AS reached, count_if(reached_by_own_class) AS reached_by_own_class FROM r GROUP BY kind",
)
def _(*frames):
    return E.reach_by_kind(_reach(*frames))


@add("AGG14_missed_by_own_class", "calendar coded articles links", f"WITH {_REACH} SELECT entry_id, kind, concept_id FROM r WHERE observable AND NOT reached_by_own_class")
def _(*frames):
    return E.missed_by_own_class(_reach(*frames))


@add(
    "AGG14_own_codes",
    "calendar coded articles links",
    f"WITH {_REACH} SELECT DISTINCT m.entry_id, m.system, m.code FROM m SEMI JOIN {{links}} l ON l.concept_id = m.concept_id AND l.system = m.system AND l.code = m.code",
)
def _(calendar, coded, articles, links):
    members, windows = C.shared_windows(calendar, ("entry_id", "concept_id"))
    codes = E.window_codes(C.window_sightings(windows, coded, articles), matching.carried_codes(coded, articles, links))
    return members.join(E.own_codes(members, codes, links), ["window", "concept_id"]).select("entry_id", "system", "code").distinct()


_LIVE = """ranked AS (SELECT DISTINCT document_id FROM {pool} WHERE document_id % 4 <> 0), p AS (SELECT document_id, concept_id, rank, selected AS kept FROM {pool} WHERE document_id % 4 <> 0),
    h AS (SELECT t.document_id, t.concept_id, p.rank, p.kept FROM {truth} t SEMI JOIN ranked r ON r.document_id = t.document_id
      LEFT JOIN p ON p.document_id = t.document_id AND p.concept_id = t.concept_id WHERE t.matched)"""


def _live(pool):
    """Documents whose vectors are known."""
    return pool.where("document_id % 4 <> 0").withColumnRenamed("selected", "kept")


def _wilson(k: str, n: str, sign: str) -> str:
    return f"round({k} * 1E0 / {n} / (1 + 3.8416E0 / {n}) + 1.9208E0 / {n} / (1 + 3.8416E0 / {n}) {sign} 1.96E0 * sqrt({k} * 1E0 / {n} * (1 - {k} * 1E0 / {n}) / {n} + 3.8416E0 / (4E0 * {n} * {n})) / (1 + 3.8416E0 / {n}), 6)"


@add(
    "AGG42_live_report",
    "pool truth",
    f"""WITH {_LIVE}, c AS (SELECT count(*) AS labelled, count_if(document_id IN (SELECT document_id FROM ranked)) AS ranked FROM (SELECT DISTINCT document_id FROM {{truth}})),
    s AS (SELECT count(*) AS pairs_kept, count(matched) AS kept_labelled, count_if(matched) AS kept_positive FROM p LEFT JOIN {{truth}} USING (document_id, concept_id) WHERE kept),
    n AS (SELECT count(*) AS positives, count(rank) AS in_pool, count_if(kept) AS found FROM h)
    SELECT c.*, s.*, n.*, labelled - ranked AS not_embedded, round(pairs_kept * 1E0 / ranked, 6) AS pairs_per_document, round(found * 1E0 / positives, 6) AS recall,
      {_wilson("found", "positives", "-")} AS recall_low, {_wilson("found", "positives", "+")} AS recall_high, round(in_pool * 1E0 / positives, 6) AS pool_recall,
      {_wilson("in_pool", "positives", "-")} AS pool_recall_low, {_wilson("in_pool", "positives", "+")} AS pool_recall_high,
      in_pool - found AS lost_to_cutoff, positives - in_pool AS never_ranked FROM c, s, n""",
)
def _(pool, truth):
    return E.live_report(_live(pool), truth)


@add("AGG42_live_classes", "pool truth", f"WITH {_LIVE} SELECT concept_id, count(*) AS positives, count(rank) AS in_pool, count_if(kept) AS kept FROM h GROUP BY concept_id")
def _(pool, truth):
    return E.live_classes(_live(pool), truth)


# three leaves, labelled on all documents but some, which have one label only
_SAMPLE = """l AS (SELECT document_id, CAST(c AS INT) AS concept_id, (document_id + c) % 4 = 0 AS matched, (document_id * 7 + c) % 5 = 0 AS predicted, (document_id + c) % 11 = 0 AS failed
      FROM {articles}, (SELECT r_regionkey AS c FROM {region} WHERE r_regionkey < 3) r WHERE c = 0 OR document_id % 101 <> 100),
    x AS (SELECT * FROM l WHERE document_id < 100)"""


def _on_sample(articles, region):
    leaves = region.where("r_regionkey < 3").select(F.col("r_regionkey").cast("int").alias("concept_id"))
    # three leaves
    pairs = articles.select("document_id").crossJoin(F.broadcast(leaves))
    labels = pairs.where("concept_id = 0 OR document_id % 101 <> 100").select("document_id", "concept_id", F.expr("(document_id + concept_id) % 4 = 0").alias("matched"))
    said = pairs.select("document_id", "concept_id", F.expr("(document_id * 7 + concept_id) % 5 = 0").alias("matched"), F.expr("CASE WHEN (document_id + concept_id) % 11 = 0 THEN 'failed' END").alias("error"))
    return E.run_on_sample(articles.select("document_id", F.col("document_id").alias("position")), labels, leaves, said)


@add(
    "EV03_sample_errors",
    "articles region",
    f"""WITH {_SAMPLE} SELECT document_id + 1 AS position, document_id, concept_id, CASE WHEN matched THEN 'false negative' ELSE 'false positive' END AS kind
    FROM x WHERE (predicted AND NOT failed) <> matched""",
)
def _(articles, region):
    return _on_sample(articles, region)[1]


@add(
    "EV03_sample_scores",
    "articles region",
    f"""WITH {_SAMPLE} SELECT count_if(matched AND predicted AND NOT failed) AS tp, count_if(NOT matched AND predicted AND NOT failed) AS fp, count_if(matched AND NOT (predicted AND NOT failed)) AS fn,
    count_if(NOT matched AND NOT (predicted AND NOT failed)) AS tn FROM x""",
)
def _(articles, region):
    return _on_sample(articles, region)[0].select("tp", "fp", "fn", "tn")


@add("EV03_out_of_turn", "articles region", "SELECT document_id FROM {articles} WHERE document_id > 100 AND document_id % 101 <> 100")
def _(articles, region):
    return _on_sample(articles, region)[2]


def _evaluated(calendar, coded, articles, shown, verdicts):
    reviews = calendar.where("entry_id % 5 < 2").select("entry_id", F.lit(1).alias("document_id"), (F.col("entry_id") % 5 == 0).alias("confirmed"))
    processed = calendar.where("entry_id % 3 <> 0").select("entry_id")
    return E.evaluate_calendar(calendar, processed, coded, articles, articles.where("lang <> 'de'"), shown.where("run_id = 1"), verdicts.where("run_id = 1"), reviews)


@add(
    "EV05_calendar_entries",
    "calendar coded articles shown verdicts",
    f"""WITH {STAGES} SELECT entry_id, kind, in_feed, passed_filter, fetched, retrieved, judged, matched, CAST(first_match AS VARCHAR) AS first_match, unique_documents, lost_at,
      CASE WHEN entry_id % 5 < 2 THEN entry_id % 5 = 0 END AS verified FROM r WHERE entry_id % 3 <> 0""",
)
def _(*frames):
    return _evaluated(*frames).entries.withColumn("first_match", F.col("first_match").cast("string"))


@add(
    "EV05_calendar_summary",
    "calendar coded articles shown verdicts",
    f"""WITH {STAGES} SELECT kind, count(*) AS entries, count_if(matched > 0) AS detected, round(avg(CASE WHEN matched > 0 THEN 1E0 ELSE 0E0 END), 6) AS rate,
      {", ".join(f"count_if(lost_at = '{s}') AS lost_at_{s}" for s in C.STAGES)} FROM r WHERE entry_id % 3 <> 0 GROUP BY kind""",
)
def _(*frames):
    return _evaluated(*frames).summary


@add("EV05_not_processed", "calendar coded articles shown verdicts", "SELECT entry_id FROM {calendar} WHERE entry_id % 3 = 0")
def _(*frames):
    return _evaluated(*frames).not_processed


_NL = "chr(10)"


@add(
    "FN25_questions",
    "nation",
    f"""SELECT n_nationkey, 'Event: strike' || {_NL} || 'Status: planned' || {_NL} || {_NL} || 'Which one of these classes is the event an instance of, if any?' || {_NL} || {_NL}
      || 'Number ' || n_nationkey || {_NL} || 'Class: ' || n_name || CASE WHEN n_nationkey % 2 = 0 THEN {_NL} || 'Meaning: of ' || n_name ELSE '' END || {_NL} || {_NL} || '{prompts.CHOICE}' AS choose,
      'Event: strike' || {_NL} || 'Status: planned' || {_NL} || {_NL} || 'Which of these questions has the answer yes for this event?' || {_NL} || {_NL}
      || 'Number ' || n_nationkey || {_NL} || 'Question: ' || CASE WHEN n_nationkey % 2 = 0 THEN 'of ' || n_name ELSE n_name END || {_NL} || {_NL} || 'Number 0' || {_NL} || 'Question: Is it none of these?'
      || {_NL} || {_NL} || '{prompts.CHOICES}' AS event_route FROM {{nation}}""",
)
def _(nation):
    none = F.lit(None).cast("string")
    meaning = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("of "), F.col("n_name"))).otherwise("")
    asked = F.struct(F.col("n_nationkey").alias("concept_id"), F.col("n_name").alias("name"), meaning.alias("definition"), none.alias("inclusion"), none.alias("exclusion"))
    event = F.struct(F.lit("strike").alias("what"), F.lit("planned").alias("status"), none.alias("country"), F.lit("").alias("evidence"))
    rows = nation.select("n_nationkey", F.array(asked).alias("classes"), event.alias("event"))
    return rows.select("n_nationkey", prompts.choose(F.col("event"), F.col("classes")).alias("choose"), prompts.event_route(F.col("event"), F.col("classes"), other=True).alias("event_route"))

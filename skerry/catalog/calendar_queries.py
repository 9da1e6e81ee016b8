"""Calendars, detections, samples, queues and funnels over the role tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skerry.catalog.roles import Catalog
from skerry.operators import calendars as C
from skerry.operators import metrics as M
from skerry.operators import sampling as S
from skerry.functions.rates import rate

catalog = Catalog()
add = catalog.add

_SEEN = """SELECT c.entry_id, s.document_id, min(s.day) AS first_seen FROM {calendar} c JOIN (
      SELECT document_id, place_id, CAST(occurred_at AS DATE) AS day FROM {coded} UNION SELECT document_id, unnest(place_ids), published_on FROM {articles}) s
    ON s.place_id = c.place_id AND s.day BETWEEN c.starts_on - 3 AND c.starts_on + 3 GROUP BY c.entry_id, s.document_id"""


@add("JN05_window_documents", "calendar coded articles", f"SELECT entry_id, document_id, CAST(first_seen AS VARCHAR) AS first_seen FROM ({_SEEN})")
def _(calendar, coded, articles):
    # written as text before entries multiply it
    members, windows = C.shared_windows(calendar)
    seen = C.window_sightings(windows, coded, articles).withColumn("first_seen", F.col("first_seen").cast("string"))
    return C.for_each_entry(seen, members, ["window"])


@add("JN04_events_in_window", "calendar coded", "SELECT c.entry_id, e.feed_event_id FROM {calendar} c JOIN {coded} e ON e.place_id = c.place_id AND CAST(e.occurred_at AS DATE) BETWEEN c.starts_on AND c.ends_on")
def _(calendar, coded):
    # a sequence would run backwards from an end before the start
    days = calendar.where("starts_on <= ends_on").select("entry_id", "place_id", F.explode(F.sequence("starts_on", "ends_on")).alias("day"))
    return C.for_each_entry(coded.select("feed_event_id", "place_id", F.to_date("occurred_at").alias("day")), days, ["place_id", "day"])


@add("SET08_all_window_documents", "calendar coded articles", f"SELECT DISTINCT document_id FROM ({_SEEN})")
def _(calendar, coded, articles):
    days = C.entry_days(calendar.select("place_id", "starts_on").distinct(), 3, 3, "starts_on").select("place_id", "day").distinct()
    return C.sightings(coded, articles).join(days, ["place_id", "day"], "left_semi").select("document_id").distinct()


@add("ST09_days_to_ingest", "calendar", "SELECT CAST(day AS VARCHAR) AS day, string_agg(DISTINCT CAST(place_id AS VARCHAR), ',' ORDER BY CAST(place_id AS VARCHAR)) AS places FROM (SELECT place_id, CAST(unnest(generate_series(starts_on - 3, starts_on + 3, INTERVAL 1 DAY)) AS DATE) AS day FROM {calendar}) GROUP BY day")
def _(calendar):
    found = C.days_to_ingest(calendar)
    return found.select(F.col("day").cast("string").alias("day"), F.array_join(F.array_sort(F.transform("places", lambda p: p.cast("string"))), ",").alias("places"))


STAGES = f"""w AS ({_SEEN}), p AS (SELECT w.*, c.concept_id, c.kind, coalesce(a.lang <> 'de', false) AS passed,
      CASE WHEN a.lang <> 'de' AND a.body IS NOT NULL AND NOT a.is_junk THEN coalesce(a.duplicate_of, a.document_id) END AS rep
      FROM w JOIN {{calendar}} c USING (entry_id) LEFT JOIN {{articles}} a USING (document_id)),
    sh AS (SELECT DISTINCT document_id AS rep, concept_id FROM {{shown}} WHERE run_id = 1), v AS (SELECT document_id AS rep, concept_id, matched FROM {{verdicts}} WHERE run_id = 1),
    f AS (SELECT p.*, sh.rep IS NOT NULL AS is_shown, sh.rep IS NOT NULL AND v.rep IS NOT NULL AS is_judged, sh.rep IS NOT NULL AND coalesce(v.matched, false) AS hit
      FROM p LEFT JOIN sh USING (rep, concept_id) LEFT JOIN v USING (rep, concept_id)),
    g AS (SELECT entry_id, count(*) AS in_feed, count_if(passed) AS passed_filter, count(rep) AS fetched, count_if(is_shown) AS retrieved, count_if(is_judged) AS judged,
      count_if(hit) AS matched, min(CASE WHEN hit THEN first_seen END) AS first_match, count(DISTINCT rep) AS unique_documents FROM f GROUP BY entry_id),
    st AS (SELECT c.entry_id, c.kind, coalesce(in_feed, 0) AS in_feed, coalesce(passed_filter, 0) AS passed_filter, coalesce(fetched, 0) AS fetched, coalesce(retrieved, 0) AS retrieved,
      coalesce(judged, 0) AS judged, coalesce(matched, 0) AS matched, first_match, coalesce(unique_documents, 0) AS unique_documents FROM {{calendar}} c LEFT JOIN g USING (entry_id)),
    r AS (SELECT *, CASE WHEN in_feed = 0 THEN 'in_feed' WHEN passed_filter = 0 THEN 'passed_filter' WHEN fetched = 0 THEN 'fetched' WHEN retrieved = 0 THEN 'retrieved'
      WHEN judged = 0 THEN 'judged' WHEN matched = 0 THEN 'matched' END AS lost_at FROM st)"""


def _stages(calendar, coded, articles, shown, verdicts):
    members, windows = C.shared_windows(calendar)
    passed = articles.where("lang <> 'de'")
    return C.stage_counts(calendar, members, C.window_sightings(windows, coded, articles), passed, articles, shown.where("run_id = 1"), verdicts.where("run_id = 1"))


@add(
    "AGG32_stage_counts",
    "calendar coded articles shown verdicts",
    f"WITH {STAGES} SELECT entry_id, kind, in_feed, passed_filter, fetched, retrieved, judged, matched, CAST(first_match AS VARCHAR) AS first_match, unique_documents, lost_at FROM r",
)
def _(*frames):
    return _stages(*frames).withColumn("first_match", F.col("first_match").cast("string"))


@add(
    "AGG31_calendar_summary",
    "calendar coded articles shown verdicts",
    f"""WITH {STAGES} SELECT kind, count(*) AS entries, count_if(matched > 0) AS detected, round(avg(CASE WHEN matched > 0 THEN 1E0 ELSE 0E0 END), 6) AS rate,
      {', '.join(f"count_if(lost_at = '{s}') AS lost_at_{s}" for s in C.STAGES)} FROM r GROUP BY kind""",
)
def _(*frames):
    return C.summary(_stages(*frames))


@add(
    "JN23_lead_times",
    "calendar coded articles shown verdicts",
    f"""WITH {STAGES} SELECT c.entry_id, c.precursor_of, CAST(t.starts_on - r.first_match AS INT) AS lead_days, d.matched > 0 AS disruption_detected
    FROM {{calendar}} c JOIN r ON r.entry_id = c.entry_id AND r.first_match IS NOT NULL JOIN {{calendar}} t ON t.entry_id = c.precursor_of JOIN r d ON d.entry_id = c.precursor_of
    WHERE c.kind = 'precursor'""",
)
def _(calendar, *frames):
    return C.lead_times(_stages(calendar, *frames), calendar)


@add(
    "AGG33_verified",
    "verdicts labels_all",
    """SELECT v.concept_id AS entry_id, CASE WHEN bool_or(coalesce(l.matched, false)) THEN true WHEN bool_and(coalesce(NOT l.matched, false)) THEN false END AS verified
    FROM {verdicts} v LEFT JOIN {labels_all} l USING (document_id, concept_id) WHERE v.run_id = 1 AND v.matched GROUP BY v.concept_id""",
)
def _(verdicts, labels):
    hits = verdicts.where("run_id = 1 AND matched").select("document_id", F.col("concept_id").alias("entry_id"))
    reviewed = hits.join(labels.select("document_id", F.col("concept_id").alias("entry_id"), F.col("matched").alias("confirmed")), ["document_id", "entry_id"], "left")
    return C.verified(reviewed)


@add(
    "ST07_window_readiness",
    "calendar slices",
    """WITH d AS (SELECT feed, DATE '2024-01-01' + CAST(slot // 96 AS INT) AS day, count_if(status <> 'failed') AS done, count_if(status IN ('ok', 'empty')) AS published FROM {slices} GROUP BY 1, 2),
    f AS (SELECT entry_id, feed, sum(done) AS done, sum(published) AS published FROM {calendar} JOIN d ON day BETWEEN starts_on AND starts_on + 1 GROUP BY entry_id, feed)
    SELECT c.entry_id, count_if(done >= 192) = 2 AS ready, coalesce(sum(published), 0) = 0 AS unobservable FROM {calendar} c LEFT JOIN f USING (entry_id) GROUP BY c.entry_id""",
)
def _(calendar, slices):
    dated = slices.withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.floor(F.col("slot") / 96).cast("int")))
    return C.readiness(calendar, dated, before=0, after=1)


@add(
    "AGG11_detections",
    "verdicts truth coded",
    """WITH s AS (SELECT document_id, min(CAST(occurred_at AS DATE)) AS d FROM {coded} GROUP BY document_id),
    x AS (SELECT v.concept_id, v.place_id, CAST(s.d AS VARCHAR) AS occurred_on, v.document_id, v.confidence, t.matched AS confirmed FROM {verdicts} v LEFT JOIN {truth} t USING (document_id, concept_id)
      LEFT JOIN s ON s.document_id = v.document_id WHERE v.run_id = 1 AND v.error IS NULL AND v.matched),
    g AS (SELECT concept_id, place_id, occurred_on, count(DISTINCT document_id) AS documents, count_if(confirmed) AS confirmed, count_if(NOT confirmed) AS rejected, max(confidence) AS max_confidence
      FROM x GROUP BY concept_id, place_id, occurred_on)
    SELECT *, CASE WHEN confirmed > 0 THEN 'confirmed' WHEN rejected > 0 AND rejected = documents THEN 'rejected' ELSE 'unverified' END AS verification FROM g""",
)
def _(verdicts, truth, coded):
    seen = coded.groupBy("document_id").agg(F.min(F.to_date("occurred_at")).cast("string").alias("occurred_on"))
    return C.detections(verdicts.where("run_id = 1"), truth, seen)


@add("AGG07_feed_dates", "coded", "SELECT document_id, CAST(min(CAST(occurred_at AS DATE)) AS VARCHAR) AS first_day FROM {coded} GROUP BY document_id")
def _(coded):
    return coded.groupBy("document_id").agg(F.min(F.to_date("occurred_at")).cast("string").alias("first_day"))


@add("AGG02_ingest_status", "slices", "SELECT feed, status, count(*) AS slices, CAST(sum(events) AS BIGINT) AS events FROM {slices} GROUP BY feed, status")
def _(slices):
    return slices.groupBy("feed", "status").agg(F.count("*").alias("slices"), F.sum("events").alias("events"))


@add("ST01_watermark", "slices", """WITH s AS (SELECT feed, slot, slot - row_number() OVER (PARTITION BY feed ORDER BY slot) AS run FROM {slices} WHERE status <> 'failed'),
    f AS (SELECT feed, min(slot) AS first FROM {slices} GROUP BY feed)
    SELECT s.feed, max(slot) AS watermark FROM s JOIN f USING (feed) WHERE run = (SELECT min(t.run) FROM s t WHERE t.feed = s.feed) AND EXISTS (SELECT 1 FROM s u WHERE u.feed = s.feed AND u.slot = first) GROUP BY s.feed""")
def _(slices):
    from skerry.streaming.watermark import contiguous

    return contiguous(slices)


@add("WIN12_owned_documents", "calendar coded articles", f"SELECT document_id, min(entry_id) AS entry_id FROM ({_SEEN}) GROUP BY document_id")
def _(calendar, coded, articles):
    # the first entry of each place and day stands for all
    first = calendar.groupBy("place_id", "starts_on").agg(F.min("entry_id").alias("entry_id"))
    days = C.entry_days(first, 3, 3).groupBy("place_id", "day").agg(F.min("entry_id").alias("entry_id"))
    return S.owned(C.sightings(coded, articles).join(days, ["place_id", "day"]))


@add("WIN13_first_of_representative", "calendar coded articles", f"SELECT entry_id, coalesce(duplicate_of, document_id) AS rep, CAST(min(first_seen) AS VARCHAR) AS first_seen FROM ({_SEEN}) JOIN {{articles}} USING (document_id) GROUP BY 1, 2")
def _(calendar, coded, articles):
    reps = articles.select("document_id", F.coalesce("duplicate_of", "document_id").alias("rep"))
    members, windows = C.shared_windows(calendar)
    seen = C.window_sightings(windows, coded, articles).join(reps, "document_id")
    first = seen.groupBy("window", "rep").agg(F.min("first_seen").cast("string").alias("first_seen"))
    return C.for_each_entry(first, members, ["window"])


_QUEUE = """WITH v AS (SELECT * FROM {verdicts} WHERE error IS NULL AND matched IS NOT NULL),
    u AS (SELECT run_id FROM {verdicts} WHERE confidence IS NOT NULL AND error IS NULL GROUP BY run_id HAVING count(*) >= 20 AND stddev_pop(confidence) >= 0.05
      AND avg(CASE WHEN confidence > 0.15 AND confidence < 0.85 THEN 1E0 ELSE 0E0 END) >= 0.05),
    j AS (SELECT document_id, concept_id, count(*) AS judged, count(DISTINCT matched) > 1 AS split, avg(CASE WHEN run_id IN (SELECT run_id FROM u) THEN confidence END) AS mean FROM v GROUP BY document_id, concept_id),
    p AS (SELECT * FROM (SELECT DISTINCT document_id, concept_id FROM {pool} WHERE selected) s FULL JOIN j USING (document_id, concept_id)),
    h AS (SELECT concept_id, count(*) AS labels FROM {labels_all} GROUP BY concept_id),
    q AS (SELECT p.*, 1E0 / (1 + coalesce(labels, 0)) AS cov, coalesce(greatest(0E0, 1 - 2 * abs(mean - 0.5E0)), 0E0) AS doubt FROM p LEFT JOIN h USING (concept_id)
      WHERE (document_id, concept_id) NOT IN (SELECT (document_id, concept_id) FROM {labels_all}))
    SELECT document_id, concept_id, round(CASE WHEN split THEN 1 + doubt WHEN judged IS NULL THEN 0.5E0 + 0.3E0 * cov WHEN doubt > 0 THEN 0.4E0 * doubt + 0.2E0 * cov ELSE 0.1E0 * cov END + 1E-9, 6) AS priority,
      CASE WHEN split THEN 'runs disagree' WHEN judged IS NULL THEN 'never judged' WHEN doubt > 0 THEN 'model uncertain' ELSE 'coverage' END AS reason FROM q"""


@add(
    "BK06_label_queue",
    "verdicts pool labels_all",
    _QUEUE,
)
def _(verdicts, pool, labels):
    usable = M.usable_confidence(verdicts).where("usable").select("run_id")
    return S.queue(verdicts, pool.where("selected"), labels, usable)


def _draw(seed: int) -> str:
    return f"('0x' || substr(md5('{seed}|' || document_id), 1, 13))::BIGINT / 4503599627370496E0"


FROZEN = f"""SELECT document_id, lang, source, row_number() OVER (ORDER BY place, lang, source, document_id) - 1 AS position FROM (
      SELECT document_id, lang, source, (row_number() OVER (PARTITION BY lang, source ORDER BY {_draw(0)}, document_id) - 1 + {_draw(1)}) / count(*) OVER (PARTITION BY lang, source) AS place FROM {{articles}}) a"""
EQUAL = f"""SELECT document_id, lang, source, row_number() OVER (ORDER BY turn, lang, document_id) - 1 AS position FROM (
      SELECT document_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY place, source, document_id) - 1 + {_draw(2)} AS turn FROM (
        SELECT document_id, lang, source, (row_number() OVER (PARTITION BY lang, source ORDER BY {_draw(0)}, document_id) - 1 + {_draw(1)}) / count(*) OVER (PARTITION BY lang, source) AS place
        FROM {{articles}}) a) b"""


@add("WIN05_frozen_order", "articles", FROZEN)
def _(articles):
    """Every prefix is proportional; tests check the prefixes."""
    return S.frozen_order(articles.select("document_id", "lang", "source"), "document_id", ["lang", "source"])


@add("WIN06_equal_order", "articles", EQUAL)
def _(articles):
    return S.equal_order(articles.select("document_id", "lang", "source"), "document_id", "lang", ["source"])


@add("OT35_drawn_sample", "articles", EQUAL)
def _(articles):
    """By default every window has its turn."""
    return S.draw_sample(articles.select("document_id", "lang", "source"), ["source"], window="lang")


@add(
    "OT12_sample_sheet",
    "articles",
    f"""SELECT o.position + 1 AS position, document_id, substr(split_part(body, chr(10), 1), 1, 160) AS title,
      substr(trim(regexp_replace(body, '\\s+', ' ', 'g')), 1, 700) AS excerpt FROM ({FROZEN}) o JOIN {{articles}} USING (document_id) WHERE o.position BETWEEN 49 AND 148""",
)
def _(articles):
    """A hundred positions of the frozen order."""
    order = S.frozen_order(articles.select("document_id", "lang", "source"), "document_id", ["lang", "source"])
    return S.sample_sheet(order, articles, 50, 100).drop("concepts", "note")


@add(
    "WIN07_labelled_prefix",
    "articles",
    "SELECT document_id, document_id AS position, document_id < (SELECT min(document_id) FROM {articles} WHERE is_junk) AS in_prefix FROM {articles} WHERE NOT is_junk",
)
def _(articles):
    order = articles.select("document_id", F.col("document_id").alias("position"))
    return S.labelled_prefix(order, articles.where("NOT is_junk"))


@add(
    "AGG38_window_weights",
    "articles labels",
    "WITH l AS (SELECT document_id, lang FROM {articles} WHERE document_id IN (SELECT doc_id FROM {labels})) SELECT document_id, lang AS \"window\", round((SELECT count(*) FROM {articles} a WHERE a.lang = l.lang) / CAST(count(*) OVER (PARTITION BY lang) AS DOUBLE), 6) AS weight FROM l",
)
def _(articles, labels):
    order = articles.select("document_id", F.col("lang").alias("window"))
    return S.window_weights(order, labels.select(F.col("doc_id").alias("document_id")))


@add("AGG18_document_bootstrap", "truth verdicts")
def _(truth, verdicts):
    """Intervals from resampling documents; tests hold them against exact limits."""
    return S.bootstrap_scores(S.document_counts(M.answers(truth, verdicts.where("run_id = 1"))))


@add("AGG20_stratified_bootstrap", "truth verdicts")
def _(truth, verdicts):
    pairs = M.answers(truth, verdicts.where("run_id = 1")).withColumn("window", F.col("document_id") % 30)
    return S.bootstrap_scores(S.document_counts(pairs, ("window",)), stratum="window")


@add(
    "WIN08_funnel",
    "articles pool shown verdicts",
    """WITH s AS (SELECT 1 AS step, 'pool' AS name, count(*) AS n FROM {pool} UNION ALL SELECT 2, 'selected', count_if(selected) FROM {pool}
      UNION ALL SELECT 3, 'shown', count(*) FROM {shown} WHERE run_id = 1
      UNION ALL SELECT 4, 'judged', count(*) FROM {shown} s JOIN {verdicts} v USING (document_id, concept_id) WHERE s.run_id = 1 AND v.run_id = 1 AND v.error IS NULL AND v.matched IS NOT NULL
      UNION ALL SELECT 5, 'matched', count(*) FROM {shown} s JOIN {verdicts} v USING (document_id, concept_id) WHERE s.run_id = 1 AND v.run_id = 1 AND v.error IS NULL AND v.matched)
    SELECT step, name, n, round(n / CAST(nullif(lag(n) OVER (ORDER BY step), 0) AS DOUBLE), 6) AS of_previous, round(n / CAST(nullif(first_value(n) OVER (ORDER BY step), 0) AS DOUBLE), 6) AS of_top FROM s""",
)
def _(articles, pool, shown, verdicts):
    """Five counts, then shares of the step before and of the first."""
    usable = shown.where("run_id = 1").select(*M.PAIR).join(M.clean(verdicts.where("run_id = 1")).select(*M.PAIR, "matched"), M.PAIR)
    steps = [
        pool.agg(F.lit(1).alias("step"), F.lit("pool").alias("name"), F.count("*").alias("n")),
        pool.agg(F.lit(2).alias("step"), F.lit("selected").alias("name"), F.count_if("selected").alias("n")),
        shown.where("run_id = 1").agg(F.lit(3).alias("step"), F.lit("shown").alias("name"), F.count("*").alias("n")),
        usable.agg(F.lit(4).alias("step"), F.lit("judged").alias("name"), F.count("*").alias("n")),
        usable.agg(F.lit(5).alias("step"), F.lit("matched").alias("name"), F.count_if("matched").alias("n")),
    ]
    whole = steps[0]
    for step in steps[1:]:
        whole = whole.unionByName(step)
    w = Window.orderBy("step")
    return whole.select(
        "step", "name", "n", F.round(rate(F.col("n"), F.lag("n").over(w)), 6).alias("of_previous"), F.round(rate(F.col("n"), F.first("n").over(w)), 6).alias("of_top")
    )

"""Text rules, keys, time stamps, replies, hierarchies and near duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from skerry.catalog.roles import Catalog
from skerry.functions import feed_time, gate, replies, texts
from skerry.operators import hierarchy, minhash

catalog = Catalog()
add = catalog.add

_LINK = r"\[[^\]]*\]\([^)]*\)"
#: As the rule is written, apart from the operator's own pattern.
_DEAD = (
    "page not found|page (cannot|could not|can''t) be found|page has (been )?moved|looking for (cannot|could not|can''t) be found|\\b404\\b[^\\n]{0,80}\\berror|\\berror\\s*(code\\s*)?404\\b|access denied"
    "|are you a (human|robot)|verify (that )?you are|(enable|turn on) javascript|subscribe (now )?to (read|continue)|(not available|unavailable) in your (country|region|location)"
)


@add(
    "FLT11_quality_gate",
    "articles",
    rf"""WITH p AS (SELECT document_id, body, regexp_replace(body, '{_LINK}', ' ', 'g') AS prose, length(body) - length(regexp_replace(body, '{_LINK}', '', 'g')) AS links FROM {{articles}})
    SELECT document_id, CASE WHEN trim(regexp_replace(body, '\s+', ' ', 'g')) = '' THEN 'empty'
      WHEN regexp_matches(body, '(?m)^Warning: Target URL returned error [0-9]+') THEN 'proxy_error' WHEN regexp_matches(body, '(?i){_DEAD}'.replace('{{0,80}}', '{{0,80}}')) THEN 'dead_page'
      WHEN links > 0.47E0 * length(body) THEN 'link_dump'
      WHEN len(regexp_extract_all(prose, '[A-Za-z][^.!?]{{29,}}[.!?]')) < 3 AND len(list_filter(regexp_split_to_array(prose, '\s+'), lambda x: x <> '')) < 50 THEN 'too_thin' END AS reason FROM p""".replace(
        ".replace('{{0,80}}', '{{0,80}}')", ""
    ),
)
def _(articles):
    return articles.select("document_id", gate.junk_reason(F.col("body")).alias("reason"))


@add("FN01_floor_stamp", "events", "SELECT event_id, strftime(time_bucket(INTERVAL 15 MINUTES, ts), '%Y%m%d%H%M%S') AS stamp FROM {events}")
def _(events):
    return events.select("event_id", feed_time.floor_stamp(F.col("ts")).alias("stamp"))


@add("FN02_next_previous", "events", "WITH s AS (SELECT event_id, time_bucket(INTERVAL 15 MINUTES, ts) AS t FROM {events}) SELECT event_id, strftime(t + INTERVAL 15 MINUTES, '%Y%m%d%H%M%S') AS next, strftime(t - INTERVAL 15 MINUTES, '%Y%m%d%H%M%S') AS previous FROM s")
def _(events):
    stamp = feed_time.floor_stamp(F.col("ts"))
    return events.select("event_id", feed_time.shifted(stamp, 1).alias("next"), feed_time.shifted(stamp, -1).alias("previous"))


@add(
    "FN03_stamps_between",
    "calendar",
    "SELECT entry_id, strftime(t, '%Y%m%d%H%M%S') AS stamp FROM (SELECT entry_id, unnest(generate_series(CAST(starts_on AS TIMESTAMP) + INTERVAL 15 MINUTES, CAST(starts_on AS TIMESTAMP) + INTERVAL 2 HOURS, INTERVAL 15 MINUTES)) AS t FROM {calendar}) s",
)
def _(calendar):
    start = F.date_format("starts_on", "yyyyMMdd000000")
    return calendar.select("entry_id", F.explode(feed_time.between(start, F.date_format("starts_on", "yyyyMMdd020000"))).alias("stamp"))


@add("FN04_lag", "events", "SELECT event_id, CAST(floor(date_diff('second', TIMESTAMP '2024-01-01', time_bucket(INTERVAL 15 MINUTES, ts)) / 900) AS BIGINT) AS lag FROM {events}")
def _(events):
    return events.select("event_id", feed_time.lag_slices(F.lit("20240101000000"), F.col("ts")).alias("lag"))


@add("FN05_next_poll", "events", "SELECT event_id, 900 - CAST(epoch(date_trunc('second', ts)) AS BIGINT) % 900 + 90E0 AS seconds FROM {events}")
def _(events):
    return events.select("event_id", feed_time.seconds_to_next(F.col("ts")).alias("seconds"))


@add("FN06_iso_day", "orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE o_orderpriority END AS day FROM {orders}")
def _(orders):
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.col("o_orderpriority"))
    return orders.select("o_orderkey", texts.iso_day(raw).alias("day"))


@add("FN07_url_key", "pages", "SELECT page_id, substr(sha1(url), 1, 16) AS url_key FROM {pages}")
def _(pages):
    return pages.select("page_id", texts.url_key(F.col("url")).alias("url_key"))


@add("FN08_host", "pages", r"SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)', 1)) AS host FROM {pages}")
def _(pages):
    return pages.select("page_id", texts.host(F.col("url")).alias("host"))


@add("FN09_content_key", "articles", "SELECT document_id, 'body@' || substr(sha256(body), 1, 12) AS content_key FROM {articles}")
def _(articles):
    return articles.select("document_id", texts.content_key(F.lit("body"), F.col("body")).alias("content_key"))


@add("FN10_calm_case", "articles", r"SELECT document_id, md5(CASE WHEN regexp_matches(body, '\p{Ll}') THEN body ELSE lower(body) END) AS digest FROM {articles}")
def _(articles):
    return articles.select("document_id", F.md5(texts.calm_case(F.col("body"))).alias("digest"))


@add("FN17_theme_words", "part", "SELECT p_partkey, lower(replace(regexp_replace('WB_' || p_size || '_' || replace(p_name, ' ', '_'), '^(?:TAX|WB)_(?:[0-9]+_)?', ''), '_', ' ')) AS words FROM {part}")
def _(part):
    return part.select("p_partkey", texts.theme_words(F.concat(F.lit("WB_"), "p_size", F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("_")))).alias("words"))


@add("FN19_parsed_boolean", "lineitem", "SELECT l_returnflag, CASE l_returnflag WHEN 'A' THEN true WHEN 'N' THEN false END AS answer, count(*) AS n FROM {lineitem} GROUP BY l_returnflag")
def _(lineitem):
    words = F.when(F.col("l_returnflag") == "A", " Yes ").when(F.col("l_returnflag") == "N", "NO").otherwise("maybe")
    return lineitem.groupBy("l_returnflag").agg(F.first(texts.parsed_boolean(words)).alias("answer"), F.count("*").alias("n"))


@add("FN24_cut_text", "articles", "SELECT document_id, CASE WHEN length(body) > 120 THEN substr(body, 1, 117) || '...' ELSE body END AS excerpt FROM {articles}")
def _(articles):
    return articles.select("document_id", texts.cut_text(F.col("body"), 120).alias("excerpt"))


_REPLY = "CASE WHEN event_id % 4 = 3 THEN 'no json' ELSE 'Well: {\"matched\": ' || CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END || ', \"confidence\": ' || CAST(event_id % 30 AS {S}) || '.5, \"country\": \" de \"} ok' END"


@add(
    "FN20_reply_verdict",
    "events",
    "SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN event_id % 3 = 0 END AS matched, CASE WHEN event_id % 4 <> 3 THEN least(1E0, event_id % 30 + 0.5E0) END AS confidence, CASE WHEN event_id % 4 <> 3 THEN 'DE' END AS country FROM {events}",
)
def _(events):
    return events.select("event_id", replies.verdict(F.expr(_REPLY.replace("{S}", "STRING"))).alias("v")).select("event_id", "v.*")


@add(
    "FN21_reply_batch",
    "events",
    """SELECT event_id, c AS concept_id, coalesce(CASE WHEN c = event_id % 5 THEN event_id % 2 = 0 END, false) AS matched, c <> event_id % 5 AS omitted
    FROM {events}, (SELECT unnest([0, 2, 4]) AS c)""",
)
def _(events):
    raw = F.concat(F.lit('{"results": [{"concept_id": '), (F.col("event_id") % 5).cast("string"), F.lit(', "matched": '), (F.col("event_id") % 2 == 0).cast("string"), F.lit('}, {"concept_id": 77, "matched": true}]}'))
    said = replies.batch(raw, F.array(F.lit(0), F.lit(2), F.lit(4)))
    return events.select("event_id", F.inline(said)).select("event_id", "concept_id", "matched", "omitted")


@add("GR02_leaves", "concepts edges", "SELECT concept_id FROM {concepts} WHERE concept_id NOT IN (SELECT parent FROM {edges})")
def _(concepts, edges):
    return hierarchy.leaves(concepts, edges)


@add("GR02_top_level", "edges", "SELECT DISTINCT parent AS concept_id FROM {edges} WHERE parent NOT IN (SELECT child FROM {edges})")
def _(edges):
    return hierarchy.top_level(edges)


_UP = "RECURSIVE up(concept_id, ancestor, level) AS (SELECT child, parent, 1 FROM {edges} UNION ALL SELECT up.concept_id, e.parent, up.level + 1 FROM up JOIN {edges} e ON up.ancestor = e.child)"


@add("GR03_ancestors", "edges", "SELECT child AS concept_id, parent AS ancestor FROM {edges} UNION SELECT a.child, b.parent FROM {edges} a JOIN {edges} b ON a.parent = b.child")
def _(edges):
    return hierarchy.closure(edges)


@add(
    "GR04_depth",
    "concepts edges",
    "SELECT c.concept_id, CAST(CASE WHEN EXISTS (SELECT 1 FROM {edges} e JOIN {edges} f ON e.parent = f.child WHERE e.child = c.concept_id) THEN 2 WHEN EXISTS (SELECT 1 FROM {edges} e WHERE e.child = c.concept_id) THEN 1 ELSE 0 END AS INT) AS depth FROM {concepts} c",
)
def _(concepts, edges):
    return hierarchy.depths(concepts, edges)


@add("GR05_acyclic", "edges", "SELECT child, parent FROM {edges}")
def _(edges):
    """The edges, once they are known to hold no cycle."""
    hierarchy.check_acyclic(edges)
    return edges


@add("GR07_leaves_under", "concepts edges", "WITH c AS (SELECT child, parent FROM {edges} UNION SELECT a.child, b.parent FROM {edges} a JOIN {edges} b ON a.parent = b.child) SELECT parent AS ancestor, child AS concept_id FROM c WHERE child NOT IN (SELECT parent FROM {edges})")
def _(concepts, edges):
    return hierarchy.leaves_under(concepts, edges)


@add(
    "GR08_internal_truth",
    "truth concepts edges",
    """WITH c AS (SELECT child, parent FROM {edges} UNION SELECT a.child, b.parent FROM {edges} a JOIN {edges} b ON a.parent = b.child)
    SELECT document_id, parent AS ancestor, bool_or(matched) AS matched FROM {truth} JOIN c ON concept_id = child WHERE child NOT IN (SELECT parent FROM {edges}) GROUP BY document_id, parent""",
)
def _(truth, concepts, edges):
    return hierarchy.internal_truth(truth, concepts, edges)


@add(
    "GR09_next_to_ask",
    "pool edges",
    """WITH a AS (SELECT document_id, 200 + concept_id % 2 AS concept_id FROM {pool} WHERE rank = 1), y AS (SELECT * FROM a WHERE document_id % 2 = 0),
    n AS (SELECT document_id, t.concept_id FROM (SELECT DISTINCT document_id FROM a) d, (SELECT DISTINCT parent AS concept_id FROM {edges} WHERE parent NOT IN (SELECT child FROM {edges})) t
      UNION SELECT document_id, child FROM y JOIN {edges} ON concept_id = parent)
    SELECT document_id, concept_id FROM n WHERE (document_id, concept_id) NOT IN (SELECT (document_id, concept_id) FROM a)""",
)
def _(pool, edges):
    asked = pool.where("rank = 1").select("document_id", (200 + F.col("concept_id") % 2).alias("concept_id"))
    return hierarchy.next_to_ask(edges, asked, asked.where("document_id % 2 = 0"))


@add(
    "OT29_structure",
    "concepts edges",
    """SELECT c.concept_id, array_to_string(list_sort(coalesce((SELECT list(parent) FROM {edges} WHERE child = c.concept_id), [])), ',') AS parents,
      array_to_string(list_sort(coalesce((SELECT list(child) FROM {edges} WHERE parent = c.concept_id), [])), ',') AS children,
      NOT EXISTS (SELECT 1 FROM {edges} WHERE parent = c.concept_id) AS is_leaf FROM {concepts} c""",
)
def _(concepts, edges):
    found = hierarchy.structure(concepts, edges)
    return found.select("concept_id", F.array_join("parents", ",").alias("parents"), F.array_join("children", ",").alias("children"), "is_leaf")


@add("DD01_near_duplicates", "articles")
def _(articles):
    """MinHash estimates are beyond SQL; tests compare with exact similarity."""
    return minhash.deduplicate(articles.select("document_id", "body"))

"""Code matching, filters, sets and cutoffs over the role tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skerry.catalog.roles import Catalog
from skerry.operators import matching as K
from skerry.operators import ranking as R

catalog = Catalog()
add = catalog.add

_TIER = "coalesce(CASE WHEN event_code IS DISTINCT FROM base_code THEN event_code END, base_code, root_code)"
_EVENTS = f"SELECT e.*, l.concept_id, l.code FROM (SELECT *, {_TIER} AS tier FROM {{coded}}) e JOIN (SELECT DISTINCT concept_id, code FROM {{links}} WHERE system = 'cameo') l ON tier = code"
_THEMES = "SELECT a.document_id, l.concept_id, theme AS code FROM (SELECT DISTINCT document_id, unnest(themes) AS theme FROM {articles}) a JOIN (SELECT DISTINCT concept_id, code FROM {links} WHERE system = 'theme') l ON theme = code"
_CARRIED = f"""SELECT DISTINCT document_id, system, code FROM (SELECT document_id, 'cameo' AS system, {_TIER} AS code FROM {{coded}}
    UNION ALL SELECT document_id, 'theme', unnest(themes) FROM {{articles}}) c WHERE (system, code) IN (SELECT (system, code) FROM {{links}})"""


@add("FLT01_event_code_nulled", "coded", "SELECT feed_event_id, CASE WHEN event_code IS DISTINCT FROM base_code THEN event_code END AS event_code FROM {coded}")
def _(coded):
    return coded.select("feed_event_id", F.when(~F.col("event_code").eqNullSafe(F.col("base_code")), F.col("event_code")).alias("event_code"))


@add("FLT02_first_tier", "coded", f"SELECT feed_event_id, {_TIER} AS code FROM {{coded}}")
def _(coded):
    return coded.select("feed_event_id", K.tier_code().alias("code"))


@add(
    "FLT04_fallback_chain",
    "links",
    """SELECT DISTINCT code, CASE WHEN length(code) >= 4 THEN code || '>' || left(code, 3) || '>' || left(code, 2)
      WHEN length(code) = 3 THEN code || '>' || left(code, 2) ELSE code END AS chain FROM {links} WHERE system = 'cameo'""",
)
def _(links):
    return links.where("system = 'cameo'").select("code", F.array_join(K.fallback_chain(F.col("code")), ">").alias("chain")).distinct()


@add("FLT05_membership", "coded links", "SELECT feed_event_id FROM {coded} WHERE root_code IN (SELECT code FROM {links})")
def _(coded, links):
    return coded.join(links.select(F.col("code").alias("root_code")), "root_code", "left_semi").select("feed_event_id")


@add("FLT06_array_overlap", "articles links", "SELECT DISTINCT document_id FROM (SELECT document_id, unnest(themes) AS t FROM {articles}) a WHERE t IN (SELECT code FROM {links})")
def _(articles, links):
    return K.matched_articles(articles, links).select("document_id").distinct()


@add("FLT07_scope_covers", "articles", "SELECT document_id, document_id % 5 = 0 OR (list_contains(place_ids, 3) AND list_contains(place_ids, 9)) AS covers FROM {articles}")
def _(articles):
    scope = F.when(F.col("document_id") % 5 != 0, F.col("place_ids"))
    return articles.select("document_id", K.covered(scope, F.array(F.lit(3), F.lit(9))).alias("covers"))


@add("FLT08_wanted_places", "articles", "SELECT document_id FROM {articles} WHERE list_has_any(place_ids, [1, 2, 3])")
def _(articles):
    return articles.where(F.arrays_overlap("place_ids", F.array(F.lit(1), F.lit(2), F.lit(3)))).select("document_id")


@add("FLT09_usable_representatives", "articles", "SELECT document_id FROM {articles} WHERE body IS NOT NULL AND NOT is_junk AND duplicate_of IS NULL ORDER BY published_on DESC, document_id DESC LIMIT 100")
def _(articles):
    """The hundred newest."""
    usable = articles.where(F.col("body").isNotNull() & ~F.col("is_junk") & F.col("duplicate_of").isNull())
    return usable.orderBy(F.desc("published_on"), F.desc("document_id")).limit(100).select("document_id")


@add("FLT10_pending_documents", "articles coded", "SELECT document_id FROM {articles} WHERE is_junk AND document_id NOT IN (SELECT document_id FROM {coded})")
def _(articles, coded):
    return articles.where("is_junk").join(coded, "document_id", "left_anti").select("document_id")


@add("FLT15_whole_day_window", "coded calendar", "SELECT entry_id, count(*) AS n FROM {calendar} JOIN {coded} ON occurred_at >= starts_on AND occurred_at < starts_on + 1 AND {coded}.place_id = {calendar}.place_id GROUP BY entry_id")
def _(coded, calendar):
    """Half-open days: equal places and days meet in an equi-join, so the range needs no cross product; events are counted by place and day first."""
    daily = coded.groupBy("place_id", F.to_date("occurred_at").alias("starts_on")).agg(F.count("*").alias("n"))
    return daily.join(calendar.select("entry_id", "place_id", "starts_on"), ["place_id", "starts_on"]).groupBy("entry_id").agg(F.sum("n").alias("n"))


@add("FLT16_min_confidence", "verdicts", "SELECT run_id, document_id, concept_id FROM {verdicts} WHERE matched AND coalesce(confidence, 0) >= 0.7")
def _(verdicts):
    return verdicts.where(F.col("matched") & (F.coalesce("confidence", F.lit(0.0)) >= 0.7)).select("run_id", "document_id", "concept_id")


@add("FLT17_proposable_themes", "articles", "SELECT theme, count(*) AS uses FROM (SELECT unnest(themes) AS theme FROM {articles}) t WHERE theme NOT LIKE 'TAX\\_%' ESCAPE '\\' GROUP BY theme HAVING count(*) >= 50")
def _(articles):
    uses = articles.select(F.explode("themes").alias("theme")).where(~F.col("theme").startswith("TAX_"))
    return uses.groupBy("theme").agg(F.count("*").alias("uses")).where("uses >= 50")


@add("FLT18_leaves_ranked", "pool edges", "SELECT document_id, concept_id FROM {pool} WHERE concept_id NOT IN (SELECT parent FROM {edges}) AND rank = 1")
def _(pool, edges):
    return pool.join(edges.select(F.col("parent").alias("concept_id")), "concept_id", "left_anti").where("rank = 1").select("document_id", "concept_id")


@add(
    "FLT19_filter_preview",
    "coded links",
    f"""WITH m AS (SELECT document_id, {_TIER} IN (SELECT code FROM {{links}} WHERE system = 'cameo') AS k FROM {{coded}})
    SELECT count(*) AS events, count_if(k) AS kept, count(DISTINCT document_id) AS documents, count(DISTINCT CASE WHEN k THEN document_id END) AS documents_kept,
      round(CAST(count_if(k) AS DOUBLE) / count(*), 6) AS share FROM m""",
)
def _(coded, links):
    return K.filter_preview(coded, links)


@add("FLT20_selected_gate", "pool articles", "SELECT document_id FROM {articles} WHERE document_id IN (SELECT document_id FROM {pool} WHERE selected)")
def _(pool, articles):
    return articles.select("document_id").join(pool.where("selected"), "document_id", "left_semi")


@add("JN01_links", "links", "SELECT concept_id, system, code, linked_run IS NULL AS manual FROM {links}")
def _(links):
    return links.select("concept_id", "system", "code", F.col("linked_run").isNull().alias("manual"))


@add("JN02_place_of_event", "coded places", "SELECT feed_event_id, place FROM {coded} LEFT JOIN {places} USING (place_id)")
def _(coded, places):
    return coded.join(places, "place_id", "left").select("feed_event_id", "place")


@add(
    "JN03_matching_documents",
    "coded articles links",
    f"""WITH ev AS ({_EVENTS}), th AS ({_THEMES}), u AS (
      SELECT document_id, concept_id, code, 0 AS way, feed_event_id AS place FROM ev UNION ALL SELECT document_id, concept_id, code, 1, 0 FROM th),
    r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY way, place, concept_id, code) AS n FROM u)
    SELECT document_id, concept_id, code, CASE WHEN way = 0 THEN 'cameo' ELSE 'theme' END AS system FROM r WHERE n = 1""",
)
def _(coded, articles, links):
    return K.matching_documents(coded, articles, links)


@add("OT01_carried_codes", "coded articles links", _CARRIED)
def _(coded, articles, links):
    return K.carried_codes(coded, articles, links)


@add(
    "AGG15_cost_by_code",
    "coded articles links",
    f"""WITH c AS ({_CARRIED}), n AS (SELECT document_id, count(*) AS codes FROM c GROUP BY document_id)
    SELECT system, code, count(*) AS admitted, count_if(codes = 1) AS only_this FROM c JOIN n USING (document_id) GROUP BY system, code""",
)
def _(coded, articles, links):
    return K.code_report(coded, articles, links)


@add(
    "AGG13_link_confusion",
    "coded articles links truth",
    f"""WITH c AS ({_CARRIED}), h AS (SELECT DISTINCT document_id, concept_id, system, code FROM c JOIN (SELECT DISTINCT concept_id, system, code FROM {{links}}) USING (system, code)),
    j AS (SELECT h.*, t.matched, count(*) OVER (PARTITION BY h.document_id, h.concept_id) AS ways FROM h JOIN {{truth}} t USING (document_id, concept_id))
    SELECT concept_id, system, code, count_if(matched) AS true_positives, count_if(NOT matched) AS false_positives, count_if(matched AND ways = 1) AS unique_true_positives
    FROM j GROUP BY concept_id, system, code""",
)
def _(coded, articles, links, truth):
    return K.link_confusion(coded, articles, links, truth)


@add("JN25_code_parents", "links", "WITH c AS (SELECT DISTINCT system, code FROM {links}) SELECT c.system, c.code, p.code AS parent, CAST(length(c.code) AS INT) AS level FROM c LEFT JOIN c p ON p.system = c.system AND p.code = left(c.code, length(c.code) - 1)")
def _(links):
    return K.code_tree(links.select("system", "code").distinct())


@add("OT14_code_counts", "links", "SELECT system, CAST(length(code) AS INT) AS level, count(DISTINCT code) AS codes FROM {links} GROUP BY system, length(code)")
def _(links):
    return links.groupBy("system", F.length("code").alias("level")).agg(F.countDistinct("code").alias("codes"))


@add("JN09_slices_without_place", "slices coded", "SELECT feed, slot FROM {slices} WHERE slot NOT IN (SELECT CAST(feed_event_id AS BIGINT) FROM {coded} WHERE place_id < 20)")
def _(slices, coded):
    placed = coded.where("place_id < 20").select(F.col("feed_event_id").alias("slot"))
    return slices.join(placed, "slot", "left_anti").select("feed", "slot")


@add("JN13_read_representative", "articles verdicts", "SELECT a.document_id, v.concept_id, v.matched FROM {articles} a JOIN {verdicts} v ON v.document_id = coalesce(a.duplicate_of, a.document_id) WHERE v.run_id = 1")
def _(articles, verdicts):
    """Copies read their representative's verdicts."""
    rep = articles.select("document_id", F.coalesce("duplicate_of", "document_id").alias("rep"))
    return rep.join(verdicts.where("run_id = 1").withColumnRenamed("document_id", "rep"), "rep").select("document_id", "concept_id", "matched")


@add("JN11_selected_never_retrieved", "pool shown", "SELECT count(DISTINCT document_id) AS documents FROM {pool} WHERE selected AND document_id NOT IN (SELECT document_id FROM {shown} WHERE run_id = 2)")
def _(pool, shown):
    return pool.where("selected").join(shown.where("run_id = 2"), "document_id", "left_anti").agg(F.countDistinct("document_id").alias("documents"))


@add("JN19_pool_stored_flag", "pool verdicts", "SELECT document_id, concept_id, p.selected, v.matched FROM {pool} p JOIN {verdicts} v USING (document_id, concept_id) WHERE v.run_id = 2")
def _(pool, verdicts):
    return pool.join(verdicts.where("run_id = 2"), ["document_id", "concept_id"]).select("document_id", "concept_id", "selected", "matched")


@add("JN28_copy_absent", "pool shown", "SELECT document_id, concept_id FROM {pool} WHERE (document_id, concept_id) NOT IN (SELECT (document_id, concept_id) FROM {shown} WHERE run_id = 1)")
def _(pool, shown):
    return pool.join(shown.where("run_id = 1"), ["document_id", "concept_id"], "left_anti").select("document_id", "concept_id")


@add("SET01_union_keys", "coded articles", "SELECT document_id FROM {coded} UNION SELECT document_id FROM {articles}")
def _(coded, articles):
    return coded.select("document_id").union(articles.select("document_id")).distinct()


@add("SET03_first_sighting", "coded articles", "SELECT document_id, CAST(min(d) AS VARCHAR) AS first_seen FROM (SELECT document_id, CAST(occurred_at AS DATE) AS d FROM {coded} UNION ALL SELECT document_id, published_on FROM {articles}) GROUP BY document_id")
def _(coded, articles):
    both = coded.select("document_id", F.to_date("occurred_at").alias("d")).unionByName(articles.select("document_id", F.col("published_on").alias("d")))
    return both.groupBy("document_id").agg(F.min("d").cast("string").alias("first_seen"))


@add("SET04_intersect", "coded articles", "SELECT document_id FROM {coded} INTERSECT SELECT document_id FROM {articles}")
def _(coded, articles):
    return coded.select("document_id").intersect(articles.select("document_id"))


@add("SET05_except", "pool shown", "SELECT document_id, concept_id FROM {pool} EXCEPT SELECT document_id, concept_id FROM {shown}")
def _(pool, shown):
    return pool.select("document_id", "concept_id").subtract(shown.select("document_id", "concept_id"))


@add("SET06_scope_widened", "articles", "SELECT document_id, array_to_string(list_sort(list_distinct(list_concat(place_ids, [3, 9]))), ',') AS scope FROM {articles}")
def _(articles):
    return articles.select("document_id", F.array_join(K.widened(F.col("place_ids"), F.array(F.lit(3), F.lit(9))), ",").alias("scope"))


@add("SET07_beyond_baseline", "shown", "SELECT document_id, concept_id FROM {shown} WHERE run_id = 2 EXCEPT SELECT document_id, concept_id FROM {shown} WHERE run_id = 1")
def _(shown):
    key = ["document_id", "concept_id"]
    return shown.where("run_id = 2").select(*key).join(shown.where("run_id = 1").select(*key), key, "left_anti").distinct()


@add("RT04_replace_links", "links", "SELECT concept_id, system, code, linked_run FROM {links} WHERE linked_run IS NULL UNION ALL (SELECT DISTINCT concept_id, system, code, 9 FROM {links} l WHERE linked_run = 2 AND NOT EXISTS (SELECT 1 FROM {links} m WHERE m.linked_run IS NULL AND m.concept_id = l.concept_id AND m.system = l.system AND m.code = l.code))")
def _(links):
    return K.replace_links(links, links.where("linked_run = 2").select("concept_id", "system", "code").distinct(), 9)


_ADAPT = "score >= greatest(0.3, max(score) OVER (PARTITION BY document_id) - 0.25) AND rank <= 5"


@add("WIN02_adaptive_cutoff", "pool", f"SELECT document_id, concept_id, {_ADAPT} AS kept FROM {{pool}}")
def _(pool):
    return R.adaptive(pool, 0.3, 0.25, 5).select("document_id", "concept_id", "kept")


@add("AGG08_kept_histogram", "pool", f"WITH k AS (SELECT document_id, {_ADAPT} AS kept FROM {{pool}}), d AS (SELECT document_id, count_if(kept) AS kept FROM k GROUP BY document_id) SELECT kept, count(*) AS documents FROM d GROUP BY kept")
def _(pool):
    return R.kept_histogram(R.adaptive(pool, 0.3, 0.25, 5))


@add(
    "AGG41_cutoff_report",
    "pool truth",
    f"""WITH k AS (SELECT document_id, concept_id, {_ADAPT} AS kept FROM {{pool}}), d AS (SELECT document_id, count_if(kept) AS kept FROM k GROUP BY document_id),
    s AS (SELECT CAST(sum(kept) AS BIGINT) AS pairs, round(avg(kept), 6) AS per_document, count_if(kept = 0) AS documents_with_none, count(*) AS documents FROM d),
    h AS (SELECT count(*) AS positives, count(k.kept) AS in_pool, count_if(k.kept) AS kept_positives FROM {{truth}} t LEFT JOIN k USING (document_id, concept_id) WHERE t.matched)
    SELECT * FROM s, h""",
)
def _(pool, truth):
    return R.cutoff_report(R.adaptive(pool, 0.3, 0.25, 5), truth)


@add("TOP05_budget", "pool", "SELECT document_id, concept_id FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY score DESC, document_id) AS n FROM {pool} WHERE selected) p WHERE n <= 20")
def _(pool):
    return R.budget(pool.where("selected"), 20, ["concept_id"]).select("document_id", "concept_id")


@add("TOP03_articles_of_class", "pool", "SELECT document_id, score FROM {pool} WHERE concept_id = 7 ORDER BY score DESC, document_id LIMIT 25")
def _(pool):
    """The articles that rank one class highest."""
    return pool.where("concept_id = 7").orderBy(F.desc("score"), "document_id").limit(25).select("document_id", "score")


@add("WIN09_capped_queue", "pool", "SELECT document_id, concept_id FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY score DESC, document_id) > 5 AS o FROM {pool}) p ORDER BY o, score DESC, document_id, concept_id LIMIT 300")
def _(pool):
    """Three hundred candidates, five of each class first."""
    return R.capped(pool, 300, 5, order=(F.desc("score"), F.col("document_id"), F.col("concept_id"))).select("document_id", "concept_id")


@add("WIN10_split_remainder", "orders", "SELECT o_orderkey, p AS position, (1000 + o_orderkey) // 7 + CASE WHEN p = 0 THEN (1000 + o_orderkey) % 7 ELSE 0 END AS share FROM {orders}, (SELECT unnest(range(7)) AS p)")
def _(orders):
    parts = orders.select("o_orderkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("position"))
    return parts.withColumn("share", R.split_remainder(1000 + F.col("o_orderkey"), F.lit(7), F.col("position")))


@add("AGG06_best_score", "pool", "SELECT document_id, max(score) AS best, CASE WHEN max(score) < 0.6 THEN 'low' WHEN max(score) < 0.7 THEN 'middle' ELSE 'high' END AS band FROM {pool} GROUP BY document_id")
def _(pool):
    """With its band (FN18)."""
    from skerry.functions.texts import score_band

    return pool.groupBy("document_id").agg(F.max("score").alias("best")).withColumn("band", score_band(F.col("best")))


_LEAVES = "SELECT label AS concept_id, min(vec_id) AS vec_id FROM {embeddings} GROUP BY label"
_SCORED = f"""WITH l AS ({_LEAVES}), s AS (SELECT d.vec_id AS document_id, d.label AS own, l.concept_id,
      round(list_dot_product(d.embedding::DOUBLE[], x.embedding::DOUBLE[]) / (sqrt(list_dot_product(d.embedding::DOUBLE[], d.embedding::DOUBLE[])) * sqrt(list_dot_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[]))), 6) AS score
      FROM {{embeddings}} d, l JOIN {{embeddings}} x ON x.vec_id = l.vec_id WHERE d.vec_id NOT IN (SELECT vec_id FROM l)),
    r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, concept_id) AS rank FROM s),
    k AS (SELECT *, score >= greatest(0.2, max(score) OVER (PARTITION BY document_id) - 0.1) AND rank <= 3 AS kept FROM r)"""


def _vectors(embeddings):
    leaf = embeddings.groupBy(F.col("label").alias("concept_id")).agg(F.min_by("embedding", "vec_id").alias("leaf_vector"), F.min("vec_id").alias("vec_id"))
    documents = embeddings.join(leaf.select("vec_id"), "vec_id", "left_anti").select(F.col("vec_id").alias("document_id"), F.col("label").alias("own"), F.col("embedding").alias("vector"))
    return documents, leaf.select("concept_id", "leaf_vector")


@add("WIN01_pool", "embeddings", _SCORED + " SELECT document_id, concept_id, score, CAST(rank AS INT) AS rank FROM k WHERE rank <= 5")
def _(embeddings):
    documents, leaves = _vectors(embeddings)
    return R.pool(documents.drop("own"), leaves, 5)


@add(
    "flagship",
    "embeddings",
    _SCORED
    + """, c AS (SELECT count_if(kept AND own = concept_id) AS tp, count_if(kept AND own <> concept_id) AS fp, count_if(NOT kept AND own <> concept_id) AS tn, count_if(NOT kept AND own = concept_id) AS fn FROM k)
    SELECT tp, fp, tn, fn, tp + fp + tn + fn AS n, round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 6) AS precision, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6) AS recall,
      round(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(CAST(tp + tn AS DOUBLE) / nullif(tp + fp + tn + fn, 0), 6) AS accuracy FROM c""",
)
def _(embeddings):
    """Nearest classes of each vector, cut adaptively and scored against its own class."""
    from skerry.operators import metrics as M

    documents, leaves = _vectors(embeddings)
    ranked = R.adaptive(R.pool(documents.drop("own"), leaves, 100), 0.2, 0.1, 3).join(documents.select("document_id", "own"), "document_id")
    return M.confusion(ranked.withColumn("expected", F.col("own") == F.col("concept_id")), "expected", "kept")


@add(
    "JN27_near_concepts",
    "embeddings",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM {embeddings})
    SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS score
    FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) >= 0.45""",
)
def _(embeddings):
    return R.near_pairs(embeddings.select(F.col("vec_id").alias("concept_id"), F.col("embedding").alias("vector")), 0.45)


@add("WIN03_latest", "verdicts", "SELECT document_id, concept_id, max(run_id) AS run_id FROM {verdicts} GROUP BY document_id, concept_id")
def _(verdicts):
    return R.latest(verdicts.select("document_id", "concept_id", "run_id", "matched"), ["document_id", "concept_id"], "run_id").select("document_id", "concept_id", "run_id")

"""Judge modes, routing, events and trials with the stand-in providers, which answer by hashes that SQL can work out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.catalog.matching_queries import _SCORED, _vectors
from skerry.catalog.roles import Catalog
from skerry.functions import prompts as P
from skerry.operators import judging, strategies
from skerry.operators import matching as K
from skerry.operators import metrics as M
from skerry.operators.providers import HashChat, HashEmbedder, embedded

catalog = Catalog()
add = catalog.add
PAIR = M.PAIR

_SUBJECT = "CASE WHEN length(body) > 0 THEN 'Article: ' || body ELSE '' END"
_NL = "chr(10)"


def _byte(text: str, at: int) -> str:
    return f"('0x' || substr(sha256({text}), {2 * at + 1}, 2))::INT"


def _yes(subject: str, number: str) -> str:
    return f"({_byte(f'{subject} || chr(35) || {number}', 0)} < 96)"


def _sure(subject: str) -> str:
    return f"round({_byte(subject, 1)} / 255, 3)"


def _prompt(name: str, meaning: str) -> str:
    return f"{_SUBJECT} || {_NL} || {_NL} || 'Class: ' || {name} || {_NL} || 'Meaning: ' || {meaning} || {_NL} || {_NL} || '{P.PAIRED}' || {_NL} || {_NL} || '{P.VERDICT}'"


_ASKED = f"SELECT p.document_id, p.concept_id, p.score, {_prompt(chr(39) + 'c' + chr(39) + ' || concept_id', chr(39) + 'd' + chr(39))} AS prompt FROM {{pool}} p JOIN {{articles}} a USING (document_id) WHERE p.selected"


def _named(concepts: DataFrame) -> DataFrame:
    return concepts.select("concept_id", F.concat(F.lit("c"), F.col("concept_id").cast("string")).alias("name"), F.lit("d").alias("definition"))


def _selected(pool: DataFrame, articles: DataFrame) -> DataFrame:
    return pool.where("selected").join(articles.select("document_id"), "document_id", "left_semi").select(*PAIR, "score")


@add(
    "JD02_sampled_votes",
    "pool articles concepts",
    f"""SELECT document_id, concept_id, count_if(yes) * 2 > 3 AS matched, round(greatest(count_if(yes), 3 - count_if(yes)) / 3, 6) AS confidence, CAST(NULL AS VARCHAR) AS error FROM (
      SELECT document_id, concept_id, {_byte("CASE WHEN i = 1 THEN prompt ELSE prompt || chr(10) || 'Sample ' || i END", 0)} < 96 AS yes FROM ({_ASKED}) q, range(1, 4) r(i)) v GROUP BY document_id, concept_id""",
)
def _(pool, articles, concepts):
    """Three samples of a stand-in provider that answers by hash, and their majority."""
    pairs = _selected(pool, articles)
    return judging.judged("pair", pairs, articles, _named(concepts), pairs.where("false"), HashChat(), samples=3)


@add(
    "JD01_best_first",
    "pool articles concepts",
    f"""SELECT document_id, concept_id, {_byte("prompt", 0)} < 96 AS matched, {_sure("prompt")} AS confidence, CAST(NULL AS VARCHAR) AS error
      FROM (SELECT * FROM ({_ASKED}) q WHERE concept_id % 3 <> 0 ORDER BY score DESC, document_id, concept_id LIMIT 60) t""",
)
def _(pool, articles, concepts):
    """The sixty best pairs without a verdict; the limit is the feature."""
    pairs = _selected(pool, articles)
    return judging.judged("pair", pairs, articles, _named(concepts), pairs.where("concept_id % 3 = 0"), HashChat(), limit=60, by_score=True)


@add(
    "JD02_judged_pairs",
    "articles links",
    f"""SELECT document_id, concept_id, {_byte("prompt", 0)} < 96 AS matched, {_sure("prompt")} AS confidence, CAST(NULL AS VARCHAR) AS error FROM (
      SELECT DISTINCT document_id, concept_id, {_prompt("'class ' || concept_id", "'an event of this class'")} AS prompt
      FROM (SELECT document_id, body, unnest(themes) AS theme FROM {{articles}}) a JOIN {{links}} l ON l.system = 'theme' AND l.code = a.theme WHERE body IS NOT NULL) q
    UNION ALL SELECT DISTINCT document_id, concept_id, NULL, NULL, 'no body' FROM (SELECT document_id, body, unnest(themes) AS theme FROM {{articles}}) a JOIN {{links}} l ON l.system = 'theme' AND l.code = a.theme WHERE body IS NULL""",
)
def _(articles, links):
    """Verdicts of the stand-in model on each article and class that a theme links."""
    concepts = links.select("concept_id").distinct().select("concept_id", F.concat(F.lit("class "), F.col("concept_id").cast("string")).alias("name"), F.lit("an event of this class").alias("definition"))
    pairs = K.matched_articles(articles, links).select(*PAIR).distinct()
    return judging.judge(pairs, articles, concepts, pairs.where("document_id < 0"), HashChat())


@add(
    "JD03_batched_replies",
    "pool articles concepts",
    f"""SELECT p.document_id, p.concept_id, CASE WHEN body IS NOT NULL THEN {_yes(f"({_SUBJECT})", "p.concept_id")} END AS matched, CASE WHEN body IS NOT NULL THEN {_sure(f"({_SUBJECT})")} END AS confidence,
      CASE WHEN body IS NULL THEN 'no body' END AS error FROM {{pool}} p LEFT JOIN {{articles}} a USING (document_id) WHERE p.selected""",
)
def _(pool, articles, concepts):
    """One call a document about all classes that it is shown."""
    return judging.judged("batch", pool.where("selected").select(*PAIR), articles, _named(concepts), pool.where("false"), HashChat())


_DOWN = f"""WITH a AS (SELECT document_id, body, {_SUBJECT} AS s FROM (SELECT DISTINCT document_id FROM {{pool}} WHERE selected) p LEFT JOIN {{articles}} USING (document_id)),
    top AS (SELECT DISTINCT parent AS c FROM {{edges}} WHERE parent NOT IN (SELECT child FROM {{edges}})),"""
_NO_BODY = "SELECT document_id, c AS concept_id, CAST(NULL AS BOOLEAN) AS matched, CAST(NULL AS DOUBLE) AS confidence, 'no body' AS error FROM a, top WHERE body IS NULL"


@add(
    "JD04_hierarchical",
    "pool articles concepts edges",
    f"""{_DOWN}
    l1 AS (SELECT document_id, s, c, {_yes("s", "c")} AS m FROM a, top WHERE body IS NOT NULL),
    l2 AS (SELECT document_id, s, c, {_yes("s", "c")} AS m FROM (SELECT DISTINCT document_id, s, child AS c FROM l1 JOIN {{edges}} ON parent = c WHERE m) x),
    l3 AS (SELECT document_id, s, c, {_yes("s", "c")} AS m FROM (SELECT DISTINCT document_id, s, child AS c FROM l2 JOIN {{edges}} ON parent = c WHERE m) x)
    SELECT document_id, c AS concept_id, m AS matched, {_sure("s")} AS confidence, CAST(NULL AS VARCHAR) AS error FROM (FROM l1 UNION ALL FROM l2 UNION ALL FROM l3) l UNION ALL {_NO_BODY}""",
)
def _(pool, articles, concepts, edges):
    """The parents' routing answers and the decisions on the leaves that they lead to."""
    return judging.judged("hierarchical", pool.where("selected"), articles, _named(concepts), pool.where("false"), HashChat(), edges=edges)


_EVENTS = f"""{_DOWN}
    ev AS (SELECT document_id, ordinal, what, 'Event: ' || what || chr(10) || 'Status: occurred' || chr(10) || 'Country: US' AS s FROM (
      SELECT document_id, i AS ordinal, 'event ' || i || ' of ' || substr(sha256(s), 1, 8) AS what FROM a, range(4) r(i) WHERE body IS NOT NULL AND i < {_byte("s", 0)} % 4) e),
    r1 AS (SELECT document_id, ordinal, s, c, {_yes("s", "c")} AS m FROM ev, top),
    r2 AS (SELECT document_id, ordinal, s, c, {_yes("s", "c")} AS m FROM (SELECT DISTINCT document_id, ordinal, s, child AS c FROM r1 JOIN {{edges}} ON parent = c WHERE m) x),
    r3 AS (SELECT DISTINCT document_id, ordinal, s, child AS c FROM r2 JOIN {{edges}} ON parent = c WHERE m),
    ch AS (SELECT document_id, ordinal, min(CASE WHEN {_yes("s", "c")} THEN c END) AS concept_id, {_sure("any_value(s)")} AS confidence FROM r3 GROUP BY document_id, ordinal)"""


@add(
    "JD05_assigned_events",
    "pool articles concepts edges",
    f"""{_EVENTS}
    SELECT document_id, CAST(ordinal AS INT) AS ordinal, what, ch.concept_id AS concept_id, confidence, coalesce(t, '') AS routed_through,
      CASE WHEN confidence IS NULL THEN 'rejected' WHEN ch.concept_id IS NULL THEN 'unclassified' ELSE 'classified' END AS outcome, CAST(NULL AS VARCHAR) AS error
    FROM ev LEFT JOIN ch USING (document_id, ordinal) LEFT JOIN (SELECT document_id, ordinal, string_agg(c, ',' ORDER BY c) AS t FROM (FROM r1 UNION ALL FROM r2) x WHERE m GROUP BY document_id, ordinal) t USING (document_id, ordinal)""",
)
def _(pool, articles, concepts, edges):
    """Each event of each article with the one leaf it was given, if any, and how it ended."""
    _, events = judging.assigned_events(pool.where("selected"), articles, _named(concepts), HashChat(), edges)
    return events.select("document_id", "ordinal", "what", "concept_id", "confidence", F.array_join("routed_through", ",").alias("routed_through"), "outcome", "error")


@add(
    "JD05_by_events",
    "pool articles concepts edges",
    f"""{_EVENTS}
    SELECT document_id, c AS concept_id, bool_or(m) AS matched, CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR) AS error FROM (FROM r1 UNION ALL FROM r2) x GROUP BY document_id, c
    UNION ALL SELECT r3.document_id, c, coalesce(bool_or(ch.concept_id = c), false), max(CASE WHEN ch.concept_id = c THEN confidence END), NULL FROM r3 JOIN ch USING (document_id, ordinal) GROUP BY r3.document_id, c
    UNION ALL SELECT document_id, c, false, NULL, NULL FROM a, top WHERE body IS NOT NULL AND document_id NOT IN (SELECT document_id FROM ev)
    UNION ALL {_NO_BODY}""",
)
def _(pool, articles, concepts, edges):
    """Verdicts that follow from an article's events."""
    return judging.judged("extract", pool.where("selected"), articles, _named(concepts), pool.where("false"), HashChat(), edges=edges)


@add(
    "JD08_trial",
    "articles",
    f"""SELECT document_id, concept_id, {_byte("prompt", 0)} < 96 AS matched, {_sure("prompt")} AS confidence, CAST(NULL AS VARCHAR) AS error
      FROM (SELECT document_id, 1 AS concept_id, {_prompt("'strike'", "'a stop of work'")} AS prompt FROM {{articles}} WHERE body IS NOT NULL) t UNION ALL SELECT document_id, 1, NULL, NULL, 'no body' FROM {{articles}} WHERE body IS NULL""",
)
def _(articles):
    """One class tried on all articles before it is in the hierarchy."""
    concepts = articles.sparkSession.createDataFrame([(1, "strike", "a stop of work")], "concept_id int, name string, definition string")
    return judging.trial(articles.select("document_id", F.lit(1).alias("concept_id")), articles, concepts, HashChat())


@add("JD06_judged_without_body", "pool articles concepts", "SELECT document_id, concept_id, error FROM (SELECT document_id, concept_id, 'no body' AS error FROM {pool} WHERE selected AND document_id NOT IN (SELECT document_id FROM {articles} WHERE body IS NOT NULL))")
def _(pool, articles, concepts):
    """Pairs of documents without a body stay in the count as errors."""
    said = judging.judge(pool.where("selected"), articles, _named(concepts), pool.where("false"), HashChat())
    return said.where("error IS NOT NULL").select(*PAIR, "error")


@add(
    "RT08_routed",
    "articles concepts edges",
    f"""WITH a AS (SELECT document_id, {_SUBJECT} AS s FROM {{articles}}), top AS (SELECT DISTINCT parent AS c FROM {{edges}} WHERE parent NOT IN (SELECT child FROM {{edges}})),
    l1 AS (SELECT document_id, s, c, {_yes("s", "c")} AS m FROM a, top),
    l2 AS (SELECT document_id, s, c, {_yes("s", "c")} AS m FROM (SELECT DISTINCT document_id, s, child AS c FROM l1 JOIN {{edges}} ON parent = c WHERE m) x)
    SELECT DISTINCT document_id, child AS concept_id FROM l2 JOIN {{edges}} ON parent = c WHERE m""",
)
def _(articles, concepts, edges):
    """Leaves reached by routing."""
    return strategies.routed(articles, _named(concepts), edges, HashChat())[0]


@add("RT09_ranked_events", "articles concepts edges embeddings")
def _(articles, concepts, edges, embeddings):
    """The leaves nearest to each event, of those that its routing at the top allows; tests compare with a reading by hand."""
    documents = articles.where("body IS NOT NULL").select("document_id", judging.article_text(articles).alias("article"))
    events, _ = judging.extracted_events(documents, _named(concepts), edges, HashChat())
    passed, reached, _ = judging.routed_events(events, _named(concepts), edges, HashChat())
    leaves = embedded(_named(concepts), HashEmbedder(), "name").select("concept_id", F.col("vector").alias("leaf_vector"))
    return strategies.ranked_events(events, passed, reached.where("false"), edges, leaves, HashEmbedder())


@add("SRC31_embedded", "benchmark")
def _(benchmark):
    """Vectors of the stand-in embedder; tests hold them against its bytes."""
    return embedded(benchmark, HashEmbedder()).select("item_id", "vector", "embed_error")


@add("RT06_ranked_text", "benchmark")
def _(benchmark):
    """Items as leaves, ranked for a pasted text."""
    leaves = embedded(benchmark, HashEmbedder()).select(F.col("item_id").cast("int").alias("concept_id"), F.col("vector").alias("leaf_vector"))
    return strategies.rank_text(benchmark.sparkSession, "a text from the clipboard", leaves, HashEmbedder())


@add(
    "RT02_pool_with_flag",
    "embeddings",
    _SCORED + " SELECT document_id, concept_id, score, CAST(rank AS INT) AS rank, score >= greatest(0.25, max(score) OVER (PARTITION BY document_id) - 0.1) AND rank <= 15 AS selected FROM r WHERE rank <= 20",
)
def _(embeddings):
    documents, leaves = _vectors(embeddings)
    return strategies.build_pool(documents.drop("own"), leaves)



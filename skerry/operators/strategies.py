"""Which classes a document's judge is shown: flat, by routing, or by extracted events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.operators import hierarchy, ranking
from skerry.operators.judging import article_text, routing
from skerry.operators.metrics import PAIR
from skerry.operators.providers import ChatProvider, EmbeddingProvider, embedded


def build_pool(documents: DataFrame, leaves: DataFrame, size: int = 20, min_score: float = 0.25, margin: float = 0.1, max_k: int = 15) -> DataFrame:
    """The whole pool with its ``selected`` flag (RT02)."""
    return ranking.adaptive(ranking.pool(documents, leaves, size), min_score, margin, max_k).withColumnRenamed("kept", "selected")


def flat(pool: DataFrame) -> DataFrame:
    """What the cutoff kept (RT07); (document_id, concept_id)."""
    return pool.where("selected").select(*PAIR)


def routed(articles: DataFrame, concepts: DataFrame, edges: DataFrame, provider: ChatProvider, log: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(offered leaves, parents' answers): sibling sets are asked top down, children only of classes answered yes (RT08)."""
    documents = articles.select("document_id", article_text(articles).alias("article"))
    answers, offers = routing(documents, concepts, edges, provider, log)
    return offers.select(*PAIR), answers


def ranked_events(events: DataFrame, passed: DataFrame, reached: DataFrame, edges: DataFrame, leaves: DataFrame, embedder: EmbeddingProvider, k: int = 5) -> DataFrame:
    """The ``k`` leaves nearest to each event, of those it reached and those under the parents it was answered yes for (RT09, TOP09).

    ``leaves``: concept_id, leaf_vector.  In place of routing below the top.
    """
    key = ["document_id", "ordinal"]
    under = hierarchy.closure(edges).select(F.col("concept_id").alias("leaf"), F.col("ancestor").alias("concept_id"))
    below = passed.where("matched").join(under, "concept_id").select(*key, F.col("leaf").alias("concept_id"))
    allowed = below.unionByName(reached.select(*key, "concept_id")).distinct().join(leaves, "concept_id")
    vectors = embedded(events.select(*key, F.col("event.what").alias("what")), embedder, "what").select(*key, "vector")
    scored = allowed.join(vectors, key).select(*key, "concept_id", F.round(ranking.cosine(F.col("vector"), F.col("leaf_vector")), 6).alias("score"))
    return ranking.budget(scored, k, key, ties=("concept_id",))


def rank_text(spark, text: str, leaves: DataFrame, embedder: EmbeddingProvider, size: int = 20) -> DataFrame:
    """The nearest leaves of a pasted text, nothing stored (RT06, RT12)."""
    one = embedded(spark.createDataFrame([(0, text)], "document_id long, text string"), embedder).select("document_id", "vector")
    return ranking.pool(one, leaves, size).drop("document_id")


def copied(rows: DataFrame, target: DataFrame, run: int, key: list[str] = PAIR) -> DataFrame:
    """Another run's rows that the run ``run`` lacks, under its id (JN28, JN29, OT11)."""
    have = target.where(F.col("run_id") == run).select(*key)
    return rows.join(have, key, "left_anti").withColumn("run_id", F.lit(run))

"""A corpus pipeline of five stages, each a DataFrame of documents to a DataFrame.

Between stages the documents are written as Parquet to the shared folder and read
again.  All stages but the last keep the columns of ``documents``; the last gives
the token ids of what is left.  No stage adds a name that could clash with a column.
An empty table goes through all stages and stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm import bpe, decontam, jaccard, pii, quality
from skerry.llm.queries import PII_KEY, table
from skerry.plans.cuts import cut
from skerry.plans.shipping import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects; null and empty texts have too few words, equal rows go the same way."""
    return quality.keep_good(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.

    The smallest id stays.  Rows without words or without an id are in no group and stay;
    rows with equal ids are one document and stay or go together.
    """
    ship(spark)
    return jaccard.one_of_each(docs, width=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window like a benchmark item; null and empty texts have none, equal rows go the same way."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms of the same format; an address may change its length.

    All rows stay; null texts stay null and empty ones empty.
    """
    new = pii.pseudonymize(docs, PII_KEY)
    return new.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else new


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with digests of them and of the text decoded from them; a row for each row, null texts as empty ones."""
    ship(spark)
    return bpe.round_trip(docs, keep=("doc_id", "lang", "source"), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", pii_pseudonyms),
    ("BPE encoding and decoding", bpe_encoding),
]

#: Near copies and SimHash windows are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs

"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm import bpe, caps, chat, decontam, fim, jaccard, pii, quality, sharding, spans, tokencount, variants, warc
from skerry.plans.shipping import ship

TOKEN_LIMIT = 1024
SHARDS = 24
#: A key for tests; production jobs pass their own.
PII_KEY = "key of the example queries"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokencount.count_tokens(table(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.through_archives(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = spans.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_sentences", "n_removed", "text")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts hold control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], rows.schema)
    return chat.digest(chat.format_conversations(rows.unionByName(extra)))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `rows`: counts at most one apart."""
    dealt = sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.pseudonymize(docs, PII_KEY).select("doc_id", "text")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.transform(table(spark, sf_dir, "documents")))


def op12_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_decontamination, op2_token_counts, op3_ngram_jaccard, op4_sentence_spans, op5_chat_format, op6_sharding, op7_warc, op8_bpe_round_trip, op9_quality_rules, op10_pii, op11_fill_in_middle, op12_embedding_near_duplicates, op13_spelling_variants)
}

ORACLE_SQL: dict[str, str] = {"op4_sentence_spans": spans.SQL, "op5_chat_format": chat.SQL, "op7_warc": warc.SQL, "op9_quality_rules": quality.SQL, "op11_fill_in_middle": fim.SQL}

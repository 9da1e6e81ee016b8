"""CSV and JSON exchange of calendars, labels, run metrics and ontologies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions.texts import parsed_boolean

CALENDAR = "id string, kind string, concept string, country_iso3 string, date string, end_date string, precursor_of string, description string, sources string, notes string"
LABELS = "document_url string, concept string, matched string, source string, locus_iso3 string, occurred_on string, note string"
KINDS = ("event", "precursor", "control")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False, multiLine=True, escape='"')


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Calendar entries, refused as a whole if any is wrong (SRC14)."""
    raw = read_csv(spark, path, CALENDAR)
    rows = raw.select(
        F.trim("id").alias("id"),
        F.trim("kind").alias("kind"),
        F.trim("concept").alias("concept"),
        F.array_remove(F.split(F.regexp_replace("country_iso3", r"\s", ""), r"\|"), "").alias("countries"),
        F.try_to_date("date", "yyyy-MM-dd").alias("starts_on"),
        F.try_to_date("end_date", "yyyy-MM-dd").alias("ends_on"),
        F.nullif(F.trim("precursor_of"), F.lit("")).alias("precursor_of"),
        "description",
    )
    faults = rows.agg(
        F.count_if(F.coalesce("id", F.lit("")) == "").alias("without id"),
        F.count_if(~F.coalesce("kind", F.lit("")).isin(*KINDS)).alias("unknown kind"),
        F.count_if(F.col("starts_on").isNull()).alias("bad date"),
        F.count_if(F.coalesce(F.size("countries"), F.lit(0)) <= 0).alias("no country"),
        (F.count("id") - F.countDistinct("id")).alias("repeated id"),
    ).first()
    wrong = [f"{n} {what}" for what, n in faults.asDict().items() if n]
    dangling = rows.where("precursor_of IS NOT NULL").join(rows.select(F.col("id").alias("precursor_of")), "precursor_of", "left_anti")
    if not dangling.isEmpty():
        wrong.append("a precursor of no entry")
    if wrong:
        raise ValueError(f"the calendar is refused: {', '.join(wrong)}")
    return rows


def import_labels(rows: DataFrame, documents: DataFrame, concepts: DataFrame, existing: DataFrame, overwrite: bool = False) -> dict[str, DataFrame]:
    """``labels`` to write, ``stubs`` for unknown documents, ``unknown`` concepts (SRC15).

    ``rows`` as LABELS; documents (document_id, url), concepts (concept_id, concept).
    Labels of unknown documents keep the address and a null id.
    """
    cells = rows.select(F.trim("document_url").alias("url"), F.trim("concept").alias("concept"), parsed_boolean(F.col("matched")).alias("matched"), "source")
    cells = cells.where("url <> '' AND matched IS NOT NULL").dropDuplicates(["url", "concept"])
    unknown = cells.join(concepts, "concept", "left_anti").select("concept").distinct()
    known = cells.join(concepts, "concept").join(documents, "url", "left")
    fresh = known if overwrite else known.join(existing.select("document_id", "concept_id"), ["document_id", "concept_id"], "left_anti")
    stubs = known.where("document_id IS NULL").select("url").distinct()
    return {"labels": fresh.select("document_id", "url", "concept_id", "matched", "source"), "stubs": stubs, "unknown": unknown}


def whole_document_labels(sheet: DataFrame, leaves: DataFrame) -> DataFrame:
    """Every leaf of each filled row: true if listed, false if not (SRC17).

    ``sheet``: document_id, concepts (names by ``;`` or ``none``; blank rows are skipped).
    A row that names an unknown class is refused as a whole.  Leaves are a dimension.
    """
    filled = sheet.where(F.trim(F.coalesce("concepts", F.lit(""))) != "")
    listed = filled.select(
        "document_id", F.when(F.lower(F.trim("concepts")) == "none", F.array().cast("array<string>")).otherwise(F.transform(F.split("concepts", ";"), lambda name: F.trim(name))).alias("names")
    ).withColumn("names", F.array_remove("names", ""))
    named = listed.select("document_id", F.explode("names").alias("concept"))
    refused = named.join(leaves, "concept", "left_anti").select("document_id").distinct()
    good = listed.join(refused, "document_id", "left_anti")
    return good.crossJoin(F.broadcast(leaves)).select("document_id", "concept_id", F.array_contains("names", F.col("concept")).alias("matched"))


def write_csv(rows: DataFrame, path: str) -> None:
    """With a header, one file for each partition (SRC26)."""
    rows.write.mode("overwrite").csv(path, header=True, escape='"')


def write_run_metrics(rows: DataFrame, path: str) -> None:
    """Replace the partitions of the runs in ``rows`` (SRC25)."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def leaderboard(spark: SparkSession, path: str) -> DataFrame:
    """Best F1 first, unscored runs last (TOP04)."""
    return spark.read.parquet(path).orderBy(F.desc_nulls_last("f1"), F.desc("n_labels"), "run_id")


ONTOLOGY = "version int, name string, concepts array<struct<name:string,definition:string,inclusion:string,exclusion:string>>, relations array<struct<child:string,parent:string,predicate:string>>"


def read_ontology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Concepts and relations of exported ontologies; relations are absent in version 1 (SRC21)."""
    whole = spark.read.json(path, schema=ONTOLOGY, multiLine=True)
    return whole.select(F.inline("concepts")), whole.select(F.inline_outer("relations")).where("child IS NOT NULL")


def upserted(existing: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both, the new one where a key is in both (SRC18, BK01)."""
    return existing.join(rows.select(*key), key, "left_anti").unionByName(rows.dropDuplicates(key))


def write_manifest(order: DataFrame, path: str, **about: str) -> None:
    """A frozen order with what it was drawn from, as JSON lines (SRC24)."""
    rows = order.select("position", *(c for c in order.columns if c != "position"))
    rows.withColumns({k: F.lit(v) for k, v in about.items()}).write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema)


def import_observations(rows: DataFrame, concepts: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, rows that name an unknown class or place) (SRC16); a blank place is any place.

    ``rows``: concept, locus_iso3, occurred_on as text; places: place_id, iso3.
    """
    cells = rows.select(F.trim("concept").alias("concept"), F.nullif(F.upper(F.trim("locus_iso3")), F.lit("")).alias("iso3"), F.try_to_date("occurred_on", "yyyy-MM-dd").alias("occurred_on"))
    named = cells.join(concepts, "concept", "left").join(places, "iso3", "left")
    bad = F.col("concept_id").isNull() | (F.col("iso3").isNotNull() & F.col("place_id").isNull())
    return named.where(~bad).select("concept_id", "place_id", "occurred_on").distinct(), named.where(bad).select("concept", "iso3")


def seeded_places(existing: DataFrame, rows: DataFrame, corrections: dict[str, str]) -> DataFrame:
    """Places to add (SRC09): feed codes corrected where the feed's differ from the standard's; running it again adds none.

    ``rows``: iso2, iso3, name.
    """
    fixed = F.col("iso2")
    for iso2, fips in corrections.items():
        fixed = F.when(F.col("iso2") == iso2, fips).otherwise(fixed)
    return rows.withColumn("fips", fixed).dropDuplicates(["iso3"]).join(existing.select("iso3"), "iso3", "left_anti")

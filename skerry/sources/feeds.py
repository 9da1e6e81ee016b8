"""Feed slices: zipped tab-separated files, without quoting.

Archives are read with Spark's binary reader, so any store that Spark reaches will
do; each is inflated by lines in an Arrow batch function.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.operators.matching import tier_code

#: Columns of the event export and the article feed, counted from 0.
EXPORT_WIDTH = 61
EXPORT = {"event_id": 0, "day": 1, "event_code": 26, "base_code": 27, "root_code": 28, "country": 53, "url": 60}
ARTICLE_WIDTH = 11
ARTICLE = {"record_id": 0, "date": 1, "collection": 2, "url": 4, "themes": 7, "themes_v2": 8, "locations": 9, "locations_v2": 10}
WEB = "1"


def zipped_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) of the first member of each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    members = archive.namelist()
                    if not members:
                        continue
                    with archive.open(members[0]) as raw:
                        lines: list[str] = []
                        for line in io.TextIOWrapper(raw, encoding="utf-8", errors="replace", newline="\n"):
                            lines.append(line.rstrip("\r\n"))
                            if len(lines) == 4096:
                                yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines)), pa.array(lines)], names=["path", "line"])
                                lines = []
                        if lines:
                            yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines)), pa.array(lines)], names=["path", "line"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, line string")


def _columns(line: Column, width: int, wanted: dict[str, int]) -> tuple[Column, dict[str, Column]]:
    fields = F.split(line, "\t")
    return F.size(fields) >= width, {name: F.trim(F.get(fields, i)) for name, i in wanted.items()}


def export_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """Events of an export; short lines and such without an address are dropped (SRC01)."""
    enough, named = _columns(F.col(line), EXPORT_WIDTH, EXPORT)
    rows = lines.where(enough).select(*(c.alias(n) for n, c in named.items())).where("url <> ''")
    return rows.withColumn("event_code", F.when(F.col("event_code") != F.col("base_code"), F.col("event_code")).otherwise("")).withColumn("code", tier_code())


def location_countries(field: Column) -> Column:
    """Country codes of a location field: the third part of each place (SRC03)."""
    codes = F.transform(F.split(field, ";"), lambda place: F.get(F.split(place, "#"), F.lit(2)))
    return F.array_sort(F.array_distinct(F.filter(codes, lambda c: c.isNotNull() & (c != ""))))


def theme_names(v1: Column, v2: Column) -> Column:
    """Themes of the first form, else of the second without its offsets (SRC04)."""
    plain = F.split(v1, ";")
    cut = F.transform(F.split(v2, ";"), lambda t: F.substring_index(t, ",", 1))
    return F.array_sort(F.array_distinct(F.array_remove(F.when(v1 != "", plain).otherwise(cut), "")))


def article_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """Web articles of an article slice (SRC02)."""
    enough, named = _columns(F.col(line), ARTICLE_WIDTH, ARTICLE)
    rows = lines.where(enough).select(*(c.alias(n) for n, c in named.items())).where((F.col("collection") == WEB) & (F.col("url") != ""))
    first = location_countries(F.col("locations"))
    countries = F.when(F.size(first) > 0, first).otherwise(location_countries(F.col("locations_v2")))
    return rows.select("record_id", "date", "url", theme_names(F.col("themes"), F.col("themes_v2")).alias("themes"), countries.alias("countries"))


def code_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Codes of two to four digits with their names; leading zeros stay (SRC07)."""
    rows = spark.read.csv(path, sep="\t", schema="code string, name string", quote="")
    return rows.where(F.col("code").rlike("^[0-9]{2,4}$")).select("code", F.trim("name").alias("name"))


def theme_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Themes with their use counts; rows without a number are skipped (SRC08)."""
    rows = spark.read.csv(path, sep="\t", schema="theme string, uses string", quote="")
    return rows.select("theme", F.expr("try_cast(uses AS bigint)").alias("uses")).where("uses IS NOT NULL AND theme IS NOT NULL")


def insert_absent(existing: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows to append: one for each key that isn't there yet (SRC29, SRC30)."""
    return rows.dropDuplicates(key).join(existing.select(*key), key, "left_anti")

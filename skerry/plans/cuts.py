"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or, where it is unset (tests on one machine), a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = spark.sparkContext.applicationId
    if own not in _FOLDERS:
        _FOLDERS[own] = f"file://{tempfile.mkdtemp(prefix='skerry-')}"
    return _FOLDERS[own]


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared folder as Parquet, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)

"""Runs as folders of tables: results are found by their key, written once, read by later runs."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.plans.runs import normalised, stable_hash, stage_keys


class Manifest:
    """A small JSON file that is written once: of several writers, the first one wins.

    The file is created with ``overwrite`` off on the path's own file system, which is atomic on HDFS and the like.
    A writer that died between creating and filling it leaves it empty: an empty file counts as none, and is taken away after STALE seconds.
    """

    STALE = 60.0

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.system = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def read(self) -> dict | None:
        from py4j.protocol import Py4JJavaError

        try:
            stream = self.system.open(self.path)
        except Py4JJavaError as e:
            if "FileNotFoundException" in str(e.java_exception):
                return None
            raise
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:
            return None

    def put(self, content: dict) -> bool:
        """Whether this writer was the first."""
        from py4j.protocol import Py4JJavaError

        while True:
            try:
                stream = self.system.create(self.path, False)
            except Py4JJavaError as e:
                if "FileAlreadyExistsException" not in str(e.java_exception) and "already exists" not in str(e.java_exception):
                    raise
                if self.read() is not None:
                    return False
                if time.time() - self.system.getFileStatus(self.path).getModificationTime() / 1000 > self.STALE:
                    self.system.delete(self.path, False)
                time.sleep(0.2)
                continue
            stream.write(bytearray(json.dumps(content).encode()))
            stream.close()
            return True


def reused(spark: SparkSession, root: str, stage: str, key: str, make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The stage's table under its key, made only if it isn't there (RN03); and whether it was there.

    Each maker writes to a folder of its own and then publishes it by the key's manifest.  If another one was first, its table
    is taken and the own one dropped; a table that was published is never written again, so its readers keep it.
    """
    manifest = Manifest(spark, f"{root}/{stage}/{key}.json")
    if (there := manifest.read()) is not None:
        return spark.read.parquet(f"{root}/{stage}/{there['data']}"), True
    own = f"{key}-{uuid.uuid4().hex}"
    make().write.parquet(f"{root}/{stage}/{own}")
    if manifest.put({"data": own}):
        return spark.read.parquet(f"{root}/{stage}/{own}"), False
    mine = manifest.jvm.org.apache.hadoop.fs.Path(f"{root}/{stage}/{own}")
    manifest.system.delete(mine, True)
    return spark.read.parquet(f"{root}/{stage}/{manifest.read()['data']}"), True


def _offered(config: dict, pool: DataFrame) -> DataFrame:
    """What the cutoff kept, where the pool says so."""
    return pool.where("selected") if "selected" in pool.columns else pool


def execute(
    spark: SparkSession, root: str, config: dict, candidates: Callable[[dict], DataFrame], judge: Callable[[dict, DataFrame], DataFrame],
    retrieval: Callable[[dict, DataFrame], DataFrame] = _offered,
) -> dict:
    """A run's stages in order, candidates, retrieval and judge, each reused by key; a failure is recorded with its stage and raised (RN04)."""
    full, keys = normalised(config), stage_keys(config)
    record = {"keys": keys, "reused": {}, "error": None, "stage": "candidates"}
    try:
        pool, record["reused"]["candidates"] = reused(spark, root, "candidates", keys["candidates"], lambda: candidates(full))
        record["stage"] = "retrieval"
        offers, record["reused"]["retrieval"] = reused(spark, root, "retrieval", keys["retrieval"], lambda: retrieval(full, pool))
        record["stage"] = "judge"
        verdicts, record["reused"]["judge"] = reused(spark, root, "judge", keys["judge"], lambda: judge(full, offers))
        record["verdicts"], record["stage"] = verdicts, None
    except BaseException as e:
        record["error"] = "interrupted" if isinstance(e, KeyboardInterrupt) else f"{type(e).__name__}: {e}"[:1000]
        raise
    finally:
        row = (keys["judge"], stable_hash(full), record["stage"], record["error"])
        spark.createDataFrame([row], "run_key string, config string, stage string, error string").write.mode("append").parquet(f"{root}/runs")
    return record


def replace_partition(rows: DataFrame, path: str, by: str) -> None:
    """Write over the partitions that ``rows`` has, leave the others (ST16, OT24)."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def repaired_places(events: DataFrame, reread: DataFrame) -> DataFrame:
    """Places set on old events from their slice, read again; known places stay (ST16, JN09)."""
    fresh = reread.select("feed_event_id", F.col("place_id").alias("_fresh"))
    return events.join(fresh, "feed_event_id", "left").withColumn("place_id", F.coalesce("place_id", "_fresh")).drop("_fresh")


def backfill(slots: DataFrame, start: int, end: int) -> DataFrame:
    """Slices of a window that aren't done, whatever the watermark, which stays where it is (ST03)."""
    from skerry.streaming.watermark import TERMINAL

    return slots.where(F.col("slot").between(start, end) & ~F.col("status").isin(*TERMINAL)).select("feed", "slot")


def recovered_shown(verdicts: DataFrame) -> DataFrame:
    """Shown leaves read back from verdicts of runs without a record: calls are told apart by their time (RN08, WIN14)."""
    from pyspark.sql import Window

    call = F.dense_rank().over(Window.partitionBy("run_id", "document_id").orderBy("created_at")) - 1
    return verdicts.select("run_id", "document_id", "concept_id", call.alias("offer")).distinct()


def stored_retrieval(offers: DataFrame) -> DataFrame:
    """Offers as one row a document, nested (RT10); ``loaded_retrieval`` takes them apart again."""
    return offers.groupBy("run_id", "document_id").agg(F.sort_array(F.collect_list(F.struct("offer", "concept_id", "rank"))).alias("offers"))


def loaded_retrieval(stored: DataFrame) -> DataFrame:
    return stored.select("run_id", "document_id", F.inline("offers"))

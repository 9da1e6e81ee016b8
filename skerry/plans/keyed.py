"""Tables that take each key once, batch after batch, without reading all keys each time.

Rows lie in folders by a hash of their key, one folder tree for each batch.  A batch reads the keys
of its own buckets only.  What it writes counts when its manifest is there: a batch that died before is
written anew, one that is replayed after is skipped, and readers see whole batches.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from skerry.plans.store import Manifest

BUCKETS = 64


class KeyedTable:
    """``key``: the columns that are unique; ``by``: further columns that follow from the key (its day, say) and part the folders.

    Nulls in a key are equal.  Columns are those of the first batch; ``bucket`` is taken.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], by: tuple[str, ...] = (), buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.by, self.buckets = spark, path.rstrip("/"), list(key), tuple(by), buckets
        self.jvm = spark.sparkContext._jvm
        self.log = self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        self.system = self.log.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _commits(self) -> list[dict]:
        """The batches that count, without those that a compaction put together."""
        if not self.system.exists(self.log):
            return []
        names = [s.getPath().toString() for s in self.system.listStatus(self.log) if s.getPath().getName().endswith(".json")]
        found = [c for c in (Manifest(self.spark, n).read() for n in names) if c is not None]
        gone = {d for c in found for d in c.get("instead", ())}
        return [c for c in found if c["data"] not in gone and c["rows"]]

    def _read(self, commits: list[dict], buckets: list[int] | None = None) -> DataFrame | None:
        if not commits:
            return None
        schema = StructType.fromJson(commits[0]["schema"])
        bases = [f"{self.path}/data/{c['data']}" for c in commits]
        parts = []
        for base, commit in zip(bases, commits, strict=True):
            held = commit["buckets"] if buckets is None else sorted(set(commit["buckets"]) & set(buckets))
            if held:
                wide = StructType([*schema.fields, StructField("bucket", IntegerType())])
                parts.append(self.spark.read.schema(wide).option("basePath", base).parquet(*(f"{base}/bucket={b}" for b in held)).drop("bucket").select(*schema.names))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame | None:
        """All rows; None before the first batch that has some."""
        return self._read(self._commits())

    def of_keys(self, keys: DataFrame) -> DataFrame | None:
        """The rows of some keys, from their buckets (SRC29: which id has a URL)."""
        held = self._read(self._commits(), self._buckets_of(keys))
        return None if held is None else held.join(keys.select(*self.key).distinct(), self.key, "left_semi")

    def _buckets_of(self, rows: DataFrame) -> list[int]:
        # BUCKETS numbers at most
        return sorted(r.b for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def insert(self, rows: DataFrame, batch: str) -> int:
        """Add one row for each key that isn't there yet, and return how many; the name of a batch is used once (ST05, SRC30)."""
        manifest = Manifest(self.spark, f"{self.path}/log/{batch}.json")
        if manifest.read() is not None:
            return 0
        fresh = rows.dropDuplicates(self.key)
        commits = self._commits()
        there = self._read(commits, self._buckets_of(rows)) if commits else None
        if there is not None:
            known = there.select(*(F.col(k).alias(f"_there_{k}") for k in self.key))
            fresh = fresh.join(known, reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_there_{k}")) for k in self.key)), "left_anti")
        return self._publish(manifest, fresh, {})

    def _publish(self, manifest: Manifest, rows: DataFrame, more: dict) -> int:
        own = uuid.uuid4().hex
        place = f"{self.path}/data/{own}"
        rows.withColumn("bucket", self.bucket()).repartition("bucket", *self.by).write.partitionBy("bucket", *self.by).parquet(place)
        written = self.spark.read.parquet(place) if self.system.globStatus(self.jvm.org.apache.hadoop.fs.Path(f"{place}/bucket=*")) else None
        sizes = {} if written is None else {int(r.bucket): r.n for r in written.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        content = {"data": own, "rows": sum(sizes.values()), "buckets": sorted(sizes), "schema": json.loads(rows.schema.json())} | more
        return content["rows"] if manifest.put(content) else 0

    def compact(self) -> None:
        """Put all batches together, so that readers open fewer files; the old ones stay for who reads them now."""
        commits = self._commits()
        if len(commits) > 1:
            self._publish(Manifest(self.spark, f"{self.path}/log/compact-{uuid.uuid4().hex}.json"), self._read(commits), {"instead": [c["data"] for c in commits]})

"""Joins of wide rows with few keys that don't shuffle the wide rows.

The keys are hashed into BUCKETS buckets.  The buckets in use, BUCKETS numbers at
most whatever the number of keys, are broadcast, and only rows in such a bucket
take part in the exact join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 20


def _bucket(key: tuple[str, ...]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")


def _buckets(keys: DataFrame, key: tuple[str, ...]) -> DataFrame:
    # 2 ** 20 integers at most
    return F.broadcast(keys.select(_bucket(key).alias("bucket_of_keys")).distinct())


def _by_bucket(rows: DataFrame, keys: DataFrame, key: tuple[str, ...], how: str) -> DataFrame:
    """No column is added to ``rows``, so none of theirs can clash."""
    buckets = _buckets(keys, key)
    return rows.join(buckets, F.pmod(F.xxhash64(*(rows[k] for k in key)), F.lit(BUCKETS)).cast("int") == buckets["bucket_of_keys"], how)


def likely(rows: DataFrame, keys: DataFrame, *key: str) -> DataFrame:
    """The rows whose key may be among the keys."""
    return _by_bucket(rows, keys, key, "left_semi")


def without(rows: DataFrame, keys: DataFrame, *key: str) -> DataFrame:
    """The rows whose key isn't among the keys; rows with a null in the key stay."""
    clear = _by_bucket(rows, keys, key, "left_anti")
    return clear.unionByName(likely(rows, keys, *key).join(keys.select(*key), list(key), "left_anti").select(*rows.columns))

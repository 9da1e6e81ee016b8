"""Lookups by a key of which a few values may hold a large part of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key value is hot if it has one in HOT rows or more; so there are HOT hot values at most.
HOT = 1000


def looked_up(rows: DataFrame, table: DataFrame, key: tuple[str, ...], weight: str, spread: Column) -> DataFrame:
    """``rows`` left-joined with ``table``, which has one row for each value of ``key``.

    ``weight`` is a column of the table: how many rows have that value; it isn't
    returned.  Hot values, HOT of them at most, are broadcast.  The other rows meet the rest of the table in a
    shuffle, in which a row that has found its hot value goes where ``spread``, a
    column of longs, sends it.  Give ``table`` from a written table; it is read three times.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    found = [c for c in table.columns if c not in key and c != weight]
    hot = F.col(weight) * HOT >= total

    def side(name: str, part: DataFrame) -> DataFrame:
        return part.select(*(F.col(k).alias(f"_{name}_{k}") for k in key), F.lit(True).alias(f"_{name}"), *(F.col(c).alias(f"_{name}_{c}") for c in found))

    # HOT rows at most
    first = F.broadcast(side("hot", table.where(hot)))
    out = rows.join(first, reduce(Column.__and__, (F.col(k) == F.col(f"_hot_{k}") for k in key)), "left")
    out = out.withColumn("_spread", F.when(F.col("_hot"), spread))
    rest = side("rest", table.where(~hot)).withColumn("_rest_spread", F.lit(-1).cast("long"))
    same = reduce(Column.__and__, (F.col(k) == F.col(f"_rest_{k}") for k in key[1:]), F.coalesce("_spread", F.lit(-1).cast("long")) == F.col("_rest_spread"))
    out = out.join(rest, (F.when(F.col("_hot").isNull(), F.col(key[0])) == F.col(f"_rest_{key[0]}")) & same, "left")
    return out.select(*rows.columns, *(F.coalesce(f"_hot_{c}", f"_rest_{c}").alias(c) for c in found))

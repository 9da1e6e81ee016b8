"""The contiguous watermark: the end of the gap-free run of finished slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("ok", "empty", "missing")


def contiguous(slices: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(feed, watermark): the last slot that all slots before it are done for (ST01).

    ``slices``: feed, slot, status.  ``start``: feed and the slot done so far; without
    it a feed begins at its first known slot.  A feed has 96 slots a day, so one
    feed's slots are few; the window is by feed.
    """
    first = slices.groupBy("feed").agg((F.min("slot") - 1).alias("done")) if start is None else start
    after = slices.where(F.col("status").isin(*TERMINAL)).join(first, "feed").where("slot > done").select("feed", "slot", "done").distinct()
    number = F.row_number().over(Window.partitionBy("feed").orderBy("slot"))
    # in an unbroken run the n-th slot lies n behind the start
    return after.withColumn("n", number).where(F.col("slot") == F.col("done") + F.col("n")).groupBy("feed").agg(F.max("slot").alias("watermark"))

"""Quarter-hour slice stamps, YYYYMMDDHHMMSS in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP, SECONDS = "yyyyMMddHHmmss", 900


def _epoch(moment: Column) -> Column:
    return F.unix_timestamp(moment.cast("timestamp"))


def floor_stamp(moment: Column) -> Column:
    """The stamp of the slice that holds a moment (FN01)."""
    return F.date_format(F.timestamp_seconds(_epoch(moment) - _epoch(moment) % SECONDS), STAMP)


def moment(stamp: Column) -> Column:
    """The moment a stamp names (FN02)."""
    return F.to_timestamp(stamp, STAMP)


def shifted(stamp: Column, slices: int) -> Column:
    """The stamp so many slices later, or earlier if negative (FN02)."""
    return F.date_format(F.timestamp_seconds(_epoch(moment(stamp)) + slices * SECONDS), STAMP)


def between(start: Column, end: Column, limit: int | None = None) -> Column:
    """All stamps after ``start`` up to ``end``, at most ``limit`` (FN03)."""
    count = F.floor((_epoch(moment(end)) - _epoch(moment(start))) / SECONDS).cast("int")
    if limit is not None:
        count = F.least(count, F.lit(limit))
    each = lambda i: F.date_format(F.timestamp_seconds(_epoch(moment(start)) + i * SECONDS), STAMP)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), each)).otherwise(F.array().cast("array<string>"))


def lag_slices(watermark: Column, now: Column) -> Column:
    """Slices between the watermark and now, null if nothing was ever ingested (FN04)."""
    return F.greatest(F.lit(0), F.floor((_epoch(now) - _epoch(now) % SECONDS - _epoch(moment(watermark))) / SECONDS).cast("long"))


def seconds_to_next(now: Column, grace: float = 90.0) -> Column:
    """Seconds until the next slice and its grace time (FN05)."""
    return SECONDS - _epoch(now) % SECONDS + F.lit(grace)

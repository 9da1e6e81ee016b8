"""Keys, dates, bands and small text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def score_band(best: Column) -> Column:
    """none, low, middle or high (FN18)."""
    return F.when(best.isNull(), "none").when(best < 0.6, "low").when(best < 0.7, "middle").otherwise("high")


def iso_day(text: Column) -> Column:
    """YYYYMMDD as an ISO date; other text as it is (FN06)."""
    return F.when(text.rlike("^[0-9]{8}$"), F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))).otherwise(text)


def url_key(url: Column) -> Column:
    """The first 16 digits of the address's SHA-1 (FN07)."""
    return F.substring(F.sha1(url), 1, 16)


def host(url: Column) -> Column:
    """Host with port, in lower case; empty without one (FN08)."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def content_key(fields: Column, text: Column) -> Column:
    """Names the text that was embedded (FN09)."""
    return F.concat(fields, F.lit("@"), F.substring(F.sha2(text, 256), 1, 12))


def calm_case(text: Column) -> Column:
    """Lower case for text that has letters but none in lower case (FN10)."""
    return F.when(text.rlike(r"\p{Ll}"), text).otherwise(F.lower(text))


def cut_text(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last three dots if cut (FN24)."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def theme_words(theme: Column) -> Column:
    """A theme's name as words (FN17)."""
    return F.lower(F.regexp_replace(F.regexp_replace(theme, "^(?:TAX|WB)_(?:[0-9]+_)?", ""), "_", " "))


def parsed_boolean(cell: Column) -> Column:
    """yes/no words as a boolean; null for others (FN19)."""
    word = F.lower(F.trim(cell))
    return F.when(word.isin("1", "true", "yes", "y", "t"), True).when(word.isin("0", "false", "no", "n", "f"), False)

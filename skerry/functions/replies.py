"""Model replies: JSON with chatter around it, read without failing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _braced(raw: Column, kind: str) -> Column:
    """What stands between the outermost braces, read as JSON; a bare JSON object is all of it."""
    return F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), kind)


def verdict(raw: Column) -> Column:
    """A struct (matched, confidence, country); confidence is clamped, null fields where unreadable (FN20)."""
    said = _braced(raw, "struct<matched:boolean,confidence:double,country:string,evidence:string>")
    return F.struct(
        said["matched"].alias("matched"),
        F.when(said["confidence"].isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), said["confidence"]))).alias("confidence"),
        F.upper(F.trim(said["country"])).alias("country"),
    )


def batch(raw: Column, expected: Column) -> Column:
    """One entry for each expected id: the reply's, or a no that says ``omitted``; other ids are ignored (FN21)."""
    said = F.coalesce(_braced(raw, "struct<results:array<struct<concept_id:int,matched:boolean,confidence:double>>>")["results"], F.array())

    def entry(wanted: Column) -> Column:
        found = F.get(F.filter(said, lambda r: r["concept_id"] == wanted), F.lit(0))
        return F.struct(
            wanted.alias("concept_id"), F.coalesce(found["matched"], F.lit(False)).alias("matched"), found["confidence"].alias("confidence"), found.isNull().alias("omitted")
        )

    return F.transform(expected, entry)


def event_list(raw: Column, most: int = 8) -> Column:
    """At most ``most`` events with a known status and a two-letter country or none (FN22)."""
    said = F.coalesce(_braced(raw, "struct<events:array<struct<what:string,status:string,country:string>>>")["events"], F.array())
    known = F.filter(said, lambda e: e["what"].isNotNull() & F.lower(e["status"]).isin("occurred", "ongoing", "planned", "denied"))
    return F.transform(
        F.slice(known, 1, most),
        lambda e: F.struct(e["what"].alias("what"), F.lower(e["status"]).alias("status"), F.when(e["country"].rlike("^[A-Za-z]{2}$"), F.upper(e["country"])).alias("country")),
    )


def listed(raw: Column) -> Column:
    """Whether a reply has a list of results at all."""
    return _braced(raw, "struct<results:array<struct<concept_id:int>>>")["results"].isNotNull()


def has_events(raw: Column) -> Column:
    """Whether a reply has a list of events, be it empty."""
    return _braced(raw, "struct<events:array<struct<what:string>>>")["events"].isNotNull()


def choices(raw: Column, allowed: Column) -> Column:
    """The ids said that are allowed, null if the reply has no list of them."""
    said = _braced(raw, "struct<concept_ids:array<int>>")["concept_ids"]
    return F.when(said.isNotNull(), F.array_intersect(allowed, said))


def chosen(raw: Column, allowed: Column) -> Column:
    """A struct (concept_id, confidence), the id null if it isn't allowed; null if the reply can't be read (FN23)."""
    said = _braced(raw, "struct<concept_id:int,choice:int,confidence:double,evidence:string>")
    one = F.coalesce(said["concept_id"], said["choice"])
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(said["confidence"], F.lit(0.0))))
    readable = F.rlike(raw, F.lit(r"(?s)\{.*\}")) & said.isNotNull()
    return F.when(readable, F.struct(F.when(F.array_contains(allowed, one), one).alias("concept_id"), sure.alias("confidence")))


def choice(raw: Column, allowed: Column) -> Column:
    """The chosen id, null if it isn't allowed (FN23)."""
    return chosen(raw, allowed)["concept_id"]

"""Questions for judges, as column expressions (FN25).

Classes are structs of concept_id, name, definition, inclusion and exclusion; events
are structs of what, status, country and evidence.  Null parts are left out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The answer that none of the classes asked about fits.
OTHER = 0
VERDICT = 'Answer with JSON: {"matched": true or false, "confidence": 0 to 1}'
VERDICTS = 'Answer with JSON: {"results": [{"concept_id": 0, "matched": true or false, "confidence": 0 to 1}]}'
EVENTS = 'Answer with JSON: {"events": [{"what": "", "status": "occurred or planned", "country": "two letters", "evidence": ""}]}'
CHOICES = 'Answer with JSON: {"concept_ids": [0]}'
CHOICE = 'Answer with JSON: {"concept_id": 0 or null}'
PAIRED = "Does the article report an instance of this class?"
BATCHED = "Which of these classes does the article report an instance of?"
ROUTED = "Answer each question about the article."
LISTED = "List the events of these kinds that the article reports."
EVENT_ROUTED = "Which of these questions has the answer yes for this event?"
CHOSEN = "Which one of these classes is the event an instance of, if any?"
#: What stands between the subject of a prompt and its classes.
QUESTIONS = (PAIRED, BATCHED, ROUTED, LISTED, EVENT_ROUTED, CHOSEN)


def _labelled(*parts: tuple[str, Column]) -> Column:
    """One line for each part that isn't null or empty."""
    return F.concat_ws("\n", *(F.when(F.length(c) > 0, F.concat(F.lit(f"{name}: "), c)) for name, c in parts))


def shortened(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last three dots where something is left out."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.length(whole) > limit, F.concat(F.substring(whole, 1, limit - 3), F.lit("..."))).otherwise(whole)


def article(url: Column, title: Column, body: Column, limit: int | None = None) -> Column:
    """The article, whole unless a model's context sets a limit."""
    return _labelled(("Address", url), ("Title", title), ("Article", F.coalesce(body, F.lit("")) if limit is None else shortened(body, limit)))


def concept(c: Column) -> Column:
    """A class with where its owner draws the line."""
    return _labelled(("Class", c["name"]), ("Meaning", c["definition"]), ("Counts if", c["inclusion"]), ("Doesn't count if", c["exclusion"]))


def event(e: Column) -> Column:
    return _labelled(("Event", e["what"]), ("Status", e["status"]), ("Country", e["country"]), ("Evidence", e["evidence"]))


def _numbered(classes: Column, text) -> Column:
    return F.array_join(F.transform(classes, lambda c: F.concat(F.lit("Number "), c["concept_id"].cast("string"), F.lit("\n"), text(c))), "\n\n")


def _question(c: Column) -> Column:
    """What a parent class asks: its definition, else its name."""
    return F.concat(F.lit("Question: "), F.coalesce(F.nullif(c["definition"], F.lit("")), c["name"]))


def _asked(*parts: Column | str) -> Column:
    return F.concat_ws("\n\n", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def pair(article: Column, c: Column) -> Column:
    return _asked(article, concept(c), PAIRED, VERDICT)


def concept_first(article: Column, c: Column) -> Column:
    """As ``pair``, the class before the article, so that a cache of prefixes serves all articles of a class."""
    return _asked(concept(c), article, PAIRED, VERDICT)


def batch(article: Column, classes: Column) -> Column:
    return _asked(article, BATCHED, _numbered(classes, concept), VERDICTS)


def route(article: Column, classes: Column) -> Column:
    return _asked(article, ROUTED, _numbered(classes, _question), VERDICTS)


def extract(article: Column, top: Column) -> Column:
    """The events of an article; the top classes say what is in scope."""
    kinds = F.array_join(F.transform(top, lambda c: F.concat(F.lit("- "), c["name"], F.lit(": "), F.coalesce(F.nullif(c["definition"], F.lit("")), c["name"]))), "\n")
    return _asked(article, F.concat(F.lit(f"{LISTED}\n"), kinds), EVENTS)


def event_route(e: Column, classes: Column, other: bool = False) -> Column:
    """Which of several questions an event answers with yes; with ``other``, none of them is an answer, too."""
    none = F.lit(f"\n\nNumber {OTHER}\nQuestion: Is it none of these?" if other else "")
    return _asked(event(e), EVENT_ROUTED, F.concat(_numbered(classes, _question), none), CHOICES)


def choose(e: Column, classes: Column) -> Column:
    return _asked(event(e), CHOSEN, _numbered(classes, concept), CHOICE)

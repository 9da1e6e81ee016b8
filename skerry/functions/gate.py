"""The quality gate on extracted text: why a page is no article."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks pages that are no articles.
PROXY_ERROR = r"(?m)^Warning: Target URL returned error [0-9]+"
DEAD_PAGE = "(?i)" + "|".join(
    [
        r"page (?:not found|(?:cannot|could not|can't) be found|has (?:been )?moved)",
        r"looking for (?:cannot|could not|can't) be found",
        r"\b404\b[^\n]{0,80}\berror|\berror\s*(?:code\s*)?404\b",
        r"access denied",
        r"are you a (?:human|robot)",
        r"verify (?:that )?you are",
        r"(?:enable|turn on) javascript",
        r"subscribe (?:now )?to (?:read|continue)",
        r"(?:not available|unavailable) in your (?:country|region|location)",
    ]
)
#: Links, sentences, and the shares and counts that tell articles from other pages.
LINK = r"\[[^\]]*\]\([^)]*\)"
#: A sentence is a letter, 29 characters or more that are no mark, and a mark.
MAX_LINK_SHARE, MIN_SENTENCES, MIN_WORDS = 0.47, 3, 50

#: Blanks of all scripts; what ``\\s`` takes is ASCII only here.
BLANKS = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def sentences(text: Column) -> Column:
    """How often a sentence is found; at most once before each mark, so a look at each piece between marks does, in linear time."""
    pieces = F.split(text, "[.!?]", -1)
    return F.size(F.filter(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: p.rlike("(?s)^[^A-Za-z]*+[A-Za-z].{29}")))


def junk_reason(text: Column) -> Column:
    """empty, proxy_error, dead_page, link_dump, too_thin, or null for an article (FLT11)."""
    whole = F.coalesce(text, F.lit(""))
    prose = F.regexp_replace(whole, LINK, " ")
    # each link leaves one blank
    link_chars = F.length(whole) - F.length(F.regexp_replace(whole, LINK, ""))
    words = F.size(F.array_remove(F.split(prose, f"{BLANKS}+"), ""))
    thin = (words < MIN_WORDS) & (sentences(prose) < MIN_SENTENCES)
    return (
        F.when(~whole.rlike(BLANKS.replace("[", "[^", 1)), "empty")
        .when(whole.rlike(PROXY_ERROR), "proxy_error")
        .when(whole.rlike(DEAD_PAGE), "dead_page")
        .when(link_chars > MAX_LINK_SHARE * F.length(whole), "link_dump")
        .when(thin, "too_thin")
    )

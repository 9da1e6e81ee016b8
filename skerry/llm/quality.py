"""Quality rules as a short-circuit cascade, in DataFrame operations only.

Each rule is a predicate that rejects.  On a bounded sample, each rule's running
time and the share of rows it rejects are measured; the rules are then chained in
a CASE, most rejections for the time first, so that a row that one rule rejects
pays for no later one.  The order changes the time only: a row is kept if no rule
rejects it, whatever the order.

Null text is treated as empty: it has no words and is rejected by ``few_words``.
A text without line breaks is one line; very long texts take time in proportion to n log n.  Equal rows get equal verdicts, extra
columns are kept, and an empty table gives an empty table (rules keep their
given order then).
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm.exprs import BLANKS, NOT_BLANK, let, split_words

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"
SAMPLE_ROWS, SAMPLE_STEP, SAMPLE_BYTES = 1000, 8, 1 << 16


@dataclass(frozen=True)
class Rule:
    """``rejects`` is never null."""

    name: str
    rejects: Column


def word_chars(text: Column) -> Column:
    """Code points outside blanks."""
    return F.length(F.regexp_replace(text, BLANKS, "")).cast("long")


def matches(text: Column, single: str) -> Column:
    """Characters of a class."""
    return (F.length(text) - F.length(F.regexp_replace(text, single, ""))).cast("long")


def lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(NOT_BLANK))


def dup_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    return let(lines(text), lambda found: (F.size(found) - F.size(F.array_distinct(found))).cast("long"))


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words within windows of ``width`` words that occur twice or more; ``words`` has to be a value.

    Windows go by a 64-bit hash.  Only where one repeats, the places are sorted
    and the union of the windows is measured.
    """

    def covered(places: Column) -> Column:
        gaps = F.zip_with(
            F.slice(places, F.lit(1), F.size(places) - 1), F.slice(places, F.lit(2), F.size(places) - 1), lambda a, b: F.least(b - a, F.lit(width))
        )
        return F.aggregate(gaps, F.lit(width), lambda n, gap: n + gap).cast("long")

    def places(ordered: Column) -> Column:
        pairs = F.zip_with(
            F.slice(ordered, F.lit(1), F.size(ordered) - 1),
            F.slice(ordered, F.lit(2), F.size(ordered) - 1),
            lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
        )
        return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))

    def of_hashes(hashes: Column) -> Column:
        tagged = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            let(tagged, lambda ordered: let(places(ordered), covered))
        )

    starts = F.sequence(F.lit(0), F.size(words) - width)
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(width))))
    return F.when(F.size(words) <= width, F.lit(0).cast("long")).otherwise(let(hashes, of_hashes))


def measures(text: Column) -> Column:
    """A struct of the base measures of a text that isn't null."""
    return let(
        split_words(text),
        lambda words: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            matches(text, SYMBOLS).alias("n_symbols"),
            dup_lines(text).alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
        ),
    )


def with_measures(docs: DataFrame, text: str = "text", to: str = "measures") -> DataFrame:
    return docs.withColumn(to, measures(F.coalesce(F.col(text), F.lit(""))))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def further_rules(text: Column, n_words: Column, chars: Column, symbols: Column, dups: Column) -> list[Rule]:
    """The rules beyond the base; thresholds lie well outside what rows labelled good have."""
    return [
        Rule("symbols", 100 * symbols > 10 * n_words),
        Rule("word_length", (chars < 2 * n_words) | (chars > 12 * n_words)),
        Rule("dup_lines", 100 * dups > 40 * F.size(lines(text))),
        Rule("capitals", 100 * matches(text, "[A-Z]") > 40 * chars),
        Rule("few_kinds_of_words", 100 * F.size(F.array_distinct(split_words(text))) < 10 * n_words),
    ]


def text_rules(text: Column) -> list[Rule]:
    """Base and further rules, each from the text alone."""
    n_words = F.size(split_words(text)).cast("long")
    repeats = let(split_words(text), lambda words: 100 * repeated_words(words) > 20 * F.size(words))
    return [
        Rule("few_words", n_words < 10),
        Rule("repeats", repeats),
        *further_rules(text, n_words, word_chars(text), matches(text, SYMBOLS), dup_lines(text)),
    ]


def ordered(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS, text: str = "text", prepare: Callable[[DataFrame], DataFrame] | None = None) -> list[Rule]:
    """The rules by rejections for the time on a sample of at most ``sample_rows`` rows.

    One row in SAMPLE_STEP of the first partitions is taken until there are enough,
    without texts of more than SAMPLE_BYTES: so few partitions are read, and the
    driver holds 64 MB at most.  ``prepare`` is applied to the sample.  The sample
    serves the order alone, which no result depends on.
    """
    spark = docs.sparkSession
    short = docs.where(F.coalesce(F.octet_length(text), F.lit(0)) <= SAMPLE_BYTES)
    rows = short.sample(fraction=1 / SAMPLE_STEP, seed=7).take(sample_rows)
    if not rows:
        return list(rules)
    sample = spark.createDataFrame(rows, docs.schema).coalesce(1)
    sample = (prepare(sample) if prepare else sample).persist()
    try:

        def measured(*wanted: Column) -> tuple[float, int]:
            began = time.perf_counter()
            got = sample.agg(F.count("*"), *(F.count_if(c) for c in wanted)).first()[-1]
            return time.perf_counter() - began, got

        measured()
        idle, total = measured()
        rate = {}
        for rule in rules:
            took, rejected = measured(rule.rejects)
            rate[rule.name] = rejected / total / max(took - idle, 1e-3)
        return sorted(rules, key=lambda r: -rate[r.name])
    finally:
        sample.unpersist()


def verdict(rules: list[Rule]) -> Column:
    """True if no rule rejects; later rules aren't evaluated once one has."""
    chain = F.when(rules[0].rejects, F.lit(False))
    for rule in rules[1:]:
        chain = chain.when(rule.rejects, F.lit(False))
    return chain.otherwise(F.lit(True))


def keep_good(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects, with all their columns; no shuffle."""
    rules = text_rules(F.coalesce(F.col(text), F.lit("")))
    return docs.where(verdict(ordered(docs.select(text), rules, sample_rows, text)))


def report(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``keep``, the base measures, ``base_failed`` and ``kept`` of each row."""
    m, whole = F.col("measures"), F.coalesce(F.col(text), F.lit(""))
    measured = with_measures(docs.select(*keep, text), text)
    rules = further_rules(whole, m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"])
    failed = base_failed(m["n_words"], m["n_repeat_words"])
    kept = F.when(failed, F.lit(False)).otherwise(verdict(ordered(docs.select(text), rules, sample_rows, text, lambda sample: with_measures(sample, text))))
    return measured.select(*keep, "measures.*", failed.alias("base_failed"), kept.alias("kept"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t,
         list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), win AS (
  SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 5)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT r, count(DISTINCT i + k) AS n_rep FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY r
), m AS (
  SELECT doc_id, t, ws, ls, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (r)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed
            OR 100 * n_symbols > 10 * n_words
            OR word_chars < 2 * n_words OR word_chars > 12 * n_words
            OR 100 * n_dup_lines > 40 * len(ls)
            OR 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 40 * word_chars
            OR 100 * len(list_distinct(ws)) < 10 * n_words) AS kept
FROM b
"""

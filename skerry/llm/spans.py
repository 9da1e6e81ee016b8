"""Substring deduplication by sliding sentence spans, in DataFrame operations only.

A text is cut into sentences, which together are the text again.  Spans are all
runs of two consecutive sentences, however short; a longer repeated run is covered by those inside it.  As a
passage may be one sentence, single sentences of ``long`` words or more are spans, too, and so is
a text of one sentence.  Spans are hashed (128 bits) and joined globally; common spans, of which one task would
hold all, are looked up in a broadcast of bounded size instead.  Of equal spans the one with the
smallest (id, position) is the first; every sentence that another one covers is repeated.

Two short sentences often meet again by chance.  So repeated sentences are removed by stretches: a
stretch of neighbours goes if it has ``few`` words or more, or is the whole text.
So of a repeat of over 50 words, all whole sentences are
removed; sentences that only partly belong to it are not.  With ``few = long = 1`` whatever is repeated goes.

Null text stays null and empty text empty.  A text without sentence marks is one
sentence.  Rows with equal ids are the same document, so they don't repeat each
other.  Rows with a null id are left as they are.  Very long texts take time in
proportion to their length; an empty table gives an empty table.  Extra columns are kept
by ``deduplicate``, but for ``n_sentences`` and ``n_removed``, which are set.  Ids are integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm.exprs import let
from skerry.plans.cuts import cut

#: Up to marks before a blank, or to line ends, or to the end of the text.
SENTENCE = r"[^\n]*?[.!?]+[ \t]+\n*|[^\n]*\n+[ \t]*|[^\n]+"
#: Least words of a stretch of repeated sentences, and of a sentence that is a span of its own.  Every sentence counts as a word at least.
FEW, LONG = 12, 25
#: A span is common if it makes up one in COMMON of all repeated spans or more; so there are COMMON of them at most.
COMMON = 1000


def sentences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def _plain(found: Column) -> Column:
    return F.transform(found, lambda s: F.trim(F.regexp_replace(s, r"[ \t\r\n]+", " ")))


def _words(plain: Column) -> Column:
    return F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1


def _spans(found: Column, long: int) -> Column:
    """Structs (pos, size, h1, h2) of all spans among the sentences."""
    # each sentence is hashed once, spans by the hashes of their sentences
    counted = F.transform(_plain(found), lambda s: F.struct(_words(s).alias("w"), F.xxhash64(s).alias("h1"), F.xxhash64(F.lit("2"), s).alias("h2")))

    def starting(items: Column, i: Column) -> Column:
        a, b = F.get(items, i), F.get(items, i + 1)

        def span(size: int, *parts: Column) -> Column:
            hashes = (F.xxhash64(*(p[h] for p in parts)).alias(h) for h in ("h1", "h2"))
            return F.struct(i.alias("pos"), F.lit(size).alias("size"), *hashes)

        return F.array(F.when((a["w"] >= long) | (F.size(items) == 1), span(1, a)), F.when(b.isNotNull(), span(2, a, b)))

    def all_of(items: Column) -> Column:
        return F.filter(F.flatten(F.transform(items, lambda _, i: starting(items, i))), lambda s: s.isNotNull())

    return let(counted, all_of)


def _enough(repeated: Column, found: Column, few: int) -> Column:
    """The repeated positions that lie in stretches of enough words, or in one that is the whole text."""

    def of_words(words: Column, places: Column) -> Column:
        last = F.size(places) - 1
        begins = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (F.get(places, i) != F.get(places, i - 1) + 1))

        def stretch(begins: Column, k: Column) -> Column:
            begin = F.get(begins, k)
            size = F.coalesce(F.get(begins, k + 1), last + 1) - begin
            inside = F.slice(words, F.get(places, begin) + 1, size)
            enough = (F.aggregate(inside, F.lit(0), lambda n, w: n + w) >= few) | (size == F.size(words))
            return F.when(enough, F.slice(places, begin + 1, size)).otherwise(F.array().cast("array<int>"))

        return let(begins, lambda begins: F.flatten(F.transform(begins, lambda _, k: stretch(begins, k))))

    return let(F.transform(_plain(found), _words), lambda words: let(F.array_sort(repeated), lambda places: of_words(words, places)))


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", long: int = LONG) -> DataFrame:
    """(key, ``repeated``): the positions of the sentences that other spans repeat, for documents that have some."""
    known = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    spans = known.select(F.col(key).cast("long").alias("doc"), F.inline(_spans(sentences(F.col(text)), long)))
    # one exact number in the order of (id, position); a decimal stays in the hash aggregation
    place = (F.col("doc").cast("decimal(38,0)") * F.lit(2**31).cast("decimal(11,0)") + F.col("pos")).cast("decimal(38,0)")
    repeated = cut(spans.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"))
    total = repeated.agg(F.sum("n")).first()[0] or 0
    common = F.col("n") * COMMON >= total
    # COMMON rows at most
    known_first = F.broadcast(repeated.where(common).select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("first").alias("_first")))
    found = spans.join(known_first, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    # a common span is settled here: only its repeats go on, with a negative size, to the task that their own place gives
    settled = F.col("_first").isNotNull()
    going = found.where(~settled | (place > F.col("_first"))).select(
        "doc", "pos", F.when(settled, -F.col("size")).otherwise(F.col("size")).alias("size"),
        F.when(settled, F.xxhash64("doc", "pos")).otherwise(F.col("h1")).alias("h1"), "h2",
    )
    # the place is worked out again after the exchange, which stays as slim as can be
    later = going.join(repeated.where(~common).drop("n"), ["h1", "h2"], "left").where((F.col("size") < 0) | (place > F.col("first")))
    covered = later.select("doc", F.explode(F.sequence("pos", F.col("pos") + F.abs("size") - 1)).alias("p"))
    return covered.groupBy(F.col("doc").alias(key)).agg(F.collect_set("p").alias("repeated"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", few: int = FEW, long: int = LONG) -> DataFrame:
    """``docs`` with repeated sentences removed from the text, and ``n_sentences`` and ``n_removed``."""

    def left_over(found: Column, repeated: Column) -> Column:
        def kept(removed: Column) -> Column:
            places = F.array_except(F.sequence(F.lit(0), F.size(found) - 1), removed)
            return F.struct(F.size(removed).cast("long").alias("n"), F.array_join(F.transform(places, lambda i: F.get(found, i)), "").alias("text"))

        return let(_enough(repeated, found, few), kept)

    gone = repeats(docs, key, text, long).select(F.col(key).alias("_spans_key"), F.col("repeated").alias("_spans_repeated"))
    joined = docs.join(gone, docs[key].cast("long") == gone["_spans_key"], "left").drop("_spans_key")
    repeated = F.col("_spans_repeated")

    def cleaned(found: Column) -> Column:
        whole = F.struct(F.lit(0).cast("long").alias("n"), F.col(text).alias("text"))
        left = F.when(repeated.isNull(), whole).otherwise(left_over(found, repeated))
        return F.struct(F.size(found).cast("long").alias("sentences"), left.alias("left"))

    names = {"n_sentences", "n_removed"}
    found = joined.select(*(F.col(c) for c in docs.columns if c.lower() not in names), F.inline(F.array(let(sentences(F.coalesce(F.col(text), F.lit(""))), cleaned))).alias("_spans_n", "_spans_left"))
    return found.withColumns({"n_sentences": F.col("_spans_n"), "n_removed": F.col("_spans_left.n"), text: F.col("_spans_left.text")}).drop("_spans_n", "_spans_left")


SQL = rf"""
WITH s AS (
  SELECT doc_id, text, CASE WHEN text = '' THEN [] ELSE regexp_extract_all(text, '[^\n]*?[.!?]+[ \t]+\n*|[^\n]*\n+[ \t]*|[^\n]+') END AS ss
  FROM documents
), e AS (
  SELECT doc_id, i - 1 AS pos, len(ss) AS size, trim(regexp_replace(ss[i], '[ \t\r\n]+', ' ', 'g')) AS a,
         trim(regexp_replace(ss[i + 1], '[ \t\r\n]+', ' ', 'g')) AS b
  FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM s)
), w AS (
  SELECT *, length(a) - length(replace(a, ' ', '')) + 1 AS wa FROM e
), spans AS (
  SELECT doc_id, pos, 1 AS size, a AS k FROM w WHERE wa >= {LONG} OR size = 1
  UNION ALL SELECT doc_id, pos, 2, a || chr(1) || b FROM w WHERE b IS NOT NULL
), later AS (
  SELECT doc_id, pos, size FROM (SELECT *, row_number() OVER (PARTITION BY size, k ORDER BY doc_id, pos) AS n FROM spans) WHERE n > 1
), repeated AS (
  SELECT DISTINCT doc_id, pos + j AS pos FROM (SELECT *, unnest(range(0, size)) AS j FROM later)
), stretch AS (
  SELECT doc_id, pos, wa, size, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM repeated JOIN w USING (doc_id, pos)
), gone AS (
  SELECT doc_id, pos AS p FROM (SELECT *, sum(wa) OVER (PARTITION BY doc_id, k) AS words, count(*) OVER (PARTITION BY doc_id, k) AS n FROM stretch) WHERE words >= {FEW} OR n = size
), r AS (
  SELECT doc_id, count(*) AS n, list(p) AS ps FROM gone GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(ss) AS BIGINT) AS n_sentences, coalesce(n, 0) AS n_removed,
       CASE WHEN n IS NULL THEN text
            ELSE array_to_string(list_transform(list_filter(range(1, len(ss) + 1), lambda i: NOT list_contains(ps, i - 1)), lambda i: ss[i]), '') END AS text
FROM s LEFT JOIN r ON s.doc_id = r.doc_id
"""

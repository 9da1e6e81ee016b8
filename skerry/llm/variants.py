"""Spelling variants: words one edit apart, found by bands of letter parities.

A word's mask has a bit for the parity of each letter's count.  Two words are near if
one inserted, deleted or replaced code point makes them equal; that flips at most two bits.  The
masks are split into three bands, so near words agree in one band at least, and no
length differs by more than one.  Words are joined on equal bands and lengths.  As one edit has one
place, near words also have one half in common, counted by the shorter word's length, so
the join key holds that half, too: the bands alone leave thousands of candidates a word.  Of the pairs that
meet, those whose masks differ in more than two bits go at once, the edit distance decides on the
rest.  Pairs that agree in several bands or halves are taken in the first one.

A band's value with a large part of all words is split: its shorter words are dealt
to several tasks, its others go to each of these.  Joins of words with words ask for a
sort-merge join: Spark's estimate comes from compressed files and knows nothing of a word's many
entries, so it would take large tables for small ones and broadcast them.  A word's form is its near word of the
largest count, if that count is large enough; forms are followed to the last one, the root.

Null texts have no words; null ids count as empty ones.  Repeated rows count each time,
ties go to the word first in the order of code points, very long texts are taken whole, an
empty table gives an empty table, extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.plans.cuts import cut

RUN = "[A-Za-zÀ-ÿ]+"
#: One run in so many, by its hash, loses a letter.
NOISE = 97
BANDS, BAND_BITS = 3, 16
#: A band's value is split if it has one in SPLIT of all entries or more; so there are SPLIT such values at most.
SPLIT = 200


def noisy_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word): each run of letters of each text with A-Z in lower case; one in NOISE, by a hash of id and run, lacks a letter."""
    lower = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % NOISE == 0, short).otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame, least_chars: int, least_count: int) -> DataFrame:
    """(word, n) for words that are long and frequent enough."""
    return words.where(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def mask(word: Column) -> Column:
    """The parities of the letters' counts; letters beyond a-z share the bits that are left.

    Neighbours in the alphabet go to different bands.
    """
    bits = BANDS * BAND_BITS

    def bit(char: Column) -> Column:
        code = F.ascii(char)
        order = F.when(code.between(97, 122), code - 97).otherwise(26 + code % (bits - 26))
        return order % BANDS * BAND_BITS + F.floor(order / BANDS).cast("int")

    chars = F.filter(F.split(word, ""), lambda c: c != "")
    # bit_count and xor on longs; a shift by a column needs the SQL form
    return F.aggregate(chars, F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit(c))))


def _band(m: Column, k: int) -> Column:
    return F.shiftright(m, BAND_BITS * k).bitwiseAND((1 << BAND_BITS) - 1).cast("int")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): each pair of near words once.  ``words`` has one row (word, n) for each word; it is read three times."""
    masked = words.select("word", "n", F.length("word").alias("size"), mask(F.col("word")).alias("mask"))

    def entries(least: Column) -> list[Column]:
        """For each band and half, as one of two words of which the shorter one has so many code points."""
        head = F.floor(least / 2).cast("int")
        halves = (F.substring("word", F.lit(1), head), F.substring(F.col("word"), F.col("size") - least + head + 1, F.col("size")))
        return [
            F.struct(F.lit(k).alias("band"), _band(F.col("mask"), k).alias("value"), least.alias("least"), F.lit(i).alias("half"), F.xxhash64(half).alias("letters"))
            for k in range(BANDS)
            for i, half in enumerate(halves)
        ]

    key = ["band", "value", "least", "half", "letters"]
    first = masked.select("*", F.inline(F.array(*entries(F.col("size")))))
    # as a word of equal length, and as the longer one of a pair
    second = masked.select("*", F.inline(F.array(*entries(F.col("size")), *entries(F.col("size") - 1))))
    sizes = first.groupBy(*key).agg(F.count("*").alias("m"))
    block = max(1, 2 * BANDS * words.count() // SPLIT)
    # SPLIT rows at most
    large = F.broadcast(sizes.where(F.col("m") >= block + 1).select(*key, F.ceil(F.col("m") / block).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    left = first.join(large, key, "left").select(*key, F.pmod(F.xxhash64("word"), parts).cast("int").alias("part"), *(F.col(c).alias(f"a_{c}") for c in ("word", "n", "size", "mask")))
    right = second.join(large, key, "left").select(*key, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), *(F.col(c).alias(f"b_{c}") for c in ("word", "n", "size", "mask")))
    apart = F.col("a_mask").bitwiseXOR(F.col("b_mask"))
    earlier = [(F.col("l.band") <= k) | (_band(apart, k) != 0) for k in range(BANDS - 1)]
    ordered = (F.col("a_size") < F.col("b_size")) | (F.col("a_word") < F.col("b_word"))
    head = F.floor(F.col("l.least") / 2).cast("int")
    heads = F.substring("a_word", F.lit(1), head) == F.substring("b_word", F.lit(1), head)
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in (*key, "part")]
    alike = [F.bit_count(apart) <= 2, ordered, *earlier, (F.col("l.half") == 0) == heads, F.levenshtein("a_word", "b_word", 1) == 1]
    return left.alias("l").join(right.alias("r").hint("merge"), reduce(Column.__and__, same + alike)).select(F.col("a_word").alias("a"), F.col("a_n"), F.col("b_word").alias("b"), F.col("b_n"))


def with_forms(words: DataFrame, pairs: DataFrame, ratio: int) -> DataFrame:
    """(word, n, n_near, form, form_n): the form is the near word of largest n, ties to the first one, if it has ``ratio`` times the word's n."""
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")).union(pairs.select("b", "a", "a_n"))
    best = both.groupBy("word").agg(F.count("*").alias("near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    found = words.join(best.hint("merge"), "word", "left")
    enough = -F.col("best.m") >= ratio * F.col("n")
    return found.select(
        "word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n"),
    )


def with_roots(forms: DataFrame) -> DataFrame:
    """``forms`` with ``root``: each round doubles how far forms are followed.

    A form has more occurrences than the word, so there are no cycles.
    """
    at = cut(forms.select("word", F.coalesce("form", "word").alias("root")))
    moved = True
    while moved:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = cut(at.join(further.hint("merge"), "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        moved = not at.where("moved").isEmpty()
    return forms.join(at.select("word", "root").hint("merge"), "word")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 5, least_count: int = 3, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of the texts with enough code points and occurrences."""
    words = cut(counted(noisy_runs(docs, key, text), least_chars, least_count))
    forms = cut(with_forms(words, near_pairs(words), ratio))
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")

"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from skerry.llm import queries, variants


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                p = h % len(run)
                run = run[:p] + run[p + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    holes = defaultdict(list)  # near words share a word with a hole, or one is the other without a letter
    for w in words:
        for i in range(len(w)):
            holes[w[:i] + "_" + w[i + 1 :]].append(w)
    friends = defaultdict(set)
    for group in holes.values():
        for w in group:
            friends[w].update(x for x in group if x != w)
    for w in words:
        for i in range(len(w)):
            short = w[:i] + w[i + 1 :]
            if short in words:
                friends[w].add(short)
                friends[short].add(w)
    form = {}
    for w, n in words.items():
        best = min(friends[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        assert all(near(w, x) for x in friends[w])
        out.append((w, form[w], root, n, len(friends[w]), words.get(form[w])))
    return sorted(out)


def collected(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_all_words_of_the_documents(spark, sf_dir):
    rows = [tuple(r) for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    got = collected(queries.QUERIES["op13_spelling_variants"](spark, sf_dir))
    assert got == brute(rows) and len(got) > 500


def test_chains_ties_accents_and_odd_rows(spark):
    rng = random.Random(5)
    base = ["orange", "étoile", "ÉTOILE", "strasse", "aaaaaa", "abcabc", "señora", "xy×zw÷v"]
    rows = [(None, None), (1, ""), (2, "1234 --"), (None, "strasse strasse"), (3, "Orange ORANGE orange " * 40), (3, "Orange ORANGE orange " * 40)]
    for i in range(300):
        words = []
        for _ in range(40):
            w = list(rng.choice(base))
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
                k = rng.randrange(len(w))
                w[k : k + rng.choice((0, 1))] = rng.choice(("", "a", "é", "z", "÷"))
            words.append("".join(w))
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string")
    got = collected(variants.spelling_variants(docs))
    assert got == brute(rows)
    assert any(r[1] and r[2] != r[1] for r in got), "no chain"
    assert collected(variants.spelling_variants(docs.where("false"))) == []


def test_a_band_that_most_words_share_is_split(spark, monkeypatch):
    """Anagrams have equal masks, so all of them meet in one band."""
    monkeypatch.setattr(variants, "SPLIT", 3)
    rng = random.Random(1)
    words = {"".join(rng.sample("abcdefg", 7)) for _ in range(600)}
    words |= {w[:-1] for w in list(words)[:200]}
    table = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    got = {tuple(sorted((r.a, r.b))) for r in variants.near_pairs(table).collect()}
    want = {(a, b) for a in words for b in words if a < b and near(a, b)}
    assert got == want and variants.near_pairs(table).count() == len(want)


def test_words_are_not_broadcast(spark, sf_dir, monkeypatch):
    """However small Spark takes their files to be; the values that are split may be."""
    plans, cut = [], variants.cut

    def ran(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(variants, "cut", lambda df: cut(ran(df)))
    monkeypatch.setattr(variants, "SPLIT", 10**6)
    docs = queries.table(spark, sf_dir, "documents").limit(50)
    assert ran(variants.spelling_variants(docs)).count() > 0
    joins = [line for plan in plans for line in plan.splitlines() if "Join" in line]
    assert any("SortMergeJoin" in line for line in joins)
    assert not [x for x in joins if "Broadcast" in x and not ("band#" in x and "LeftOuter" in x)]


def test_masks_differ_in_two_bits_at_most(spark):
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
    pairs = []
    for _ in range(500):
        w = [rng.choice(letters) for _ in range(rng.randint(5, 12))]
        v = list(w)
        v[rng.randrange(len(v))] = rng.choice(letters)
        pairs.append(("".join(w), "".join(v)))
    df = spark.createDataFrame(pairs, "a string, b string")
    bits = df.select(F.bit_count(variants.mask(F.col("a")).bitwiseXOR(variants.mask(F.col("b")))).alias("d"))
    assert bits.agg(F.max("d")).first()[0] == 2

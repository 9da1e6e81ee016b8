import random
import re

import pytest

from skerry.llm import jaccard, shingles


def shingled(text, width):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(texts, width, percent):
    sets = {d: shingled(t, width) for d, t in texts}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def family(rng, copies, size, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(size)]
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_components_agree_with_brute_force(spark, width, percent):
    rng = random.Random(width)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = family(rng, 60, 120, 6) + family(rng, 40, 400, 20) + family(rng, 50, 12, 2) + family(rng, 20, 5, 1)
    texts += [f"{' '.join(f'u{rng.randrange(10**6)}' for _ in range(80))} {passage}" for _ in range(40)]
    texts += [None, "", " \n", "a b", "A  b", "a b c", "same text here now", "Same TEXT here\tnow", " ".join("r" for _ in range(900))]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, width=width, percent=percent).collect()}
    assert got == brute(rows, width, percent)


def test_blocks_and_large_buckets_find_the_same(spark, monkeypatch):
    rng = random.Random(8)
    rows = list(enumerate(family(rng, 90, 150, 5) + family(rng, 30, 150, 5)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "GROUP_LIMIT", 16)
    monkeypatch.setattr(jaccard, "PAIR_LIMIT", 3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == brute(rows, 3, 90)


def test_group_links_span_the_components():
    rng = random.Random(4)
    for _ in range(60):
        base = rng.sample(range(10**6), 60)
        sets = []
        for _ in range(rng.randint(2, 25)):
            own = set(base) - set(rng.sample(base, rng.randint(0, 8))) | {rng.randrange(10**6) for _ in range(rng.randint(0, 5))}
            sets.append(sorted(own))
        import numpy as np

        links = jaccard.group_links([np.array(s, np.uint64) for s in sets], 80)
        up = list(range(len(sets)))

        def find(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for i, j in links:
            assert 100 * len(set(sets[i]) & set(sets[j])) >= 80 * len(set(sets[i]) | set(sets[j]))
            up[find(i)] = find(j)
        for i in range(len(sets)):
            for j in range(i):
                if 100 * len(set(sets[i]) & set(sets[j])) >= 80 * len(set(sets[i]) | set(sets[j])):
                    assert find(i) == find(j)


def test_tokens_too_rare_for_a_run_do_not_put_documents_together(spark, monkeypatch):
    """A token of 200 documents, of which no run of tokens holds three, comes after each document's own."""
    monkeypatch.setattr(jaccard, "SKETCH_RUN", 400)
    monkeypatch.setattr(jaccard, "SKETCH_SHARE", 4)
    rng = random.Random(9)
    rows = [(i, " ".join([f"w{rng.randrange(10**9)}" for _ in range(250)] + [f"c{k}" for k in range(5)])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    common = shingles.shingle_set("c0 c1 c2 c3 c4", 5)
    sketch = jaccard.frequency_sketch(docs, "text", 5)
    assert sketch[jaccard._cells(common)][0] >= jaccard.SKETCH_LEAST * 4
    for _, text in rows:
        tokens = shingles.shingle_set(text, 5)
        assert common[0] in tokens
        c = len(tokens).bit_length()
        assert not set((shingles.mixed(common + jaccard.np.uint64(c))).tolist()) & set(jaccard.rarest_keys(tokens, 80, sketch).tolist())
    monkeypatch.setattr(jaccard, "PAIR_LIMIT", 3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, width=5, percent=80).collect()}
    assert got == brute(rows, 5, 80)


def test_one_of_each(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(5, text, 1), (3, text, 2), (9, text + " more", 3), (4, "other words of its own here", 4), (None, text, 5), (7, None, 6)], "doc_id long, text string, n long")
    got = sorted((str(r.doc_id), r.n) for r in jaccard.one_of_each(docs).collect())
    assert got == [("3", 2), ("4", 4), ("7", 6), ("None", 5)]


def by_id(rows, width, percent):
    """Brute force where an id may have several texts: {(id, its set's size): component}."""
    sets = [(d, shingled(t, width)) for d, t in rows]
    up = {d: d for d, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(d), find(e)
                up[max(x, y)] = min(x, y)
    return sorted((d, len(s), find(d)) for d, s in sets)


def test_unequal_words_that_linear_hashes_mix_up_stay_apart(spark):
    """Thue-Morse words of 1,024 letters collide in any polynomial hash mod 2 ** 64."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(10, one), (11, other), (12, f"x {one} y z"), (13, f"x {other} y z")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()} == {i: i for i in range(10, 14)}
    assert len({shingles.shingle_set(t, 3)[0] for t in (one, other)}) == 2


def test_ids_with_several_texts(spark):
    rng = random.Random(5)
    a, b, c = (family(rng, 6, 150, 3) for _ in range(3))
    rows = [(1, a[0]), (1, b[0]), (2, a[1]), (3, b[1]), (4, c[0]), (9, c[1]), (9, a[2]), (8, "own words only here"), (8, "own words only here"), (0, b[0]), (7, None), (7, c[2]), (6, "")]
    rows += [(20 + i, t) for i, t in enumerate(family(rng, 30, 200, 4))] + [(20, "one more text of twenty"), (5, "one more text of twenty")]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, n int, digest string").repartition(5)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect())
    assert got == by_id(rows, 3, 90)


def test_hot_texts_and_keys(spark, monkeypatch):
    """Many copies of one text and many near copies of another, with every key counted as crowded or none."""
    rng = random.Random(6)
    rows = list(enumerate([family(rng, 1, 90, 0)[0]] * 120 + family(rng, 120, 90, 3) + family(rng, 60, 90, 90)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute(rows, 3, 90)
    for cells in (1 << 16, 0):
        monkeypatch.setattr(jaccard, "CROWDED", 1 << 40 if cells == 0 else 1000)
        monkeypatch.setattr(jaccard, "KEY_CELLS", cells or 1)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
        assert got == want


def test_whole_table_agrees_with_brute_force(spark, sf_dir):
    from skerry.llm import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op3_ngram_jaccard(spark, sf_dir).collect()}
    assert got == brute(rows, 3, 90)


def test_null_ids_clashing_names_and_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(120_000))
    rows = [(None, "a b c d"), (2, "a b c d"), (None, "q r s t"), (None, None), (3, long), (4, long + " end"), (5, "z" * 500_000)]
    names = "doc_id long, text string, _bucket int, bucket_of_keys int, doc int, rep string, component int, component_id int, n_shingles int"
    docs = spark.createDataFrame([(*r, 1, 2, 3, "r", 5, 6, 7) for r in rows], names)
    got = sorted(jaccard.jaccard_components(docs).collect(), key=str)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted(
        [("None", 2, "2"), ("2", 2, "2"), ("None", 2, "None"), ("None", 0, "None"), ("3", 119998, "3"), ("4", 119999, "3"), ("5", 1, "5")]
    )
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "5", "None", "None", "None"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(docs).count() == 0
    assert jaccard.one_of_each(docs).count() == 0


def test_words_are_hashed_alike_in_any_batch():
    texts = ["a bb  ccc", "", None, "ccc a\tbb", "x" * 2000, "é A bb"]
    together = list(shingles.shingle_sets(texts, 2))
    for text, found in zip(texts, together, strict=True):
        assert found.tolist() == shingles.shingle_set(text, 2).tolist()
        assert len(found) == len(shingled(text, 2))

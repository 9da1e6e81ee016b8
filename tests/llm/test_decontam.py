import random
import re
from collections import Counter

import numpy as np

from skerry.llm import decontam, queries, shingles


def brute(index, text):
    """Every window of every item's size, compared exactly."""
    hashes, sizes = decontam.hashed_words(text)
    out = {}
    for number, size, item in zip(index.numbers, index.sizes, index.items, strict=True):
        width = min(decontam.WIDTH, size)
        if len(hashes) < width:
            continue
        runs, weights = shingles.rolled(hashes, width), decontam.weights_of(sizes, width)
        count = max(1, min(size, len(hashes)) - width + 1)
        best = max(decontam.similarity(decontam.Shingled(runs[p : p + count], weights[p : p + count]), item) for p in range(len(runs) - count + 1))
        if best >= decontam.THRESHOLD:
            out[number] = best
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [" ".join(word() for _ in range(rng.randint(12, 60))) for _ in range(30)] + ["three little words", "one", None, "", " . "]
    docs = []
    for i in range(120):
        words = [word() for _ in range(rng.randint(0, 200))]
        if i % 3 == 0:
            leak = rng.choice(items[:32]).split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                leak[rng.randrange(len(leak))] = word()
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() + "," if i % 2 else w for w in leak]
        docs.append(" ".join(words))
    return items, docs + [None, "", "three little", "one"]


def test_windows_agree_with_brute_force():
    items, docs = corpus(2)
    index = decontam.Index(tuple(items))
    got = list(index.all_matches(docs))
    found = 0
    for text, matches in zip(docs, got, strict=True):
        want = brute(index, text)
        assert {k: round(v[0], 9) for k, v in matches.items()} == {k: round(v, 9) for k, v in want.items()}
        found += len(want)
    assert found > 20


def test_index_finds_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(0)
    index = decontam.Index(tuple(" ".join(f"a{i}_{j}" for j in range(20)) for i in range(50)))
    prints = []
    for i in range(50):
        bits = np.unpackbits(index.prints[i].view(np.uint8))
        bits[rng.choice(128, rng.integers(0, decontam.RADIUS + 1), replace=False)] ^= 1
        prints.append(np.packbits(bits).view(np.uint16))
    found = {tuple(x) for x in index.near(np.array(prints)).tolist()}
    assert {(i, i) for i in range(50)} <= found


def test_tables_blocks_and_dropping(spark, monkeypatch):
    items, docs = corpus(5)
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, similarity string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    whole = sorted(map(tuple, decontam.contaminated(table, bench).collect()))
    monkeypatch.setattr(decontam, "ITEM_BLOCK", 7)
    assert sorted(map(tuple, decontam.contaminated(table, bench).collect())) == whole
    kept = decontam.drop_contaminated(table, bench)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(docs))) - {r[0] for r in whole}


def plain(text):
    """Shingles as strings with their bytes, by plain Python."""
    words = re.findall(r"[A-Za-z0-9_\u0080-\U0010ffff]+", (text or "").lower())
    width = min(decontam.WIDTH, len(words))
    return [(tuple(words[i : i + width]), sum(len(w.encode()) for w in words[i : i + width])) for i in range(len(words) - width + 1)] if words else [], len(words), width


def alike(a, b):
    """Weighted Jaccard similarity of two lists of (shingle, bytes)."""
    x, y = Counter(), Counter()
    for t, w in a:
        x[t] += w
    for t, w in b:
        y[t] += w
    return sum((x & y).values()) / sum((x | y).values())


def plain_matches(items, text):
    """The best similarity of each item that some window is similar to, without hashes or fingerprints."""
    words = re.findall(r"[A-Za-z0-9_\u0080-\U0010ffff]+", (text or "").lower())
    out = {}
    for key, item in items:
        own, size, width = plain(item)
        if not size or len(words) < width:
            continue
        count, vocabulary = max(1, min(size, len(words)) - width + 1), {t for t, _ in own}
        grams = [(tuple(words[i : i + width]), sum(len(w.encode()) for w in words[i : i + width])) for i in range(len(words) - width + 1)]
        if not any(t in vocabulary for t, _ in grams):
            continue
        best = max(alike(grams[p : p + count], own) for p in range(len(grams) - count + 1))
        if best >= decontam.THRESHOLD:
            out[key] = round(best, 9)
    return out


def test_query_agrees_with_plain_python(spark, sf_dir):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {(d.doc_id, key): s for d in docs for key, s in plain_matches(items, d.text).items()}
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in queries.op1_decontamination(spark, sf_dir).collect()}
    assert got == want and len(want) > 2


def test_items_with_long_words_are_found_at_the_threshold():
    """A replaced word of many bytes costs fingerprints no more bits than similarity."""
    rng, pairs, missed = random.Random(3), 0, 0
    for trial in range(400):
        words = [f"w{rng.randrange(9000)}" + ("x" * rng.choice([0, 0, 0, 30])) for _ in range(rng.randint(80, 170))]
        other = list(words)
        for at in rng.sample(range(len(words)), rng.randint(1, 5)):
            other[at] = f"{trial}_{at}" + "y" * (len(words[at]) - 4)
        item, text = " ".join(words), " ".join(other)
        if 0.8 <= alike(plain(item)[0], plain(text)[0]) < 0.86:
            pairs += 1
            missed += 0 not in next(decontam.Index((item,)).all_matches([text]))
    assert pairs > 40 and missed <= 0.01 * pairs


def test_very_long_repeated_and_null(spark):
    rng = random.Random(9)
    item = " ".join(f"q{rng.randrange(999)}" for _ in range(40))
    long = " ".join(f"w{i}" for i in range(200_000))
    docs = spark.createDataFrame([(1, f"{long} {item} {long}"), (1, f"{long} {item} {long}"), (None, item), (4, None), (5, long)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item, 0), (7, item, 0), (8, item, 0), (None, item, 0), (9, None, 0)], "item_id long, text string, similarity int")
    got = sorted((str(r.doc_id), str(r.item_id), r.similarity, r.window_start) for r in decontam.contaminated(docs, items).collect())
    assert got == sorted((d, i, 1.0, 0 if d == "None" else 200_000) for d in ("1", "1", "None") for i in ("7", "8", "None"))
    assert sorted(r.doc_id for r in decontam.drop_contaminated(docs, items).collect()) == [4, 5]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(docs, items).count() == 0
    assert decontam.drop_contaminated(docs, items).count() == 1
    assert decontam.contaminated(docs.where("false"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_indexes_are_built_once_for_any_number_of_items(monkeypatch):
    import pyarrow as pa

    built = []
    monkeypatch.setattr(decontam, "Index", lambda texts: built.append(texts) or type("None_", (), {"matches_in": lambda self, held: [{} for _ in range(3)]})())
    blocks = [(f"item {i}",) for i in range(10)]
    batches = [pa.RecordBatch.from_arrays([pa.array(["a", "b", "c"])], names=["t"]) for _ in range(6)]
    for _ in range(2):
        assert len(list(decontam._by_batch("job", blocks, iter(batches), "t"))) == 6
    assert len(built) == 10
    list(decontam._by_batch("another job", blocks[:1], iter(batches), "t"))
    assert len(built) == 11 and list(decontam._HELD) == ["another job"]

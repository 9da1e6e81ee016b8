"""Near copies batch by batch against the rule in plain Python."""

import random

from skerry.operators import minhash


def grouped(texts, before, threshold=0.8):
    """duplicate_of of each document, by the rule over all documents so far: {id: id or None}."""
    signed = {d: minhash.signature(s) for d, t in texts.items() if len(s := minhash.text_shingles(t)) >= minhash.MIN_SHINGLES}
    up = {d: d for d in signed}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    buckets = {}
    for d, s in signed.items():
        for b in range(0, minhash.SLOTS, minhash.BAND):
            buckets.setdefault((b, tuple(s[b : b + minhash.BAND])), []).append(d)
    for members in buckets.values():
        for i, x in enumerate(members):
            for y in members[i + 1 :]:
                if (signed[x] == signed[y]).mean() >= threshold:
                    up[root(x)] = root(y)
    groups = {}
    for d in signed:
        groups.setdefault(root(d), []).append(d)
    out = {d: before.get(d) for d in texts}
    standing = {r for r in before.values() if r is not None}
    for members in groups.values():
        if len(members) > 1:
            settled = sorted({before[m] for m in members if before.get(m)} | (standing & set(members)))
            target = settled[0] if settled else min(members)
            for m in members:
                if m != target and out[m] is None and m not in standing:
                    out[m] = target
    return out


def test_batches_follow_the_rule_and_sign_nothing_twice(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(300)]
    stories = [[rng.choice(words) for _ in range(60)] for _ in range(8)]
    texts = {}
    ids = list(range(120))
    rng.shuffle(ids)
    for n, d in enumerate(ids):
        story = list(stories[n % 8])
        for _ in range(rng.choice((0, 0, 1, 2, 5))):  # some drift so far that only others link them
            story[rng.randrange(60)] = rng.choice(words)
        if n % 8 == 7 and n > 60:
            story = stories[0][:30] + stories[1][30:]  # half of one and half of another
        texts[d] = " ".join(story) if n % 11 else rng.choice(["too short", "", None])
    signed = []
    whole = minhash.signatures
    monkeypatch.setattr(minhash, "signatures", lambda df: signed.append(df.count()) or whole(df))
    index = minhash.CopyIndex(spark, f"file://{tmp_path}/index")
    seen, state = {}, {}
    for k in range(5):
        batch = ids[k * 24 : (k + 1) * 24]
        rows = [(d, texts[d]) for d in batch + ids[:3] * (k > 0)]  # some come again
        seen |= {d: texts[d] for d in batch}
        got = index.add(spark.createDataFrame(rows, "document_id long, body string"), f"b{k}")
        state = grouped(seen, state)
        assert {r.document_id: r.duplicate_of for r in got.collect()} == state, k
    assert signed == [24] * 5
    assert sum(v is not None for v in state.values()) > 40
    again = index.add(spark.createDataFrame([(999, "x")], "document_id long, body string"), "b2")
    assert again.count() == 120 and index.batches() == [f"b{k}" for k in range(5)]


def test_a_batch_that_died_is_taken_in_anew(spark, tmp_path, monkeypatch):
    text = " ".join(f"w{i}" for i in range(50))
    index = minhash.CopyIndex(spark, f"file://{tmp_path}/index")
    index.add(spark.createDataFrame([(5, text)], "document_id long, body string"), "one")
    later = spark.createDataFrame([(2, text), (9, text)], "document_id long, body string")
    with monkeypatch.context() as m:
        m.setattr(minhash.KeyedTable, "insert", lambda *a: 1 / 0)
        try:
            index.add(later, "two")
        except ZeroDivisionError:
            pass
    assert index.batches() == ["one"]
    got = {r.document_id: r.duplicate_of for r in index.add(later, "two").collect()}
    assert got == {5: 2, 2: None, 9: 2}
    third = index.add(spark.createDataFrame([(1, text)], "document_id long, body string"), "three")
    assert {r.document_id: r.duplicate_of for r in third.collect()} == {5: 2, 2: None, 9: 2, 1: 2}, "a representative stays one"

"""Near-duplicate embeddings against brute force."""

import math

import numpy as np
import pytest

from skerry.llm import caps, queries


def brute(rows, threshold=0.95):
    """(id, links, component, kept) of each row."""
    vectors = []
    for key, v in rows:
        good = key is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        if good:
            v = np.array(v, float)
            v = v / np.abs(v).max()
            v = v / np.linalg.norm(v)
        vectors.append(v if good else None)
    n = len(rows)
    linked = np.zeros((n, n), bool)
    for d in {len(v) for v in vectors if v is not None}:
        at = [i for i in range(n) if vectors[i] is not None and len(vectors[i]) == d]
        x = np.array([vectors[i] for i in at])
        linked[np.ix_(at, at)] = x @ x.T >= threshold
    np.fill_diagonal(linked, False)
    component = np.arange(n)
    label = [r[0] for r in rows]
    for i in range(n):  # spread the smallest id
        if component[i] != i or label[i] is None:
            continue
        seen, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(linked[todo.pop()]):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min(rows[k][0] for k in seen)
        for k in seen:
            component[k], label[k] = i, least
    return sorted(((k, int(linked[i].sum()), label[i], label[i] is not None and label[i] == k) for i, (k, _) in enumerate(rows)), key=str)


def collected(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def clusters(rng, dim, sizes, spread):
    out = []
    for size in sizes:
        centre = rng.standard_normal(dim)
        centre /= np.linalg.norm(centre)
        noise = rng.standard_normal((size, dim)) / math.sqrt(dim)
        out.append(centre + noise * rng.uniform(0, spread, (size, 1)))
    return np.concatenate(out)


def test_all_embeddings(spark, sf_dir):
    table = queries.table(spark, sf_dir, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert collected(queries.QUERIES["op12_embedding_near_duplicates"](spark, sf_dir)) == brute(rows)


@pytest.mark.parametrize("dim", [1, 2, 3, 7, 16, 33, 64, 200])
def test_any_dimension(spark, dim):
    """Nearly all links are found: at 64 dimensions or more, none of ten thousands is lost here; fewer dimensions have wider caps to cover."""
    rng = np.random.default_rng(dim)
    x = clusters(rng, dim, [1] * 200 + [2] * 60 + [5] * 20 + [40, 90], 0.33)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = collected(caps.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    want = brute(rows)
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True)), "a link below the threshold"
    assert found >= (0.999 if dim >= 16 else 0.97) * there and there > 500


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal(64)
    near = (base + 0.1 * rng.standard_normal(64)).tolist()
    other = rng.standard_normal(64).tolist()
    base = base.tolist()
    rows = [
        (9, base), (4, base), (4, base), (7, near), (2, other), (2, near), (None, base), (11, None), (12, []), (13, [0.0] * 64), (14, [-0.0] * 64),
        (15, [None, *base[1:]]), (16, [math.nan, *base[1:]]), (17, [math.inf, *base[1:]]), (18, base[:32]), (19, base[:32]), (20, [x * 1e300 for x in base]),
        (21, [x * 1e-300 for x in base]), (22, [-x for x in base]), (3, [*base[:1], *[0.0] * 63]), (5, [*base[:1], *[-0.0] * 63]),
    ]
    docs = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "vec_id long, embedding array<double>, label int, vec string, N double")
    assert collected(caps.near_duplicates(docs)) == brute(rows)
    assert collected(caps.near_duplicates(docs.where("false"))) == []
    whole = [(1, [3, 4]), (2, [4, 3]), (3, [30, 41]), (4, [-3, 4])]
    assert collected(caps.near_duplicates(spark.createDataFrame(whole, "vec_id long, embedding array<int>"))) == brute(whole)


def test_large_groups_go_by_blocks_and_tiles(spark, monkeypatch):
    """A group of near copies, a chain of links, and small limits, so that all ways of comparing are taken."""
    rng = np.random.default_rng(4)
    x = clusters(rng, 64, [700, 300, *[3] * 50], 0.42)
    turn = np.linspace(0, 3, 400)[:, None]
    a, b = rng.standard_normal((2, 64))
    x = np.concatenate([x, np.cos(turn) * a / np.linalg.norm(a) + np.sin(turn) * b / np.linalg.norm(b)])
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(x)), x, strict=True)] + [(5000 + i, x[0].tolist()) for i in range(50)]
    want = brute(rows)
    monkeypatch.setattr(caps, "BLOCK", 100)
    got = collected(caps.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    lost = sum(b[1] - a[1] for a, b in zip(got, want, strict=True))
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True))
    assert lost <= 0.0005 * sum(r[1] for r in want)
    assert [(r[0], r[2], r[3]) for r in got] == [(r[0], r[2], r[3]) for r in want]


def test_lists_are_decoded_to_the_highest_sums():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((20, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    size, tables = caps._codes(64)
    got = caps.decoded(x).reshape(20, caps.TABLES, caps.NEAREST)
    for t, (turn, first, second) in enumerate(tables):
        y = x @ turn
        sums = ((y[:, :32] @ first)[:, :, None] + (y[:, 32:] @ second)[:, None, :]).reshape(20, -1)
        want = np.sort(np.argsort(-sums, axis=1)[:, : caps.NEAREST], axis=1)
        assert (np.sort(got[:, t] % (size * size), axis=1) == want).all()

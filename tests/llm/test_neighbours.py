import numpy as np

from codeweft.llm import neighbours as nb


def brute(ids, x, k=5):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -2)
    pairs = set()
    for r, i in enumerate(ids):
        for c in np.lexsort((ids, -s[r]))[: min(k, len(ids) - 1)]:
            pairs.add((min(i, ids[c]), max(i, ids[c])))
    return {(int(a), int(b)) for a, b in pairs}


def frame(spark, ids, x, extra=()):
    rows = [(int(i), [float(v) for v in r], "x") for i, r in zip(ids, x)] + list(extra)
    return spark.createDataFrame(rows, "node_id long, vec array<float>, node string")


def clustered(rng, n, centres=12, noise=0.25, dim=64):
    c = rng.standard_normal((centres, dim))
    x = c[rng.integers(0, centres, n)] / 8 + noise * rng.standard_normal((n, dim)) / 8
    return x.astype(np.float32).astype(np.float64)


def test_small_collections_are_exact_and_unusable_vectors_take_no_part(spark):
    rng = np.random.default_rng(3)
    x = clustered(rng, 150)
    ids = rng.permutation(1000)[:150]
    bad = [(2001, None, "x"), (2002, [0.0] * 64, "x"), (2003, [1.0] * 63, "x"), (2004, [float("nan")] + [1.0] * 63, "x"), (2005, [float("inf")] * 64, "x"), (None, [1.0] * 64, "x")]
    df = frame(spark, ids, x, bad)
    got = {tuple(r) for r in nb.neighbour_pairs(nb.nearest(df.union(df))).collect()}
    assert got == brute(ids, x)


def test_recall_of_the_search_with_many_arrays(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x, ids = clustered(rng, 3000, 40), np.arange(3000)
    monkeypatch.setattr(nb, "PER_ARRAY", 60)
    got = {tuple(r) for r in nb.neighbour_pairs(nb.nearest(frame(spark, ids, x))).collect()}
    want = brute(ids, x)
    assert len(got & want) / len(want) >= 0.95


def test_blocks_of_a_crowded_array_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x, ids = clustered(rng, 300), np.arange(300)
    monkeypatch.setattr(nb, "BLOCK", 70)
    got = {tuple(r) for r in nb.neighbour_pairs(nb.nearest(frame(spark, ids, x))).collect()}
    assert got == brute(ids, x)


def test_many_nodes_with_one_vector(spark):
    rng = np.random.default_rng(7)
    x = clustered(rng, 60)
    x[20:] = x[20]
    ids = np.arange(60)[::-1].copy()
    got = {tuple(r) for r in nb.neighbour_pairs(nb.nearest(frame(spark, ids, x))).collect()}
    assert got == brute(ids, x)


def test_two_large_groups_that_are_multiples_of_each_other(spark):
    rng = np.random.default_rng(11)
    v, rest = rng.standard_normal(64).astype(np.float32).astype(np.float64), clustered(rng, 20)
    ids = np.concatenate([np.arange(100, 112), np.arange(1, 10), np.arange(50, 70)])
    x = np.concatenate([np.tile(v, (12, 1)), np.tile(2 * v, (9, 1)), rest])
    near = nb.nearest(frame(spark, ids, x))
    assert {tuple(r) for r in nb.neighbour_pairs(near).collect()} == brute(ids, x)
    got = {r["node"]: [n["id"] for n in r["near"]] for r in near.collect()}
    assert got[111] == [1, 2, 3, 4, 5] and got[9] == [1, 2, 3, 4, 5]


def test_empty_and_lonely(spark):
    df = frame(spark, [1], np.ones((1, 64)))
    assert nb.nearest(df).count() == 0 and nb.nearest(df.limit(0)).count() == 0


def test_windows_double_until_the_neighbours_are_near_enough():
    rng = np.random.default_rng(8)
    x = nb._unit(rng.standard_normal((400, 64)))  # nothing is near: every window has to open
    every = np.ones(400, dtype=bool)
    q, t, s, asked, verified = nb.search(np.arange(400), x, every, every)
    assert len(asked) == 400 and verified.min() >= 399
    assert len(q) == 2000 and {(min(a, b), max(a, b)) for a, b in zip(q.tolist(), t.tolist())} == brute(np.arange(400), x)

import numpy as np
import pytest
from pyspark.sql import functions as F

from curveboard.llm import hilbert, hyperplanes

SCHEMA = "vec_id long, embedding array<float>, label int, n int, component_id string, rank string"


def frame(spark, vectors, labels, ids=None):
    ids = ids or range(len(vectors))
    rows = [
        (int(i), None if v is None else [None if x is None else float(x) for x in v], label, 1, "x", "y")
        for i, v, label in zip(ids, vectors, labels, strict=True)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def clustered(n, dims=16, seed=0, noise=0.02):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 6, dims))
    x = base[rng.integers(0, len(base), n)] + noise * rng.standard_normal((n, dims)) * np.linalg.norm(base, axis=1).mean()
    return x.astype(np.float32)


def brute_links(x, labels, threshold=0.93):
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = (u @ u.T >= threshold) & (labels[:, None] == labels)
    np.fill_diagonal(link, False)
    c = np.arange(len(x))
    while True:
        new = np.minimum(c, np.where(link, c, len(x)).min(axis=1))
        if (new == c).all():
            return link.sum(axis=1), c
        c = new


@pytest.mark.parametrize("block_rows", [1024, 7])
def test_links_equal_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(hyperplanes, "BLOCK_ROWS", block_rows)
    x = np.concatenate((clustered(400), clustered(400)[:30]))
    labels = np.random.default_rng(1).integers(0, 3, len(x))
    n, component = brute_links(x, labels)
    out = hyperplanes.near_vectors(frame(spark, x, labels.tolist()).repartition(5)).orderBy("vec_id").collect()
    assert [r.n_links for r in out] == n.tolist()
    assert [r.component_id for r in out] == component.tolist()
    assert all(r.kept == (r.component_id == r.vec_id) for r in out)


def test_odd_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1, 0], [1, 0.01], None, [0, 0], [nan, 1], [inf, 1], [None, 1], [1, 0], [1, 0], [2, 0], []]
    labels = [1, 1, 1, 1, 1, 1, 1, None, 2, 1, 1]
    out = {r.vec_id: (r.n_links, r.component_id) for r in hyperplanes.near_vectors(frame(spark, vectors, labels)).collect()}
    alone = {i: (0, i) for i in range(2, 9)} | {10: (0, 10)}
    assert out == {0: (2, 0), 1: (2, 0), 9: (2, 0)} | alone
    assert hyperplanes.near_vectors(frame(spark, [], [])).count() == 0
    only_bad = hyperplanes.near_vectors(frame(spark, [None, [0, 0]], [1, 1]))
    assert sorted(r.n_links for r in only_bad.collect()) == [0, 0]


def test_repeated_ids_stay_rows(spark):
    vectors = [[1, 0], [1, 0], [0, 1], [1, 0.01], [0, 1], None]
    ids = [5, 5, 5, 8, 3, 8]
    out = hyperplanes.near_vectors(frame(spark, vectors, [1] * 6, ids)).collect()
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out)
    assert got == [
        (3, 1, 3, True), (5, 1, 3, False), (5, 2, 5, False), (5, 2, 5, True), (8, 0, 8, True), (8, 2, 5, False),
    ]


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (5, 2)])
def test_consecutive_keys_are_neighbouring_cells(dims, bits):
    side = 1 << bits
    cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    keys = hilbert.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(side**dims))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_neighbours_reach_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 64)).astype(np.float32)
    out = hilbert.nearest_vectors(frame(spark, x, [0] * len(x)).repartition(6), F.col("id") % 100 == 0).collect()
    hits = 0
    for q in range(0, len(x), 100):
        own = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == q)
        assert [r for r, _, _ in own] == list(range(1, 11))
        d = np.sqrt(((x.astype(float) - x[q]) ** 2).sum(axis=1))
        assert all(abs(d[v] - s) < 1e-12 for _, v, s in own) and q not in {v for _, v, _ in own}
        d[q] = np.inf
        hits += len({v for _, v, _ in own} & set(np.argsort(d)[:10].tolist()))
    assert hits / (10 * 30) >= 0.9


def test_few_rows_ties_and_odd_vectors(spark):
    vectors = [[1, 0], [1, 0], [1, 0], None, [0, 0], [float("nan"), 1], [0, 3]]
    out = hilbert.nearest_vectors(frame(spark, vectors, [1] * 7), F.col("id") % 2 == 0).collect()
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in out)
    far = round(10**0.5, 6)
    assert got == [
        (0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 6, far),
        (2, 1, 0, 0.0), (2, 2, 1, 0.0), (2, 3, 6, far),
        (6, 1, 0, far), (6, 2, 1, far), (6, 3, 2, far),
    ]
    assert hilbert.nearest_vectors(frame(spark, [], []), F.lit(True)).count() == 0


def test_repeated_query_rows_and_many_copies(spark):
    """Copies of a vector give the smallest ids, a row given twice does not shorten the list."""
    rng = np.random.default_rng(4)
    x = np.concatenate([np.tile(rng.standard_normal(8), (400, 1)), rng.standard_normal((200, 8))])
    ids = [*range(600)]
    rows = frame(spark, [*x, x[0], x[100], x[500]], [0] * 603, [*ids, 0, 100, 500])
    out = hilbert.nearest_vectors(rows, F.col("id") % 100 == 0).collect()
    by = {}
    for r in out:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert sorted(by) == [0, 100, 200, 300, 400, 500]
    assert all([a for a, _ in sorted(v)] == list(range(1, 11)) for v in by.values())
    assert [i for _, i in sorted(by[0])] == list(range(1, 11))
    assert [i for _, i in sorted(by[300])] == list(range(10))


def test_windows_are_searched_in_blocks(spark, monkeypatch):
    """Small blocks and windows: every hit lies in a window of its query, as brute force over them finds."""
    monkeypatch.setattr(hilbert, "BLOCK_ROWS", 16)
    monkeypatch.setattr(hilbert, "LEAST", 20)
    monkeypatch.setattr(hilbert, "SCALE", 0.0)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 12))
    out = hilbert.nearest_vectors(frame(spark, x, [0] * 300), F.col("id") % 50 == 0).collect()
    x = x.astype(np.float32).astype(float)
    # any row order gives the same curves: they depend on the fitted centre and scale alone
    k = hilbert.keys(x, hilbert.curves(x, 48, 16, 3, 29))
    near = 0
    for q in range(0, 300, 50):
        mark = np.zeros(300, bool)
        for key in k:
            place = np.argsort(key, kind="stable")
            at = int(np.flatnonzero(place == q)[0])
            mark[place[max(0, at - 22) : at + 23]] = True
        mark[q] = False
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        own = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == q)
        assert all(abs(d[v] - s) < 1e-9 for _, v, s in own)
        near += len({v for _, v, _ in own} & set(np.argsort(np.where(mark, d, np.inf))[:10].tolist()))
    assert near >= 0.9 * 60

"""Models of several datasets in one job against plain fits of each."""

import numpy as np
import pytest

from curveboard.operators import categorize, grouped

SCHEMA = "dataset int, sample_id long, features array<double>, label int"


@pytest.fixture(scope="module")
def sets(spark):
    """Three datasets of different sizes, one with two thirds of the rows; ids overlap."""
    rng = np.random.default_rng(7)
    out = {}
    for d, (n, dims, k) in enumerate([(260, 4, 3), (90, 3, 2), (40, 5, 4)]):
        centre = rng.normal(scale=4, size=(k, dims))
        label = rng.integers(0, k, n)
        out[d] = (centre[label] + rng.normal(size=(n, dims)), label)
    rows = [(d, i, x[i].tolist(), int(y[i])) for d, (x, y) in out.items() for i in range(len(x))]
    rows += [(1, 900, None, 0)]
    return out, spark.createDataFrame(rows, SCHEMA), spark


def states(models):
    return {r.dataset: grouped.unpack(r.state) for r in models.collect()}


def test_kmeans_equals_plain_lloyd(sets):
    data, df, spark = sets
    cut = grouped.blocks(df, rows=37)
    assert cut.count() > 10
    ks = spark.createDataFrame([(0, 8), (1, 4), (2, 3)], "dataset int, k int")
    begin = grouped.kmeans(cut, ks, rounds=0)
    assert {d: len(s["centres"]) for d, s in states(begin).items()} == {0: 8, 1: 4, 2: 3}
    models = grouped.lloyd(cut, begin, rounds=6, tolerance=0.0)
    for d, s in states(begin).items():
        x, c = data[d][0], s["centres"]
        for _ in range(6):
            own = grouped.squares(x, c).argmin(axis=1)
            c = np.stack([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        assert np.allclose(states(models)[d]["centres"], c)
        gaps = {r.sample_id: r.distance for r in grouped.to_centres(cut, models).filter(f"dataset = {d}").collect()}
        want = np.sqrt(grouped.squares(x, c).min(axis=1))
        assert np.allclose([gaps[i] for i in range(len(x))], want, atol=1e-6)


def test_seeds_spread_over_clusters(sets):
    data, df, spark = sets
    ks = spark.createDataFrame([(0, 3), (1, 2), (2, 4)], "dataset int, k int")
    models = grouped.kmeans(grouped.blocks(df), ks)
    for d, s in states(models).items():
        x, label = data[d]
        own = grouped.squares(x, s["centres"]).argmin(axis=1)
        assert len({(a, b) for a, b in zip(own, label)}) <= len(set(label)) + 4


def test_linear_machines_reach_the_minimum(sets):
    """The gradient of every class's own loss vanishes at the weights found together."""
    data, df, _ = sets
    cut = grouped.blocks(df, rows=50)
    models = grouped.linear_machines(cut, ridge=0.05)
    for d, s in states(models).items():
        x, label = data[d]
        a = grouped.design(x, s)
        assert np.allclose(s["mean"], x.mean(axis=0)) and np.allclose(s["spread"], x.std(axis=0))
        for c, w in zip(s["classes"], s["w"]):
            y = np.where(label == c, 1.0, -1.0)
            gap = np.maximum(1 - y * (a @ w), 0)
            slope = -2 * (a.T @ (y * gap)) / len(x) + 0.05 * np.append(w[:-1], 0)
            assert np.abs(slope).max() < 1e-5
        right = s["classes"][(a @ s["w"].T).argmax(axis=1)] == label
        assert right.mean() > 0.9
    values = categorize.boundary_closeness(df).collect()
    assert len(values) == 390 and all(r.value >= 0 for r in values)


def test_fold_models_equal_a_fit_per_fold(sets):
    """Every seed and fold of three datasets, from sums, against fits on the rows outside the fold."""
    data, df, _ = sets
    seeds, folds, steps, ridge = 2, 4, 25, 0.01
    cut = grouped.blocks(df, rows=60)
    models = grouped.fold_models(cut, seeds, folds, steps, ridge)
    found = {(r.dataset, r.sample_id): r.value for r in grouped.held_out_certainty(cut, models, seeds, folds).collect()}
    for d, s in states(models).items():
        x, label = data[d]
        a, k = grouped.design(x, s), len(s["classes"])
        y, fold = grouped.one_hot(label.astype(float), s["classes"]), grouped.fold_of(list(range(len(x))), seeds, folds)
        total = np.zeros(len(x))
        for seed in range(seeds):
            for f in range(folds):
                own, m = fold[:, seed] == f, seed * folds + f
                train, plain = a[~own], a[:, :-1]
                mean = np.stack([plain[~own][y[~own][:, c] > 0].mean(axis=0) for c in range(k)])
                var = np.stack([plain[~own][y[~own][:, c] > 0].var(axis=0) for c in range(k)])
                assert np.allclose(s["means"][m], mean) and np.allclose(s["variance"][m], var, atol=1e-6)
                prior = np.log(y[~own].mean(axis=0))
                rest = plain[~own] - mean[y[~own].argmax(axis=1)]
                axes = np.linalg.solve(rest.T @ rest / len(train) + ridge * np.eye(rest.shape[1]), mean.T).T
                w, inverse = np.zeros((k, a.shape[1])), np.linalg.inv(0.5 * train.T @ train / len(train) + ridge * np.eye(a.shape[1]))
                losses = []
                for _ in range(steps):
                    p = grouped.softmax(train @ w.T)
                    losses.append(-np.log(p[y[~own] > 0]).sum() / len(train) + 0.5 * ridge * (w**2).sum())
                    w = w - (((p - y[~own]).T @ train) / len(train) + ridge * w) @ inverse
                assert all(b <= a + 1e-12 for a, b in zip(losses, losses[1:]))
                assert np.allclose(s["w"][m], w, atol=1e-8)
                b = plain[own]
                gap = ((b[:, None] - mean) ** 2 / s["variance"][m] + np.log(s["variance"][m])).sum(axis=2)
                line = b @ axes.T - 0.5 * (axes * mean).sum(axis=1)
                for scores in (prior - 0.5 * gap, prior + line, a[own] @ w.T):
                    total[own] += grouped.softmax(scores).max(axis=1)
        assert np.allclose([found[d, i] for i in range(len(x))], total, atol=1e-6)


def test_categorisers_take_all_datasets(sets):
    _, df, _ = sets
    for run in (categorize.cluster_center_closeness, lambda s: categorize.average_uncertainty(s, 2, 3, 4)):
        out = run(df).collect()
        assert len(out) == 390 and {r.dataset for r in out} == {0, 1, 2}
        assert all(np.isfinite(r.value) and r.value >= 0 for r in out)

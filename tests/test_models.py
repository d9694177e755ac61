"""Operators without a SQL check, on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curveboard.operators import categorize, leaderboard, neighbours, pool, scenarios
from curveboard.plans.testbed import Tables

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SMALL)


@pytest.fixture(scope="module")
def blobs(spark):
    """Three tight clusters of forty points and one far outlier."""
    rng = np.random.default_rng(1)
    centers = np.array([[0.0, 5.0], [5.0, 0.0], [5.0, 5.0]])
    points = np.concatenate([c + rng.normal(scale=0.2, size=(40, 2)) for c in centers])
    rows = [(0, i, p.tolist(), i // 40) for i, p in enumerate(points)]
    rows.append((0, 120, [60.0, -40.0], 0))
    return spark.createDataFrame(
        rows, "dataset int, sample_id long, features array<double>, label int"
    )


def test_outlier_is_flagged_most(blobs):
    out = {r["sample_id"]: r["value"] for r in categorize.outlierness(blobs, block_rows=50).collect()}
    assert len(out) == 121
    assert out[120] == max(out.values()) and out[120] > 0
    again = {r["sample_id"]: r["value"] for r in categorize.outlierness(blobs.repartition(3)).collect()}
    assert again == out


def test_kmeans_closeness_sums_to_its_scale(blobs):
    out = categorize.cluster_center_closeness(blobs).collect()
    k = max(2, int(np.sqrt(121) / 2))
    assert sum(r["value"] for r in out) == pytest.approx(100 * k)


def test_uncertainty_and_boundary(blobs):
    for out in (
        categorize.average_uncertainty(blobs, seeds=1, folds=2),
        categorize.boundary_closeness(blobs),
    ):
        rows = out.collect()
        assert len(rows) == 121 and all(r["value"] >= 0 for r in rows)


def test_kmeans_batch_spreads_over_clusters(blobs):
    inner = blobs.filter("sample_id < 120")
    out = [r["sample_id"] for r in pool.embedding_kmeans(inner, 3).collect()]
    assert {i // 40 for i in out} == {0, 1, 2}


def test_discriminative_avoids_the_labelled_cluster(blobs):
    inner = blobs.filter("sample_id < 120").select("sample_id", "features")
    labelled = inner.filter("sample_id < 30")
    out = [r["sample_id"] for r in pool.discriminative(inner, labelled, 20).collect()]
    assert len(out) == 20 and all(i >= 40 for i in out)


def test_graph_density_matches_plain_greedy(blobs):
    inner = blobs.filter("sample_id < 120")
    got = [r["sample_id"] for r in pool.graph_density(inner, 4, k_neighbours=5).collect()]
    near = neighbours.knn(inner, k=5).toPandas()
    w = np.zeros((120, 120))
    for q, n, d in zip(near["query_id"], near["neighbour_id"], near["distance"]):
        w[q, n] = max(w[q, n], 1 - d)
        w[n, q] = max(w[n, q], 1 - d)
    edges = w > 0
    density = w.sum(axis=1) / edges.sum(axis=1)
    want = []
    for _ in range(4):
        i = int(np.round(density, 12).argmax())
        want.append(i)
        density[edges[i]] -= density[i]
        density[i] = -np.inf
    assert got == want


def test_cubic_trend_matches_least_squares(spark):
    rng = np.random.default_rng(0)
    x = np.arange(30) / 10
    y = 1 + 2 * x - 0.5 * x**2 + 0.1 * x**3 + rng.normal(scale=0.01, size=30)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "k double, tau double")
    got = [r["coefficient"] for r in scenarios.cubic_trend(df, "k", "tau").orderBy("power").collect()]
    assert np.allclose(got, np.polyfit(x, y, 3)[::-1], atol=1e-6)


def test_budget_scenarios_equal_plain_filters(tables):
    """Each scenario's totals are those of the runs its drawn lists allow."""
    limits = {"dataset": 20, "start_point": 19, "bucket": 5, "batch": 3, "learner": 2}
    rows = tables.spark.createDataFrame([(i, 50 * (i + 1)) for i in range(4)], "scenario int, budget int")
    got = {
        (r["scenario"], r["strategy"]): r["total"]
        for r in scenarios.budget_scenarios(tables.runs, rows, limits, seed=3, attempts=1).collect()
        if r["strategy"] is not None
    }
    subsets = scenarios.random_subsets(
        rows.withColumn("attempt", F.lit(0)), tables.runs.select(*limits).distinct(), list(limits), limits, 3
    ).collect()
    seen = set()
    for s in subsets:
        kept = tables.runs
        for p in limits:
            if s[f"only_{p}"] is not None:
                kept = kept.filter(F.col(p).cast("string").isin(s[f"only_{p}"]))
        board = leaderboard.board(
            kept, interpolation="average_of_same_strategy", normalisation="robust"
        )
        for r in leaderboard.totals(board).collect():
            assert got[s["scenario"], r["strategy"]] == pytest.approx(r["total"])
            seen.add((s["scenario"], r["strategy"]))
    assert seen == set(got)


def test_scenarios_without_scores_come_out_unresolved(tables):
    """A budget of one setting per parameter hardly ever meets a run; nothing vanishes."""
    rows = tables.spark.createDataFrame([(i, 1) for i in range(6)], "scenario int, budget int")
    limits = {"dataset": 1, "start_point": 1, "bucket": 1, "batch": 1, "learner": 1}
    few = tables.runs.limit(3)
    out = scenarios.budget_scenarios(few, rows, limits, seed=1, attempts=1).collect()
    assert {r["scenario"] for r in out} == set(range(6))
    assert all((r["total"] is None) == (r["strategy"] is None) for r in out)


def test_k_center_coreset_covers_the_pool(spark, monkeypatch):
    """Radius within twice the plain greedy one, over many blocks, with ties and repeated points."""
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(scale=0.3, size=(80, 3)) + 6 * rng.normal(size=3) for _ in range(6)])
    points = np.concatenate([points, points[:40], np.round(points[:20])])
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "sample_id long, features array<double>")
    labelled = rows.filter("sample_id < 3")

    def radius(chosen):
        centre = points[[0, 1, 2, *chosen]]
        return np.sqrt(((points[:, None] - centre) ** 2).sum(axis=2)).min(axis=1).max()

    plain = [r.sample_id for r in pool.k_center(rows, labelled, 8).orderBy("round").collect()]
    for most in (1 << 20, 25):
        out = pool.k_center_coreset(rows, labelled, 8, most).orderBy("round").collect()
        chosen = [r.sample_id for r in out]
        assert len(set(chosen)) == 8 and not set(chosen) & {0, 1, 2}
        assert radius(chosen) <= 2 * radius(plain) + 1e-9
        assert [r.distance for r in out] == sorted((r.distance for r in out), reverse=True)


def test_exact_significance_of_tau(spark):
    """p against all orders of few items; tabulated 5 % points of larger ones."""
    import itertools
    import math

    from curveboard.operators import similarity

    table = {(r.n, r.c): r.p for r in similarity.inversion_table(spark).collect()}
    for n in range(1, 7):
        counts = [sum(a > b for a, b in itertools.combinations(p, 2)) for p in itertools.permutations(range(n))]
        for c in range(n * (n - 1) // 2 + 1):
            assert table[n, c] == pytest.approx(sum(x <= c for x in counts) / math.factorial(n))
    # fixed values: least con - dis with a two-sided chance of at most 5 %
    for n, score in ((5, 10), (6, 13), (7, 15), (8, 18), (9, 20), (10, 23), (20, 62), (30, 111)):
        least = next(s for s in range(n * (n - 1) // 2 % 2, 500, 2) if 2 * table[n, (n * (n - 1) // 2 - s) // 2] <= 0.05)
        assert least == score
    rows = [(0, i, float(i), float(i)) for i in range(8)] + [(1, i, float(i), float(i * 37 % 11)) for i in range(8)]
    rows += [(2, i, float(i // 2), float(i)) for i in range(12)]
    out = {r.k: r for r in similarity.tau_significance(spark.createDataFrame(rows, "k int, i int, x double, y double"), ["k"]).collect()}
    assert out[0].p == pytest.approx(2 / math.factorial(8)) and out[0].significant
    assert out[1].p > 0.05 and not out[1].significant
    assert out[2].p is None and out[2].significant


def test_long_tau_equals_the_short_one(spark):
    from curveboard.operators import similarity

    rng = np.random.default_rng(4)
    rows = [(int(k), float(a), float(b)) for k, a, b in zip(rng.integers(0, 3, 900) ** 2, rng.integers(0, 9, 900), rng.integers(0, 30, 900) / 4)]
    df = spark.createDataFrame(rows, "k int, x double, y double")
    short = {r.k: r.tau for r in similarity.kendall(df, ["k"]).collect()}
    assert {r.k: r.tau for r in similarity.kendall_long(df, ["k"], chunk=3).collect()} == pytest.approx(short)

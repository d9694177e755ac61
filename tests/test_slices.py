"""Hot groups: sliced building blocks against plain computation."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from curveboard.functions import slices
from curveboard.operators import curves, neighbours, similarity


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds a third of all rows, another a single row."""
    rng = np.random.default_rng(5)
    keys = np.r_[np.zeros(1000), rng.integers(1, 200, 1999), [999]].astype(int)
    pdf = pd.DataFrame({"k": keys, "v": rng.normal(size=len(keys)).round(2), "id": range(len(keys))})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("large", [0, 100, 1 << 20])
def test_position(hot, monkeypatch, large):
    """All groups sliced, the hot one, or none."""
    monkeypatch.setattr(slices, "HOT_ROWS", large)
    pdf, df = hot
    got = slices.position(df, ["k"], F.floor("v"), ["v", "id"]).toPandas().set_index("id")["pos"]
    want = pdf.sort_values(["k", "v", "id"]).groupby("k").cumcount()
    want.index = pdf.sort_values(["k", "v", "id"])["id"]
    assert got.sort_index().tolist() == want.sort_index().tolist()


def test_hash_position_is_a_repeatable_permutation(hot):
    _, df = hot
    a = slices.hash_position(df, ["k"], [F.lit(3)], ["id"]).select("id", "k", "pos").toPandas()
    b = slices.hash_position(df.repartition(13), ["k"], [F.lit(3)], ["id"]).select("id", "k", "pos")
    merged = a.merge(b.toPandas(), on=["id", "k"])
    assert (merged["pos_x"] == merged["pos_y"]).all()
    for _, group in a.groupby("k"):
        assert sorted(group["pos"]) == list(range(len(group)))


def test_running(hot):
    pdf, df = hot
    out = slices.running(
        df, ["k"], F.floor(F.col("id") / 64), ["id"], {"s": ("sum", "v"), "m": ("max", "v")}
    ).toPandas().sort_values("id")
    groups = pdf.groupby("k")["v"]
    assert np.allclose(out["s"], groups.cumsum())
    assert np.allclose(out["m"], groups.cummax())


@pytest.mark.parametrize("margin", [0.002, 0.02])
def test_percentiles(hot, margin):
    pdf, df = hot
    probs = {"a": 0.25, "b": 0.5, "c": 0.975}
    big = df.filter("k = 0")
    got = slices.percentiles(big, ["k"], "v", probs, margin=margin).first()
    values = pdf[pdf["k"] == 0]["v"]
    for name, p in probs.items():
        assert got[name] == pytest.approx(np.quantile(values, p))
    every = slices.percentiles(df, ["k"], "v", probs).toPandas().set_index("k").sort_index()
    for name, p in probs.items():
        assert np.allclose(every[name], pdf.groupby("k")["v"].quantile(p).sort_index())


def test_percentiles_of_small_and_tied_groups(spark):
    """Every size from one value on, where a bracket is narrower than a rank."""
    rng = np.random.default_rng(8)
    rows = [(n, float(v)) for n in range(1, 60) for v in rng.integers(0, 9 if n % 2 else 10**6, n)]
    pdf = pd.DataFrame(rows, columns=["k", "v"])
    probs = {"a": 0.0, "b": 0.025, "c": 0.3, "d": 0.5, "e": 0.975, "f": 1.0}
    got = slices.percentiles(spark.createDataFrame(pdf), ["k"], "v", probs).toPandas().set_index("k").sort_index()
    for name, p in probs.items():
        assert np.allclose(got[name], pdf.groupby("k")["v"].quantile(p).sort_index())


def test_first_rows_merges_copies(spark):
    rows = spark.createDataFrame([(1, 5, "x")] * 500 + [(1, 4, "y"), (2, 1, None)], "k int, o int, s string")
    got = sorted(slices.first_rows(rows, ["k"], ["o"]).collect())
    assert [tuple(r) for r in got] == [(1, 4, "y"), (2, 1, None)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.one_of(st.none(), st.integers(0, 20)), min_size=1, max_size=23),
    st.integers(1, 6),
)
def test_framed_matches_pandas(spark, values, chunk):
    df = spark.createDataFrame(
        [(1, i, None if v is None else float(v)) for i, v in enumerate(values)],
        "run_id int, cycle int, value double",
    )
    out = slices.framed(df, chunk=chunk).orderBy("cycle").collect()
    n = len(values)
    seen = np.cumsum([v is not None for v in values])
    for i, row in enumerate(out):
        assert (row["ix"], row["width"], row["n"]) == (i, n, seen[-1])
        assert row["prev"] == (values[i - 1] if i else None)
        assert row["next"] == (values[i + 1] if i + 1 < n else None)
        if values[i] is not None:
            assert row["pos"] == seen[i] - 1


def test_long_curve_equals_short_chunks(spark):
    rng = np.random.default_rng(0)
    rows = [(r, i, float(v)) for r in range(3) for i, v in enumerate(rng.random(97))]
    c = spark.createDataFrame(rows, "run_id int, cycle int, value double")
    for compute in (curves.ramp_cutoffs, curves.biggest_drop, curves.trapezoid, curves.change_point):
        a = sorted(map(tuple, compute(c, chunk=7).collect()))
        b = sorted(map(tuple, compute(c).collect()))
        assert np.allclose(np.array(a, dtype=float), np.array(b, dtype=float))


def brute_tau(x, y):
    x, y = np.asarray(x), np.asarray(y)
    dx, dy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    scale = np.sqrt((dx**2).sum()) * np.sqrt((dy**2).sum())
    return (dx * dy).sum() / scale if scale else None


def test_kendall_short_and_long_paths(spark):
    rng = np.random.default_rng(2)
    sets = {k: (rng.integers(0, 9, 60), rng.integers(0, 12, 60)) for k in range(6)}
    rows = [(k, int(a), int(b)) for k, (x, y) in sets.items() for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "k int, x int, y int")
    short = {r["k"]: r["tau"] for r in similarity.kendall(df, ["k"]).collect()}
    ranked = df.groupBy("k", F.col("x").cast("long").alias("rx"), F.col("y").cast("long").alias("ry"))
    ranked = ranked.agg(F.count(F.lit(1)).alias("c"))
    long = {r["k"]: r["tau"] for r in similarity._tau_from_ranks(ranked, ["k"], 4).collect()}
    for k, (x, y) in sets.items():
        assert short[k] == pytest.approx(brute_tau(x, y))
        assert long[k] == pytest.approx(brute_tau(x, y))


@pytest.mark.parametrize("scope", ["all", "same", "other"])
def test_knn_blocks_against_brute_force(spark, scope):
    rng = np.random.default_rng(3)
    points, labels = rng.normal(size=(60, 5)), rng.integers(0, 3, 60)
    df = spark.createDataFrame(
        [(0, i, points[i].tolist(), int(labels[i])) for i in range(60)],
        "dataset int, sample_id long, features array<double>, label int",
    )
    got = neighbours.knn(df, k=4, scope=scope, cell_rows=9).toPandas()
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    distance = 1 - unit @ unit.T
    same = labels[:, None] == labels
    barred = np.eye(60, dtype=bool) | (scope == "same") & ~same | (scope == "other") & same
    distance[barred] = np.inf
    for i in range(60):
        mine = got[got["query_id"] == i].sort_values("rank")
        assert mine["neighbour_id"].tolist() == np.argsort(distance[i])[:4].tolist()


def test_curves_by_size_agree(hot, monkeypatch):
    """A hot curve in chunks and the others as windows give what windows give for all."""
    _, df = hot
    curve = df.select(F.col("k").alias("run_id"), F.col("id").alias("cycle"), F.col("v").alias("value"))
    each = {
        "drop": lambda: curves.biggest_drop(curve, chunk=64),
        "lag": lambda: curves.time_lag(curve, chunk=64),
        "ramp": lambda: curves.ramp_cutoffs(curve, chunk=64),
        "change": lambda: curves.change_point(curve, chunk=64),
        "stable": lambda: curves.learning_stability(curve, chunk=64),
        "area": lambda: curves.trapezoid(curve, chunk=64),
    }
    for name, run in each.items():
        plain = sorted(tuple(r) for r in run().collect())
        with monkeypatch.context() as m:
            m.setattr(slices, "HOT_ROWS", 100)
            sliced = sorted(tuple(r) for r in run().collect())
        assert len(plain) == len(sliced)
        for a, b in zip(plain, sliced):
            assert a == pytest.approx(b, abs=1e-9, nan_ok=True), name


def test_ordinary_groups_take_one_exchange(spark):
    """Without large groups only counts, rows and cutoffs are shuffled; the sliced branch is not run."""
    rows = [(i % 50, i // 50, float(i * 7 % 13)) for i in range(1000)]
    curve = spark.createDataFrame(rows, "run_id long, cycle long, value double")
    df = curves.curve_aggregates(curve, spark.createDataFrame([(1, 2.0)], "run_id long, cutoff double"))
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") <= 3

"""Invariants, scenario behaviour and plan shapes."""

import pytest
from pyspark.sql import functions as F

from curveboard.operators import (
    curate,
    grid,
    leaderboard,
    pool,
    prepare,
    registry,
    scenarios,
    series,
    similarity,
)
from curveboard.plans.queries import QUERIES
from curveboard.plans.testbed import Tables

SMALL = "/root/testdata/sf0.001"
# these fit models or loop, so building them already runs jobs
EAGER = ("K3", "K9", "K11", "Q8_k", "Q9", "Q11", "Q13", "R23_eliminate", "N6", "N10", "ST", "S9", "S11", "S12", "E12_app")


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SMALL)


def test_no_cross_join_in_any_plan(spark):
    for name, run in QUERIES.items():
        if not name.startswith(EAGER):
            plan = run(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan, name
            assert "BroadcastNestedLoopJoin" not in plan, name


def test_filters_and_columns_reach_the_scan(tables):
    df = tables.given("orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan
    accuracy = QUERIES["M10_time_totals"](tables.spark, SMALL)
    plan = accuracy._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_subtract_partitions_the_left_side(tables):
    runs = tables.runs
    done = runs.filter("status = 'done'")
    left = grid.subtract(runs, done)
    keys = ["dataset", "strategy", "learner", "batch", "start_point", "bucket"]
    matched = runs.join(done.select(*keys).distinct(), keys, "left_semi")
    assert left.count() + matched.count() == runs.count()
    assert left.join(matched, "run_id", "left_semi").count() == 0


def test_correlation_matrices_are_symmetric(tables):
    m = similarity.pearson_matrix(tables.full_mean, "strategy", "fingerprint").collect()
    r = {(x["x"], x["y"]): x["r"] for x in m}
    assert all(r[a, b] == pytest.approx(r[b, a]) for a, b in r)
    assert all(r[a, a] == pytest.approx(1) for a, _ in r)
    vectors = tables.runs.groupBy("batch", "strategy").agg(F.avg("value").alias("total"))
    t = {(x["x_name"], x["y_name"]): x["tau"] for x in similarity.kendall_matrix(vectors, "batch", "strategy").collect()}
    assert all(t[a, a] == pytest.approx(1) and t[a, b] == t[b, a] for a, b in t)


def test_pearson_survives_a_large_offset(spark):
    rows = [(i, m, 1e9 + v * 1e-2) for i in range(50) for m, v in (("a", i), ("b", -i), ("c", i * i))]
    df = spark.createDataFrame(rows, "run_id int, metric string, value double").repartition(5)
    r = {(x["x"], x["y"]): x["r"] for x in similarity.pearson_matrix(df, "metric", "run_id").collect()}
    assert r["a", "b"] == pytest.approx(-1, abs=1e-4)


def test_rank_sums(tables):
    ranks = leaderboard.board(tables.full_mean, interpolation="zero", form="inverted_ranks")
    n = ranks.select("strategy").distinct().count()
    for row in ranks.groupBy("dataset").agg(F.sum("score").alias("s"), F.max("score").alias("m")).collect():
        assert row["s"] <= n * (n + 1) / 2 and row["m"] <= n


def test_pad_to_fingerprints_pads_less(tables):
    scores = tables.runs
    pad = leaderboard.most_fingerprints(scores, ["batch", "learner"])
    board = leaderboard.board(scores, interpolation="remove", pad_to=pad)
    assert board.filter("score is not null").count() > 0


def test_scenarios_are_repeatable_and_exact(tables):
    rows = tables.spark.createDataFrame([(0, 3), (1, 3), (2, 99)], "scenario int, k int")
    picks = scenarios.sample_values(rows, tables.runs, "start_point").collect()
    again = scenarios.sample_values(rows, tables.runs.repartition(7), "start_point").collect()
    assert sorted(picks) == sorted(again)
    by = {s: {p["start_point"] for p in picks if p["scenario"] == s} for s in (0, 1, 2)}
    assert len(by[0]) == len(by[1]) == 3 and by[0] != by[1] and by[2] == set()


def test_budget_scenarios_stay_in_their_subsets(tables):
    groups = tables.runs.select(*scenarios.DRAW_LIMITS).distinct()
    rows = tables.spark.createDataFrame([(i, 0, 10 ** (i % 4)) for i in range(20)], "scenario int, attempt int, budget int")
    subsets = scenarios.random_subsets(
        rows, groups, list(scenarios.DRAW_LIMITS), scenarios.DRAW_LIMITS
    ).collect()
    assert len(subsets) == 20
    for s in subsets:
        sizes = [len(s[f"only_{p}"]) for p in scenarios.DRAW_LIMITS if s[f"only_{p}"]]
        product = 1
        for n in sizes:
            product *= n
        assert sizes and product == s["grid_size"]
        for p, limit in scenarios.DRAW_LIMITS.items():
            assert s[f"only_{p}"] is None or 1 <= len(set(s[f"only_{p}"])) <= limit


def test_single_value_scenarios_hold_their_target(tables):
    targets = tables.spark.createDataFrame(
        [(i, "learner", v) for i in range(3) for v in ("F", "O")], "scenario int, target string, target_value string"
    )
    out = scenarios.single_value_scenarios(tables.runs, targets).collect()
    assert out and {r["target"] for r in out} == {"learner"}


def test_elimination_removes_copies(spark):
    rows = [(f, s, float(v * (1 if f % 2 else 1.0)))
            for f in range(8) for s, v in enumerate([1, 5, 2, 9, 4] if f < 6 else [9, 1, 7, 2, 3])]
    vectors = spark.createDataFrame(rows, "fingerprint int, strategy int, value double")
    out = similarity.eliminate_redundant(vectors, 0.95, rounds=20).collect()
    assert len(out) == 8
    kept = [r["fingerprint"] for r in out if r["round"] is None]
    assert len(kept) == 2 and sum(f >= 6 for f in kept) == 1


def test_bootstrap_of_equal_boards(tables):
    board = tables.full_mean.groupBy("dataset", "strategy").agg(F.avg("value").alias("score"))
    taus = similarity.bootstrap_tau(board, board, replicates=25).collect()
    assert len(taus) == 25 and all(t["tau"] == pytest.approx(1) for t in taus)


def test_splits_hold_every_class(tables):
    splits = prepare.stratified_splits(tables.samples)
    counts = splits.groupBy("bucket", "label").pivot("part", ["train", "test"]).count().collect()
    assert all(r["train"] and r["test"] for r in counts)
    starts = prepare.start_sets(splits, sets=20)
    labels = tables.samples.select("label").distinct().count()
    assert starts.count() == 5 * 20 * labels
    train = splits.filter("part = 'train'")
    assert starts.join(train, ["bucket", "sample_id"], "left_anti").count() == 0


def test_pool_smaller_than_batch_is_returned_whole(tables):
    small = tables.probabilities.filter("sample_id < 5")
    for batch in (pool.random_batch(small, 50), pool.uncertainty_batch(small, 50, "entropy")):
        assert batch.count() == small.count()


def test_k_center_matches_greedy(tables):
    import numpy as np

    rows = tables.samples.select("sample_id", "features")
    got = [r["sample_id"] for r in pool.k_center(rows, rows.filter("sample_id = 0"), 5).collect()]
    data = rows.orderBy("sample_id").toPandas()
    x = np.stack(data["features"])
    d, want = np.linalg.norm(x - x[0], axis=1), []
    for _ in range(5):
        i = int(d.argmax())
        want.append(int(data["sample_id"][i]))
        d = np.minimum(d, np.linalg.norm(x - x[i], axis=1))
    assert got == want


def test_registry_takes_new_functions(tables):
    registry.register_curve_metric("range", lambda v, c: F.max(v) - F.min(v))
    registry.register_cycle_metric("rows", lambda guess, truth: F.count(truth))
    try:
        out = registry.apply_to_curves(tables.curve, ["range"])
        assert out.filter("range < 0").count() == 0
        assert registry.cycle_metrics(tables.predictions, ["run_id"], ["rows"]).count() > 0
    finally:
        registry.CURVE_METRICS.pop("range")
        registry.CYCLE_METRICS.pop("rows")


def test_duplicate_combinations_with_a_hot_group(spark):
    rows = [(i, 1 if i < 500 else i) for i in range(1000)]
    runs = spark.createDataFrame(rows, "run_id int, dataset int")
    out = curate.duplicate_combinations(runs, ["dataset"])
    assert out.count() == 499 and {r["first_id"] for r in out.collect()} == {0}


def test_series_extracts(tables):
    out = series.learning_curve(tables.curve, {"dataset": 3})
    assert out.filter("low > mean + 1e-9 and n > 40").count() == 0
    wide = series.pivot_cycles(tables.curve, ["run_id"], [0, 1, 2])
    long = series.unpivot_cycles(wide, ["run_id"])
    assert long.count() == tables.curve.filter("cycle < 3").count()


def test_many_scenarios_repeat_the_few(spark):
    """The first of 3000 scenarios draw and score as the 125 and 150 do; each comes out."""
    from curveboard.plans.queries import QUERIES

    small = "/root/testdata/sf0.001"
    for few, many in (("N1_start_point_scenario", "N1_start_point_3000"), ("N3_dataset_scenario", "N3_dataset_3000")):
        part = {(r.scenario, r.k, r.strategy): r.total for r in QUERIES[few](spark, small).collect()}
        rows = QUERIES[many](spark, small).collect()
        whole = {(r.scenario, r.k, r.strategy): r.total for r in rows}
        assert {r.scenario for r in rows} == set(range(3000))
        for key, total in part.items():
            assert whole[key] == pytest.approx(total, abs=1e-9)


def test_scenarios_without_scores_come_out(spark):
    from curveboard.operators import scenarios

    scores = spark.createDataFrame(
        [(d, s, x, float(d + s + len(x))) for d in range(3) for s in range(4) for x in ("a", "bb")],
        "dataset int, start_point int, strategy string, value double",
    )
    asked = spark.createDataFrame([(0, 2), (1, 9), (2, 4)], "scenario int, k int")
    out = {}
    for r in scenarios.value_scenarios(scores, asked, "start_point").collect():
        out.setdefault(r.scenario, []).append((r.strategy, r.total))
    assert out[1] == [(None, None)] and all(len(out[i]) == 2 for i in (0, 2))


def test_incidence_boards_equal_plain_joins(spark, monkeypatch):
    """Sums, minima and exact quartiles of picked settings, with small blocks and bins."""
    import numpy as np
    from pyspark.sql import functions as F

    from curveboard.operators import incidence

    monkeypatch.setattr(incidence, "BLOCK", 4)
    rng = np.random.default_rng(6)
    rows = [
        (int(d), int(p), f"s{x}", None if rng.random() < 0.1 else float(np.round(rng.lognormal(0, 3), 2)))
        for d, p, x in zip(rng.integers(0, 4, 900), rng.integers(0, 7, 900), rng.integers(0, 3, 900))
    ]
    scores = spark.createDataFrame(rows, "dataset int, point int, strategy string, value double")
    picks = [(s, int(p)) for s in range(23) for p in rng.choice(7, 1 + s % 5, replace=False)]
    picked = spark.createDataFrame(picks, "scenario int, point int")
    cells = scores.groupBy("point", "dataset", "strategy").agg(
        F.sum("value").alias("s"), F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    probs = {"a": 0.25, "b": 0.5, "c": 0.9}
    grouped, spread = incidence.boards(cells, scores, picked, ["point"], ["scenario"], probs, bins=16)
    got = {(r.scenario, r.dataset, r.strategy): (r.s, r.n, r.lo, r.hi) for r in grouped.collect()}
    quart = {(r.scenario, r.dataset): (r.a, r.b, r.c) for r in spread.collect()}
    want, values = {}, {}
    for s, p in picks:
        for d, q, x, v in rows:
            if q == p:
                want.setdefault((s, d, x), []).append(v)
                if v is not None:
                    values.setdefault((s, d), []).append(v)
    assert set(got) == set(want) and set(quart) == set(values)
    for key, own in want.items():
        own = [v for v in own if v is not None]
        if own:
            assert got[key] == pytest.approx((sum(own), len(own), min(own), max(own)))
    for key, own in values.items():
        assert quart[key] == pytest.approx(tuple(np.quantile(own, list(probs.values()))))

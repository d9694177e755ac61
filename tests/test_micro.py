"""Hand-computed values for single operators."""

import pytest
from pyspark.sql import functions as F

from curveboard.functions.lists import list_mean, list_median, parse_list
from curveboard.functions.vectors import with_unit
from curveboard.functions import slices
from curveboard.operators import categorize, curves, grid, leaderboard, quality, selections, similarity
from curveboard.schema import DIMS

V = [0.2, 0.5, 0.4, 0.6, 0.6, 0.8, 0.7]


def curve(spark, values=V, run_id=1):
    rows = [(run_id, i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "run_id long, cycle int, value double")


def one(df, column):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0][column]


def near(value):
    return pytest.approx(value, abs=1e-6)


@pytest.fixture(params=[2, 3, 1024])
def chunk(request, monkeypatch):
    """Every curve cut into small chunks, or none."""
    if request.param < 1024:
        monkeypatch.setattr(slices, "HOT_ROWS", 0)
    return request.param


def test_curve_values(spark, chunk):
    c = curve(spark)
    assert one(curves.full_mean(c), "full_auc") == near(0.6)
    assert one(curves.first_mean(c), "first_5") == near(0.58)
    assert one(curves.last_mean(c), "last_5") == near(0.62)
    assert one(curves.final_value(c), "final_value") == near(0.7)
    assert one(curves.ramp_cutoffs(c, chunk=chunk), "cutoff") == 1
    cut = spark.createDataFrame([(1, 1.0)], "run_id long, cutoff double")
    phases = curves.phase_means(c, cut, chunk=chunk).first()
    assert (phases["ramp_up_auc"], phases["plateau_auc"]) == (near(0.5), near(0.62))
    stable = curves.learning_stability(c, [5, 2], chunk=chunk).first()
    assert stable["learning_stability_5"] == near(1.0)
    assert stable["learning_stability_2"] == near(1.25)


def by_cycle(df):
    return [near(r["value"]) for r in df.orderBy("cycle").collect()]


def test_curve_sequences(spark, chunk):
    c = curve(spark)
    assert by_cycle(curves.time_lag(c, chunk=chunk)) == [0.3, -0.1, 0.2, 0, 0.2, -0.1]
    assert by_cycle(curves.biggest_drop(c, chunk=chunk)) == [0, -0.1, -0.1, -0.1, -0.1, -0.1]
    assert by_cycle(curves.decreasing_cycles(c, chunk=chunk)) == [0, -1, -1, -1, -1, -2]
    assert len(curves.biggest_drop(c, legacy_drop_first=True).collect()) == 5


def test_cutoff_fallback_rounds_half_to_even(spark):
    assert one(curves.ramp_cutoffs(curve(spark, V[:5])), "cutoff") == 2
    flat = curve(spark, [0.5] * 7)
    assert one(curves.ramp_cutoffs(flat), "cutoff") == 4


def test_list_cells(spark):
    rows = spark.createDataFrame([("[0.5, nan, 1.0]",), (None,), ("[3, 1]",)], "c string")
    out = rows.select(
        parse_list(F.col("c")).alias("v"),
        list_mean(parse_list(F.col("c"))).alias("mean"),
        list_median(parse_list(F.col("c"))).alias("median"),
    ).collect()
    assert out[0]["v"] == [0.5, None, 1.0] and out[0]["mean"] == near(0.5)
    assert out[0]["median"] is None
    assert out[1]["v"] == [] and out[1]["mean"] is None and out[1]["median"] is None
    assert out[2]["median"] == near(2.0)


def test_quality(spark):
    rows = spark.createDataFrame(
        [(1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 1)], "run_id int, label int, y_pred int"
    )
    r = quality.standard_metrics(rows, ["run_id"]).first()
    assert r["accuracy"] == near(0.75)
    for kind in ("macro", "weighted"):
        assert r[f"{kind}_precision"] == near(0.833333)
        assert r[f"{kind}_recall"] == near(0.75)
        assert r[f"{kind}_f1"] == near(0.733333)


def picks(spark):
    rows = [(1, 1, 1, [1.0, 0.0]), (1, 1, 2, [0.0, 1.0]), (1, 1, 3, [1.0, 1.0])]
    return with_unit(
        spark.createDataFrame(rows, "run_id int, cycle int, sample_id int, features array<double>")
    )


def test_distances(spark):
    assert one(selections.batch_distance(picks(spark)), "value") == near(0.528595)
    single = picks(spark).filter("sample_id = 1")
    assert one(selections.batch_distance(single), "value") == 0
    samples = picks(spark).select(F.lit("d").alias("dataset"), "sample_id", "features", F.lit(0).alias("label"))
    raw = categorize.class_mean_distance_raw(samples, "all").orderBy("sample_id").collect()
    assert [r["value"] for r in raw] == [near(0.430964), near(0.430964), near(0.195262)]


def test_labelled_distance_double_start(spark):
    rows = [(1, 0, 1, [1.0, 0.0]), (1, 1, 2, [1.0, 1.0]), (1, 2, 3, [0.0, 1.0])]
    sel = with_unit(
        spark.createDataFrame(rows, "run_id int, cycle int, sample_id int, features array<double>")
    )
    s = 1 - 2**-0.5
    plain = by_cycle(selections.labelled_distance(sel))
    assert plain == [0, near(s), near((1 + s) / 2)]
    double = by_cycle(selections.labelled_distance(sel, legacy_double_start=True, chunk=1))
    assert double == [0, near(s), near((2 + s) / 3)]


def test_class_gap(spark):
    train = spark.createDataFrame([(0, 0), (0, 1)], "bucket int, label int")
    sel = spark.createDataFrame(
        [(1, 0, 0, 0), (1, 0, 0, 0), (1, 0, 0, 1)], "run_id int, bucket int, cycle int, label int"
    )
    r = selections.class_gap(sel, train, ["bucket"]).first()
    assert (r["manhattan"], r["chebyshev"]) == (near(-0.333333), near(-0.166667))
    # a label that the train set lacks still counts
    strange = spark.createDataFrame([(1, 0, 0, 7)], "run_id int, bucket int, cycle int, label int")
    for cumulative in (False, True):
        r = selections.class_gap(strange, train, ["bucket"], cumulative=cumulative).first()
        assert (r["manhattan"], r["chebyshev"]) == (near(-2.0), near(-1.0))


def board(spark, rows):
    return spark.createDataFrame(rows, "dataset int, strategy string, value double")


def test_interpolations(spark):
    rows = board(spark, [(1, "A", 0.8), (1, "A", 0.6), (1, "B", 0.9), (2, "C", 0.1), (2, "C", 0.3)])

    def scores(rule):
        out = leaderboard.board(rows, interpolation=rule).filter("dataset = 1")
        return {r["strategy"]: r["score"] for r in out.collect()}

    assert scores("zero") == {"A": near(0.7), "B": near(0.45), "C": 0}
    assert scores("average_of_same_strategy") == {"A": near(0.7), "B": near(0.9), "C": None}
    assert scores("remove") == {"A": near(0.7), "B": None, "C": None}
    padded = leaderboard.board(rows, interpolation="zero", pad_to=4).filter("dataset = 1")
    assert {r["strategy"]: r["score"] for r in padded.collect()}["A"] == near(0.35)


def test_robust_scaling(spark):
    rows = board(spark, [(1, s, v) for s, v in zip("ABCD", [1.0, 2.0, 3.0, 7.0])])
    out = leaderboard.board(rows, normalisation="robust", interpolation="none")
    got = {r["strategy"]: r["score"] for r in out.collect()}
    assert got == {"A": near(-0.666667), "B": near(-0.222222), "C": near(0.222222), "D": near(2.0)}
    flat = board(spark, [(1, "A", 5.0), (1, "B", 5.0)])
    for kind in ("robust", "minmax"):
        out = leaderboard.board(flat, normalisation=kind, interpolation="none").collect()
        assert [r["score"] for r in out] == [0.0, 0.0]


def test_ranks(spark):
    values = [0.9, 0.5, 0.5, 0.1, None]
    rows = spark.createDataFrame(
        [(1, i, v) for i, v in enumerate(values)], "dataset int, strategy int, score double"
    )
    up = rows.withColumn("r", leaderboard.max_tie_rank("score", ["dataset"])).orderBy("strategy")
    down = rows.withColumn("r", leaderboard.inverted_rank("score", ["dataset"])).orderBy("strategy")
    assert [r["r"] for r in up.collect()] == [4, 3, 3, 1, None]
    assert [r["r"] for r in down.collect()] == [1, 2, 2, 4, None]


def test_fisher_interval(spark):
    m = spark.createDataFrame([("a", "b", 28, 0.5), ("a", "a", 28, 1.0)], "x string, y string, n int, r double")
    out = {r["y"]: r for r in similarity.with_interval(m).collect()}
    assert (out["b"]["lo"], out["b"]["hi"]) == (near(0.156028), near(0.735818))
    assert (out["a"]["lo"], out["a"]["hi"]) == (1.0, 1.0)
    few = spark.createDataFrame([("a", "b", 3, 0.5)], "x string, y string, n int, r double")
    with pytest.raises(Exception, match="at least 4"):
        similarity.with_interval(few).collect()


@pytest.mark.parametrize(
    ("x", "y", "tau"),
    [
        ([1, 2, 3, 4], [1, 3, 2, 4], 0.666667),
        ([1, 2, 3, 4], [1, 2, 2, 4], 0.912871),
        ([1, 2, 3, 4], [4, 3, 2, 1], -1.0),
        ([1, 1, 1, 1], [1, 2, 3, 4], None),
    ],
)
def test_kendall(spark, x, y, tau):
    rows = spark.createDataFrame([(1, a, b) for a, b in zip(x, y)], "k int, x int, y int")
    got = one(similarity.kendall(rows, ["k"]), "tau")
    assert got is None if tau is None else got == near(tau)


def test_jaccards(spark):
    rows = spark.createDataFrame(
        [(1, "a", i) for i in (1, 2, 3)] + [(1, "b", i) for i in (2, 3, 4)],
        "f int, s string, sample_id int",
    )
    got = {(r["a"], r["b"]): r["jaccard"] for r in similarity.jaccard_matrix(rows, "s", ["f"]).collect()}
    assert got == {("a", "a"): 1, ("b", "b"): 1, ("a", "b"): near(0.5), ("b", "a"): near(0.5)}
    multi = spark.createDataFrame(
        [(1, "a", i) for i in (1, 1, 2)] + [(1, "b", i) for i in (1, 2, 2)],
        "dataset int, strategy string, sample_id int",
    )
    pairs = similarity.multiset_jaccard(multi).filter("a = 'a' and b = 'b'").collect()
    assert {r["dataset"] for r in pairs} == {"1", "All Datasets Combined"}
    assert all(r["jaccard"] == near(0.5) for r in pairs)


def test_run_hash(spark):
    row = spark.createDataFrame(
        [(5, 1, 1, 0, 2, 3, 4)],
        "EXP_BATCH_SIZE int, EXP_DATASET int, EXP_LEARNER_MODEL int, EXP_RANDOM_SEED int, "
        "EXP_START_POINT int, EXP_STRATEGY int, EXP_TRAIN_TEST_BUCKET_SIZE int",
    )
    got = row.select(grid.run_hash(row.columns).alias("h")).first()["h"]
    assert len(got) == 16
    assert got == "5b531edb37de5f28"


def test_merge_runs_refuses_shared_ids(spark):
    a = spark.createDataFrame([(1, 1), (2, 1)], "run_id long, dataset int")
    b = spark.createDataFrame([(2, 2)], "run_id long, dataset int")
    with pytest.raises(Exception, match="overlap"):
        grid.merge_runs(a, b).collect()


def test_grid_and_refresh(spark):
    cells = grid.grid(spark, {"dataset": [0, 1], "strategy": [3, 4, 5]})
    assert cells.distinct().count() == 6
    numbered = grid.shuffle_and_number(cells, ["dataset", "strategy"], offset=10)
    assert sorted(r["run_id"] for r in numbered.collect()) == list(range(10, 16))
    more = grid.grid(spark, {"dataset": [0, 1, 2], "strategy": [3, 4, 5]})
    fresh = grid.refresh_grid(numbered, more, ["dataset", "strategy"])
    ids = {(r["dataset"], r["strategy"]): r["run_id"] for r in fresh.collect()}
    kept = {(r["dataset"], r["strategy"]): r["run_id"] for r in numbered.collect()}
    assert len(ids) == 9 and all(ids[k] == v for k, v in kept.items())
    assert sorted(v for k, v in ids.items() if k not in kept) == [16, 17, 18]


def test_subtract_is_null_safe(spark):
    schema = "run_id long, " + ", ".join(f"{d} int" for d in DIMS)
    left = spark.createDataFrame([(1, 1, 1, 1, 1, None, 1), (2, 1, 1, 1, 1, 2, 1)], schema)
    right = spark.createDataFrame([(9, 1, 1, 1, 1, None, 1)], schema)
    assert [r["run_id"] for r in grid.subtract(left, right).collect()] == [2]

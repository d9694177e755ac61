"""Correlated pairs by the index, and the greedy choice, against plain rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curveboard.operators import cells, redundancy, similarity


def made(spark, n=220, items=6, seed=3):
    """Vectors around a few profiles; some lack items, some repeat others exactly, some do not vary."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, items))
    x = base[rng.integers(0, 12, n)] * rng.uniform(0.5, 2, (n, 1)) + 0.15 * rng.normal(size=(n, items))
    x[50:60] = 3 * x[40:50] + 1
    x[7] = 1.0
    x[rng.random((n, items)) < 0.05] = np.nan
    rows = [(i, f"s{j}", None if np.isnan(x[i, j]) else float(x[i, j])) for i in range(n) for j in range(items)]
    return x, spark.createDataFrame(rows, "fingerprint long, strategy string, value double")


def plain(x, threshold):
    kept, because = [], {}
    for i in range(len(x)):
        for j in kept:
            both = ~np.isnan(x[i]) & ~np.isnan(x[j])
            if both.sum() >= 2 and x[i][both].std() > 1e-12 and x[j][both].std() > 1e-12:
                if np.corrcoef(x[i][both], x[j][both])[0, 1] > threshold:
                    because[i] = j
                    break
        else:
            kept.append(i)
    return kept, because


@pytest.mark.parametrize("threshold", [0.9, 0.97])
def test_survivors_equal_the_plain_rule(spark, threshold):
    x, vectors = made(spark)
    out = redundancy.independent(vectors, threshold).collect()
    kept, because = plain(x, threshold)
    assert sorted(r.fingerprint for r in out if r.kept) == kept
    assert {r.fingerprint for r in out if not r.kept} == set(because) and all((r.because is None) == r.kept for r in out)


def test_index_leaves_pairs_out(spark):
    """Complete, clustered vectors: fewer comparisons than pairs, all correlated pairs found."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    x = base[rng.integers(0, 40, 900)] + 0.1 * rng.normal(size=(900, 16))
    rows = spark.createDataFrame([(i, f"s{j:02d}", float(v)) for i, r in enumerate(x) for j, v in enumerate(r)], "fingerprint long, strategy string, value double")
    notes = []
    found = redundancy.correlated_pairs(redundancy.profiles(rows), 0.95, notes.append, F.lit(12)).collect()
    r = np.corrcoef(x)
    want = {(i, j) for i in range(900) for j in range(i + 1, 900) if r[i, j] > 0.95}
    assert {(p.a, p.b) for p in found} == want
    assert notes[0].first()["compared"] < 0.5 * 900 * 899 / 2


def test_chains_and_no_links(spark):
    """In a chain every second node stays; nodes without links all stay."""
    nodes = spark.range(12).withColumnRenamed("id", "fingerprint")
    edges = spark.createDataFrame([(i, i + 1) for i in range(11)], "a long, b long")
    out = {r.fingerprint: (r.kept, r.because) for r in redundancy.greedy(nodes, edges).collect()}
    assert out == {i: (i % 2 == 0, None if i % 2 == 0 else i - 1) for i in range(12)}
    assert redundancy.greedy(nodes, edges.filter("a < 0")).filter("kept").count() == 12


def test_rounds_in_one_task_equal_rounds_as_jobs(spark):
    """Also where fingerprints lack items, repeat an item, do not vary or are null; rounds cost no jobs."""
    _, vectors = made(spark, n=40)
    more = [(3, "s1", 0.5), (4, "s0", None), (None, "s0", 1.0), (None, "s1", 2.0), (50, None, 1.0), (51, "s2", 1.0)]
    vectors = vectors.union(spark.createDataFrame(more, vectors.schema))
    spark.sparkContext.setJobGroup("elimination", "")
    one = similarity.eliminate_redundant(vectors, 0.9, rounds=12, patience=2, seed=5).collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("elimination")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) < 40
    many = similarity.eliminate_redundant(vectors, 0.9, rounds=12, patience=2, seed=5, last_rows=30).collect()
    assert sorted(map(str, one)) == sorted(map(str, many)) and len(one) == 43
    assert any(r["round"] is not None for r in one) and all(r["round"] is None for r in one if r["fingerprint"] in (None, 7, 50, 51))


def test_parts_find_few_of_all_pairs(spark, monkeypatch):
    """Many profiles around a few: later ones meet the kept ones only, with the result of the plain rule."""
    monkeypatch.setattr(redundancy, "FIRST_ROWS", 64)
    asked, within = [], redundancy.pairs_within
    monkeypatch.setattr(redundancy, "pairs_within", lambda *a: asked.append(found := cells.written(within(*a))) or found)
    x, vectors = made(spark, n=400)
    vectors = vectors.union(spark.createDataFrame([(None, "s0", 1.0), (None, "s1", 3.0)], vectors.schema))
    out = redundancy.independent(vectors, 0.9).collect()
    kept, because = plain(x, 0.9)
    assert sorted(r.fingerprint for r in out if r.kept and r.fingerprint is not None) == kept and len(out) == 401
    assert {r.fingerprint for r in out if not r.kept} == set(because)
    r = np.ma.corrcoef(np.ma.masked_invalid(x))
    assert len(asked) > 1 and sum(a.count() for a in asked) < 0.6 * ((r > 0.9).sum() - 400) / 2


def test_blocks_around_one_centre_reach_each_other(spark):
    """Rows far from a centre are near rows of another block whose nearest rows are nearer to that centre."""
    a = spark.createDataFrame([(0, 1, [1.0, 0.0], 0.0, 0.6), (0, 2, [1.0, 0.0], 0.5, 0.9)], "g int, block long, centre array<double>, least double, most double")
    near = cells.open_pairs(a.withColumn("reach", F.lit(0.05)), ["g"], None).collect()
    assert {(r.a, r.b) for r in near} == {(1, 1), (1, 2), (2, 1), (2, 2)}

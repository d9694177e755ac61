"""Sources and sinks on real files, and the streaming jobs."""

import lzma

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curveboard.operators import curate
from curveboard.sources import tables as src
from curveboard.streaming import ingest

CURVE = T.StructType(
    [
        T.StructField("0", T.DoubleType()),
        T.StructField("1", T.DoubleType()),
        T.StructField("run_id", T.LongType()),
    ]
)


@pytest.fixture()
def tree(tmp_path):
    """<strategy>/<dataset>/<metric> files: good, truncated, and no metric at all."""
    good = b"0,1,run_id\n0.5,,7\n0.25,0.75,8\n"
    for strategy in ("RAND", "MARGIN"):
        folder = tmp_path / strategy / "iris"
        folder.mkdir(parents=True)
        (folder / "accuracy.csv.xz").write_bytes(lzma.compress(good))
    (tmp_path / "RAND" / "iris" / "macro_f1.csv.xz").write_bytes(lzma.compress(good)[:-20])
    (tmp_path / "RAND" / "iris" / "05_done_workload.csv.xz").write_bytes(lzma.compress(good))
    (tmp_path / "RAND" / "iris" / "wide.csv").write_text("a,b\n1,2\n1,2,3\n")
    return tmp_path


def test_xz_table(spark, tree):
    df = src.read_table(spark, str(tree / "RAND" / "iris" / "accuracy.csv.xz"), CURVE)
    assert [tuple(r) for r in df.orderBy("run_id").collect()] == [(0.5, None, 7), (0.25, 0.75, 8)]


def test_discovery_and_health(spark, tree):
    found = src.discover_metric_files(spark, str(tree)).select("strategy", "dataset", "metric")
    assert {tuple(r) for r in found.collect()} == {
        ("RAND", "iris", "accuracy"),
        ("MARGIN", "iris", "accuracy"),
        ("RAND", "iris", "macro_f1"),
        ("RAND", "iris", "wide"),
    }
    only = src.discover_metric_files(spark, str(tree), "accuracy")
    assert only.count() == 2
    bad = src.file_health(spark, str(tree)).filter("error is not null").collect()
    assert {r["path"].rsplit("/", 1)[1] for r in bad} == {"macro_f1.csv.xz", "wide.csv"}


def test_corrupt_rows_are_kept_apart(spark, tmp_path):
    (tmp_path / "t.csv").write_text("run_id,dataset\n1,2\nx,3\n")
    schema = T.StructType([T.StructField("run_id", T.LongType()), T.StructField("dataset", T.IntegerType())])
    rows = src.split_corrupt(spark, str(tmp_path / "t.csv"), schema).cache()
    assert rows.filter("_corrupt is not null").count() == 1


def test_repeated_headers_and_short_rows(spark, tmp_path):
    (tmp_path / "m.csv").write_text("0,1,2,run_id\n0.1,0.2,0.3,5\n0,1,2,run_id\n0.4,6,,\n")
    lines = spark.read.text(str(tmp_path / "m.csv"))
    body = curate.drop_repeated_headers(lines)
    got = {tuple(r)[:3] for r in curate.repair_short_rows(body, 4).collect()}
    assert got == {(5, 0, 0.1), (5, 1, 0.2), (5, 2, 0.3), (6, 0, 0.4)}


def test_list_cells_and_unreadable_ids_stay(spark):
    text = [
        '"[3, 17]","[4, 5]",,9',
        '"[3, 17]","[4, 5]",9007199254740993,',
        '"say ""x""",0.5,0.25,7.0',
        "0.1,0.2,0.3,lost",
        "only",
    ]
    lines = spark.createDataFrame([(x,) for x in text], "value string")
    got = {tuple(r) for r in curate.repair_short_rows(lines, 4).collect()}
    assert got == {
        (9, 0, None, "[3, 17]", None),
        (9, 1, None, "[4, 5]", None),
        (9007199254740993, 0, None, "[3, 17]", None),
        (9007199254740993, 1, None, "[4, 5]", None),
        (7, 0, None, 'say "x"', "value"),
        (7, 1, 0.5, "0.5", None),
        (7, 2, 0.25, "0.25", None),
        (None, 0, 0.1, "0.1", "id"),
        (None, 1, 0.2, "0.2", "id"),
        (None, 2, 0.3, "0.3", "id"),
    }


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "b", None)], "run_id int, s string, v double")
    src.write_table(df, str(tmp_path / "p"), partition_by=["s"])
    # a second write of one partition leaves the other alone
    src.write_table(df.filter("s = 'a'").withColumn("v", F.lit(9.0)), str(tmp_path / "p"), partition_by=["s"])
    got = {r["s"]: r["v"] for r in spark.read.parquet(str(tmp_path / "p")).collect()}
    assert got == {"a": 9.0, "b": None}
    src.append_rows(df, str(tmp_path / "q"))
    src.append_rows(df, str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).count() == 4
    with pytest.raises(ValueError):
        src.write_table(df, str(tmp_path / "r"), fmt="npz")


def test_stream_keeps_the_first_row_over_restarts(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = spark.createDataFrame([(i, i % 3, "done") for i in range(20)], "run_id long, dataset int, status string")
    rows.filter("run_id < 12").write.parquet(source)

    def ingest_all():
        stream = ingest.first_per_run(ingest.run_stream(spark, source, rows.schema))
        ingest.write_runs(stream, sink, state).awaitTermination()
        return spark.read.parquet(sink)

    assert ingest_all().count() == 12
    # the second delivery repeats old runs
    rows.write.mode("append").parquet(source)
    out = ingest_all()
    assert out.count() == 20 and out.select("run_id").distinct().count() == 20


def test_watermarked_stream(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = spark.range(10).select(
        F.col("id").alias("run_id"), F.timestamp_seconds(F.col("id") + 1_000_000).alias("finished")
    )
    rows.unionByName(rows).write.parquet(source)
    stream = ingest.first_per_run(ingest.run_stream(spark, source, rows.schema), "finished")
    ingest.write_runs(stream, sink, state).awaitTermination()
    assert spark.read.parquet(sink).count() == 10


def test_late_copies_restarts_and_replays(spark, tmp_path):
    """A copy long after its run, a second start of the stream, and a batch that runs twice."""
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = spark.createDataFrame([(i, "first") for i in range(30)], "run_id long, status string")
    late = rows.withColumn("status", F.lit("late")).filter("run_id < 25")
    rows.filter("run_id < 20").write.parquet(source)

    def ingest_all():
        stream = ingest.run_stream(spark, source, rows.schema, 1)
        ingest.write_new_runs(stream, sink, state, buckets=4).awaitTermination()
        return {r.run_id: r.status for r in ingest.kept_runs(spark, sink).collect()}

    assert ingest_all() == {i: "first" for i in range(20)}
    late.write.mode("append").parquet(source)
    rows.filter("run_id >= 20").write.mode("append").parquet(source)
    out = ingest_all()
    assert set(out) == set(range(30))
    assert all(out[i] == "first" for i in [*range(20), *range(25, 30)])
    n = spark.read.parquet(sink).count()
    assert n == 30
    last = max(r.batch for r in spark.read.parquet(sink).select("batch").distinct().collect())
    again = spark.read.parquet(sink).filter(F.col("batch") == last).select("run_id", "status").collect()
    ingest.append_new(spark.createDataFrame(again, rows.schema), last, sink, buckets=4)
    assert spark.read.parquet(sink).count() == 30


def test_tree_of_named_files_and_formats(spark, tmp_path):
    """Named files and Spark's own folders; of several formats the first counts, workloads do not."""
    schema = T.StructType.fromDDL("run_id long, cycle long, value double")
    folder = tmp_path / "RAND" / "iris"
    folder.mkdir(parents=True)
    text = "run_id,cycle,value\n1,0,{v}\n1,1,0.5\n"
    (folder / "accuracy.csv.xz").write_bytes(lzma.compress(text.format(v=0.1).encode()))
    (folder / "accuracy.csv").write_text(text.format(v=7))
    (folder / "macro_f1.csv").write_text(text.format(v=0.3))
    (folder / "05_done_workload.csv.xz").write_bytes(lzma.compress(b"run_id\n1\n"))
    rows = spark.createDataFrame([(2, 0, 0.9, "MARGIN", "wine", "accuracy"), (1, 0, 9.0, "RAND", "iris", "macro_f1")], "run_id long, cycle long, value double, strategy string, dataset string, metric string")
    rows.write.mode("append").partitionBy("strategy", "dataset", "metric").parquet(str(tmp_path))
    listed = {tuple(r)[:4] for r in src.listed_tree(spark, str(tmp_path)).collect()}
    assert listed == {
        ("RAND", "iris", "accuracy", "csv.xz"), ("RAND", "iris", "accuracy", "csv"), ("RAND", "iris", "macro_f1", "csv"),
        ("RAND", "iris", "macro_f1", "parquet"), ("MARGIN", "wine", "accuracy", "parquet"),
    }
    got = sorted(tuple(r) for r in src.tree_rows(spark, str(tmp_path), schema).collect())
    assert got == [
        ("MARGIN", "wine", "accuracy", 2, 0, 0.9), ("RAND", "iris", "accuracy", 1, 0, 0.1),
        ("RAND", "iris", "accuracy", 1, 1, 0.5), ("RAND", "iris", "macro_f1", 1, 0, 0.3), ("RAND", "iris", "macro_f1", 1, 1, 0.5),
    ]
    assert src.tree_rows(spark, str(tmp_path), schema, "macro_f1").count() == 2


def test_wide_export_refuses_absurd_cycles(spark):
    from curveboard.operators import series

    curve = spark.createDataFrame([(1, 0, 0.5), (1, 1_000_000, 0.6)], "run_id long, cycle long, value double")
    with pytest.raises(ValueError, match="cannot become columns"):
        series.pivot_cycles(curve, ["run_id"])
    assert series.pivot_cycles(curve, ["run_id"], [0]).columns == ["run_id", "0"]


def test_short_files_share_a_frame():
    """Many files of two rows come out as one frame, not one each."""
    import lzma

    import pandas as pd

    from curveboard.sources.tables import _xz_rows

    content = [lzma.compress(f"run_id,learner\n{i},a\n{i},\n".encode()) for i in range(50)]
    out = list(_xz_rows(iter([pd.DataFrame({"path": [f"p{i}" for i in range(50)], "content": content})])))
    assert len(out) == 1 and len(out[0]) == 100
    assert out[0]["path"].tolist() == [f"p{i // 2}" for i in range(100)]
    assert out[0]["cells"][3] == {"run_id": "1", "learner": None}


def test_corrupt_files_of_a_broken_tree(spark, tmp_path):
    """Every file of a run table is packed whole or cut, without a Python call for each group."""
    from curveboard.plans import run_queries

    class Given:
        runs = spark.createDataFrame(
            [("s", d, 1000 * d + i, "x") for d in range(6) for i in range(3)],
            "strategy string, dataset int, run_id long, learner string",
        )

    for broken in (False, True):
        files = run_queries._xz_files(Given, broken)
        assert "FlatMapGroups" not in files._jdf.queryExecution().toString()
        bad = {r.path for r in run_queries.src.probe_files(files).filter("error is not null").collect()}
        assert bad == ({"/results/s/0/part-0.csv.xz", "/results/s/5/part-5.csv.xz"} if broken else set())
    cells = run_queries.src.decode_xz(run_queries._xz_files(Given)).collect()
    assert sorted(int(c.cells["run_id"]) for c in cells) == [1000 * d + i for d in range(6) for i in range(3)]


def test_id_coverage_is_one_aggregate(spark):
    """No join per status table; a missing id is in no table."""
    from curveboard.operators import curate

    ids = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "run_id long")
    tables = {"done": ids.filter("run_id = 1"), "open": spark.createDataFrame([(2,), (9,), (None,)], "run_id long")}
    out = curate.id_coverage(ids, tables)
    assert "Join" not in out._jdf.queryExecution().toString()
    want = [("done", None), ("done", 2), ("done", 3), ("open", None), ("open", 1), ("open", 3)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_train_sets_shared_by_runs(spark):
    """Selections of many runs are checked against the train set of their bucket."""
    from curveboard.operators import pool

    picks = [(1, 0, 0, 5), (1, 0, 1, 6), (2, 1, 0, 5), (2, 1, 1, 8), (3, None, 0, 5)]
    selected = spark.createDataFrame(picks, "run_id int, bucket int, cycle int, sample_id int")
    train = spark.createDataFrame([(0, 5), (0, 6), (0, 6), (1, 8)], "bucket int, sample_id int")
    batch = selected.select("run_id").distinct().withColumn("batch_size", F.lit(1))
    out = pool.pool_violations(selected, train, batch, train_keys=["bucket"]).collect()
    assert sorted(map(tuple, out)) == [(2, 0, "not in train set", 1), (3, 0, "not in train set", 1)]

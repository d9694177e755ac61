"""Curation of metric tables: reduce, purge, repair, regroup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curveboard.functions.lists import round_list
from curveboard.functions.slices import first_rows, same_keys
from curveboard.schema import DIMS, QUERY_TIME_LIMIT

#: Metric rows that meet in one task.
ID_ROWS = 1 << 20


def reduce_to_runs(
    rows: DataFrame, dense: DataFrame, keys: Sequence[str] = ("run_id",), order_by=()
) -> DataFrame:
    """Keep rows of the dense runs only, first row per key."""
    kept = rows.join(dense.select("run_id").distinct(), "run_id", "left_semi")
    return first_rows(kept, keys, list(order_by))


def id_coverage(ids: DataFrame, status_tables: dict[str, DataFrame]) -> DataFrame:
    """(which, run_id): metric ids that a status table does not hold.

    All tables meet in one aggregate by id, in parts of about ``ID_ROWS`` metric rows at any size.
    """
    names = list(status_tables)
    marked = ids.select("run_id", F.lit(-1).alias("__table"))
    for n, name in enumerate(names):
        marked = marked.unionByName(status_tables[name].select("run_id", F.lit(n).alias("__table")))
    parts = max(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-ids.count() // ID_ROWS))
    held = marked.repartition(parts, "run_id").groupBy("run_id").agg(
        F.max(F.col("__table") < 0).alias("__wanted"),
        *[F.max(F.col("__table") == n).alias(f"__{n}") for n in range(len(names))],
    )
    # a missing id is in no table
    lacking = [F.when(F.col("run_id").isNull() | ~F.col(f"__{n}"), F.lit(name)) for n, name in enumerate(names)]
    return held.filter("__wanted").select(
        F.explode(F.array_compact(F.array(*lacking))).alias("which"), "run_id"
    )


def missing_from_some_metric(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """Ids of a group that at least one of the group's metrics lacks."""
    group = list(group)
    per_id = rows.groupBy(*group, "run_id").agg(F.countDistinct("metric").alias("present"))
    expected = rows.groupBy(*group).agg(F.countDistinct("metric").alias("expected"))
    return per_id.join(expected, group).filter("present < expected")


def duplicate_combinations(runs: DataFrame, keys: Sequence[str] = DIMS) -> DataFrame:
    """(first_id, later_id): later ids of a combination that an earlier id already ran.

    The first id comes from a map-side combined minimum and is joined back, so a
    combination with very many copies is never gathered in one place.
    """
    keys = list(keys)
    first = (
        runs.groupBy(*keys)
        .agg(F.min("run_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    return (
        runs.alias("l")
        .join(first.alias("r"), same_keys(keys))
        .filter("l.run_id <> r.first_id")
        .select("r.first_id", F.col("l.run_id").alias("later_id"))
    )


def reconcile_oom(oom: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """Out-of-memory runs that are neither done nor failed after all."""
    return purge(purge(oom, done), failed)


def purge(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Drop the rows of the given runs."""
    return rows.join(gone.select("run_id").distinct(), "run_id", "left_anti")


def purge_slow_runs(
    rows: DataFrame, query_times: DataFrame, limit: float = QUERY_TIME_LIMIT
) -> DataFrame:
    """Drop every run with a cycle above the time limit, from every metric."""
    slow = (
        query_times.groupBy("run_id").agg(F.max("value").alias("slowest")).filter(
            F.col("slowest") > limit
        )
    )
    return purge(rows, slow)


def purge_datasets(
    rows: DataFrame, runs: DataFrame, datasets: Sequence, extra_ids: Sequence[int] = ()
) -> DataFrame:
    gone = runs.filter(
        F.col("dataset").isin(list(datasets)) | F.col("run_id").isin(list(extra_ids))
    )
    return purge(rows, gone)


def purge_learner(rows: DataFrame, runs: DataFrame, learner) -> DataFrame:
    return purge(rows, runs.filter(F.col("learner") == learner))


def drop_repeated_headers(lines: DataFrame, id_name: str = "run_id", column: str = "value"):
    """Raw text lines without any line that names the id column.

    The header is known and written again with the file; a header of another width goes too.
    """
    return lines.filter(~F.coalesce(F.contains(F.col(column), F.lit(id_name)), F.lit(False)))


def drop_stray_index(df: DataFrame, name: str = "Unnamed: 0") -> DataFrame:
    return df.drop(name)


def repair_short_rows(lines: DataFrame, header_width: int, column: str = "value") -> DataFrame:
    """(run_id, cycle, value, cell, error) from raw lines, also where a short line misplaced its id.

    A line whose id column is missing or empty holds its id in the last filled cell;
    the cells before it are its cycles. Commas inside quotes do not separate cells, so list
    cells stay whole. Empty cycles are left out. A cell that is no number keeps its text in
    ``cell`` and has no ``value``; ``error`` is "id" where the id is no integer, "value" where
    the cell is neither a number nor a list, else null.
    """
    # a cell is a quoted text with doubled quotes inside, or anything without a comma
    found = F.regexp_extract_all(F.col(column), F.lit(r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'), 1)
    plain = F.transform(
        found,
        lambda c: F.trim(
            F.when(c.startswith('"'), F.replace(c.substr(F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"')))
            .otherwise(c)
        ),
    )
    rows = lines.select(plain.alias("__cells"))
    full = (F.size("__cells") >= header_width) & (F.get("__cells", F.lit(header_width - 1)) != "")
    filled = F.filter("__cells", lambda c: c != "")
    used = F.when(full, F.slice("__cells", 1, header_width)).otherwise(filled)
    rows = rows.select(used.alias("__used"))
    body = F.slice("__used", F.lit(1), F.size("__used") - 1)
    last = F.element_at("__used", -1)
    # ids may be written as 7.0; a long keeps ids beyond 2^53 exact
    ids = F.regexp_replace(last, r"\.0*$", "").try_cast("long")
    value = F.col("cell").try_cast("double")
    missing = F.lower("cell").isin("", "nan")
    wrong = F.when(F.col("run_id").isNull(), "id").when(
        value.isNull() & ~F.col("cell").startswith("["), "value"
    )
    return (
        rows.filter(F.size("__used") > 1)
        .select(ids.alias("run_id"), F.posexplode(body).alias("cycle", "cell"))
        .filter(~missing)
        .select("run_id", "cycle", value.alias("value"), "cell", wrong.alias("error"))
    )


def drop_double_logged(curve: DataFrame, min_cycles: int = 22, keys=("run_id",)) -> DataFrame:
    """Keep every second cycle and renumber, for curves wide enough to be double-logged."""
    wide = curve.groupBy(*keys).agg((F.max("cycle") + 1).alias("__width"))
    double = F.col("__width") >= min_cycles
    return (
        curve.join(wide, list(keys))
        .filter(~double | (F.col("cycle") % 2 == 0))
        .withColumn(
            "cycle", F.when(double, F.floor(F.col("cycle") / 2)).otherwise(F.col("cycle"))
            .cast("int")
        )
        .drop("__width")
    )


def reduce_precision(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round doubles and arrays of doubles, half to even."""
    out = []
    for name, kind in df.dtypes:
        if kind == "double":
            out.append(F.bround(name, digits).alias(name))
        elif kind == "array<double>":
            out.append(round_list(F.col(name), digits).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def regroup_by_run(rows: DataFrame, done_files: DataFrame | None = None, file: str = "path"):
    """Metric-major to run-major: one run's rows lie together, ordered for range reads.

    Rows are range-partitioned, so a run with very many rows spans several files.
    Files already processed are left out.
    """
    if done_files is not None:
        rows = rows.join(done_files.select(file).distinct(), file, "left_anti")
    return rows.repartitionByRange("run_id", "metric", "cycle").sortWithinPartitions(
        "run_id", "metric", "cycle"
    )


def recompute_jobs(broken: DataFrame, categorizers: Sequence[str]) -> DataFrame:
    """(kind, strategy, dataset) of the job that rebuilds each broken file."""
    lag = F.col("metric").endswith("_time_lag")
    kind = (
        F.when(lag, "TIMELAG")
        .when(F.col("metric").isin(list(categorizers)), "CATEGORIZATION")
        .otherwise(F.upper("metric"))
    )
    return broken.select(kind.alias("kind"), "strategy", "dataset").distinct()

"""Runtime and progress reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curveboard.functions.lists import merge_cells
from curveboard.functions.slices import first_rows
from curveboard.schema import QUERY_TIME_LIMIT


def runtime_by_strategy(
    times: DataFrame,
    fingerprint: Sequence[str],
    impute: str = "union",
    limit: float = QUERY_TIME_LIMIT,
) -> DataFrame:
    """Mean and population deviation of times per strategy, fastest first.

    A fingerprint missing for a strategy counts with the time limit: fingerprints any
    strategy has (``union``) or those all have (``intersection``, which never fires).
    Missing entries only shift count, sum and sum of squares, so none is written out.
    """
    held = times.groupBy("strategy").agg(
        F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")
    )
    prints = times.select(*fingerprint, "strategy").distinct()
    own = prints.groupBy("strategy").agg(F.count(F.lit(1)).alias("__own"))
    if impute == "union":
        wanted = prints.select(*fingerprint).distinct().agg(F.count(F.lit(1)))
        rows = held.join(own, "strategy").withColumn("__miss", wanted.scalar() - F.col("__own"))
    elif impute == "intersection":
        rows = held.withColumn("__miss", F.lit(0))
    else:
        raise ValueError(f"unknown imputation: {impute}")
    total = F.col("n") + F.col("__miss")
    mean = (F.col("n") * F.col("m") + F.col("__miss") * F.lit(limit)) / total
    gap = F.col("m") - F.lit(limit)
    variance = (
        F.col("n") * F.col("v") + F.col("n") * F.col("__miss") / total * gap * gap
    ) / total
    return rows.select(
        "strategy", mean.alias("mean"), F.sqrt(variance).alias("std"), total.alias("n")
    ).orderBy("mean", "strategy")


def _grouped(rows: DataFrame, dims: Sequence[str], sets: Sequence[Sequence[str]], sums: dict):
    """Sums per grouping set; rows combine on the map side, so only groups are shuffled."""
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *dims).agg(
        *[F.sum(c).alias(n) for n, c in sums.items()], F.grouping_id().alias("__gid")
    )
    names = F.when(F.lit(False), "")
    for s in sets:
        mask = sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in s)
        names = names.when(F.col("__gid") == mask, ",".join(s))
    return grouped.withColumn("grouping", names).drop("__gid")


def run_counts(
    runs: DataFrame,
    sets: Sequence[Sequence[str]] = (("dataset", "strategy"), ("dataset",), ("strategy",)),
) -> DataFrame:
    """Number of runs per grouping."""
    dims = sorted({c for s in sets for c in s})
    one = runs.withColumn("__one", F.lit(1).cast("long"))
    return _grouped(one, dims, sets, {"runs": "__one"}).select("grouping", *dims, "runs")


def mean_times(
    runs: DataFrame, totals: DataFrame, sets: Sequence[Sequence[str]]
) -> DataFrame:
    """Mean total seconds per grouping; ``totals``: run_id, seconds."""
    dims = sorted({c for s in sets for c in s})
    rows = runs.join(totals, "run_id").withColumn("__one", F.lit(1).cast("long"))
    summed = _grouped(rows, dims, sets, {"seconds": "seconds", "runs": "__one"})
    return summed.select(
        "grouping", *dims, (F.col("seconds") / F.col("runs")).alias("mean_seconds"), "runs"
    )


def done_matrix(
    done: DataFrame,
    open_runs: DataFrame,
    filters: dict[str, Sequence] | None = None,
) -> DataFrame:
    """Done and total runs per dataset x strategy, zero-filled, sorted by name."""
    from curveboard.operators.leaderboard import complete_cells

    cols = ["run_id", "dataset", "strategy", *(filters or {})]
    both = done.select(*cols).withColumn("__done", F.lit(1)).unionByName(
        open_runs.select(*cols).withColumn("__done", F.lit(0))
    )
    runs = first_rows(both, ["run_id"], [-F.col("__done")])
    for name, values in (filters or {}).items():
        runs = runs.filter(F.col(name).isin(list(values)))
    cells = runs.groupBy("dataset", "strategy").agg(
        F.count(F.lit(1)).alias("n"), F.sum("__done").alias("done")
    )
    return (
        complete_cells(cells, [])
        .select(
            "dataset",
            "strategy",
            F.coalesce("done", F.lit(0)).cast("long").alias("done"),
            F.col("n").cast("long").alias("total"),
        )
        .orderBy(F.col("dataset").cast("string"), F.col("strategy").cast("string"))
    )


def melt_cycles(wide: DataFrame, ids: Sequence[str] = ("strategy", "dataset")) -> DataFrame:
    """Wide cycles to (ids, cycle, value) rows for curves and runtimes."""
    cycles = [c for c in wide.columns if c.isdigit()]
    return wide.unpivot(list(ids), cycles, "cycle", "value").withColumn(
        "cycle", F.col("cycle").cast("int")
    )


def filtered_runs(
    runs: DataFrame, filters: dict[str, Sequence], names: dict[str, DataFrame] | None = None
) -> DataFrame:
    """Runs whose parameters are in the given lists, codes replaced by names.

    ``names``: column -> table (column, name) of the short code list.
    """
    for column, values in filters.items():
        runs = runs.filter(F.col(column).isin(list(values)))
    for column, table in (names or {}).items():
        named = table.select(column, F.col("name").alias(f"{column}_name"))
        runs = runs.join(named, column, "left")
    return runs


def merged_lists(cells: DataFrame, mode: str, column: str = "cell") -> DataFrame:
    """Apply a list-cell merge mode; ``*_list`` modes gather a run's cycles in order.

    A run has one value per cycle, up to its planned number of queries.
    """
    merged = cells.withColumn("value", merge_cells(F.col(column), mode))
    if mode in ("original", "original_mean"):
        return merged.drop(column)
    return merged.groupBy("run_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("cycle", "value"))), lambda x: x["value"]
        ).alias("values")
    )


def renamed(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Display name for a code; names are (code, short), unknown codes stay as they are."""
    return (
        df.join(names.select(F.col("code").alias(column), "short"), column, "left")
        .withColumn("label", F.coalesce("short", F.col(column).cast("string")))
        .drop("short")
    )


def metric_of_runs(metric: DataFrame, runs: DataFrame) -> DataFrame:
    """Metric rows of the selected runs, exact copies removed."""
    return metric.join(runs, "run_id").dropDuplicates()


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole)

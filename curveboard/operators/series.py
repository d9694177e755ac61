"""Long time series: join to runs, unpivot, phase slices, extracts and recipes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curveboard.functions.slices import CHUNK, percentiles
from curveboard.schema import DIMS


def with_runs(metric: DataFrame, runs: DataFrame) -> DataFrame:
    """Metric rows with the dimensions of their run; seed and planned length are left out."""
    return metric.join(runs.drop("seed", "num_queries"), "run_id", "left")


def stack_metrics(metrics: dict[str, DataFrame], runs: DataFrame) -> DataFrame:
    """Several metrics under one ``metric`` column, values as float."""
    stacked = reduce(
        lambda a, b: a.unionByName(b),
        [df.withColumn("metric", F.lit(name)) for name, df in metrics.items()],
    ).withColumn("value", F.col("value").cast("float"))
    return with_runs(stacked, runs)


#: Cycles that a wide table can have as columns.
MOST_COLUMNS = 5000


def unpivot_cycles(wide: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Wide metric table to (ids..., ix, id_ix, value), nulls skipped."""
    cycles = [c for c in wide.columns if c not in ids]
    long = wide.unpivot(list(ids), cycles, "ix", "value").filter("value is not null")
    return long.select(
        *[c for c in ids if c != "run_id"],
        F.col("ix").cast("int").alias("ix"),
        F.concat_ws("_", F.col("run_id").cast("string"), F.col("ix")).alias("run_ix"),
        "value",
    )


def pivot_cycles(
    curve: DataFrame, ids: Sequence[str], cycles: Sequence[int] | None = None
) -> DataFrame:
    """Long curve to one column per cycle, for export.

    Without ``cycles`` all cycles of the table become columns: one aggregate gives the last one. A
    table of more than ``MOST_COLUMNS`` cycles is refused: it cannot be planned, and one wrong cycle
    number is the likely reason.
    """
    if cycles is None:
        last = curve.agg(F.max("cycle")).first()[0]
        cycles = range(0 if last is None else int(last) + 1)
    if len(cycles) > MOST_COLUMNS:
        raise ValueError(f"{len(cycles)} cycles cannot become columns; name the cycles to export")
    return curve.groupBy(*ids).pivot("cycle", list(cycles)).agg(F.first("value"))


def sorted_series(series: DataFrame, order: Sequence[str]) -> DataFrame:
    """Globally ordered rows, for writing a Parquet table that prunes well."""
    return series.repartitionByRange(*order).sortWithinPartitions(*order)


def unbuilt_metrics(wanted: DataFrame, built: DataFrame) -> DataFrame:
    return wanted.select("metric").distinct().join(
        built.select("metric").distinct(), "metric", "left_anti"
    )


def phase_slice(cell: Column, phase: str, cutoff: Column | None = None, k: int = 5) -> Column:
    """Slice of a flattened selection: first/last k, final, ramp-up or plateau."""
    n = F.size(cell)
    if phase == "full":
        return cell
    if phase == "first":
        return F.slice(cell, 1, k)
    if phase == "last":
        return F.when(n <= k, cell).otherwise(F.slice(cell, F.greatest(n - k, F.lit(0)) + 1, k))
    if phase == "final":
        return F.slice(cell, F.greatest(n, F.lit(1)), 1)
    at = cutoff.cast("int")
    if phase == "ramp_up":
        return F.slice(cell, F.lit(1), at)
    if phase == "plateau":
        return F.slice(cell, at + 1, F.greatest(n - at, F.lit(0)))
    raise ValueError(f"unknown phase: {phase}")


def selection_phases(selections: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """All phase slices of each run's selection; runs without cutoff are dropped."""
    joined = selections.join(cutoffs.filter("cutoff is not null"), "run_id")
    cell, cut = F.col("sample_ids"), F.col("cutoff")
    return joined.select(
        *[c for c in selections.columns if c != "sample_ids"],
        phase_slice(cell, "ramp_up", cut).alias("ramp_up"),
        phase_slice(cell, "plateau", cut).alias("plateau"),
        phase_slice(cell, "first").alias("first_5"),
        phase_slice(cell, "last").alias("last_5"),
    )


def learning_curve(
    series: DataFrame, fixed: dict[str, object], by: Sequence[str] = ("strategy", "cycle")
) -> DataFrame:
    """Mean, spread and 95 % band of the values by strategy and cycle for fixed settings."""
    rows = series
    for name, value in fixed.items():
        rows = rows.filter(F.col(name) == value)
    band = percentiles(rows, by, "value", {"low": 0.025, "high": 0.975})
    means = rows.groupBy(*by).agg(
        F.avg("value").alias("mean"), F.stddev("value").alias("std"), F.count("value").alias("n")
    )
    return means.join(band, list(by))


def summary_by(scores: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    return scores.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev(value).alias("std"), F.count(value).alias("n")
    )


def top_by(scores: DataFrame, by: str, k: int, value: str = "value") -> DataFrame:
    """The k best values of one dimension by mean score."""
    return summary_by(scores, [by], value).orderBy(F.desc("mean"), by).limit(k)


def fingerprint(columns: Sequence[str] = tuple(DIMS)) -> Column:
    """Underscore-joined settings, for display; joins use the columns themselves."""
    return F.concat_ws("_", *[F.col(c).cast("string") for c in columns])


__all__ = [
    "CHUNK",
    "fingerprint",
    "learning_curve",
    "phase_slice",
    "pivot_cycles",
    "selection_phases",
    "sorted_series",
    "stack_metrics",
    "summary_by",
    "top_by",
    "unbuilt_metrics",
    "unpivot_cycles",
    "with_runs",
]

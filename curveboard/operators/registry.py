"""Extension points: own curve metrics, own categorisers, per-row work."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curveboard.operators.categorize import CATEGORIZERS

# Per-cycle metrics: name -> function of (prediction, label) columns, aggregated per key.
CYCLE_METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "accuracy": lambda guess, truth: F.avg((guess == truth).cast("double")),
    "error_rate": lambda guess, truth: F.avg((guess != truth).cast("double")),
}

# Curve metrics: name -> aggregate over one curve's (value, cycle) columns.
CURVE_METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "full_auc": lambda value, cycle: F.avg(value),
    "final_value": lambda value, cycle: F.max_by(value, cycle),
    "best_value": lambda value, cycle: F.max(value),
    "worst_value": lambda value, cycle: F.min(value),
}


def register_cycle_metric(name: str, function: Callable[[Column, Column], Column]) -> None:
    CYCLE_METRICS[name] = function


def register_curve_metric(name: str, function: Callable[[Column, Column], Column]) -> None:
    CURVE_METRICS[name] = function


def register_categorizer(name: str, function: Callable[..., DataFrame]) -> None:
    CATEGORIZERS[name] = function


def cycle_metrics(
    predictions: DataFrame, keys: Sequence[str], names: Sequence[str] | None = None
) -> DataFrame:
    """All named per-cycle metrics in one aggregate."""
    wanted = names or list(CYCLE_METRICS)
    guess, truth = F.col("y_pred"), F.col("label")
    return predictions.groupBy(*keys).agg(
        *[CYCLE_METRICS[n](guess, truth).alias(n) for n in wanted]
    )


def apply_to_curves(
    curve: DataFrame, names: Sequence[str] | None = None, keys: Sequence[str] = ("run_id",)
) -> DataFrame:
    """All named curve metrics in one aggregate; cycle 0 and nulls are left out."""
    wanted = names or list(CURVE_METRICS)
    rows = curve.filter((F.col("cycle") > 0) & F.col("value").isNotNull())
    return rows.groupBy(*keys).agg(
        *[CURVE_METRICS[n](F.col("value"), F.col("cycle")).alias(n) for n in wanted]
    )


def categorize(name: str, *tables, **options) -> DataFrame:
    """Run a registered categoriser and tag its rows."""
    return CATEGORIZERS[name](*tables, **options).withColumn("categorizer", F.lit(name))


def for_each_row(
    rows: DataFrame, function: Callable[[dict], dict | list[dict]], schema: str
) -> DataFrame:
    """Own Python work per row with one or several result rows, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[dict] = []
            for record in batch.to_dict("records"):
                result = function(record)
                out.extend(result if isinstance(result, list) else [result])
            if out:
                yield pd.DataFrame(out)

    return rows.mapInPandas(run, schema)


def expand_cycles(cells: DataFrame, column: str = "values") -> DataFrame:
    """One row with an array of cycle values to one row per cycle."""
    return cells.select(
        *[c for c in cells.columns if c != column],
        F.posexplode(column).alias("cycle", "value"),
    )


def population_std(value: str | Column) -> Column:
    return F.stddev_pop(value)

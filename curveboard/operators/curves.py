"""Learning-curve metrics over long curves (keys..., cycle, value).

Means and last values are plain aggregates. Whatever needs an order is written once over
``slices.framed``/``slices.running`` and runs twice: ordinary curves are windows over one exchange,
very long ones are cut into chunks of ``chunk`` cycles. ``keys`` names the columns of one curve, for
example run and metric.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from curveboard.functions.slices import CHUNK, by_size, first_rows, framed, running, same_keys
from curveboard.operators.cells import written
from curveboard.schema import AGGREGATE_PREFIXES, NON_CURVE_PREFIXES, TIME_LAG_EXCLUDED

RUN = ("run_id",)


def _each(
    curve: DataFrame, keys: Sequence[str], chunk: int, operator: Callable[[DataFrame, int | None], DataFrame]
) -> DataFrame:
    """An operator on ordinary curves as windows, on very long ones in chunks."""
    return by_size(curve, keys, lambda rows: operator(rows, None), lambda rows: operator(rows, chunk))


def _slice(column: str, chunk: int | None):
    return None if chunk is None else F.floor(F.col(column) / chunk)


def evaluated(curve: DataFrame) -> DataFrame:
    """Cycle 0 is the given start set; nulls are cycles without a value."""
    return curve.filter((F.col("cycle") > 0) & F.col("value").isNotNull())


def full_mean(curve: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    return evaluated(curve).groupBy(*keys).agg(F.avg("value").alias("full_auc"))


def first_mean(curve: DataFrame, k: int = 5, keys: Sequence[str] = RUN) -> DataFrame:
    """Mean of the first k values. Each map task keeps k rows per run before the shuffle."""
    order = W.partitionBy(*keys).orderBy("cycle")
    head = evaluated(curve).withColumn("__rn", F.row_number().over(order)).filter(F.col("__rn") <= k)
    return head.groupBy(*keys).agg(F.avg("value").alias(f"first_{k}"))


def last_mean(curve: DataFrame, k: int = 5, keys: Sequence[str] = RUN) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.desc("cycle"))
    tail = evaluated(curve).withColumn("__rn", F.row_number().over(order)).filter(F.col("__rn") <= k)
    return tail.groupBy(*keys).agg(F.avg("value").alias(f"last_{k}"))


def final_value(curve: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    return evaluated(curve).groupBy(*keys).agg(F.max_by("value", "cycle").alias("final_value"))


def phase_means(
    curve: DataFrame, cutoffs: DataFrame, keys: Sequence[str] = RUN, chunk: int = CHUNK
) -> DataFrame:
    """Ramp-up ``[0, cutoff)`` and plateau ``[cutoff, end)`` means after cycle 0 is removed.

    A run without cutoff is split at half its row length, counted as the cycles after
    the first plus the id cell.
    """

    def means(rows: DataFrame, chunk: int | None) -> DataFrame:
        joined = framed(rows, keys, chunk=chunk).join(
            cutoffs.select(*keys, "cutoff"), list(keys), "left"
        )
        cut = F.coalesce(F.col("cutoff").cast("long"), F.floor((F.col("width") + 1) / 2))
        return joined.groupBy(*keys).agg(
            F.avg(F.when(F.col("pos") < cut, F.col("value"))).alias("ramp_up_auc"),
            F.avg(F.when(F.col("pos") >= cut, F.col("value"))).alias("plateau_auc"),
        )

    return _each(curve.filter("cycle > 0"), keys, chunk, means)


def learning_stability(
    curve: DataFrame, ks: Sequence[int] = (5, 10), keys: Sequence[str] = RUN, chunk: int = CHUNK
) -> DataFrame:
    """Mean of the last k differences over the mean of all; 0 where the overall mean is <= 0.

    The last k are counted over all cycles, with or without a value.
    """

    def steps(rows: DataFrame, chunk: int | None) -> DataFrame:
        diff = F.col("value") - F.col("prev")
        return (
            framed(rows, keys, chunk=chunk)
            .groupBy(*keys)
            .agg(
                F.avg(diff).alias("__all"),
                *[
                    F.avg(F.when(F.col("ix") >= F.col("width") - k, diff)).alias(f"__last_{k}")
                    for k in ks
                ],
            )
        )

    per_run = _each(curve.filter("cycle > 0"), keys, chunk, steps)
    return per_run.select(
        *keys,
        *[
            F.when(F.col("__all") <= 0, F.lit(0.0))
            .otherwise(F.try_divide(F.col(f"__last_{k}"), F.col("__all")))
            .alias(f"learning_stability_{k}")
            for k in ks
        ],
    )


def time_lag(curve: DataFrame, keys: Sequence[str] = RUN, chunk: int = CHUNK) -> DataFrame:
    """First differences; cycle 0 has none."""

    def steps(rows: DataFrame, chunk: int | None) -> DataFrame:
        return (
            framed(rows, keys, chunk=chunk)
            .filter("ix > 0")
            .select(*keys, "cycle", (F.col("value") - F.col("prev")).alias("value"))
        )

    return _each(curve, keys, chunk, steps)


def _transitions(
    curve: DataFrame, keys: Sequence[str], chunk: int, legacy_drop_first: bool, op: str, column: str
) -> DataFrame:
    """Negated running ``op`` of what happens between a cycle and the next."""

    def upto(rows: DataFrame, chunk: int | None) -> DataFrame:
        steps = framed(rows, keys, chunk=chunk).filter(F.col("ix") < F.col("width") - 1)
        steps = steps.select(
            *keys,
            "cycle",
            F.greatest(F.col("value") - F.col("next"), F.lit(0.0)).alias("drop"),
            F.when(F.col("next") < F.col("value"), 1).otherwise(0).alias("fell"),
        )
        return running(steps, keys, _slice("cycle", chunk), ["cycle"], {"m": (op, column)})

    kept = F.col("cycle") > 0 if legacy_drop_first else F.lit(True)
    return _each(curve, keys, chunk, upto).filter(kept)


def biggest_drop(
    curve: DataFrame,
    keys: Sequence[str] = RUN,
    chunk: int = CHUNK,
    legacy_drop_first: bool = False,
) -> DataFrame:
    """Negated largest fall so far, stored at the cycle it starts from."""
    out = _transitions(curve, keys, chunk, legacy_drop_first, "max", "drop")
    return out.select(*keys, "cycle", (F.lit(0.0) - F.col("m")).alias("value"))


def decreasing_cycles(
    curve: DataFrame,
    keys: Sequence[str] = RUN,
    chunk: int = CHUNK,
    legacy_drop_first: bool = False,
) -> DataFrame:
    """Negated number of falls so far."""
    out = _transitions(curve, keys, chunk, legacy_drop_first, "sum", "fell")
    return out.select(*keys, "cycle", (-F.col("m")).alias("value"))


def ramp_cutoffs(
    curve: DataFrame, keys: Sequence[str] = RUN, window: int = 5, chunk: int = CHUNK
) -> DataFrame:
    """Where a baseline curve leaves its ramp.

    The smallest start in ``1 .. n-window`` whose window mean exceeds the overall
    mean, else half the length rounded half to even. A window that crosses a chunk
    border sees the next chunk's first rows, which are copied over.
    """
    keys = list(keys)

    def starts(rows: DataFrame, chunk: int | None) -> DataFrame:
        spots = framed(rows, keys, chunk=chunk).select(*keys, "pos", "n", "value")
        if chunk is None:
            whole = W.partitionBy(*keys)
            means = spots.select(
                "*",
                F.avg("value").over(whole.orderBy("pos").rowsBetween(0, window - 1)).alias("__mean"),
                F.avg("value").over(whole).alias("__overall"),
            )
        else:
            own = F.floor(F.col("pos") / chunk)
            first = F.greatest(F.floor((F.col("pos") - (window - 1)) / chunk), F.lit(0))
            halo = spots.withColumn("__part", F.explode(F.sequence(first, own)))
            ahead = W.partitionBy(*keys, "__part").orderBy("pos").rowsBetween(0, window - 1)
            means = halo.withColumn("__mean", F.avg("value").over(ahead)).filter(
                F.col("__part") == F.floor(F.col("pos") / chunk)
            )
            overall = spots.groupBy(*keys).agg(F.avg("value").alias("__overall"))
            means = means.join(overall, keys)
        above = (
            (F.col("__mean") > F.col("__overall"))
            & (F.col("pos") >= 1)
            & (F.col("pos") <= F.col("n") - window)
        )
        return means.groupBy(*keys).agg(
            F.min(F.when(above, F.col("pos"))).alias("__start"), F.first("n").alias("__n")
        )

    return _each(curve.filter(F.col("value").isNotNull()), keys, chunk, starts).select(
        *keys,
        F.coalesce(
            F.col("__start").cast("double"), F.bround(F.col("__n") / F.lit(2.0), 0)
        ).alias("cutoff"),
    )


def spread_cutoffs(
    baseline: DataFrame,
    runs: DataFrame,
    dims: Sequence[str] = ("dataset", "batch", "learner", "bucket", "start_point"),
) -> DataFrame:
    """(run_id, cutoff) of every run from the baseline run with the same settings.

    ``baseline``: dims + cutoff. Runs without a baseline keep a null cutoff, baselines
    without a run a null id.
    """
    left, right = runs.alias("l"), baseline.alias("r")
    return left.join(right, same_keys(dims), "full_outer").select("l.run_id", "r.cutoff")


def change_point(curve: DataFrame, keys: Sequence[str] = RUN, chunk: int = CHUNK) -> DataFrame:
    """Start of the second segment in the best two-segment fit by squared error.

    Prefix sums give the error of every split in one pass. A segment holds two
    values at least and starts at a multiple of five.
    """
    keys = list(keys)

    def splits(rows: DataFrame, chunk: int | None) -> DataFrame:
        spots = framed(rows, keys, chunk=chunk).select(
            *keys, "pos", "n", "value", (F.col("value") * F.col("value")).alias("square")
        )
        sums = running(
            spots,
            keys,
            _slice("pos", chunk),
            ["pos"],
            {"s": ("sum", "value"), "q": ("sum", "square")},
        )
        if chunk is None:
            whole = W.partitionBy(*keys)
            sums = sums.select(
                "*", F.sum("value").over(whole).alias("__s"), F.sum("square").over(whole).alias("__q")
            )
        else:
            totals = spots.groupBy(*keys).agg(
                F.sum("value").alias("__s"), F.sum("square").alias("__q")
            )
            sums = sums.join(totals, keys)
        left = F.col("pos") + 1
        right = F.col("n") - left
        error = (
            F.col("q")
            - F.col("s") * F.col("s") / left
            + (F.col("__q") - F.col("q"))
            - (F.col("__s") - F.col("s")) * (F.col("__s") - F.col("s")) / right
        )
        fits = (left >= 2) & (right >= 2) & (left % 5 == 0)
        return (
            sums.filter(fits)
            .select(*keys, left.alias("split"), error.alias("error"))
            .groupBy(*keys)
            .agg(F.min_by("split", F.struct("error", "split")).alias("cutoff"))
        )

    return _each(curve.filter(F.col("value").isNotNull()), keys, chunk, splits)


def trapezoid(curve: DataFrame, keys: Sequence[str] = RUN, chunk: int = CHUNK) -> DataFrame:
    """Trapezoid area, and the same over the area of a constant 1."""

    def areas(rows: DataFrame, chunk: int | None) -> DataFrame:
        area = F.sum(F.when(F.col("ix") > 0, (F.col("value") + F.col("prev")) / 2))
        steps = framed(rows, keys, chunk=chunk).groupBy(*keys)
        return steps.agg(area.alias("auc"), F.max("width").alias("__n"))

    out = _each(curve, keys, chunk, areas)
    return out.withColumn("normalised_auc", F.try_divide(F.col("auc"), F.col("__n") - 1)).drop("__n")


def eligible_metrics(metrics: DataFrame, family: str = "curve") -> DataFrame:
    """Metrics that get curve aggregates (``curve``) or a time lag (``time_lag``)."""
    name = F.col("metric")
    blocked = reduce(
        lambda a, b: a | b, [name.startswith(p) for p in AGGREGATE_PREFIXES + NON_CURVE_PREFIXES]
    )
    if family == "time_lag":
        for part in TIME_LAG_EXCLUDED:
            blocked = blocked | name.contains(part)
        blocked = blocked | name.endswith("_time_lag")
    return metrics.filter(~blocked)


def wide_join(
    frames: Sequence[DataFrame], key: str = "run_id", order_by: Sequence[str] = ()
) -> DataFrame:
    """Outer join of several metric tables on the id, first row per id of each.

    ``order_by`` names the columns that give the order of files and rows; they are left out of
    the result. Without them the smallest values come first, so that the choice is repeatable.
    """
    firsts = [
        first_rows(f, [key], list(order_by) or [c for c in f.columns if c != key]).drop(*order_by)
        for f in frames
    ]
    return reduce(lambda a, b: a.join(b, key, "full_outer"), firsts)


def missing_outputs(
    requested: DataFrame,
    existing: DataFrame,
    keys: Sequence[str] = ("strategy", "dataset", "metric"),
    overwrite: bool = False,
) -> DataFrame:
    """Requested outputs that still have to be computed."""
    if overwrite:
        return requested
    return requested.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def pad_curves(curve: DataFrame, lengths: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Null rows up to the planned number of cycles; only for wide export.

    Nothing is cut: cycles beyond the plan, and runs without a plan, stay as they are.
    """
    slots = lengths.filter("num_queries > 0").select(
        *keys,
        F.explode(F.sequence(F.lit(0), F.col("num_queries").cast("int") - 1)).alias("cycle"),
    )
    return slots.join(curve.select(*keys, "cycle", "value"), [*keys, "cycle"], "full_outer")


def curve_aggregates(
    curve: DataFrame, cutoffs: DataFrame, keys: Sequence[str] = RUN, chunk: int = CHUNK
) -> DataFrame:
    """Full, first 5, last 5, final, ramp-up and plateau means from one framed pass."""

    # a row per run, read by both branches
    cuts = written(cutoffs.select(*keys, "cutoff"))

    def means(rows: DataFrame, chunk: int | None) -> DataFrame:
        spots = framed(rows, keys, chunk=chunk).join(cuts, list(keys), "left")
        cut = F.coalesce(F.col("cutoff").cast("long"), F.floor((F.col("width") + 1) / 2))
        v = F.col("value")
        return spots.filter(v.isNotNull()).groupBy(*keys).agg(
            F.avg(v).alias("full_auc"),
            F.avg(F.when(F.col("pos") < 5, v)).alias("first_5"),
            F.avg(F.when(F.col("pos") >= F.col("n") - 5, v)).alias("last_5"),
            F.max_by("value", "cycle").alias("final_value"),
            F.avg(F.when(F.col("pos") < cut, v)).alias("ramp_up_auc"),
            F.avg(F.when(F.col("pos") >= cut, v)).alias("plateau_auc"),
        )

    return _each(curve.filter("cycle > 0"), keys, chunk, means)

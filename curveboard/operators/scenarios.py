"""Robustness scenarios: seeded samples of settings, one leaderboard each.

A scenario is a row, not a loop step. Samples are ordered by an MD5 digest of seed,
scenario and value, so they do not change with partitioning. Every scenario's board
comes from one job with the scenario as a group key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from curveboard.functions.slices import position
from curveboard.operators import incidence
from curveboard.operators.leaderboard import (
    QUARTILES,
    complete_cells,
    interpolated,
    picked_percentiles,
    robust_scaled,
    totals,
)
from curveboard.session import cut_lineage

GROUP = ("dataset", "start_point", "batch", "learner", "bucket")

# Largest number of values drawn per parameter under a random budget.
DRAW_LIMITS = {"dataset": 29, "start_point": 19, "bucket": 5, "batch": 2, "learner": 2}


def draw(seed: int | Column, *parts: str | Column) -> Column:
    """Repeatable draw as a hex string; orders and fractions come from it."""
    cols = [seed if isinstance(seed, Column) else F.lit(str(seed))]
    cols += [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def fraction(digest: Column) -> Column:
    """Digest as a number in [0, 1)."""
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def scenario_board(
    scores: DataFrame,
    picks: DataFrame,
    keys: Sequence[str],
    by: Sequence[str] = ("scenario",),
    interpolation: str = "average_of_same_strategy",
) -> DataFrame:
    """Total vector per scenario under robust scaling.

    ``picks``: by + keys, the settings each scenario picked. Scores are first reduced to cells per
    (keys, dataset, strategy) and to counts per (keys, dataset, value); scenarios meet these as
    rows of an incidence matrix (``incidence``), never the score rows.
    """
    by, keys = list(by), list(keys)
    if keys == ["dataset"]:
        # every setting is a dataset of its own: cells and quartiles are the same in all scenarios
        base = _cells(scores, ["dataset"])
        grouped = picks.select(*by, *keys).join(base, keys)
        spread = picked_percentiles(scores, picks, by, keys, QUARTILES)
    else:
        grouped, spread = incidence.boards(_cells(scores, keys), scores, picks, keys, by, QUARTILES)
    cells = robust_scaled(complete_cells(grouped, by), spread, by)
    return totals(interpolated(cells, interpolation, by), by)


def _cells(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    return scores.groupBy(*dict.fromkeys([*keys, "dataset", "strategy"])).agg(
        F.sum("value").alias("s"),
        F.count("value").alias("n"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
    )


def sample_values(
    scenarios: DataFrame, values: DataFrame, dimension: str, seed: int = 0
) -> DataFrame:
    """k random values of one dimension per scenario: (scenario, k, dimension).

    ``scenarios``: scenario, k. Values come from the dimension's short list; a
    scenario asking for more values than there are draws none.
    """
    listed = values.select(dimension).distinct().agg(
        F.sort_array(F.collect_set(dimension)).alias("v")
    )
    slots = scenarios.withColumn("__all", listed.scalar()).filter(F.size("__all") >= F.col("k"))
    order = W.partitionBy("scenario").orderBy("__digest", dimension)
    return (
        slots.select("scenario", "k", F.explode("__all").alias(dimension))
        .withColumn("__digest", draw(seed, "scenario", dimension))
        .withColumn("__rn", F.row_number().over(order))
        .filter(F.col("__rn") <= F.col("k"))
        .select("scenario", "k", dimension)
    )


def value_scenarios(
    scores: DataFrame,
    scenarios: DataFrame,
    dimension: str,
    seed: int = 0,
    fixed: Column | None = None,
) -> DataFrame:
    """Boards on k random values of a dimension (start points, datasets).

    ``fixed`` restricts the scores, and so the values to draw, first; a scenario with null k takes all of them. A scenario
    without a score, or one that asks for more values than there are, comes out once with null
    strategy and total.
    """
    rows = scores if fixed is None else scores.filter(fixed)
    picks = sample_values(scenarios.filter("k is not null"), rows, dimension, seed).drop("k")
    if fixed is not None:
        options = scores.agg(F.collect_set(dimension))
        everything = scenarios.filter("k is null").select(
            "scenario", F.explode(options.scalar()).alias(dimension)
        )
        picks = picks.unionByName(everything)
    boards = scenario_board(rows, picks, [dimension], ["scenario"])
    return scenarios.join(boards, "scenario", "left").select(
        "scenario", "strategy", "total", *[c for c in scenarios.columns if c != "scenario"]
    )


def sample_groups(
    scenarios: DataFrame, groups: DataFrame, keys: Sequence[str] = GROUP, seed: int = 0
) -> DataFrame:
    """n random setting groups per scenario: (scenario, k, keys).

    The distinct groups are numbered once, in the order of their keys; a scenario cuts the
    numbers into k equal strata and draws one number of each. So a scenario costs k rows,
    whatever the number of groups, and each group is drawn with probability k / groups. A
    scenario that asks for all groups or more gets all.
    """
    keys = list(keys)
    distinct = groups.select(*keys).distinct()
    numbered = position(distinct, [], F.col(keys[0]), keys, "__at")
    count = distinct.agg(F.count(F.lit(1))).scalar()
    k, j = F.col("__k"), F.col("__j")
    low = F.floor(j * F.col("__all") / k)
    width = F.floor((j + 1) * F.col("__all") / k) - low
    at = low + F.floor(fraction(draw(seed, "scenario", j)) * width)
    slots = (
        scenarios.select("scenario", "k")
        .withColumn("__all", count)
        .withColumn("__k", F.least("k", "__all"))
        .filter("__k > 0")
        .withColumn("__j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__k") - 1)))
    )
    return slots.select("scenario", "k", at.alias("__at")).join(numbered, "__at").drop("__at")


def group_scenarios(
    scores: DataFrame, scenarios: DataFrame, keys: Sequence[str] = GROUP, seed: int = 0
) -> DataFrame:
    """Boards on n random setting groups, joined back to their scores."""
    picks = sample_groups(scenarios, scores, keys, seed)
    return scenario_board(scores, picks, keys, ["scenario", "k"])


def reduced_group_scenarios(
    scores: DataFrame,
    scenarios: DataFrame,
    parameter: str,
    keys: Sequence[str] = GROUP,
    seed: int = 0,
) -> DataFrame:
    """As ``group_scenarios`` with one parameter held at its smallest value."""
    smallest = scores.agg(F.min(parameter))
    kept = scores.filter(F.col(parameter) == smallest.scalar())
    return group_scenarios(kept, scenarios, keys, seed).withColumn("parameter", F.lit(parameter))


def _parameter_lists(groups: DataFrame, parameters: Sequence[str]) -> DataFrame:
    """One row: the short list of values of every parameter."""
    return groups.agg(
        F.struct(
            *[
                F.sort_array(F.collect_set(F.col(p).cast("string"))).alias(p)
                for p in parameters
            ]
        ).alias("lists")
    )


def random_subsets(
    scenarios: DataFrame,
    groups: DataFrame,
    parameters: Sequence[str],
    limits: dict[str, int] | None = None,
    seed: int = 0,
    skip: str | None = None,
) -> DataFrame:
    """Random parameters with random values until the budget is reached.

    ``limits``: largest number of values drawn per parameter; by default all that the groups
    hold. ``scenarios``: scenario, attempt, budget [, target]. Parameters come in a random
    order; each takes part while the grid built so far is within the budget. Output
    per scenario: a list of allowed values per parameter (null = unrestricted) and the
    size of the resulting grid.
    """
    parameters = list(parameters)
    lists = _parameter_lists(groups, parameters)
    key = ["scenario", "attempt"]
    slots = scenarios.withColumn("__lists", lists.scalar()).select(
        *scenarios.columns,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(p).alias("parameter"),
                        (F.lit(limits[p]) if limits else F.size(f"__lists.{p}")).alias("limit"),
                        F.col(f"__lists.{p}").alias("options"),
                    )
                    for p in parameters
                ]
            )
        ).alias("__p"),
    ).select(*scenarios.columns, "__p.*")
    if skip is not None:
        slots = slots.filter(F.col("parameter") != F.col(skip))
    luck = fraction(draw(seed, "scenario", "attempt", "parameter", F.lit("amount")))
    amount = F.least(
        F.floor(luck * F.col("limit")).cast("int") + 1, F.size("options")
    )
    chosen = F.slice(
        F.transform(
            F.sort_array(
                F.transform(
                    "options",
                    lambda v: F.struct(
                        draw(seed, "scenario", "attempt", "parameter", v).alias("d"), v.alias("v")
                    ),
                )
            ),
            lambda x: x["v"],
        ),
        F.lit(1),
        amount,
    )
    order = W.partitionBy(*key).orderBy("__order", "parameter")
    taken = (
        slots.withColumn("__order", draw(seed, "scenario", "attempt", "parameter"))
        .withColumn("chosen", chosen)
        .withColumn(
            "__before",
            F.coalesce(
                F.sum(F.ln(F.size("chosen").cast("double"))).over(
                    order.rowsBetween(W.unboundedPreceding, -1)
                ),
                F.lit(0.0),
            ),
        )
        .withColumn("used", F.round(F.exp("__before")) <= F.col("budget"))
    )
    carried = [c for c in scenarios.columns if c not in key]
    return taken.groupBy(*key, *carried).agg(
        F.round(F.exp(F.sum(F.when(F.col("used"), F.ln(F.size("chosen").cast("double"))))))
        .cast("long")
        .alias("grid_size"),
        *[
            F.first(
                F.when((F.col("parameter") == p) & F.col("used"), F.col("chosen")),
                ignorenulls=True,
            ).alias(f"only_{p}")
            for p in parameters
        ],
    )


def _match(rows: DataFrame, subsets: DataFrame, parameters: Sequence[str], drive: str) -> DataFrame:
    """Rows each subset allows: an equi join on one parameter, list tests on the others."""
    lists = _parameter_lists(rows, [drive])
    spread = subsets.withColumn("__lists", lists.scalar()).withColumn(
        "__drive", F.explode(F.coalesce(F.col(f"only_{drive}"), F.col(f"__lists.{drive}")))
    )
    joined = spread.join(
        rows.withColumn("__drive", F.col(drive).cast("string")), "__drive"
    )
    for p in parameters:
        if p != drive:
            allowed = F.col(f"only_{p}")
            joined = joined.filter(
                allowed.isNull() | F.array_contains(allowed, F.col(p).cast("string"))
            )
    return joined.drop("__drive", "__lists", *[f"only_{p}" for p in parameters])


def budget_scenarios(
    scores: DataFrame,
    scenarios: DataFrame,
    limits: dict[str, int] | None = None,
    seed: int = 0,
    attempts: int = 100,
) -> DataFrame:
    """Boards on random parameter subsets within a budget (scenario, budget, grid_size).

    A subset without any score is drawn again, up to ``attempts`` times. Attempts are rows: few
    scenarios fail the first one, and all further attempts of these are tried in one job, of
    which the first with scores counts. A scenario that still has none comes out once, with null
    strategy and total.
    """
    limits = limits or DRAW_LIMITS
    parameters = list(limits)
    groups = cut_lineage(scores.select(*parameters).distinct())
    waiting = scenarios.select("scenario", "budget")
    found, by = None, ["scenario", "budget", "grid_size"]
    for first, last in ((0, 1), (1, attempts)):
        if last <= first:
            break
        tries = waiting.withColumn("attempt", F.explode(F.sequence(F.lit(first), F.lit(last - 1))))
        subsets = random_subsets(tries, groups, parameters, limits, seed)
        hits = _match(groups, subsets, parameters, parameters[0])
        earliest = hits.groupBy("scenario").agg(F.min("attempt").alias("attempt"))
        good = cut_lineage(hits.join(earliest, ["scenario", "attempt"]).select(*by, *parameters))
        found = good if found is None else found.unionByName(good)
        waiting = cut_lineage(waiting.join(good.select("scenario"), "scenario", "left_anti"))
        if waiting.isEmpty():
            break
    boards = scenario_board(scores, found, parameters, by)
    unresolved = waiting.select(
        *waiting.columns,
        F.lit(None).cast("long").alias("grid_size"),
        F.lit(None).cast(scores.schema["strategy"].dataType).alias("strategy"),
        F.lit(None).cast("double").alias("total"),
    )
    return boards.unionByName(unresolved)


def single_value_scenarios(
    scores: DataFrame,
    targets: DataFrame,
    parameters: Sequence[str] = GROUP,
    seed: int = 0,
) -> DataFrame:
    """Boards with one target value held fixed and the other parameters drawn.

    Up to all values of each other parameter are drawn.

    ``targets``: scenario, target (parameter name), target_value. The budget favours
    small grids: its weight falls from 10 to 1 on a log scale over all grid sizes.
    A target without any score comes out once, with null grid size, strategy and total.
    """
    parameters = list(parameters)
    groups = cut_lineage(scores.select(*parameters).distinct())
    largest = groups.agg(
        F.expr(" * ".join(f"count(distinct {p})" for p in parameters)).cast("double")
    )
    luck = fraction(draw(seed, "scenario", "target", F.lit("budget")))
    budget = F.floor(-largest.scalar() * F.log10(1.0 - 0.9 * luck)).cast("long") + 1
    drawn = targets.withColumn("budget", budget).withColumn("attempt", F.lit(0))
    # the drawn subset is the same for all values of one scenario and target
    subsets = random_subsets(
        drawn.withColumn("scenario", F.concat_ws(":", "scenario", "target", "target_value")),
        groups,
        parameters,
        None,
        seed,
        skip="target",
    )
    hit = None
    for p in parameters:
        test = F.when(F.col("target") == p, F.col(p).cast("string") == F.col("target_value"))
        hit = test if hit is None else F.coalesce(hit, test)
    picks = _match(groups, subsets, parameters, parameters[0]).filter(hit)
    name = ["scenario", "target", "target_value"]
    boards = scenario_board(scores, picks, parameters, [*name, "grid_size"])
    whole = F.concat_ws(":", *name).alias("scenario")
    asked = targets.select(whole, "target", "target_value").distinct()
    return asked.join(boards, name, "left").select(*name, "grid_size", "strategy", "total")


def split_label(labels: DataFrame, column: str = "label") -> DataFrame:
    """``name: (id, parameter, value, budget)`` text into columns."""
    part = lambda i: F.trim(
        F.regexp_replace(F.get(F.col("__parts"), F.lit(i)), r"^[\s'\"]+|[\s'\"]+$", "")
    )
    inner = F.regexp_extract(column, r"\((.*)\)\s*$", 1)
    return labels.withColumn("__parts", F.split(inner, ",")).select(
        *labels.columns,
        F.trim(F.regexp_extract(column, r"^([^:]*):", 1)).alias("scenario_kind"),
        part(0).try_cast("long").alias("scenario"),
        part(1).alias("parameter"),
        part(2).alias("setting"),
        part(3).try_cast("long").alias("budget"),
    )


def tau_by_size(taus: DataFrame, size: str = "k", value: str = "tau") -> DataFrame:
    """Smallest, mean and largest agreement per sample size."""
    return taus.groupBy(size).agg(
        F.min(value).alias("lowest"), F.avg(value).alias("mean"), F.max(value).alias("highest")
    )


def cubic_trend(curve: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares cubic of y over x: (power, coefficient).

    x is scaled to [-1, 1] for the fit, moments come from one aggregate, and MLlib
    solves the 4 x 4 system.
    """
    from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = curve.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("label"))
    rows = rows.filter("x is not null and label is not null")
    vector = VectorAssembler(inputCols=["x"], outputCol="__v").transform(rows)
    powers = PolynomialExpansion(degree=3, inputCol="__v", outputCol="features").transform(vector)
    fit = LinearRegression(solver="normal", regParam=0.0).fit(powers.select("features", "label"))
    values = [fit.intercept, *fit.coefficients.toArray().tolist()]
    return curve.sparkSession.createDataFrame(
        [(i, float(v)) for i, v in enumerate(values)], "power int, coefficient double"
    )

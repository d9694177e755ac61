"""Leaderboards: cells, interpolation, normalisation, ranks and totals.

Scores are long: (by..., dataset, strategy, value), one row per run. A cell is one
(dataset, strategy). Cells keep sum, count, minimum and maximum instead of lists of
values, because padding and affine scaling act on these alone. ``by`` adds slices
(learner, batch, metric, scenario, ...) as group keys, so a family of boards is one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from curveboard.functions.slices import percentiles

# Names of interpolation rules, scalings and forms.
INTERPOLATIONS = ("none", "remove", "zero", "average_of_same_strategy")
NORMALISATIONS = ("none", "minmax", "robust")
FORMS = ("percentages", "ranks", "inverted_ranks", "counts")


def shared_fingerprints(
    scores: DataFrame, fingerprint: Sequence[str], cell: Sequence[str] = ("dataset", "strategy")
) -> DataFrame:
    """Fingerprints that every cell of the whole table holds."""
    cells = scores.select(*cell).distinct().agg(F.count(F.lit(1)))
    present = scores.select(*fingerprint, *cell).distinct()
    return (
        present.groupBy(*fingerprint)
        .agg(F.count(F.lit(1)).alias("cells"))
        .filter(F.col("cells") == cells.scalar())
        .select(*fingerprint)
    )


def most_fingerprints(
    scores: DataFrame, fingerprint: Sequence[str], cell: Sequence[str] = ("dataset", "strategy")
) -> DataFrame:
    """Largest number of distinct fingerprints in any cell."""
    present = scores.select(*fingerprint, *cell).distinct()
    return present.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("pad_to"))


def dense_scores(
    scores: DataFrame, fingerprint: Sequence[str], cell: Sequence[str] = ("dataset", "strategy")
) -> DataFrame:
    """Rows whose fingerprint every cell holds."""
    shared = shared_fingerprints(scores, fingerprint, cell)
    return scores.join(shared, list(fingerprint), "left_semi")


def _attach(df: DataFrame, one: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Add a per-``by`` column; without ``by`` it is a single value."""
    if by:
        return df.join(one.select(*by, column), list(by))
    return df.withColumn(column, one.select(column).scalar())


def complete_cells(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every dataset x strategy of a board, empty cells with count 0.

    The strategies of a board are a short list of enum codes; rows are generated per
    dataset from that list.
    """
    by = list(by)
    names = cells.groupBy(*by).agg(F.sort_array(F.collect_set("strategy")).alias("__names"))
    datasets = cells.select(*by, "dataset").distinct()
    slots = _attach(datasets, names, by, "__names").select(
        *by, "dataset", F.explode("__names").alias("strategy")
    )
    return slots.join(cells, [*by, "dataset", "strategy"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    )


def cells_of(scores: DataFrame, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Sum, count, minimum and maximum per cell, empty cells included."""
    grouped = scores.groupBy(*by, "dataset", "strategy").agg(
        F.sum(value).alias("s"),
        F.count(value).alias("n"),
        F.min(value).alias("lo"),
        F.max(value).alias("hi"),
    )
    return complete_cells(grouped, by)


QUARTILES = {"__q1": 0.25, "__q2": 0.5, "__q3": 0.75}


def robust_scaled(cells: DataFrame, spread: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cells of (v - median) / IQR; an IQR of 0 counts as 1.

    The scaling is affine, so it acts on sum, minimum and maximum; the values themselves are
    only needed for ``spread``, the quartiles per (by..., dataset).
    """
    width = F.coalesce(F.nullif(F.col("__q3") - F.col("__q1"), F.lit(0.0)), F.lit(1.0))
    middle = F.col("__q2")
    return (
        cells.join(spread, [*by, "dataset"], "left")
        .withColumn("s", (F.col("s") - F.col("n") * middle) / width)
        .withColumn("lo", (F.col("lo") - middle) / width)
        .withColumn("hi", (F.col("hi") - middle) / width)
        .drop(*QUARTILES)
    )


def picked_percentiles(
    scores: DataFrame,
    picks: DataFrame,
    by: Sequence[str],
    keys: Sequence[str],
    probs: dict[str, float],
    value: str = "value",
    bins: int = 256,
) -> DataFrame:
    """Exact percentiles per (by..., dataset) of the scores whose keys each ``by`` picked.

    Scores never meet all picks: they are counted per (keys, dataset, bin of the dataset's value
    range), counts are summed per ``by``, and only the bins that hold a wanted rank bring their
    distinct values.
    """
    by, keys = list(by), list(keys)
    if keys == ["dataset"]:
        # a dataset's values do not depend on which other datasets were picked
        whole = percentiles(scores, ["dataset"], value, probs)
        return picks.select(*by, "dataset").join(whole, "dataset").select(*by, "dataset", *probs)
    cell = list(dict.fromkeys([*keys, "dataset"]))
    seen = scores.filter(F.col(value).isNotNull()).select(*cell, F.col(value).alias("__v"))
    # equal widths follow from minimum and maximum, so every evaluation gives the same bins
    ends = seen.groupBy("dataset").agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    share = (F.col("__v") - F.col("__low")) / F.nullif(F.col("__high") - F.col("__low"), F.lit(0.0))
    bin_of = F.coalesce(F.floor(share * bins), F.lit(0))
    valued = (
        seen.join(ends, "dataset")
        .groupBy(*cell, bin_of.alias("__bin"), "__v")
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    counts = valued.groupBy(*cell, "__bin").agg(F.sum("__c").alias("__c"))
    chosen = picks.select(*by, *keys)
    board = [*by, "dataset"]
    mine = chosen.join(counts, keys).groupBy(*board, "__bin").agg(F.sum("__c").alias("__c"))
    order = W.partitionBy(*board).orderBy("__bin").rowsBetween(W.unboundedPreceding, 0)
    mine = mine.withColumn("__upto", F.sum("__c").over(order)).withColumn(
        "__n", F.sum("__c").over(W.partitionBy(*board))
    )
    wanted = []
    for name, p in probs.items():
        exact = F.lit(p) * (F.col("__n") - 1)
        # 1e-9 keeps an integral rank from sliding below itself in floating point
        low = F.floor(exact + F.lit(1e-9))
        part = F.greatest(exact - low, F.lit(0.0))
        for rank, share in ((low, 1 - part), (F.least(low + 1, F.col("__n") - 1), part)):
            wanted.append(F.struct(F.lit(name).alias("name"), rank.alias("rank"), share.alias("share")))
    located = (
        mine.select(*board, "__bin", "__c", "__upto", F.explode(F.array(*wanted)).alias("w"))
        .filter((F.col("w.rank") < F.col("__upto")) & (F.col("w.rank") >= F.col("__upto") - F.col("__c")))
        .select(*board, "__bin", F.col("w.name").alias("name"), F.col("w.share").alias("share"),
                (F.col("w.rank") - F.col("__upto") + F.col("__c")).alias("rank"))
    )
    inside = (
        located.join(chosen, [*by, "dataset"] if "dataset" in keys else by)
        .join(valued, [*cell, "__bin"])
        .groupBy(*board, "name", "__bin", "rank", "share", "__v")
        .agg(F.sum("__c").alias("__c"))
    )
    upto = F.sum("__c").over(
        W.partitionBy(*board, "name", "__bin", "rank", "share").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    )
    hit = inside.withColumn("__upto", upto).filter(
        (F.col("rank") < F.col("__upto")) & (F.col("rank") >= F.col("__upto") - F.col("__c"))
    )
    return hit.groupBy(*board).agg(
        *[F.sum(F.when(F.col("name") == n, F.col("__v") * F.col("share"))).alias(n) for n in probs]
    )


def _rule(name: str) -> tuple[Column, Column, Column]:
    """Cell mean, minimum and maximum under an interpolation rule; ``m`` is the full length."""
    mean = F.try_divide("s", "n")
    short = F.col("n") < F.col("m")
    lo, hi, zero = F.col("lo"), F.col("hi"), F.lit(0.0)
    if name in ("none", "average_of_same_strategy"):
        # padding with the cell's own mean leaves mean, minimum and maximum unchanged
        return mean, lo, hi
    if name == "remove":
        return F.when(~short, mean), F.when(~short, lo), F.when(~short, hi)
    if name == "zero":
        return (
            F.coalesce("s", zero) / F.greatest(F.col("n"), F.col("m")),
            F.when(short, F.least(F.coalesce(lo, zero), zero)).otherwise(lo),
            F.when(short, F.greatest(F.coalesce(hi, zero), zero)).otherwise(hi),
        )
    raise ValueError(f"unknown interpolation: {name}")


def interpolated(
    cells: DataFrame,
    interpolations: str | Sequence[str],
    by: Sequence[str] = (),
    pad_to: DataFrame | int | None = None,
) -> DataFrame:
    """Cell means under one or several interpolation rules, with minimum and maximum.

    Short cells are padded to the longest cell of the board, or to ``pad_to``. With
    several rules the result has a column ``rule``.
    """
    by = list(by)
    if pad_to is None:
        longest = cells.groupBy(*by).agg(F.max("n").alias("m"))
        rows = _attach(cells, longest, by, "m")
    elif isinstance(pad_to, int):
        rows = cells.withColumn("m", F.lit(pad_to))
    else:
        rows = cells.withColumn("m", pad_to.scalar())
    many = not isinstance(interpolations, str)
    variants = []
    for name in interpolations if many else [interpolations]:
        score, lo, hi = _rule(name)
        variants.append(
            F.struct(
                F.lit(name).alias("rule"),
                score.cast("double").alias("score"),
                lo.alias("lo"),
                hi.alias("hi"),
            )
        )
    out = rows.select(*by, "dataset", "strategy", "n", F.explode(F.array(*variants)).alias("v"))
    return out.select(
        *by, *(["v.rule"] if many else []), "dataset", "strategy", "n", "v.score", "v.lo", "v.hi"
    )


def minmax_scaled(
    scored: DataFrame, by: Sequence[str] = (), name: str = "score"
) -> DataFrame:
    """(v - min) / (max - min) per dataset over all values; acts on cell means directly."""
    board = W.partitionBy(*by, "dataset")
    low, high = F.min("lo").over(board), F.max("hi").over(board)
    width = F.coalesce(F.nullif(high - low, F.lit(0.0)), F.lit(1.0))
    return scored.withColumn(name, (F.col("score") - low) / width)


def max_tie_rank(value: str | Column, partition: Sequence[str]) -> Column:
    """Ascending rank; equal values share the largest rank, nulls have none."""
    col = F.col(value) if isinstance(value, str) else value
    upto = W.partitionBy(*partition).orderBy(col.asc_nulls_last()).rangeBetween(
        W.unboundedPreceding, 0
    )
    return F.when(col.isNotNull(), F.count(col).over(upto)).cast("int")


def inverted_rank(value: str | Column, partition: Sequence[str]) -> Column:
    """Descending rank, 1 is best; equal values share the smallest rank, nulls have none."""
    col = F.col(value) if isinstance(value, str) else value
    order = W.partitionBy(*partition).orderBy(col.desc_nulls_last())
    return F.when(col.isNotNull(), F.rank().over(order)).cast("int")


def board(
    scores: DataFrame,
    by: Sequence[str] = (),
    interpolation: str = "zero",
    normalisation: str = "none",
    form: str = "percentages",
    pad_to: DataFrame | int | None = None,
    value: str = "value",
) -> DataFrame:
    """Long leaderboard (by..., dataset, strategy, score)."""
    by = list(by)
    if normalisation not in NORMALISATIONS:
        raise ValueError(f"unknown normalisation: {normalisation}")
    cells = cells_of(scores, by, value)
    if normalisation == "robust":
        cells = robust_scaled(cells, percentiles(scores, [*by, "dataset"], value, QUARTILES), by)
    if form == "counts":
        return cells.select(*by, "dataset", "strategy", F.col("n").cast("double").alias("score"))
    scored = interpolated(cells, interpolation, by, pad_to)
    if normalisation == "minmax":
        scored = minmax_scaled(scored, by)
    if form == "ranks":
        scored = scored.withColumn("score", max_tie_rank("score", [*by, "dataset"]).cast("double"))
    elif form == "inverted_ranks":
        scored = scored.withColumn("score", inverted_rank("score", [*by, "dataset"]).cast("double"))
    elif form != "percentages":
        raise ValueError(f"unknown form: {form}")
    return scored.select(*by, "dataset", "strategy", "score")


def totals(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean over datasets per strategy: the Total vector of each board."""
    return scored.groupBy(*by, "strategy").agg(F.avg("score").alias("total"))


def with_total_row(scored: DataFrame, name: str = "Total") -> DataFrame:
    """The board with one more dataset row holding the strategy means."""
    total = totals(scored).select(
        F.lit(name).alias("dataset"), "strategy", F.col("total").alias("score")
    )
    return scored.select(F.col("dataset").cast("string"), "strategy", "score").unionByName(total)


def ranking(scored: DataFrame, ascending: bool = True) -> DataFrame:
    """Strategies in order of their total; equal totals by name."""
    order = F.asc("total") if ascending else F.desc("total")
    return totals(scored).orderBy(order, "strategy")


def matrix(scored: DataFrame, strategies: Sequence | None = None) -> DataFrame:
    """One column per strategy, for export."""
    return scored.groupBy("dataset").pivot("strategy", strategies).agg(F.first("score"))


def board_family(
    scores: DataFrame,
    fingerprint: Sequence[str],
    interpolations: Sequence[str] = INTERPOLATIONS,
) -> DataFrame:
    """Total vectors of {min-max, rank, percentage} x {sparse x interpolations, dense}.

    One aggregate builds all cells; every rule and form follows from the cells.
    """
    sparse = scores.select("dataset", "strategy", "value", F.lit("sparse").alias("grid"))
    dense = dense_scores(scores, fingerprint).select(
        "dataset", "strategy", "value", F.lit("dense").alias("grid")
    )
    cells = cells_of(sparse.unionByName(dense), ["grid"])
    rules = ["grid", "rule"]
    scored = interpolated(cells, interpolations, ["grid"]).filter(
        (F.col("grid") == "sparse") | (F.col("rule") == "none")
    )
    shown = minmax_scaled(scored, rules, "normalised").select(
        *rules,
        "strategy",
        F.col("normalised").alias("dataset_normalized_percentages"),
        max_tie_rank("score", [*rules, "dataset"]).cast("double").alias("rank"),
        F.col("score").alias("percentages"),
    )
    kinds = ["dataset_normalized_percentages", "rank", "percentages"]
    means = shown.groupBy(*rules, "strategy").agg(*[F.avg(k).alias(k) for k in kinds])
    return means.unpivot([*rules, "strategy"], kinds, "kind", "total").select(
        F.concat_ws("_", "grid", "rule", "kind").alias("setting"), "strategy", "total"
    )


def sliced_boards(
    scores: DataFrame, parameters: Sequence[str], value: str = "value", **options
) -> DataFrame:
    """Total vector per value of each named parameter, all slices in one job.

    ``parameters`` may hold run settings (learner, batch, ...) or ``metric``. A row enters
    one slice per parameter; rows combine on the map side, so only cells are shuffled.
    """
    slices = F.explode(
        F.array(
            *[
                F.struct(F.lit(p).alias("parameter"), F.col(p).cast("string").alias("setting"))
                for p in parameters
            ]
        )
    )
    rows = scores.select("dataset", "strategy", value, slices.alias("__p")).select(
        "dataset", "strategy", value, "__p.parameter", "__p.setting"
    )
    by = ["parameter", "setting"]
    return totals(board(rows, by=by, value=value, **options), by)


def score_table(scores: DataFrame, value: str = "value") -> DataFrame:
    """Mean by strategy and dataset of one metric, with a mean row.

    A metric none of whose values exceeds 1 is a share and shown in per cent.
    """
    scale = F.when(scores.agg(F.max(value)).scalar() <= 1, 100.0).otherwise(1.0)
    cells = scores.groupBy("strategy", "dataset").agg(F.avg(value).alias("__v"))
    cells = cells.withColumn("score", F.col("__v") * scale)
    mean = cells.groupBy("strategy").agg(F.avg("score").alias("score")).withColumn(
        "dataset", F.lit("Mean (%)")
    )
    return cells.select("strategy", F.col("dataset").cast("string"), "score").unionByName(
        mean.select("strategy", "dataset", "score")
    )


def metric_heat(scores: DataFrame, value: str = "value") -> DataFrame:
    """Mean by strategy and metric, scaled to [0, 1] per metric."""
    means = scores.groupBy("strategy", "metric").agg(F.avg(value).alias("mean"))
    per_metric = W.partitionBy("metric")
    low, high = F.min("mean").over(per_metric), F.max("mean").over(per_metric)
    width = F.coalesce(F.nullif(high - low, F.lit(0.0)), F.lit(1.0))
    return means.withColumn("heat", (F.col("mean") - low) / width)

"""Metrics of selected samples: distances, class mix, categories, ordered selections.

Averages of pairwise cosine distances never touch a pair: with unit vectors u and v,
the mean of 1 - u.v over two sets is 1 - sum(u).sum(v) / (n m).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curveboard.functions.slices import CHUNK, position, running
from curveboard.functions.vectors import dot, vector_sum

RUN = ("run_id",)


def batch_distance(selected: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Mean pairwise distance inside each cycle's batch; 0 below two samples.

    ``selected`` carries the unit vector of each sample in ``unit``.
    """
    keys = [*keys, "cycle"]
    squares = selected.withColumn("__sq", dot(F.col("unit"), F.col("unit")))
    total = vector_sum(selected, keys, "unit", "__s")
    own = squares.groupBy(*keys).agg(F.sum("__sq").alias("__q"))
    n = F.col("__s_n")
    mean = F.lit(1.0) - (dot(F.col("__s"), F.col("__s")) - F.col("__q")) / (n * (n - 1))
    return total.join(own, keys).select(
        *keys, F.when(n < 2, F.lit(0.0)).otherwise(mean).alias("value")
    )


def _by_dimension(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    return sums.select(*keys, F.posexplode("__s").alias("dim", "b"))


def _running_sums(
    selected: DataFrame, keys: Sequence[str], chunk: int
) -> tuple[DataFrame, DataFrame]:
    """Per cycle: the batch sum per dimension with everything up to it, and the counts."""
    keys = list(keys)
    sums = vector_sum(selected, [*keys, "cycle"], "unit", "__s")
    slice_by = F.floor(F.col("cycle") / chunk)
    dims = running(
        _by_dimension(sums, [*keys, "cycle"]),
        [*keys, "dim"],
        slice_by,
        ["cycle"],
        {"upto": ("sum", "b")},
    )
    counts = running(
        sums.select(*keys, "cycle", F.col("__s_n").alias("m")),
        keys,
        slice_by,
        ["cycle"],
        {"m_upto": ("sum", "m")},
    )
    return dims, counts


def labelled_distance(
    selected: DataFrame,
    keys: Sequence[str] = RUN,
    legacy_double_start: bool = False,
    chunk: int = CHUNK,
) -> DataFrame:
    """Mean distance of each batch to everything selected before; the start set to itself.

    ``legacy_double_start`` weighs the start set twice after cycle 0.
    """
    keys = list(keys)
    dims, counts = _running_sums(selected, keys, chunk)
    start = F.col("cycle") == 0
    before = F.when(start, F.col("b")).otherwise(F.col("upto") - F.col("b"))
    seen = F.when(start, F.col("m")).otherwise(F.col("m_upto") - F.col("m"))
    if legacy_double_start:
        first = dims.filter(start).select(*keys, "dim", F.col("b").alias("__b0"))
        dims = dims.join(first, [*keys, "dim"], "left")
        before = before + F.when(start, 0.0).otherwise(F.coalesce("__b0", F.lit(0.0)))
        first_m = counts.filter(start).select(*keys, F.col("m").alias("__m0"))
        counts = counts.join(first_m, keys, "left")
        seen = seen + F.when(start, 0).otherwise(F.coalesce("__m0", F.lit(0)))
    products = dims.groupBy(*keys, "cycle").agg(F.sum(F.col("b") * before).alias("__dot"))
    mean = F.lit(1.0) - F.try_divide(F.col("__dot"), F.col("m") * seen)
    return products.join(counts, [*keys, "cycle"]).select(
        *keys, "cycle", F.coalesce(mean, F.lit(0.0)).alias("value")
    )


def unlabelled_distance(
    selected: DataFrame,
    train: DataFrame,
    set_keys: Sequence[str],
    keys: Sequence[str] = RUN,
    chunk: int = CHUNK,
) -> DataFrame:
    """Mean distance of each batch to the train samples not selected before it.

    The start set itself is taken out at cycle 0; a later batch still counts as
    unlabelled while it is compared. ``train``: set keys, unit. ``set_keys`` name the
    train set (for example dataset and bucket) on both sides.
    """
    keys, set_keys = list(keys), list(set_keys)
    all_keys = [*keys, *set_keys]
    dims, counts = _running_sums(selected, all_keys, chunk)
    pool = vector_sum(train, set_keys, "unit", "__s")
    pool_dims = pool.select(*set_keys, F.posexplode("__s").alias("dim", "t"))
    start = F.col("cycle") == 0
    gone = F.when(start, F.col("upto")).otherwise(F.col("upto") - F.col("b"))
    gone_m = F.when(start, F.col("m_upto")).otherwise(F.col("m_upto") - F.col("m"))
    products = (
        dims.join(pool_dims, [*set_keys, "dim"])
        .groupBy(*all_keys, "cycle")
        .agg(F.sum(F.col("b") * (F.col("t") - gone)).alias("__dot"))
    )
    sizes = counts.join(pool.select(*set_keys, F.col("__s_n").alias("__pool")), set_keys)
    mean = F.lit(1.0) - F.try_divide(
        F.col("__dot"), F.col("m") * (F.col("__pool") - gone_m)
    )
    return products.join(sizes, [*all_keys, "cycle"]).select(
        *keys, "cycle", F.coalesce(mean, F.lit(0.0)).alias("value")
    )


def class_shares(train: DataFrame, set_keys: Sequence[str]) -> DataFrame:
    """Share of each label in each train set."""
    set_keys = list(set_keys)
    counts = train.groupBy(*set_keys, "label").agg(F.count(F.lit(1)).alias("__c"))
    totals = counts.groupBy(*set_keys).agg(F.sum("__c").alias("__n"))
    return counts.join(totals, set_keys).select(
        *set_keys, "label", (F.col("__c") / F.col("__n")).alias("p_true")
    )


def class_gap(
    selected: DataFrame,
    train: DataFrame,
    set_keys: Sequence[str],
    keys: Sequence[str] = RUN,
    cumulative: bool = False,
    chunk: int = CHUNK,
) -> DataFrame:
    """Negated Manhattan and Chebyshev distance of class shares per cycle.

    ``selected`` carries label and set keys. Shares are matched by label. With
    ``cumulative`` a cycle counts everything selected up to it.
    """
    keys, set_keys = list(keys), list(set_keys)
    all_keys = [*keys, *set_keys]
    shares = class_shares(train, set_keys)
    counts = selected.groupBy(*all_keys, "cycle", "label").agg(F.count(F.lit(1)).alias("c"))
    cycles = counts.groupBy(*all_keys, "cycle").agg(F.sum("c").alias("m"))
    slots = cycles.join(shares, set_keys)
    rows = slots.drop("m", "p_true").join(counts, [*all_keys, "cycle", "label"], "full_outer")
    rows = rows.withColumn("c", F.coalesce("c", F.lit(0)))
    slice_by = F.floor(F.col("cycle") / chunk)
    if cumulative:
        extra = (
            counts.select(*all_keys, "label")
            .distinct()
            .join(shares, [*set_keys, "label"], "left_anti")
        )
        rows = rows.unionByName(
            extra.join(cycles.select(*all_keys, "cycle"), all_keys).withColumn(
                "c", F.lit(0).cast("long")
            )
        )
        rows = rows.groupBy(*all_keys, "cycle", "label").agg(F.sum("c").alias("c"))
        rows = running(rows, [*all_keys, "label"], slice_by, ["cycle"], {"upto": ("sum", "c")})
        rows = rows.drop("c").withColumnRenamed("upto", "c")
        cycles = running(cycles, all_keys, slice_by, ["cycle"], {"upto": ("sum", "m")})
        cycles = cycles.drop("m").withColumnRenamed("upto", "m")
    gap = F.abs(F.coalesce("p_true", F.lit(0.0)) - F.col("c") / F.col("m"))
    return (
        rows.join(cycles, [*all_keys, "cycle"])
        .join(shares, [*set_keys, "label"], "left")
        .groupBy(*keys, "cycle")
        .agg(
            (F.lit(0.0) - F.sum(gap)).alias("manhattan"),
            (F.lit(0.0) - F.max(gap)).alias("chebyshev"),
        )
    )


def selected_categories(
    selected: DataFrame, categories: DataFrame, keys: Sequence[str] = RUN
) -> DataFrame:
    """Category values of each cycle's samples: the list, and its list mean.

    A batch bounds the list; a sample without value leaves a gap but still counts.
    """
    rows = selected.join(categories, ["dataset", "sample_id"])
    return rows.groupBy(*keys, "cycle", "categorizer").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("sample_id", "value"))), lambda x: x["value"]
        ).alias("values"),
        (F.sum("value") / F.count(F.lit(1))).alias("mean"),
    )


def ordered_selections(selected: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Each run's selections in order as rows (pos, n), cycles in order, ids inside a cycle.

    The long form of the flattened selection: slices and comparisons work on ``pos``
    without building a list per run.
    """
    keys = list(keys)
    numbered = position(selected, keys, F.col("cycle"), ["cycle", "sample_id"], "pos")
    sizes = selected.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return numbered.join(sizes, keys)


def flattened(selected: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """One array per run, for export. A run selects a sample once, so its pool bounds it."""
    per_cycle = selected.groupBy(*keys, "cycle").agg(
        F.sort_array(F.collect_list("sample_id")).alias("ids")
    )
    return per_cycle.groupBy(*keys).agg(
        F.flatten(
            F.transform(
                F.sort_array(F.collect_list(F.struct("cycle", "ids"))), lambda x: x["ids"]
            )
        ).alias("sample_ids")
    )


def phase_rows(
    ordered: DataFrame, cutoffs: DataFrame, keys: Sequence[str] = RUN, k: int = 5
) -> DataFrame:
    """(keys, phase, sample_id) rows of every phase slice; runs without cutoff are dropped."""
    keys = list(keys)
    joined = ordered.join(cutoffs.filter("cutoff is not null").select(*keys, "cutoff"), keys)
    cut = F.col("cutoff").cast("long")
    phases = {
        "ramp_up": F.col("pos") < cut,
        "plateau": F.col("pos") >= cut,
        "first_5": F.col("pos") < k,
        "last_5": F.col("pos") >= F.col("n") - k,
    }
    tags = F.filter(
        F.array(*[F.when(test, F.lit(name)) for name, test in phases.items()]),
        lambda x: x.isNotNull(),
    )
    return joined.select(*keys, F.explode(tags).alias("phase"), "pos", "sample_id")

"""Correlation, rank correlation and set similarity between settings.

A setting is one value of a studied parameter (strategy, batch, metric, board, ...).
Vectors of two settings are matched by a key (run, fingerprint, item), never by order.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from hashlib import md5
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from curveboard.functions.slices import CHUNK, hash_position, percentiles, position, running
from curveboard.functions.stats import (
    NORMAL_5_PERCENT,
    fisher_interval,
    half_width,
    kendall_z,
    pearson_standard_error,
    pearson_t,
)
from curveboard.operators.cells import cogrouped, written
from curveboard.session import cut_lineage, shared_folder


def shared_ids(rows: DataFrame, of: str = "metric", key: str = "run_id") -> DataFrame:
    """Ids that every metric (or other setting) holds."""
    total = rows.select(of).distinct().agg(F.count(F.lit(1)))
    present = rows.select(key, of).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return present.filter(F.col("__n") == total.scalar()).select(key)


# --- Pearson ---------------------------------------------------------------


def _moments(by: list[str], schema: pa.Schema):
    """Per partition: co-moments of all setting pairs as matrix products, per board."""

    def group(x: np.ndarray, key: dict) -> pa.RecordBatch:
        seen = ~np.isnan(x)
        shift = np.where(seen, x, 0.0).mean(axis=0)
        z = np.where(seen, x - shift, 0.0)
        m = seen.astype(float)
        n = m.T @ m
        at = np.nonzero(n)
        sx, sy = z.T @ m, m.T @ z
        sxx, syy, sxy = (z * z).T @ m, m.T @ (z * z), z.T @ z
        # undo the shift per pair: means and centred second moments
        with np.errstate(invalid="ignore", divide="ignore"):
            mx, my = sx / n, sy / n
            cxx, cyy, cxy = sxx - sx * mx, syy - sy * my, sxy - sx * my
        mx, my = mx + shift[:, None], my + shift[None, :]
        found = {"i": at[0], "j": at[1]}
        found |= {"n": n[at], "mx": mx[at], "my": my[at], "cxx": cxx[at], "cyy": cyy[at], "cxy": cxy[at]}
        columns = [pa.repeat(key[f.name], len(at[0])) if f.name in key else pa.array(found[f.name], f.type) for f in schema]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            width = table["width"][0].as_py()
            lists = table["cells"].combine_chunks()
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            cells = lists.flatten()
            x = np.full((len(lists), width), np.nan)
            x[row, cells.field("i").to_numpy()] = cells.field("v").to_numpy(zero_copy_only=False)
            if not by:
                yield group(x, {})
                continue
            of = table.select(by).to_pandas().groupby(by, sort=False, dropna=False).ngroup().to_numpy()
            order = np.argsort(of, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
                yield group(x[own], {b: table[b][int(own[0])] for b in by})

    return run


def pearson_matrix(
    rows: DataFrame,
    of: str,
    key: str | Sequence[str],
    value: str = "value",
    by: Sequence[str] = (),
) -> DataFrame:
    """Pearson r of every pair of settings over the keys both hold: (by, x, y, n, r).

    Each task turns its keys into a small settings x settings moment matrix; only these
    matrices are shuffled, whatever the number of keys.
    """
    by = list(by)
    keys = [key] if isinstance(key, str) else list(key)
    # settings in order with a typical value each, which is taken off before any product
    typical = rows.groupBy(F.col(of).alias("name")).agg(F.avg(value).alias("mean"))
    names = typical.agg(F.sort_array(F.collect_list(F.struct("name", "mean"))))
    listed = rows.filter(F.col(value).isNotNull()).withColumn("__names", names.scalar())
    place = F.array_position(F.transform("__names", lambda x: x["name"]), F.col(of))
    vectors = (
        listed.withColumn("__at", (place - 1).cast("int"))
        .select(
            *by,
            *keys,
            F.size("__names").alias("width"),
            F.struct(
                F.col("__at").alias("i"),
                (F.col(value).cast("double") - F.col("__names")[F.col("__at")]["mean"]).alias("v"),
            ).alias("cell"),
        )
        .groupBy(*by, *keys)
        .agg(F.collect_list("cell").alias("cells"), F.first("width").alias("width"))
        .select(*by, "cells", "width")
    )
    kinds = {f.name: f.dataType for f in rows.schema}
    numbers = ["n", "mx", "my", "cxx", "cyy", "cxy"]
    schema = T.StructType(
        [T.StructField(b, kinds[b]) for b in by]
        + [T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]
        + [T.StructField(c, T.DoubleType()) for c in numbers]
    )
    parts = vectors.mapInArrow(_moments(by, to_arrow_schema(schema)), schema)
    n, mx, my = F.col("n"), F.col("mx"), F.col("my")
    merged = parts.groupBy(*by, "i", "j").agg(
        F.sum("n").alias("n"),
        F.sum("cxx").alias("cxx"),
        F.sum("cyy").alias("cyy"),
        F.sum("cxy").alias("cxy"),
        F.sum(n * mx).alias("sx"),
        F.sum(n * my).alias("sy"),
        F.sum(n * mx * mx).alias("sxx"),
        F.sum(n * my * my).alias("syy"),
        F.sum(n * mx * my).alias("sxy"),
    )
    cov = F.col("cxy") + F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    var_x = F.col("cxx") + F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    var_y = F.col("cyy") + F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    name_at = lambda c: F.get(F.col("__names"), F.col(c))

    def varies(variance: Column, setting: str) -> Column:
        noise = F.abs(name_at(setting)["mean"]) * 1e-13
        return variance > F.col("n") * noise * noise

    r = cov / F.sqrt(var_x * var_y)
    return merged.withColumn("__names", names.scalar()).select(
        *by,
        name_at("i")["name"].alias("x"),
        name_at("j")["name"].alias("y"),
        F.col("n").cast("long").alias("n"),
        F.when(varies(var_x, "i") & varies(var_y, "j"), r).alias("r"),
    )


def parameter_correlation(
    scores: DataFrame, parameter: str, fingerprint: Sequence[str], value: str = "value"
) -> DataFrame:
    """Pearson matrix between the values of one parameter over shared fingerprints."""
    total = scores.select(parameter).distinct().agg(F.count(F.lit(1)))
    cells = scores.groupBy(*fingerprint, parameter).agg(F.avg(value).alias("value"))
    shared = (
        cells.groupBy(*fingerprint)
        .agg(F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") == total.scalar())
        .drop("__n")
    )
    return pearson_matrix(
        cells.join(shared, list(fingerprint), "left_semi"), parameter, fingerprint
    )


def with_interval(matrix: DataFrame, level: float = 0.95) -> DataFrame:
    """Fisher-z bounds, half width and standard error; the diagonal is exactly 1."""
    low, high = fisher_interval(F.col("r"), F.col("n"), level)
    same = F.col("x") == F.col("y")
    one = F.lit(1.0)
    too_few = F.raise_error(F.lit("an interval needs at least 4 keys"))
    out = matrix.withColumn(
        "r", F.when(F.col("n") < 4, too_few.cast("double")).when(same, one).otherwise(F.col("r"))
    )
    out = out.withColumn("lo", F.when(same, one).otherwise(low)).withColumn(
        "hi", F.when(same, one).otherwise(high)
    )
    return out.withColumn("half_width", half_width(F.col("lo"), F.col("hi"))).withColumn(
        "standard_error", pearson_standard_error(F.col("r"), F.col("n"))
    )


def average_rank(value: str, partition: Sequence[str]) -> Column:
    """Ascending rank where equal values share their mean rank; nulls have none."""
    order = W.partitionBy(*partition).orderBy(F.col(value).asc_nulls_last())
    ties = W.partitionBy(*partition, value)
    return F.when(
        F.col(value).isNotNull(),
        F.rank().over(order) + (F.count(value).over(ties) - 1) / F.lit(2.0),
    )


def spearman_matrix(
    rows: DataFrame, of: str, key: str | Sequence[str], value: str = "value", by: Sequence[str] = ()
) -> DataFrame:
    """Spearman matrix of complete short vectors (for example over strategies)."""
    ranked = rows.withColumn("__rank", average_rank(value, [*by, of]))
    return pearson_matrix(ranked, of, key, "__rank", by)


def curve_rank_correlation(
    cells: DataFrame, parameter: str, group: Sequence[str], value: str = "value"
) -> DataFrame:
    """Spearman between the curves of two parameter values in each all-but-one group.

    ``cells``: group, parameter, cycle, value (list cells already averaged).
    """
    ranked = cells.withColumn("__rank", average_rank(value, [*group, parameter]))
    return pearson_matrix(ranked, parameter, ["cycle"], "__rank", by=group)


# --- Kendall ---------------------------------------------------------------


def kendall(pairs: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Tie-aware Kendall tau-b of (x, y) per key: (keys, n, tau). See ``pair_counts``."""
    return pair_counts(pairs, keys, x, y).select(*keys, "n", _tau_b().alias("tau"))


def pair_counts(pairs: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Discordant and tied item pairs of (x, y) per key, exact in n log n without forming them.

    For vectors with one entry per strategy or other short list. With items in x order
    and y as integer ranks, a discordant pair differs first at one bit of y: the
    earlier item has the bit set, the later has not. So each bit level is a running
    count of set bits among items that agree above it. All windows share one exchange.
    """
    keys = list(keys)
    rows = pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *keys, F.col(x).alias("x"), F.col(y).alias("y")
    )
    every = W.partitionBy(*keys)
    ties = lambda *c: F.count(F.lit(1)).over(W.partitionBy(*keys, *c))
    ranked = rows.select(
        *keys,
        F.dense_rank().over(every.orderBy("x")).alias("rx"),
        (F.dense_rank().over(every.orderBy("y")) - 1).cast("long").alias("ry"),
        ties().alias("n"),
        ties("x").alias("tx"),
        ties("y").alias("ty"),
        ties("x", "y").alias("txy"),
    ).withColumn("top", F.max("ry").over(every))
    bits = ranked.select(
        *keys, "rx", "ry", "n", "tx", "ty", "txy", F.explode(_bit_levels("top")).alias("level")
    ).select(
        "*",
        F.expr("shiftright(ry, level + 1)").alias("prefix"),
        F.expr("shiftright(ry, level) & 1").alias("bit"),
    )
    ahead = (
        W.partitionBy(*keys, "level", "prefix")
        .orderBy("rx", "ry")
        .rowsBetween(W.unboundedPreceding, 0)
    )
    # one row per item for the tie counts, one row per item and bit for the discord
    once = lambda c: F.sum(F.when(F.col("level") == 0, F.col(c) - 1)) / 2
    sums = (
        bits.withColumn("before", F.sum("bit").over(ahead))
        .groupBy(*keys)
        .agg(
            F.max("n").alias("n"),
            F.sum(F.when(F.col("bit") == 0, F.col("before")).otherwise(0)).alias("discord"),
            once("tx").alias("ties_x"),
            once("ty").alias("ties_y"),
            once("txy").alias("ties_both"),
            *[
                F.sum(F.when(F.col("level") == 0, (F.col(c) - 1) * factor(F.col(c)))).alias(f"{name}_{c}")
                for c in ("tx", "ty")
                for name, factor in (("triples", lambda t: t - 2), ("spread", lambda t: 2 * t + 5))
            ],
        )
    )
    return sums


def _bit_levels(top: str) -> Column:
    last = F.ceil(F.log2(F.col(top) + 1)).cast("int") - 1
    return F.sequence(F.lit(0), F.greatest(last, F.lit(0)))


def _tau_b() -> Column:
    pairs = F.col("n") * (F.col("n") - 1) / 2
    score = (
        pairs - F.col("ties_x") - F.col("ties_y") + F.col("ties_both") - 2 * F.col("discord")
    )
    scale = F.sqrt(pairs - F.col("ties_x")) * F.sqrt(pairs - F.col("ties_y"))
    return F.try_divide(score, scale)


def _tau_from_ranks(ranked: DataFrame, keys: list[str], chunk: int) -> DataFrame:
    """tau-b of long vectors from (keys, rx, ry, c): integer ranks, c equal items.

    As ``kendall``, with every running count cut into chunks of x.
    """
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    sizes = ranked.groupBy(*keys).agg(
        F.sum("c").alias("n"), F.max("ry").alias("top"), two("c").alias("ties_both")
    )

    def tied(rank: str, name: str) -> DataFrame:
        counts = ranked.groupBy(*keys, rank).agg(F.sum("c").alias("t"))
        return counts.groupBy(*keys).agg(two("t").alias(name))

    bits = (
        ranked.join(sizes.select(*keys, "top"), keys)
        .select(*keys, "rx", "ry", "c", F.explode(_bit_levels("top")).alias("level"))
        .withColumn("bit", F.expr("shiftright(ry, level) & 1"))
        .withColumn("prefix", F.expr("shiftright(ry, level + 1)"))
        .withColumn("ones", F.col("bit") * F.col("c"))
    )
    counted = running(
        bits,
        [*keys, "level", "prefix"],
        F.floor(F.col("rx") / chunk),
        ["rx", "ry"],
        {"before": ("sum", "ones")},
    )
    discord = counted.groupBy(*keys).agg(
        F.sum(F.when(F.col("bit") == 0, F.col("before") * F.col("c")).otherwise(0)).alias(
            "discord"
        )
    )
    return (
        sizes.join(tied("rx", "ties_x"), keys)
        .join(tied("ry", "ties_y"), keys)
        .join(discord, keys)
        .select(*keys, "n", _tau_b().alias("tau"))
    )


def kendall_long(
    pairs: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y", chunk: int = 65536
) -> DataFrame:
    """tau-b per key of long numeric vectors, of which one key may hold most rows: (keys, n, tau).

    Equal pairs are counted before the shuffle; ranks are those of the distinct values, and running
    counts are cut into chunks of x.
    """
    keys = list(keys)
    rows = pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    counted = rows.groupBy(*keys, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("c"))

    def ranked(column: str, name: str) -> DataFrame:
        distinct = counted.select(*keys, column).distinct()
        return position(distinct, keys, F.floor(column), [column], name)

    both = counted.join(ranked("x", "rx"), [*keys, "x"]).join(ranked("y", "ry"), [*keys, "y"])
    return _tau_from_ranks(both.select(*keys, "rx", "ry", "c"), keys, chunk)


def _mirrored(half: DataFrame, a: str, b: str) -> DataFrame:
    """Both directions of every unordered pair of a half matrix."""
    both = F.when(
        F.col(a) == F.col(b), F.array(F.struct(F.col(a).alias("p"), F.col(b).alias("q")))
    ).otherwise(
        F.array(
            F.struct(F.col(a).alias("p"), F.col(b).alias("q")),
            F.struct(F.col(b).alias("p"), F.col(a).alias("q")),
        )
    )
    rest = [c for c in half.columns if c not in (a, b)]
    return half.select(F.explode(both).alias("__m"), *rest).select(
        F.col("__m.p").alias(a), F.col("__m.q").alias(b), *rest
    )


def kendall_matrix(
    rows: DataFrame, of: str, item: str, value: str = "total", by: Sequence[str] = ()
) -> DataFrame:
    """tau-b between every two settings over their common items: (by, x_name, y_name, n, tau).

    One output row per pair of settings; vectors are matched by item. The half matrix
    is computed once and mirrored.
    """
    by = list(by)
    left = rows.select(*by, item, F.col(of).alias("x_name"), F.col(value).alias("x"))
    right = rows.select(*by, item, F.col(of).alias("y_name"), F.col(value).alias("y"))
    pairs = left.join(right, [*by, item]).filter(F.col("x_name") <= F.col("y_name"))
    half = kendall(pairs, [*by, "x_name", "y_name"])
    return _mirrored(half, "x_name", "y_name").select(*by, "x_name", "y_name", "n", "tau")


def agreement_with(
    rows: DataFrame, gold: DataFrame, of: Sequence[str], item: str = "strategy",
    value: str = "total",
) -> DataFrame:
    """tau-b of each setting's vector to the reference vector, best first."""
    pairs = rows.select(*of, item, F.col(value).alias("x")).join(
        gold.select(item, F.col(value).alias("y")), item
    )
    return kendall(pairs, of)


#: Vectors of more items without ties, unless nearly sorted, take the normal approximation.
EXACT_ITEMS = 33


def inversion_table(spark, items: int = EXACT_ITEMS) -> DataFrame:
    """(n, c, p): chance of at most c inversions among n items in random order, for n up to ``items``.

    The counts follow the recurrence over n: inserting the n-th item adds 0 to n - 1 inversions.
    """
    counts, rows = [1], []
    for n in range(1, items + 1):
        if n > 1:
            sums = np.concatenate(([0], np.cumsum(np.array(counts, dtype=object))))
            width = n * (n - 1) // 2 + 1
            counts = [sums[min(k + 1, len(counts))] - sums[max(k - n + 1, 0)] for k in range(width)]
        upto, total = 0, math.factorial(n)
        for c, count in enumerate(counts):
            upto += int(count)
            rows.append((n, c, upto / total))
    return spark.createDataFrame(rows, "n long, c long, p double")


def tau_significance(pairs: DataFrame, keys: Sequence[str], level: float = 0.05) -> DataFrame:
    """(keys, n, tau, p, z, significant): two-sided test of tau-b against independence.

    Without ties and with at most ``EXACT_ITEMS`` items, p is exact, from the distribution of inversions;
    elsewhere p is null and z, the normal score with the variance corrected for ties, decides.
    """
    keys = list(keys)
    counts = pair_counts(pairs, keys)
    n, every = F.col("n").cast("double"), F.col("n") * (F.col("n") - 1) / 2
    score = every - F.col("ties_x") - F.col("ties_y") + F.col("ties_both") - 2 * F.col("discord")
    variance = (
        (2 * every * (2 * n + 5) - F.col("spread_tx") - F.col("spread_ty")) / 18
        + F.coalesce(F.try_divide(F.col("ties_x") * F.col("ties_y"), every), F.lit(0.0))
        + F.coalesce(F.try_divide(F.col("triples_tx") * F.col("triples_ty"), 18 * every * (n - 2)), F.lit(0.0))
    )
    untied = (F.col("ties_x") == 0) & (F.col("ties_y") == 0)
    fewer = F.least(F.col("discord"), (every - F.col("discord"))).cast("long")
    out = counts.select(
        *keys,
        "n",
        _tau_b().alias("tau"),
        F.when(untied, fewer).alias("c"),
        F.try_divide(score, F.sqrt(variance)).alias("z"),
    )
    table = inversion_table(pairs.sparkSession)
    p = F.when(F.col("p").isNotNull(), F.least(F.lit(1.0), 2 * F.col("p")))
    cut = F.lit(NormalDist().inv_cdf(1 - level / 2))
    return out.join(table, ["n", "c"], "left").select(
        *keys,
        "n",
        "tau",
        p.alias("p"),
        "z",
        F.coalesce(p < level, F.abs("z") > cut).alias("significant"),
    )


def significant_only(taus: DataFrame) -> DataFrame:
    """Keep tau only where it differs from 0 at 5 % (normal approximation)."""
    z = kendall_z(F.col("tau"), F.col("n"))
    return taus.withColumn("z", z).withColumn(
        "tau", F.when(F.abs(F.col("z")) > NORMAL_5_PERCENT, F.col("tau"))
    )


def order_positions(
    ranks: DataFrame, by: Sequence[str], item: str = "strategy", value: str = "score"
) -> DataFrame:
    """Place of each item in ascending order of value, equal values by name."""
    order = W.partitionBy(*by).orderBy(F.col(value).asc_nulls_last(), item)
    return ranks.select(*by, item, F.row_number().over(order).alias("place"))


def tau_between(
    first: DataFrame, second: DataFrame, by: Sequence[str], item: str = "strategy",
    value: str = "score",
) -> DataFrame:
    """tau between the item orders of two boards within each group (dataset, replicate)."""
    a = order_positions(first, by, item, value).withColumnRenamed("place", "x")
    b = order_positions(second, by, item, value).withColumnRenamed("place", "y")
    return kendall(a.join(b, [*by, item]), by)


def align_boards(boards: DataFrame, of: str) -> DataFrame:
    """Rows of the datasets and strategies that all boards have a value for."""
    filled = boards.filter("score is not null")
    total = boards.select(of).distinct().agg(F.count(F.lit(1)))

    def common(column: str) -> DataFrame:
        seen = filled.select(of, column).distinct()
        return (
            seen.groupBy(column)
            .agg(F.count(F.lit(1)).alias("__n"))
            .filter(F.col("__n") == total.scalar())
            .select(column)
        )

    return boards.join(common("dataset"), "dataset", "left_semi").join(
        common("strategy"), "strategy", "left_semi"
    )


def bootstrap_tau(
    first: DataFrame, second: DataFrame, replicates: int = 5000, seed: int = 0
) -> DataFrame:
    """tau between two boards for seeded resamples of the datasets: (replicate, n, tau).

    Datasets are drawn as weights, so a replicate is a weighted mean, not a copy.
    """
    datasets = first.select("dataset").distinct()
    indexed = position(datasets, [], F.col("dataset"), ["dataset"], "__at")
    count = datasets.agg(F.count(F.lit(1)))
    digest = F.md5(
        F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"),
                    F.col("__at").cast("string"))
    )
    draw = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")
    draws = (
        indexed.select(
            "__at", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")
        )
        .select("replicate", F.pmod(draw, count.scalar()).alias("__at"))
        .groupBy("replicate", "__at")
        .agg(F.count(F.lit(1)).alias("__w"))
        .join(indexed, "__at")
        .drop("__at")
    )

    def resampled(one: DataFrame) -> DataFrame:
        valued = one.filter("score is not null")
        return (
            draws.join(valued, "dataset")
            .groupBy("replicate", "strategy")
            # rounded, so that equal means tie whatever the order of summation
            .agg(F.round(F.sum(F.col("__w") * F.col("score")) / F.sum("__w"), 9).alias("score"))
        )

    return tau_between(resampled(first), resampled(second), ["replicate"])


def percentile_summary(
    values: DataFrame, by: Sequence[str], value: str, low: float = 0.025, high: float = 0.975
) -> DataFrame:
    """Median, two outer percentiles and the number of values."""
    cuts = percentiles(values, by, value, {"median": 0.5, "p_lo": low, "p_hi": high})
    counts = values.groupBy(*by).agg(F.count(value).alias("n"))
    return counts.join(cuts, list(by), "left")


# --- set similarity --------------------------------------------------------


def _pairs_of(list_column: str) -> Column:
    """Ordered pairs (a <= b) of a short sorted list of settings."""
    return F.flatten(
        F.transform(
            F.col(list_column),
            lambda a: F.transform(
                F.filter(F.col(list_column), lambda b: b >= a),
                lambda b: F.struct(a.alias("a"), b.alias("b")),
            ),
        )
    )


def jaccard_matrix(
    rows: DataFrame, of: str, fingerprint: Sequence[str], item: str = "sample_id"
) -> DataFrame:
    """Mean Jaccard of item sets between settings over their shared fingerprints.

    Items held by the same settings are counted together first, so pairs are formed
    from a few distinct setting lists per fingerprint, not from items. The source is read
    once: everything follows from its distinct (fingerprint, setting, item).
    """
    fingerprint = list(fingerprint)
    rows = written(rows.select(*fingerprint, of, item).distinct())
    total = rows.select(of).distinct().agg(F.count(F.lit(1)))
    present = rows.select(*fingerprint, of).distinct()
    shared = (
        present.groupBy(*fingerprint)
        .agg(F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") == total.scalar())
        .drop("__n")
    )
    kept = rows.join(shared, fingerprint, "left_semi")
    holders = kept.groupBy(*fingerprint, item).agg(
        F.sort_array(F.collect_set(of)).alias("__who")
    )
    counted = holders.groupBy(*fingerprint, "__who").agg(F.count(F.lit(1)).alias("__c"))
    common = (
        counted.select(*fingerprint, "__c", F.explode(_pairs_of("__who")).alias("p"))
        .groupBy(*fingerprint, F.col("p.a").alias("a"), F.col("p.b").alias("b"))
        .agg(F.sum("__c").alias("both"))
    )
    sizes = common.filter("a = b")
    size_a = sizes.select(*fingerprint, "a", F.col("both").alias("na"))
    size_b = sizes.select(*fingerprint, "b", F.col("both").alias("nb"))
    per_print = common.join(size_a, [*fingerprint, "a"]).join(size_b, [*fingerprint, "b"])
    summed = per_print.groupBy("a", "b").agg(
        F.sum(F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("__sum")
    )
    prints = shared.agg(F.count(F.lit(1)))
    names = rows.agg(F.sort_array(F.collect_set(of)).alias("__who"))
    slots = names.select(F.explode(_pairs_of("__who")).alias("p")).select("p.a", "p.b")
    half = slots.join(summed, ["a", "b"], "left").select(
        "a",
        "b",
        F.try_divide(F.coalesce("__sum", F.lit(0.0)), prints.scalar()).alias("jaccard"),
    )
    return _mirrored(half, "a", "b")


def sequence_kendall(
    ordered: DataFrame, of: str, fingerprint: Sequence[str], chunk: int = 65536
) -> DataFrame:
    """tau of two settings' selections position by position; null when lengths differ.

    ``ordered``: fingerprint, of, pos, n, sample_id (integers).
    """
    keys = [*fingerprint]
    a = ordered.select(
        *keys, "pos", F.col(of).alias("a"), F.col("n").alias("na"), F.col("sample_id").alias("x")
    )
    b = ordered.select(
        *keys, "pos", F.col(of).alias("b"), F.col("n").alias("nb"), F.col("sample_id").alias("y")
    )
    pairs = a.join(b, [*keys, "pos"]).filter("a < b")
    # sample ids are integers already, so they serve as ranks
    ranked = (
        pairs.filter("na = nb")
        .groupBy(*keys, "a", "b", F.col("x").cast("long").alias("rx"), F.col("y").cast("long").alias("ry"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    taus = _tau_from_ranks(ranked, [*keys, "a", "b"], chunk)
    return pairs.select(*keys, "a", "b").distinct().join(taus, [*keys, "a", "b"], "left")


def multiset_jaccard(selected: DataFrame) -> DataFrame:
    """Jaccard of selections with multiplicity per dataset, and over all datasets.

    ``selected``: dataset, strategy, sample_id. The union of counts is the sum of both
    minus the intersection, so only common samples are ever matched.
    """
    counts = written(
        selected.groupBy("dataset", "strategy", "sample_id").agg(F.count(F.lit(1)).alias("c"))
    )
    held = counts.groupBy("dataset", "sample_id").agg(
        F.sort_array(F.collect_list(F.struct("strategy", "c"))).alias("__h")
    )
    common = (
        held.groupBy("dataset", "__h")
        .agg(F.count(F.lit(1)).alias("__k"))
        .select("dataset", "__k", F.explode(_pairs_of("__h")).alias("p"))
        .groupBy(
            "dataset", F.col("p.a.strategy").alias("a"), F.col("p.b.strategy").alias("b")
        )
        .agg(F.sum(F.col("__k") * F.least("p.a.c", "p.b.c")).alias("both"))
    )
    totals = counts.groupBy("dataset", "strategy").agg(F.sum("c").alias("t"))
    names = totals.groupBy("dataset").agg(F.sort_array(F.collect_set("strategy")).alias("__who"))
    slots = names.select("dataset", F.explode(_pairs_of("__who")).alias("p")).select(
        "dataset", "p.a", "p.b"
    )
    ta = totals.select("dataset", F.col("strategy").alias("a"), F.col("t").alias("ta"))
    tb = totals.select("dataset", F.col("strategy").alias("b"), F.col("t").alias("tb"))
    cells = (
        slots.join(common, ["dataset", "a", "b"], "left")
        .join(ta, ["dataset", "a"])
        .join(tb, ["dataset", "b"])
        .select(
            F.col("dataset").cast("string").alias("dataset"),
            "a",
            "b",
            F.coalesce("both", F.lit(0)).alias("both"),
            (F.col("ta") + F.col("tb") - F.coalesce("both", F.lit(0))).alias("either"),
        )
    )
    half = (
        cells.unionByName(cells.withColumn("dataset", F.lit("All Datasets Combined")))
        .groupBy("dataset", "a", "b")
        .agg((F.sum("both") / F.sum("either")).alias("jaccard"))
    )
    return _mirrored(half, "a", "b")


def strategy_similarity(
    ordered: DataFrame, fingerprint: Sequence[str], of: str = "strategy"
) -> DataFrame:
    """Jaccard and Spearman of the selections of two strategies.

    ``ordered``: fingerprint, strategy, pos, sample_id. Spearman ranks the sample ids of
    each sequence and matches them by position, averaged over fingerprints.
    """
    jaccards = jaccard_matrix(ordered, of, fingerprint)
    ranked = position(
        ordered,
        [*fingerprint, of],
        F.floor(F.col("sample_id") / CHUNK),
        ["sample_id", "pos"],
        "__rank",
    )
    spearman = pearson_matrix(ranked, of, ["pos"], "__rank", by=fingerprint)
    means = spearman.groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(
        F.avg("r").alias("spearman")
    )
    return jaccards.join(means, ["a", "b"], "left")


# --- matrices --------------------------------------------------------------


def framework_means(matrix: DataFrame, value: str = "r") -> DataFrame:
    """Mean and population deviation of correlations per pair of label suffixes ``(...)``."""
    suffix = lambda c: F.regexp_extract(c, r"\(([^)]*)\)", 1)
    return (
        matrix.select(suffix("x").alias("group_x"), suffix("y").alias("group_y"), value)
        .filter("group_x <> '' and group_y <> ''")
        .groupBy("group_x", "group_y")
        .agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    )


def mean_matrix(matrices: DataFrame, value: str = "tau") -> DataFrame:
    """Element-wise mean of many matrices; an undefined cell counts as 0."""
    return matrices.groupBy("x_name", "y_name").agg(
        F.avg(F.coalesce(value, F.lit(0.0))).alias("mean")
    )


def scenario_matrices(vectors: DataFrame, gold: DataFrame, of: str = "value") -> DataFrame:
    """tau matrix per scenario, with the reference vector as one more setting ``gold``.

    ``vectors``: scenario, ``of``, strategy, total.
    """
    names = vectors.select("scenario").distinct()
    with_gold = vectors.select("scenario", F.col(of).cast("string").alias(of), "strategy", "total")
    copies = (
        gold.groupBy()
        .agg(F.collect_list(F.struct("strategy", "total")).alias("g"))
        .select("g")
    )
    golden = names.withColumn("g", F.explode(copies.scalar())).select(
        "scenario", F.lit("gold").alias(of), "g.strategy", "g.total"
    )
    return kendall_matrix(
        with_gold.unionByName(golden), of, "strategy", "total", by=["scenario"]
    )


def row_means(matrix: DataFrame, value: str = "r") -> DataFrame:
    return matrix.groupBy("x").agg(F.avg(value).alias("total"))


def without_labels(matrix: DataFrame, fragments: Sequence[str], x: str = "x", y: str = "y"):
    """Drop rows and columns whose label contains any of the fragments."""
    hit = reduce(
        lambda a, b: a | b,
        [F.col(c).contains(f) for f in fragments for c in (x, y)],
    )
    return matrix.filter(~hit)


def column_pair(
    vectors: DataFrame, of: str, first, second, item: str = "strategy", value: str = "total"
) -> DataFrame:
    """Value pairs of two settings by item, from one conditional aggregate."""
    return (
        vectors.filter(F.col(of).isin([first, second]))
        .groupBy(item)
        .agg(
            F.max(F.when(F.col(of) == first, F.col(value))).alias("first"),
            F.max(F.when(F.col(of) == second, F.col(value))).alias("second"),
        )
        .filter("first is not null and second is not null")
    )


# --- redundancy ------------------------------------------------------------


def pair_correlations(
    pairs: DataFrame, vectors: DataFrame, item: str = "strategy", value: str = "value"
) -> DataFrame:
    """Pearson r and t of the listed fingerprint pairs (a, b) over common items; null where values do not vary."""
    left = vectors.select(F.col("fingerprint").alias("a"), item, F.col(value).alias("va"))
    right = vectors.select(F.col("fingerprint").alias("b"), item, F.col(value).alias("vb"))
    both = (F.col("va").isNotNull()) & (F.col("vb").isNotNull())
    # corr divides by zero there, an error in ANSI mode
    r = F.try_divide(F.covar_pop("va", "vb"), F.sqrt(F.var_pop("va") * F.var_pop("vb")))
    out = (
        pairs.join(left, "a")
        .join(right, ["b", item])
        .filter(both)
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n"), r.alias("r"))
    )
    out = out.withColumn("r", F.when(~F.isnan("r"), F.col("r")))
    return out.withColumn("t", pearson_t(F.col("r"), F.col("n")))


def pair_taus(
    pairs: DataFrame, vectors: DataFrame, item: str = "strategy", value: str = "value"
) -> DataFrame:
    """tau-b of the listed fingerprint pairs over common items."""
    left = vectors.select(F.col("fingerprint").alias("a"), item, F.col(value).alias("x"))
    right = vectors.select(F.col("fingerprint").alias("b"), item, F.col(value).alias("y"))
    return kendall(pairs.join(left, "a").join(right, ["b", item]), ["a", "b"])


def neighbour_pairs(prints: DataFrame, seed: int | None = None) -> DataFrame:
    """Pair fingerprints two by two: in their order, or in a seeded random order."""
    if seed is None:
        placed = position(
            prints,
            [],
            F.floor(F.col("fingerprint") / CHUNK),
            ["fingerprint"],
            "__at",
        )
    else:
        placed = hash_position(prints, [], [F.lit(seed)], ["fingerprint"], "__at")
    return (
        placed.groupBy(F.floor(F.col("__at") / 2).alias("__pair"))
        .agg(
            F.min_by("fingerprint", "__at").alias("a"),
            F.max_by("fingerprint", "__at").alias("b"),
        )
        .filter("a <> b")
        .select("a", "b")
    )


#: Most fingerprints, and values of theirs, whose rounds of elimination run inside one task.
LAST_ROWS, LAST_VALUES = 1 << 17, 1 << 21


def eliminate_redundant(
    vectors: DataFrame, threshold: float = 0.95, rounds: int = 51, patience: int = 10, seed: int = 0,
    last_rows: int | None = None,
) -> DataFrame:
    """Drop fingerprints that repeat a neighbour's strategy vector: (fingerprint, round, converged).

    Each round pairs the remaining fingerprints and drops the second of every pair with
    r above the threshold. A round without progress reshuffles. ``round`` is null for the kept ones.
    ``rounds`` rounds are run at least, and more until ``patience`` rounds in a row drop nothing; fewer
    only if no two fingerprints are left or all pairs of the remaining are known to differ (``converged``).

    The number of rounds grows with the logarithm of the fingerprints: a reshuffle drops about the share
    of pairs above the threshold. While more than ``last_rows`` remain (LAST_ROWS, fewer if they hold
    more than LAST_VALUES values), a round is a job over all of them; the rounds of the bounded rest run
    inside one task, where a round costs no job.
    """
    spark = vectors.sparkSession
    # every round reads the vectors again
    vectors = written(vectors)
    left = names = written(vectors.select("fingerprint").distinct())
    size, cells = names.count(), vectors.count()
    most = min(LAST_ROWS, LAST_VALUES * size // max(cells, 1)) if last_rows is None else last_rows
    kind = vectors.schema["fingerprint"].dataType.simpleString()
    schema = f"a {kind}, b {kind}, r double, gone boolean, round int"
    folder = f"{shared_folder(spark)}/pairs-{uuid.uuid4().hex}"

    def tested(first: int, last: int) -> DataFrame:
        paths = [f"{folder}/{i}" for i in range(first, last)]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def among(pairs: DataFrame) -> DataFrame:
        """Known pairs of fingerprints that remain."""
        held = pairs.filter("not gone").join(left.withColumnRenamed("fingerprint", "a"), "a", "left_semi")
        held = held.join(left.withColumnRenamed("fingerprint", "b"), "b", "left_semi")
        return held.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    shuffle, since, idle, round_no, converged = None, 0, 0, 0, False
    while size > max(most, 1) and (round_no < rounds or idle < patience):
        # a round gives a fingerprint one partner
        if idle and size - 1 <= round_no:
            converged = among(tested(0, round_no)).count() == size * (size - 1) // 2
            if converged:
                break
        # another order hardly repeats a pair
        known = tested(since, round_no).filter("not gone").select("a", "b")
        pairs = neighbour_pairs(left, shuffle).join(known, ["a", "b"], "left_anti")
        found = pair_correlations(pairs, vectors).select(
            "a",
            "b",
            "r",
            F.coalesce(F.col("r") > threshold, F.lit(False)).alias("gone"),
            F.lit(round_no).alias("round"),
        )
        found.write.parquet(f"{folder}/{round_no}")
        gone = tested(round_no, round_no + 1).filter("gone").select(F.col("b").alias("fingerprint"))
        lost = gone.count()
        if lost:
            left = written(left.join(gone, "fingerprint", "left_anti"))
        else:
            shuffle, since = seed + round_no, round_no + 1
        idle = 0 if lost else idle + 1
        size, round_no = size - lost, round_no + 1
    ended = converged or size < 2 or (round_no >= rounds and idle >= patience)
    early = tested(0, round_no).filter("gone").select(F.col("b").alias("fingerprint"), "round")
    if ended:
        return names.join(early, "fingerprint", "left").select("fingerprint", "round", F.lit(True).alias("converged"))
    state = _Rounds(threshold, rounds, patience, seed, shuffle, idle, round_no)
    late = written(_last_rounds(left, vectors, among(tested(0, round_no)), state))
    end = late.agg(F.min("converged")).scalar()
    return late.select("fingerprint", "round", "converged").unionByName(early.withColumn("converged", end))


@dataclass(frozen=True)
class _Rounds:
    """Where the rounds of an elimination stand."""

    threshold: float
    rounds: int
    patience: int
    seed: int
    shuffle: int | None
    idle: int
    round_no: int


def _last_rounds(left: DataFrame, vectors: DataFrame, known: DataFrame, state: _Rounds) -> DataFrame:
    """The rounds of ``eliminate_redundant`` from ``state`` on, for a bounded number of fingerprints."""
    cell = F.struct(F.col("strategy").alias("i"), F.col("value").cast("double").alias("v"))
    lists = (
        vectors.filter("strategy is not null and value is not null")
        .groupBy("fingerprint")
        .agg(F.sort_array(F.collect_list(cell)).alias("c"))
    )
    rows = left.join(lists, "fingerprint", "left").select(
        F.lit(0).alias("all"),
        "fingerprint",
        F.col("fingerprint").cast("string").alias("name"),
        F.col("c.i").alias("items"),
        F.col("c.v").alias("values"),
    )
    kind = left.schema["fingerprint"].dataType.simpleString()

    def run(own: pa.Table, pairs: pa.Table) -> pa.Table:
        own = own.take(pc.array_sort_indices(own["fingerprint"].combine_chunks(), null_placement="at_start"))
        out, converged = _rounds_of(own, pairs, state)
        rounds = pa.array(out, pa.int32(), mask=out < 0)
        return pa.table({"fingerprint": own["fingerprint"], "round": rounds, "converged": pa.array(np.full(len(out), converged))})

    return cogrouped(
        rows, known.withColumn("all", F.lit(0)), ["all"], run, f"fingerprint {kind}, round int, converged boolean"
    )


def _rounds_of(own: pa.Table, pairs: pa.Table, state: _Rounds) -> tuple[np.ndarray, bool]:
    """Round in which each row is dropped (-1: kept), and whether the rounds ended by themselves."""
    n = own.num_rows
    ids, names = own["fingerprint"].to_pylist(), own["name"].to_pylist()
    correlation = _row_correlation(own)
    number = {v: i for i, v in enumerate(ids)}
    alive, out = np.ones(n, bool), np.full(n, -1)
    missing = np.array([v is None for v in ids], bool)
    pair = [np.array([number[v] for v in pairs[c].to_pylist()], np.int64) for c in ("a", "b")]
    # pairs known to differ, as numbers: all, and those of the present order
    known, fresh = np.minimum(*pair) * n + np.maximum(*pair), []
    shuffle, idle, round_no, limit = state.shuffle, state.idle, state.round_no, 1 << 20

    def placed() -> np.ndarray:
        left = np.flatnonzero(alive)
        if shuffle is None:
            return left
        text = [str(shuffle) if names[i] is None else f"{shuffle}|{names[i]}" for i in left]
        return left[np.argsort(np.array([md5(t.encode()).hexdigest() for t in text], "S32"), kind="stable")]

    def merged() -> np.ndarray:
        codes = np.unique(np.concatenate([known, *fresh]))
        return codes[alive[codes // n] & alive[codes % n]]

    order = placed()
    while len(order) > 1 and (round_no < state.rounds or idle < state.patience):
        if idle and len(order) - 1 <= round_no:
            known, fresh = merged(), []
            if len(known) == len(order) * (len(order) - 1) // 2:
                return out, True
        half = len(order) // 2
        a, b = order[: 2 * half : 2], order[1 : 2 * half : 2]
        r, met = correlation(a, b)
        met &= ~missing[a] & ~missing[b]
        gone = met & (r > state.threshold)
        same = met & ~gone
        fresh.append(np.minimum(a, b)[same] * n + np.maximum(a, b)[same])
        if sum(map(len, fresh)) > limit:
            known, fresh = merged(), []
            limit = max(limit, 2 * len(known))
        lost = b[gone]
        alive[lost], out[lost] = False, round_no
        if len(lost):
            order, idle = order[alive[order]], 0
        else:
            shuffle, idle = state.seed + round_no, idle + 1
            order = placed()
        round_no += 1
    return out, len(order) < 2 or idle >= state.patience


def _row_correlation(own: pa.Table):
    """Function of row numbers a, b: Pearson r over common items, and where there is a common item."""
    lists = own["items"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()) * lists.is_valid().to_numpy(zero_copy_only=False)
    row, ends = np.repeat(np.arange(own.num_rows), sizes), np.cumsum(sizes)
    coded = lists.flatten().dictionary_encode()
    item = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    value = own["values"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    x = np.zeros((own.num_rows, max(len(coded.dictionary), 1)))
    has = np.zeros(x.shape, bool)
    x[row, item], has[row, item] = value, True
    # rows with several values of an item meet value by value
    several = has.sum(axis=1) < sizes

    def r_of(x: np.ndarray, y: np.ndarray, both: np.ndarray) -> np.ndarray:
        n, first = both.sum(axis=1), both.argmax(axis=1)
        at = np.arange(len(both))

        def centred(v: np.ndarray) -> np.ndarray:
            # from the first value, so that equal values give exactly zero
            v = np.where(both, v - v[at, first][:, None], 0.0)
            return np.where(both, v - (v.sum(axis=1) / n)[:, None], 0.0)

        x, y = centred(x), centred(y)
        return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))

    def correlation(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(all="ignore"):
            both = has[a] & has[b]
            r = r_of(x[a], x[b], both)
            for i in np.flatnonzero((several[a] | several[b]) & both.any(axis=1)):
                p, q = (slice(ends[k] - sizes[k], ends[k]) for k in (a[i], b[i]))
                j, k = np.nonzero(item[p][:, None] == item[q])
                r[i] = r_of(value[p][j][None], value[q][k][None], np.ones((1, len(j)), bool))[0]
        return r, both.any(axis=1)

    return correlation

"""Pairwise distances and k nearest neighbours by cosine distance.

Neighbours come from the cell index of ``cells``: tasks compare blocks of near rows by a matrix
product, hand on only the k best per query, and skip blocks that cannot hold any of them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from curveboard.functions.vectors import cosine_distance, with_unit
from curveboard.operators import cells

BLOCK_ROWS, FEW_BLOCKS = 2048, 16
#: Vectors of a bucket of ``many_pair_distances``.
SQUARE_ROWS = 1 << 15


def neighbour_count(n: Column) -> Column:
    """The default k: half the square root of the dataset size, rounded down."""
    return F.floor(F.sqrt(n) / 2).cast("int")


def pair_distances(
    pairs: DataFrame, samples: DataFrame, keys: Sequence[str] = (), many: bool = False
) -> DataFrame:
    """Distance of the pairs that are asked for: (keys, a, b) -> + distance.

    With ``many`` pairs per sample the vectors are not sent along with each pair.
    """
    keys = list(keys)
    if many:
        return many_pair_distances(pairs, samples, keys)
    left = samples.select(
        *keys, F.col("sample_id").alias("a"), F.col("features").alias("__fa")
    )
    right = samples.select(
        *keys, F.col("sample_id").alias("b"), F.col("features").alias("__fb")
    )
    return (
        pairs.join(left, [*keys, "a"])
        .join(right, [*keys, "b"])
        .select(
            *pairs.columns,
            cosine_distance(F.col("__fa"), F.col("__fb")).alias("distance"),
        )
    )


def many_pair_distances(pairs: DataFrame, samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``pair_distances`` where a sample stands in many pairs: vectors are copied per square, not per pair.

    Samples are dealt to about n / SQUARE_ROWS buckets by their id. The pairs of two buckets meet the
    vectors of both, so the exchange holds each vector once per bucket and two ids per pair. Missing ids
    match nothing; an id that stands in several samples gives a row for each.
    """
    keys = list(keys)
    rows = samples.filter("sample_id is not null and features is not null").select(*keys, "sample_id", "features")
    count = max(4, -(-rows.count() // SQUARE_ROWS))
    units = with_unit(rows).drop("features")

    def bucket(column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(count)).cast("int")

    every = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    own = bucket("sample_id")
    sides = [
        units.select(*keys, own.alias("__qa"), every.alias("__qb"), F.lit(0).alias("__side"), "sample_id", "unit"),
        units.select(*keys, every.alias("__qa"), own.alias("__qb"), F.lit(1).alias("__side"), "sample_id", "unit"),
    ]
    square = [*keys, "__qa", "__qb"]
    left = pairs.filter("a is not null and b is not null").withColumn("__qa", bucket("a")).withColumn("__qb", bucket("b"))
    schema = pairs.withColumn("distance", F.lit(0.0)).schema
    names = [f.name for f in schema]

    def meet(p: pa.Table, v: pa.Table) -> pa.Table:
        p, at, found = p.select(names[:-1]), np.arange(p.num_rows), []
        for side, column in enumerate(("a", "b")):
            own = v.filter(pc.equal(v["__side"], side)).sort_by("sample_id")
            ids, wanted = own["sample_id"].to_numpy(), p[column].to_numpy()[at]
            low, high = np.searchsorted(ids, wanted, "left"), np.searchsorted(ids, wanted, "right")
            again = np.repeat(np.arange(len(at)), high - low)
            found = [f[again] for f in found] + [np.repeat(low, high - low) + cells.within(high - low)]
            at = at[again]
            if side == 0:
                x = cells.matrix(own["unit"])
            else:
                y = cells.matrix(own["unit"])
        distance = np.zeros(len(at))
        for low in range(0, len(at), 1 << 16):
            part = slice(low, low + (1 << 16))
            distance[part] = 1.0 - np.einsum("ij,ij->i", x[found[0][part]], y[found[1][part]])
        return pa.table([*p.take(pa.array(at)).columns, pa.array(distance)], names=names)

    return cells.cogrouped(left, sides[0].unionByName(sides[1]), square, meet, schema)


def mean_distance_to_all(samples: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Row means of the distance matrix in linear time."""
    from curveboard.functions.vectors import dot, vector_sum

    units = with_unit(samples)
    total = vector_sum(units, keys, "unit", "__s")
    return units.join(total, list(keys)).select(
        *keys,
        "sample_id",
        (F.lit(1.0) - dot(F.col("unit"), F.col("__s")) / F.col("__s_n")).alias("mean_distance"),
    )


def _renamed(df: DataFrame) -> DataFrame:
    """Own column names for the candidate side, which may stem from the same table."""
    return df.select(*[F.col(c).alias(f"c_{c}") for c in df.columns])


def _best_of_block(key: tuple, queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
    out = {"__g": [], "query_id": [], "neighbour_id": [], "distance": []}
    if len(queries) and len(candidates):
        left = np.stack(queries["unit"].to_numpy())
        right = np.stack(candidates["c_unit"].to_numpy())
        distance = 1.0 - left @ right.T
        q_ids = queries["sample_id"].to_numpy()
        c_ids = candidates["c_sample_id"].to_numpy()
        q_label = queries["label"].to_numpy()
        c_label = candidates["c_label"].to_numpy()
        scope = queries["scope"].iloc[0]
        barred = q_ids[:, None] == c_ids[None, :]
        if scope == "other":
            barred |= q_label[:, None] == c_label[None, :]
        distance[barred] = np.inf
        k = min(int(queries["k"].max()), len(candidates))
        if k > 0:
            order = np.lexsort((np.broadcast_to(c_ids, distance.shape), distance), axis=1)[:, :k]
            best = np.take_along_axis(distance, order, axis=1)
            keep = np.isfinite(best)
            rows = np.nonzero(keep)[0]
            out = {
                "__g": np.full(len(rows), key[0]),
                "query_id": q_ids[rows],
                "neighbour_id": c_ids[order[keep]],
                "distance": best[keep],
            }
    return pd.DataFrame(out)


def _wanted(k: Column | int | None) -> Column:
    return neighbour_count(F.col("__n")) if k is None else (F.lit(k) if isinstance(k, int) else k)


def _block_knn(samples: DataFrame, wanted: Column, scope: str, key: str, block_rows: int) -> DataFrame:
    """Every block of a dataset compared with every other: one job, for datasets of a few blocks."""
    # neighbours of the own label never leave their label's blocks
    groups = [key, "label"] if scope == "same" else [key]
    sizes = samples.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    ks = sizes.select(key, wanted.alias("k"))
    blocks = samples.groupBy(*groups).agg(
        F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("__blocks")
    )
    units = (
        with_unit(samples.select(key, "sample_id", "features", "label"))
        .drop("features")
        .join(ks, key)
        .join(blocks, groups)
        .withColumn("__block", F.pmod(F.xxhash64("sample_id"), F.col("__blocks")).cast("int"))
        .withColumn("scope", F.lit(scope))
    )
    every = F.sequence(F.lit(0), F.col("__blocks") - 1)
    cols = [key, "sample_id", "label", "unit", "k", "scope"]
    queries = units.select(*cols, F.col("__block").alias("__q"), F.explode(every).alias("__c"))
    candidates = _renamed(
        units.select(*cols, F.explode(every).alias("__q"), F.col("__block").alias("__c"))
    )
    id_type = samples.schema["sample_id"].dataType
    out = T.StructType(
        [
            T.StructField("__g", samples.schema[key].dataType),
            T.StructField("query_id", id_type),
            T.StructField("neighbour_id", id_type),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    cell = [*groups, "__q", "__c"]
    partial = (
        queries.groupBy(*cell)
        .cogroup(candidates.groupBy(*[f"c_{c}" for c in cell]))
        .applyInPandas(_best_of_block, out)
        .withColumnRenamed("__g", key)
    )
    merged = W.partitionBy(key, "query_id").orderBy("distance", "neighbour_id")
    return (
        partial.withColumn("rank", F.row_number().over(merged))
        .join(ks, key)
        .filter("rank <= k")
        .drop("k")
    )


def _units(samples: DataFrame, k: Column | int | None, scope: str, key: str) -> tuple[DataFrame, list[str]]:
    """(groups, sample_id, label, unit, k) of samples with features, and the groups to search in."""
    sizes = samples.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    # its size is known to the join, which else moves a dataset into one task
    ks = cells.written(sizes.select(key, _wanted(k).alias("k")))
    # labels only matter where they bar or bind; a missing one is a label like any other
    label = F.lit("") if scope == "all" else F.coalesce(F.col("label").cast("string"), F.lit("\0"))
    rows = samples.filter("features is not null").select(key, "sample_id", label.alias("label"), "features")
    units = with_unit(rows).drop("features").join(ks, key)
    # neighbours of the own label never leave their label's cells
    return units, [key, "label"] if scope == "same" else [key]


def knn(
    samples: DataFrame,
    k: Column | int | None = None,
    scope: str = "all",
    key: str = "dataset",
    cell_rows: int | None = None,
) -> DataFrame:
    """The k nearest other samples of each sample inside its dataset, exactly.

    ``scope``: ``all``, ``same`` (own label only) or ``other`` (other labels only).
    Ties go to the smaller id. ``k`` defaults to half the square root of the size.
    Blocks that cannot hold any of a block's k best, by the triangle inequality, are not compared.
    Where all datasets have at most ``FEW_BLOCKS`` blocks, comparing all pairs of them takes less time
    than the index. ``cell_rows`` sets the rows of a cell and asks for the index at any size.
    Output: key, query_id, neighbour_id, distance, rank.
    """
    samples = samples.filter("features is not null")
    if cell_rows is None:
        most = samples.groupBy(key).count().agg(F.max("count")).first()[0] or 0
        if most <= FEW_BLOCKS * BLOCK_ROWS:
            # no fewer blocks than keep all cores busy
            rows = max(256, min(BLOCK_ROWS, most // 4))
            return _block_knn(samples, _wanted(k), scope, key, rows)
    units, groups = _units(samples, k, scope, key)
    found = cells.neighbours(units, groups, scope, None, None if cell_rows is None else F.lit(cell_rows))
    return found.select(key, "query_id", "neighbour_id", "distance", "rank")


#: Standard deviations by which the approximate search expects an offset to point towards a query.
SLACK = 2.0


def approximate_knn(
    samples: DataFrame,
    k: Column | int | None = None,
    scope: str = "all",
    key: str = "dataset",
    slack: float = SLACK,
    cell_rows: int | None = None,
) -> DataFrame:
    """The k nearest other samples found by probing cells; all k of them, some perhaps not the nearest.

    The own and the nearest blocks are compared first. Others are probed where a row of theirs can be
    among the k best so far, if its offset from its centre points towards the query by at most
    ``slack`` standard deviations of a random direction. With ``slack`` at the square root of the
    dimensions the search is exact. Samples that still lack k neighbours meet every block.
    Output as ``knn``.
    """
    units, groups = _units(samples, k, scope, key)
    found = cells.neighbours(units, groups, scope, slack, None if cell_rows is None else F.lit(cell_rows))
    return found.select(key, "query_id", "neighbour_id", "distance", "rank")


def _block_minimum(key: tuple, queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
    if not len(queries) or not len(candidates):
        return pd.DataFrame({"sample_id": [], "distance": []})
    left = np.stack(queries["features"].to_numpy())
    right = np.stack(candidates["c_features"].to_numpy())
    square = (
        (left * left).sum(axis=1)[:, None] + (right * right).sum(axis=1)[None, :]
        - 2.0 * left @ right.T
    )
    best = np.sqrt(np.maximum(square, 0.0)).min(axis=1)
    return pd.DataFrame({"sample_id": queries["sample_id"].to_numpy(), "distance": best})


def nearest(queries: DataFrame, candidates: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Euclidean distance of each query to its nearest candidate: (sample_id, distance)."""
    blocks = {
        "__nq": queries.agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int")).scalar(),
        "__nc": candidates.agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int")).scalar(),
    }

    def cut(df: DataFrame, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        sized = df.select("sample_id", "features")
        for name, count in blocks.items():
            sized = sized.withColumn(name, count)
        sized = sized.filter("__nq > 0 and __nc > 0")
        return sized.select(
            "sample_id",
            "features",
            F.pmod(F.xxhash64("sample_id"), F.col(own)).cast("int").alias(names[0]),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(names[1]),
        )

    left = cut(queries, "__nq", "__nc", ("__q", "__c"))
    right = _renamed(cut(candidates, "__nc", "__nq", ("__c", "__q")))
    schema = T.StructType(
        [
            T.StructField("sample_id", queries.schema["sample_id"].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    parts = (
        left.groupBy("__q", "__c")
        .cogroup(right.groupBy("c___q", "c___c"))
        .applyInPandas(_block_minimum, schema)
    )
    return parts.groupBy("sample_id").agg(F.min("distance").alias("distance"))

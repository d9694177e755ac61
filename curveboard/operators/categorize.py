"""Sample categorisers: one value per sample, normalised over its dataset."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from curveboard.functions.vectors import dot, vector_sum, with_unit
from curveboard.operators import grouped
from curveboard.operators.cells import written
from curveboard.operators.curves import time_lag
from curveboard.operators.neighbours import knn, neighbour_count
from curveboard.session import cut_lineage, shared_folder


def normalised(
    values: DataFrame, scale: float | Column, value: str = "value", extra: DataFrame | None = None
) -> DataFrame:
    """value / sum over the dataset * scale. ``extra`` joins per-dataset columns for scale."""
    totals = values.groupBy("dataset").agg(F.sum(value).alias("__total"))
    rows = values.join(totals, "dataset")
    if extra is not None:
        rows = rows.join(extra, "dataset")
    factor = scale if isinstance(scale, Column) else F.lit(float(scale))
    return rows.select(
        "dataset", "sample_id", (F.try_divide(value, "__total") * factor).alias("value")
    )


def _k_of(samples: DataFrame) -> DataFrame:
    return samples.groupBy("dataset").agg(
        neighbour_count(F.count(F.lit(1)).cast("double")).alias("__k")
    )


def _fill(samples: DataFrame, values: DataFrame) -> DataFrame:
    """Every sample of the dataset, 0 where nothing was counted."""
    return samples.select("dataset", "sample_id").join(
        values, ["dataset", "sample_id"], "left"
    ).select("dataset", "sample_id", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))


def wrong_classifications(predictions: DataFrame) -> DataFrame:
    """How often a sample was predicted wrongly. ``predictions`` carries the label."""
    wrong = predictions.groupBy("dataset", "sample_id").agg(
        F.sum((F.col("y_pred") != F.col("label")).cast("double")).alias("value")
    )
    return normalised(wrong, 1000)


def class_switches(predictions: DataFrame, cycles: int = 3) -> DataFrame:
    """Concentration of a sample's predictions over the first cycles, summed over runs.

    A high value means few switches.
    """
    early = predictions.filter(F.col("cycle") < cycles)
    votes = early.groupBy("dataset", "run_id", "sample_id", "y_pred").agg(
        F.count(F.lit(1)).alias("c")
    )
    index = votes.groupBy("dataset", "run_id", "sample_id").agg(
        (F.sum(F.col("c") * F.col("c")) / (F.sum("c") * F.sum("c"))).alias("h")
    )
    return normalised(
        index.groupBy("dataset", "sample_id").agg(F.sum("h").alias("value")), 1000
    )


def boundary_closeness(samples: DataFrame) -> DataFrame:
    """Smallest absolute decision value of one-vs-rest linear machines (own semantics).

    All datasets are fitted together, one job per step; see ``grouped.linear_machines``.
    """
    cut = grouped.blocks(samples)
    return normalised(grouped.decision_gaps(cut, grouped.linear_machines(cut)), 1000)


def region_density(samples: DataFrame, neighbours: DataFrame | None = None) -> DataFrame:
    """Mean distance to the k nearest neighbours."""
    near = knn(samples) if neighbours is None else neighbours
    mean = near.groupBy("dataset", F.col("query_id").alias("sample_id")).agg(
        F.avg("distance").alias("value")
    )
    return normalised(mean, 100.0 * F.col("__k"), extra=_k_of(samples))


def melting_pot(samples: DataFrame, neighbours: DataFrame | None = None) -> DataFrame:
    """Concentration of classes among the k nearest neighbours."""
    near = knn(samples) if neighbours is None else neighbours
    # two short columns, written so that the join sees their size and need not move the pairs
    labels = written(samples.select("dataset", F.col("sample_id").alias("neighbour_id"), "label"))
    votes = (
        near.join(labels, ["dataset", "neighbour_id"])
        .groupBy("dataset", "query_id", "label")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    index = votes.groupBy("dataset", F.col("query_id").alias("sample_id")).agg(
        (F.sum(F.col("c") * F.col("c")) / (F.sum("c") * F.sum("c"))).alias("value")
    )
    return normalised(index, 100.0 * F.col("__k"), extra=_k_of(samples))


def in_optimal_selection(
    samples: DataFrame, selected: DataFrame, oracle_strategies: Sequence
) -> DataFrame:
    """In how many runs of the oracle strategies a sample was selected."""
    chosen = (
        selected.filter(F.col("strategy").isin(list(oracle_strategies)))
        .groupBy("dataset", "sample_id")
        .agg(F.countDistinct("run_id").alias("value"))
    )
    return _fill(samples, normalised(chosen, 100))


def _class_knn(samples: DataFrame, scope: str) -> DataFrame:
    near = knn(samples, scope=scope)
    mean = near.groupBy("dataset", F.col("query_id").alias("sample_id")).agg(
        F.avg("distance").alias("value")
    )
    if scope == "same":
        # a class of at most k samples averages over itself, the sample included
        sizes = samples.groupBy("dataset", "label").agg(F.count(F.lit(1)).alias("__size"))
        small = samples.join(sizes, ["dataset", "label"]).join(_k_of(samples), "dataset").filter(
            F.col("__size") <= F.col("__k")
        )
        inside = class_mean_distance_raw(small, "same")
        mean = (
            mean.join(
                inside.select("dataset", "sample_id", F.col("value").alias("__inside")),
                ["dataset", "sample_id"],
                "full_outer",
            )
            .select("dataset", "sample_id", F.coalesce("__inside", "value").alias("value"))
        )
    return normalised(mean, F.col("__k").cast("double"), extra=_k_of(samples))


def same_class_knn(samples: DataFrame) -> DataFrame:
    return _class_knn(samples, "same")


def other_class_knn(samples: DataFrame) -> DataFrame:
    return _class_knn(samples, "other")


def cluster_center_closeness(samples: DataFrame, seed: int = 1) -> DataFrame:
    """Distance to the nearest of k K-means centres, k half the square root of the size.

    All datasets are clustered together; the centres are rows of a table.
    """
    cut = grouped.blocks(samples)
    ks = _k_of(samples.filter("features is not null")).select(
        "dataset", F.greatest(F.lit(2), F.col("__k")).alias("k")
    )
    gaps = grouped.to_centres(cut, grouped.kmeans(cut, ks, seed))
    scale = 100.0 * F.greatest(F.lit(2), F.col("__k"))
    values = gaps.select("dataset", "sample_id", F.col("distance").alias("value"))
    return normalised(values, scale, extra=_k_of(samples))


def improves_accuracy(accuracy_curve: DataFrame, selected: DataFrame) -> DataFrame:
    """Accuracy gained in the cycles whose batch held the sample.

    ``accuracy_curve``: run_id, cycle, value; ``selected``: dataset, run_id, cycle, sample_id.
    """
    gains = time_lag(accuracy_curve).filter("value is not null")
    credited = (
        selected.join(gains, ["run_id", "cycle"])
        .groupBy("dataset", "sample_id")
        .agg(F.sum("value").alias("value"))
    )
    return normalised(credited, 1000)


def average_uncertainty(
    samples: DataFrame, seeds: int = 5, folds: int = 10, steps: int = 10
) -> DataFrame:
    """Summed top class probability on held-out folds (own semantics).

    Three learners (Gaussian Bayes, linear discriminant, logistic) for every seed and fold of every
    dataset: the folds of a learner come from sums per fold, not from a fit each. Folds follow an MD5
    digest of seed and id.
    """
    cut = grouped.blocks(samples)
    models = grouped.fold_models(cut, seeds, folds, steps)
    return normalised(grouped.held_out_certainty(cut, models, seeds, folds), 100)


def _grow_tree(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One isolation tree on a bounded sample: random axis, random cut, fixed height."""
    seed, tree = int(key[1]), int(key[2])
    rng = np.random.default_rng([seed, tree])
    ordered = rows.sort_values("sample_id")
    points = np.stack(ordered["features"].to_numpy())
    height = int(np.ceil(np.log2(max(len(points), 2))))
    nodes: list[tuple[int, int, float, int, float]] = []
    todo = [(1, points, 0)]
    while todo:
        node, inside, depth = todo.pop()
        spread = inside.max(axis=0) - inside.min(axis=0) if len(inside) else np.zeros(1)
        axes = np.nonzero(spread > 0)[0]
        if depth == height or len(inside) <= 1 or not len(axes):
            nodes.append((node, -1, 0.0, depth, float(len(inside))))
            continue
        axis = int(rng.choice(axes))
        cut = float(rng.uniform(inside[:, axis].min(), inside[:, axis].max()))
        nodes.append((node, axis, cut, depth, 0.0))
        below = inside[:, axis] < cut
        todo.append((2 * node, inside[below], depth + 1))
        todo.append((2 * node + 1, inside[~below], depth + 1))
    frame = pd.DataFrame(nodes, columns=["node", "axis", "cut", "depth", "size"])
    frame.insert(0, "tree", tree)
    frame.insert(0, "seed", seed)
    frame.insert(0, "dataset", key[0])
    return frame


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    c = 2.0 * (np.log(np.maximum(safe - 1.0, 1.0)) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


def _path_lengths(tree: pd.DataFrame, points: np.ndarray) -> np.ndarray:
    """Depth at which each point leaves the tree, corrected for unsplit leaves."""
    nodes = tree.set_index("node")
    axis, cut = nodes["axis"].to_dict(), nodes["cut"].to_dict()
    leaf = dict(zip(nodes.index, nodes["depth"] + _average_path(nodes["size"].to_numpy())))
    path = np.zeros(len(points))
    todo = [(1, np.arange(len(points)))]
    while todo:
        at, who = todo.pop()
        if not len(who):
            continue
        if axis[at] < 0:
            path[who] = leaf[at]
            continue
        below = points[who, axis[at]] < cut[at]
        todo.append((2 * at, who[below]))
        todo.append((2 * at + 1, who[~below]))
    return path


def outlierness(
    samples: DataFrame,
    seeds: int = 5,
    trees: int = 100,
    sample_rows: int = 256,
    threshold: float = 0.5,
    block_rows: int = 8192,
) -> DataFrame:
    """How many seeds flag the sample in an isolation forest.

    A tree grows on a bounded random sample: samples fall into buckets by a hash, a tree
    picks one bucket and keeps its ``sample_rows`` luckiest. All samples then walk all
    trees of their dataset, block by block, next to one copy of the forest per block.
    """
    sizes = samples.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"),
        F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / (2 * sample_rows))).alias("__buckets"),
    )
    rows = samples.select("dataset", "sample_id", "features").join(sizes, "dataset")
    picks = sizes.select(
        "dataset",
        "__buckets",
        F.explode(F.sequence(F.lit(0), F.lit(seeds * trees - 1))).alias("__t"),
    ).select(
        "dataset", "__t", F.pmod(F.xxhash64("__t"), F.col("__buckets")).alias("__bucket")
    )
    lucky = W.partitionBy("dataset", "__t").orderBy(F.xxhash64("__t", "sample_id"), "sample_id")
    drawn = (
        rows.withColumn("__bucket", F.pmod(F.xxhash64("sample_id"), F.col("__buckets")))
        .join(picks, ["dataset", "__bucket"])
        .withColumn("__rn", F.row_number().over(lucky))
        .filter(F.col("__rn") <= sample_rows)
        .select(
            "dataset",
            F.floor(F.col("__t") / trees).cast("int").alias("seed"),
            (F.col("__t") % trees).alias("tree"),
            "sample_id",
            "features",
        )
    )
    dataset_type = samples.schema["dataset"].dataType
    node = T.StructType(
        [
            T.StructField("dataset", dataset_type),
            T.StructField("seed", T.IntegerType()),
            T.StructField("tree", T.IntegerType()),
            T.StructField("node", T.LongType()),
            T.StructField("axis", T.IntegerType()),
            T.StructField("cut", T.DoubleType()),
            T.StructField("depth", T.IntegerType()),
            T.StructField("size", T.DoubleType()),
        ]
    )
    forest = drawn.groupBy("dataset", "seed", "tree").applyInPandas(_grow_tree, node)
    blocks = F.ceil(F.col("n") / block_rows).cast("int")
    points = rows.select(
        "dataset",
        F.pmod(F.xxhash64("sample_id"), blocks).cast("int").alias("__block"),
        "sample_id",
        "features",
        "n",
    )
    copies = forest.join(
        sizes.select("dataset", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("__block")),
        "dataset",
    )
    out = T.StructType(
        [
            T.StructField("dataset", dataset_type),
            T.StructField("sample_id", samples.schema["sample_id"].dataType),
            T.StructField("value", T.DoubleType()),
        ]
    )

    def score(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"dataset": [], "sample_id": [], "value": []})
        features = np.stack(left["features"].to_numpy())
        reach = float(min(sample_rows, left["n"].iloc[0]))
        scale = max(float(_average_path(np.array([reach]))[0]), 1e-12)
        flags = np.zeros(len(left))
        for _, seed in right.groupby("seed"):
            depths = [_path_lengths(tree, features) for _, tree in seed.groupby("tree")]
            flags += np.power(2.0, -np.mean(depths, axis=0) / scale) > threshold
        return pd.DataFrame(
            {"dataset": left["dataset"], "sample_id": left["sample_id"], "value": flags}
        )

    flags = (
        points.groupBy("dataset", "__block")
        .cogroup(copies.groupBy("dataset", "__block"))
        .applyInPandas(score, out)
    )
    return normalised(flags, 100)


def class_mean_distance_raw(samples: DataFrame, scope: str) -> DataFrame:
    """Mean distance to own class, other classes or all samples, in linear time."""
    units = with_unit(samples)
    whole = vector_sum(units, ["dataset"], "unit", "__all")
    if scope == "all":
        rows = units.join(whole, "dataset")
        near, count = dot(F.col("unit"), F.col("__all")), F.col("__all_n")
    else:
        own = vector_sum(units, ["dataset", "label"], "unit", "__own")
        rows = units.join(own, ["dataset", "label"]).join(whole, "dataset")
        near, count = dot(F.col("unit"), F.col("__own")), F.col("__own_n")
        if scope == "other":
            near = dot(F.col("unit"), F.col("__all")) - near
            count = F.col("__all_n") - count
    return rows.select(
        "dataset", "sample_id", (F.lit(1.0) - F.try_divide(near, count)).alias("value")
    )


def same_class_distance(samples: DataFrame, scope: str = "same") -> DataFrame:
    """``scope='all'`` gives the mean over the whole distance row instead."""
    return normalised(class_mean_distance_raw(samples, scope), 1)


def other_class_distance(samples: DataFrame, scope: str = "other") -> DataFrame:
    return normalised(class_mean_distance_raw(samples, scope), 1)


def reassemble_predictions(predictions: DataFrame, splits: DataFrame) -> DataFrame:
    """Predictions given in split order -> (run_id, cycle, sample_id, y_pred).

    ``predictions``: dataset, bucket, run_id, cycle, part, y_pred array;
    ``splits``: dataset, bucket, part, pos, sample_id.
    """
    cells = predictions.select(
        "dataset", "bucket", "run_id", "cycle", "part", F.posexplode("y_pred").alias("pos", "y_pred")
    )
    return cells.join(splits, ["dataset", "bucket", "part", "pos"]).select(
        "dataset", "run_id", "cycle", "part", "sample_id", "y_pred"
    )


# Categorisers by name: extension point for own samples -> values functions.
CATEGORIZERS: dict[str, Callable[..., DataFrame]] = {
    "COUNT_WRONG_CLASSIFICATIONS": wrong_classifications,
    "SWITCHES_CLASS_OFTEN": class_switches,
    "CLOSENESS_TO_DECISION_BOUNDARY": boundary_closeness,
    "REGION_DENSITY": region_density,
    "MELTING_POT_REGION": melting_pot,
    "INCLUDED_IN_OPTIMAL_STRATEGY": in_optimal_selection,
    "CLOSENESS_TO_SAMPLES_OF_SAME_CLASS_kNN": same_class_knn,
    "CLOSENESS_TO_SAMPLES_OF_OTHER_CLASS_kNN": other_class_knn,
    "CLOSENESS_TO_CLUSTER_CENTER": cluster_center_closeness,
    "IMPROVES_ACCURACY_BY": improves_accuracy,
    "AVERAGE_UNCERTAINTY": average_uncertainty,
    "OUTLIERNESS": outlierness,
    "CLOSENESS_TO_SAMPLES_OF_SAME_CLASS": same_class_distance,
    "CLOSENESS_TO_SAMPLES_OF_OTHER_CLASS": other_class_distance,
}

"""Batch selection from an unlabelled pool: score a table, take the best k.

Common contract: (pool, batch size) -> distinct unlabelled ids; a pool that is not
larger than the batch is returned whole. A top k is kept per task before any exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from curveboard.functions.vectors import dot, vector_sum, with_unit
from curveboard.operators import grouped
from curveboard.operators.cells import matrix, written
from curveboard.operators.neighbours import knn, nearest
from curveboard.operators.scenarios import draw, fraction
from curveboard.session import cut_lineage


def unlabelled(pool: DataFrame, labelled: DataFrame) -> DataFrame:
    return pool.join(labelled.select("sample_id").distinct(), "sample_id", "left_anti")


def top_k(scored: DataFrame, k: int, largest: bool = True) -> DataFrame:
    """The k best ids with their score; equal scores go to the smaller id."""
    order = F.desc_nulls_last("score") if largest else F.asc_nulls_last("score")
    return scored.select("sample_id", "score").orderBy(order, "sample_id").limit(k)


def random_batch(pool: DataFrame, k: int, seed: int = 0) -> DataFrame:
    return (
        pool.select("sample_id", draw(seed, "sample_id").alias("score"))
        .orderBy("score", "sample_id")
        .limit(k)
    )


def least_confidence(p: Column) -> Column:
    return F.lit(1.0) - F.array_max(p)


def margin(p: Column) -> Column:
    """Gap between the two most likely classes; small means uncertain."""
    ordered = F.sort_array(p, asc=False)
    return F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1))


def entropy(p: Column) -> Column:
    return F.lit(0.0) - F.aggregate(
        p, F.lit(0.0), lambda s, x: s + F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0))
    )


def uncertainty_batch(pool: DataFrame, k: int, rule: str, p: str = "p") -> DataFrame:
    """Batch by ``least_confidence``, ``margin`` or ``entropy`` of class probabilities."""
    rules = {"least_confidence": least_confidence, "margin": margin, "entropy": entropy}
    scored = pool.withColumn("score", rules[rule](F.col(p)))
    return top_k(scored, k, largest=rule != "margin")


def vote_entropy(votes: DataFrame) -> DataFrame:
    """Entropy of the committee's votes per sample; ``votes``: sample_id, member, y_pred."""
    counts = votes.groupBy("sample_id", "y_pred").agg(F.count(F.lit(1)).alias("c"))
    sums = counts.groupBy("sample_id").agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.ln("c")).alias("s")
    )
    return sums.select("sample_id", (F.ln("n") - F.col("s") / F.col("n")).alias("score"))


def committee_divergence(members: DataFrame) -> DataFrame:
    """Mean KL divergence of members from their consensus.

    ``members``: sample_id, member, class, p.
    """
    consensus = members.groupBy("sample_id", "class").agg(
        F.avg("p").alias("q"),
        F.avg(
            F.when(F.col("p") > 0, F.col("p") * F.ln("p")).otherwise(F.lit(0.0))
        ).alias("h"),
    )
    # mean over members of p ln(p / q) is mean(p ln p) - q ln q
    gain = F.col("h") - F.when(F.col("q") > 0, F.col("q") * F.ln("q")).otherwise(F.lit(0.0))
    return consensus.groupBy("sample_id").agg(F.sum(gain).alias("score"))


def density_weighted(pool: DataFrame, p: str = "p") -> DataFrame:
    """Entropy times mean similarity to the pool, in linear time."""
    units = with_unit(pool)
    total = units.groupBy().agg(F.count(F.lit(1)))
    mean = vector_sum(units, [], "unit", "__s").select("__s")
    similarity = dot(F.col("unit"), F.col("__mean")) / total.scalar()
    return units.withColumn("__mean", mean.scalar()).select(
        "sample_id", (entropy(F.col(p)) * similarity).alias("score")
    )


def _distance_to(vector: Sequence[float]) -> Column:
    other = F.array(*[F.lit(float(x)) for x in vector])
    return F.sqrt(
        F.aggregate(
            F.zip_with("features", other, lambda a, b: (a - b) * (a - b)),
            F.lit(0.0),
            lambda s, x: s + x,
        )
    )


def k_center(pool: DataFrame, labelled: DataFrame, k: int, every: int = 8) -> DataFrame:
    """Greedy k-centre: k times the sample farthest from everything chosen so far.

    The first distances come from blocked products with the labelled set. One aggregate
    per round; a round's only driver state is the one new centre.
    """
    spark = pool.sparkSession
    rows = unlabelled(pool, labelled).select("sample_id", "features")
    begin = nearest(rows, labelled).withColumnRenamed("distance", "__d")
    rows = cut_lineage(
        rows.join(begin, "sample_id", "left").withColumn(
            "__d", F.coalesce("__d", F.lit(float("inf")))
        )
    )
    chosen = []
    for i in range(k):
        far = rows.agg(
            F.max_by(
                F.struct("sample_id", "features", "__d"),
                F.struct(F.col("__d"), -F.col("sample_id")),
            ).alias("r")
        ).first()["r"]
        if far is None:
            break
        chosen.append((i, far["sample_id"], float(far["__d"])))
        rows = rows.filter(F.col("sample_id") != far["sample_id"]).withColumn(
            "__d", F.least("__d", _distance_to(far["features"]))
        )
        if i % every == every - 1:
            rows = cut_lineage(rows)
    return spark.createDataFrame(chosen, "round int, sample_id long, distance double")


def k_center_coreset(pool: DataFrame, labelled: DataFrame, k: int, most: int = 1 << 20) -> DataFrame:
    """k centres by composable core sets: (round, sample_id, distance), in a fixed number of jobs.

    Every block of the pool picks k rows greedily, given the distances to the labelled set; the greedy
    choice is then made once more among the picks of all blocks. Rows of a block follow from the size of
    the pool, so that blocks and picks are about alike in number; blocks have at most ``most`` rows. The
    radius is at most four times that of the best k centres, the plain greedy one's at most twice. Equal
    distances go to the smaller id.
    """
    rows = unlabelled(pool, labelled).filter("features is not null").select("sample_id", "features")
    begin = nearest(rows, labelled).withColumnRenamed("distance", "gap")
    rows = written(
        rows.join(begin, "sample_id", "left").withColumn("gap", F.coalesce("gap", F.lit(float("inf"))))
    )
    n = rows.count()
    parts = max(1, -(-n // max(1, min(most, int((n * max(k, 1)) ** 0.5) + 1))))
    kind = rows.schema["sample_id"].dataType.simpleString()
    schema = f"round int, sample_id {kind}, features array<double>, gap double, distance double"
    out = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def greedy(table: pa.Table) -> pa.Table:
        table = table.sort_by("sample_id").combine_chunks()
        x, gap = matrix(table["features"]), table["gap"].to_numpy().copy()
        chosen, far = [], []
        for _ in range(min(k, len(x))):
            i = int(gap.argmax())
            chosen.append(i)
            far.append(float(gap[i]))
            gap = np.minimum(gap, np.sqrt(((x - x[i]) ** 2).sum(axis=1)))
            gap[chosen] = -1.0
        picked = table.select(["sample_id", "features", "gap"]).take(chosen)
        columns = [pa.array(range(len(chosen))), *picked.columns, pa.array(far, pa.float64())]
        return pa.table(columns, names=out.names).cast(out)

    block = F.pmod(F.xxhash64("sample_id"), F.lit(parts))
    picks = rows.groupBy(block.alias("block")).applyInArrow(greedy, schema)
    return picks.groupBy(F.lit(0).alias("all")).applyInArrow(greedy, schema).select("round", "sample_id", "distance")


def embedding_kmeans(pool: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """The sample nearest to each of k K-means centres."""
    rows = pool.select(F.lit(0).alias("dataset"), "sample_id", "features", F.lit(0.0).alias("label"))
    cut = grouped.blocks(rows)
    ks = cut.select("dataset").distinct().withColumn("k", F.lit(k))
    scored = grouped.to_centres(cut, grouped.kmeans(cut, ks, seed))
    return scored.groupBy("centre").agg(
        F.min_by("sample_id", F.struct("distance", "sample_id")).alias("sample_id"),
        F.min("distance").alias("score"),
    ).select("sample_id", "score")


def lightweight_coreset(pool: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Seeded sample with weight 1/(2n) + d^2 / (2 sum d^2), d the distance to the mean.

    Drawn without replacement: the k smallest -ln(u) / weight.
    """
    vectors = pool.select("sample_id", "features")
    size = vectors.agg(F.count(F.lit(1)))
    total = vector_sum(vectors, [], "features", "__s").select("__s")
    centred = vectors.withColumn("__s", total.scalar()).withColumn("__n", size.scalar())
    d2 = F.aggregate(
        F.zip_with("features", "__s", lambda a, s: (a - s / F.col("__n")) * (a - s / F.col("__n"))),
        F.lit(0.0),
        lambda s, x: s + x,
    )
    spread = centred.select("sample_id", "__n", d2.alias("__d2"))
    whole = spread.agg(F.sum("__d2"))
    weight = F.lit(0.5) / F.col("__n") + F.lit(0.5) * F.coalesce(
        F.try_divide(F.col("__d2"), whole.scalar()), F.lit(0.0)
    )
    luck = F.greatest(fraction(draw(seed, "sample_id")), F.lit(1e-15))
    return top_k(
        spread.select("sample_id", (-F.ln(luck) / weight).alias("score")), k, largest=False
    )


def discriminative(pool: DataFrame, labelled: DataFrame, k: int) -> DataFrame:
    """The k samples that a classifier is surest are not from the labelled set."""
    from pyspark.ml.classification import LogisticRegression

    rest = unlabelled(pool, labelled)
    rows = rest.select("sample_id", "features", F.lit(1.0).alias("label")).unionByName(
        labelled.select("sample_id", "features", F.lit(0.0).alias("label"))
    ).withColumn("features", array_to_vector("features"))
    model = LogisticRegression(maxIter=20, regParam=0.01).fit(rows)
    scored = model.transform(rows.filter("label = 1.0")).select(
        "sample_id", F.get(vector_to_array("probability"), F.lit(1)).alias("score")
    )
    return top_k(scored, k)


def contrastive(pool: DataFrame, k_neighbours: int = 10, p: str = "p") -> DataFrame:
    """Mean KL divergence of the neighbours' probabilities from the sample's own.

    ``pool``: dataset, sample_id, features, label, p.
    """
    near = knn(pool, k=k_neighbours)
    probabilities = pool.select("dataset", "sample_id", F.col(p).alias("__p"))
    own = probabilities.select("dataset", F.col("sample_id").alias("query_id"), F.col("__p").alias("__q"))
    other = probabilities.select("dataset", F.col("sample_id").alias("neighbour_id"), "__p")
    gain = F.aggregate(
        F.zip_with(
            "__p",
            "__q",
            lambda a, b: F.when((a > 0) & (b > 0), a * F.ln(a / b)).otherwise(F.lit(0.0)),
        ),
        F.lit(0.0),
        lambda s, x: s + x,
    )
    return (
        near.join(other, ["dataset", "neighbour_id"])
        .join(own, ["dataset", "query_id"])
        .groupBy("dataset", F.col("query_id").alias("sample_id"))
        .agg(F.avg(gain).alias("score"))
    )


def graph_density(
    pool: DataFrame, k: int, k_neighbours: int = 10, every: int = 4
) -> DataFrame:
    """Greedy density on each dataset's neighbour graph: (dataset, round, sample_id, density).

    Density is the mean edge similarity of a sample. Choosing a sample lowers its
    neighbours' density by its own, so a batch spreads over dense regions. Every round
    chooses one sample of every dataset at once; choices stay in tables.
    """
    near = knn(pool, k=k_neighbours).select(
        "dataset", "query_id", "neighbour_id", (F.lit(1.0) - F.col("distance")).alias("w")
    )
    back = near.select(
        "dataset",
        F.col("neighbour_id").alias("query_id"),
        F.col("query_id").alias("neighbour_id"),
        "w",
    )
    edges = near.unionByName(back).groupBy("dataset", "query_id", "neighbour_id")
    edges = cut_lineage(edges.agg(F.max("w").alias("w")))
    state = cut_lineage(
        edges.groupBy("dataset", F.col("query_id").alias("sample_id")).agg(F.avg("w").alias("density"))
    )
    chosen = None
    for i in range(k):
        best = (
            state.groupBy("dataset")
            .agg(
                F.max_by(
                    F.struct("sample_id", "density"),
                    F.struct(F.round("density", 12), -F.col("sample_id")),
                ).alias("r")
            )
            .select("dataset", F.lit(i).alias("round"), "r.sample_id", "r.density")
        )
        best = cut_lineage(best)
        chosen = best if chosen is None else chosen.unionByName(best)
        if i == k - 1:
            break
        beside = edges.join(
            best.select("dataset", F.col("sample_id").alias("query_id"), F.col("density").alias("__less")),
            ["dataset", "query_id"],
        ).select("dataset", F.col("neighbour_id").alias("sample_id"), "__less")
        state = (
            state.join(best.select("dataset", "sample_id"), ["dataset", "sample_id"], "left_anti")
            .join(beside, ["dataset", "sample_id"], "left")
            .select(
                "dataset",
                "sample_id",
                (F.col("density") - F.coalesce("__less", F.lit(0.0))).alias("density"),
            )
        )
        if i % every == every - 1:
            state = cut_lineage(state)
    return chosen


def pool_violations(
    selected: DataFrame,
    train: DataFrame,
    batch: DataFrame,
    keys: Sequence[str] = ("run_id",),
    train_keys: Sequence[str] | None = None,
) -> DataFrame:
    """Rows (keys, cycle, violation, n) where a run broke the selection contract.

    ``selected``: keys, cycle, sample_id; ``train``: keys, sample_id; ``batch``: keys,
    batch_size. A batch must hold distinct ids of the train set, none chosen before,
    and exactly the batch size unless the pool runs out. ``train_keys`` names the columns of
    ``selected`` that a train set belongs to, where many runs share one (default: ``keys``).
    """
    keys = list(keys)
    of = keys if train_keys is None else list(train_keys)
    counts = selected.groupBy(*keys, "sample_id").agg(
        F.count(F.lit(1)).alias("times"), F.min("cycle").alias("first_cycle"),
        F.max("cycle").alias("cycle"),
    )
    repeated = counts.filter("times > 1").groupBy(*keys, "cycle").agg(
        F.lit("selected twice").alias("violation"), F.count(F.lit(1)).alias("n")
    )
    outside = (
        selected.join(train.select(*of, "sample_id").distinct(), [*of, "sample_id"], "left_anti")
        .groupBy(*keys, "cycle")
        .agg(F.lit("not in train set").alias("violation"), F.count(F.lit(1)).alias("n"))
    )
    sizes = selected.filter("cycle > 0").groupBy(*keys, "cycle").agg(F.count(F.lit(1)).alias("n"))
    last = sizes.groupBy(*keys).agg(F.max("cycle").alias("__last"))
    wrong = (
        sizes.join(last, keys)
        .join(batch, keys)
        .filter((F.col("n") > F.col("batch_size"))
                | ((F.col("n") < F.col("batch_size")) & (F.col("cycle") < F.col("__last"))))
        .select(*keys, "cycle", F.lit("wrong batch size").alias("violation"), "n")
    )
    return repeated.unionByName(outside).unionByName(wrong)

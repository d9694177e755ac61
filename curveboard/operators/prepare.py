"""Dataset preparation: encoding, scaling, splits and start sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curveboard.functions.slices import framed, hash_position, position


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def _long(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    return df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("feature"), F.col(c).cast(kind).alias("v"))
                    for c in columns
                ]
            )
        ).alias("p")
    ).select("p.*")


def float_categoricals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Float columns whose distinct values are evenly spaced by a non-integer step.

    Values are evenly spaced when each lies on the lattice from the smallest to the
    largest value, so two aggregates decide it without sorting.
    """
    values = _long(df, columns, "double").filter("v is not null").distinct()
    stats = values.groupBy("feature").agg(
        F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("values")
    ).withColumn("step", F.try_divide(F.col("high") - F.col("low"), F.col("values") - 1))
    at = (F.col("v") - F.col("low")) / F.col("step")
    off = F.abs(at - F.round(at)) > 1e-6
    return (
        values.join(stats.filter("step > 0"), "feature")
        .groupBy("feature", "low", "step", "values")
        .agg(F.sum(off.cast("int")).alias("off"))
        .filter(F.abs(F.col("step") - F.round("step")) > 1e-9)
        .filter("off = 0")
        .select("feature", "low", "step", "values")
    )


def encode_float_categoricals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace evenly spaced float categoricals by codes 0.. in order of value."""
    found = float_categoricals(df, columns).agg(
        F.map_from_entries(
            F.collect_list(F.struct("feature", F.struct("low", "step").alias("s")))
        )
    )
    out = df.withColumn("__codes", found.scalar())
    for c in columns:
        spec = F.try_element_at("__codes", F.lit(c))
        code = F.round((F.col(c) - spec["low"]) / spec["step"]).cast("double")
        out = out.withColumn(c, F.when(spec.isNotNull(), code).otherwise(F.col(c)))
    return out.drop("__codes")


def category_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, v, code): codes of the sorted distinct values of each column."""
    values = _long(df, columns, "string").filter("v is not null").distinct()
    return position(values, ["feature"], F.substring("v", 1, 2), ["v"], "code")


def encode_categoricals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-numeric columns become category codes; a missing value becomes -1.

    Missing values are spread over keys that match nothing, so they do not meet in one task.
    """
    codes = category_codes(df, columns)
    spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*df.columns), F.lit(4096)).cast("string"))
    for c in columns:
        key = F.coalesce(F.col(c).cast("string"), spread)
        one = codes.filter(F.col("feature") == c).select(
            F.col("v").alias("__v"), F.col("code").cast("int").alias("__code")
        )
        df = (
            df.withColumn("__key", key)
            .join(one, F.col("__key") == F.col("__v"), "left")
            .withColumn(c, F.coalesce("__code", F.lit(-1)))
            .drop("__key", "__v", "__code")
        )
    return df


def fill_missing(df: DataFrame) -> DataFrame:
    return df.fillna(0)


def id_columns(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """Numeric columns that move by 1 per row on average: (feature, mean_step).

    ``order`` is the whole-numbered row position of the source file.
    """
    cells = df.select(
        F.col(order).alias("cycle"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                    for c in columns
                ]
            )
        ).alias("p"),
    ).select("cycle", "p.*")
    steps = framed(cells, ["feature"], chunk=65536)
    return (
        steps.groupBy("feature")
        .agg(
            F.try_divide(
                F.sum(F.coalesce(F.abs(F.col("value") - F.col("prev")), F.lit(0.0))),
                F.max("width") - 1,
            ).alias("mean_step")
        )
        .withColumn("is_id", F.col("mean_step") == 1.0)
    )


def scaled(samples: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Each feature to [0, 1] per dataset; a constant feature becomes 0.

    Robust scaling before min-max scaling is affine and cancels out.
    """
    keys = list(keys)
    vector = array_to_vector("features")
    ends = samples.groupBy(*keys).agg(
        vector_to_array(Summarizer.min(vector)).alias("__lo"),
        vector_to_array(Summarizer.max(vector)).alias("__hi"),
    )
    rows = samples.join(ends, keys)
    unit = F.transform(
        F.arrays_zip("features", "__lo", "__hi"),
        lambda x: F.when(
            x["__hi"] > x["__lo"], (x["features"] - x["__lo"]) / (x["__hi"] - x["__lo"])
        ).otherwise(F.lit(0.0)),
    )
    return rows.withColumn("features", unit).drop("__lo", "__hi")


def drop_rare_classes(samples: DataFrame, at_least: int = 2) -> DataFrame:
    """Drop samples whose class has fewer than ``at_least`` samples in its dataset."""
    common = (
        samples.groupBy("dataset", "label")
        .agg(F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") >= at_least)
    )
    return samples.join(common, ["dataset", "label"], "left_semi")


def stratified_splits(
    samples: DataFrame, buckets: int = 5, train_percent: int = 60, seed: int = 0
) -> DataFrame:
    """(dataset, bucket, label, part, sample_id): seeded random split of each class.

    Every class with two samples or more has at least one on each side.
    """
    rows = samples.select(
        "dataset",
        "label",
        "sample_id",
        F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"),
    )
    placed = hash_position(
        rows, ["dataset", "bucket", "label"], [F.lit(seed), "bucket"], ["sample_id"], "__at"
    )
    sizes = samples.groupBy("dataset", "label").agg(F.count(F.lit(1)).alias("__n"))
    cut = F.greatest(F.floor(F.col("__n") * train_percent / F.lit(100.0)), F.lit(1))
    return placed.join(sizes, ["dataset", "label"]).select(
        "dataset",
        "bucket",
        "label",
        F.when(F.col("__at") < cut, "train").otherwise("test").alias("part"),
        "sample_id",
    )


def start_sets(splits: DataFrame, sets: int = 10000, seed: int = 0) -> DataFrame:
    """Per split: ``sets`` start sets with one random train sample per class.

    Sets are drawn independently, so equal sets may occur. Long form:
    (dataset, bucket, start_point, label, sample_id).
    """
    train = splits.filter("part = 'train'")
    keys = ["dataset", "bucket", "label"]
    numbered = hash_position(
        train, keys, [F.lit(seed), F.lit("order")], ["sample_id"], "__at"
    ).select(*keys, "__at", "sample_id")
    sizes = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    digest = F.md5(
        F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys],
                    F.col("start_point").cast("string"))
    )
    draws = sizes.select(
        *keys, "__n", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("start_point")
    ).select(
        *keys,
        "start_point",
        F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.col("__n")).alias("__at"),
    )
    return draws.join(numbered, [*keys, "__at"]).select(
        "dataset", "bucket", "start_point", "label", "sample_id"
    )


def predefined_splits(table: DataFrame) -> DataFrame:
    """Split lists given with a dataset: (dataset, bucket, train, test) arrays to rows."""
    return table.select(
        "dataset",
        "bucket",
        F.explode(
            F.array(
                F.struct(F.lit("train").alias("part"), F.col("train").alias("ids")),
                F.struct(F.lit("test").alias("part"), F.col("test").alias("ids")),
            )
        ).alias("s"),
    ).select("dataset", "bucket", "s.part", F.posexplode("s.ids").alias("pos", "sample_id"))


def dataset_summary(samples: DataFrame) -> DataFrame:
    """Rows, columns and classes per dataset."""
    return samples.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(F.size("features")).alias("columns"),
        F.countDistinct("label").alias("classes"),
    )


def summary_extremes(summary: DataFrame) -> DataFrame:
    """Smallest and largest value of each summary column over all datasets."""
    cells = summary.unpivot(["dataset"], ["rows", "columns", "classes"], "what", "v")
    return cells.groupBy("what").agg(F.min("v").alias("lowest"), F.max("v").alias("highest"))


def load_split(
    samples: DataFrame, splits: DataFrame, starts: DataFrame, dataset, bucket: int, start_point: int
) -> DataFrame:
    """Samples of one split with their part and whether they are in the start set."""
    one = splits.filter((F.col("dataset") == F.lit(dataset)) & (F.col("bucket") == bucket)).select(
        "dataset", "sample_id", "part"
    )
    begin = starts.filter(
        (F.col("dataset") == F.lit(dataset))
        & (F.col("bucket") == bucket)
        & (F.col("start_point") == start_point)
    ).select("dataset", "sample_id", F.lit(True).alias("in_start"))
    return (
        samples.join(one, ["dataset", "sample_id"])
        .join(begin, ["dataset", "sample_id"], "left")
        .withColumn("in_start", F.coalesce("in_start", F.lit(False)))
    )

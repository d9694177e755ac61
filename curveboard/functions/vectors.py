"""Dense vectors held as array<double>."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """Vector of length 1; the zero vector stays zero (distance 1 to everything)."""
    size = norm(a)
    return F.transform(a, lambda x: F.when(size > 0, x / size).otherwise(F.lit(0.0)))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(unit(a), unit(b))


def with_unit(samples: DataFrame, features: str = "features", name: str = "unit") -> DataFrame:
    """Normalise once; every later distance is ``1 - dot``."""
    return samples.withColumn("__norm", norm(F.col(features))).withColumn(
        name,
        F.transform(
            features,
            lambda x: F.when(F.col("__norm") > 0, x / F.col("__norm")).otherwise(F.lit(0.0)),
        ),
    ).drop("__norm")


def vector_sum(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Element-wise sum and row count per key, combined on the map side."""
    total = Summarizer.sum(array_to_vector(F.col(column)))
    return df.groupBy(*keys).agg(
        vector_to_array(total).alias(name), F.count(F.lit(1)).alias(f"{name}_n")
    )

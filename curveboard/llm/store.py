"""Written tables that cut lineage, and gapless numbering without a single task."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curveboard.session import shared_folder


def stored(df: DataFrame) -> DataFrame:
    """Write to the shared folder of the cluster and read again.

    The files outlive executors; the owner of the shared folder clears them, as with checkpoints.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(df: DataFrame, group: list[str], order: list[str], name: str, slices: int) -> DataFrame:
    """Gapless ``name`` from 0 within each group; ``order`` names the columns that tell rows apart.

    A group is cut into ``slices`` by hash; rows are numbered inside (group, slice) and a small
    table of counts, at most groups x slices rows, carries the numbers across.
    """
    cut = df.withColumn("__slice", F.pmod(F.xxhash64(*order, F.lit(7)), F.lit(slices)).cast("int"))
    sizes = cut.groupBy(*group, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *group, "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    inside = Window.partitionBy(*group, "__slice").orderBy(*order)
    return (
        cut.withColumn("__at", F.row_number().over(inside) - 1)
        .join(offsets, [*group, "__slice"])
        .withColumn(name, F.col("__at") + F.col("__before"))
        .drop("__slice", "__at", "__before")
    )

"""Incremental ingestion of finished runs and live progress counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from curveboard.functions.slices import first_rows


def run_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 64
) -> DataFrame:
    """Finished runs as they arrive in a folder of Parquet files."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )


def first_per_run(
    stream: DataFrame, event_time: str | None = None, late: str = "1 day"
) -> DataFrame:
    """First row per run wins.

    With an event time the remembered ids age out behind a watermark, and a copy that comes later
    passes; ``write_new_runs`` knows these too. Without one all ids are kept, which is right for a
    stream that ends.
    """
    if event_time is None:
        return stream.dropDuplicates(["run_id"])
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["run_id"])


def write_runs(
    runs: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = (),
    available_now: bool = True,
) -> StreamingQuery:
    """Append to a Parquet table; file sink and checkpoint make each row land once."""
    writer = runs.writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", checkpoint
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="30 seconds"
    )
    return writer.start(path)


def append_new(
    batch: DataFrame, number: int, path: str, key: Sequence[str] = ("run_id",), buckets: int = 64
) -> None:
    """Append the rows of a batch whose key the table does not hold yet; one row per key.

    The table itself is the memory: it is cut into buckets by a hash of the key, and a batch reads the
    keys of earlier batches in its own buckets only. So nothing ages out, and a stream keeps no state
    for it. A batch writes a folder of its own, which a repeated batch replaces; it never looks at what
    it wrote before itself.
    """
    keys, spark = list(key), batch.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    order = [c for c in batch.columns if c not in keys]
    rows = first_rows(batch, keys, order).withColumn("bucket", bucket)
    known = _known_keys(spark, path, keys, number)
    if known is not None:
        # the list of buckets is at most ``buckets`` numbers; it prunes the folders that are read
        mine = [r[0] for r in rows.select("bucket").distinct().collect()]
        rows = rows.join(known.filter(F.col("bucket").isin(mine)), ["bucket", *keys], "left_anti")
    rows.select(*batch.columns, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")


def _known_keys(spark: SparkSession, path: str, keys: list[str], number: int) -> DataFrame | None:
    """(bucket, keys) of the batches before ``number``, None where there are none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(hadoop) or not [f for f in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/bucket=*"))]:
        return None
    return spark.read.parquet(path).filter(F.col("batch") < number).select("bucket", *keys)


def write_new_runs(
    runs: DataFrame, path: str, checkpoint: str, key: Sequence[str] = ("run_id",), buckets: int = 64,
    available_now: bool = True,
) -> StreamingQuery:
    """Keep the first row per key for ever, however late a copy arrives; see ``append_new``."""
    writer = runs.writeStream.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="30 seconds"
    )
    return writer.foreachBatch(
        lambda batch, number: append_new(batch, number, path, key, buckets)
    ).start()


def kept_runs(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``write_new_runs`` keeps."""
    return spark.read.parquet(path).drop("batch", "bucket")


def progress_counts(runs: DataFrame, by: Sequence[str] = ("dataset", "strategy")) -> DataFrame:
    """Runs in all and runs done per group; ``runs`` holds each run once (``first_per_run``)."""
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.when(F.col("status") == "done", 1).otherwise(0)).alias("done"),
    )


def write_progress(
    counts: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Keep the latest counts as a small Parquet table.

    Batches write two folders in turn, named after their number's parity, so a repeated batch
    replaces itself, a reader of the other folder is not disturbed, and nothing piles up.
    """

    def store(batch: DataFrame, number: int) -> None:
        numbered = batch.withColumn("batch", F.lit(number).cast("long"))
        numbered.write.mode("overwrite").parquet(f"{path}/turn={number % 2}")

    writer = counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="30 seconds"
    )
    return writer.foreachBatch(store).start()


def latest_progress(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    newest = rows.agg(F.max("batch"))
    return rows.filter(F.col("batch") == newest.scalar()).drop("batch", "turn")

"""Reading and writing result tables (CSV, xz-compressed CSV, Parquet)."""

from __future__ import annotations

import csv
import io
import lzma
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curveboard.functions.lists import parse_list

# Layout of a result tree, <strategy>/<dataset>/<metric>.csv.xz[.parquet]
METRIC_PATH = r"([^/]+)/([^/]+)/([^/]+?)\.(?:csv\.xz\.parquet|csv\.xz|csv|parquet)$"


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    columns: Sequence[str] | None = None,
    sep: str = ",",
) -> DataFrame:
    """Read a table by its suffix. CSV needs a schema or is read as strings."""
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
    elif path.endswith(".xz"):
        df = read_xz_rows(spark, path)
        if schema is None:
            raise ValueError("an xz-compressed CSV needs a schema")
        df = df.select(
            *[
                F.col("cells").getItem(f.name).try_cast(f.dataType).alias(f.name)
                for f in schema
            ]
        )
    else:
        reader = spark.read.option("header", True).option("sep", sep)
        df = (reader.schema(schema) if schema is not None else reader).csv(path)
    return df.select(*columns) if columns else df


def _xz_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    # rows of short files share a frame
    paths: list[str] = []
    rows: list[dict[str, str | None]] = []
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            with lzma.open(io.BytesIO(content), "rt", newline="") as text:
                for row in csv.DictReader(text):
                    paths.append(path)
                    rows.append({k: (v or None) for k, v in row.items() if k})
                    if len(rows) == 4096:
                        yield pd.DataFrame({"path": paths, "cells": rows})
                        paths, rows = [], []
    if rows:
        yield pd.DataFrame({"path": paths, "cells": rows})


def read_xz_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of xz-compressed CSV files as (path, map of cells).

    Spark's CSV reader has no xz codec. xz is not splittable, so one file is one
    task; rows stream out in batches. Convert once to Parquet for repeated use.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.xz")
        .load(path)
        .select("path", "content")
    )
    return decode_xz(files)


def decode_xz(files: DataFrame) -> DataFrame:
    """(path, content) of xz-compressed CSV files to (path, map of cells)."""
    return files.mapInPandas(_xz_rows, "path string, cells map<string,string>")


def discover_metric_files(spark: SparkSession, root: str, metric: str | None = None) -> DataFrame:
    """All metric files below ``root`` as (path, strategy, dataset, metric, bytes)."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{csv,xz,parquet}")
        .load(root)
        .select("path", F.col("length").alias("bytes"))
    )
    return parse_metric_paths(files, metric)


def parse_metric_paths(files: DataFrame, metric: str | None = None) -> DataFrame:
    """Strategy, dataset and metric from the path; run tables are no metric files."""
    named = files.select(
        "*",
        F.regexp_extract("path", METRIC_PATH, 1).alias("strategy"),
        F.regexp_extract("path", METRIC_PATH, 2).alias("dataset"),
        F.regexp_extract("path", METRIC_PATH, 3).alias("metric"),
    ).filter((F.col("metric") != "") & ~F.col("metric").rlike("_workloads?$"))
    return named.filter(F.col("metric") == metric) if metric else named


#: Formats of a metric in the order in which they are tried.
FORMATS = ("csv.xz", "csv", "parquet")
#: Files that Spark writes: strategy=<s>/dataset=<d>/metric=<m>/part-*.<format>
PART_PATH = r"strategy=([^/]+)/dataset=([^/]+)/metric=([^/]+)/[^/]+?\.(csv\.xz|csv|parquet)$"
NAMED_PATH = r"([^/=]+)/([^/=]+)/([^/=]+?)(?:\.csv\.xz)?\.(csv\.xz|csv|parquet)$"


def tree_places(files: DataFrame, path: str = "path") -> DataFrame:
    """Add strategy, dataset, metric and format by the path, for named files and for Spark's own parts."""
    column = F.col(path)
    spark_like = column.rlike(PART_PATH)
    part = [
        F.when(spark_like, F.regexp_extract(column, PART_PATH, i)).otherwise(F.regexp_extract(column, NAMED_PATH, i))
        for i in range(1, 5)
    ]
    placed = files.select("*", *[c.alias(n) for c, n in zip(part, ("strategy", "dataset", "metric", "format"))])
    return placed.filter((F.col("metric") != "") & ~F.col("metric").rlike("_workloads?$"))


def listed_tree(spark: SparkSession, root: str) -> DataFrame:
    """(strategy, dataset, metric, format, files, bytes) of a result tree, from Spark's file listing alone."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{csv,xz,parquet}")
        .load(root)
        .select("path", "length")
    )
    return tree_places(files).groupBy("strategy", "dataset", "metric", "format").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")
    )


def tree_rows(
    spark: SparkSession, root: str, schema: T.StructType, metric: str | None = None
) -> DataFrame:
    """Rows of all metrics of a result tree: strategy, dataset, metric and the columns of ``schema``.

    A metric that stands in several formats is read from the first of ``FORMATS`` only. The choice is
    a small table from the listing; each format is one scan, whose rows keep the place that the path
    of their file names. ``metric`` prunes the files that are read.
    """
    choice = listed_tree(spark, root)
    rank = F.array_position(F.array(*[F.lit(f) for f in FORMATS]), F.col("format"))
    best = choice.groupBy("strategy", "dataset", "metric").agg(F.min_by("format", rank).alias("format"))
    if metric is not None:
        best = best.filter(F.col("metric") == metric)

    def given(suffix: str):
        return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}")

    where = F.col("_metadata.file_path").alias("__path")
    names = [f.name for f in schema]
    csvs = given(".csv").schema(schema).option("header", True).csv(root).select(*names, where)
    tables = given(".parquet").schema(schema).parquet(root).select(*names, where)
    cells = read_xz_rows(spark, root).select(
        *[F.col("cells").getItem(f.name).try_cast(f.dataType).alias(f.name) for f in schema],
        F.col("path").alias("__path"),
    )
    rows = csvs.unionByName(tables).unionByName(cells)
    # a named Parquet file of a converted metric ends in .csv.xz.parquet and is a Parquet file
    placed = tree_places(rows, "__path").drop("__path")
    found = placed.join(best, ["strategy", "dataset", "metric", "format"])
    return found.select("strategy", "dataset", "metric", *names)


def metric_lookup(curves: DataFrame, strategy, dataset, metric) -> DataFrame:
    """One metric of one (strategy, dataset): a partition filter on the curve table."""
    return curves.filter(
        (F.col("strategy") == strategy)
        & (F.col("dataset") == dataset)
        & (F.col("metric") == metric)
    )


def strategy_dataset_pairs(files: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """Distinct (strategy, dataset); excluded names and names starting with 0 are no results."""
    pairs = files.select("strategy", "dataset").distinct()
    if excluded:
        pairs = pairs.filter(~F.col("strategy").isin(list(excluded)))
    return pairs.filter(~F.col("strategy").cast("string").startswith("0"))


def _probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.parquet as pq

    for batch in batches:
        errors = []
        for path, content in zip(batch["path"], batch["content"]):
            try:
                if path.endswith(".parquet"):
                    source = pq.ParquetFile(io.BytesIO(content))
                    for _ in source.iter_batches(batch_size=4096):
                        pass
                else:
                    opener = lzma.open if path.endswith(".xz") else io.BytesIO
                    raw = opener(io.BytesIO(content)) if opener is lzma.open else opener(content)
                    rows = csv.reader(io.TextIOWrapper(raw, "utf-8", newline=""))
                    width = len(next(rows))
                    for number, row in enumerate(rows, start=2):
                        if len(row) > width:
                            raise ValueError(f"line {number} has {len(row)} cells, not {width}")
                errors.append(None)
            except StopIteration:
                errors.append("EmptyFile: no header")
            except Exception as e:  # noqa: BLE001 - the error is the result
                errors.append(f"{type(e).__name__}: {e}")
        yield pd.DataFrame({"path": batch["path"], "error": errors})


def file_health(spark: SparkSession, root: str) -> DataFrame:
    """(path, error) per file: unreadable files carry the error, good ones null."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{csv,xz,parquet}")
        .load(root)
        .select("path", "content")
    )
    return probe_files(files)


def probe_files(files: DataFrame) -> DataFrame:
    """(path, content) to (path, error)."""
    return files.mapInPandas(_probe, "path string, error string")


def split_corrupt(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read CSV permissively; rows that do not parse keep their text in ``_corrupt``."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    return (
        spark.read.schema(full)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .csv(path)
    )


def wide_list_to_arrays(
    wide: DataFrame, id_columns: Sequence[str] = ("run_id",), element: str = "double"
) -> DataFrame:
    """Parse every non-id column from a list literal to a native array."""
    return wide.select(
        *id_columns,
        *[
            parse_list(F.col(f"`{c}`"), element).alias(c)
            for c in wide.columns
            if c not in id_columns
        ],
    )


def repair_list_columns(wide: DataFrame, id_columns: Sequence[str] = ("run_id",)) -> DataFrame:
    """Parse only the list columns that are still text; arrays stay as they are."""
    text = {f.name for f in wide.schema if isinstance(f.dataType, T.StringType)}
    return wide.select(
        *[
            parse_list(F.col(f"`{c}`"), "int").alias(c)
            if c in text and c not in id_columns
            else F.col(f"`{c}`")
            for c in wide.columns
        ]
    )


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
) -> None:
    """Write Parquet (zstd) or CSV (gzip); partitioned writes replace only what they hold."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    if fmt == "parquet":
        writer.option("compression", "zstd").parquet(path)
    elif fmt == "csv":
        writer.option("header", True).option("compression", "gzip").csv(path)
    else:
        raise ValueError(f"unknown format: {fmt}")


def append_rows(df: DataFrame, path: str) -> None:
    """Append rows to a Parquet table, creating it when missing."""
    df.write.mode("append").parquet(path)


def convert_to_parquet(
    spark: SparkSession, source: str, target: str, schema: T.StructType, sep: str = ","
) -> None:
    """One-off conversion of a CSV dataset, split or metric table."""
    write_table(read_table(spark, source, schema, sep=sep), target)

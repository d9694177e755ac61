"""Bounded samples of labelled texts for fitting a classifier."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, rows: int, seed: int = 5) -> pa.Table:
    """Texts and labels of at most ``rows`` labelled documents, chosen by a hash of the id.

    ``allowed`` is a condition on ``doc_id``. Rows without id, label or text are left out. The
    chosen ids are at most ``rows`` rows, so the join that fetches the texts broadcasts them; the
    texts reach the driver cut to nothing: whole texts of a bounded number of rows.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & allowed)
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
        .limit(rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    table = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y").toArrow()
    return table.take(pc.sort_indices(table, [("doc_id", "ascending")])).combine_chunks()


def crc_of(column: str) -> Column:
    """crc32 of an id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def string_blocks(table: pa.Table) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for batch in table.to_batches():
        yield batch, batch.column(batch.schema.get_field_index("text"))


def row_sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n) if len(rows) else np.zeros(n)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))

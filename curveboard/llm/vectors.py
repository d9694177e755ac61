"""Checks and shapes shared by the vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is not null, not empty, not zero, and finite in every component."""
    vector = F.col(column).cast("array<double>")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(F.col(column).isNotNull() & (F.size(column) > 0)).filter(
        fine & F.exists(vector, lambda x: x != 0)
    )


def matrix(array: pa.Array) -> np.ndarray:
    """Rows of a list array of equal lengths as a matrix of doubles."""
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(array), -1) if len(array) else np.zeros((0, 0))

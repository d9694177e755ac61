"""Column helpers for list-valued cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_list(cell: Column, element: str = "double") -> Column:
    """List literal -> array; a missing cell is empty and ``nan``/``None`` elements are null."""
    text = F.regexp_replace(F.coalesce(cell, F.lit("[]")), r"(?i)\b(nan|none)\b", "null")
    return F.from_json(text, f"array<{element}>")


def list_mean(cell: Column) -> Column:
    """Sum of the non-null elements over the full length; an empty list is null."""
    total = F.aggregate(
        cell, F.lit(0.0), lambda acc, x: acc + F.coalesce(x.cast("double"), F.lit(0.0))
    )
    return F.when(F.size(cell) > 0, total / F.size(cell))


def plain_mean(cell: Column) -> Column:
    """Mean of a list without nulls; null when empty or when an element is missing."""
    has_null = F.exists(cell, lambda x: x.isNull())
    return F.when(~has_null, list_mean(cell))


def list_median(cell: Column) -> Column:
    """Median of a list; null when empty or when an element is missing."""
    ordered = F.sort_array(cell)
    n = F.size(cell)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(n / 2).cast("int"))
    has_null = F.exists(cell, lambda x: x.isNull())
    return F.when((n > 0) & ~has_null, (low + high) / 2)


def round_list(cell: Column, digits: int = 4) -> Column:
    """Round every element half to even."""
    return F.transform(cell, lambda x: F.bround(x, digits))


def show_list(cell: Column) -> Column:
    """Comma-joined text of a list of whole numbers, for display."""
    return F.array_join(F.transform(cell, lambda x: x.cast("string")), ",")


def merge_cells(cell: Column, mode: str) -> Column:
    """How a list cell enters a report: as it is, as its mean or as its median."""
    if mode == "original":
        return cell
    if mode in ("original_mean", "mean_list"):
        return plain_mean(cell)
    if mode == "median_list":
        return list_median(cell)
    raise ValueError(f"unknown merge mode: {mode}")

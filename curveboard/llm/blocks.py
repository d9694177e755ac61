"""Arrow batches of text as byte blocks, and vectorised word hashing on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy pass handles; a longer document is a block of its own.
BLOCK_BYTES = 1 << 19
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of some megabytes, where the session still has the default of 64.

    A batch of whole texts stands in memory several times on either side of the socket.
    """
    if spark.conf.get(BATCH_KEY) in ("67108864", "67108864b", "64m", "64MB"):
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def mapped(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply a function from one Arrow batch to batches, inside the tasks."""

    small_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)

    return df.mapInArrow(run, schema)


def kept_rows(df: DataFrame, function: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """Rows for which a function of the Arrow batch is true, all columns as they are."""

    def run(batch):
        yield batch.filter(pa.array(function(batch)))

    return mapped(df, run, df.schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the n + 1 offsets of a string array; null counts as empty."""
    if not len(array):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)), offs.astype(np.int64)


def text_blocks(
    array: pa.Array, limit: int = BLOCK_BYTES, most: int = 1 << 14
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows in runs of about ``limit`` bytes and ``most`` rows: first row, row after, bytes, offsets."""
    data, offs = text_bytes(array)
    first, rows = 0, len(array)
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + limit, "right")) - 1)
        last = min(last, first + most)
        yield first, last, data[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (the finaliser of splitmix64)."""
    x = np.asarray(x, U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Uniform doubles in (0, 1) from 64-bit integers."""
    return ((mix(x) >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def classes(words: str = "") -> np.ndarray:
    """Class of each byte: 0 white space, 1 letter, digit or part of a longer character, 2 the rest."""
    table = np.full(256, 2, np.uint8)
    table[0x80:] = 1
    for c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_" + words.encode():
        table[c] = 1
    table[list(b" \t\n\r\x0b\x0c")] = 0
    return table


TOKENS = classes()
#: Words between white space, punctuation included.
SPACED = np.where(TOKENS == 0, 0, 1).astype(np.uint8)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def runs(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of one class other than 0; runs stay inside a row."""
    if not len(data):
        return (np.empty(0, np.int64),) * 3
    kind = table[data]
    edge = np.empty(len(data), bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    inner = offs[1:-1]
    edge[inner[inner < len(data)]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(data))
    keep = kind[starts] != 0
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(POWERS.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + 2)
        for name, base in (("up", BASE), ("down", INVERSE)):
            p = np.full(size, base, U)
            p[0] = 1
            POWERS[name] = np.multiply.accumulate(p)
    return POWERS["up"], POWERS["down"]


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte run, from one prefix sum over the block."""
    up, down = powers(len(data) + 1)
    total = np.empty(len(data) + 1, U)
    total[0] = 0
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])

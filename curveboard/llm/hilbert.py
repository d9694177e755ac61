"""Nearest neighbours from windows on several shifted Hilbert orderings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curveboard.llm.blocks import column, mapped
from curveboard.llm.store import stored
from curveboard.llm.vectors import matrix, usable

#: Rows of one ordering that a task compares with the queries whose windows touch them.
BLOCK_ROWS = 2048
#: Queries that one product takes.
QUERY_ROWS = 256
#: A window reaches max(LEAST, SCALE * rows ** GROWTH) rows to either side.
LEAST, SCALE, GROWTH = 64, 0.03, 0.87
#: Rows from which centre and scale of the projections are fitted.
FIT_ROWS = 4096


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of integer points (rows x dims, ``bits`` each) on the Hilbert curve, as integers.

    Walks the bit planes from the top: each plane's cell is rotated and reflected into the frame
    of the curve, and the Gray code of the frame gives the next digits of the key.
    """
    axes = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    dims = len(axes)
    for plane in range(bits - 1, 0, -1):
        bit, below = 1 << plane, (1 << plane) - 1
        for i in range(dims):
            up = (axes[i] & bit) != 0
            swap = np.where(up, 0, (axes[0] ^ axes[i]) & below)
            axes[0] = np.where(up, axes[0] ^ below, axes[0] ^ swap)
            if i:
                axes[i] = axes[i] ^ swap
    for i in range(1, dims):
        axes[i] = axes[i] ^ axes[i - 1]
    flip = np.zeros(len(cells), np.int64)
    for plane in range(bits - 1, 0, -1):
        flip ^= np.where((axes[-1] >> plane) & 1 == 1, (1 << plane) - 1, 0)
    key = np.zeros(len(cells), np.int64)
    for plane in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | (((axis ^ flip) >> plane) & 1)
    return key


def curves(sample: np.ndarray, orderings: int, dims: int, bits: int, seed: int) -> dict:
    """Random projections with a shift each, whose grid cells are put on Hilbert curves."""
    rng = np.random.default_rng(seed)
    width = sample.shape[1] if sample.size else 1
    dims = min(dims, width)
    center = sample.mean(axis=0) if sample.size else np.zeros(width)
    spread = np.sqrt(((sample - center) ** 2).sum(axis=1).mean() / width) if sample.size else 1.0
    return {
        "axes": [np.linalg.qr(rng.standard_normal((width, dims)))[0] for _ in range(orderings)],
        "shift": rng.random((orderings, dims)) - 0.5,
        "center": center,
        "spread": spread or 1.0,
        "bits": bits,
    }


def keys(vectors: np.ndarray, c: dict) -> np.ndarray:
    """Orderings x rows keys on the curves ``c``."""
    cells = 1 << c["bits"]
    out = []
    for axes, shift in zip(c["axes"], c["shift"], strict=True):
        y = (vectors - c["center"]) @ axes / (6 * c["spread"]) + 0.5 + 0.25 * shift
        out.append(hilbert_keys(np.clip((y * cells).astype(np.int64), 0, cells - 1), c["bits"]))
    return np.stack(out)


def ranked(vectors: DataFrame, shared) -> DataFrame:
    """(ordering, rank, row): every row's place on every curve, range-partitioned."""

    def run(batch):
        for o, key in enumerate(keys(matrix(column(batch, "vector")), shared.value)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(key), o, np.int32)), pa.array(key), column(batch, "row")],
                names=["ordering", "key", "row"],
            )

    keyed = mapped(vectors, run, "ordering int, key long, row long")
    by = ["ordering", "key", "row"]
    # ids of rows ascend within a sorted partition; they are fixed by writing them
    placed = stored(
        keyed.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id())
    )
    placed = placed.withColumn("part", F.shiftright("place", 33))
    sizes = placed.groupBy("ordering", "part").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("ordering").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("ordering", "part", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return placed.join(offsets, ["ordering", "part"]).select(
        "ordering", (F.col("before") + F.col("place") - F.col("start")).alias("rank"), "row"
    )


def window_half(rows: int, k: int) -> int:
    return max(2 * k, LEAST, int(np.ceil(SCALE * rows**GROWTH)))


def in_windows(classes: DataFrame, k: int, orderings: int, dims: int, bits: int, seed: int) -> DataFrame:
    """(row, vec_id, score): for each distinct vector that is asked for, the k nearest ids found.

    ``classes`` has row, vector, asked and ids (the k smallest ids of the vector, at most). Every
    ordering is cut into blocks of BLOCK_ROWS; a row stands in one block of each, and a query goes to
    the blocks that its window touches. Each block returns its k best for each query.
    """
    n = classes.count()
    fit = classes.orderBy(F.xxhash64("row", F.lit(seed)), "row").limit(FIT_ROWS).select("vector").toArrow()
    sample = matrix(fit["vector"].combine_chunks()) if fit.num_rows else np.zeros((0, 1))
    shared = classes.sparkSession.sparkContext.broadcast(curves(sample, orderings, dims, bits, seed))
    places, half = ranked(classes, shared), window_half(n, k)

    def block(rank: Column) -> Column:
        return F.floor(rank / BLOCK_ROWS)

    rank = F.col("rank")
    left = places.join(classes.select("row", "vector", "ids"), "row").withColumn("block", block(rank))
    touched = F.sequence(block(F.greatest(rank - half, F.lit(0))), block(F.least(rank + half, F.lit(max(n - 1, 0)))))
    right = places.join(classes.filter("asked").select("row", "vector"), "row").withColumn("block", F.explode(touched))

    def nearest(have: pa.Table, ask: pa.Table) -> pa.Table:
        ask = ask.rename_columns([c[2:] for c in ask.column_names])
        names, kinds = ["row", "vec_id", "score"], [pa.int64(), pa.int64(), pa.float64()]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if have.num_rows and ask.num_rows:
            have, ask = have.sort_by("rank").combine_chunks(), ask.sort_by("rank").combine_chunks()
            x, q = (matrix(t["vector"].combine_chunks()) for t in (have, ask))
            place, rows = have["rank"].to_numpy(), ask["row"].to_numpy()
            low = np.searchsorted(place, ask["rank"].to_numpy() - half)
            high = np.searchsorted(place, ask["rank"].to_numpy() + half, "right")
            lists = have["ids"].combine_chunks()
            ids, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            norms = (x * x).sum(axis=1)
            for first in range(0, len(q), QUERY_ROWS):
                own = slice(first, first + QUERY_ROWS)
                a, b = int(low[own].min()), int(high[own].max())
                size = (q[own] * q[own]).sum(axis=1)
                square = size[:, None] + norms[a:b] - 2 * (q[own] @ x[a:b].T)
                for i, row in enumerate(square, first):
                    row = row[low[i] - a : high[i] - a]
                    last = np.partition(row, k - 1)[k - 1] if len(row) > k else np.inf
                    # rounding of the product form is far below this margin
                    margin = 1e-9 * (1 + size[i - first] + norms[a:b].max(initial=0))
                    at = low[i] + np.flatnonzero(row <= last + margin)
                    score = np.sqrt(((x[at] - q[i]) ** 2).sum(axis=1))
                    found = np.concatenate([ids[ends[j] : ends[j + 1]] for j in at]) if len(at) else ids[:0]
                    score = np.repeat(score, ends[at + 1] - ends[at])
                    best = np.lexsort((found, score))[:k]
                    out.append((np.full(len(best), rows[i]), found[best], score[best]))
        arrays = [pa.array(np.concatenate(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.Table.from_arrays(arrays, names=names)

    by = ["ordering", "block"]
    # own names for the side of the queries, which stems from the same tables
    right = right.select(*[F.col(c).alias(f"q_{c}") for c in (*by, "rank", "row", "vector")])
    found = (
        left.select(*by, "rank", "vector", "ids")
        .groupBy(*by)
        .cogroup(right.groupBy(*[f"q_{c}" for c in by]))
        .applyInArrow(nearest, "row long, vec_id long, score double")
    )
    return found.groupBy("row", "vec_id").agg(F.min("score").alias("score"))


def search(vectors: DataFrame, is_query: Column, k: int = 10, orderings: int = 48, dims: int = 16, bits: int = 3,
           seed: int = 29) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query row.

    ``vectors`` has id and vector (an array of one length), an id once. Equal vectors are one row of
    the search with its k + 1 smallest ids, so copies neither fill windows nor gather in a block; a
    vector asked for by many ids is searched once. A row is a candidate of a query if it lies in its
    window on at least one ordering; candidates of all orderings are merged and reranked by exact
    Euclidean distance, ties to the smaller id.

    Windows grow somewhat slower than the rows, which keeps recall where vectors have little structure.
    """
    asked = F.coalesce(is_query, F.lit(False))
    rows = vectors.withColumn("asked", asked).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0).cast("float")))
    rows = stored(rows)
    # the limit by place is taken in each task before the exchange, so copies of one vector do not meet
    order = Window.partitionBy("vector").orderBy("id")
    least = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    least = least.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    wanted = rows.filter("asked").groupBy("vector").agg(F.lit(True).alias("asked"))
    classes = least.join(wanted, "vector", "left").select("vector", "ids", F.coalesce("asked", F.lit(False)).alias("asked"))
    classes = stored(classes.withColumn("row", F.monotonically_increasing_id()))
    found = in_windows(classes, k + 1, orderings, dims, bits, seed)
    best = Window.partitionBy("row").orderBy("score", "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k + 1)
    hits = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("hits"))
    queries = rows.filter("asked").select(F.col("id").alias("query_id"), "vector")
    queries = queries.join(classes.filter("asked").select("vector", "row"), "vector").join(hits, "row")
    others = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    return queries.select("query_id", F.posexplode(others).alias("at", "h")).select(
        "query_id", (F.col("at") + 1).alias("rank"), "h.vec_id", "h.score"
    )


def nearest_vectors(df: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """The k nearest rows of each query row of (vec_id, embedding).

    Rows whose vector is null, empty, zero or not finite take no part, neither do rows without id.
    Equal vectors are candidates of each other at distance 0. Repeated rows count once; of an id with
    several vectors the least by a hash counts. With fewer rows than k, all are returned; an empty
    table gives an empty one. ``is_query`` is a condition on ``id``. Other columns are ignored.
    """
    kind = df.schema["embedding"].dataType.simpleString()
    given = df.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"))
    if kind != "array<float>":
        given = given.withColumn("vector", F.col("vector").cast("array<double>"))
    fine = usable(given.filter("id is not null"), "vector")
    return search(fine.groupBy("id").agg(F.min_by("vector", F.xxhash64("vector")).alias("vector")), is_query, k)

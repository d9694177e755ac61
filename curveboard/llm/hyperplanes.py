"""Near-duplicate vectors by random-hyperplane sign hashing, exact cosines and components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curveboard.llm.blocks import U, column, mapped, mix
from curveboard.llm.graph import components
from curveboard.llm.store import stored
from curveboard.llm.vectors import matrix, usable

#: Rows of one side of a comparison inside a bucket.
BLOCK_ROWS = 1024


def planes(dims: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables, bits, dims))


def codes(vectors: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """Table x row sign codes; one matrix product per table."""
    powers = (U(1) << np.arange(normals.shape[1], dtype=U)).astype(U)
    return np.stack([((vectors @ n.T > 0) * powers).sum(axis=1, dtype=U) for n in normals])


def table_numbers(rows: int, threshold: float, miss: float = 0.001) -> tuple[int, int]:
    """Bits and tables for buckets of a few rows in which a pair at the threshold meets almost surely.

    Bits follow the logarithm of the rows, so a bucket of unrelated vectors stays small; tables
    are as many as leave a pair at the threshold unfound with probability ``miss``. Both follow
    one formula at every size; the work per row grows with a small power of the rows.
    """
    bits = max(8, math.ceil(math.log2(max(rows, 2))) + 2)
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-agree))


def pair_links(a: dict, b: dict, same: bool, threshold: float, table: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (i, j) of two blocks of one bucket, and whether no earlier table joins them."""
    cosine = a["unit"] @ b["unit"].T
    link = cosine >= threshold - 1e-9
    if same:
        link = np.triu(link, 1)
    i, j = np.nonzero(link)
    # decide values at the threshold on one fixed order of additions
    close = np.abs(cosine[i, j] - threshold) < 1e-6
    if close.any():
        exact = np.ones(len(i), bool)
        at = np.flatnonzero(close)
        exact[at] = [
            math.fsum(x * y for x, y in zip(a["unit"][p], b["unit"][q], strict=True)) >= threshold
            for p, q in zip(i[at], j[at], strict=True)
        ]
        i, j = i[exact], j[exact]
    first = ~(a["codes"][:table, i] == b["codes"][:table, j]).any(axis=0) if table else np.ones(len(i), bool)
    return np.stack((i, j)), first


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node of its component under links (i, j)."""
    low = np.arange(n)
    while len(i):
        least = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        np.minimum.at(new, low[i], least)
        np.minimum.at(new, low[j], least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    return low


def linked(vectors: DataFrame, normals: np.ndarray, threshold: float, blocks: DataFrame) -> DataFrame:
    """(id, n, root) rows: links found in one task, and edges that keep its components.

    ``vectors``: id, label, vector, copies; ``blocks``: bucket keys that hold several rows, with
    their number of blocks. A bucket of many rows is cut into blocks, and each pair of blocks is
    a task group of its own.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(normals)
    rows = hashed(vectors, shared, keep=True).join(blocks, "bucket")
    own = F.pmod(F.xxhash64("id", F.lit(5)), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1).cast("array<int>"))
    rows = rows.withColumn("own", own).withColumn("other", other)
    rows = rows.withColumn("low", F.least("own", "other")).withColumn("top", F.greatest("own", "other"))
    keys = ["bucket", "low", "top"]

    def group(ids, copies, unit, code, own, low, top, table):
        sides = [np.flatnonzero(own == low), np.flatnonzero(own == top)]
        a, b = ({"unit": unit[s], "codes": code[:, s]} for s in sides)
        (i, j), first = pair_links(a, b, low == top, threshold, table)
        i, j = sides[0][i], sides[1][j]
        n = np.bincount(i[first], weights=copies[j[first]], minlength=len(ids))
        n += np.bincount(j[first], weights=copies[i[first]], minlength=len(ids))
        return n.astype(np.int64), ids[forest(len(ids), i, j)]

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(part):
            t = pa.Table.from_batches(part)
            bucket, low, top = (t[k].to_numpy() for k in keys)
            ids, copies, own, table = (t[k].to_numpy() for k in ("id", "copies", "own", "table"))
            vector = matrix(t["vector"].combine_chunks())
            unit = vector / np.linalg.norm(vector, axis=1, keepdims=True)
            code = codes(vector, shared.value)
            edge = np.flatnonzero((bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (top[1:] != top[:-1])) + 1
            out = []
            for x, y in zip([0, *edge.tolist()], [*edge.tolist(), len(ids)], strict=True):
                s = slice(x, y)
                out.append(group(ids[s], copies[s], unit[s], code[:, s], own[s], low[x], top[x], table[x]))
            n, root = (np.concatenate(z) for z in zip(*out, strict=True))
            hit = (n > 0) | (root != ids)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids[hit]), pa.array(n[hit]), pa.array(root[hit])], names=["id", "n", "root"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, low, top = (column(batch, k).to_numpy() for k in keys)
            # everything up to the last change of group is complete
            change = (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (top[1:] != top[:-1])
            last = int(np.flatnonzero(change)[-1]) + 1 if change.any() else 0
            if held:
                end = held[-1]
                fresh = [column(end, k)[-1].as_py() != column(batch, k)[0].as_py() for k in keys]
                if any(fresh):
                    yield flush(held)
                    held = []
                elif last:
                    held.append(batch.slice(0, int(np.flatnonzero(change)[0]) + 1))
                    yield flush(held)
                    begin = int(np.flatnonzero(change)[0]) + 1
                    if last > begin:
                        yield flush([batch.slice(begin, last - begin)])
                    held = [batch.slice(last)]
                    continue
                else:
                    held.append(batch)
                    continue
            if last:
                yield flush([batch.slice(0, last)])
            held = [batch.slice(last)]
        if held:
            yield flush(held)

    ready = rows.select(*keys, "own", "id", "copies", "vector", "table")
    return ready.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "id long, n long, root long")


def hashed(vectors: DataFrame, shared, keep: bool) -> DataFrame:
    """One row per vector and table with its bucket, a hash of (label, table, code)."""

    def run(batch):
        vector = column(batch, "vector")
        code = codes(matrix(vector), shared.value)
        tables, rows = code.shape
        label = column(batch, "label").to_numpy(zero_copy_only=False).astype(np.int64).astype(U)
        table = np.arange(tables, dtype=U)[:, None]
        bucket = mix(mix(mix(code + U(1)) + table) + label).view(np.int64)
        names = ["id", "label", "vector", "copies"] if keep else []
        for t in range(tables):
            arrays = [column(batch, n) for n in names]
            arrays += [pa.array(bucket[t]), pa.array(np.full(rows, t, np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "bucket", "table"])

    schema = "id long, label long, vector array<float>, copies long, " if keep else ""
    return mapped(vectors, run, schema + "bucket long, table int")


def near_vectors(df: DataFrame, threshold: float = 0.93, seed: int = 23) -> DataFrame:
    """(vec_id, n_links, component_id, kept): vectors of one label linked by cosine >= threshold.

    Vectors that are null, empty, zero or not finite, and rows without label, link with nothing
    and are their own component. Equal vectors of a label link with each other; they are one row
    of the search, with a count of copies, so a large group of copies costs nothing there. All
    usable vectors must have one length. Rows that repeat a vec_id stay rows of their own, ordered
    by a hash of label and vector; ``kept`` marks one row of each component. Rows without vec_id
    are left out; other columns are ignored. Any pair at the threshold meets in a table with
    probability 0.999 or more, nearer pairs more surely; what is linked is verified in double
    precision.
    """
    given = df.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<float>").alias("vector"))
    given = given.filter("id is not null")
    if given.groupBy("id").count().filter("count > 1").isEmpty():
        return links_of_rows(given, threshold, seed)
    # numbers in the order of the ids stand for the rows; the last key spreads a row given often
    ordered = given.orderBy("id", F.xxhash64("label", "vector"), F.monotonically_increasing_id())
    rows = stored(ordered.select(F.monotonically_increasing_id().alias("row"), "*"))
    found = links_of_rows(rows.select(F.col("row").alias("id"), "label", "vector"), threshold, seed)
    own = rows.select("row", F.col("id").alias("own"))
    root = rows.select(F.col("row").alias("component_id"), F.col("id").alias("root"))
    found = found.withColumnRenamed("vec_id", "row").join(own, "row").join(root, "component_id")
    return found.select(F.col("own").alias("vec_id"), "n_links", F.col("root").alias("component_id"), "kept")


def links_of_rows(given: DataFrame, threshold: float, seed: int) -> DataFrame:
    """near_vectors of (id, label, vector) rows with an id of their own each."""
    # a negative zero equals zero
    fine = usable(given, "vector").filter("label is not null")
    fine = fine.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0).cast("float")))
    fine = stored(fine)
    classes = stored(
        fine.groupBy("label", "vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    ).select("id", "label", "vector", "copies")
    most = classes.groupBy("label").count().agg(F.max("count").alias("n"), F.lit(0)).first()["n"] or 0
    first = classes.select(F.size("vector").alias("d")).first()
    bits, tables = table_numbers(most, threshold)
    normals = planes(first["d"] if first else 1, bits, tables, seed)
    shared = given.sparkSession.sparkContext.broadcast(normals)
    blocks = (
        hashed(classes, shared, keep=False)
        .groupBy("bucket")
        .count()
        .filter("count > 1")
        .select("bucket", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("parts"))
    )
    found = stored(linked(classes, normals, threshold, blocks))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    edges = found.filter("root <> id").select(F.col("id").alias("a"), F.col("root").alias("b"))
    groups = components(edges).withColumnRenamed("component", "component_id")
    reps = classes.join(counts, "id", "left").join(groups, "id", "left")
    members = fine.join(
        reps.select(
            F.col("label"),
            F.col("vector"),
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component_id", "id").alias("component_id"),
        ),
        ["label", "vector"],
    ).select("id", "n_links", "component_id")
    out = given.select("id").join(members, "id", "left")
    return out.select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        (F.coalesce("component_id", "id") == F.col("id")).alias("kept"),
    )

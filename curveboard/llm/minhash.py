"""Near-duplicate documents by BagMinHash signatures, banding and exact multiset overlap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curveboard.llm.blocks import SPACED, U, column, mapped, mix, run_hashes, runs, small_batches, text_blocks, uniform
from curveboard.llm.graph import components
from curveboard.llm.store import stored

#: Words in a shingle.
WORDS = 5
REGISTERS = 64
ROWS = 4
#: Two texts are near when shared / total shingles, with multiplicity, is at least 4 / 5.
NEAR = (4, 5)
#: Different leaders a document is compared with for its 16 bands.
LEADERS = 4
#: Bytes of text of one side of a block comparison, and tokens of one matrix product.
BLOCK_TEXT, TOKEN_COLUMNS = 1 << 20, 4096
#: Rows of one side of such a block; a task holds their products.
BLOCK_ROWS = 2048


def shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every run of five words; a row of one to four words is one shingle."""
    starts, ends, rows = runs(data, offs, SPACED)
    word = run_hashes(data, starts, ends)
    n = np.bincount(rows, minlength=len(offs) - 1)
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    out_rows, out = [], []
    for size in range(1, WORDS + 1):
        if size < WORDS:
            at = first[n == size]
        else:
            at = np.flatnonzero(rows[: max(0, len(rows) - WORDS + 1)] == rows[WORDS - 1 :])
        if len(at):
            total = np.full(len(at), size, U)
            for k in range(size):
                total = mix(total + word[at + k])
            out_rows.append(rows[at])
            out.append(total)
    if not out:
        return np.empty(0, np.int64), np.empty(0, U)
    return np.concatenate(out_rows), np.concatenate(out)


def bags(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (row, hash) once, in that order, with its multiplicity."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    head = np.ones(len(rows), bool)
    head[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(head)
    return rows[at], hashes[at], np.diff(np.append(at, len(rows)))


def signatures(rows: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_rows: int) -> np.ndarray:
    """BagMinHash: registers x 64-bit values per row; 0 everywhere for a row without shingles.

    The weight axis is cut at 0, 1, 2, 4, 8, ...; each (element, interval) is a Poisson process
    whose rate is the interval's length, the same whatever bag it stands in. Every point has a
    place on the weight axis and counts for the bag if that is below the element's weight; it
    falls on one register, which keeps its earliest point. So two bags agree on a register with
    the probability of their weighted Jaccard similarity. Points are drawn up to a time at which
    all registers are filled almost surely, and further where one is still empty.
    """
    out = np.zeros(n_rows * REGISTERS, U)
    total = np.bincount(rows, weights=weights, minlength=n_rows)
    todo = total > 0
    limit = REGISTERS * (np.log(REGISTERS) + 3.0) / np.maximum(total, 1)
    while todo.any():
        own = todo[rows]
        r, w = rows[own], weights[own]
        levels = 1 + np.ceil(np.log2(w)).astype(np.int64)
        at = np.repeat(np.arange(len(r)), levels)
        level = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
        seed = mix(hashes[own][at] + level.astype(U) * U(0x9E3779B97F4A7C15))
        low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
        width = np.maximum(low, 1.0)
        row, weight, most = r[at], w[at].astype(np.float64), limit[r[at]]
        time = np.zeros(len(at))
        best = np.full(n_rows * REGISTERS, np.inf)
        slots, times, values = [], [], []
        step = 0
        while len(seed):
            seed = mix(seed + U(0xD1342543DE82EF95))
            time = time - np.log(uniform(seed)) / width
            on = time < most
            seed, time, low, width, row, weight, most = (x[on] for x in (seed, time, low, width, row, weight, most))
            value = mix(seed ^ U(0xA0761D6478BD642F))
            inside = low + width * uniform(value) < weight
            slot = row[inside] * REGISTERS + (value[inside] >> U(58)).astype(np.int64)
            slots.append(slot)
            times.append(time[inside])
            values.append(value[inside])
            step += 1
        slots, times, values = map(np.concatenate, (slots, times, values))
        np.minimum.at(best, slots, times)
        first = times == best[slots]
        full = np.isfinite(best).reshape(n_rows, REGISTERS).all(axis=1)
        done = first & full[slots // REGISTERS]
        out[slots[done]] = values[done]
        todo &= ~full
        limit = limit * 2
    return out.reshape(n_rows, REGISTERS)


def banded(signature: np.ndarray) -> np.ndarray:
    """Band keys: registers in groups of ROWS, hashed together with the number of the band."""
    bands = REGISTERS // ROWS
    keys = np.tile(np.arange(bands, dtype=U), (len(signature), 1))
    for k in range(ROWS):
        keys = mix(keys + signature[:, k::ROWS])
    return keys.astype(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, bands) of each document; both null where the text holds no word."""

    def run(batch):
        for first, last, data, offs in text_blocks(column(batch, "text")):
            rows, hashes, weights = bags(*shingles(data, offs))
            keys = banded(signatures(rows, hashes, weights, last - first))
            some = np.bincount(rows, minlength=last - first) > 0
            lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), keys.shape[1]).cast(pa.list_(pa.int64()))
            lists = lists.filter(pa.array(some)).take(pa.array(np.where(some, np.cumsum(some) - 1, 0), mask=~some))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id")[first:last], column(batch, "digest")[first:last], lists],
                names=["doc_id", "digest", "bands"],
            )

    plain = docs.select(F.col("doc_id").cast("long"), "text", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    out = mapped(plain, run, "doc_id long, digest binary, bands array<long>")
    return out.withColumn("digest", F.when(F.col("bands").isNotNull(), F.col("digest")))


def texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the wanted ids (one column doc_id), once per id.

    The join is a merge join at every size, so its cost stays in proportion to the texts.
    """
    wanted = ids.distinct().hint("merge")
    found = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"))


def compared(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b, shared, total): shingles that two documents share, and hold together."""
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id")))
    texts = stored(texts_of(wanted, docs))
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b"
    )

    def run(batch):
        n = batch.num_rows
        step = max(1, min(n, (2 << 20) * n // max(1, batch.nbytes)))
        for at in range(0, n, step):
            part = batch.slice(at, step)
            sides = []
            for name in ("text_a", "text_b"):
                found = [(np.empty(0, np.int64), np.empty(0, U))]
                for first, _, data, offs in text_blocks(column(part, name)):
                    rows, hashes = shingles(data, offs)
                    found.append((rows + first, hashes))
                sides.append(bags(*map(np.concatenate, zip(*found, strict=True))))
            (rows_a, hash_a, n_a), (rows_b, hash_b, n_b) = sides
            spread = U(0x9E3779B97F4A7C15)
            _, in_a, in_b = np.intersect1d(
                mix(hash_a + rows_a.astype(U) * spread),
                mix(hash_b + rows_b.astype(U) * spread),
                assume_unique=True,
                return_indices=True,
            )
            size = part.num_rows
            shared = np.bincount(rows_a[in_a], weights=np.minimum(n_a[in_a], n_b[in_b]), minlength=size)
            total = np.bincount(rows_a, weights=n_a, minlength=size) + np.bincount(rows_b, weights=n_b, minlength=size)
            yield pa.RecordBatch.from_arrays(
                [
                    column(part, "a"),
                    column(part, "b"),
                    pa.array(shared.astype(np.int64)),
                    pa.array((total - shared).astype(np.int64)),
                ],
                names=["a", "b", "shared", "total"],
            )

    return mapped(both, run, "a long, b long, shared long, total long")


def blockwise(members: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): components that a link joins, from all members of some buckets.

    ``members``: key, rep, own (component), loose. Members of one bucket are compared in blocks
    of bounded text and rows, by products of token incidence matrices; a pair counts where at least one
    side is loose and the components differ. A token is a shingle with its occurrence number, so
    that common tokens are the shared shingles with multiplicity. Blocks return components, not
    pairs.
    """
    texts = stored(texts_of(members.select(F.col("rep").alias("doc_id")), docs))
    rows = members.join(texts.withColumnRenamed("doc_id", "rep"), "rep")
    size = F.sum(F.octet_length("text"))
    needed = F.greatest(F.ceil(size / BLOCK_TEXT), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS))
    parts = stored(rows.groupBy("key").agg(needed.cast("int").alias("parts")))
    rows = rows.join(parts, "key")
    side = F.pmod(F.xxhash64("rep", F.lit(3)), F.col("parts")).cast("int")
    rows = rows.withColumn("side", side).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1).cast("array<int>"))
    )
    rows = rows.select(
        "key", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("top"),
        "side", "own", "loose", "text",
    )

    def links(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        own, side, loose = (table[c].to_numpy(zero_copy_only=False) for c in ("own", "side", "loose"))
        low, top = table["low"][0].as_py(), table["top"][0].as_py()
        found = [(np.empty(0, np.int64), np.empty(0, U))]
        for first, _, data, offs in text_blocks(table["text"].chunk(0)):
            rows, hashes = shingles(data, offs)
            found.append((rows + first, hashes))
        rows, hashes, n = bags(*map(np.concatenate, zip(*found, strict=True)))
        size = np.bincount(rows, weights=n, minlength=len(own))
        at = np.repeat(np.arange(len(n)), n)
        turn = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        rows = rows[at]
        _, token, count = np.unique(mix(hashes[at] + turn.astype(U)), return_inverse=True, return_counts=True)
        several = count > 1
        column_of = np.cumsum(several) - 1
        rows, token = rows[several[token]], column_of[token[several[token]]]
        order = np.argsort(token, kind="stable")
        rows, token = rows[order], token[order]
        a, b = np.flatnonzero(side == low), np.flatnonzero(side == top)
        shared = np.zeros((len(a), len(b)), np.float32)
        for begin in range(0, int(several.sum()), TOKEN_COLUMNS):
            x, y = np.searchsorted(token, (begin, begin + TOKEN_COLUMNS))
            hold = np.zeros((len(own), TOKEN_COLUMNS), np.float32)
            hold[rows[x:y], token[x:y] - begin] = 1
            shared += hold[a] @ hold[b].T
        total = size[a][:, None] + size[b] - shared
        hit = near(shared, total) & (own[a][:, None] != own[b]) & (loose[a][:, None] | loose[b])
        i, j = np.nonzero(hit)
        pairs = np.unique(np.stack((own[a][i], own[b][j]), axis=1), axis=0)
        return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    small_batches(docs.sparkSession)
    return rows.groupBy("key", "low", "top").applyInArrow(links, "a long, b long").distinct()


def near(shared, total):
    return shared * NEAR[1] >= total * NEAR[0]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id, kept): groups of documents linked by near copies.

    Two texts are linked when their bags of five-word shingles have a Jaccard similarity of 0.8
    or more; component_id is the smallest doc_id reachable, kept marks that document. Words stand
    between white space, as written. Null texts and texts without a word link with nothing. Rows
    that repeat a doc_id count as one document. Other columns are ignored.

    1. Equal texts become one class, represented by the smallest id.
    2. Representatives whose signatures agree in a band share a bucket. In each bucket they are
       compared with a leader only (one of LEADERS rules of choice per band), not with each other.
    3. Members of a bucket that are not connected to its leader afterwards (loose ones) are compared
       with the members of other components, in blocks. The Jaccard distance is a metric, so
       members whose distance to the leader differs from that of all loose ones by more than 0.2
       cannot be linked with these and are left out. So no link between two texts of one bucket
       is lost. A group of copies that are mostly below the similarity costs block products, in
       proportion to its loose members times its members.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    signs = stored(signed(given))
    classes = stored(
        signs.filter("digest is not null")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    )
    rows = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    order = F.xxhash64("rep", F.col("band") % LEADERS)
    leaders = (
        rows.groupBy("key")
        .agg(F.min(F.struct(order.alias("order"), "rep"))["rep"].alias("leader"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    members = stored(rows.join(leaders, "key").select("key", "rep", "leader"))
    pairs = stored(members.filter("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct())
    links = stored(compared(pairs, given))
    edges = links.filter(near(F.col("shared"), F.col("total"))).select("a", "b")
    found = stored(components(edges))

    def component(df: DataFrame, id_name: str, name: str) -> DataFrame:
        right = found.select(F.col("id").alias(id_name), F.col("component").alias(name))
        return df.join(right, id_name, "left").withColumn(name, F.coalesce(name, id_name))

    apart = 1 - F.col("shared") / F.col("total")
    placed = component(component(members, "rep", "own"), "leader", "main").join(
        links.select(F.col("a").alias("leader"), F.col("b").alias("rep"), apart.alias("far")), ["leader", "rep"], "left"
    )
    placed = stored(placed.withColumn("far", F.coalesce("far", F.lit(0.0))))
    loose = placed.filter("own <> main").groupBy("key").agg(F.min("far").alias("least"), F.max("far").alias("most"))
    # only buckets with loose members matter, and of these the members within reach of one
    rest = placed.join(loose, "key").filter("far between least - 0.2 - 1e-9 and most + 0.2 + 1e-9")
    rest = stored(rest.select("key", "rep", "own", (F.col("own") != F.col("main")).alias("loose")))
    if not rest.isEmpty():
        found = stored(components(edges.union(blockwise(rest, given))))
    reps = component(classes.select("digest", "rep"), "rep", "component_id")
    out = signs.select("doc_id", "digest").join(reps.select("digest", "component_id"), "digest", "left")
    # a repeated id with several texts belongs to the smallest component of them
    return (
        out.groupBy("doc_id")
        .agg(F.min(F.coalesce("component_id", "doc_id")).alias("component_id"))
        .select("doc_id", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    )

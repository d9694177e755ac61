"""Language by the nearest of several centroids of TF-IDF n-gram vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curveboard.llm.blocks import LOWER, TOKENS, column, mapped, text_blocks

#: Number of hashed n-gram dimensions.
DIMS = 4096
#: Bytes of text in one dense block of counts.
BLOCK = 1 << 19
#: Rows of it at most, as each takes DIMS counters.
ROWS = 512
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True


def counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows x DIMS counts of byte pairs, triples and quadruples of lower-cased words.

    Bytes that belong to no word act as one space; n-grams stay inside a row.
    """
    rows = len(offs) - 1
    if not len(data):
        return np.zeros((rows, DIMS), np.float32)
    plain = np.where(TOKENS[data] == 1, LOWER[data], 32).astype(np.uint32)
    row = np.repeat(np.arange(rows), np.diff(offs))
    keys = []
    for n in (2, 3, 4):
        m = len(plain) - n + 1
        if m <= 0:
            break
        code = plain[:m].copy()
        for k in range(1, n):
            code = (code << np.uint32(8)) | plain[k : k + m]
        inside = row[:m] == row[n - 1 :]
        inside &= code != np.uint32(0x20202020 >> (8 * (4 - n)))
        bucket = ((code + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - 12)
        keys.append((row[:m] * DIMS + bucket.astype(np.int64))[inside])
    if not keys:
        return np.zeros((rows, DIMS), np.float32)
    return np.bincount(np.concatenate(keys), minlength=rows * DIMS).reshape(rows, DIMS).astype(np.float32)


def weighted(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors with logarithmic term frequency; a row without n-grams is zero."""
    v = np.log1p(tf) * idf
    size = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(size > 0, size, 1)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows, and in how many each dimension occurs, over every row.

    Each batch sends one count per dimension, summed again before the shuffle.
    """

    def count(batch):
        total = np.zeros(DIMS + 1, np.int64)
        for first, last, data, offs in text_blocks(column(batch, "text"), BLOCK, ROWS):
            total[:DIMS] += (counts(data, offs) > 0).sum(axis=0)
            total[DIMS] += last - first
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(total)], names=["dim", "n"])

    sums = mapped(docs.select("text"), count, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n"))
    out = np.zeros(DIMS + 1, np.int64)
    for dim, n in sums.collect():  # DIMS + 1 rows, whatever the input
        out[dim] = n
    return int(out[DIMS]), out[:DIMS]


def cluster(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means: unit centroids, started from rows far from each other."""
    centers = [v[0]]
    for _ in range(1, min(k, len(v))):
        centers.append(v[int(np.argmin(np.max(v @ np.stack(centers).T, axis=1)))])
    c = np.stack(centers)
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        c = np.stack([v[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def sampled(docs: DataFrame, rows: int) -> DataFrame:
    """(doc_id, text, lang) of at most ``rows`` rows of each language, chosen by a hash of the id.

    Of a large language only rows of small hash pass, about four times as many as are wanted, so no
    other text is moved. The sizes of the languages, a number each, are one value of the plan.
    """
    span = 1 << 30
    sizes = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    size = F.element_at(sizes.agg(F.map_from_entries(F.collect_list(F.struct("lang", "n")))).scalar(), F.col("lang"))
    low = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(span)) < F.lit(4.0 * span * rows) / size
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id", F.xxhash64("text"))
    few = docs.select("doc_id", "text", "lang").filter(low)
    return few.withColumn("__place", F.row_number().over(order)).filter(F.col("__place") <= rows).drop("__place")


def centroids(docs: DataFrame, idf: np.ndarray, clusters: int) -> DataFrame:
    """(lang, centroids, far): unit centroids of each language, one after the other, from its rows' vectors.

    Tasks turn texts into vectors of one size; a language with bounded rows is a bounded group.
    """
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def vectors(batch):
        for first, last, data, offs in text_blocks(column(batch, "text"), BLOCK, ROWS):
            v = weighted(counts(data, offs), shared.value)
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "lang").slice(first, last - first),
                    column(batch, "doc_id").slice(first, last - first),
                    pa.array([row.tobytes() if row.any() else None for row in v], pa.binary()),
                ],
                names=["lang", "doc_id", "vector"],
            )

    def group(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("vector", "ascending")])
        v = np.stack([np.frombuffer(row, np.float32) for row in table["vector"].to_pylist()])
        c = cluster(v, clusters)
        # reject what is farther from its centroid than nearly all sampled rows of the language
        far = float(np.quantile((v @ c.T).max(axis=1), 0.005)) * 0.5
        return pa.table({"lang": table["lang"][:1], "centroids": pa.array([c.tobytes()], pa.binary()), "far": pa.array([far])})

    rows = mapped(docs, vectors, "lang string, doc_id long, vector binary").filter("vector is not null")
    return rows.groupBy("lang").applyInArrow(group, "lang string, centroids binary, far double")


def fit(docs: DataFrame, clusters: int, sample_rows: int) -> dict:
    """Inverse document frequencies over all given rows, centroids from a bounded sample of each language.

    Only centroids reach the driver, ``clusters`` a language.
    """
    n, df = document_frequencies(docs)
    idf = np.log((1.0 + n) / (1.0 + df)).astype(np.float32)
    found = sorted(centroids(sampled(docs, sample_rows), idf, clusters).collect(), key=lambda r: r["lang"])
    each = [np.frombuffer(r["centroids"], np.float32).reshape(-1, DIMS) for r in found]
    return {
        "idf": idf,
        "centroids": np.concatenate(each) if each else np.zeros((0, DIMS), np.float32),
        "names": [r["lang"] for r, c in zip(found, each, strict=True) for _ in c],
        "limit": min((r["far"] for r in found), default=0.0),
    }


def without_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows that hold no letter of any script."""
    total = np.concatenate(([0], np.cumsum(ASCII_LETTER[data])))
    none = total[offs[1:]] == total[offs[:-1]]
    for i in np.flatnonzero(none):
        none[i] = not any(c.isalpha() for c in bytes(data[offs[i] : offs[i + 1]]).decode("utf-8", "replace"))
    return none


def predicted(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of each row; score is the cosine to the nearest centroid.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned.
    ``rejected`` marks texts farther from every centroid than the model's limit.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batch):
        m = shared.value
        names = np.array([*m["names"], "und"], dtype=object)
        langs, scores = [], []
        for first, last, data, offs in text_blocks(column(batch, "text"), BLOCK, ROWS):
            near = weighted(counts(data, offs), m["idf"]) @ m["centroids"].T
            if near.shape[1]:
                best, value = near.argmax(axis=1), np.clip(near.max(axis=1), 0, 1)
            else:
                best, value = np.zeros(last - first, int), np.zeros(last - first)
            none = without_letter(data, offs) | (near.shape[1] == 0)
            langs.append(np.where(none, "und", names[best]))
            scores.append(np.where(none, 0.0, value.astype(np.float64)))
        score = np.concatenate(scores)
        yield pa.RecordBatch.from_arrays(
            [
                column(batch, "doc_id"),
                pa.array(np.concatenate(langs), pa.string()),
                pa.array(score),
                pa.array(score < m["limit"]),
            ],
            names=["doc_id", "lang_pred", "score", "rejected"],
        )

    plain = docs.select(F.col("doc_id").cast("long"), "text")
    return mapped(plain, predict, "doc_id long, lang_pred string, score double, rejected boolean")


def languages(docs: DataFrame, allowed: Column, clusters: int = 4, sample_rows: int = 1000) -> DataFrame:
    """Language of every whole text, learned from rows with a language that meet ``allowed``.

    Document frequencies cover all such rows; centroids come from at most ``sample_rows`` of each
    language; every language among them is learned. A text of any length counts whole. Ties go to the language that sorts first.
    Repeated rows are predicted each; an empty table gives an empty one; other columns are ignored.
    """
    learn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter(
        allowed & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
    )
    return predicted(docs, fit(learn, clusters, sample_rows))

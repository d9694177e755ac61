"""Quality by logistic regression on hashed word n-grams, fitted with follow-the-regularised-leader."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curveboard.llm.blocks import LOWER, TOKENS, U, column, kept_rows, mapped, mix, run_hashes, runs, text_blocks
from curveboard.llm.labelled import row_sums, sample, sigmoid, string_blocks

#: log2 of the number of weights.
BITS = 18
#: Feature values are SCALE x share of the document's n-grams.
SCALE = 8.0

UPPER_BYTE = np.zeros(256, bool)
UPPER_BYTE[65:91] = True
DIGIT_BYTE = np.zeros(256, bool)
DIGIT_BYTE[48:58] = True


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and weight index of every n-gram occurrence: words, pairs of words, triples of shapes.

    A token is a run of letters and digits, or of punctuation. A pair of equal words is one
    feature whatever the word. Shapes (lower, title, capitals, digits, the punctuation itself)
    let unseen words count.
    """
    starts, ends, rows = runs(data, offs, TOKENS)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word = run_hashes(LOWER[data], starts, ends)
    upper = np.concatenate(([0], np.cumsum(UPPER_BYTE[data])))
    digit = np.concatenate(([0], np.cumsum(DIGIT_BYTE[data])))
    n_upper, n_digit = upper[ends] - upper[starts], digit[ends] - digit[starts]
    length = ends - starts
    shape = np.ones(len(starts), U)
    shape[UPPER_BYTE[data[starts]]] = 2
    shape[(n_upper * 2 > length) & (length > 1)] = 3
    shape[n_digit > 0] = 4
    other = TOKENS[data[starts]] == 2
    shape[other] = word[other]
    same = rows[1:] == rows[:-1]
    pair = mix(word[:-1] * U(3) + word[1:])
    pair[word[:-1] == word[1:]] = U(77)
    three = same[1:] & same[:-1]
    shapes = mix(shape[:-2] * U(5) + shape[1:-1] * U(9) + shape[2:])
    all_rows = np.concatenate((rows, rows[1:][same], rows[2:][three]))
    hashes = np.concatenate((mix(word + U(1)), mix(pair[same] + U(2)), mix(shapes[three] + U(3))))
    return all_rows, (hashes >> U(64 - BITS)).astype(np.int64)


def fit(table: pa.Table, passes: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01):
    """Weights and bias by per-coordinate FTRL-proximal, one document at a time in a hashed order."""
    docs, y = [], []
    for batch, text in string_blocks(table):
        labels = batch.column(batch.schema.get_field_index("y")).to_numpy()
        for first, last, data, offs in text_blocks(text):
            rows, idx = features(data, offs)
            order = np.argsort(rows, kind="stable")
            rows, idx = rows[order], idx[order]
            cut = np.searchsorted(rows, np.arange(last - first + 1))
            for i in range(last - first):
                own, n = np.unique(idx[cut[i] : cut[i + 1]], return_counts=True)
                docs.append((own.astype(np.int32), (SCALE * n / max(1, n.sum())).astype(np.float32)))
                y.append(labels[first + i])
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    order = np.argsort(mix(np.arange(len(docs)).astype(U)))
    for _ in range(passes):
        for d in order:
            i, x = docs[d]
            i, x = np.append(i, size), np.append(x, 1.0)
            w = weights(i)
            g = (sigmoid(float(w @ x)) - y[d]) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(size + 1))
    return w[:size].astype(np.float32), float(w[size])


def text_scores(texts: pa.Array, w: np.ndarray, bias: float) -> np.ndarray:
    """One sparse dot product per text."""
    out = [np.empty(0)]
    for first, last, data, offs in text_blocks(texts):
        rows, idx = features(data, offs)
        n = np.bincount(rows, minlength=last - first)
        out.append(sigmoid(bias + SCALE * row_sums(w[idx], rows, last - first) / np.maximum(n, 1)))
    return np.concatenate(out)


def quality_scores(docs: DataFrame, labels: DataFrame, allowed: Column, sample_rows: int = 8000) -> DataFrame:
    """(doc_id, score): how likely each whole text is of quality 1.

    Fitted on at most ``sample_rows`` labelled rows that meet ``allowed``, scored on every row.
    Empty and null texts get the score of the bias alone; equal texts get equal scores; repeated
    rows are scored each. Without usable labels every score is 0.5. Other columns are ignored.
    """
    weights, bias = fit(sample(docs, labels, "quality", allowed, sample_rows))
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batch):
        scores = text_scores(column(batch, "text"), shared.value, bias)
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(scores)], names=["doc_id", "score"])

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), score, "doc_id long, score double")


def good_documents(
    docs: DataFrame, labels: DataFrame, allowed: Column, least: float = 0.3, sample_rows: int = 8000
) -> DataFrame:
    """The rows, whole, whose score is at least ``least``; scores as in quality_scores."""
    weights, bias = fit(sample(docs, labels, "quality", allowed, sample_rows))
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    return kept_rows(docs, lambda batch: text_scores(column(batch, "text"), shared.value, bias) >= least)

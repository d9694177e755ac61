"""Severity of toxicity by cumulative-link ordinal regression on sparse word features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curveboard.llm.blocks import LOWER, TOKENS, U, column, kept_rows, mapped, run_hashes, runs, text_blocks
from curveboard.llm.labelled import row_sums, sample, sigmoid, string_blocks

BITS = 20
#: Grades 0 (clean), 1 and 2; the labels give 0 against the rest.
GRADES = 3
#: Probability of a grade above 0 from which a text counts as toxic.
TOXIC = 0.5


def occurrences(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature index of every word occurrence; case is ignored."""
    starts, ends, rows = runs(data, offs, TOKENS)
    words = TOKENS[data[starts]] == 1
    starts, ends, rows = starts[words], ends[words], rows[words]
    return rows, (run_hashes(LOWER[data], starts, ends) >> U(64 - BITS)).astype(np.int64)


def presence(rows: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (row, feature) once, with its count."""
    key, n = np.unique((rows << BITS) | idx, return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), n


def fit(table: pa.Table, passes: int = 150, l1: float = 2e-4, rate: float = 0.5, least: int = 5):
    """Shared weights and ordered thresholds of P(grade > k) = sigmoid(w.x - threshold_k).

    The labels are binary, so the two toxic grades come from the data: words whose smoothed
    log-odds of standing in toxic texts exceed 2 mark toxicity, and a toxic text whose share of
    such words is at or above the median of toxic texts is grade 2. Weights are fitted by
    proximal AdaGrad with an L1 term on all sampled rows at once; words of fewer than ``least``
    sampled texts get none.
    """
    rows, idx, count, y, base = [], [], [], [], 0
    for batch, text in string_blocks(table):
        labels = batch.column(batch.schema.get_field_index("y")).to_numpy()
        for first, last, data, offs in text_blocks(text):
            r, i, n = presence(*occurrences(data, offs))
            rows.append((r + base).astype(np.int32))
            idx.append(i.astype(np.int32))
            count.append(n.astype(np.int32))
            y.append(labels[first:last])
            base += last - first
    weights = np.zeros(1 << BITS, np.float32)
    y = np.concatenate(y) if y else np.empty(0, np.int64)
    if not len(y) or y.min() == y.max():
        always = 10.0 if not len(y) or y.max() == 0 else -10.0
        return weights, np.array([always, always + 1.0])
    rows, idx, count = map(np.concatenate, (rows, idx, count))
    in_toxic = np.bincount(idx, weights=(y[rows] > 0), minlength=1 << BITS)
    in_all = np.bincount(idx, minlength=1 << BITS)
    n_toxic = float((y > 0).sum())
    odds = np.log((in_toxic + 0.5) / (n_toxic + 1)) - np.log((in_all - in_toxic + 0.5) / (len(y) - n_toxic + 1))
    marks = (odds > 2) & (in_toxic >= least)
    share = row_sums(count * marks[idx], rows, base) / np.maximum(row_sums(count, rows, base), 1)
    grade = (y > 0).astype(np.int64)
    grade[(y > 0) & (share >= np.median(share[y > 0]))] = GRADES - 1
    kept = in_all[idx] >= least
    rows, idx = rows[kept], idx[kept]
    used, idx = np.unique(idx, return_inverse=True)
    w, sum_w = np.zeros(len(used)), np.full(len(used), 1e-6)
    cuts, sum_cuts = np.array([1.0, 2.0]), np.full(GRADES - 1, 1e-6)
    for _ in range(passes):
        score = row_sums(w[idx], rows, base)
        top = sigmoid(score[:, None] - cuts)
        # likelihood of the own grade: difference of neighbouring cumulative probabilities
        upper = np.concatenate((np.ones((base, 1)), top), axis=1)[np.arange(base), grade]
        lower = np.concatenate((top, np.zeros((base, 1))), axis=1)[np.arange(base), grade]
        p = np.maximum(upper - lower, 1e-9)
        slope = top * (1 - top)
        up = np.where(grade > 0, slope[np.arange(base), np.maximum(grade - 1, 0)], 0.0)
        low = np.where(grade < GRADES - 1, slope[np.arange(base), np.minimum(grade, GRADES - 2)], 0.0)
        g_score = -(up - low) / p / base
        g_cuts = np.array(
            [
                ((np.where(grade == k + 1, up, 0) - np.where(grade == k, low, 0)) / p).sum() / base
                for k in range(GRADES - 1)
            ]
        )
        g = np.bincount(idx, weights=g_score[rows], minlength=len(used))
        sum_w += g * g
        sum_cuts += g_cuts * g_cuts
        step = rate / np.sqrt(sum_w)
        w -= step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        cuts = np.sort(cuts - rate / np.sqrt(sum_cuts) * g_cuts)
        cuts[1] = max(cuts[1], cuts[0] + 1e-3)
    weights[used] = w
    return weights, cuts


def exceeded(texts: pa.Array, where: np.ndarray, values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """P(grade > k) of each text, one column per threshold k; only words with a weight are looked at."""
    w = np.zeros(1 << BITS, np.float32)
    w[where] = values
    out = [np.empty((0, len(cuts)))]
    for first, last, data, offs in text_blocks(texts):
        rows, idx = occurrences(data, offs)
        hit = w[idx] != 0
        r, i, _ = presence(rows[hit], idx[hit])
        out.append(sigmoid(row_sums(w[i], r, last - first)[:, None] - cuts))
    return np.concatenate(out)


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000) -> DataFrame:
    """(doc_id, severity, p_toxic, grade, toxic) of every whole text.

    severity is the expected grade, p_toxic the probability of a grade above 0, grade the
    likeliest one, toxic says that p_toxic is 0.5 or more. Fitted on at most ``sample_rows`` labelled rows. Null and empty texts are clean unless the
    labels are toxic throughout; equal texts get equal values; repeated rows are scored each.
    Without usable labels nothing is toxic. Other columns are ignored.
    """
    weights, cuts = fit(sample(docs, labels, "toxic", F.lit(True), sample_rows))
    used = np.flatnonzero(weights)
    shared = docs.sparkSession.sparkContext.broadcast((used, weights[used]))

    def score(batch):
        above = exceeded(column(batch, "text"), *shared.value, cuts)
        p = np.concatenate((1 - above[:, :1], above[:, :-1] - above[:, 1:], above[:, -1:]), axis=1)
        arrays = [above.sum(axis=1), above[:, 0], p.argmax(axis=1).astype(np.int32), above[:, 0] >= TOXIC]
        names = ["doc_id", "severity", "p_toxic", "grade", "toxic"]
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *map(pa.array, arrays)], names=names)

    plain = docs.select(F.col("doc_id").cast("long"), "text")
    return mapped(plain, score, "doc_id long, severity double, p_toxic double, grade int, toxic boolean")


def clean_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000) -> DataFrame:
    """The rows, whole, that are not toxic; probabilities as in toxicity."""
    weights, cuts = fit(sample(docs, labels, "toxic", F.lit(True), sample_rows))
    used = np.flatnonzero(weights)
    shared = docs.sparkSession.sparkContext.broadcast((used, weights[used]))
    return kept_rows(docs, lambda batch: exceeded(column(batch, "text"), *shared.value, cuts)[:, 0] < TOXIC)

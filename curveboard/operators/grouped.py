"""Models of many datasets at once: K-means, linear classifiers and fold models as tables.

Samples are packed into blocks, a matrix per row of a table. A model is a row (dataset, state). A step
joins blocks with the state of their dataset, turns each block into sums, adds them up per task and then
per dataset, and derives the next state there. So one job per step serves all datasets, a large dataset
is many blocks, and no model passes through the driver.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from curveboard.operators.cells import written

#: Rows of a block, parts that sums of a dataset are added in first, and bytes of sums a task holds.
ROWS, PARTS, HELD = 2048, 32, 64 << 20


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as found:
        return dict(found)


def blocks(samples: DataFrame, rows: int = ROWS) -> DataFrame:
    """(dataset, ids, labels, x): bounded blocks of a dataset's samples, by a hash of the id.

    Samples without features are left out; a missing label is NaN.
    """
    kind = {f.name: f.dataType.simpleString() for f in samples.schema}
    given = samples.filter("features is not null").select(
        "dataset", "sample_id", F.col("features").cast("array<double>").alias("features"),
        F.coalesce(F.col("label").cast("double"), F.lit(float("nan"))).alias("label"),
    )
    sizes = given.groupBy("dataset").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("__parts"))
    part = F.pmod(F.xxhash64("sample_id"), F.col("__parts")).cast("int")
    cut = given.join(sizes, "dataset").withColumn("__part", part).drop("__parts")

    def matrix(table: pa.Table) -> pa.Table:
        table = table.sort_by("sample_id")
        flat = table["features"].combine_chunks().flatten().to_numpy()
        ids, labels = (pa.array([table[c].combine_chunks().to_pylist()]) for c in ("sample_id", "label"))
        columns = {"dataset": table["dataset"][:1], "ids": ids, "labels": labels, "x": pa.array([flat.tobytes()])}
        return pa.table(columns).cast(out)

    schema = f"dataset {kind['dataset']}, ids array<{kind['sample_id']}>, labels array<double>, x binary"
    fields = cut.sparkSession.createDataFrame([], schema).schema
    out = to_arrow_schema(fields)
    return written(cut.groupBy("dataset", "__part").applyInArrow(matrix, schema))


def block_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
    labels = np.array(row["labels"], float)
    return labels, np.frombuffer(row["x"]).reshape(len(labels), -1)


def each_block(cut: DataFrame, models: DataFrame, function: Callable, schema: str) -> DataFrame:
    """Rows that ``function(row, labels, x, state)`` yields for each block with its dataset's state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["state"] != last:
                    last, state = row["state"], unpack(row["state"])
                found = list(function(row, *block_of(row), state))
                if found:
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*found), out)]
                    yield pa.RecordBatch.from_arrays(columns, schema=out)

    out = to_arrow_schema(cut.sparkSession.createDataFrame([], schema).schema)
    return cut.join(models.select("dataset", "state"), "dataset").mapInArrow(run, schema)


def summed(cut: DataFrame, models: DataFrame, function: Callable) -> DataFrame:
    """(dataset, state, sums): ``function(row, labels, x, state)`` of all blocks of a dataset, added up."""
    kind = cut.schema["dataset"].dataType.simpleString()
    schema = f"dataset {kind}, part int, sums binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def flush():
            columns = [list(held), [0] * len(held), [v.tobytes() for v in held.values()]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

        last, state = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["state"] != last:
                    last, state = row["state"], unpack(row["state"])
                sums = function(row, *block_of(row), state)
                known = held.get(row["dataset"])
                held[row["dataset"]] = sums if known is None else known + sums
                if sum(v.nbytes for v in held.values()) > HELD:
                    yield flush()
        if held:
            yield flush()

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_py()) for v in table["sums"])
        return table.slice(0, 1).set_column(2, out.field("sums"), pa.array([total.tobytes()], pa.binary()))

    out = to_arrow_schema(cut.sparkSession.createDataFrame([], schema).schema)
    parts = cut.join(models.select("dataset", "state"), "dataset").mapInArrow(run, schema)
    parts = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)).cast("int"))
    for keys in (["dataset", "part"], ["dataset"]):
        parts = parts.groupBy(*keys).applyInArrow(add, schema)
    return parts.select("dataset", "sums").join(models.select("dataset", "state"), "dataset")


def updated(sums: DataFrame, function: Callable[[dict, np.ndarray], dict]) -> DataFrame:
    """The next (dataset, state), each from its dataset's state and sums; written."""
    schema = f"dataset {sums.schema['dataset'].dataType.simpleString()}, state binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                state = pack(**function(unpack(row["state"]), np.frombuffer(row["sums"])))
                columns = [pa.array([row["dataset"]], out.field(0).type), pa.array([state], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    out = to_arrow_schema(sums.sparkSession.createDataFrame([], schema).schema)
    return written(sums.select("dataset", "state", "sums").mapInArrow(run, schema))


def first_states(cut: DataFrame, **arrays: np.ndarray) -> DataFrame:
    """The same state for every dataset."""
    return cut.select("dataset").distinct().withColumn("state", F.lit(pack(**arrays)))


# --- K-means ---------------------------------------------------------------


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * x @ centres.T
    return np.maximum(d, 0.0)


def drawn(text: str) -> int:
    """A number below 2^32 from the leading digits of an MD5 digest."""
    return int(md5(text.encode()).hexdigest()[:8], 16)


def chosen_rows(cut: DataFrame, models: DataFrame, ks: DataFrame, per: int, seed: int) -> DataFrame:
    """Add ``per`` x k rows per dataset to its centres, drawn by their squared distance to these.

    A row's key is an exponential waiting time over its distance, so the smallest keys are a weighted
    draw without replacement; each block hands on as many as are wanted. Keys depend on seed and id.
    """
    kind = cut.schema["dataset"].dataType.simpleString()

    def keys(row, labels, x, state):
        weight = squares(x, state["centres"]).min(axis=1) if len(state["centres"]) else np.ones(len(x))
        luck = np.array([drawn(f"{seed}|{i}") for i in row["ids"]]) / 2.0**32
        key = np.where(weight > 1e-12, -np.log(np.maximum(luck, 1e-300)) / np.maximum(weight, 1e-300), np.inf)
        most = max(1, per * row["k"])
        for i in np.argsort(key, kind="stable")[:most]:
            if np.isfinite(key[i]):
                yield row["dataset"], row["k"], float(key[i]), x[i].tobytes()

    found = each_block(cut.join(ks, "dataset"), models, keys, f"dataset {kind}, k int, key double, x binary")
    order = W.partitionBy("dataset").orderBy("key", "x")
    best = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= F.greatest(F.lit(1), per * F.col("k")))
    lists = best.groupBy("dataset").agg(F.sort_array(F.collect_list(F.struct("key", "x"))).alias("rows"))
    return lists.select("dataset", F.col("rows.x").alias("more"))


def with_rows(models: DataFrame, more: DataFrame) -> DataFrame:
    schema = f"dataset {models.schema['dataset'].dataType.simpleString()}, state binary"

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                state = unpack(row["state"])
                new = [np.frombuffer(v) for v in row["more"] or ()]
                old = state["centres"]
                state["centres"] = np.concatenate([old, new]) if len(old) and new else (np.array(new) if new else old)
                columns = [pa.array([row["dataset"]], out.field(0).type), pa.array([pack(**state)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    out = to_arrow_schema(models.sparkSession.createDataFrame([], schema).schema)
    return written(models.join(more, "dataset", "left").mapInArrow(run, schema))


def lloyd_sums(row: dict, labels: np.ndarray, x: np.ndarray, state: dict) -> np.ndarray:
    """Sum, number and cost of the rows nearest to each centre, flat."""
    d = squares(x, state["centres"])
    own = d.argmin(axis=1)
    k = len(state["centres"])
    sums = np.zeros((k, x.shape[1] + 1))
    np.add.at(sums, own, np.column_stack((x, np.ones(len(x)))))
    return np.append(sums.ravel(), d[np.arange(len(x)), own].sum())


def moved(state: dict, sums: np.ndarray) -> dict:
    """Centres at the means of their rows; one without rows stays."""
    old = state["centres"]
    table = sums[:-1].reshape(len(old), -1)
    n = table[:, -1:]
    new = np.where(n > 0, table[:, :-1] / np.maximum(n, 1), old)
    return {**state, "centres": new, "shift": np.array(np.sqrt(((new - old) ** 2).sum(axis=1)).max(initial=0.0))}


def thinned(state: dict, sums: np.ndarray) -> dict:
    """k centres from weighted candidates: the farthest by weight first, then weighted Lloyd rounds."""
    x = state["centres"]
    weight = sums[:-1].reshape(len(x), -1)[:, -1]
    k = min(int(state["k"]), len(x))
    chosen = [int(weight.argmax())]
    near = squares(x, x[chosen]).min(axis=1)
    while len(chosen) < k:
        chosen.append(int((near * weight).argmax()))
        near = np.minimum(near, squares(x, x[chosen[-1:]])[:, 0])
    centres = x[chosen]
    for _ in range(10):
        own = squares(x, centres).argmin(axis=1)
        for c in range(k):
            mine = own == c
            if weight[mine].sum() > 0:
                centres[c] = np.average(x[mine], axis=0, weights=weight[mine])
    return {"centres": centres, "shift": np.array(np.inf)}


def kmeans(cut: DataFrame, ks: DataFrame, seed: int = 1, rounds: int = 20, tolerance: float = 1e-4) -> DataFrame:
    """(dataset, state): centres of every dataset, from blocks and (dataset, k).

    Seeding draws k rows twice over, weighted by their distance to what was drawn, and thins the
    candidates to k by their weights. Lloyd rounds go on until no centre of any dataset moves.
    """
    models = with_rows(first_states(cut, centres=np.zeros((0, 1))), chosen_rows(cut, first_states(cut, centres=np.zeros((0, 1))), ks, 0, seed))
    for turn in (1, 2):
        models = with_rows(models, chosen_rows(cut, models, ks, 2, seed + turn))
    sums = summed(cut, models, lloyd_sums).join(ks, "dataset")
    schema = f"dataset {cut.schema['dataset'].dataType.simpleString()}, state binary"

    def fit(batches):
        for batch in batches:
            for row in batch.to_pylist():
                state = thinned({**unpack(row["state"]), "k": row["k"]}, np.frombuffer(row["sums"]))
                columns = [pa.array([row["dataset"]], out.field(0).type), pa.array([pack(**state)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    out = to_arrow_schema(cut.sparkSession.createDataFrame([], schema).schema)
    return lloyd(cut, written(sums.mapInArrow(fit, schema)), rounds, tolerance)


def lloyd(cut: DataFrame, models: DataFrame, rounds: int = 20, tolerance: float = 1e-4) -> DataFrame:
    """Lloyd rounds from given centres; one job per round for all datasets."""
    for _ in range(rounds):
        models = updated(summed(cut, models, lloyd_sums), moved)
        shifts = each_state(models, lambda dataset, state: [(dataset, float(state["shift"]))], "shift double")
        if (shifts.agg(F.max("shift")).first()[0] or 0.0) <= tolerance:
            break
    return models


def each_state(models: DataFrame, function: Callable, fields: str) -> DataFrame:
    """Rows (dataset, fields) that ``function(dataset, state)`` returns for each model."""
    schema = f"dataset {models.schema['dataset'].dataType.simpleString()}, {fields}"

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                found = function(row["dataset"], unpack(row["state"]))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*found), out)]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    out = to_arrow_schema(models.sparkSession.createDataFrame([], schema).schema)
    return models.mapInArrow(run, schema)


def to_centres(cut: DataFrame, models: DataFrame) -> DataFrame:
    """(dataset, sample_id, centre, distance): the nearest centre of each sample."""
    kinds = {f.name: f.dataType for f in cut.schema}
    fields = f"dataset {kinds['dataset'].simpleString()}, sample_id {kinds['ids'].elementType.simpleString()}"

    def gaps(row, labels, x, state):
        d = squares(x, state["centres"])
        own = d.argmin(axis=1)
        # the difference form keeps small distances exact
        gap = np.sqrt(((x - state["centres"][own]) ** 2).sum(axis=1))
        return zip([row["dataset"]] * len(x), row["ids"], own.tolist(), gap.tolist())

    return each_block(cut, models, gaps, f"{fields}, centre int, distance double")


# --- linear classifiers ----------------------------------------------------


def classes_of(cut: DataFrame) -> DataFrame:
    """(dataset, state): the classes of each dataset, with mean and spread of its features."""

    def moments(row, labels, x, state):
        return np.concatenate(([len(x)], x.sum(axis=0), (x * x).sum(axis=0)))

    def scaled(state, sums):
        d = (len(sums) - 1) // 2
        n, mean = sums[0], sums[1 : d + 1] / sums[0]
        spread = np.sqrt(np.maximum(sums[d + 1 :] / n - mean * mean, 0.0))
        return {**state, "mean": mean, "spread": np.where(spread > 1e-12, spread, 1.0), "n": np.array(n)}

    labels = cut.select("dataset", F.explode("labels").alias("y")).filter(~F.isnan("y")).distinct()
    lists = labels.groupBy("dataset").agg(F.sort_array(F.collect_list("y")).alias("ys"))
    schema = f"dataset {cut.schema['dataset'].dataType.simpleString()}, state binary"

    def states(batches):
        for batch in batches:
            for row in batch.to_pylist():
                state = pack(classes=np.array(row["ys"] or [], float))
                columns = [pa.array([row["dataset"]], out.field(0).type), pa.array([state], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    out = to_arrow_schema(cut.sparkSession.createDataFrame([], schema).schema)
    names = cut.select("dataset").distinct().join(lists, "dataset", "left")
    return updated(summed(cut, written(names.mapInArrow(states, schema)), moments), scaled)


def design(x: np.ndarray, state: dict) -> np.ndarray:
    """Standardised features and a column of ones."""
    return np.column_stack(((x - state["mean"]) / state["spread"], np.ones(len(x))))


def hinge_sums(row: dict, labels: np.ndarray, x: np.ndarray, state: dict) -> np.ndarray:
    """Gradient and curvature of the squared hinge loss of each class against the rest."""
    a, out = design(x, state), []
    known = ~np.isnan(labels)
    for c, w in zip(state["classes"], state["w"]):
        y = np.where(labels == c, 1.0, -1.0)
        gap = np.where(known, 1.0 - y * (a @ w), 0.0)
        inside = gap > 0
        out += [-2 * (a[inside].T @ (y[inside] * gap[inside])), (2 * a[inside].T @ a[inside]).ravel()]
        out.append([(gap[inside] ** 2).sum()])
    return np.concatenate(out) if out else np.zeros(1)


def newton(state: dict, sums: np.ndarray) -> dict:
    """One Newton step for each class; the intercept is not penalised."""
    p, w = state["w"].shape[1], state["w"].copy()
    size = p + p * p + 1
    penalty = np.full(p, float(state["ridge"]))
    penalty[-1] = 1e-9
    moved_by = 0.0
    for c in range(len(w)):
        part = sums[c * size : (c + 1) * size]
        slope = part[:p] / state["n"] + penalty * w[c]
        curve = part[p:-1].reshape(p, p) / state["n"] + np.diag(penalty)
        step = np.linalg.solve(curve + 1e-10 * np.eye(p), slope)
        w[c] = w[c] - step
        moved_by = max(moved_by, float(np.abs(step).max()))
    return {**state, "w": w, "shift": np.array(moved_by)}


def linear_machines(cut: DataFrame, ridge: float = 0.01, rounds: int = 15, tolerance: float = 1e-6) -> DataFrame:
    """(dataset, state): one linear machine per class against the rest, for all datasets.

    Squared hinge loss with a ridge on standardised features, by Newton steps in the primal: one job
    per step, whose sums are a gradient and a curvature per (dataset, class).
    """

    def begin(dataset, state):
        w = np.zeros((len(state["classes"]), len(state["mean"]) + 1))
        return [(dataset, pack(**state, w=w, ridge=np.array(ridge)))]

    models = written(each_state(classes_of(cut), begin, "state binary"))
    for _ in range(rounds):
        models = updated(summed(cut, models, hinge_sums), newton)
        shifts = each_state(models, lambda dataset, state: [(dataset, float(state["shift"]))], "shift double")
        if (shifts.agg(F.max("shift")).first()[0] or 0.0) <= tolerance:
            break
    return models


def decision_gaps(cut: DataFrame, models: DataFrame) -> DataFrame:
    """(dataset, sample_id, value): the smallest absolute decision value over the classes."""
    kinds = {f.name: f.dataType for f in cut.schema}
    fields = f"dataset {kinds['dataset'].simpleString()}, sample_id {kinds['ids'].elementType.simpleString()}"

    def gaps(row, labels, x, state):
        values = np.abs(design(x, state) @ state["w"].T)
        least = values.min(axis=1) if values.shape[1] else np.zeros(len(x))
        return zip([row["dataset"]] * len(x), row["ids"], least.tolist())

    return each_block(cut, models, gaps, f"{fields}, value double")


# --- fold models -----------------------------------------------------------


def fold_of(ids: list, seeds: int, folds: int) -> np.ndarray:
    """Fold of each id under each seed."""
    return np.array([[drawn(f"{s}|{i}") % folds for s in range(seeds)] for i in ids]).reshape(len(ids), seeds)


def one_hot(labels: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Rows x classes of 0 and 1; a row without label is all 0."""
    return (labels[:, None] == classes).astype(float)


def fold_moments(seeds: int, folds: int) -> Callable:
    """Per seed and fold: sums and squares of the features by class, and the products of features."""

    def sums(row: dict, labels: np.ndarray, x: np.ndarray, state: dict) -> np.ndarray:
        a, y = design(x, state), one_hot(labels, state["classes"])
        fold, out = fold_of(row["ids"], seeds, folds), []
        for s in range(seeds):
            for f in range(folds):
                own = (fold[:, s] == f) & (y.sum(axis=1) > 0)
                out += [(y[own].T @ a[own]).ravel(), (y[own].T @ a[own] ** 2).ravel(), (a[own].T @ a[own]).ravel()]
        return np.concatenate(out)

    return sums


def from_moments(seeds: int, folds: int, ridge: float) -> Callable:
    """Models of every seed and fold from the total of the seed less the fold."""

    def fit(state: dict, sums: np.ndarray) -> dict:
        k, p = len(state["classes"]), len(state["mean"]) + 1
        table = sums.reshape(seeds, folds, 2 * k * p + p * p)
        table = table.sum(axis=1, keepdims=True) - table
        table = table.reshape(seeds * folds, -1)
        first = table[:, : k * p].reshape(-1, k, p)
        second = table[:, k * p : 2 * k * p].reshape(-1, k, p)
        gram = table[:, 2 * k * p :].reshape(-1, p, p)
        n = first[:, :, -1]
        safe = np.maximum(n, 1.0)[:, :, None]
        mean = first[:, :, :-1] / safe
        variance = np.maximum(second[:, :, :-1] / safe - mean**2, 0.0)
        total = np.maximum(n.sum(axis=1), 1.0)
        within = gram[:, :-1, :-1] - np.einsum("mk,mki,mkj->mij", n, mean, mean)
        within = within / total[:, None, None] + ridge * np.eye(p - 1)
        # half the products of features bound the curvature of the logistic loss for any weights
        bound = 0.5 * gram / total[:, None, None] + ridge * np.eye(p)
        prior = np.where(n > 0, np.log(np.maximum(n, 1.0) / total[:, None]), -np.inf)
        return {
            **state,
            "prior": prior,
            "means": mean,
            "variance": variance + 1e-9 * np.maximum(variance.max(initial=0.0), 1.0),
            "axes": np.linalg.solve(within, mean.transpose(0, 2, 1)).transpose(0, 2, 1),
            "inverse": np.linalg.inv(bound),
            "total": total,
            "w": np.zeros((seeds * folds, k, p)),
            "ridge": np.array(ridge),
        }

    return fit


def softmax(scores: np.ndarray) -> np.ndarray:
    top = scores.max(axis=-1, keepdims=True)
    e = np.exp(scores - np.where(np.isfinite(top), top, 0.0))
    return e / np.maximum(e.sum(axis=-1, keepdims=True), 1e-300)


def fold_gradients(seeds: int, folds: int) -> Callable:
    """Gradient of the logistic loss of every fold model over the rows outside its fold."""

    def sums(row: dict, labels: np.ndarray, x: np.ndarray, state: dict) -> np.ndarray:
        a, y = design(x, state), one_hot(labels, state["classes"])
        known, fold = y.sum(axis=1) > 0, fold_of(row["ids"], seeds, folds)
        out = []
        for m in range(seeds * folds):
            use = known & (fold[:, m // folds] != m % folds)
            out.append(((softmax(a[use] @ state["w"][m].T) - y[use]).T @ a[use]).ravel())
        return np.concatenate(out)

    return sums


def bounded_step(state: dict, sums: np.ndarray) -> dict:
    """A step along the bound's inverse; the loss of no fold model rises."""
    w = state["w"]
    slope = sums.reshape(w.shape) / state["total"][:, None, None] + state["ridge"] * w
    return {**state, "w": w - np.einsum("mij,mkj->mki", state["inverse"], slope)}


def fold_models(cut: DataFrame, seeds: int, folds: int, steps: int = 10, ridge: float = 0.01) -> DataFrame:
    """(dataset, state): Gaussian Bayes, linear discriminant and logistic models of all seeds and folds.

    The first two follow from one pass: a fold's model is the seed's total less the fold. The logistic
    models take one pass per step for all folds of all datasets.
    """
    models = updated(summed(cut, classes_of(cut), fold_moments(seeds, folds)), from_moments(seeds, folds, ridge))
    for _ in range(steps):
        models = updated(summed(cut, models, fold_gradients(seeds, folds)), bounded_step)
    return models


def held_out_certainty(cut: DataFrame, models: DataFrame, seeds: int, folds: int) -> DataFrame:
    """(dataset, sample_id, value): the largest class probability, summed over models that never saw the row."""
    kinds = {f.name: f.dataType for f in cut.schema}
    fields = f"dataset {kinds['dataset'].simpleString()}, sample_id {kinds['ids'].elementType.simpleString()}"

    def certainty(row, labels, x, state):
        a, fold, total = design(x, state), fold_of(row["ids"], seeds, folds), np.zeros(len(x))
        if len(state["classes"]):
            plain = a[:, :-1]
            for s in range(seeds):
                for f in range(folds):
                    own, m = np.flatnonzero(fold[:, s] == f), s * folds + f
                    if not len(own):
                        continue
                    b, mean, variance = plain[own], state["means"][m], state["variance"][m]
                    gap = ((b[:, None, :] - mean) ** 2 / variance + np.log(variance)).sum(axis=2)
                    line = b @ state["axes"][m].T - 0.5 * (state["axes"][m] * mean).sum(axis=1)
                    for scores in (state["prior"][m] - 0.5 * gap, state["prior"][m] + line, a[own] @ state["w"][m].T):
                        total[own] += softmax(scores).max(axis=1)
        return zip([row["dataset"]] * len(x), row["ids"], total.tolist())

    return each_block(cut, models, certainty, f"{fields}, value double")

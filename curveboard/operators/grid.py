"""Run grids: building, reconciling, filtering and validating run tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from curveboard.functions.slices import first_rows, hash_position, same_keys
from curveboard.schema import DENSE_CUTOFFS, DIMS, TRANSIENT_ERRORS


def grid(spark: SparkSession, values: dict[str, Sequence]) -> DataFrame:
    """Every combination of the listed values, generated row by row without a join."""
    out = spark.range(1).select()
    for name, options in values.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in options])))
    return out


def grid_of(tables: dict[str, DataFrame]) -> DataFrame:
    """Grid over the distinct values of one-column dimension tables.

    Each dimension is a list of enum codes, held once as an array; rows are generated
    from the first dimension on.
    """
    names = list(tables)
    out = tables[names[0]].distinct()
    for name in names[1:]:
        options = tables[name].distinct().agg(F.sort_array(F.collect_set(name)))
        out = out.withColumn(name, F.explode(options.scalar()))
    return out


def subtract(left: DataFrame, right: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``left`` without a match in ``right`` on all columns but the id."""
    keys = list(keys or [c for c in left.columns if c not in ("run_id", "error")])
    kept = left.drop("error").alias("l")
    gone = right.select(*keys).distinct().alias("r")
    return kept.join(gone, same_keys(keys), "left_anti")


def exclude_done_elsewhere(
    runs: DataFrame, others: Sequence[DataFrame], keys: Sequence[str] = DIMS
) -> DataFrame:
    """Drop grid rows that any other table already holds."""
    done = reduce(
        lambda a, b: a.unionByName(b), [o.select(*keys).distinct() for o in others]
    )
    return subtract(runs, done, keys)


def shuffle_and_number(
    runs: DataFrame, keys: Sequence[str], offset: int = 0, seed: int = 0
) -> DataFrame:
    """Random order, then ids from ``offset`` up; spread over slices, repeatable."""
    return hash_position(runs, [], [F.lit(seed)], keys, "run_id").withColumn(
        "run_id", F.col("run_id") + offset
    )


def refresh_grid(
    old: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    taken: Sequence[DataFrame] = (),
) -> DataFrame:
    """Keep known ids, give fresh ones to new combinations.

    Fresh ids start above every id in ``old`` and in the ``taken`` tables.
    """
    keys = list(keys)
    known = first_rows(old.select(*keys, "run_id"), keys, ["run_id"])
    merged = known.alias("l").join(
        new.select(*keys).distinct().alias("r"), same_keys(keys), "full_outer"
    )
    merged = merged.select(
        *[F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")).alias(k) for k in keys], "l.run_id"
    )
    last = reduce(
        lambda a, b: a.unionByName(b),
        [t.agg(F.max("run_id").alias("m")) for t in [old, *taken]],
    ).agg(F.coalesce(F.max("m"), F.lit(-1)))
    fresh = hash_position(
        merged.filter(F.col("run_id").isNull()).drop("run_id"), [], [], keys, "__at"
    ).withColumn("run_id", last.scalar() + 1 + F.col("__at"))
    return merged.filter(F.col("run_id").isNotNull()).unionByName(fresh.drop("__at"))


def retryable(failed: DataFrame, retry: bool = True) -> DataFrame:
    """Failures that stay final; transient ones are left out so that they stay open."""
    return failed.filter(~F.col("error").isin(TRANSIENT_ERRORS)) if retry else failed


def open_runs(
    runs: DataFrame,
    failed: DataFrame,
    done: DataFrame,
    oom: DataFrame,
    keys: Sequence[str] = DIMS,
    retry: bool = True,
) -> DataFrame:
    """What is left to run: grid minus failed, done and out-of-memory runs."""
    left = subtract(runs, retryable(failed, retry), keys)
    return subtract(subtract(left, done, keys), oom, keys)


def drop_binary_only(runs: DataFrame, samples: DataFrame, binary_only: Sequence) -> DataFrame:
    """Drop binary-only strategies on datasets with more than two labels."""
    multi = (
        samples.groupBy("dataset")
        .agg(F.countDistinct("label").alias("labels"))
        .filter("labels > 2")
        .select("dataset", F.explode(F.array(*[F.lit(s) for s in binary_only])).alias("strategy"))
    )
    return runs.join(multi, ["dataset", "strategy"], "left_anti")


def drop_incapable(
    runs: DataFrame, learners: DataFrame, needing_decision_function: Sequence
) -> DataFrame:
    """Drop (strategy that needs a decision function) x (learner without one).

    ``learners``: (learner, has_decision_function), one row per learner.
    """
    blocked = learners.filter(~F.col("has_decision_function")).select(
        "learner",
        F.explode(F.array(*[F.lit(s) for s in needing_decision_function])).alias("strategy"),
    )
    return runs.join(blocked, ["learner", "strategy"], "left_anti")


def drop_learners(runs: DataFrame, learners: Sequence) -> DataFrame:
    return runs.filter(~F.col("learner").isin(list(learners)))


def route_local(runs: DataFrame, local_only: Sequence) -> DataFrame:
    """Mark runs that may only run locally; write with ``partitionBy('route')``."""
    local = F.col("strategy").isin(list(local_only))
    return runs.withColumn("route", F.when(local, "local").otherwise("cluster"))


def run_hash(columns: Sequence[str]) -> Column:
    """First 16 hex digits of SHA-256 over the sorted ``column=value`` pairs."""
    pairs = [
        F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in sorted(columns)
    ]
    return F.substring(F.sha2(F.concat_ws("|", *pairs), 256), 1, 16)


def run_identity(columns: Sequence[str]) -> Column:
    """The identity as one comparable value, columns in sorted order."""
    return F.struct(*[F.col(c) for c in sorted(columns)])


def overlap_report(left: DataFrame, right: DataFrame, keys: Sequence[str] = DIMS) -> DataFrame:
    """How many ids and how many identities two run tables share."""
    ids = left.select("run_id").intersect(right.select("run_id"))
    same = left.select(*keys).intersect(right.select(*keys))
    return (
        ids.agg(F.lit("run_id").alias("what"), F.count(F.lit(1)).alias("shared"))
        .unionByName(same.agg(F.lit("identity").alias("what"), F.count(F.lit(1)).alias("shared")))
    )


def merge_runs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Concatenate two run tables; an id present in both raises when the job runs."""
    both = left.select("run_id").intersect(right.select("run_id")).agg(F.count(F.lit(1)))
    check = F.when(both.scalar() > 0, F.raise_error(F.lit("run_id overlap between run tables")))
    return left.unionByName(right, allowMissingColumns=True).filter(
        check.cast("string").isNull()
    )


def merge_results(
    primary: DataFrame, secondary: DataFrame, keys: Sequence[str] = ("run_id",)
) -> DataFrame:
    """Primary first: keep one row per key, the primary one where both have it."""
    primary = primary.drop("Unnamed: 0").withColumn("__source", F.lit(0))
    secondary = secondary.drop("Unnamed: 0").withColumn("__source", F.lit(1))
    both = primary.unionByName(secondary, allowMissingColumns=True)
    return first_rows(both, keys, ["__source"]).drop("__source")


def merge_shards(
    shards: DataFrame, shard_order: str, keys: Sequence[str] = ("run_id",)
) -> DataFrame:
    """Duplicate shards of one table: first shard wins per key."""
    return first_rows(shards, keys, [shard_order])


def check_schema(
    df: DataFrame, required: Sequence[str], identity: Sequence[str], strict: bool = False
) -> DataFrame:
    """Report rows (level, check, detail): missing columns, duplicate ids."""
    spark = df.sparkSession
    missing = sorted(set(required) - set(df.columns))
    lost = sorted(set(identity) - set(df.columns))
    found = [
        ("error", "required columns", ",".join(missing))
        if missing
        else ("info", "required columns", "present"),
        ("error" if strict else "warning", "identity columns", ",".join(lost))
        if lost
        else ("info", "identity columns", "present"),
    ]
    report = spark.createDataFrame(found, "level string, check string, detail string")
    if "run_id" not in df.columns:
        return report
    rows = df.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    counts = rows.agg(
        F.count(F.lit(1)).alias("ids"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra"),
    )
    return report.unionByName(
        counts.select(
            F.when(F.col("extra") > 0, "error").otherwise("info").alias("level"),
            F.lit("unique ids").alias("check"),
            F.concat_ws(
                " ",
                F.col("ids").cast("string"),
                F.lit("ids,"),
                F.col("extra").cast("string"),
                F.lit("duplicates"),
            ).alias("detail"),
        )
    )


def duplicate_ids(df: DataFrame) -> DataFrame:
    return df.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def missing_required_files(present: DataFrame, required: DataFrame, strict: bool = False):
    """Required or recommended file names that are absent, with their level.

    ``required``: (name, needed boolean); ``present``: (name).
    """
    level = F.when(F.col("needed") | F.lit(strict), "error").otherwise("warning")
    return required.join(present.select("name").distinct(), "name", "left_anti").select(
        level.alias("level"), "name"
    )


def orphan_ids(metric_rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Ids in metric rows that no run knows, with their number of rows."""
    counted = metric_rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(runs.select("run_id").distinct(), "run_id", "left_anti")


def duplicate_identities(runs: DataFrame, keys: Sequence[str] = DIMS) -> DataFrame:
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def shared_identities(
    left: DataFrame, right: DataFrame, keys: Sequence[str] = DIMS
) -> DataFrame:
    """Identities present in both tables, with their number of rows in each."""
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_left")).alias("l")
    b = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_right")).alias("r")
    return a.join(b, same_keys(keys)).select(*[f"l.{k}" for k in keys], "n_left", "n_right")


def prune_dense(
    runs: DataFrame,
    cutoffs: Sequence[tuple[str, int]] = DENSE_CUTOFFS,
    keys: Sequence[str] = DIMS,
) -> DataFrame:
    """Keep rows whose combination is complete along each parameter, one after another.

    Equal combinations merge first, so a group of a pass holds at most one entry per
    value of its parameter; a pass sees what the one before left.
    """
    keys = list(keys)
    combos = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    for parameter, cutoff in cutoffs:
        others = W.partitionBy(*[k for k in keys if k != parameter])
        combos = combos.withColumn("__size", F.sum("__n").over(others)).filter(
            F.col("__size") >= cutoff
        )
    return runs.alias("l").join(combos.select(*keys).alias("r"), same_keys(keys), "left_semi")


def combination_support(runs: DataFrame, parameter: str, keys: Sequence[str] = DIMS) -> DataFrame:
    """Histogram of group sizes over all parameters but one."""
    others = [k for k in keys if k != parameter]
    return (
        runs.groupBy(*others)
        .agg(F.count(F.lit(1)).alias("support"))
        .groupBy("support")
        .agg(F.count(F.lit(1)).alias("combinations"))
    )


def distinct_values(runs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(parameter, value) for each distinct value of the named columns."""
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("parameter"), F.col(c).cast("string").alias("value"))
                for c in columns
            ]
        )
    )
    distinct = runs.select(*columns).distinct()
    return distinct.select(pairs.alias("p")).select("p.*").distinct().orderBy("parameter", "value")


def as_run_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast a raw run table to the explicit schema, adding absent columns as null."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )

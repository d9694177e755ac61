"""Prediction-quality metrics per run and cycle.

Input: predictions (keys..., sample id, y_pred) joined to the true label. All metrics
come from confusion counts, which combine on the map side, so a class or a run that
holds most rows costs no more than others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MACRO = {"macro_precision": "precision", "macro_recall": "recall", "macro_f1": "f1"}
WEIGHTED = {"weighted_precision": "precision", "weighted_recall": "recall", "weighted_f1": "f1"}


def class_counts(
    predictions: DataFrame, keys: Sequence[str], truth: str = "label", guess: str = "y_pred"
) -> DataFrame:
    """True positives, predicted and actual counts per class present in truth or guess."""
    keys = list(keys)
    confusion = predictions.groupBy(*keys, truth, guess).agg(F.count(F.lit(1)).alias("c"))
    sides = confusion.select(
        *keys,
        "c",
        (F.col(truth) == F.col(guess)).alias("hit"),
        F.explode(
            F.array(
                F.struct(F.col(truth).cast("string").alias("class"), F.lit(True).alias("actual")),
                F.struct(F.col(guess).cast("string").alias("class"), F.lit(False).alias("actual")),
            )
        ).alias("s"),
    )
    return sides.groupBy(*keys, F.col("s.class").alias("class")).agg(
        F.sum(F.when(F.col("s.actual") & F.col("hit"), F.col("c")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("s.actual"), F.col("c")).otherwise(0)).alias("support"),
        F.sum(F.when(~F.col("s.actual"), F.col("c")).otherwise(0)).alias("predicted"),
    )


def class_scores(predictions: DataFrame, keys: Sequence[str], **names) -> DataFrame:
    """Precision, recall and F1 per class; an undefined value is 0."""
    zero = F.lit(0.0)
    return (
        class_counts(predictions, keys, **names)
        .withColumn("precision", F.coalesce(F.try_divide("tp", "predicted"), zero))
        .withColumn("recall", F.coalesce(F.try_divide("tp", "support"), zero))
        .withColumn(
            "f1",
            F.coalesce(
                F.try_divide(2.0 * F.col("tp"), F.col("predicted") + F.col("support")), zero
            ),
        )
    )


def accuracy(
    predictions: DataFrame, keys: Sequence[str], truth: str = "label", guess: str = "y_pred"
) -> DataFrame:
    hit = (F.col(truth) == F.col(guess)).cast("double")
    return predictions.groupBy(*keys).agg(F.avg(hit).alias("accuracy"))


def macro_scores(predictions: DataFrame, keys: Sequence[str], **names) -> DataFrame:
    """Unweighted mean over classes."""
    return class_scores(predictions, keys, **names).groupBy(*keys).agg(
        *[F.avg(c).alias(n) for n, c in MACRO.items()]
    )


def weighted_scores(predictions: DataFrame, keys: Sequence[str], **names) -> DataFrame:
    """Mean over classes weighted by the true support."""
    return class_scores(predictions, keys, **names).groupBy(*keys).agg(
        *[
            F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(n)
            for n, c in WEIGHTED.items()
        ]
    )


def standard_metrics(predictions: DataFrame, keys: Sequence[str], **names) -> DataFrame:
    """All seven standard metrics from one pass of confusion counts."""
    return class_scores(predictions, keys, **names).groupBy(*keys).agg(
        F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"),
        *[F.avg(c).alias(n) for n, c in MACRO.items()],
        *[
            F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(n)
            for n, c in WEIGHTED.items()
        ],
    )


def train_test_ratio(
    predictions: DataFrame,
    keys: Sequence[str],
    part: str = "part",
    truth: str = "label",
    guess: str = "y_pred",
) -> DataFrame:
    """Test accuracy over train accuracy; null without either part or at train accuracy 0."""
    hit = (F.col(truth) == F.col(guess)).cast("double")
    return (
        predictions.groupBy(*keys)
        .agg(
            F.avg(F.when(F.col(part) == "test", hit)).alias("test_accuracy"),
            F.avg(F.when(F.col(part) == "train", hit)).alias("train_accuracy"),
        )
        .withColumn("mismatch", F.try_divide("test_accuracy", "train_accuracy"))
    )


def selection_log(selected: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """One array of sample ids per cycle; a batch is what one cycle may select."""
    return selected.groupBy(*keys, "cycle").agg(
        F.sort_array(F.collect_list("sample_id")).alias("sample_ids")
    )


def time_totals(times: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Seconds per run over all cycles."""
    return times.groupBy(*keys).agg(F.sum("value").alias("seconds"))

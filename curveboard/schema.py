"""Table schemas and the few fixed value lists the operators need."""

from pyspark.sql import types as T

RUNS = T.StructType(
    [
        T.StructField("run_id", T.LongType(), False),
        T.StructField("dataset", T.IntegerType()),
        T.StructField("strategy", T.IntegerType()),
        T.StructField("learner", T.IntegerType()),
        T.StructField("batch", T.IntegerType()),
        T.StructField("start_point", T.IntegerType()),
        T.StructField("bucket", T.IntegerType()),
        T.StructField("seed", T.IntegerType()),
        T.StructField("num_queries", T.IntegerType()),
    ]
)

CURVE = T.StructType(
    [
        T.StructField("run_id", T.LongType(), False),
        T.StructField("metric", T.StringType()),
        T.StructField("cycle", T.IntegerType(), False),
        T.StructField("value", T.DoubleType()),
    ]
)

SELECTED = T.StructType(
    [
        T.StructField("run_id", T.LongType(), False),
        T.StructField("cycle", T.IntegerType(), False),
        T.StructField("sample_id", T.IntegerType(), False),
    ]
)

# The dimensions of a run, in the order used for keys and labels.
DIMS = ["dataset", "strategy", "learner", "batch", "start_point", "bucket"]

# Name prefixes of metrics that are already curve aggregates.
AGGREGATE_PREFIXES = [
    "ramp_up_auc_",
    "plateau_auc_",
    "final_value_",
    "first_5_",
    "last_5_",
    "learning_stability_5_",
    "learning_stability_10_",
    "full_auc_",
]

# Raw outputs that are no scalar curve.
NON_CURVE_PREFIXES = [
    "pickled_learner_model",
    "y_pred_train",
    "y_pred_test",
    "selected_indices",
]

# Standard metrics left out of the time-lag family.
TIME_LAG_EXCLUDED = [
    "macro_precision",
    "weighted_precision",
    "macro_recall",
    "weighted_recall",
]

# Failures that are worth a retry.
TRANSIENT_ERRORS = ["ConvergenceWarning", "OSError", "BrokenPipeError"]

# Fixed values: (parameter, smallest group that counts as complete), in pruning order.
DENSE_CUTOFFS = [
    ("start_point", 20),
    ("bucket", 5),
    ("batch", 6),
    ("learner", 3),
    ("strategy", 30),
    ("dataset", 92),
]

# Fixed value: per-cycle time limit in seconds.
QUERY_TIME_LIMIT = 300.0

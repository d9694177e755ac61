"""Queries for leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curveboard.operators import leaderboard as lb
from curveboard.plans.catalog import query
from curveboard.plans.testbed import Tables, sql


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def board_ctes(
    scores: str,
    by: tuple[str, ...] = (),
    interpolation: str = "zero",
    normalisation: str = "none",
    form: str = "percentages",
    prefix: str = "",
) -> str:
    """SQL of a leaderboard by brute force: padded rows, not sums. Ends in ``<prefix>board``."""
    p = prefix
    b = "".join(f"{c}, " for c in by)
    using = ", ".join([*by, "dataset", "strategy"])
    part = ", ".join([*by, "dataset"])
    pby = f"partition by {', '.join(by)}" if by else ""
    source = scores
    head = ""
    if normalisation == "robust":
        head = f"""{p}scaled as (
  select {b}dataset, strategy, (value - median(value) over (partition by {part})) /
    coalesce(nullif(quantile_cont(value, 0.75) over (partition by {part})
             - quantile_cont(value, 0.25) over (partition by {part}), 0), 1) as value
  from {scores}),
"""
        source = f"{p}scaled"
    join_by = " and ".join(f"a.{c} = z.{c}" for c in by) or "true"
    kept = {
        "remove": "where n = m",
    }.get(interpolation, "")
    pad = {
        "zero": f"select {using}, unnest(list_transform(range(m - n), lambda i: 0.0)) as value"
        f" from {p}cells where m > n",
        "average_of_same_strategy": f"select {using}, unnest(list_transform(range(m - n),"
        f" lambda i: mean)) as value from {p}cells where m > n and n > 0",
    }.get(interpolation)
    norm = (
        f"""(value - min(value) over (partition by {part})) /
    coalesce(nullif(max(value) over (partition by {part})
      - min(value) over (partition by {part}), 0), 1)"""
        if normalisation == "minmax"
        else "value"
    )
    score = {
        "percentages": "score",
        "counts": "cast(n as double)",
        "ranks": f"""cast(case when score is not null then count(score) over (partition by {part}
    order by score range between unbounded preceding and current row) end as double)""",
        "inverted_ranks": f"""cast(case when score is not null then rank() over
    (partition by {part} order by score desc nulls last) end as double)""",
    }[form]
    return f"""{head}{p}cells as (
  select g.*, coalesce(n, 0) as n, mean, max(coalesce(n, 0)) over ({pby}) as m from (
    select distinct {", ".join("a." + c for c in [*by, "dataset"])}, z.strategy
    from {source} a join {source} z on {join_by}) g
  left join (select {using}, count(value) as n, avg(value) as mean
             from {source} group by {using}) c using ({using})),
{p}padded as (
  select s.* from (select {using}, value from {source}) s join {p}cells using ({using}) {kept}
  {"union all " + pad if pad else ""}),
{p}means as (
  select {using}, avg(v) as score from (select *, {norm} as v from {p}padded) group by {using}),
{p}board as (
  select {using}, {score} as score from {p}cells left join {p}means using ({using}))"""


def _board_sql(name: str, *tables: str, extra: str = "", **options) -> str:
    ctes = (extra + ",\n" if extra else "") + board_ctes(name, **options)
    return sql(
        "select dataset, strategy, round(score, 6) as score from board", *tables, extra=ctes
    )


# the run table as scores: one value per run on a 25 x 5 board of uneven cells
VALUES = "scores as (select * exclude (value), value / 997 as value from runs)"
# a board with empty cells: one strategy has no value on some datasets
HOLES = """scores as (select * exclude (value), case when not (dataset % 5 = 0
  and strategy = '1-URGENT') then value / 997 end as value from runs)"""


def _scores(t: Tables) -> DataFrame:
    return t.runs.withColumn("value", F.col("value") / 997)


def _holes(t: Tables) -> DataFrame:
    known = F.expr("not (dataset % 5 = 0 and strategy = '1-URGENT')")
    return _scores(t).withColumn("value", F.when(known, F.col("value")))


@query(
    "flagship_leaderboard",
    sql(
        "select strategy, round(avg(score), 6) as total from board group by strategy",
        "full_mean",
        extra=board_ctes("full_mean", interpolation="zero", form="inverted_ranks"),
    ),
)
def _(t: Tables):
    """Mean curve per run, zero interpolation, best-first ranks, mean over datasets."""
    ranked = lb.board(t.full_mean, interpolation="zero", form="inverted_ranks")
    return lb.totals(ranked)


@query(
    "L1_fingerprints",
    sql(
        """select run_id, dataset || '_' || strategy || '_' || learner || '_' || batch || '_' ||
  start_point || '_' || bucket as fingerprint from runs""",
        "runs",
    ),
)
def _(t: Tables):
    from curveboard.operators.series import fingerprint

    return t.runs.select("run_id", fingerprint().alias("fingerprint"))


@query(
    "L2_shared_fingerprints",
    sql(
        """select batch, learner from runs group by batch, learner
having count(distinct (dataset, strategy)) =
  (select count(distinct (dataset, strategy)) from runs)""",
        "runs",
    ),
)
def _(t: Tables):
    return lb.shared_fingerprints(t.runs, ["batch", "learner"])


@query(
    "L2_most_fingerprints",
    sql(
        """select max(n) as pad_to from (select count(distinct (batch, learner, bucket)) as n
from runs group by dataset, strategy)""",
        "runs",
    ),
)
def _(t: Tables):
    return lb.most_fingerprints(t.runs, ["batch", "learner", "bucket"])


SHARED = """dense as (select * from scores where (batch, learner) in (
  select (batch, learner) from runs group by batch, learner
  having count(distinct (dataset, strategy)) =
    (select count(distinct (dataset, strategy)) from runs)))"""


@query(
    "L3_dense_scores",
    sql("select run_id, round(value, 6) as value from dense", "runs", extra=VALUES + ",\n" + SHARED),
)
def _(t: Tables):
    return lb.dense_scores(_scores(t), ["batch", "learner"]).select("run_id", "value")


@query(
    "L4_cells",
    sql(
        """select d.dataset, d.strategy, round(s, 6) as s, coalesce(n, 0) as n,
  round(lo, 6) as lo, round(hi, 6) as hi
from (select * from (select distinct dataset from scores), (select distinct strategy from scores)) d
left join (select dataset, strategy, sum(value) as s, count(value) as n, min(value) as lo,
  max(value) as hi from scores group by 1, 2) c using (dataset, strategy)""",
        "runs",
        extra=HOLES,
    ),
)
def _(t: Tables):
    return lb.cells_of(_holes(t))


@query(
    "L4_matrix",
    sql(
        "select dataset, "
        + ", ".join(
            f"""round(max(score) filter (where strategy = '{s}'), 6) as "{s}\""""
            for s in PRIORITIES
        )
        + " from board group by dataset",
        "runs",
        extra=HOLES + ",\n" + board_ctes("scores", interpolation="none"),
    ),
)
def _(t: Tables):
    return lb.matrix(lb.board(_holes(t), interpolation="none"), PRIORITIES)


for _id, _rule in (
    ("L5", "none"),
    ("L6", "remove"),
    ("L7", "zero"),
    ("L8", "average_of_same_strategy"),
):

    def _interpolated(t: Tables, rule=_rule):
        return lb.board(_holes(t), interpolation=rule)

    query(
        f"{_id}_interpolation_{_rule}",
        _board_sql("scores", "runs", extra=HOLES, interpolation=_rule),
    )(_interpolated)


@query("L9_counts", _board_sql("scores", "runs", extra=HOLES, form="counts"))
def _(t: Tables):
    return lb.board(_holes(t), form="counts")


@query(
    "L9_dense_counts",
    _board_sql("dense", "runs", extra=VALUES + ",\n" + SHARED, form="counts"),
)
def _(t: Tables):
    return lb.board(lb.dense_scores(_scores(t), ["batch", "learner"]), form="counts")


@query(
    "L10_percentages",
    _board_sql("dense", "runs", extra=VALUES + ",\n" + SHARED, interpolation="none"),
)
def _(t: Tables):
    return lb.board(lb.dense_scores(_scores(t), ["batch", "learner"]), interpolation="none")


for _rule in ("none", "remove", "zero", "average_of_same_strategy"):

    def _minmax(t: Tables, rule=_rule):
        return lb.board(_holes(t), interpolation=rule, normalisation="minmax")

    query(
        f"L11_minmax_{_rule}",
        _board_sql(
            "scores", "runs", extra=HOLES, interpolation=_rule, normalisation="minmax"
        ),
    )(_minmax)


@query(
    "L12_robust_scaling",
    _board_sql(
        "scores",
        "runs",
        extra=HOLES,
        interpolation="average_of_same_strategy",
        normalisation="robust",
    ),
)
def _(t: Tables):
    return lb.board(
        _holes(t), interpolation="average_of_same_strategy", normalisation="robust"
    )


@query("L13_ranks", _board_sql("scores", "runs", extra=HOLES, interpolation="none", form="ranks"))
def _(t: Tables):
    return lb.board(_holes(t), interpolation="none", form="ranks")


@query(
    "L14_inverted_ranks",
    _board_sql("scores", "runs", extra=HOLES, interpolation="none", form="inverted_ranks"),
)
def _(t: Tables):
    return lb.board(_holes(t), interpolation="none", form="inverted_ranks")


@query(
    "L15_total_row",
    sql(
        """select cast(dataset as varchar) as dataset, strategy, round(score, 6) as score from board
union all select 'Total', strategy, round(avg(score), 6) from board group by strategy""",
        "runs",
        extra=HOLES + ",\n" + board_ctes("scores", interpolation="zero", form="ranks"),
    ),
)
def _(t: Tables):
    return lb.with_total_row(lb.board(_holes(t), interpolation="zero", form="ranks"))


@query(
    "L15_ranking",
    sql(
        """select strategy, round(avg(score), 6) as total from board group by strategy
order by avg(score) desc, strategy""",
        "runs",
        extra=HOLES + ",\n" + board_ctes("scores", interpolation="zero", form="ranks"),
    ),
)
def _(t: Tables):
    return lb.ranking(lb.board(_holes(t), interpolation="zero", form="ranks"), ascending=False)


def _family_sql() -> str:
    ctes, parts = [], []
    kinds = {
        "dataset_normalized_percentages": ("minmax", "percentages"),
        "rank": ("none", "ranks"),
        "percentages": ("none", "percentages"),
    }
    number = 0
    for kind, (normalisation, form) in kinds.items():
        for grid, source, rules in (
            ("sparse", "scores", lb.INTERPOLATIONS),
            ("dense", "dense", ("none",)),
        ):
            for rule in rules:
                p = f"f{number}_"
                number += 1
                ctes.append(board_ctes(source, (), rule, normalisation, form, p))
                parts.append(
                    f"""select '{grid}_{rule}_{kind}' as setting, strategy,
  round(avg(score), 6) as total from {p}board group by strategy"""
                )
    return sql(
        "\nunion all\n".join(parts), "runs", extra=VALUES + ",\n" + SHARED + ",\n" + ",\n".join(ctes)
    )


@query("L16_board_family", _family_sql())
def _(t: Tables):
    return lb.board_family(_scores(t), ["batch", "learner"])


SLICED = ["learner", "batch", "dataset", "bucket", "start_point"]
SLICES = "slices as (" + " union all ".join(
    f"select '{c}' as parameter, cast({c} as varchar) as setting, dataset, strategy, value from scores"
    for c in SLICED
) + ")"


@query(
    "L17_parameter_slices",
    sql(
        """select parameter, setting, strategy, round(avg(score), 6) as total from board
group by all""",
        "runs",
        extra=",\n".join(
            [
                VALUES,
                SLICES,
                board_ctes(
                    "slices", ("parameter", "setting"), "average_of_same_strategy", "minmax"
                ),
            ]
        ),
    ),
)
def _(t: Tables):
    return lb.sliced_boards(
        _scores(t),
        SLICED,
        interpolation="average_of_same_strategy",
        normalisation="minmax",
    )


METRIC_SCORES = """metric_scores as (
  select dataset, strategy, run_id, unnest(['full_auc', 'best_value', 'worst_value']) as metric,
         unnest([avg(value), max(value), min(value)]) as value
  from curve where cycle > 0 group by run_id, dataset, strategy)"""


def _metric_scores(t: Tables) -> DataFrame:
    from curveboard.operators.registry import apply_to_curves

    names = ["full_auc", "best_value", "worst_value"]
    wide = apply_to_curves(t.curve, names, ["run_id", "dataset", "strategy"])
    return wide.unpivot(["run_id", "dataset", "strategy"], names, "metric", "value")


@query(
    "L18_metric_boards",
    sql(
        """select 'metric' as parameter, metric as setting, strategy,
  round(avg(score), 6) as total from board group by all""",
        "curve",
        extra=METRIC_SCORES + ",\n" + board_ctes("metric_scores", ("metric",), "zero", "none", "ranks"),
    ),
)
def _(t: Tables):
    return lb.sliced_boards(_metric_scores(t), ["metric"], interpolation="zero", form="ranks")


@query(
    "L19_longest_cell",
    sql(
        """select learner, max(n) as m from (select learner, dataset, strategy, count(*) as n
from runs group by all) group by learner""",
        "runs",
    ),
)
def _(t: Tables):
    cells = lb.cells_of(t.runs, ["learner"])
    return cells.groupBy("learner").agg(F.max("n").alias("m"))


@query(
    "L20_score_table",
    sql(
        """with c as (select strategy, dataset, avg(value) as v from full_mean group by 1, 2),
s as (select strategy, cast(dataset as varchar) as dataset,
        v * (select case when max(value) <= 1 then 100 else 1 end from full_mean) as score from c)
select strategy, dataset, round(score, 6) as score from s
union all select strategy, 'Mean (%)', round(avg(score), 6) from s group by strategy""".replace(
            "with c as", ", c as", 1
        ),
        "full_mean",
    ),
)
def _(t: Tables):
    return lb.score_table(t.full_mean)


@query(
    "L20_score_table_of_shares",
    sql(
        """with c as (select strategy, dataset, avg(value) as v from shares group by 1, 2),
s as (select strategy, cast(dataset as varchar) as dataset, v * 100 as score from c)
select strategy, dataset, round(score, 6) as score from s
union all select strategy, 'Mean (%)', round(avg(score), 6) from s group by strategy""".replace(
            "with c as", ", c as", 1
        ),
        "full_mean",
        extra="shares as (select strategy, dataset, value / (select max(value) from full_mean) as value from full_mean)",
    ),
)
def _(t: Tables):
    largest = t.full_mean.agg(F.max("value")).scalar()
    return lb.score_table(t.full_mean.withColumn("value", F.col("value") / largest))


@query(
    "L21_metric_heat",
    sql(
        """select strategy, metric, round(mean, 6) as mean,
  round((mean - min(mean) over (partition by metric)) / nullif(max(mean) over (partition by metric)
    - min(mean) over (partition by metric), 0), 6) as heat
from (select strategy, metric, avg(value) as mean from metric_scores group by 1, 2)""",
        "curve",
        extra=METRIC_SCORES,
    ),
)
def _(t: Tables):
    return lb.metric_heat(_metric_scores(t))

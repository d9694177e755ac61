"""Queries for prediction quality, learning curves and time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from curveboard.functions.lists import list_mean, parse_list, show_list
from curveboard.operators import curves, quality, series
from curveboard.operators.registry import apply_to_curves, cycle_metrics, expand_cycles
from curveboard.plans.catalog import query
from curveboard.plans.testbed import Tables, sql

# --- prediction quality -----------------------------------------------------

CLASSES = """
classes as (
  select run_id, c.class, count(*) filter (where label = c.class and y_pred = c.class) as tp,
         count(*) filter (where label = c.class) as support,
         count(*) filter (where y_pred = c.class) as predicted
  from predictions join (select distinct run_id, unnest([label, y_pred]) as class
                         from predictions) c using (run_id)
  group by run_id, c.class),
scores as (
  select *, case when predicted = 0 then 0 else tp / predicted end as p,
         case when support = 0 then 0 else tp / support end as r,
         case when predicted + support = 0 then 0 else 2.0 * tp / (predicted + support) end as f
  from classes)"""


@query(
    "M1_accuracy",
    sql(
        """select run_id, round(avg(case when label = y_pred then 1.0 else 0.0 end), 6) as accuracy
from predictions group by run_id""",
        "predictions",
    ),
)
def _(t: Tables):
    return quality.accuracy(t.predictions, ["run_id"])


def _quality_sql(column: str, name: str, weighted: bool) -> str:
    value = f"sum({column} * support) / sum(support)" if weighted else f"avg({column})"
    return sql(
        f"select run_id, round({value}, 6) as {name} from scores group by run_id",
        "predictions",
        extra=CLASSES,
    )


for _id, _name, _column in (
    ("M2", "macro_precision", "p"),
    ("M3", "macro_recall", "r"),
    ("M4", "macro_f1", "f"),
    ("M5", "weighted_precision", "p"),
    ("M6", "weighted_recall", "r"),
    ("M7", "weighted_f1", "f"),
):

    def _score(t: Tables, name=_name):
        compute = quality.macro_scores if name.startswith("macro") else quality.weighted_scores
        return compute(t.predictions, ["run_id"]).select("run_id", name)

    query(f"{_id}_{_name}", _quality_sql(_column, _name, _name.startswith("weighted")))(_score)


@query(
    "M1_M7_standard_metrics",
    sql(
        """select run_id, round(sum(tp) / sum(support), 6) as accuracy,
  round(avg(p), 6) as macro_precision, round(avg(r), 6) as macro_recall,
  round(avg(f), 6) as macro_f1,
  round(sum(p * support) / sum(support), 6) as weighted_precision,
  round(sum(r * support) / sum(support), 6) as weighted_recall,
  round(sum(f * support) / sum(support), 6) as weighted_f1
from scores group by run_id""",
        "predictions",
        extra=CLASSES,
    ),
)
def _(t: Tables):
    return quality.standard_metrics(t.predictions, ["run_id"])


@query(
    "M8_train_test_ratio",
    sql(
        """select run_id, cycle, round(a / nullif(b, 0), 6) as mismatch from (
  select run_id, cycle, avg(case when label = y_pred then 1.0 else 0 end)
           filter (where part = 'test') as a,
         avg(case when label = y_pred then 1.0 else 0 end) filter (where part = 'train') as b
  from predictions group by run_id, cycle)""",
        "predictions",
    ),
)
def _(t: Tables):
    return quality.train_test_ratio(t.predictions, ["run_id", "cycle"]).select(
        "run_id", "cycle", "mismatch"
    )


@query(
    "M9_selection_log",
    sql(
        """select run_id, cycle,
  array_to_string(list_sort(list(sample_id)), ',') as sample_ids
from picks group by run_id, cycle""",
        "picks",
    ),
)
def _(t: Tables):
    log = quality.selection_log(t.picks)
    return log.withColumn("sample_ids", show_list(F.col("sample_ids")))


@query(
    "M10_time_totals",
    """select l_orderkey as run_id, round(sum(l_quantity), 6) as seconds
from lineitem group by 1""",
)
def _(t: Tables):
    return quality.time_totals(t.items)


# --- curve metrics ----------------------------------------------------------

def _list_cells(t: Tables):
    """A list literal per event; values below 2 are nan."""
    shown = lambda c: F.when(c < 2, F.lit("nan")).otherwise(c.cast("string"))
    value, place = F.col("value"), (F.col("event_id") % 10).cast("double")
    text = F.concat(
        F.lit("["), F.concat_ws(", ", shown(value), shown(value / 2), shown(place)), F.lit("]")
    )
    return t.given("events").select("event_id", text.alias("cell"))


@query(
    "A0_list_cell_mean",
    """select event_id, round(list_sum(list_transform([value, value / 2, event_id % 10],
  lambda x: case when x >= 2 then x else 0 end)) / 3, 6) as mean from events""",
)
def _(t: Tables):
    cells = _list_cells(t).withColumn("v", parse_list(F.col("cell")))
    return cells.select("event_id", list_mean(F.col("v")).alias("mean"))


EVALUATED = """evaluated as (
  select *, row_number() over (partition by run_id order by cycle) - 1 as pos,
         count(*) over (partition by run_id) as n
  from gappy where cycle > 0 and value is not null)"""


def _evaluated_sql(value: str, name: str, where: str = "true") -> str:
    return sql(
        f"select run_id, round({value}, 6) as {name} from evaluated where {where} group by run_id",
        "gappy",
        extra=EVALUATED,
    )


@query("A1_full_auc", _evaluated_sql("avg(value)", "full_auc"))
def _(t: Tables):
    return curves.full_mean(t.gappy)


@query("A2_first_5", _evaluated_sql("avg(value)", "first_5", "pos < 5"))
def _(t: Tables):
    return curves.first_mean(t.gappy)


@query("A3_last_5", _evaluated_sql("avg(value)", "last_5", "pos >= n - 5"))
def _(t: Tables):
    return curves.last_mean(t.gappy)


@query("A4_final_value", _evaluated_sql("max_by(value, cycle)", "final_value"))
def _(t: Tables):
    return curves.final_value(t.gappy)


CUTOFFS = """filled as (
  select run_id, dataset, strategy, fingerprint, value,
         row_number() over (partition by run_id order by cycle) - 1 as pos,
         count(*) over (partition by run_id) as n
  from gappy where value is not null),
windows as (
  select *, avg(value) over (partition by run_id order by pos
                             rows between current row and 4 following) as w,
         avg(value) over (partition by run_id) as o
  from filled),
cutoffs as (
  select run_id, any_value(dataset) as dataset, any_value(strategy) as strategy,
         any_value(fingerprint) as fingerprint,
         coalesce(cast(min(pos) filter (where w > o and pos between 1 and n - 5) as double),
                  cast(round_even(any_value(n) / 2.0, 0) as double)) as cutoff
  from windows group by run_id)"""

# every third run has no cutoff of its own
PARTIAL = """, partial as (select * from cutoffs where run_id % 3 > 0),
phase_rows as (
  select run_id, cycle, value,
         case when value is not null then
           count(value) over (partition by run_id order by cycle) - 1 end as pos,
         count(*) over (partition by run_id) as width
  from gappy where cycle > 0),
phases as (
  select r.*, coalesce(cast(p.cutoff as bigint), (width + 1) // 2) as cut
  from phase_rows r left join partial p using (run_id))"""


def _partial_cutoffs(t: Tables):
    return curves.ramp_cutoffs(t.gappy).filter("run_id % 3 > 0")


@query(
    "A5_ramp_up_auc",
    sql(
        """select run_id, round(avg(value) filter (where pos < cut), 6) as ramp_up_auc
from phases group by run_id""",
        "gappy",
        extra=CUTOFFS + PARTIAL,
    ),
)
def _(t: Tables):
    return curves.phase_means(t.gappy, _partial_cutoffs(t)).select("run_id", "ramp_up_auc")


@query(
    "A6_plateau_auc",
    sql(
        """select run_id, round(avg(value) filter (where pos >= cut), 6) as plateau_auc
from phases group by run_id""",
        "gappy",
        extra=CUTOFFS + PARTIAL,
    ),
)
def _(t: Tables):
    return curves.phase_means(t.gappy, _partial_cutoffs(t)).select("run_id", "plateau_auc")


@query(
    "A7_missing_cutoff_fallback",
    sql(
        """select run_id, round(avg(value) filter (where pos < (width + 1) // 2), 6) as ramp_up_auc,
  round(avg(value) filter (where pos >= (width + 1) // 2), 6) as plateau_auc
from phase_rows group by run_id""",
        "gappy",
        extra=CUTOFFS + PARTIAL,
    ),
)
def _(t: Tables):
    none = t.gappy.select("run_id").distinct().withColumn("cutoff", F.lit(None).cast("double"))
    return curves.phase_means(t.gappy, none)


STABILITY = """steps as (
  select run_id, value - lag(value) over (partition by run_id order by cycle) as diff,
         row_number() over (partition by run_id order by cycle) - 1 as ix,
         count(*) over (partition by run_id) as width
  from gappy where cycle > 0)"""


def _stability_sql(k: int) -> str:
    return sql(
        f"""select run_id, round(case when avg(diff) <= 0 then 0
  else avg(diff) filter (where ix >= width - {k}) / nullif(avg(diff), 0) end, 6)
  as learning_stability_{k}
from steps group by run_id""",
        "gappy",
        extra=STABILITY,
    )


@query("A8_learning_stability_5", _stability_sql(5))
def _(t: Tables):
    return curves.learning_stability(t.gappy, [5])


@query("A9_learning_stability_10", _stability_sql(10))
def _(t: Tables):
    return curves.learning_stability(t.gappy, [10])


@query(
    "A10_time_lag",
    sql(
        """select run_id, cycle, round(d, 6) as value from (
  select run_id, cycle, value - lag(value) over (partition by run_id order by cycle) as d
  from gappy) where cycle > 0""",
        "gappy",
    ),
)
def _(t: Tables):
    return curves.time_lag(t.gappy)


DROPS = """steps as (
  select run_id, cycle, value, lead(value) over (partition by run_id order by cycle) as nxt
  from curve)"""


@query(
    "A11_biggest_drop",
    sql(
        """select run_id, cycle, round(0.0 - max(greatest(value - nxt, 0)) over
  (partition by run_id order by cycle), 6) as value
from steps where nxt is not null""",
        "curve",
        extra=DROPS,
    ),
)
def _(t: Tables):
    return curves.biggest_drop(t.curve)


@query(
    "A12_decreasing_cycles",
    sql(
        """select run_id, cycle, cast(0 - sum(case when nxt < value then 1 else 0 end) over
  (partition by run_id order by cycle) as bigint) as value
from steps where nxt is not null""",
        "curve",
        extra=DROPS,
    ),
)
def _(t: Tables):
    return curves.decreasing_cycles(t.curve)


@query("A13_ramp_cutoff", sql("select run_id, cutoff from cutoffs", "gappy", extra=CUTOFFS))
def _(t: Tables):
    return curves.ramp_cutoffs(t.gappy)


@query(
    "A14_spread_cutoffs",
    sql(
        """select r.run_id, b.cutoff
from (select distinct run_id, dataset, fingerprint from curve) r
full outer join (select * from cutoffs where strategy = 'signup') b
  using (dataset, fingerprint)""",
        "gappy",
        extra=CUTOFFS,
    ),
)
def _(t: Tables):
    baseline = curves.ramp_cutoffs(
        t.gappy.filter("strategy = 'signup'"), ["run_id", "dataset", "fingerprint"]
    )
    runs = t.curve.select("run_id", "dataset", "fingerprint").distinct()
    return curves.spread_cutoffs(baseline, runs, ["dataset", "fingerprint"])


@query(
    "A15_change_point",
    sql(
        """select run_id, min_by(split, (e, split)) as cutoff from (
  select a.run_id, a.pos + 1 as split,
    sum((b.value - m.l) ** 2) filter (where b.pos <= a.pos)
      + sum((b.value - m.r) ** 2) filter (where b.pos > a.pos) as e
  from filled a join filled b using (run_id)
  join (select a.run_id, a.pos, avg(b.value) filter (where b.pos <= a.pos) as l,
               avg(b.value) filter (where b.pos > a.pos) as r
        from filled a join filled b using (run_id) group by 1, 2) m
    on m.run_id = a.run_id and m.pos = a.pos
  where (a.pos + 1) % 5 = 0 and a.n - a.pos - 1 >= 2
  group by 1, 2) group by run_id""",
        "gappy",
        extra=CUTOFFS,
    ),
)
def _(t: Tables):
    return curves.change_point(t.gappy)


@query(
    "A16_trapezoid_auc",
    sql(
        """select run_id, round(sum(a), 9) as auc,
  round(sum(a) / nullif(count(*) - 1, 0), 9) as normalised_auc
from (select run_id, (value + lag(value) over (partition by run_id order by cycle)) / 2 as a
      from curve) group by run_id""",
        "curve",
    ),
    digits=9,
)
def _(t: Tables):
    return curves.trapezoid(t.curve)


# metric names derived from the event types, with prefixes and suffixes cycling
METRICS = """metrics as (
  select distinct
    case event_id % 6 when 0 then 'full_auc_' when 1 then 'first_5_' when 2 then 'y_pred_train_'
      else '' end || event_type ||
    case event_id % 4 when 0 then '_macro_recall' when 1 then '_time_lag' else '' end as metric
  from events)"""


def _metric_names(t: Tables):
    k, m = F.col("event_id") % 6, F.col("event_id") % 4
    front = (
        F.when(k == 0, "full_auc_").when(k == 1, "first_5_").when(k == 2, "y_pred_train_")
    ).otherwise("")
    back = F.when(m == 0, "_macro_recall").when(m == 1, "_time_lag").otherwise("")
    return t.given("events").select(F.concat(front, "event_type", back).alias("metric")).distinct()


@query(
    "A17_eligible_metrics",
    sql(
        """select metric from metrics
where not (metric like 'full_auc_%' or metric like 'first_5_%' or metric like 'y_pred_train%')""",
        extra=METRICS,
    ),
)
def _(t: Tables):
    return curves.eligible_metrics(_metric_names(t))


@query(
    "A17_eligible_for_time_lag",
    sql(
        """select metric from metrics
where not (metric like 'full_auc_%' or metric like 'first_5_%' or metric like 'y_pred_train%'
  or metric like '%macro_recall%' or metric like '%time_lag')""",
        extra=METRICS,
    ),
)
def _(t: Tables):
    return curves.eligible_metrics(_metric_names(t), "time_lag")


@query(
    "A18_wide_join",
    sql(
        """select run_id, round(a.value, 6) as quantity, round(b.value, 6) as price from
(select run_id, min_by(discount, cycle) as value from lines where y_pred > 0 group by 1) a
full outer join (select run_id, min_by(price, cycle) as value from lines group by 1) b
using (run_id)""",
        "lines",
    ),
)
def _(t: Tables):
    first = t.lines.filter("y_pred > 0").select("run_id", "cycle", F.col("discount").alias("quantity"))
    second = t.lines.select("run_id", "cycle", "price")
    return curves.wide_join([first, second], order_by=["cycle"])


@query(
    "A19_derive_if_missing",
    sql(
        """select strategy, dataset, metric from
(select distinct strategy, dataset, m.metric from runs
   cross join (values ('accuracy'), ('macro_f1')) m(metric))
except select strategy, dataset, 'accuracy' from runs where learner = 'F'""",
        "runs",
    ),
)
def _(t: Tables):
    metric = F.explode(F.array(F.lit("accuracy"), F.lit("macro_f1"))).alias("metric")
    wanted = t.runs.select("strategy", "dataset").distinct().select("strategy", "dataset", metric)
    existing = t.runs.filter("learner = 'F'").select(
        "strategy", "dataset", F.lit("accuracy").alias("metric")
    )
    return curves.missing_outputs(wanted, existing)


@query(
    "A20_pad_curves",
    sql(
        """select coalesce(s.run_id, l.run_id) as run_id,
  cast(coalesce(s.cycle, l.cycle) as bigint) as cycle, round(l.value, 6) as value from
(select run_id, unnest(generate_series(0, 2)) as cycle
 from (select distinct run_id from lines where run_id % 4 > 0)) s
full join lines l on s.run_id = l.run_id and s.cycle = l.cycle""",
        "lines",
    ),
)
def _(t: Tables):
    planned = t.items.filter("run_id % 4 > 0").select("run_id").distinct()
    padded = curves.pad_curves(t.lines, planned.withColumn("num_queries", F.lit(3)))
    return padded.withColumn("cycle", F.col("cycle").cast("long"))


@query(
    "A1_A6_curve_aggregates",
    sql(
        """select e.run_id, round(avg(e.value), 6) as full_auc,
  round(avg(e.value) filter (where e.pos < 5), 6) as first_5,
  round(avg(e.value) filter (where e.pos >= e.n - 5), 6) as last_5,
  round(max_by(e.value, e.cycle), 6) as final_value,
  round(avg(e.value) filter (where e.pos < p.cut), 6) as ramp_up_auc,
  round(avg(e.value) filter (where e.pos >= p.cut), 6) as plateau_auc
from evaluated e join phases p on e.run_id = p.run_id and e.cycle = p.cycle group by e.run_id""",
        "gappy",
        extra=EVALUATED + ",\n" + CUTOFFS + PARTIAL,
    ),
)
def _(t: Tables):
    return curves.curve_aggregates(t.gappy, _partial_cutoffs(t))


# --- time series ------------------------------------------------------------


@query(
    "T1_metric_with_runs",
    sql(
        """select l.run_id, l.cycle, round(l.price, 6) as price, r.dataset, r.strategy, r.learner
from lines l left join runs r using (run_id)""",
        "lines",
        "runs",
    ),
)
def _(t: Tables):
    runs = t.runs.select("run_id", "dataset", "strategy", "learner")
    return series.with_runs(t.lines.select("run_id", "cycle", "price"), runs)


@query(
    "T2_stack_metrics",
    sql(
        """select m.metric, r.dataset, r.strategy, count(*) as n,
  round(avg(cast(m.value as float)), 4) as mean
from (select run_id, 'discount' as metric, discount as value from lines
      union all select run_id, 'quantity', value from lines) m
left join runs r using (run_id) group by all""",
        "lines",
        "runs",
    ),
)
def _(t: Tables):
    items = t.given("lineitem").withColumnRenamed("l_orderkey", "run_id")
    stacked = series.stack_metrics(
        {
            "discount": items.select("run_id", F.col("l_discount").alias("value")),
            "quantity": items.select("run_id", F.col("l_quantity").alias("value")),
        },
        t.runs.select("run_id", "dataset", "strategy"),
    )
    return stacked.groupBy("metric", "dataset", "strategy").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean")
    )


@query(
    "T3_unpivot",
    sql(
        """select dataset, strategy, cast(cycle as integer) as ix,
  run_id || '_' || cycle as run_ix, round(value, 6) as value
from gappy where value is not null""",
        "gappy",
    ),
)
def _(t: Tables):
    ids = ["run_id", "dataset", "strategy"]
    wide = series.pivot_cycles(t.gappy, ids)
    return series.unpivot_cycles(wide, ids)


@query(
    "T4_sorted_series",
    sql(
        """select dataset, strategy, run_id, cycle, round(value, 6) as value from curve
order by dataset, strategy, run_id, cycle""",
        "curve",
    ),
)
def _(t: Tables):
    rows = t.curve.select("dataset", "strategy", "run_id", "cycle", "value")
    return series.sorted_series(rows, ["dataset", "strategy", "run_id", "cycle"])


@query(
    "T5_unbuilt_metrics",
    sql(
        """select distinct metric from metrics
except select event_type from events""",
        extra=METRICS,
    ),
)
def _(t: Tables):
    built = t.given("events").select(F.col("event_type").alias("metric"))
    return series.unbuilt_metrics(_metric_names(t), built)


@query(
    "T7_learning_curve",
    sql(
        """select strategy, cycle, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std,
  count(value) as n, round(quantile_cont(value, 0.025), 6) as low,
  round(quantile_cont(value, 0.975), 6) as high
from curve where dataset = 3 group by strategy, cycle""",
        "curve",
    ),
)
def _(t: Tables):
    return series.learning_curve(t.curve, {"dataset": 3})


@query(
    "T8_summary_by_strategy",
    sql(
        """select strategy, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std,
  count(value) as n from full_mean group by strategy""",
        "full_mean",
    ),
)
def _(t: Tables):
    return series.summary_by(t.full_mean, ["strategy"])


@query(
    "T8_top_datasets",
    sql(
        """select dataset, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std,
  count(value) as n from full_mean group by dataset order by avg(value) desc, dataset limit 3""",
        "full_mean",
    ),
)
def _(t: Tables):
    return series.top_by(t.full_mean, "dataset", 3)


# --- extension points -------------------------------------------------------


@query(
    "U1_cycle_metrics",
    sql(
        """select run_id, cycle,
  round(avg(case when label = y_pred then 1.0 else 0 end), 6) as accuracy,
  round(avg(case when label <> y_pred then 1.0 else 0 end), 6) as error_rate
from predictions group by run_id, cycle""",
        "predictions",
    ),
)
def _(t: Tables):
    return cycle_metrics(t.predictions, ["run_id", "cycle"], ["accuracy", "error_rate"])


@query(
    "U2_apply_to_curves",
    sql(
        """select run_id, round(avg(value), 6) as full_auc,
  round(max_by(value, cycle), 6) as final_value, round(max(value), 6) as best_value,
  round(min(value), 6) as worst_value
from evaluated group by run_id""",
        "gappy",
        extra=EVALUATED,
    ),
)
def _(t: Tables):
    names = ["full_auc", "final_value", "best_value", "worst_value"]
    return apply_to_curves(t.gappy, names)


@query(
    "U5_expand_cycles",
    """select event_id, cast(unnest([0, 1, 2]) as integer) as cycle,
  round(unnest([value, value * 2, value / 4]), 6) as value from events""",
)
def _(t: Tables):
    value = F.col("value")
    cells = t.given("events").select(
        "event_id", F.array(value, value * 2, value / 4).alias("values")
    )
    return expand_cycles(cells)


@query(
    "U6_population_std",
    sql(
        "select strategy, round(stddev_pop(value), 6) as std from full_mean group by strategy",
        "full_mean",
    ),
)
def _(t: Tables):
    from curveboard.operators.registry import population_std

    return t.full_mean.groupBy("strategy").agg(population_std("value").alias("std"))

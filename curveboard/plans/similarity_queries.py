"""Queries for correlations, set similarity and robustness scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curveboard.operators import leaderboard as lb
from curveboard.operators import redundancy as red
from curveboard.operators import scenarios as sc
from curveboard.operators import selections as sel
from curveboard.operators import similarity as sim
from curveboard.plans.board_queries import METRIC_SCORES, _metric_scores, _scores, board_ctes
from curveboard.plans.catalog import query
from curveboard.plans.testbed import Tables, sql

VALUES = "scores as (select * exclude (value), value / 997 as value from runs)"

# --- correlation ------------------------------------------------------------


@query(
    "R1_shared_ids",
    """select l_orderkey as run_id from lineitem group by 1 having count(distinct l_returnflag) =
  (select count(distinct l_returnflag) from lineitem)""",
)
def _(t: Tables):
    rows = t.given("lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("metric")
    )
    return sim.shared_ids(rows)


def _pairs_sql(rows: str, of: str, key: str, by: str = "") -> str:
    b = f"{by}, " if by else ""
    on = f"a.{by} = z.{by} and " if by else ""
    return f"""select {f"a.{by}, " if by else ""}a.{of} as x, z.{of} as y, count(*) as n,
  round(corr(a.value, z.value), 6) as r
from {rows} a join {rows} z on {on}{" and ".join(f"a.{k} = z.{k}" for k in key.split(", "))}
group by {f"a.{by}, " if by else ""}a.{of}, z.{of}"""


@query(
    "R2_metric_correlation",
    sql(_pairs_sql("metric_scores", "metric", "run_id"), "curve", extra=METRIC_SCORES),
)
def _(t: Tables):
    return sim.pearson_matrix(_metric_scores(t), "metric", "run_id")


SHARED_USERS = """cells as (select fingerprint, strategy, avg(value) as value from full_mean group by all),
shared as (select * from cells where fingerprint in (select fingerprint from cells group by 1
  having count(*) = (select count(distinct strategy) from cells)))"""


@query(
    "R3_parameter_correlation",
    sql(_pairs_sql("shared", "strategy", "fingerprint"), "full_mean", extra=SHARED_USERS),
)
def _(t: Tables):
    return sim.parameter_correlation(t.full_mean, "strategy", ["fingerprint"])


INTERVAL = (
    SHARED_USERS
    + """,
m as ("""
    + _pairs_sql("shared", "strategy", "fingerprint").replace(
        "round(corr(a.value, z.value), 6)", "corr(a.value, z.value)"
    )
    + """),
k as (select x, y, n, case when x = y then 1.0 else r end as r,
        case when x = y then 1.0 else tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)) end as lo,
        case when x = y then 1.0 else tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)) end as hi
      from m where x <> y or true)"""
).replace("atanh(r)", "atanh(greatest(-0.999999999, least(0.999999999, r)))")


@query(
    "R4_fisher_interval",
    sql(
        "select x, y, n, round(r, 6) as r, round(lo, 6) as lo, round(hi, 6) as hi from k",
        "full_mean",
        extra=INTERVAL,
    ),
)
def _(t: Tables):
    matrix = sim.parameter_correlation(t.full_mean, "strategy", ["fingerprint"])
    return sim.with_interval(matrix).select("x", "y", "n", "r", "lo", "hi")


@query(
    "R5_half_width_and_error",
    sql(
        """select x, y, round((hi - lo) / 2, 6) as half_width,
  round((1 - r * r) / sqrt(n - 3), 6) as standard_error from k""",
        "full_mean",
        extra=INTERVAL,
    ),
)
def _(t: Tables):
    matrix = sim.parameter_correlation(t.full_mean, "strategy", ["fingerprint"])
    return sim.with_interval(matrix).select("x", "y", "half_width", "standard_error")


# selections: which parts the orders of a nation's customers pick, by priority
CHOSEN = """chosen as (
  select r.dataset, r.strategy, r.learner, l.l_partkey as sample_id
  from lineitem l join runs r on l.l_orderkey = r.run_id)"""


def _chosen(t: Tables) -> DataFrame:
    return t.items.select("run_id", "sample_id").join(
        t.runs.select("run_id", "dataset", "strategy", "learner"), "run_id"
    )


@query(
    "R6_jaccard",
    sql(
        """select s.a, z.b, round(avg(coalesce(i, 0) / (na + nb - coalesce(i, 0))), 6) as jaccard
from (select dataset, strategy as a, count(distinct sample_id) as na from chosen group by 1, 2) s
join (select dataset, strategy as b, count(distinct sample_id) as nb from chosen group by 1, 2) z
  using (dataset)
left join (select x.dataset, x.strategy as a, y.strategy as b, count(*) as i
  from (select distinct dataset, strategy, sample_id from chosen) x
  join (select distinct dataset, strategy, sample_id from chosen) y using (dataset, sample_id)
  group by 1, 2, 3) c on c.dataset = s.dataset and c.a = s.a and c.b = z.b
group by 1, 2""",
        "runs",
        extra=CHOSEN,
    ),
)
def _(t: Tables):
    return sim.jaccard_matrix(_chosen(t), "strategy", ["dataset"])


# equal-length sequences: five runs share a fingerprint
ORDERED = """ordered as (
  select run_id // 5 as fingerprint, run_id % 5 as run_id, sample_id,
         count(*) over (partition by run_id) as n,
         row_number() over (partition by run_id order by cycle, sample_id) - 1 as pos
  from picks)"""


@query(
    "R7_sequence_kendall",
    sql(
        """select p.fingerprint, p.a, p.b, t.n, t.tau from
(select distinct x.fingerprint, x.run_id as a, y.run_id as b from ordered x join ordered y
  using (fingerprint, pos) where x.run_id < y.run_id) p
left join (select fingerprint, a, b, any_value(n) as n,
    round(sum(sign(x1 - x2) * sign(y1 - y2)) / sqrt(sum(abs(sign(x1 - x2))) * 1.0
      * sum(abs(sign(y1 - y2)))), 6) as tau
  from (select i.*, j.x2, j.y2 from
    (select x.fingerprint, x.run_id as a, y.run_id as b, x.n, x.pos, x.sample_id as x1,
       y.sample_id as y1 from ordered x join ordered y using (fingerprint, pos)
     where x.run_id < y.run_id and x.n = y.n) i join
    (select x.fingerprint, x.run_id as a, y.run_id as b, x.pos as p2, x.sample_id as x2,
       y.sample_id as y2 from ordered x join ordered y using (fingerprint, pos)
     where x.run_id < y.run_id) j
    on i.fingerprint = j.fingerprint and i.a = j.a and i.b = j.b and i.pos < j.p2)
  group by 1, 2, 3) t using (fingerprint, a, b)""",
        "picks",
        extra=ORDERED,
    ),
)
def _(t: Tables):
    rows = t.picks.select(
        F.floor(F.col("run_id") / 5).alias("fingerprint"),
        (F.col("run_id") % 5).alias("run_id"),
        "cycle",
        "sample_id",
    )
    ordered = sel.ordered_selections(rows, ["fingerprint", "run_id"])
    return sim.sequence_kendall(ordered, "run_id", ["fingerprint"], chunk=64)


@query(
    "R8_multiset_jaccard",
    sql(
        """select dataset, a, b, round(sum(i) / sum(ta + tb - i), 6) as jaccard from (
  select unnest([cast(s.dataset as varchar), 'All Datasets Combined']) as dataset, s.a, z.b, ta, tb,
         coalesce(i, 0) as i
  from (select dataset, strategy as a, count(*) as ta from chosen group by 1, 2) s
  join (select dataset, strategy as b, count(*) as tb from chosen group by 1, 2) z using (dataset)
  left join (select x.dataset, x.strategy as a, y.strategy as b, sum(least(x.c, y.c)) as i
    from (select dataset, strategy, sample_id, count(*) as c from chosen group by all) x
    join (select dataset, strategy, sample_id, count(*) as c from chosen group by all) y
      using (dataset, sample_id) group by 1, 2, 3) c
    on c.dataset = s.dataset and c.a = s.a and c.b = z.b)
group by dataset, a, b""",
        "runs",
        extra=CHOSEN,
    ),
)
def _(t: Tables):
    return sim.multiset_jaccard(_chosen(t).select("dataset", "strategy", "sample_id"))


@query(
    "R9_strategy_similarity",
    sql(
        """select j.a, j.b, round(j.jaccard, 6) as jaccard, round(s.spearman, 6) as spearman from
(select a, b, avg(i * 1.0 / (na + nb - i)) as jaccard from (
   select x.strategy as a, y.strategy as b, fingerprint, any_value(x.n) as na,
     any_value(y.n) as nb, count(*) filter (where x.sample_id = y.sample_id) as i
   from ranked x join ranked y using (fingerprint) group by 1, 2, 3) group by 1, 2) j
left join (select a, b, avg(r) as spearman from (
   select x.strategy as a, y.strategy as b, fingerprint, corr(x.r, y.r) as r
   from ranked x join ranked y using (fingerprint, pos) group by 1, 2, 3) group by 1, 2) s
  using (a, b)""",
        "picks",
        extra="""numbered as (
  select run_id % 5 as strategy, run_id // 5 as fingerprint, sample_id,
         count(*) over (partition by run_id) as n,
         row_number() over (partition by run_id order by cycle, sample_id) - 1 as pos
  from picks),
ranked as (select *, rank() over (partition by fingerprint, strategy order by sample_id) as r
  from numbered)""",
    ),
)
def _(t: Tables):
    rows = t.picks.select(
        (F.col("run_id") % 5).alias("strategy"),
        F.floor(F.col("run_id") / 5).alias("fingerprint"),
        "cycle",
        "sample_id",
    )
    ordered = sel.ordered_selections(rows, ["fingerprint", "strategy"])
    return sim.strategy_similarity(ordered, ["fingerprint"])


# ranking vectors: total per strategy for each learner, batch and bucket
VECTORS = """vectors as (
  select batch as setting, strategy, avg(value) as total from scores group by 1, 2)"""


def _vectors(t: Tables, of: str = "batch") -> DataFrame:
    return _scores(t).groupBy(F.col(of).alias("setting"), "strategy").agg(
        F.avg("value").alias("total")
    )


def _tau(rows: str, keys: str) -> str:
    """SQL tau-b of pairs (keys, item, x, y) by brute force over item pairs."""
    same = " and ".join(f"i.{k.strip()} = j.{k.strip()}" for k in keys.split(","))
    return f"""select {", ".join("i." + k.strip() for k in keys.split(","))},
  (select count(*) from {rows} c where {" and ".join(f"c.{k.strip()} = i.{k.strip()}"
    for k in keys.split(","))}) as n,
  sum(sign(i.x - j.x) * sign(i.y - j.y)) / nullif(sqrt(sum(abs(sign(i.x - j.x))) * 1.0
    * sum(abs(sign(i.y - j.y)))), 0) as tau
from {rows} i join {rows} j on {same} and i.item < j.item
group by {", ".join("i." + k.strip() for k in keys.split(","))}"""


VECTOR_PAIRS = """vp as (select a.setting as x_name, b.setting as y_name, a.strategy as item,
  a.total as x, b.total as y from vectors a join vectors b using (strategy))"""


@query(
    "R10_kendall_matrix",
    sql(
        f"select x_name, y_name, n, round(tau, 6) as tau from ({_tau('vp', 'x_name, y_name')})",
        "runs",
        extra=",\n".join([VALUES, VECTORS, VECTOR_PAIRS]),
    ),
)
def _(t: Tables):
    return sim.kendall_matrix(_vectors(t), "setting", "strategy")


@query(
    "R10_kendall_with_ties",
    sql(
        f"select x_name, n, round(tau, 6) as tau from ({_tau('tp', 'x_name')})",
        extra="""tp as (select l_orderkey % 200 as x_name, row_number() over () as item,
  l_quantity as x, l_linenumber as y from lineitem)""",
    ),
)
def _(t: Tables):
    rows = t.given("lineitem").select(
        (F.col("l_orderkey") % 200).alias("x_name"),
        F.col("l_quantity").alias("x"),
        F.col("l_linenumber").alias("y"),
    )
    return sim.kendall_long(rows, ["x_name"])


@query(
    "R11_spearman_of_metrics",
    sql(
        """select a.metric as x, z.metric as y, count(*) as n, round(corr(a.r, z.r), 6) as r
from rk a join rk z using (strategy) group by 1, 2""",
        "curve",
        extra=METRIC_SCORES
        + """,
mean_scores as (select strategy, metric, avg(value) as value from metric_scores group by 1, 2),
rk as (select strategy, metric, rank() over (partition by metric order by value) +
  (count(*) over (partition by metric, value) - 1) / 2.0 as r from mean_scores)""",
    ),
)
def _(t: Tables):
    means = _metric_scores(t).groupBy("strategy", "metric").agg(F.avg("value").alias("value"))
    return sim.spearman_matrix(means, "metric", "strategy")


GOLD = """gold as (select strategy, avg(value) as total from scores group by 1),
gp as (select setting as x_name, v.strategy as item, v.total as x, g.total as y
  from vectors v join gold g using (strategy))"""


def _gold(t: Tables) -> DataFrame:
    return _scores(t).groupBy("strategy").agg(F.avg("value").alias("total"))


@query(
    "R12_agreement_with_gold",
    sql(
        f"""select x_name as setting, n, round(tau, 6) as tau from ({_tau('gp', 'x_name')})""",
        "runs",
        extra=",\n".join([VALUES, VECTORS, GOLD]),
    ),
)
def _(t: Tables):
    return sim.agreement_with(_vectors(t), _gold(t), ["setting"])


@query(
    "R13_significant_tau",
    sql(
        f"""select x_name as setting, n, round(case when abs(3 * tau * sqrt(n * (n - 1))
  / sqrt(2 * (2 * n + 5))) > 1.959963984540054 then tau end, 6) as tau
from ({_tau('gp', 'x_name')})""",
        "runs",
        extra=",\n".join([VALUES, VECTORS, GOLD]),
    ),
)
def _(t: Tables):
    taus = sim.agreement_with(_vectors(t), _gold(t), ["setting"])
    return sim.significant_only(taus).select("setting", "n", "tau")


EXACT = """signs as (select i.x_name, sign(i.x - j.x) as sx, sign(i.y - j.y) as sy
  from gp i join gp j on i.x_name = j.x_name and i.item < j.item),
sizes as (select x_name, count(*) as n from gp group by 1),
tied as (select x_name, sum(t * (t - 1) * (2 * t + 5)) filter (where side = 'x') as x1,
    sum(t * (t - 1) * (2 * t + 5)) filter (where side = 'y') as y1,
    sum(t * (t - 1) * (t - 2)) filter (where side = 'x') as x0,
    sum(t * (t - 1) * (t - 2)) filter (where side = 'y') as y0
  from (select x_name, 'x' as side, count(*) as t from gp group by x_name, x
        union all select x_name, 'y', count(*) from gp group by x_name, y) group by 1),
counted as (select x_name, n, count(*) as every, sum((sx * sy < 0)::int) as discord,
    sum((sx = 0)::int) as tx, sum((sy = 0)::int) as ty, sum(sx * sy) as score
  from signs join sizes using (x_name) group by 1, 2),
inversions as (with recursive r(n, counts) as (select 1, [1::double] union all
    select n + 1, list_transform(range(0, (n + 1) * n // 2 + 1),
      lambda k: list_sum(counts[greatest(k - n, 0) + 1 : least(k, n * (n - 1) // 2) + 1])) from r where n < 33)
  select n, c, list_sum(counts[1 : c + 1]) / list_sum(counts) as p
  from (select n, counts, unnest(range(0, n * (n - 1) // 2 + 1)) as c from r)),
tested as (select x_name, c.n, score / nullif(sqrt((every - tx) * 1.0 * (every - ty)), 0) as tau,
    least(1.0, 2 * p) as p,
    score / nullif(sqrt((2.0 * every * (2 * c.n + 5) - x1 - y1) / 18 + tx * ty * 1.0 / every
      + coalesce(x0 * y0 / nullif(18.0 * every * (c.n - 2), 0), 0)), 0) as z
  from counted c join tied using (x_name)
  left join inversions v on v.n = c.n and tx = 0 and ty = 0 and v.c = least(discord, every - discord))"""


@query(
    "R13_exact_significance",
    sql(
        """select x_name as setting, n, round(tau, 6) as tau, round(p, 6) as p, round(z, 6) as z,
  coalesce(p < 0.05, abs(z) > 1.959963984540054) as significant from tested""",
        "runs",
        extra=",\n".join([VALUES, VECTORS, GOLD, EXACT]),
    ),
)
def _(t: Tables):
    pairs = _vectors(t).select("setting", "strategy", F.col("total").alias("x")).join(
        _gold(t).select("strategy", F.col("total").alias("y")), "strategy"
    )
    return sim.tau_significance(pairs, ["setting"])


METRIC_BOARDS = """orders_of as (select *, row_number() over (partition by dataset, metric
  order by score, strategy) as place from (
    select dataset, strategy, metric, avg(value) as score from metric_scores group by 1, 2, 3)),
op as (select dataset as x_name, a.strategy as item, a.place as x, b.place as y
  from orders_of a join orders_of b using (dataset, strategy)
  where a.metric = 'full_auc' and b.metric = 'best_value')"""


def _metric_board(t: Tables, metric: str) -> DataFrame:
    return (
        _metric_scores(t)
        .filter(F.col("metric") == metric)
        .groupBy("dataset", "strategy")
        .agg(F.avg("value").alias("score"))
    )


@query(
    "R14_per_dataset_tau",
    sql(
        f"select x_name as dataset, n, round(tau, 6) as tau from ({_tau('op', 'x_name')})",
        "curve",
        extra=METRIC_SCORES + ",\n" + METRIC_BOARDS,
    ),
)
def _(t: Tables):
    return sim.tau_between(
        _metric_board(t, "full_auc"), _metric_board(t, "best_value"), ["dataset"]
    )


REPLICATES = 5000
BOOT = f"""ds as (select dataset, row_number() over (order by dataset) - 1 as spot,
  count(*) over () as n from (select distinct dataset from metric_scores)),
draws as (select r.replicate, ('0x' || (md5('0|' || r.replicate || '|' || spot))[1:12])::bigint % n as spot
  from ds cross join (select cast(unnest(range({REPLICATES})) as integer) as replicate) r),
means_of as (select d.replicate, b.metric, b.strategy, round(avg(score), 9) as score
  from draws d join ds using (spot) join (select dataset, strategy, metric, avg(value) as score
    from metric_scores group by 1, 2, 3) b using (dataset) group by 1, 2, 3),
places as (select *, row_number() over (partition by replicate, metric order by score, strategy)
  as place from means_of),
bp as (select a.replicate as x_name, a.strategy as item, a.place as x, b.place as y
  from places a join places b using (replicate, strategy)
  where a.metric = 'full_auc' and b.metric = 'best_value'),
taus as ({_tau('bp', 'x_name')})"""


def _boot(t: Tables) -> DataFrame:
    return sim.bootstrap_tau(
        _metric_board(t, "full_auc"), _metric_board(t, "best_value"), REPLICATES
    )


@query(
    "R15_bootstrap_tau",
    sql(
        "select x_name as replicate, n, round(tau, 6) as tau from taus",
        "curve",
        extra=METRIC_SCORES + ",\n" + BOOT,
    ),
)
def _(t: Tables):
    return _boot(t)


@query(
    "R16_percentile_summary",
    sql(
        """select strategy, count(value) as n, round(median(value), 6) as median,
  round(quantile_cont(value, 0.025), 6) as p_lo, round(quantile_cont(value, 0.975), 6) as p_hi
from scores group by strategy""",
        "runs",
        extra=VALUES,
    ),
)
def _(t: Tables):
    return sim.percentile_summary(_scores(t), ["strategy"], "value")


@query(
    "R17_align_boards",
    sql(
        """select batch, dataset, strategy, round(score, 6) as score from b
where dataset in (select dataset from b group by 1 having count(distinct batch) =
    (select count(distinct batch) from b))
  and strategy in (select strategy from b group by 1 having count(distinct batch) =
    (select count(distinct batch) from b))""",
        "runs",
        extra=VALUES
        + """,
b as (select batch, dataset, strategy, avg(value) as score from (
    select * exclude (value), case when not (batch = 'BUILDING' and (dataset in (1, 2)
      or strategy = '5-LOW')) then value end as value from scores) group by all
  having avg(value) is not null)""",
    ),
)
def _(t: Tables):
    known = F.expr("not (batch = 'BUILDING' and (dataset in (1, 2) or strategy = '5-LOW'))")
    boards = (
        _scores(t)
        .groupBy("batch", "dataset", "strategy")
        .agg(F.avg(F.when(known, F.col("value"))).alias("score"))
    )
    return sim.align_boards(boards, "batch").select("batch", "dataset", "strategy", "score")


LABELLED = """labelled as (
  select run_id, strategy || ' (' || learner || ')' as label, dataset, start_point, value
  from scores),
label_cells as (select label, dataset, avg(value) as value from labelled group by 1, 2),
label_matrix as (select a.label as x, z.label as y, corr(a.value, z.value) as r
  from label_cells a join label_cells z using (dataset) group by 1, 2)"""


def _label_matrix(t: Tables) -> DataFrame:
    label = F.concat("strategy", F.lit(" ("), "learner", F.lit(")"))
    cells = _scores(t).groupBy(label.alias("label"), "dataset").agg(F.avg("value").alias("value"))
    return sim.pearson_matrix(cells, "label", "dataset").drop("n")


@query(
    "R18_framework_means",
    sql(
        """select regexp_extract(x, '\\(([^)]*)\\)', 1) as group_x,
  regexp_extract(y, '\\(([^)]*)\\)', 1) as group_y,
  round(avg(r), 6) as mean, round(stddev_pop(r), 6) as std from label_matrix group by 1, 2""",
        "runs",
        extra=VALUES + ",\n" + LABELLED,
    ),
)
def _(t: Tables):
    return sim.framework_means(_label_matrix(t))


SCENARIO_VECTORS = """vectors as (select learner as scenario, batch as value_of, strategy,
  avg(value) as total from scores group by 1, 2, 3),
gold as (select strategy, avg(value) as total from scores group by 1),
with_gold as (select scenario, value_of, strategy, total from vectors union all
  select s.scenario, 'gold', strategy, total from gold
    cross join (select distinct scenario from vectors) s),
sp as (select a.scenario, a.value_of as x_name, b.value_of as y_name, a.strategy as item,
  a.total as x, b.total as y from with_gold a join with_gold b using (scenario, strategy))"""


def _scenario_matrices(t: Tables) -> DataFrame:
    vectors = (
        _scores(t)
        .withColumnRenamed("value", "score")
        .groupBy(F.col("learner").alias("scenario"), F.col("batch").alias("value"), "strategy")
        .agg(F.avg("score").alias("total"))
    )
    return sim.scenario_matrices(vectors, _gold(t))


@query(
    "R19_mean_matrix",
    sql(
        f"""select x_name, y_name, round(avg(coalesce(tau, 0)), 6) as mean
from ({_tau('sp', 'scenario, x_name, y_name')}) group by 1, 2""",
        "runs",
        extra=VALUES + ",\n" + SCENARIO_VECTORS,
    ),
)
def _(t: Tables):
    return sim.mean_matrix(_scenario_matrices(t))


@query(
    "R20_scenario_matrices",
    sql(
        f"""select scenario, x_name, y_name, n, round(tau, 6) as tau
from ({_tau('sp', 'scenario, x_name, y_name')})""",
        "runs",
        extra=VALUES + ",\n" + SCENARIO_VECTORS,
    ),
)
def _(t: Tables):
    return _scenario_matrices(t)


@query(
    "R21_row_means",
    sql(
        "select x, round(avg(r), 6) as total from label_matrix group by x",
        "runs",
        extra=VALUES + ",\n" + LABELLED,
    ),
)
def _(t: Tables):
    return sim.row_means(_label_matrix(t))


FP_VECTORS = """v as (select fingerprint, strategy, value from full_mean),
pr as (select min(fingerprint) as a, max(fingerprint) as b from (
    select fingerprint, (row_number() over (order by fingerprint) - 1) // 2 as p
    from (select distinct fingerprint from v)) group by p having count(*) = 2),
pv as (select a, b, x.strategy as item, x.value as x, y.value as y from pr
  join v x on x.fingerprint = a join v y on y.fingerprint = b and y.strategy = x.strategy)"""


def _fp_pairs(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Every fingerprint with its neighbour in order, and all vectors."""
    vectors = t.full_mean.select("fingerprint", "strategy", "value")
    return sim.neighbour_pairs(vectors.select("fingerprint").distinct()), vectors


@query(
    "R22_pair_correlations",
    sql(
        "select a, b, count(*) as n, round(corr(x, y), 6) as r from pv group by 1, 2",
        "full_mean",
        extra=FP_VECTORS,
    ),
)
def _(t: Tables):
    return sim.pair_correlations(*_fp_pairs(t)).select("a", "b", "n", "r")


@query(
    "R22_pair_taus",
    sql(
        f"select a, b, n, round(tau, 6) as tau from ({_tau('pv', 'a, b')})",
        "full_mean",
        extra=FP_VECTORS,
    ),
)
def _(t: Tables):
    return sim.pair_taus(*_fp_pairs(t))


@query("R23_eliminate_redundant")
def _(t: Tables):
    vectors = t.full_mean.select("fingerprint", "strategy", "value")
    return sim.eliminate_redundant(vectors, threshold=0.9)


@query(
    "R23_greedy_elimination",
    sql(
        """select fingerprint, list_contains((select kept from walk order by i desc limit 1), fingerprint) as kept
from prints""",
        "full_mean",
        extra="""prints as materialized (select fingerprint, row_number() over (order by fingerprint) as i
  from (select distinct fingerprint from full_mean)),
near as materialized (select b, list(a) as smaller from (
  select x.fingerprint as a, y.fingerprint as b, corr(x.value, y.value) as r
  from full_mean x join full_mean y on x.strategy = y.strategy and x.fingerprint < y.fingerprint
  group by 1, 2) where r > 0.9 and not isnan(r) group by b),
walk as (with recursive w(i, kept) as (select 0::bigint, []::bigint[] union all
  select w.i + 1, case when list_has_any(coalesce(n.smaller, []), w.kept) then w.kept
    else list_append(w.kept, p.fingerprint) end
  from w join prints p on p.i = w.i + 1 left join near n on n.b = p.fingerprint) select * from w)""",
    ),
)
def _(t: Tables):
    vectors = t.full_mean.select("fingerprint", "strategy", "value")
    return red.independent(vectors, threshold=0.9).select("fingerprint", "kept")


@query(
    "R23_first_elimination_round",
    sql(
        """select a, b, round(corr(x.value, y.value), 6) as r from (
  select min(fingerprint) as a, max(fingerprint) as b from (
    select fingerprint, (row_number() over (order by fingerprint) - 1) // 2 as p
    from (select distinct fingerprint from full_mean)) group by p having count(*) = 2)
join full_mean x on x.fingerprint = a
join full_mean y on y.fingerprint = b and x.strategy = y.strategy group by 1, 2
having corr(x.value, y.value) > 0.5""",
        "full_mean",
    ),
)
def _(t: Tables):
    vectors = t.full_mean.select("fingerprint", "strategy", "value")
    pairs = sim.neighbour_pairs(vectors.select("fingerprint").distinct())
    return sim.pair_correlations(pairs, vectors).filter("r > 0.5").select("a", "b", "r")


@query(
    "R24_without_labels",
    sql(
        """select x, y, round(r, 6) as r from label_matrix
where x not like '%LOW%' and y not like '%LOW%' and x not like '%(P)%' and y not like '%(P)%'""",
        "runs",
        extra=VALUES + ",\n" + LABELLED,
    ),
)
def _(t: Tables):
    return sim.without_labels(_label_matrix(t), ["LOW", "(P)"])


@query(
    "R25_column_pair",
    sql(
        """select a.strategy, round(a.total, 6) as first, round(b.total, 6) as second
from vectors a join vectors b using (strategy)
where a.setting = 'BUILDING' and b.setting = 'MACHINERY'""",
        "runs",
        extra=VALUES + ",\n" + VECTORS,
    ),
)
def _(t: Tables):
    return sim.column_pair(_vectors(t), "setting", "BUILDING", "MACHINERY")


@query(
    "R26_curve_rank_correlation",
    sql(
        """select fingerprint, a.strategy as x, z.strategy as y, count(*) as n,
  round(corr(a.r, z.r), 6) as r
from rk a join rk z using (fingerprint, cycle) group by 1, 2, 3""",
        "curve",
        extra="""rk as (select fingerprint, strategy, cycle, rank() over
    (partition by fingerprint, strategy order by value)
  + (count(*) over (partition by fingerprint, strategy, value) - 1) / 2.0 as r from curve
  where value is not null)""",
    ),
)
def _(t: Tables):
    cells = t.curve.select("fingerprint", "strategy", "cycle", "value")
    return sim.curve_rank_correlation(cells, "strategy", ["fingerprint"])


# --- scenarios --------------------------------------------------------------


def _scenarios(t: Tables, largest: int) -> DataFrame:
    """Scenario rows: every nation repeats the sample sizes 1 to ``largest``."""
    sizes = F.explode(F.sequence(F.lit(1), F.lit(largest))).alias("k")
    return t.given("nation").select("n_nationkey", sizes).select(
        (F.col("n_nationkey") * largest + F.col("k") - 1).alias("scenario"), "k"
    )


def _scenario_cte(largest: int) -> str:
    return f"""scenarios as (select cast(n_nationkey * {largest} + k - 1 as integer) as scenario,
  cast(k as integer) as k from nation, (select unnest(generate_series(1, {largest})) as k))"""


def _sample_cte(dimension: str) -> str:
    return f"""samples_of as (select scenario, k, v as {dimension} from (
  select s.*, d.{dimension} as v, row_number() over (partition by scenario
    order by md5('0|' || scenario || '|' || d.{dimension}), d.{dimension}) as rn
  from scenarios s cross join (select distinct {dimension} from scores) d) where rn <= k),
picked as (select s.scenario, s.k, r.* from samples_of s join scores r using ({dimension}))"""


SCENARIO_BOARD = board_ctes("picked", ("scenario", "k"), "average_of_same_strategy", "robust")
SCENARIO_TOTALS = """select scenario, k, strategy, round(avg(score), 6) as total
from board group by all"""


@query(
    "N1_start_point_scenario",
    sql(
        SCENARIO_TOTALS,
        "runs",
        extra=",\n".join([VALUES, _scenario_cte(5), _sample_cte("start_point"), SCENARIO_BOARD]),
    ),
)
def _(t: Tables):
    return sc.value_scenarios(_scores(t), _scenarios(t, 5), "start_point")


def _many(t: Tables, largest: int, repeats: int) -> DataFrame:
    """25 x ``largest`` x ``repeats`` scenarios, the first 25 x ``largest`` as ``_scenarios`` has them."""
    per = F.lit(25 * largest)
    again = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    rows = _scenarios(t, largest).withColumn("__again", again)
    return rows.select((F.col("scenario") + per * F.col("__again")).cast("int").alias("scenario"), "k")


@query("N1_start_point_3000")
def _(t: Tables):
    return sc.value_scenarios(_scores(t), _many(t, 5, 24), "start_point")


@query("N3_dataset_3000")
def _(t: Tables):
    return sc.value_scenarios(_scores(t), _many(t, 6, 20), "dataset")


@query(
    "N2_fixed_start_point_scenario",
    sql(
        SCENARIO_TOTALS,
        "runs",
        extra=",\n".join(
            [
                VALUES.replace("from runs", "from runs where learner = 'F' and batch = 'BUILDING' and dataset < 10"),
                _scenario_cte(4),
                _sample_cte("start_point").replace(
                    "join scores r using (start_point))",
                    "join scores r using (start_point)\n  union all by name select 1000 as "
                    "scenario, null as k, * from scores)",
                ),
                board_ctes("picked", ("scenario",), "average_of_same_strategy", "robust"),
            ]
        ),
    ).replace("select scenario, k, strategy", "select scenario, strategy"),
)
def _(t: Tables):
    rows = _scenarios(t, 4)
    everything = rows.agg(F.lit(1000).alias("scenario"), F.lit(None).cast("int").alias("k"))
    fixed = (F.col("learner") == "F") & (F.col("batch") == "BUILDING") & (F.col("dataset") < 10)
    boards = sc.value_scenarios(
        _scores(t), rows.unionByName(everything), "start_point", fixed=fixed
    )
    return boards.drop("k")


@query(
    "N3_dataset_scenario",
    sql(
        SCENARIO_TOTALS,
        "runs",
        extra=",\n".join([VALUES, _scenario_cte(6), _sample_cte("dataset"), SCENARIO_BOARD]),
    ),
)
def _(t: Tables):
    return sc.value_scenarios(_scores(t), _scenarios(t, 6), "dataset")


GROUP = list(sc.GROUP)


def _group_cte(scores: str = "scores") -> str:
    g = ", ".join(GROUP)
    return f"""numbered as (select *, row_number() over (order by {g}) - 1 as at_
  from (select distinct {g} from {scores})),
wanted as (select scenario, k, j, least(k, n) as kk, n,
    cast(floor(j * n / least(k, n)) as bigint) as low,
    cast(floor((j + 1) * n / least(k, n)) as bigint) as top,
    cast(('0x' || substr(md5('0|' || scenario || '|' || j), 1, 12)) as bigint) / 281474976710656.0 as u
  from sized, (select count(*) as n from numbered), lateral (select unnest(range(least(k, n))) as j)),
groups_of as (select w.scenario, w.k, m.* from wanted w
  join numbered m on m.at_ = w.low + cast(floor(w.u * (w.top - w.low)) as bigint)),
picked as (select q.scenario, q.k, r.* from groups_of q join {scores} r using ({g}))"""


SIZED = "sized as (select scenario, k * 200 as k from scenarios)"


@query(
    "N4_group_scenario",
    sql(
        SCENARIO_TOTALS,
        "runs",
        extra=",\n".join([VALUES, _scenario_cte(3), SIZED, _group_cte(), SCENARIO_BOARD]),
    ),
)
def _(t: Tables):
    sized = _scenarios(t, 3).withColumn("k", F.col("k") * 200)
    return sc.group_scenarios(_scores(t), sized)


@query(
    "N5_reduced_group_scenario",
    sql(
        SCENARIO_TOTALS.replace("strategy, round", "strategy, 'bucket' as parameter, round"),
        "runs",
        extra=",\n".join(
            [
                VALUES.replace("scores as", "all_scores as"),
                "scores as (select * from all_scores where bucket = "
                "(select min(bucket) from all_scores))",
                _scenario_cte(3),
                SIZED,
                _group_cte(),
                SCENARIO_BOARD,
            ]
        ),
    ),
)
def _(t: Tables):
    sized = _scenarios(t, 3).withColumn("k", F.col("k") * 200)
    return sc.reduced_group_scenarios(_scores(t), sized, "bucket")


LIMITS = {"dataset": 20, "start_point": 19, "bucket": 5, "batch": 3, "learner": 2}


@query("N6_budget_scenario")
def _(t: Tables):
    rows = _scenarios(t, 4).select("scenario", (F.col("k") * 100).alias("budget"))
    return sc.budget_scenarios(_scores(t), rows, LIMITS)


@query("N7_single_value_scenario")
def _(t: Tables):
    targets = _scores(t).select("learner").distinct().select(
        F.explode(F.sequence(F.lit(0), F.lit(2))).alias("scenario"),
        F.lit("learner").alias("target"),
        F.col("learner").alias("target_value"),
    )
    return sc.single_value_scenarios(_scores(t), targets)


@query(
    "N8_split_label",
    sql(
        """select run_id, 'adv' as scenario_kind, run_id as scenario, 'EXP_' || learner as parameter,
  cast(bucket as varchar) as setting, start_point as budget from runs""",
        "runs",
    ),
)
def _(t: Tables):
    label = F.concat(
        F.lit("adv: ("),
        F.concat_ws(
            ", ",
            F.col("run_id").cast("string"),
            F.concat(F.lit("'EXP_"), "learner", F.lit("'")),
            F.col("bucket").cast("string"),
            F.col("start_point").cast("string"),
        ),
        F.lit(")"),
    )
    return sc.split_label(t.runs.select("run_id", label.alias("label"))).drop("label")


TAUS_BY_K = ",\n".join(
    [
        VALUES,
        _scenario_cte(6),
        _sample_cte("dataset"),
        SCENARIO_BOARD,
        """gold as (select strategy, avg(value) as total from scores group by 1),
kp as (select scenario, k, t.strategy as item, t.total as x, g.total as y from (
  select scenario, k, strategy, avg(score) as total from board group by all) t
  join gold g using (strategy))""",
    ]
)


def _taus_by_k(t: Tables) -> DataFrame:
    vectors = sc.value_scenarios(_scores(t), _scenarios(t, 6), "dataset")
    return sim.agreement_with(vectors, _gold(t), ["scenario", "k"])


@query(
    "N9_tau_by_size",
    sql(
        f"""select k, round(min(tau), 6) as lowest, round(avg(tau), 6) as mean,
  round(max(tau), 6) as highest from ({_tau('kp', 'scenario, k')}) group by k""",
        "runs",
        extra=TAUS_BY_K,
    ),
)
def _(t: Tables):
    return sc.tau_by_size(_taus_by_k(t))


@query("N10_cubic_trend")
def _(t: Tables):
    curve = t.curve.groupBy("cycle").agg(F.avg("value").alias("mean"))
    return sc.cubic_trend(curve, "cycle", "mean")

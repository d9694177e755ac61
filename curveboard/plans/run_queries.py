"""Queries for sources, run grids, curation and reports."""

from __future__ import annotations

import lzma
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curveboard.functions.lists import parse_list, show_list
from curveboard.operators import curate, grid, reports
from curveboard.operators.registry import for_each_row
from curveboard.plans.catalog import query
from curveboard.plans.testbed import Tables, sql
from curveboard.schema import DIMS
from curveboard.session import shared_folder
from curveboard.sources import tables as src

KEYS = ", ".join(DIMS)

# --- sources ----------------------------------------------------------------


def _scratch(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "S1_read_table",
    "select o_orderkey, o_orderstatus, round(o_totalprice, 6) as o_totalprice from orders",
)
def _(t: Tables):
    return src.read_table(
        t.spark,
        f"{t.path}/orders.parquet",
        columns=["o_orderkey", "o_orderstatus", "o_totalprice"],
    )


def _xz_files(t: Tables, broken: bool = False) -> DataFrame:
    """The run table as xz-compressed CSV files of up to a thousand runs each."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            contents = []
            for text, cut in zip(files["text"], files["cut"]):
                raw = text.encode()
                # a dictionary of the text's size: the default one costs more than short texts themselves
                size = min(8 << 20, max(4096, 1 << len(raw).bit_length()))
                content = lzma.compress(raw, filters=[{"id": lzma.FILTER_LZMA2, "preset": 6, "dict_size": size}])
                contents.append(content[: len(content) // 2] if cut else content)
            yield pd.DataFrame({"path": files["path"], "content": contents})

    def named(column: str, missing: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(missing))

    rows = t.runs.select("strategy", "dataset", "run_id", "learner")
    part = F.floor(F.col("run_id") / 1000).alias("part")
    line = F.concat(named("run_id", "nan"), F.lit(","), named("learner", "None"), F.lit("\n"))
    packed = rows.groupBy("strategy", "dataset", part).agg(F.collect_list(line).alias("lines"))
    path = F.concat(
        F.lit("/results/"), named("strategy", "None"), F.lit("/"), named("dataset", "nan"),
        F.lit("/part-"), named("part", "nan"), F.lit(".csv.xz"),
    )
    texts = packed.select(
        path.alias("path"),
        F.concat(F.lit("run_id,learner\n"), F.array_join("lines", "")).alias("text"),
        (F.lit(broken) & F.coalesce(F.col("dataset") % 5 == 0, F.lit(False))).alias("cut"),
    )
    return texts.mapInPandas(pack, "path string, content binary")


@query("S2_xz_csv", sql("select run_id, learner from runs", "runs"))
def _(t: Tables):
    cells = src.decode_xz(_xz_files(t))
    return cells.select(
        F.col("cells")["run_id"].cast("long").alias("run_id"), F.col("cells")["learner"].alias("learner")
    )


def _paths(t: Tables) -> DataFrame:
    """File paths of a result tree, derived from the runs."""
    name = (
        F.when(F.col("bucket") % 3 == 0, "accuracy.csv.xz")
        .when(F.col("bucket") % 3 == 1, "macro_f1.csv.xz.parquet")
        .otherwise("05_done_workload.csv.xz")
    )
    return t.runs.select(
        F.concat_ws("/", F.lit("/results"), "strategy", F.col("dataset").cast("string"), name)
        .alias("path")
    ).distinct()


PATHS = """paths as (
  select distinct strategy, cast(dataset as varchar) as dataset,
    case bucket % 3 when 0 then 'accuracy' when 1 then 'macro_f1' else '05_done_workload' end
      as metric,
    '/results/' || strategy || '/' || dataset || '/' ||
    case bucket % 3 when 0 then 'accuracy.csv.xz' when 1 then 'macro_f1.csv.xz.parquet'
      else '05_done_workload.csv.xz' end as path
  from runs)"""


@query(
    "S3_discover_metric_files",
    sql("select * from paths where metric <> '05_done_workload'", "runs", extra=PATHS),
)
def _(t: Tables):
    return src.parse_metric_paths(_paths(t))


@query(
    "S4_metric_lookup",
    sql(
        """select run_id, cycle, round(value, 6) as value from curve
where strategy = 'click' and dataset = 3""",
        "curve",
    ),
)
def _(t: Tables):
    stored = t.curve.withColumn("metric", F.lit("accuracy"))
    return src.metric_lookup(stored, "click", 3, "accuracy").select("run_id", "cycle", "value")


def _tree(t: Tables) -> str:
    """A result tree written from the curves: by dataset as CSV, as Parquet, or as both.

    Where both stand, the values of the Parquet files are off by 1000, so reading them shows.
    """
    root = f"{shared_folder(t.spark)}/tree-{uuid.uuid4().hex}"
    rows = t.curve.select(
        "strategy", "dataset", F.lit("accuracy").alias("metric"), "run_id", "cycle", "value"
    ).filter("strategy <> 'view'")
    turn = F.col("dataset") % 3
    by = ["strategy", "dataset", "metric"]
    off = rows.withColumn("value", F.when(turn == 2, F.col("value") + 1000).otherwise(F.col("value")))
    rows.filter(turn != 1).write.partitionBy(*by).option("header", True).csv(root)
    off.filter(turn != 0).write.mode("append").partitionBy(*by).parquet(root)
    return root


@query(
    "S3_listed_tree",
    sql(
        """select distinct strategy, cast(dataset as varchar) as dataset, 'accuracy' as metric, f as format
from curve join (values (0, 'csv'), (2, 'csv'), (1, 'parquet'), (2, 'parquet')) v(turn, f)
  on turn = dataset % 3 where strategy <> 'view'""",
        "curve",
    ),
)
def _(t: Tables):
    return src.listed_tree(t.spark, _tree(t)).select("strategy", "dataset", "metric", "format")


@query(
    "S4_lookup_with_fallback",
    sql(
        """select strategy, cast(dataset as varchar) as dataset, run_id, cast(cycle as bigint) as cycle,
  round(value, 6) as value from curve where strategy <> 'view'""",
        "curve",
    ),
)
def _(t: Tables):
    schema = T.StructType.fromDDL("run_id long, cycle long, value double")
    rows = src.tree_rows(t.spark, _tree(t), schema, "accuracy")
    return rows.select("strategy", "dataset", "run_id", "cycle", "value")


@query(
    "S5_strategy_dataset_pairs",
    sql(
        """select distinct strategy, dataset from paths
where metric <> '05_done_workload' and strategy <> '5-LOW'""",
        "runs",
        extra=PATHS,
    ),
)
def _(t: Tables):
    return src.strategy_dataset_pairs(src.parse_metric_paths(_paths(t)), ["5-LOW"])


@query(
    "S6_corrupt_files",
    sql(
        """select distinct '/results/' || strategy || '/' || dataset || '/part-' ||
  run_id // 1000 || '.csv.xz' as path, dataset % 5 = 0 as broken from runs""",
        "runs",
    ),
)
def _(t: Tables):
    health = src.probe_files(_xz_files(t, broken=True))
    return health.select("path", F.col("error").isNotNull().alias("broken"))


def _item_cells(t: Tables) -> DataFrame:
    """Per line a list literal of part, supplier and number; every seventh part is nan."""
    part = F.when(F.col("l_partkey") % 7 == 0, "nan").otherwise(F.col("l_partkey").cast("string"))
    text = F.concat(F.lit("["), F.concat_ws(", ", part, "l_suppkey", "l_linenumber"), F.lit("]"))
    return t.given("lineitem").select(F.col("l_orderkey").alias("run_id"), text.alias("cell"))


ITEM_LISTS = """select l_orderkey as run_id, 3 as n,
  2 + case when l_partkey % 7 > 0 then 1 else 0 end as filled,
  l_suppkey + l_linenumber + case when l_partkey % 7 > 0 then l_partkey else 0 end as total
from lineitem"""


def _list_facts(df: DataFrame, column: str) -> DataFrame:
    known = F.filter(column, lambda x: x.isNotNull())
    return df.select(
        "run_id",
        F.size(column).alias("n"),
        F.size(known).alias("filled"),
        F.aggregate(known, F.lit(0).cast("long"), lambda s, x: s + x.cast("long")).alias("total"),
    )


@query("S7_parse_list", ITEM_LISTS)
def _(t: Tables):
    return _list_facts(_item_cells(t).select("run_id", parse_list(F.col("cell")).alias("v")), "v")


@query("S8_lists_to_arrays", ITEM_LISTS)
def _(t: Tables):
    arrays = src.wide_list_to_arrays(_item_cells(t), ["run_id"], "int")
    # a second pass leaves native arrays alone
    return _list_facts(src.repair_list_columns(arrays), "cell")


@query(
    "S9_S10_write_and_read_back",
    sql("select run_id, dataset, strategy, round(value, 6) as value from runs", "runs"),
)
def _(t: Tables):
    path = _scratch(t, "runs")
    rows = t.runs.select("run_id", "dataset", "strategy", "value")
    src.write_table(rows, f"{path}/csv", fmt="csv")
    src.convert_to_parquet(t.spark, f"{path}/csv", f"{path}/runs.parquet", rows.schema)
    return src.read_table(t.spark, f"{path}/runs.parquet")


@query(
    "S11_append_rows",
    sql("select status, count(*) as runs from runs group by status", "runs"),
)
def _(t: Tables):
    path = _scratch(t, "appended")
    for status in ("done", "open", "failed"):
        src.append_rows(t.runs.filter(F.col("status") == status).select("run_id", "status"), path)
    return t.spark.read.parquet(path).groupBy("status").agg(F.count(F.lit(1)).alias("runs"))


@query(
    "S12_separator_csv",
    "select p_partkey, p_size, round(p_retailprice, 6) as p_retailprice from part",
)
def _(t: Tables):
    path = _scratch(t, "separated")
    rows = t.given("part").select("p_partkey", "p_size", "p_retailprice")
    rows.write.option("header", True).option("sep", ";").csv(path)
    return src.read_table(t.spark, path, rows.schema, sep=";")


# --- run grids --------------------------------------------------------------


@query(
    "W1_grid",
    sql(
        """select * from (select distinct dataset from runs), (select distinct strategy from runs),
  (select distinct learner from runs), (select distinct batch from runs)""",
        "runs",
    ),
)
def _(t: Tables):
    return grid.grid_of({c: t.runs.select(c) for c in ["dataset", "strategy", "learner", "batch"]})


@query(
    "W2_exclude_done_elsewhere",
    sql(
        """select run_id from runs o where status <> 'done' and not exists (
  select 1 from runs d where d.status = 'done' and d.dataset = o.dataset
    and d.strategy = o.strategy and d.batch = o.batch and d.start_point = o.start_point)""",
        "runs",
    ),
)
def _(t: Tables):
    done = t.runs.filter("status = 'done'")
    keys = ["dataset", "strategy", "batch", "start_point"]
    open_rows = t.runs.filter("status <> 'done'")
    return grid.exclude_done_elsewhere(open_rows, [done], keys).select("run_id")


@query(
    "W3_shuffle_and_number",
    sql(
        """select dataset, strategy, learner, batch, 1000 + row_number() over (order by
  md5('0|' || dataset || '|' || strategy || '|' || learner || '|' || batch)) - 1 as run_id
from (select distinct dataset, strategy, learner, batch from runs)""",
        "runs",
    ),
)
def _(t: Tables):
    keys = ["dataset", "strategy", "learner", "batch"]
    return grid.shuffle_and_number(t.runs.select(*keys).distinct(), keys, offset=1000)


@query(
    "W4_refresh_grid",
    sql(
        f"""select {KEYS}, run_id from known
union all
select {KEYS}, (select max(run_id) from runs) + row_number() over
  (order by md5(concat_ws('|', {KEYS}))) as run_id
from (select {KEYS} from runs where status <> 'done' except select {KEYS} from known)""",
        "runs",
        extra=f"""known as (select {KEYS}, min(run_id) as run_id from runs
  where status = 'done' group by {KEYS})""",
    ),
)
def _(t: Tables):
    old = t.runs.filter("status = 'done'")
    return grid.refresh_grid(old, t.runs.filter("status <> 'done'"), DIMS, [t.runs])


@query(
    "W5_subtract",
    sql(
        """select run_id from runs l where status = 'open' and not exists (select 1 from runs r
  where r.status = 'done' and r.dataset = l.dataset and r.strategy = l.strategy
    and r.batch = l.batch and r.bucket = l.bucket and r.start_point = l.start_point)""",
        "runs",
    ),
)
def _(t: Tables):
    keys = ["dataset", "strategy", "batch", "bucket", "start_point"]
    left, right = t.runs.filter("status = 'open'"), t.runs.filter("status = 'done'")
    return grid.subtract(left, right, keys).select("run_id")


ERRORS = """failures as (
  select *, case run_id % 5 when 0 then 'ConvergenceWarning' when 1 then 'OSError'
    when 2 then 'BrokenPipeError' when 3 then 'ValueError' else 'MemoryError' end as error
  from runs where status = 'failed')"""


def _failures(t: Tables) -> DataFrame:
    names = ["ConvergenceWarning", "OSError", "BrokenPipeError", "ValueError", "MemoryError"]
    pick = F.get(F.array(*[F.lit(n) for n in names]), (F.col("run_id") % 5).cast("int"))
    return t.runs.filter("status = 'failed'").withColumn("error", pick)


@query(
    "W6_retry_transient_failures",
    sql(
        "select run_id, error from failures where error in ('ValueError', 'MemoryError')",
        "runs",
        extra=ERRORS,
    ),
)
def _(t: Tables):
    return grid.retryable(_failures(t)).select("run_id", "error")


@query(
    "W7_open_runs",
    sql(
        """select r.run_id from runs r where not exists (
  select 1 from (select dataset, strategy, batch, start_point from failures
                   where error in ('ValueError', 'MemoryError')
                 union all select dataset, strategy, batch, start_point from runs
                   where status = 'done' and bucket < 1998
                 union all select dataset, strategy, batch, start_point from runs
                   where status = 'open' and bucket = 2000) g
  where g.dataset = r.dataset and g.strategy = r.strategy and g.batch = r.batch
    and g.start_point = r.start_point)""",
        "runs",
        extra=ERRORS,
    ),
)
def _(t: Tables):
    keys = ["dataset", "strategy", "batch", "start_point"]
    done = t.runs.filter("status = 'done' and bucket < 1998")
    oom = t.runs.filter("status = 'open' and bucket = 2000")
    return grid.open_runs(t.runs, _failures(t), done, oom, keys).select("run_id")


@query(
    "W8_drop_binary_only",
    sql(
        """select run_id from runs where not (strategy in ('1-URGENT', '5-LOW') and dataset in (
  select c_nationkey from customer group by 1
  having count(distinct cast(floor(c_acctbal / 5000) as bigint)) > 2))""",
        "runs",
    ),
)
def _(t: Tables):
    samples = t.given("customer").select(
        F.col("c_nationkey").alias("dataset"), F.floor(F.col("c_acctbal") / 5000).alias("label")
    )
    return grid.drop_binary_only(t.runs, samples, ["1-URGENT", "5-LOW"]).select("run_id")


@query(
    "W9_drop_incapable",
    sql(
        """select run_id from runs where not (strategy in ('2-HIGH', '3-MEDIUM')
  and learner = 'P')""",
        "runs",
    ),
)
def _(t: Tables):
    learners = t.runs.select("learner").distinct().withColumn(
        "has_decision_function", F.col("learner") != "P"
    )
    return grid.drop_incapable(t.runs, learners, ["2-HIGH", "3-MEDIUM"]).select("run_id")


@query("W10_drop_learner", sql("select run_id from runs where learner <> 'P'", "runs"))
def _(t: Tables):
    return grid.drop_learners(t.runs, ["P"]).select("run_id")


@query(
    "W11_route_local",
    sql(
        """select case when strategy = '5-LOW' then 'local' else 'cluster' end as route,
  count(*) as runs from runs group by 1""",
        "runs",
    ),
)
def _(t: Tables):
    routed = grid.route_local(t.runs, ["5-LOW"])
    return routed.groupBy("route").agg(F.count(F.lit(1)).alias("runs"))


@query(
    "W12_run_hash",
    sql(
        """select run_id, sha256('batch=' || batch || '|bucket=' || bucket || '|dataset=' || dataset
  || '|learner=' || learner || '|start_point=' || start_point || '|strategy=' || strategy)[1:16]
  as hash from runs""",
        "runs",
    ),
)
def _(t: Tables):
    return t.runs.select("run_id", grid.run_hash(DIMS).alias("hash"))


@query(
    "W13_run_identity",
    sql(f"select {KEYS}, count(*) as n from runs group by {KEYS}", "runs"),
)
def _(t: Tables):
    identity = grid.run_identity(DIMS).alias("identity")
    counted = t.runs.groupBy(identity).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*[f"identity.{c}" for c in DIMS], "n")


@query(
    "W14_merge_runs",
    sql(
        "select run_id, status from runs where status in ('done', 'open')",
        "runs",
    ),
)
def _(t: Tables):
    done = t.runs.filter("status = 'done'").select("run_id", "status")
    return grid.merge_runs(done, t.runs.filter("status = 'open'").select("run_id", "status"))


@query(
    "W14_overlap_report",
    sql(
        f"""select 'run_id' as what, count(*) as shared from (
  select run_id from runs where bucket < 1998 intersect select run_id from runs where bucket > 1996)
union all select 'identity', count(*) from (
  select dataset, strategy, batch from runs where bucket < 1998
  intersect select dataset, strategy, batch from runs where bucket > 1996)""",
        "runs",
    ),
)
def _(t: Tables):
    left, right = t.runs.filter("bucket < 1998"), t.runs.filter("bucket > 1996")
    return grid.overlap_report(left, right, ["dataset", "strategy", "batch"])


@query(
    "W15_merge_results",
    sql(
        """select run_id, case when any_value(bucket) < 1999 then 'first' else 'second' end as origin
from runs group by run_id""",
        "runs",
    ),
)
def _(t: Tables):
    first = t.runs.filter("bucket < 1999").select("run_id", F.lit("first").alias("origin"))
    second = t.runs.select("run_id", F.lit("second").alias("origin"))
    return grid.merge_results(first, second)


@query(
    "W16_merge_shards",
    """select l_partkey as run_id, min(l_linenumber) as shard, round(min_by(l_extendedprice,
  (l_linenumber, l_extendedprice)), 6) as price from lineitem group by 1""",
)
def _(t: Tables):
    shards = t.given("lineitem").select(
        F.col("l_partkey").alias("run_id"),
        F.col("l_linenumber").alias("shard"),
        F.col("l_extendedprice").alias("price"),
    )
    return grid.merge_shards(shards, "shard")


@query(
    "W17_check_schema",
    """select 'error' as level, 'required columns' as "check", 'num_queries,seed' as detail
union all select 'info', 'identity columns', 'present'
union all select case when count(*) > count(distinct l_orderkey) then 'error' else 'info' end,
  'unique ids', count(distinct l_orderkey) || ' ids, ' ||
  (count(*) - count(distinct l_orderkey)) || ' duplicates' from lineitem""",
)
def _(t: Tables):
    rows = t.given("lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("dataset")
    )
    return grid.check_schema(rows, ["run_id", "dataset", "seed", "num_queries"], ["dataset"])


@query(
    "W17_duplicate_ids",
    "select l_orderkey as run_id, count(*) as n from lineitem group by 1 having count(*) > 1",
)
def _(t: Tables):
    return grid.duplicate_ids(t.items)


@query(
    "W17_missing_files",
    sql(
        """select distinct case when metric = 'accuracy' then 'error' else 'warning' end as level,
  path as name from paths where dataset in ('1', '2', '3')""",
        "runs",
        extra=PATHS,
    ),
)
def _(t: Tables):
    files = src.parse_metric_paths(_paths(t)).unionByName(
        _paths(t)
        .filter(F.col("path").contains("workload"))
        .select(
            "path",
            F.split("path", "/")[2].alias("strategy"),
            F.split("path", "/")[3].alias("dataset"),
            F.lit("05_done_workload").alias("metric"),
        )
    )
    required = files.select(
        F.col("path").alias("name"), (F.col("metric") == "accuracy").alias("needed")
    )
    present = files.filter(~F.col("dataset").isin("1", "2", "3")).select(F.col("path").alias("name"))
    return grid.missing_required_files(present, required)


@query(
    "W18_orphan_ids",
    """select l_orderkey as run_id, count(*) as n from lineitem
where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F') group by 1""",
)
def _(t: Tables):
    return grid.orphan_ids(t.items, t.runs.filter("status = 'done'"))


@query(
    "W19_duplicate_identities",
    sql(
        "select dataset, strategy, start_point, count(*) as n from runs group by 1, 2, 3 "
        "having count(*) > 1",
        "runs",
    ),
)
def _(t: Tables):
    return grid.duplicate_identities(t.runs, ["dataset", "strategy", "start_point"])


@query(
    "W19_shared_identities",
    sql(
        f"""select {KEYS}, a.n as n_left, b.n as n_right from
(select {KEYS}, count(*) as n from runs where status = 'done' group by all) a join
(select {KEYS}, count(*) as n from runs where status = 'open' group by all) b using ({KEYS})
union all
select {KEYS}, a.n, b.n from
(select {KEYS}, count(*) as n from runs where run_id % 2 = 0 group by all) a join
(select {KEYS}, count(*) as n from runs where run_id % 2 = 1 group by all) b using ({KEYS})""",
        "runs",
    ),
)
def _(t: Tables):
    by_status = grid.shared_identities(
        t.runs.filter("status = 'done'"), t.runs.filter("status = 'open'")
    )
    halves = grid.shared_identities(
        t.runs.filter("run_id % 2 = 0"), t.runs.filter("run_id % 2 = 1")
    )
    return by_status.unionByName(halves)


DENSE = [("start_point", 4), ("bucket", 2), ("batch", 2), ("learner", 2)]


def _dense_sql() -> str:
    steps, last = [], "runs"
    for i, (parameter, cutoff) in enumerate(DENSE):
        others = ", ".join(d for d in DIMS if d != parameter)
        steps.append(
            f"""d{i} as (select * exclude (c) from (select *, count(*) over
  (partition by {others}) as c from {last}) where c >= {cutoff})"""
        )
        last = f"d{i}"
    return sql(f"select run_id from {last}", "runs", extra=",\n".join(steps))


# full settings are too sparse here for four passes, so two dimensions are merged first
@query(
    "W20_prune_dense",
    _dense_sql().replace(
        "c_mktsegment as batch, o_custkey % 20 as start_point",
        "c_mktsegment as batch, o_custkey % 4 as start_point",
    ).replace("cast(year(o_orderdate) as integer) as bucket", "year(o_orderdate) % 2 as bucket"),
)
def _(t: Tables):
    runs = t.runs.withColumn("start_point", F.col("start_point") % 4).withColumn(
        "bucket", F.col("bucket") % 2
    )
    return grid.prune_dense(runs, DENSE).select("run_id")


@query(
    "W21_combination_support",
    sql(
        """select support, count(*) as combinations from (
  select count(*) as support from runs group by dataset, strategy, learner, batch, bucket)
group by support""",
        "runs",
    ),
)
def _(t: Tables):
    return grid.combination_support(t.runs, "start_point")


@query(
    "W22_distinct_values",
    sql(
        """select 'dataset' as parameter, cast(dataset as varchar) as value from runs
union select 'strategy', strategy from runs""",
        "runs",
    ),
)
def _(t: Tables):
    return grid.distinct_values(t.runs, ["dataset", "strategy"])


# --- curation ---------------------------------------------------------------


@query(
    "C1_reduce_to_runs",
    sql(
        """select run_id, round(min_by(value, cycle), 6) as value from lines
where run_id in (select o_orderkey from orders where o_orderstatus = 'F') group by 1""",
        "lines",
    ),
)
def _(t: Tables):
    rows = t.lines.select("run_id", "cycle", "value")
    done = t.runs.filter("status = 'done'")
    return curate.reduce_to_runs(rows, done, order_by=["cycle"]).drop("cycle")


@query(
    "C2_id_coverage",
    """select w.which, i.run_id from (select distinct l_orderkey as run_id from lineitem) i
cross join (values ('done', 'F'), ('open', 'O'), ('failed', 'P')) w(which, s)
where not exists (select 1 from orders where o_orderkey = i.run_id and o_orderstatus = w.s)""",
)
def _(t: Tables):
    tables = {s: t.runs.filter(F.col("status") == s) for s in ("done", "open", "failed")}
    return curate.id_coverage(t.items, tables)


METRIC_ROWS = """metric_rows as (
  select l_suppkey % 10 as strategy, l_orderkey as run_id,
         case l_linenumber % 3 when 0 then 'accuracy' when 1 then 'macro_f1' else 'lag' end as metric
  from lineitem)"""


def _metric_rows(t: Tables) -> DataFrame:
    kind = F.col("l_linenumber") % 3
    metric = F.when(kind == 0, "accuracy").when(kind == 1, "macro_f1").otherwise("lag")
    return t.given("lineitem").select(
        (F.col("l_suppkey") % 10).alias("strategy"),
        F.col("l_orderkey").alias("run_id"),
        metric.alias("metric"),
    )


@query(
    "C3_missing_from_some_metric",
    sql(
        """select strategy, run_id, count(distinct metric) as present, 3::bigint as expected
from metric_rows group by 1, 2 having count(distinct metric) < 3""",
        extra=METRIC_ROWS,
    ),
)
def _(t: Tables):
    return curate.missing_from_some_metric(_metric_rows(t), ["strategy"])


@query(
    "C4_duplicate_combinations",
    sql(
        f"""select first_id, run_id as later_id from (
  select run_id, min(run_id) over (partition by {KEYS}) as first_id from runs)
where run_id <> first_id""",
        "runs",
    ),
)
def _(t: Tables):
    return curate.duplicate_combinations(t.runs)


@query(
    "C5_reconcile_oom",
    sql(
        """select run_id from runs where bucket = 1999 and status not in ('done', 'failed')""",
        "runs",
    ),
)
def _(t: Tables):
    oom = t.runs.filter("bucket = 1999").select("run_id")
    return curate.reconcile_oom(
        oom, t.runs.filter("status = 'done'"), t.runs.filter("status = 'failed'")
    )


@query(
    "C6_purge_runs",
    """select l_orderkey as run_id, count(*) as n from lineitem where l_orderkey not in
  (select o_orderkey from orders where o_orderstatus = 'P') group by 1""",
)
def _(t: Tables):
    kept = curate.purge(t.items, t.runs.filter("status = 'failed'"))
    return kept.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "C7_purge_slow_runs",
    """select l_orderkey as run_id, count(*) as n from lineitem group by 1
having max(l_quantity) <= 40""",
)
def _(t: Tables):
    kept = curate.purge_slow_runs(t.items, t.items, limit=40)
    return kept.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "C8_purge_datasets",
    sql(
        """select l_orderkey as run_id, count(*) as n from lineitem where l_orderkey not in
  (select run_id from runs where dataset in (3, 7) or run_id in (1, 2, 3)) group by 1""",
        "runs",
    ),
)
def _(t: Tables):
    kept = curate.purge_datasets(t.items, t.runs, [3, 7], [1, 2, 3])
    return kept.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "C9_purge_learner",
    """select l_orderkey as run_id, count(*) as n from lineitem where l_orderkey not in
  (select o_orderkey from orders where o_orderstatus = 'O') group by 1""",
)
def _(t: Tables):
    kept = curate.purge_learner(t.items, t.runs, "O")
    return kept.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "C10_drop_repeated_headers",
    "select o_orderkey || ',' || o_orderstatus as value from orders where o_orderkey % 50 > 0",
)
def _(t: Tables):
    text = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus")
    # repeated headers of several widths
    line = (
        F.when(F.col("o_orderkey") % 100 == 0, "run_id,status")
        .when(F.col("o_orderkey") % 50 == 0, "0,1,2,run_id")
        .otherwise(text)
    )
    return curate.drop_repeated_headers(t.given("orders").select(line.alias("value")))


@query(
    "C11_drop_stray_index",
    sql("select run_id, status from runs", "runs"),
)
def _(t: Tables):
    stray = t.runs.select(F.col("run_id").alias("Unnamed: 0"), "run_id", "status")
    return curate.drop_stray_index(stray)


@query(
    "C12_repair_short_rows",
    """select case when o_orderkey % 7 > 0 then o_orderkey end as run_id, k.cycle,
  case when k.cycle <> 1 then round(o_orderkey * 0.5::double + k.cycle, 6) end as value,
  case k.cycle when 1 then '[' || o_custkey || ', ' || o_orderkey || ']'
    else (o_orderkey * 0.5::double + k.cycle)::varchar end as cell,
  case when o_orderkey % 7 = 0 then 'id' end as error
from orders, (values (0), (1), (2)) k(cycle) where k.cycle < 2 or o_orderkey % 3 > 0""",
)
def _(t: Tables):
    key = F.col("o_orderkey")
    first, third = [((key * 0.5) + i).cast("string") for i in (0, 2)]
    # a quoted list of selected samples, and ids that cannot be read
    second = F.format_string('"[%d, %d]"', F.col("o_custkey"), key)
    last = F.when(key % 7 == 0, "lost").otherwise(key.cast("string"))
    short = F.concat(F.concat_ws(",", first, second, last), F.lit(","))
    full = F.concat_ws(",", first, second, third, last)
    lines = t.given("orders").select(F.when(key % 3 == 0, short).otherwise(full).alias("value"))
    return curate.repair_short_rows(lines, header_width=4)


@query(
    "C13_drop_double_logged",
    sql(
        """select run_id, case when w >= 18 then cycle // 2 else cycle end as cycle,
  round(value, 6) as value
from (select *, max(cycle) over (partition by run_id) + 1 as w from curve)
where w < 18 or cycle % 2 = 0""",
        "curve",
    ).replace("cycle // 2 else cycle end", "cast(cycle // 2 as integer) else cast(cycle as integer) end"),
)
def _(t: Tables):
    rows = t.curve.select("run_id", "cycle", "value")
    return curate.drop_double_logged(rows, min_cycles=18)


@query(
    "C14_reduce_precision",
    """select o_orderkey as run_id, round_even(o_totalprice, 1) as value,
  round_even(o_totalprice, 1) as cell from orders""",
)
def _(t: Tables):
    value = F.col("o_totalprice")
    rows = t.given("orders").select(
        F.col("o_orderkey").alias("run_id"), value.alias("value"), F.array(value).alias("cell")
    )
    return curate.reduce_precision(rows, 1).withColumn("cell", F.col("cell")[0])


@query(
    "C15_regroup_by_run",
    sql(
        """select run_id, strategy as metric, cycle, round(value, 6) as value from curve
where dataset not in (1, 2)""",
        "curve",
    ),
)
def _(t: Tables):
    rows = t.curve.select(
        F.col("dataset").alias("path"), "run_id", F.col("strategy").alias("metric"), "cycle", "value"
    )
    done = t.curve.filter("dataset in (1, 2)").select(F.col("dataset").alias("path")).distinct()
    return curate.regroup_by_run(rows, done).drop("path")


@query(
    "C16_recompute_jobs",
    sql(
        """select distinct case when bucket % 3 = 0 then 'TIMELAG' when bucket % 3 = 1
  then 'CATEGORIZATION' else 'ACCURACY' end as kind, strategy, dataset from runs""",
        "runs",
    ),
)
def _(t: Tables):
    kind = F.col("bucket") % 3
    metric = F.when(kind == 0, "accuracy_time_lag").when(kind == 1, "REGION_DENSITY")
    broken = t.runs.select("strategy", "dataset", metric.otherwise("accuracy").alias("metric"))
    return curate.recompute_jobs(broken, ["REGION_DENSITY", "OUTLIERNESS"])


# --- reports ----------------------------------------------------------------


@query(
    "P1_runtime_by_strategy",
    sql(
        """select strategy, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std,
  count(*) as n from (
  select strategy, value from t
  union all
  select s.strategy, 300.0 from (select distinct batch, learner, bucket, dataset from t) f
  cross join (select distinct strategy from t) s
  where not exists (select 1 from t where t.strategy = s.strategy and t.batch = f.batch
    and t.learner = f.learner and t.bucket = f.bucket and t.dataset = f.dataset))
group by strategy""",
        "runs",
        extra="t as (select *exclude(value), value / 1000 as value from runs)",
    ),
)
def _(t: Tables):
    times = t.runs.withColumn("value", F.col("value") / 1000)
    return reports.runtime_by_strategy(times, ["batch", "learner", "bucket", "dataset"])


@query(
    "P2_run_counts",
    sql(
        """select case grouping(dataset) * 2 + grouping(strategy) when 0 then 'dataset,strategy'
  when 1 then 'dataset' else 'strategy' end as "grouping", dataset, strategy, count(*) as runs
from runs group by grouping sets ((dataset, strategy), (dataset), (strategy))""",
        "runs",
    ),
)
def _(t: Tables):
    return reports.run_counts(t.runs)


P3_SETS = [
    ("dataset", "strategy"),
    ("dataset",),
    ("strategy",),
    ("learner",),
    ("batch",),
    ("bucket",),
    ("start_point",),
]


def _p3_sql() -> str:
    dims = sorted({c for s in P3_SETS for c in s})
    parts = []
    for s in P3_SETS:
        cols = ", ".join(c if c in s else f"null as {c}" for c in dims)
        parts.append(
            f"""select '{','.join(s)}' as "grouping", {cols},
  round(avg(seconds), 6) as mean_seconds, count(*) as runs from t group by {', '.join(s)}"""
        )
    return sql(
        "\nunion all by name\n".join(parts),
        "runs",
        extra="""t as (select * from runs join (select l_orderkey as run_id,
  sum(l_quantity) as seconds from lineitem group by 1) using (run_id))""",
    )


@query("P3_mean_times", _p3_sql())
def _(t: Tables):
    totals = t.items.groupBy("run_id").agg(F.sum("value").alias("seconds"))
    return reports.mean_times(t.runs, totals, P3_SETS)


@query(
    "P4_done_matrix",
    sql(
        """select d.dataset, s.strategy, count(r.run_id) filter (where status = 'done') as done,
  count(r.run_id) as total
from (select distinct dataset from f) d cross join (select distinct strategy from f) s
left join f r on r.dataset = d.dataset and r.strategy = s.strategy group by 1, 2""",
        "runs",
        extra="f as (select * from runs where status <> 'failed' and batch in ('BUILDING', 'MACHINERY'))",
    ),
)
def _(t: Tables):
    done, left = t.runs.filter("status = 'done'"), t.runs.filter("status = 'open'")
    return reports.done_matrix(done, left, {"batch": ["BUILDING", "MACHINERY"]})


@query(
    "P5_melt_cycles",
    sql(
        """select g.run_id, g.strategy, g.dataset, cast(c.cycle as integer) as cycle,
  round(v.value, 6) as value
from (select distinct run_id, strategy, dataset from curve) g
cross join (select distinct cycle from curve) c
left join curve v on v.run_id = g.run_id and v.cycle = c.cycle""",
        "curve",
    ),
)
def _(t: Tables):
    from curveboard.operators.series import pivot_cycles

    ids = ["run_id", "strategy", "dataset"]
    return reports.melt_cycles(pivot_cycles(t.curve, ids), ids)


@query(
    "P6_filtered_runs",
    sql(
        """select run_id, n_name as dataset_name from runs join nation on n_nationkey = dataset
where learner in ('F', 'P') and strategy in ('1-URGENT')""",
        "runs",
    ),
)
def _(t: Tables):
    names = t.given("nation").select(
        F.col("n_nationkey").alias("dataset"), F.col("n_name").alias("name")
    )
    kept = reports.filtered_runs(
        t.runs, {"learner": ["F", "P"], "strategy": ["1-URGENT"]}, {"dataset": names}
    )
    return kept.select("run_id", "dataset_name")


@query(
    "P7_merge_list_cells",
    """select l_orderkey as run_id, l_linenumber,
  round((l_quantity + l_discount + l_tax) / 3, 6) as mean,
  round(list_median([l_quantity, l_discount, l_tax]), 6) as median from lineitem""",
)
def _(t: Tables):
    from curveboard.functions.lists import merge_cells

    cells = t.given("lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        "l_linenumber",
        F.array("l_quantity", "l_discount", "l_tax").alias("cell"),
    )
    return cells.select(
        "run_id",
        "l_linenumber",
        merge_cells(F.col("cell"), "original_mean").alias("mean"),
        merge_cells(F.col("cell"), "median_list").alias("median"),
    )


@query(
    "P7_merged_lists",
    sql(
        """select run_id, string_agg(cast(cast(list_median([value, discount, 7.0]) as bigint)
  as varchar), ',' order by cycle) as medians from lines group by run_id""",
        "lines",
    ),
)
def _(t: Tables):
    cells = t.lines.select("run_id", "cycle", F.array("value", "discount", F.lit(7.0)).alias("cell"))
    merged = reports.merged_lists(cells, "median_list")
    whole = F.transform("values", lambda x: x.cast("long"))
    return merged.select("run_id", show_list(whole).alias("medians"))


@query(
    "P8_renamed",
    sql(
        """select run_id, case strategy when '1-URGENT' then 'urgent' when '2-HIGH' then 'high'
  else strategy end as label from runs""",
        "runs",
    ),
)
def _(t: Tables):
    names = t.runs.filter("strategy in ('1-URGENT', '2-HIGH')").select(
        F.col("strategy").alias("code"), F.lower(F.substring("strategy", 3, 20)).alias("short")
    ).distinct()
    return reports.renamed(t.runs, "strategy", names).select("run_id", "label")


@query(
    "P9_metric_of_runs",
    """select distinct l_orderkey as run_id, l_linenumber, o_orderpriority as strategy
from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'F'""",
)
def _(t: Tables):
    rows = t.given("lineitem").select(F.col("l_orderkey").alias("run_id"), "l_linenumber")
    kept = t.runs.filter("status = 'done'").select("run_id", "strategy")
    return reports.metric_of_runs(rows, kept)


@query(
    "U4_for_each_row",
    sql(
        """select run_id, unnest([0, 1]) as part, unnest([upper(learner), lower(batch)]) as text
from runs""",
        "runs",
    ),
)
def _(t: Tables):
    def work(row: dict) -> list[dict]:
        return [
            {"run_id": row["run_id"], "part": 0, "text": row["learner"].upper()},
            {"run_id": row["run_id"], "part": 1, "text": row["batch"].lower()},
        ]

    rows = t.runs.select("run_id", "learner", "batch")
    schema = T.StructType(
        [
            T.StructField("run_id", T.LongType()),
            T.StructField("part", T.IntegerType()),
            T.StructField("text", T.StringType()),
        ]
    )
    return for_each_row(rows, work, schema)

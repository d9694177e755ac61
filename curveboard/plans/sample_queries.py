"""Queries for selected samples, categorisers, dataset preparation, pools and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curveboard.functions.lists import show_list
from curveboard.functions.vectors import with_unit
from curveboard.operators import categorize as cat
from curveboard.operators import neighbours as nb
from curveboard.operators import pool as pl
from curveboard.operators import prepare as prep
from curveboard.operators import selections as sel
from curveboard.operators.curves import ramp_cutoffs
from curveboard.operators.registry import categorize
from curveboard.plans.catalog import query
from curveboard.plans.curve_queries import CUTOFFS
from curveboard.plans.testbed import Tables, sql
from curveboard.session import shared_folder
from curveboard.streaming import ingest

# --- selected samples -------------------------------------------------------


@query(
    "D1_avg_dist_batch",
    sql(
        """select run_id, cycle, round(coalesce(d, 0), 6) as value from
(select distinct run_id, cycle from picks) left join (
  select a.run_id, a.cycle, avg(list_cosine_distance(a.features, b.features)) as d
  from picks a join picks b on a.run_id = b.run_id and a.cycle = b.cycle
    and a.sample_id < b.sample_id group by 1, 2) using (run_id, cycle)""",
        "picks",
    ),
)
def _(t: Tables):
    return sel.batch_distance(with_unit(t.picks))


@query(
    "D2_avg_dist_labeled",
    sql(
        """select a.run_id, a.cycle, round(avg(list_cosine_distance(a.features, b.features)), 6)
  as value from picks a join picks b on a.run_id = b.run_id
    and (b.cycle < a.cycle or a.cycle = 0 and b.cycle = 0) group by 1, 2""",
        "picks",
    ),
)
def _(t: Tables):
    return sel.labelled_distance(with_unit(t.picks))


@query(
    "D3_avg_dist_unlabeled",
    sql(
        """select run_id, cycle, round(sum(d * w) / sum(w), 6) as value from (
  select a.run_id, a.cycle, list_cosine_distance(a.features, b.features) as d, 1 as w
  from picks a join train b using (bucket)
  union all
  select a.run_id, a.cycle, list_cosine_distance(a.features, b.features), -1
  from picks a join picks b on a.run_id = b.run_id
    and (b.cycle < a.cycle or a.cycle = 0 and b.cycle = 0))
group by 1, 2""",
        "picks",
        "train",
    ),
)
def _(t: Tables):
    # every pick counts as part of its train set
    return sel.unlabelled_distance(with_unit(t.picks), with_unit(t.train), ["bucket"])


def _gap_sql(measure: str, cumulative: bool) -> str:
    upto = "b.cycle <= a.cycle" if cumulative else "b.cycle = a.cycle"
    body = "sum(gap)" if measure == "manhattan" else "max(gap)"
    return sql(
        f"""select run_id, cycle, round(0 - {body}, 6) as {measure} from (
  select run_id, cycle, label, abs(coalesce(p, 0) - coalesce(c, 0) / m) as gap
  from (select distinct run_id, bucket, cycle, label from picks
          cross join (select distinct label from samples) l(label0)
          cross join (select distinct label as label1 from samples) k
        where false
        union select run_id, bucket, cycle, l.label
          from (select distinct run_id, bucket, cycle from picks), (select distinct label
            from samples) l) g
  left join (select bucket, label, count(*) / sum(count(*)) over (partition by bucket) as p
             from train group by 1, 2) t using (bucket, label)
  left join (select a.run_id, a.cycle, b.label, count(*) as c
             from (select distinct run_id, cycle from picks) a join picks b
               on a.run_id = b.run_id and {upto} group by 1, 2, 3) s using (run_id, cycle, label)
  join (select a.run_id, a.cycle, count(*) as m
        from (select distinct run_id, cycle from picks) a join picks b
          on a.run_id = b.run_id and {upto} group by 1, 2) n using (run_id, cycle))
group by 1, 2""".replace(
            """select distinct run_id, bucket, cycle, label from picks
          cross join (select distinct label from samples) l(label0)
          cross join (select distinct label as label1 from samples) k
        where false
        union """,
            "",
        ),
        "picks",
        "train",
    )


for _id, _measure, _cumulative in (
    ("D4", "manhattan", False),
    ("D5", "chebyshev", False),
    ("D6", "manhattan", True),
    ("D7", "chebyshev", True),
):

    def _gap(t: Tables, measure=_measure, cumulative=_cumulative):
        rows = t.picks.drop("features")
        gaps = sel.class_gap(rows, t.train, ["bucket"], cumulative=cumulative)
        return gaps.select("run_id", "cycle", measure)

    _suffix = "added_up" if _cumulative else "batch"
    query(f"{_id}_class_{_measure}_{_suffix}", _gap_sql(_measure, _cumulative))(_gap)


@query(
    "D8_selected_categories",
    sql(
        """select run_id, cycle, 'brand' as categorizer, round(sum(v) / count(*), 6) as mean,
  string_agg(cast(cast(v as bigint) as varchar), ',' order by sample_id) as values
from (select *, sample_id * 3 % 17 as v from picks) group by run_id, cycle""",
        "picks",
    ),
)
def _(t: Tables):
    values = t.samples.select(
        "dataset",
        "sample_id",
        F.lit("brand").alias("categorizer"),
        ((F.col("sample_id") * 3) % 17).cast("double").alias("value"),
    )
    found = sel.selected_categories(t.picks.select("dataset", "run_id", "cycle", "sample_id"), values)
    as_text = F.transform("values", lambda x: x.cast("long"))
    return found.withColumn("values", show_list(as_text))


@query(
    "D9_ordered_selections",
    sql(
        """select run_id, cycle, sample_id, count(*) over (partition by run_id) as n,
  row_number() over (partition by run_id order by cycle, sample_id) - 1 as pos from picks""",
        "picks",
    ),
)
def _(t: Tables):
    return sel.ordered_selections(t.picks.select("run_id", "cycle", "sample_id"))


@query(
    "D9_flattened_selections",
    sql(
        """select run_id, string_agg(cast(sample_id as varchar), ',' order by cycle, sample_id)
  as sample_ids from lines group by 1""",
        "lines",
    ),
)
def _(t: Tables):
    flat = sel.flattened(t.lines.select("run_id", "cycle", "sample_id"))
    return flat.withColumn("sample_ids", show_list(F.col("sample_ids")))


@query(
    "T6_phase_slices",
    sql(
        """select run_id, phase, pos, sample_id from (
  select *, row_number() over (partition by run_id order by cycle, sample_id) - 1 as pos,
         count(*) over (partition by run_id) as n from picks)
join (select fingerprint as run_id, max(cutoff) as cut from cutoffs group by 1) using (run_id)
join (values ('ramp_up'), ('plateau'), ('first_5'), ('last_5')) p(phase)
  on case phase when 'ramp_up' then pos < cut when 'plateau' then pos >= cut
       when 'first_5' then pos < 5 else pos >= n - 5 end""",
        "picks",
        "gappy",
        extra=CUTOFFS,
    ),
)
def _(t: Tables):
    cutoffs = ramp_cutoffs(t.gappy).groupBy(F.floor(F.col("run_id") / 10).alias("run_id")).agg(
        F.max("cutoff").alias("cutoff")
    )
    ordered = sel.ordered_selections(t.picks.select("run_id", "cycle", "sample_id"))
    return sel.phase_rows(ordered, cutoffs)


@query(
    "T6_phase_slices_of_arrays",
    sql(
        """select run_id, v[1:5] as f, v[greatest(len(v) - 4, 1):] as l, v[1:cut] as r,
  v[cut + 1:] as p from (
  select run_id, list(sample_id order by cycle, sample_id) as v from picks group by 1)
join (select fingerprint as run_id, cast(max(cutoff) as bigint) as cut from cutoffs group by 1)
  using (run_id)""",
        "picks",
        "gappy",
        extra=CUTOFFS,
    )
    .replace("v[1:5] as f", "array_to_string(v[1:5], ',') as first_5")
    .replace("v[greatest(len(v) - 4, 1):] as l", "array_to_string(v[greatest(len(v) - 4, 1):], ',') as last_5")
    .replace("v[1:cut] as r", "array_to_string(v[1:cut], ',') as ramp_up")
    .replace("v[cut + 1:] as p", "array_to_string(v[cut + 1:], ',') as plateau"),
)
def _(t: Tables):
    from curveboard.operators.series import selection_phases

    cutoffs = ramp_cutoffs(t.gappy).groupBy(F.floor(F.col("run_id") / 10).alias("run_id")).agg(
        F.max("cutoff").alias("cutoff")
    )
    flat = sel.flattened(t.picks.select("run_id", "cycle", "sample_id"))
    sliced = selection_phases(flat, cutoffs)
    return sliced.select(
        "run_id", *[show_list(F.col(c)).alias(c) for c in sliced.columns if c != "run_id"]
    )


# --- distances and neighbours -----------------------------------------------

NEAR = """pairs as (
  select a.sample_id as query_id, b.sample_id as neighbour_id, a.label as la, b.label as lb,
         list_cosine_distance(a.features, b.features) as distance
  from samples a join samples b on a.sample_id <> b.sample_id),
k as (select cast(floor(sqrt(count(*)) / 2) as bigint) as k from samples),
near as (select * from (
  select *, row_number() over (partition by query_id order by distance, neighbour_id) as rank
  from pairs) where rank <= (select k from k)),
near_same as (select * from (
  select *, row_number() over (partition by query_id order by distance, neighbour_id) as rank
  from pairs where la = lb) where rank <= (select k from k)),
near_other as (select * from (
  select *, row_number() over (partition by query_id order by distance, neighbour_id) as rank
  from pairs where la <> lb) where rank <= (select k from k))"""


@query(
    "E11_mean_distances",
    sql(
        """select 0 as dataset, a.sample_id,
  round(avg(list_cosine_distance(a.features, b.features)), 6) as mean_distance
from samples a cross join samples b group by a.sample_id""",
        "samples",
    ),
)
def _(t: Tables):
    return nb.mean_distance_to_all(t.samples)


@query(
    "E11_pair_distances",
    sql(
        """select a.vec_id as a, b.vec_id as b, round(list_cosine_distance(a.embedding::double[],
  b.embedding::double[]), 6) as distance
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""",
    ),
)
def _(t: Tables):
    pairs = t.samples.select(
        F.col("sample_id").alias("a"), (F.col("sample_id") + 1).alias("b")
    )
    return nb.pair_distances(pairs, t.samples)


@query(
    "E12_knn",
    sql(
        """select 0 as dataset, query_id, neighbour_id, round(distance, 6) as distance,
  cast(rank as integer) as rank from near""",
        "samples",
        extra=NEAR,
    ),
)
def _(t: Tables):
    return nb.knn(t.samples)


@query("E12_approximate_knn")
def _(t: Tables):
    return nb.approximate_knn(t.samples)


@query(
    "E12_approximate_facts",
    sql(
        """select 0 as dataset, sample_id, (select k from k) as found, true as distances,
  true as often_right from samples""",
        "samples",
        extra=NEAR,
    ),
)
def _(t: Tables):
    """k neighbours for every sample at their true distances, and 0.9 of the true ones over all."""
    near = nb.approximate_knn(t.samples)
    pairs = near.select("dataset", F.col("query_id").alias("a"), F.col("neighbour_id").alias("b"), F.col("distance").alias("given"))
    true = nb.pair_distances(pairs, t.samples, ["dataset"], many=True)
    exact = nb.knn(t.samples).select("dataset", "query_id", "neighbour_id", F.lit(1).alias("hit"))
    hits = near.join(exact, ["dataset", "query_id", "neighbour_id"], "left")
    share = hits.agg((F.count("hit") / F.count(F.lit(1))).alias("share")).select(F.col("share") >= 0.9)
    return true.groupBy("dataset", F.col("a").alias("sample_id")).agg(
        F.count(F.lit(1)).alias("found"),
        (F.max(F.abs(F.col("given") - F.col("distance"))) < 1e-9).alias("distances"),
    ).withColumn("often_right", share.scalar())


# --- categorisers -----------------------------------------------------------


@query(
    "K1_wrong_classifications",
    sql(
        """select dataset, sample_id, round(w / sum(w) over (partition by dataset) * 1000, 6) as value
from (select dataset, sample_id, sum(case when y_pred <> label then 1.0 else 0 end) as w
      from part_predictions group by 1, 2)""",
        "part_predictions",
    ),
)
def _(t: Tables):
    return cat.wrong_classifications(t.part_predictions)


@query(
    "K2_class_switches",
    sql(
        """select dataset, sample_id, round(h / sum(h) over (partition by dataset) * 1000, 6) as value
from (select dataset, sample_id, sum(h) as h from (
  select dataset, run_id, sample_id, sum(c * c) / (sum(c) * sum(c)) as h from (
    select dataset, run_id, sample_id, y_pred, count(*)::double as c
    from part_predictions where cycle < 3 group by all) group by 1, 2, 3) group by 1, 2)""",
        "part_predictions",
    ),
)
def _(t: Tables):
    return cat.class_switches(t.part_predictions)


@query("K3_boundary_closeness")
def _(t: Tables):
    return cat.boundary_closeness(t.sample_sets)


def _neighbour_sql(body: str) -> str:
    return sql(
        f"""select 0 as dataset, sample_id,
  round(v / sum(v) over () * {body.split('|')[0]} * (select k from k), 6) as value
from ({body.split('|')[1]})""",
        "samples",
        extra=NEAR,
    )


@query(
    "K4_region_density",
    _neighbour_sql(
        "100|select query_id as sample_id, avg(distance) as v from near group by 1"
    ),
)
def _(t: Tables):
    return cat.region_density(t.samples)


@query(
    "K5_melting_pot",
    _neighbour_sql(
        """100|select query_id as sample_id, sum(c * c) / (sum(c) * sum(c)) as v from (
  select query_id, lb, count(*)::double as c from near group by 1, 2) group by 1"""
    ),
)
def _(t: Tables):
    return cat.melting_pot(t.samples)


@query(
    "K6_in_optimal_selection",
    """with s as (select l_partkey as sample_id, count(distinct l_orderkey) as v
  from lineitem join orders on l_orderkey = o_orderkey
  where o_orderpriority in ('1-URGENT', '2-HIGH') group by 1)
select 0 as dataset, p_partkey as sample_id,
  round(coalesce(v / sum(v) over () * 100, 0), 6) as value
from part left join s on p_partkey = s.sample_id""",
)
def _(t: Tables):
    whole = F.floor(F.col("sample_id") / 1e12).cast("int").alias("dataset")
    samples = t.given("part").select(F.col("p_partkey").alias("sample_id")).select("*", whole)
    selected = t.items.join(t.runs.select("run_id", "strategy"), "run_id").select("*", whole)
    return cat.in_optimal_selection(samples, selected, ["1-URGENT", "2-HIGH"])


@query(
    "K7_same_class_knn",
    _neighbour_sql(
        """1|select s.sample_id, case when c <= (select k from k) then inside else v end as v
from samples s join (select label, count(*) as c from samples group by 1) using (label)
left join (select query_id, avg(distance) as v from near_same group by 1) n
  on n.query_id = s.sample_id
left join (select a.sample_id, avg(list_cosine_distance(a.features, b.features)) as inside
  from samples a join samples b using (label) group by 1) i on i.sample_id = s.sample_id"""
    ),
)
def _(t: Tables):
    return cat.same_class_knn(t.samples)


@query(
    "K8_other_class_knn",
    _neighbour_sql(
        "1|select query_id as sample_id, avg(distance) as v from near_other group by 1"
    ),
)
def _(t: Tables):
    return cat.other_class_knn(t.samples)


@query("K9_cluster_center_closeness")
def _(t: Tables):
    return cat.cluster_center_closeness(t.sample_sets)


@query(
    "K10_improves_accuracy",
    sql(
        """select 0 as dataset, sample_id, round(v / sum(v) over () * 1000, 6) as value from (
  select sample_id, sum(d) as v from (
    select *, discount - lag(discount) over (partition by run_id order by cycle) as d from lines)
  where d is not null group by 1)""",
        "lines",
    ),
)
def _(t: Tables):
    accuracy = t.lines.select("run_id", "cycle", F.col("discount").alias("value"))
    whole = F.floor(F.col("sample_id") / 1e12).cast("int").alias("dataset")
    selected = t.lines.select(whole, "run_id", "cycle", "sample_id")
    return cat.improves_accuracy(accuracy, selected)


@query("K11_average_uncertainty")
def _(t: Tables):
    return cat.average_uncertainty(t.samples)


@query("K12_outlierness")
def _(t: Tables):
    return cat.outlierness(t.samples)


def _class_distance_sql(test: str) -> str:
    return sql(
        f"""select 0 as dataset, sample_id, round(v / sum(v) over (), 6) as value from (
  select a.sample_id, avg(list_cosine_distance(a.features, b.features)) as v
  from samples a join samples b on {test} group by 1)""",
        "samples",
    )


@query("K13_same_class_distance", _class_distance_sql("a.label = b.label"))
def _(t: Tables):
    return cat.same_class_distance(t.samples)


@query("K14_other_class_distance", _class_distance_sql("a.label <> b.label"))
def _(t: Tables):
    return cat.other_class_distance(t.samples)


@query("K13_whole_row_distance", _class_distance_sql("true"))
def _(t: Tables):
    return cat.same_class_distance(t.samples, scope="all")


@query(
    "K15_reassemble_predictions",
    sql(
        """select dataset, run_id, cycle, part, sample_id, y_pred from predictions""",
        "predictions",
    ),
)
def _(t: Tables):
    rows = t.predictions.withColumn("bucket", F.lit(0))
    order = F.sort_array(F.collect_list(F.struct("sample_id", "y_pred")))
    keys = ["dataset", "bucket", "run_id", "cycle", "part"]
    # predictions come as short arrays in split order: 64 ids to a split
    block = F.floor(F.col("sample_id") / 64)
    name = F.concat_ws(
        "/", "dataset", "run_id", F.col("cycle").cast("string"), F.col("block").cast("string")
    )
    packed = rows.groupBy(*keys, block.alias("block")).agg(order.alias("o"))
    packed = packed.withColumn("split", name)
    arrays = packed.select(
        F.col("split").alias("dataset"),
        "bucket",
        "run_id",
        "cycle",
        "part",
        F.transform("o", lambda x: x["y_pred"]).alias("y_pred"),
    )
    splits = packed.select(
        F.col("split").alias("dataset"), "bucket", "part", F.posexplode("o").alias("pos", "s")
    ).select("dataset", "bucket", "part", "pos", "s.sample_id")
    out = cat.reassemble_predictions(arrays, splits)
    return out.withColumn("dataset", F.split("dataset", "/")[0])


@query(
    "U3_registered_categorizer",
    sql(
        """select dataset, sample_id, round(w / sum(w) over (partition by dataset) * 1000, 6) as value,
  'COUNT_WRONG_CLASSIFICATIONS' as categorizer
from (select dataset, sample_id, sum(case when y_pred <> label then 1.0 else 0 end) as w
      from predictions group by 1, 2)""",
        "predictions",
    ),
)
def _(t: Tables):
    return categorize("COUNT_WRONG_CLASSIFICATIONS", t.predictions)


# --- dataset preparation ----------------------------------------------------


@query("E1_drop_columns", "select p_partkey, p_name, p_brand, p_type from part")
def _(t: Tables):
    return prep.drop_columns(t.given("part"), ["p_size", "p_retailprice"])


@query(
    "E2_float_categoricals",
    """with cells as (
  select distinct unnest(['half', 'whole', 'price']) as feature,
         unnest([(p_size % 7) * 0.5::double, (p_size % 5)::double, p_retailprice]) as v from part),
steps as (
  select *, v - lag(v) over (partition by feature order by v) as d from cells)
select feature, round(min(v), 6) as low, round(avg(d), 6) as step, count(*) as values
from steps group by feature
having max(d) - min(d) < 1e-6 and abs(avg(d) - round(avg(d))) > 1e-9""",
)
def _(t: Tables):
    rows = t.given("part").select(
        ((F.col("p_size") % 7) * 0.5).cast("double").alias("half"),
        (F.col("p_size") % 5).cast("double").alias("whole"),
        F.col("p_retailprice").alias("price"),
    )
    return prep.float_categoricals(rows, ["half", "whole", "price"])


@query(
    "E2_encode_float_categoricals",
    "select p_partkey, (p_size % 7)::double as half, (p_size % 5)::double as whole from part",
)
def _(t: Tables):
    rows = t.given("part").select(
        "p_partkey",
        ((F.col("p_size") % 7) * 0.5).cast("double").alias("half"),
        (F.col("p_size") % 5).cast("double").alias("whole"),
    )
    return prep.encode_float_categoricals(rows, ["half", "whole"])


@query(
    "E3_encode_categoricals",
    """select p_partkey, b.code as p_brand, coalesce(y.code, -1) as p_type from part
join (select p_brand, cast(row_number() over (order by p_brand) - 1 as integer) as code
      from (select distinct p_brand from part)) b using (p_brand)
left join (select p_type, cast(row_number() over (order by p_type) - 1 as integer) as code
      from (select distinct p_type from part where p_size > 10)) y
  on y.p_type = part.p_type and p_size > 10""",
)
def _(t: Tables):
    known = F.when(F.col("p_size") > 10, F.col("p_type"))
    rows = t.given("part").select("p_partkey", "p_brand", known.alias("p_type"))
    return prep.encode_categoricals(rows, ["p_brand", "p_type"])


@query(
    "E4_fill_missing",
    """select p_partkey, case when p_size > 10 then p_size else 0 end as p_size from part""",
)
def _(t: Tables):
    known = F.when(F.col("p_size") > 10, F.col("p_size"))
    return prep.fill_missing(t.given("part").select("p_partkey", known.alias("p_size")))


@query(
    "E5_id_columns",
    """with d as (select event_id - lag(event_id) over (order by event_id) as a,
  user_id - lag(user_id) over (order by event_id) as b,
  value - lag(value) over (order by event_id) as c from events)
select f.feature, round(case f.feature when 'event_id' then sum(abs(a)) when 'user_id'
  then sum(abs(b)) else sum(abs(c)) end / (count(*) - 1), 6) as mean_step,
  f.feature = 'event_id' as is_id
from d cross join (values ('event_id'), ('user_id'), ('value')) f(feature) group by 1""",
)
def _(t: Tables):
    events = t.given("events").withColumn("place", F.col("event_id"))
    return prep.id_columns(events, ["event_id", "user_id", "value"], "place")


FEATURES = """features as (
  select sample_id, dataset, label, unnest(features) as v,
         generate_subscripts(features, 1) - 1 as dim from samples)"""


@query(
    "E6_scaled_features",
    sql(
        """select sample_id, cast(dim as integer) as dim,
  round((v - min(v) over w) / nullif(max(v) over w - min(v) over w, 0), 6) as v
from features window w as (partition by dim)""",
        "samples",
        extra=FEATURES,
    ),
)
def _(t: Tables):
    rows = prep.scaled(t.samples)
    return rows.select("sample_id", F.posexplode("features").alias("dim", "v"))


@query(
    "E7_drop_rare_classes",
    """select p_partkey as sample_id from part where (p_size % 3, p_type) in (
  select (p_size % 3, p_type) from part group by 1 having count(*) >= 20)""",
)
def _(t: Tables):
    rows = t.given("part").select(
        (F.col("p_size") % 3).alias("dataset"),
        F.col("p_type").alias("label"),
        F.col("p_partkey").alias("sample_id"),
    )
    return prep.drop_rare_classes(rows, 20).select("sample_id")


SPLITS = """placed as (
  select dataset, label, sample_id, bucket,
         row_number() over (partition by dataset, label, bucket order by
           md5('0|' || bucket || '|' || sample_id), sample_id) - 1 as at_,
         count(*) over (partition by dataset, label, bucket) as n
  from samples cross join (select cast(unnest(range(5)) as integer) as bucket)),
splits as (select dataset, bucket, label, sample_id,
         case when at_ < greatest(floor(n * 60 / 100.0), 1) then 'train' else 'test' end as part
  from placed)"""


@query(
    "E8_stratified_splits",
    sql("select dataset, bucket, label, part, sample_id from splits", "samples", extra=SPLITS),
)
def _(t: Tables):
    return prep.stratified_splits(t.samples)


STARTS = """numbered as (
  select *, row_number() over (partition by dataset, bucket, label
    order by md5('0|order|' || sample_id), sample_id) - 1 as at_,
         count(*) over (partition by dataset, bucket, label) as n
  from splits where part = 'train'),
starts as (select s.dataset, s.bucket, p.start_point, s.label, s.sample_id
  from (select dataset, bucket, label, any_value(n) as n from numbered group by 1, 2, 3) g
  cross join (select cast(unnest(range(10000)) as integer) as start_point) p
  join numbered s on s.dataset = g.dataset and s.bucket = g.bucket and s.label = g.label
    and s.at_ = ('0x' || (md5('0|' || g.dataset || '|' || g.bucket || '|' || g.label || '|'
      || p.start_point))[1:12])::bigint % g.n)"""


@query(
    "E9_start_sets",
    sql(
        "select dataset, bucket, start_point, label, sample_id from starts",
        "samples",
        extra=SPLITS + ",\n" + STARTS,
    ),
)
def _(t: Tables):
    return prep.start_sets(prep.stratified_splits(t.samples))


@query(
    "E10_predefined_splits",
    sql(
        """select sample_id // 64 as dataset, bucket, part, cast(row_number() over
  (partition by sample_id // 64, bucket, part order by sample_id) - 1 as integer) as pos,
  sample_id from splits""",
        "samples",
        extra=SPLITS,
    ),
)
def _(t: Tables):
    splits = prep.stratified_splits(t.samples)
    ids = lambda part: F.sort_array(
        F.collect_list(F.when(F.col("part") == part, F.col("sample_id")))
    )
    # given splits are lists of a short dataset each: 64 samples to a dataset
    small = F.floor(F.col("sample_id") / 64).alias("dataset")
    lists = splits.groupBy(small, "bucket").agg(
        ids("train").alias("train"), ids("test").alias("test")
    )
    return prep.predefined_splits(lists)


@query(
    "E13_dataset_summary",
    """select p_size as dataset, count(*) as "rows", 2 as "columns",
  count(distinct p_type) as classes from part group by 1""",
)
def _(t: Tables):
    return prep.dataset_summary(_part_samples(t))


def _part_samples(t: Tables) -> DataFrame:
    return t.given("part").select(
        F.col("p_size").alias("dataset"),
        F.col("p_partkey").alias("sample_id"),
        F.array("p_retailprice", F.col("p_size").cast("double")).alias("features"),
        F.col("p_type").alias("label"),
    )


@query(
    "E13_summary_extremes",
    """with s as (select p_size as dataset, count(*) as r, count(distinct p_type) as c
  from part group by 1)
select 'rows' as what, min(r) as lowest, max(r) as highest from s
union all select 'columns', 2, 2
union all select 'classes', min(c), max(c) from s""",
)
def _(t: Tables):
    return prep.summary_extremes(prep.dataset_summary(_part_samples(t)))


@query(
    "E14_load_split",
    sql(
        """select s.sample_id, s.part, exists (select 1 from starts t where t.dataset = 0
  and t.bucket = 2 and t.start_point = 7 and t.sample_id = s.sample_id) as in_start
from splits s where bucket = 2""",
        "samples",
        extra=SPLITS + ",\n" + STARTS,
    ),
)
def _(t: Tables):
    splits = prep.stratified_splits(t.samples)
    starts = prep.start_sets(splits)
    return prep.load_split(t.samples, splits, starts, 0, 2, 7).select(
        "sample_id", "part", "in_start"
    )


# --- pools ------------------------------------------------------------------


@query(
    "Q1_random_batch",
    sql(
        "select sample_id from samples order by md5('0|' || sample_id) limit 50",
        "samples",
    ),
)
def _(t: Tables):
    return pl.random_batch(t.samples, 50).select("sample_id")


def _top_sql(score: str, direction: str = "desc") -> str:
    return sql(
        f"""select sample_id, round(s, 6) as score from (
  select sample_id, {score} as s from probabilities) order by s {direction}, sample_id limit 50""",
        "probabilities",
    )


@query("Q2_least_confidence", _top_sql("1 - list_max(p)"))
def _(t: Tables):
    return pl.uncertainty_batch(t.probabilities, 50, "least_confidence")


@query(
    "Q3_margin",
    _top_sql("list_reverse_sort(p)[1] - list_reverse_sort(p)[2]", "asc"),
)
def _(t: Tables):
    return pl.uncertainty_batch(t.probabilities, 50, "margin")


@query("Q4_entropy", _top_sql("0 - list_sum([x * ln(x) for x in p])"))
def _(t: Tables):
    return pl.uncertainty_batch(t.probabilities, 50, "entropy")


@query(
    "Q5_vote_entropy",
    sql(
        """select sample_id, round(0 - sum(c / 5 * ln(c / 5)), 6) as score from (
  select sample_id, y_pred, count(*)::double as c from votes group by 1, 2) group by 1""",
        "votes",
    ),
)
def _(t: Tables):
    return pl.vote_entropy(t.votes)


@query(
    "Q6_committee_divergence",
    sql(
        """select sample_id, round(sum(p * ln(p / q)) / 5, 6) as score from (
  select *, avg(p) over (partition by sample_id, class) as q from (
    select sample_id, member, unnest(generate_subscripts(w, 1)) as class,
      unnest([exp(x) / list_sum([exp(y) for y in w]) for x in w]) as p from votes))
group by 1""".replace("unnest(generate_subscripts(w, 1))", "unnest(range(1, len(w) + 1))"),
        "votes",
    ),
)
def _(t: Tables):
    exp = F.transform("w", lambda x: F.exp(x))
    whole = F.aggregate("e", F.lit(0.0), lambda s, x: s + x)
    members = t.votes.withColumn("e", exp).withColumn("z", whole).select(
        "sample_id",
        "member",
        F.posexplode(F.transform("e", lambda x: x / F.col("z"))).alias("class", "p"),
    )
    return pl.committee_divergence(members)


@query(
    "Q7_density_weighted",
    sql(
        """select sample_id, round((0 - list_sum([x * ln(x) for x in p])) * s, 6) as score
from probabilities join (
  select a.sample_id, avg(list_cosine_similarity(a.features, b.features)) as s
  from samples a cross join samples b group by 1) using (sample_id)""",
        "probabilities",
    ),
)
def _(t: Tables):
    return pl.density_weighted(t.probabilities)


@query(
    "Q8_k_center",
    sql(
        """select cast(i as integer) as round, sample_id, round(d, 6) as distance from (
  select *, row_number() over (partition by i order by d desc, sample_id) as rn from greedy where i < 10)
where rn = 1""",
        "samples",
        extra="""given as (select sample_id, features from samples where sample_id in
  (select min(sample_id) from samples group by label)),
greedy as (with recursive r(i, sample_id, features, d) as (
  select 0, s.sample_id, any_value(s.features), min(list_distance(s.features, g.features))
  from samples s cross join given g where s.sample_id not in (select sample_id from given) group by 2
  union all
  select i + 1, sample_id, features, least(d, list_distance(features, far)) from (
    select *, first_value(sample_id) over w as chosen, first_value(features) over w as far
    from r where i < 9 window w as (order by d desc, sample_id))
  where sample_id <> chosen) select * from r)""",
    ),
)
def _(t: Tables):
    rows = t.samples.select("sample_id", "features")
    # the smallest id of each class is the labelled set
    first = t.samples.groupBy("label").agg(F.min("sample_id").alias("sample_id"))
    return pl.k_center(rows, rows.join(first, "sample_id", "left_semi"), 10)


@query("Q8_k_center_coreset")
def _(t: Tables):
    rows = t.samples.select("sample_id", "features")
    first = t.samples.groupBy("label").agg(F.min("sample_id").alias("sample_id"))
    return pl.k_center_coreset(rows, rows.join(first, "sample_id", "left_semi"), 10)


@query(
    "Q8_nearest_labelled",
    sql(
        """select s.sample_id, round(min(list_distance(s.features, l.features)), 6) as distance
from samples s cross join (select * from samples where sample_id in
  (select min(sample_id) from samples group by label)) l group by 1""",
        "samples",
    ),
)
def _(t: Tables):
    rows = t.samples.select("sample_id", "features")
    first = t.samples.groupBy("label").agg(F.min("sample_id").alias("sample_id"))
    return nb.nearest(rows, rows.join(first, "sample_id", "left_semi"), block_rows=256)


@query("Q9_embedding_kmeans")
def _(t: Tables):
    return pl.embedding_kmeans(t.samples, 10)


@query(
    "Q10_lightweight_coreset",
    sql(
        """select sample_id, round(s, 3) as score from (
  select sample_id, -ln(greatest(('0x' || (md5('0|' || sample_id))[1:12])::bigint / pow(2, 48),
    1e-15)) / (0.5 / (select count(*) from samples) + 0.5 * d / sum(d) over ()) as s
  from (select sample_id, sum((v - m) * (v - m)) as d from features
        join (select dim, avg(v) as m from features group by 1) using (dim) group by 1))
order by s, sample_id limit 50""",
        "samples",
        extra=FEATURES,
    ),
)
def _(t: Tables):
    batch = pl.lightweight_coreset(t.samples, 50)
    return batch.withColumn("score", F.round("score", 3))


@query("Q11_discriminative")
def _(t: Tables):
    rows = t.samples.select("sample_id", "features")
    labelled = rows.join(t.picks.filter("cycle = 0").select("sample_id"), "sample_id", "left_semi")
    return pl.discriminative(rows, labelled, 50)


@query(
    "Q12_contrastive",
    sql(
        """select s.dataset, query_id as sample_id, round(avg(list_sum([o.p[i] * ln(o.p[i] / s.p[i])
  for i in range(1, 6)])), 6) as score
from (select * from (select *, row_number() over (partition by query_id
        order by distance, neighbour_id) as r from pairs) where r <= 10)
join probabilities s on s.sample_id = query_id
join probabilities o on o.sample_id = neighbour_id group by 1, 2""",
        "probabilities",
        extra=NEAR,
    ),
)
def _(t: Tables):
    return pl.contrastive(t.probabilities)


@query("Q13_graph_density")
def _(t: Tables):
    return pl.graph_density(t.samples, 10)


@query(
    "Q14_pool_violations",
    sql(
        """select run_id, cycle, violation, n from (
  select run_id, cycle, 'not in train set' as violation, count(*) as n from p
  where not exists (select 1 from train t where t.bucket = p.bucket
    and t.sample_id = p.sample_id) group by 1, 2
  union all
  select run_id, cycle, 'selected twice', count(*) from (
    select run_id, sample_id, max(cycle) as cycle from p group by 1, 2 having count(*) > 1)
  group by 1, 2
  union all
  select run_id, cycle, 'wrong batch size', n from (
    select run_id, cycle, count(*) as n, max(cycle) over (partition by run_id) as last
    from p where cycle > 0 group by 1, 2)
  where n > 10 or n < 10 and cycle < last)""",
        "picks",
        "train",
        extra="""p as (select run_id, bucket, cycle, sample_id from picks
  union all select run_id, bucket, cycle + 1, sample_id from picks where label = 0)""",
    ),
)
def _(t: Tables):
    rows = t.picks.select("run_id", "bucket", "cycle", "sample_id", "label")
    again = rows.filter("label = 0").withColumn("cycle", F.col("cycle") + 1)
    selected = rows.unionByName(again).select("run_id", "bucket", "cycle", "sample_id")
    sets = rows.select("run_id", "bucket").distinct()
    train = t.train.select("bucket", "sample_id")
    batch = sets.select("run_id").withColumn("batch_size", F.lit(10))
    # runs of a bucket share its train set, which is not copied for each of them
    return pl.pool_violations(selected, train, batch, train_keys=["bucket"])


# --- streams ----------------------------------------------------------------


def _stream_folder(t: Tables) -> tuple[str, T.StructType, str]:
    """The runs as several Parquet files, one status of them written twice."""
    root = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    rows = t.runs.select("run_id", "dataset", "strategy", "status")
    rows.write.parquet(f"{root}/in")
    rows.filter("status = 'done'").write.mode("append").parquet(f"{root}/in")
    return f"{root}/in", rows.schema, root


@query(
    "ST1_ingest_first_per_run",
    sql("select run_id, dataset, strategy, status from runs", "runs"),
)
def _(t: Tables):
    path, schema, root = _stream_folder(t)
    stream = ingest.first_per_run(ingest.run_stream(t.spark, path, schema, 4))
    ingest.write_runs(stream, f"{root}/out", f"{root}/state").awaitTermination()
    return t.spark.read.parquet(f"{root}/out").select("run_id", "dataset", "strategy", "status")


@query(
    "ST1_ingest_by_event_time",
    """select event_id as run_id, min(ts) as seen, min(event_type) as strategy from events group by 1""",
)
def _(t: Tables):
    root = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    rows = t.given("events").select(
        F.col("event_id").alias("run_id"),
        # a watermark needs an instant
        F.col("ts").cast("timestamp").alias("seen"),
        F.col("event_type").alias("strategy"),
    )
    # every run arrives twice; the second copy is within the watermark
    rows.union(rows).write.parquet(f"{root}/in")
    stream = ingest.run_stream(t.spark, f"{root}/in", rows.schema, 64)
    once = ingest.first_per_run(stream, "seen", "400 days")
    ingest.write_runs(once, f"{root}/out", f"{root}/state").awaitTermination()
    out = t.spark.read.parquet(f"{root}/out")
    return out.select("run_id", F.col("seen").cast("timestamp_ntz").alias("seen"), "strategy")


@query(
    "ST1_ingest_late_copies",
    sql("select run_id, dataset, strategy, status from runs", "runs"),
)
def _(t: Tables):
    """Every run comes again in later batches, long after any watermark; the first row stays."""
    root = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    rows = t.runs.select("run_id", "dataset", "strategy", "status")
    for status in (None, "copy"):
        given = rows if status is None else rows.withColumn("status", F.lit(status))
        given.write.mode("append").parquet(f"{root}/in")
        stream = ingest.run_stream(t.spark, f"{root}/in", rows.schema, 4)
        ingest.write_new_runs(stream, f"{root}/out", f"{root}/state").awaitTermination()
    return ingest.kept_runs(t.spark, f"{root}/out").select("run_id", "dataset", "strategy", "status")


@query(
    "ST2_progress_counts",
    sql(
        """select dataset, strategy, count(*) as total,
  count(*) filter (where status = 'done') as done
from runs group by dataset, strategy""",
        "runs",
    ),
)
def _(t: Tables):
    path, schema, root = _stream_folder(t)
    once = ingest.first_per_run(ingest.run_stream(t.spark, path, schema, 64))
    ingest.write_runs(once, f"{root}/once", f"{root}/state").awaitTermination()
    # the file sink holds each run once; counts follow it as a stream of its own
    counts = ingest.progress_counts(ingest.run_stream(t.spark, f"{root}/once", schema, 64))
    ingest.write_progress(counts, f"{root}/counts", f"{root}/counting").awaitTermination()
    return ingest.latest_progress(t.spark, f"{root}/counts")

"""The engine's tables derived from the given test tables, in Spark and in SQL.

``Tables`` builds the DataFrames; ``CTE`` holds the same tables as SQL for checks.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curveboard.functions.slices import position


class Tables:
    """Given tables and their mappings for one folder of Parquet files."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def curve(self) -> DataFrame:
        """One learning curve per user and event type."""
        kind = (
            F.when(F.col("event_type") == "signup", 0)
            .when(F.col("event_type") == "click", 1)
            .when(F.col("event_type") == "view", 2)
            .when(F.col("event_type") == "purchase", 3)
            .otherwise(4)
        )
        events = self.given("events").select("user_id", "event_type", "ts", "event_id", "value")
        placed = position(
            events, ["user_id", "event_type"], F.to_date("ts"), ["ts", "event_id"], "cycle"
        )
        return placed.select(
            (F.col("user_id") * 10 + kind).alias("run_id"),
            (F.col("user_id") % 10).alias("dataset"),
            F.col("event_type").alias("strategy"),
            F.col("user_id").alias("fingerprint"),
            "cycle",
            "value",
        )

    @cached_property
    def gappy(self) -> DataFrame:
        """The curves with every value below 2 missing."""
        return self.curve.withColumn("value", F.when(F.col("value") >= 2, F.col("value")))

    @cached_property
    def runs(self) -> DataFrame:
        orders = self.given("orders")
        customer = self.given("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        status = (
            F.when(F.col("o_orderstatus") == "F", "done")
            .when(F.col("o_orderstatus") == "O", "open")
            .otherwise("failed")
        )
        return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
            F.col("o_orderkey").alias("run_id"),
            F.col("c_nationkey").alias("dataset"),
            F.col("o_orderpriority").alias("strategy"),
            F.col("o_orderstatus").alias("learner"),
            F.col("c_mktsegment").alias("batch"),
            (F.col("o_custkey") % 20).alias("start_point"),
            F.year("o_orderdate").alias("bucket"),
            F.col("o_totalprice").alias("value"),
            status.alias("status"),
        )

    @cached_property
    def lines(self) -> DataFrame:
        """Short, sparse curves: one per order."""
        items = self.given("lineitem")
        order = [
            "l_shipdate",
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            "l_quantity",
            "l_extendedprice",
        ]
        placed = position(items, ["l_orderkey"], F.trunc("l_shipdate", "month"), order, "cycle")
        return placed.select(
            F.col("l_orderkey").alias("run_id"),
            "cycle",
            F.col("l_discount").alias("discount"),
            F.col("l_quantity").alias("value"),
            F.col("l_extendedprice").alias("price"),
            F.col("l_partkey").alias("sample_id"),
            (F.col("l_linenumber") % 3).alias("y_pred"),
        )

    @cached_property
    def items(self) -> DataFrame:
        """Line rows without their order inside a run, for operators that need none."""
        return self.given("lineitem").select(
            F.col("l_orderkey").alias("run_id"),
            F.col("l_quantity").alias("value"),
            F.col("l_partkey").alias("sample_id"),
        )

    @cached_property
    def samples(self) -> DataFrame:
        # labels stay below 100, so all samples form one dataset
        return self.given("embeddings").select(
            F.floor(F.col("label") / 100).cast("int").alias("dataset"),
            F.col("vec_id").alias("sample_id"),
            F.col("embedding").cast("array<double>").alias("features"),
            "label",
        )

    @cached_property
    def sample_sets(self) -> DataFrame:
        """The samples as three datasets whose ids overlap."""
        return self.samples.withColumn("dataset", (F.col("sample_id") % 3).cast("int")).withColumn(
            "sample_id", F.floor(F.col("sample_id") / 3)
        )

    @cached_property
    def picks(self) -> DataFrame:
        """Selections from the samples: runs of five cycles of ten over two train sets."""
        return self.samples.select(
            "dataset",
            F.floor(F.col("sample_id") / 50).alias("run_id"),
            (F.floor(F.col("sample_id") / 50) % 2).alias("bucket"),
            (F.col("sample_id") % 5).alias("cycle"),
            "sample_id",
            "features",
            "label",
        )

    @cached_property
    def train(self) -> DataFrame:
        both = self.samples.withColumn("bucket", F.explode(F.array(F.lit(0), F.lit(1))))
        spot = (F.col("sample_id") * 7919 + F.col("bucket") * 104729) % 1000
        return both.filter(spot < 600).withColumn("bucket", F.col("bucket").cast("long"))

    @cached_property
    def predictions(self) -> DataFrame:
        docs = self.given("documents").select("doc_id", "lang", "source")
        labels = self.given("labels")
        return labels.join(docs, "doc_id").select(
            F.col("lang").alias("run_id"),
            F.col("source").alias("dataset"),
            F.col("doc_id").alias("sample_id"),
            (F.col("doc_id") % 4).alias("cycle"),
            F.col("quality").alias("label"),
            F.col("toxic").alias("y_pred"),
            F.when(F.col("doc_id") % 5 < 3, "train").otherwise("test").alias("part"),
        )

    @cached_property
    def part_predictions(self) -> DataFrame:
        """Repeated predictions of parts: many runs predict the same sample."""
        return self.lines.select(
            (F.col("sample_id") % 5).alias("dataset"),
            "run_id",
            "cycle",
            "sample_id",
            "y_pred",
            (F.col("sample_id") % 3).alias("label"),
        )

    @cached_property
    def full_mean(self) -> DataFrame:
        """Score table of the flagship board: mean curve per run."""
        return (
            self.curve.filter("cycle > 0")
            .groupBy("run_id", "dataset", "strategy", "fingerprint")
            .agg(F.avg("value").alias("value"))
        )

    @cached_property
    def probabilities(self) -> DataFrame:
        return self.with_probabilities(self.samples)

    @staticmethod
    def with_probabilities(samples: DataFrame) -> DataFrame:
        """Class probabilities of each sample: softmax of five fixed vector slices."""
        sums = F.transform(
            F.sequence(F.lit(0), F.lit(4)),
            lambda i: F.aggregate(
                F.slice("features", i * 12 + 1, 12), F.lit(0.0), lambda s, x: s + x
            ),
        )
        weights = samples.withColumn("__w", F.transform(sums, lambda x: F.exp(x)))
        whole = F.aggregate("__w", F.lit(0.0), lambda s, x: s + x)
        return (
            weights.withColumn("__t", whole)
            .withColumn("p", F.transform("__w", lambda x: x / F.col("__t")))
            .drop("__w", "__t")
        )

    @cached_property
    def votes(self) -> DataFrame:
        """Five committee members: the strongest of four columns in each vector slice."""
        member = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("member")
        rows = self.samples.select("sample_id", "features", member)
        part = F.slice("features", F.col("member") * 12 + 1, 4)
        return rows.select(
            "sample_id",
            "member",
            part.alias("w"),
            (F.array_position(part, F.array_max(part)) - 1).alias("y_pred"),
        )


CTE = {
    "curve": """curve as (
  select user_id * 10 + case event_type when 'signup' then 0 when 'click' then 1
           when 'view' then 2 when 'purchase' then 3 else 4 end as run_id,
         user_id % 10 as dataset, event_type as strategy, user_id as fingerprint,
         row_number() over (partition by user_id, event_type order by ts, event_id) - 1 as cycle,
         value
  from events)""",
    "gappy": """gappy as (
  select run_id, dataset, strategy, fingerprint, cycle,
         case when value >= 2 then value end as value from curve)""",
    "runs": """runs as (
  select o_orderkey as run_id, c_nationkey as dataset, o_orderpriority as strategy,
         o_orderstatus as learner, c_mktsegment as batch, o_custkey % 20 as start_point,
         cast(year(o_orderdate) as integer) as bucket, o_totalprice as value,
         case o_orderstatus when 'F' then 'done' when 'O' then 'open' else 'failed' end as status
  from orders join customer on o_custkey = c_custkey)""",
    "lines": """lines as (
  select l_orderkey as run_id,
         row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber, l_partkey,
           l_suppkey, l_quantity, l_extendedprice) - 1 as cycle,
         l_discount as discount, l_quantity as value, l_extendedprice as price,
         l_partkey as sample_id, l_linenumber % 3 as y_pred
  from lineitem)""",
    "samples": """samples as (
  select label // 100 as dataset, vec_id as sample_id, embedding::double[] as features, label
  from embeddings)""",
    "sample_sets": """sample_sets as (
  select cast(sample_id % 3 as integer) as dataset, sample_id // 3 as sample_id, features, label
  from samples)""",
    "picks": """picks as (
  select dataset, sample_id // 50 as run_id, (sample_id // 50) % 2 as bucket,
         sample_id % 5 as cycle, sample_id, features, label
  from samples)""",
    "train": """train as (
  select s.*, b.bucket from samples s cross join (values (0), (1)) b(bucket)
  where (sample_id * 7919 + bucket * 104729) % 1000 < 600)""",
    "predictions": """predictions as (
  select lang as run_id, source as dataset, doc_id as sample_id, doc_id % 4 as cycle,
         quality as label, toxic as y_pred,
         case when doc_id % 5 < 3 then 'train' else 'test' end as part
  from labels join documents using (doc_id))""",
    "part_predictions": """part_predictions as (
  select sample_id % 5 as dataset, run_id, cycle, sample_id, y_pred, sample_id % 3 as label
  from lines)""",
    "full_mean": """full_mean as (
  select run_id, dataset, strategy, fingerprint, avg(value) as value
  from curve where cycle > 0 group by all)""",
    "probabilities": """weights as (
  select *, [exp(list_sum(features[i * 12 + 1 : i * 12 + 12])) for i in range(5)] as w
  from samples),
probabilities as (
  select dataset, sample_id, features, label, [x / list_sum(w) for x in w] as p
  from weights)""",
    "votes": """votes as (
  select sample_id, member, features[member * 12 + 1 : member * 12 + 4] as w,
         list_position(features[member * 12 + 1 : member * 12 + 4],
                       list_max(features[member * 12 + 1 : member * 12 + 4])) - 1 as y_pred
  from samples cross join (select unnest(range(5)) as member))""",
}

NEEDS = {
    "sample_sets": ["samples"],
    "gappy": ["curve"],
    "picks": ["samples"],
    "train": ["samples"],
    "part_predictions": ["lines"],
    "full_mean": ["curve"],
    "probabilities": ["samples"],
    "votes": ["samples"],
}


def sql(body: str, *tables: str, extra: str = "") -> str:
    """SQL text with the named tables, and what they need, in front."""
    wanted: list[str] = []
    for name in tables:
        for need in [*NEEDS.get(name, []), name]:
            if need not in wanted:
                wanted.append(need)
    parts = [CTE[name] for name in wanted]
    if extra:
        parts.append(extra.strip().rstrip(","))
    head = "with " + ",\n".join(parts) + "\n" if parts else ""
    return head + body.strip()

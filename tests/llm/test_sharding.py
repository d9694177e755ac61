import zlib
from collections import Counter

from conftest import documents
from pyspark.sql import functions as F

from curveboard.llm import sharding


def test_weights_and_strict_growth(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    weights = [1.0, 2.0, 3.0, 0.0, 2.0, 1.0, 1.0, 4.0, 2.0]
    heavier = list(weights)
    heavier[4] = 3.0
    out = sharding.placed(ids, "doc_id", weights)
    out = sharding.placed(out, "doc_id", [*weights, 2.0], "joined")
    out = sharding.placed(out, "doc_id", heavier, "heavier").collect()
    share = Counter(r.shard for r in out)
    for i, w in enumerate(weights):
        assert abs(share[i] / 20_000 - w / sum(weights)) < 0.015
    assert {r.joined for r in out if r.joined != r.shard} == {9}
    assert {r.heavier for r in out if r.heavier != r.shard} == {4}
    moved = sum(r.heavier != r.shard for r in out) / 20_000
    assert 0.02 < moved < 0.09


def test_query_columns(spark, odd_documents, no_documents):
    df = odd_documents.union(documents(spark, [f"t{i}" for i in range(500)], first=100)).repartition(4)
    out = sharding.shard_documents(df, slice_rows=3).collect()
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    assert len(out) == len(texts)
    for r in out:
        raw = texts[r.doc_id].encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.law == "key"
        assert r.grown_shard in (r.shard, 16)
    for shard in range(16):
        slots = sorted(r.slot for r in out if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(no_documents).count() == 0


def test_no_python_in_the_plan(odd_documents):
    plan = sharding.shard_documents(odd_documents)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_null_keys_and_bad_weights(spark):
    df = spark.createDataFrame([(None,), (None,), (1,)], "doc_id long")
    shards = [r.shard for r in sharding.placed(df, "doc_id", [1.0] * 4).filter(F.col("doc_id").isNull()).collect()]
    assert len(set(shards)) == 1
    try:
        sharding.placed(df, "doc_id", [0.0, 0.0])
    except ValueError:
        return
    raise AssertionError("weights without a positive one were taken")

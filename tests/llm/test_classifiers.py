import zlib

import pyarrow.parquet as pq
import pytest
from conftest import SMALL, documents
from pyspark.sql import functions as F

from curveboard.llm import language, quality, queries, toxicity

MIDDLE = SMALL.replace("0.001", "0.01")


@pytest.fixture(scope="module")
def labels():
    return {r["doc_id"]: r for r in pq.read_table(f"{MIDDLE}/labels.parquet").to_pylist()}


def test_quality_on_held_out_rows(spark, labels):
    out = queries.QUERIES["op8_ftrl_quality"](spark, MIDDLE).collect()
    assert len(out) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    held = [r for r in out if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id]["quality"] for r in held)
    assert right / len(held) >= 0.95


def test_severity_separates_toxic_texts(spark, labels):
    out = {r.doc_id: r for r in queries.QUERIES["op7_ordinal_toxicity"](spark, MIDDLE).collect()}
    clean = [out[d] for d, r in labels.items() if r["toxic"] == 0]
    toxic = [out[d] for d, r in labels.items() if r["toxic"] == 1]
    assert sum(r.toxic for r in clean) <= 0.01 * len(clean)
    assert sum(r.toxic for r in toxic) >= 0.8 * len(toxic)
    assert all(0 <= r.severity <= 2 and r.severity >= r.p_toxic - 1e-9 for r in out.values())


def test_toxicity_on_held_out_rows(spark):
    """Fitted on four fifths of the labels of a table with hundreds of toxic rows, measured on the others."""
    large = SMALL.replace("0.001", "0.1")
    given = spark.read.parquet(f"{large}/labels.parquet")
    held = (queries.crc_of("doc_id") % 5 == 0).alias("held")
    out = toxicity.toxicity(spark.read.parquet(f"{large}/documents.parquet"), given.filter(~held))
    both = out.join(given.withColumnRenamed("toxic", "label"), "doc_id").filter(held)
    found = {r.label: (r.n, r.caught) for r in both.groupBy("label").agg(F.count("*").alias("n"), F.count_if("toxic").alias("caught")).collect()}
    assert found[0][1] <= 0.02 * found[0][0] and found[1][1] >= 0.75 * found[1][0] and found[1][0] > 50


def test_severity_grows_with_the_share_of_insults(spark):
    plain = [f"word{i} other{i % 7} text{i % 11} calm" for i in range(200)]
    rude = [f"word{i} " + "nasty vile " * (1 + 5 * (i % 2)) + "calm" for i in range(60)]
    docs = documents(spark, [*plain, *rude])
    marks = spark.createDataFrame([(i, int(i >= 200)) for i in range(260)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, marks)
    by = {r.doc_id: r for r in out.collect()}
    assert not any(by[i].toxic for i in range(200)) and all(by[i].toxic for i in range(200, 260))
    assert sorted(toxicity.clean_documents(docs, marks).columns) == sorted(docs.columns)
    assert toxicity.clean_documents(docs, marks).count() == 200


def test_language_on_held_out_rows(spark):
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{MIDDLE}/documents.parquet").to_pylist()}
    out = queries.QUERIES["op10_centroid_language"](spark, MIDDLE).collect()
    assert len(out) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) >= 0.96
    assert all(0 <= r.score <= 1 for r in out)


def test_undetermined_and_rejected(spark, odd_documents, no_documents):
    train = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(train, 4, 300)
    out = {r.doc_id: r for r in language.predicted(odd_documents, model).collect()}
    und = {i for i, r in out.items() if r.lang_pred == "und"}
    assert und == {0, 1, 2, 11}
    assert out[8].rejected and all(out[i].score == 0 for i in und)
    assert language.languages(odd_documents, F.lit(True)).count() == odd_documents.count()
    assert language.languages(no_documents, F.lit(True)).count() == 0
    nothing = language.languages(odd_documents.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


@pytest.mark.parametrize("marks", [[], [(3, 1), (4, 1)], [(3, None), (None, 0)]])
def test_odd_rows_and_few_labels(spark, odd_documents, no_documents, marks):
    for name in ("quality", "toxic"):
        given = spark.createDataFrame(marks, f"doc_id long, {name} int")
        if name == "quality":
            out = quality.quality_scores(odd_documents, given, F.lit(True))
            kept = quality.good_documents(odd_documents, given, F.lit(True))
            empty = quality.quality_scores(no_documents, given, F.lit(True))
            if not [m for m in marks if None not in m]:
                assert {r.score for r in out.collect()} == {0.5}
        else:
            out = toxicity.toxicity(odd_documents, given)
            kept = toxicity.clean_documents(odd_documents, given)
            empty = toxicity.toxicity(no_documents, given)
            if not [m for m in marks if None not in m]:
                assert kept.count() == odd_documents.count()
        assert out.count() == odd_documents.count()
        assert kept.columns == odd_documents.columns
        assert empty.count() == 0


def test_equal_texts_get_equal_scores(spark):
    docs = documents(spark, ["same text here", "same text here", "other"])
    given = spark.createDataFrame([(0, 1), (2, 0)], "doc_id long, quality int")
    by = {r.doc_id: r.score for r in quality.quality_scores(docs, given, F.lit(True)).collect()}
    assert by[0] == by[1] > by[2]


def test_every_language_is_learned(spark):
    """More languages than any fixed number, each with words of its own."""
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{i}q" for i in range(1100)]
    texts = [f"{w} {w}x {w}y" for w in words for _ in range(2)]
    docs = documents(spark, texts, [w for w in words for _ in range(2)])
    model = language.fit(docs.select("doc_id", "text", "lang"), 1, 5)
    assert sorted(model["names"]) == sorted(words)

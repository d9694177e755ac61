import glob
import random
import zlib
from array import array

import numpy as np
import pyarrow.orc as orc
import pyarrow.parquet as pq
import pytest
from conftest import SMALL, documents, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from curveboard.llm import orcfile
from curveboard.llm.queries import tokenizer

PATH = tokenizer("word_bpe_49k.json")


def library_rows(rows):
    """Ids by the library alone, in order of doc_id; equal ids by nothing but their set of rows."""
    library = Tokenizer.from_file(PATH)
    return [(i, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows]


def digest(spark, docs, folder):
    orcfile.write_tokens(docs, PATH, folder)
    tokens = orcfile.read_tokens(spark, folder)
    return orcfile.placed(orcfile.checksums(tokens), tokens.select("part", "start", "n_tokens"))


def test_ids_equal_the_library(spark, odd_documents, tmp_path):
    texts = ["It's WE'LL <|endoftext|>x <|startoftext|> a<|endoftext|>", "ΑΣ ΣΑΣ İİ é x\x85y ́z", "ﬁ \x1c\x1d½ ①"]
    docs = odd_documents.union(documents(spark, texts, first=100))
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    orcfile.write_tokens(docs, PATH, str(tmp_path / "t"))
    back = {r.doc_id: list(r.ids) for r in orcfile.read_tokens(spark, str(tmp_path / "t")).collect()}
    assert back == dict(library_rows(rows))
    start, expected = 0, []
    for i, ids in library_rows(rows):
        expected.append((i, start, len(ids), zlib.crc32(array("I", ids))))
        start += len(ids)
    out = digest(spark, docs, str(tmp_path / "u")).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(tuple(r) for r in out.collect()) == expected


def word_ids(text):
    return np.frombuffer(orcfile.WordEncoder(PATH).encode([text.encode()])[0], np.uint32).tolist()


def test_slices_of_long_texts(monkeypatch):
    text = prose(4, 3000) + " " + "y" * 500 + "\t" + prose(5, 200)
    plain = word_ids(text)
    assert plain == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(orcfile, "SLICE_BYTES", 64)
    monkeypatch.setattr(orcfile, "WORDS", 100)
    assert word_ids(text) == plain


def test_both_encoders_agree():
    """Every character of the fast set, random words over it, and all words of a table."""
    rng = random.Random(8)
    signs = [chr(c) for c in range(0x21, 0x180) if orcfile.FAST.fullmatch(chr(c))]
    common = "aeinorst'"
    words = [x for c in signs for x in (c, f"a{c}", f"{c}b", f"{c}'s", f"1{c}2", f"{c}{c}", f"{c}\u0301")]
    words += ["".join(rng.choice(signs if rng.random() < 0.3 else common) for _ in range(rng.randint(1, 14))) for _ in range(40_000)]
    table = pq.read_table(SMALL.replace("0.001", "0.01") + "/documents.parquet", columns=["text"])["text"]
    words += sorted({w for t in table.to_pylist() for w in (t or "").split()})
    encoder = orcfile.WordEncoder(PATH)
    fast = encoder.coded([w.encode() for w in dict.fromkeys(words)])
    slow = encoder.slow([w.encode() for w in words])
    assert {w: v for w, v in fast.items() if v != slow[w]} == {}


def test_repeated_and_missing_ids_are_gapless(spark, tmp_path):
    rows = [(None, "a"), (4, "b c"), (4, "b c"), (4, "d"), (None, None), (2, "")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = digest(spark, docs, str(tmp_path / "t")).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in out) == sorted((str(i), len(ids)) for i, ids in library_rows(rows))
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(out, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def test_empty_table(spark, no_documents, tmp_path):
    assert digest(spark, no_documents, str(tmp_path / "t")).count() == 0


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("orc") / "t")
    docs = spark.range(60_000).select(
        (F.col("id") * 3).alias("doc_id"), F.concat_ws(" ", *(F.hash("id", F.lit(i)) for i in range(12))).alias("text")
    )
    was = orcfile.ORC["orc.stripe.size"]
    orcfile.ORC["orc.stripe.size"] = str(64 << 10)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        orcfile.write_tokens(docs, PATH, folder)
        yield folder
    finally:
        orcfile.ORC["orc.stripe.size"] = was
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def scanned(df):
    """Rows that the scan of a counted table handed on."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_files_are_ranges_in_stripes(many):
    ends = []
    for name in glob.glob(f"{many}/*.orc"):
        file = orc.ORCFile(name)
        ids = file.read(["doc_id"])["doc_id"].to_pylist()
        if ids:
            assert ids == sorted(ids) and file.nstripes > 1
            ends.append((ids[0], ids[-1]))
    ends.sort()
    assert len(ends) > 1 and all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def test_metadata_prune_stripes_and_row_groups(spark, many):
    one = orcfile.read_tokens(spark, many, low=90_000, high=90_300)
    assert one.count() == 101 and scanned(one) < 12_000
    # inside the range of a row group, but not in its Bloom filter
    absent = orcfile.read_tokens(spark, many, doc_ids=[90_001, 120_001])
    assert absent.count() == 0 and scanned(absent) == 0
    present = orcfile.read_tokens(spark, many, doc_ids=[90_000])
    assert present.count() == 1 and 1 <= scanned(present) <= 2000


def test_stripes_are_read_side_by_side(spark, many):
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 << 10))
    try:
        files = len(glob.glob(f"{many}/*.orc"))
        assert orcfile.read_tokens(spark, many).rdd.getNumPartitions() > files
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)

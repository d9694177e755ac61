"""The operators as named queries on the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curveboard.llm import (
    hilbert,
    hyperplanes,
    language,
    lexical,
    minhash,
    orcfile,
    packing,
    pieces,
    quality,
    repair,
    sharding,
    suffixes,
    toxicity,
)
from curveboard.llm.labelled import crc_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Most operators of this family cannot be written in SQL that runs on whole tables; tests compare with brute force.
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op6_hash_tree_shards(spark, sf_dir):
    """16 shards by hierarchical weighted hash tree under the law ``key``."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query
def op7_ordinal_toxicity(spark, sf_dir):
    """Expected severity of every document by cumulative-link regression."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_ftrl_quality(spark, sf_dir):
    """Quality of every document by hashed n-gram logistic regression."""
    held_out = crc_of("doc_id") % 5 == 0
    scores = quality.quality_scores(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out
    )
    return scores.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


@query
def op9_bin_slack_packing(spark, sf_dir):
    """All documents in sequences of 2048 tokens by minimum bin slack."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query
def op10_centroid_language(spark, sf_dir):
    """Language of every document by nearest TF-IDF centroid."""
    held_out = crc_of("doc_id") % 4 == 2
    found = language.languages(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@query
def op2_sampled_pieces(spark, sf_dir):
    """Sampled SentencePiece ids of every document."""
    return pieces.encoded(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


@query
def op3_bag_minhash(spark, sf_dir):
    """Near-duplicate class of every document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op1_suffix_array_dedup(spark, sf_dir):
    """Bytes of every document that no earlier 100-byte string covers."""
    return suffixes.without_repeats(table(spark, sf_dir, "documents"))


@query
def op4_hyperplane_links(spark, sf_dir):
    """Links and component of every vector within its label."""
    return hyperplanes.near_vectors(table(spark, sf_dir, "embeddings"))


ORACLES["op4_hyperplane_links"] = """
WITH v AS MATERIALIZED (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93
),
reach AS (
    WITH RECURSIVE r(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM r JOIN links l ON l.a = r.b)
    SELECT a, min(b) AS root FROM r GROUP BY a
)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(root, e.vec_id)) AS component_id,
       least(e.vec_id, coalesce(root, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN reach ON reach.a = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) c ON c.a = e.vec_id
"""


@query
def op5_hilbert_neighbours(spark, sf_dir):
    """The 10 nearest vectors of every hundredth vector."""
    return hilbert.nearest_vectors(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


@query
def op11_conversation_repair(spark, sf_dir):
    """Faults and cheapest repair of every conversation, after damage by the checksum of its turns."""
    return repair.repair_reports(repair.damaged(table(spark, sf_dir, "conversations")))


@query
def op12_lexical_search(spark, sf_dir):
    """The 20 best documents of every benchmark item."""
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op12_lexical_search"] = r"""
WITH words AS (
    SELECT d.n AS row, d.doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS n, doc_id, text FROM documents) d
),
counts AS (SELECT row, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT row, sum(tf)::BIGINT AS n FROM counts GROUP BY row),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), total
),
asked AS (
    SELECT item_id, term, count(*) AS times
    FROM (SELECT item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
          FROM (SELECT DISTINCT item_id, text FROM benchmark))
    GROUP BY ALL
),
scores AS (
    SELECT item_id, doc_id,
           sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
    FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN sizes USING (row), total
    GROUP BY item_id, row, doc_id
)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
      FROM scores WHERE score > 0)
WHERE rank <= 20
"""


@query
def op13_orc_tokens(spark, sf_dir):
    """Place, length and checksum of every document's ids, from the ORC files they were written to."""
    docs = table(spark, sf_dir, "documents")
    folder = orcfile.token_files(docs, tokenizer("word_bpe_49k.json"))
    tokens = orcfile.read_tokens(spark, folder)
    parts = tokens.select("part", "start", "n_tokens")
    return orcfile.placed(orcfile.checksums(tokens), parts)

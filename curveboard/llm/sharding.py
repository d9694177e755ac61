"""Sharding by a hierarchical weighted hash tree, in Spark expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curveboard.llm.store import numbered


def draw(key: Column, shard: int, weight: float, seed: int) -> Column:
    """Exponential waiting time of one shard: the larger the weight, the sooner it comes."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard), F.lit(seed)), 11)
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 53))) / F.lit(float(weight))


def descend(key: Column, weights: Sequence[float], rack: int, region: int, seed: int) -> Column:
    """Shard of a key: the region with the least draw, in it the rack, in it the shard.

    A rack's draw is the least of its shards', a region's the least of its racks'. So a subtree
    wins in proportion to its weight, and when the weight of one shard grows, or a shard joins,
    a row either stays or goes to that shard: no other subtree gains or trades rows. The result is
    that of rendezvous hashing over the leaves; draws by summed weights alone, without the leaves',
    would also send rows to the other shards of the rack that grows, which the law ``key`` rules out.
    """
    racks = [range(i, min(i + rack, len(weights))) for i in range(0, len(weights), rack)]
    regions = [racks[i : i + region] for i in range(0, len(racks), region)]
    draws = [draw(key, i, w, seed) if w > 0 else F.lit(float("inf")) for i, w in enumerate(weights)]

    def least(values: list[Column]) -> Column:
        return F.least(*values) if len(values) > 1 else values[0]

    def first(pairs: list[tuple[Column, Column]]) -> Column:
        """Result of the first child whose draw is the least."""
        if len(pairs) == 1:
            return pairs[0][1]
        best, out = least([d for d, _ in pairs]), None
        for d, value in pairs[:-1]:
            out = F.when(d == best, value) if out is None else out.when(d == best, value)
        return out.otherwise(pairs[-1][1])

    def in_rack(shards: range) -> tuple[Column, Column]:
        return least([draws[i] for i in shards]), first([(draws[i], F.lit(i)) for i in shards])

    def in_region(group: list[range]) -> tuple[Column, Column]:
        inner = [in_rack(r) for r in group]
        return least([d for d, _ in inner]), first(inner)

    return first([in_region(g) for g in regions]).cast("int")


def placed(
    df: DataFrame,
    key: str,
    weights: Sequence[float],
    name: str = "shard",
    rack: int = 4,
    region: int = 2,
    seed: int = 17,
) -> DataFrame:
    """Add the shard of each row; only the key and the weights decide.

    Rows of equal keys share a shard; a null key is a key like any other. Shards of weight 0 get
    no rows. At least one weight must be positive.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("no shard has a positive weight")
    return df.withColumn(name, descend(F.col(key), weights, rack, region, seed))


def shard_documents(docs: DataFrame, shards: int = 16, slice_rows: int = 20_000) -> DataFrame:
    """Shard, slot and checksum of each document, and its shard if one more shard joined.

    Empty and null texts have size 1 and checksum 0; equal texts of different ids may part, as the
    id alone decides. Slots are gapless from 0 within a shard. Columns other than ``doc_id`` and
    ``text`` are ignored. An empty table gives an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    both = placed(placed(sized, "doc_id", [1.0] * shards), "doc_id", [1.0] * (shards + 1), "grown_shard")
    slices = 1 + docs.select("doc_id").count() // (shards * slice_rows)
    out = numbered(both, ["shard"], ["doc_id"], "slot", slices)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long"), "grown_shard")

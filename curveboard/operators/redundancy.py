"""Fingerprints whose strategy vectors repeat those of others: correlated pairs, and a greedy choice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curveboard.operators.cells import pairs_within, written

#: Fingerprints that are decided among themselves before later ones are compared with the kept ones.
FIRST_ROWS = 4096


def standardised(values: Column) -> Column:
    """Values less their mean, at length 1; null where they do not vary."""
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)
    centred = F.transform(values, lambda x: x - mean)
    length = F.sqrt(F.aggregate(centred, F.lit(0.0), lambda s, x: s + x * x))
    noise = F.abs(mean) * 1e-13 * F.sqrt(F.size(values).cast("double"))
    return F.when(length > noise, F.transform(centred, lambda x: x / length))


def profiles(vectors: DataFrame, item: str = "strategy", value: str = "value") -> DataFrame:
    """(fingerprint, items, values): the items a fingerprint has a value for, in order."""
    cells = vectors.filter(F.col(value).isNotNull()).groupBy("fingerprint", item).agg(
        F.avg(value).cast("double").alias("v")
    )
    cell = F.sort_array(F.collect_list(F.struct(F.col(item).alias("i"), "v")))
    rows = cells.groupBy("fingerprint").agg(cell.alias("c"))
    return rows.select("fingerprint", F.col("c.i").alias("items"), F.col("c.v").alias("values"))


def correlated_pairs(
    rows: DataFrame,
    threshold: float,
    note: Callable[[DataFrame], None] | None = None,
    size: Column | None = None,
) -> DataFrame:
    """(a, b, r), a < b: pairs of profiles with Pearson r above ``threshold`` over their common items.

    r is the cosine of the standardised values, so an index of cells finds the pairs without comparing
    all. Profiles with the same items form one group; those of two item lists meet, standardised over
    the common items, in a group of their own. A profile is copied once per item list, of which there
    are few: a strategy fails for whole settings. ``size`` sets the rows of a cell.
    """
    met = _met(rows, rows.agg(F.collect_set("items")).scalar())
    own, other = F.col("own"), F.col("other")
    units = met.select(
        F.least(own, other).alias("lists_low"),
        F.greatest(own, other).alias("lists_high"),
        "id",
        F.when(own != other, (own < other).cast("int")).alias("side"),
        "unit",
    )
    found = pairs_within(units, ["lists_low", "lists_high"], threshold, size, note)
    return found.select("a", "b", F.col("cosine").alias("r"))


def _met(rows: DataFrame, lists: Column) -> DataFrame:
    """(own, other, id, unit): each profile once per item list it shares two items with, over these."""
    met = rows.withColumn("q", F.explode(lists)).withColumn("common", F.array_intersect("items", "q"))
    pair = F.zip_with("items", "values", lambda i, v: F.struct(i.alias("i"), v.alias("v")))
    inside = F.transform(F.filter(pair, lambda c: F.array_contains("common", c["i"])), lambda c: c["v"])
    units = met.filter(F.size("common") >= 2).select(
        F.xxhash64("items").alias("own"),
        F.xxhash64("q").alias("other"),
        F.col("fingerprint").alias("id"),
        standardised(inside).alias("unit"),
    )
    return units.filter("unit is not null")


def repeats_of(
    first: DataFrame,
    later: DataFrame,
    threshold: float,
    note: Callable[[DataFrame], None] | None = None,
    size: Column | None = None,
) -> DataFrame:
    """(a, b, r): profiles a of ``first`` and b of ``later`` with Pearson r above ``threshold``, a < b.

    As ``correlated_pairs``, but profiles of one table are not compared with each other. All
    fingerprints of ``first`` are smaller than those of ``later``.
    """
    both = first.select("items").unionByName(later.select("items"))
    lists = both.agg(F.collect_set("items")).scalar()
    left = _met(first, lists).select(
        F.col("own").alias("list_first"), F.col("other").alias("list_later"), "id", F.lit(0).alias("side"), "unit"
    )
    right = _met(later, lists).select(
        F.col("other").alias("list_first"), F.col("own").alias("list_later"), "id", F.lit(1).alias("side"), "unit"
    )
    found = pairs_within(left.unionByName(right), ["list_first", "list_later"], threshold, size, note)
    return found.select("a", "b", F.col("cosine").alias("r"))


def greedy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fingerprint, kept, because): a node stays unless a kept one before it is linked to it.

    Rounds decide all nodes without an undecided link to a smaller one, and what these drop; each
    round's decisions are written, and links of decided nodes are not read again.
    """
    links, decided = written(edges.select("a", "b").distinct()), None
    waiting = written(nodes.select("fingerprint").distinct())
    while True:
        blocked = links.select(F.col("b").alias("fingerprint")).distinct()
        stay = waiting.join(blocked, "fingerprint", "left_anti")
        stay = written(stay.select("fingerprint", F.lit(True).alias("kept"), F.col("fingerprint").alias("because")))
        lost = (
            links.join(stay.select(F.col("fingerprint").alias("a")), "a")
            .groupBy(F.col("b").alias("fingerprint"))
            .agg(F.lit(False).alias("kept"), F.min("a").alias("because"))
        )
        now = written(stay.unionByName(lost))
        decided = now if decided is None else decided.unionByName(now)
        waiting = written(waiting.join(now, "fingerprint", "left_anti"))
        gone = now.select("fingerprint")
        links = links.join(gone.withColumnRenamed("fingerprint", "a"), "a", "left_anti")
        links = written(links.join(gone.withColumnRenamed("fingerprint", "b"), "b", "left_anti"))
        if waiting.isEmpty():
            return decided.select("fingerprint", "kept", F.when(~F.col("kept"), F.col("because")).alias("because"))


def independent(
    vectors: DataFrame,
    threshold: float = 0.95,
    item: str = "strategy",
    value: str = "value",
    note: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """(fingerprint, kept, because): in order of the fingerprints, each stays unless it repeats a kept one.

    Profiles that are equal once standardised are one row of the search; the first of them stands for
    all, and whatever drops it drops the others. Fingerprints that are null, with fewer than two values,
    or values that do not vary, repeat nothing.

    The first ``FIRST_ROWS`` or so are decided among themselves; all later ones that repeat a kept one of
    them are dropped, and the next part, twice as large, is taken from what is left. So the pairs found
    are those of a part and those with a kept one, not all that are above the threshold.
    """
    vectors = written(vectors.select("fingerprint", item, value))
    rows = written(profiles(vectors, item, value).withColumn("unit", standardised(F.col("values"))))
    same = rows.filter("unit is not null").groupBy("items", "unit").agg(
        F.min("fingerprint").alias("rep"), F.count(F.lit(1)).alias("copies")
    )
    copies = rows.join(same.filter("copies > 1"), ["items", "unit"]).filter("fingerprint <> rep")
    copies = written(copies.select("fingerprint", "rep"))
    left = rows.join(copies, "fingerprint", "left_anti").filter("unit is not null and fingerprint is not null")
    left = written(left.select("fingerprint", "items", "values"))
    names = written(vectors.select("fingerprint").distinct())
    free = names.join(rows.filter("unit is not null").select("fingerprint"), "fingerprint", "left_anti")
    none = F.lit(None).cast(names.schema["fingerprint"].dataType)
    out = free.select("fingerprint", F.lit(True).alias("kept"), none.alias("because"))
    part_rows, waiting = FIRST_ROWS, left.count()
    while waiting:
        # about as many of the smallest fingerprints, by a bounded sample of them
        turn = F.pmod(F.xxhash64("fingerprint"), F.lit(max(1, part_rows // 256)))
        bound = left.filter(turn == 0).orderBy("fingerprint").limit(min(256, part_rows)).agg(F.max("fingerprint"))
        last = waiting <= part_rows
        part = left if last else written(left.filter(F.col("fingerprint") <= bound.scalar()))
        pairs = correlated_pairs(part, threshold, note)
        decided = written(greedy(part.select("fingerprint"), pairs))
        out = out.unionByName(decided)
        if last:
            break
        later = left.join(decided, "fingerprint", "left_anti")
        kept = part.join(decided.filter("kept"), "fingerprint", "left_semi")
        lost = repeats_of(kept, later, threshold, note).groupBy(F.col("b").alias("fingerprint")).agg(
            F.lit(False).alias("kept"), F.min("a").alias("because")
        )
        lost = written(lost)
        out = out.unionByName(lost)
        left = written(later.join(lost, "fingerprint", "left_anti"))
        part_rows, waiting = 2 * part_rows, left.count()
    reps = out.select(F.col("fingerprint").alias("rep"), F.col("because").alias("why"))
    more = copies.join(reps, "rep").select("fingerprint", F.lit(False).alias("kept"), F.coalesce("why", "rep").alias("because"))
    return out.unionByName(more)

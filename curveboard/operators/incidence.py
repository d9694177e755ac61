"""Boards of many scenarios as block products of an incidence matrix.

A scenario is a bitset over the settings it picked. Tasks meet a block of scenarios with the cells of one
dataset: sums and counts are matrix products, and so are the counts per bin of values, which tell the bin
of every wanted rank. Only these bins are opened, again as products of bitsets and counts.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from curveboard.operators.cells import cogrouped, written
from curveboard.session import cut_lineage

#: Scenarios of a block, and bins of a dataset's values.
BLOCK, BINS = 256, 256


def settings(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, at): the distinct settings, numbered from 0, within a dataset where it is one of the keys."""
    of = W.partitionBy(F.col("dataset") if "dataset" in keys else F.lit(0)).orderBy(*keys)
    return scores.select(*keys).distinct().withColumn("at", (F.row_number().over(of) - 1).cast("int"))


def bits(rows: np.ndarray, places: np.ndarray, count: int, width: int) -> np.ndarray:
    """count x width matrix of 0 and 1 from coordinates."""
    out = np.zeros((count, width))
    out[rows, places] = 1.0
    return out


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Row of each element of a list column, and the elements."""
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten()


def binned(scores: DataFrame, keyed: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """(dataset, at, bin, v, c): counts of the distinct values of each setting.

    Bins are cut at quantiles of a sketch per dataset, which is written down, so every stage sees the
    same bins and a bin holds about the same share of a dataset's rows, whatever its distribution.
    """
    grid = [i / bins for i in range(1, bins)]
    seen = scores.filter("value is not null").select(*dict.fromkeys([*keys, "dataset"]), F.col("value").alias("v"))
    cuts = cut_lineage(seen.groupBy("dataset").agg(F.percentile_approx("v", grid, 4 * bins).alias("cuts")))
    counted = seen.join(keyed, keys).groupBy("dataset", "at", "v").agg(F.count(F.lit(1)).alias("c"))

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            dataset = table["dataset"].combine_chunks().dictionary_encode()
            v, lists = table["v"].to_numpy().astype(float), table["cuts"].combine_chunks()
            found = np.zeros(len(v), np.int32)
            code = dataset.indices.to_numpy(zero_copy_only=False)
            for d in np.unique(code):
                own = np.flatnonzero(code == d)
                found[own] = np.searchsorted(np.asarray(lists[int(own[0])].as_py(), float), v[own])
            columns = [table[c].combine_chunks() for c in ("dataset", "at")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(found), table["v"].combine_chunks(), table["c"].combine_chunks()],
                names=["dataset", "at", "bin", "v", "c"],
            )

    kind = {f.name: f.dataType.simpleString() for f in counted.schema}
    schema = f"dataset {kind['dataset']}, at int, bin int, v {kind['v']}, c long"
    return counted.join(cuts, "dataset").mapInArrow(place, schema)


def boards(
    cells: DataFrame,
    scores: DataFrame,
    picks: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    probs: dict[str, float],
    bins: int = BINS,
) -> tuple[DataFrame, DataFrame]:
    """Cells (by, dataset, strategy, s, n, lo, hi) and exact percentiles (by, dataset, probs) per scenario."""
    keys, by = list(keys), list(by)
    keyed = cut_lineage(settings(scores, keys))
    valued = written(binned(scores, keyed, keys, bins))
    own = cells.join(keyed, keys).groupBy("dataset", "at").agg(
        F.collect_list(F.struct("strategy", "s", "n", "lo", "hi")).alias("cells")
    )
    counts = valued.groupBy("dataset", "at", "bin").agg(F.sum("c").alias("c"))
    counts = counts.groupBy("dataset", "at").agg(F.collect_list(F.struct("bin", "c")).alias("counts"))
    bound = "dataset" in keys
    rows = picks.select(*by, *keys).distinct().join(keyed, keys)
    group = [*by, "dataset"] if bound else by
    asked = rows.groupBy(*group).agg(F.sort_array(F.collect_set("at")).alias("ats"))
    if not bound:
        # a scenario meets every dataset; these are the rows of its board
        names = cells.agg(F.collect_set("dataset"))
        asked = asked.withColumn("dataset", F.explode(names.scalar()))
    asked = written(asked)  # lists read back may hold nulls by type, as the results declare
    blocks = 1 + asked.select(*by).distinct().count() // BLOCK
    right = asked.withColumn("__block", F.pmod(F.xxhash64(*by), F.lit(blocks)).cast("int"))
    left = own.join(counts, ["dataset", "at"], "left").withColumn(
        "__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    kind = {f.name: f.dataType.simpleString() for f in cells.schema}
    mine = ", ".join(f"{b} {asked.schema[b].dataType.simpleString()}" for b in by)
    cell = f"struct<strategy:{kind['strategy']},s:double,n:bigint,lo:double,hi:double>"
    schema = f"{mine}, dataset {kind['dataset']}, ats array<int>, cells array<{cell}>, wanted array<struct<name:int,bin:int,rank:bigint,share:double>>"
    shares = list(probs.values())

    def product(have: pa.Table, ask: pa.Table) -> pa.Table:
        out_schema = pa.schema(
            [*(ask.schema.field(c) for c in (*by, "dataset", "ats")), ("cells", pa.list_(CELL)), ("wanted", pa.list_(WANTED))]
        )
        strategy_type = have.schema.field("cells").type.value_type.field("strategy").type
        CELL_OUT = pa.struct([("strategy", strategy_type), *[(f.name, f.type) for f in CELL][1:]])
        out_schema = out_schema.set(len(by) + 2, pa.field("cells", pa.list_(CELL_OUT)))
        if not have.num_rows or not ask.num_rows:
            return out_schema.empty_table()
        at = have["at"].to_numpy()
        r, places = flat(ask["ats"])
        places = places.to_numpy()
        width = int(max(at.max(), places.max(initial=0))) + 1
        m = bits(r, places, ask.num_rows, width)[:, at]
        row, cell = flat(have["cells"])
        names = cell.field("strategy").dictionary_encode()
        code, count = names.indices.to_numpy(zero_copy_only=False), len(names.dictionary)
        s, n, lo, hi = (cell.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("s", "n", "lo", "hi"))
        sums = {}
        for name, v in (("s", np.nan_to_num(s)), ("n", n), ("there", np.ones(len(n)))):
            dense = np.zeros((len(at), count))
            dense[row, code] = v
            sums[name] = m @ dense
        least, most = np.full((len(m), count), np.inf), np.full((len(m), count), -np.inf)
        for c in range(count):
            mine = np.flatnonzero((code == c) & (n > 0))
            if len(mine):
                inside = m[:, row[mine]] > 0
                least[:, c] = np.where(inside, lo[mine], np.inf).min(axis=1)
                most[:, c] = np.where(inside, hi[mine], -np.inf).max(axis=1)
        i, c = np.nonzero(sums["there"] > 0)
        some = sums["n"][i, c] > 0
        found = pa.StructArray.from_arrays(
            [
                names.dictionary.take(pa.array(c)),
                pa.array(sums["s"][i, c], pa.float64(), mask=~some),
                pa.array(sums["n"][i, c].astype(np.int64)),
                pa.array(least[i, c], pa.float64(), mask=~some),
                pa.array(most[i, c], pa.float64(), mask=~some),
            ],
            fields=list(CELL_OUT),
        )
        lists = pa.ListArray.from_arrays(np.searchsorted(i, np.arange(len(m) + 1)).astype(np.int32), found)
        row, count_of = flat(have["counts"])
        histogram = np.zeros((len(at), bins))
        if len(row):
            histogram[row, count_of.field("bin").to_numpy()] = count_of.field("c").to_numpy()
        upto = np.cumsum(m @ histogram, axis=1)
        total = upto[:, -1]
        parts = []
        for name, p in enumerate(shares):
            exact = p * (total - 1)
            # 1e-9 keeps an integral rank from sliding below itself in floating point
            low = np.floor(exact + 1e-9)
            part = np.maximum(exact - low, 0.0)
            for rank, share in ((low, 1 - part), (np.minimum(low + 1, total - 1), part)):
                bin_of = (upto <= rank[:, None]).sum(axis=1)
                before = np.where(bin_of > 0, upto[np.arange(len(m)), np.maximum(bin_of - 1, 0)], 0)
                parts.append((np.full(len(m), name), bin_of, rank - before, share))
        name, bin_of, rank, share = (np.stack(v, axis=1).ravel() for v in zip(*parts, strict=True))
        wanted = pa.StructArray.from_arrays(
            [pa.array(name, pa.int32()), pa.array(bin_of, pa.int32()), pa.array(rank.astype(np.int64)), pa.array(share)],
            fields=list(WANTED),
        )
        step = 2 * len(shares)
        ends = np.concatenate(([0], np.cumsum(np.where(total > 0, step, 0)))).astype(np.int32)
        wanted = wanted.filter(pa.array(np.repeat(total > 0, step)))
        return pa.table(
            [*(ask[c] for c in (*by, "dataset", "ats")), lists, pa.ListArray.from_arrays(ends, wanted)], schema=out_schema
        )

    met = written(cogrouped(left, right, ["dataset", "__block"], product, schema))
    grouped = met.select(*by, "dataset", F.explode("cells").alias("c")).select(*by, "dataset", "c.*")
    queries = met.select(*by, "dataset", "ats", F.explode("wanted").alias("w")).select(*by, "dataset", "ats", "w.*")
    hits = cogrouped(valued, queries, ["dataset", "bin"], opened(by), f"{mine}, dataset {kind['dataset']}, name int, part double")
    spread = hits.groupBy(*by, "dataset").agg(
        *[F.sum(F.when(F.col("name") == i, F.col("part"))).alias(n) for i, n in enumerate(probs)]
    )
    return grouped, spread


CELL = pa.struct([("strategy", pa.string()), ("s", pa.float64()), ("n", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64())])
WANTED = pa.struct([("name", pa.int32()), ("bin", pa.int32()), ("rank", pa.int64()), ("share", pa.float64())])


def opened(by: list[str]):
    """Value at a rank inside one bin for each scenario, times its share."""

    def value(have: pa.Table, ask: pa.Table) -> pa.Table:
        if not have.num_rows or not ask.num_rows:
            kept = ask.select([*by, "dataset", "name"]).slice(0, 0)
            return kept.append_column("part", pa.array([], pa.float64()))
        have = have.sort_by([("v", "ascending"), ("at", "ascending")])
        at, v, c = have["at"].to_numpy(), have["v"].to_numpy().astype(float), have["c"].to_numpy()
        lists = ask["ats"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        places, rank, share = lists.flatten().to_numpy(), ask["rank"].to_numpy(), ask["share"].to_numpy()
        width = int(max(at.max(), places.max(initial=0))) + 1
        starts = np.concatenate(([0], np.cumsum(sizes)))
        part = np.empty(ask.num_rows)
        # rows of the product are bounded by the cells of a block
        step = max(1, (4 << 20) // max(len(at), width))
        for first in range(0, ask.num_rows, step):
            last = min(first + step, ask.num_rows)
            own = np.repeat(np.arange(last - first), sizes[first:last])
            m = bits(own, places[starts[first] : starts[last]], last - first, width)
            upto = np.cumsum(m[:, at] * c, axis=1)
            place = (upto <= rank[first:last, None]).sum(axis=1)
            part[first:last] = v[np.minimum(place, len(v) - 1)] * share[first:last]
        return ask.select([*by, "dataset", "name"]).append_column("part", pa.array(part))

    return value

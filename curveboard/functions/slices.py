"""Order-dependent building blocks that never put one hot group into one task.

``by_size`` tells very large groups from the others. Ordinary groups take one exchange and one sort,
from which all window functions of an operator are computed. A very large group is cut into slices by
an expression that is monotone in the order: rows are ordered inside ``(group, slice)``, and a small
table with one row per slice carries counts and sums across slices.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from curveboard.session import cut_lineage

SLICE = "__slice"
CHUNK = 1024
#: Rows aimed at in a slice of a random order.
SLICE_ROWS = 4096.0
#: A group of more rows is cut into slices, the largest so many of them.
HOT_ROWS, HOT_KEYS = 1 << 20, 1000


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _strictly_before(keys: Sequence[str]) -> W:
    return W.partitionBy(*keys).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)


def same_keys(keys: Sequence[str]) -> Column:
    """Null-safe equality on all keys between the sides aliased ``l`` and ``r`` of a join."""
    return reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])


def by_size(
    df: DataFrame,
    keys: Sequence[str],
    ordinary: Callable[[DataFrame], DataFrame],
    large: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """One function for the rows of ordinary groups, another for those of very large groups.

    Large are the groups above ``HOT_ROWS``, at most the ``HOT_KEYS`` largest: as many rows reach the
    broadcast that tells them apart, and any other group has less than a thousandth of all rows. The
    counts read the key columns alone. Where no group is large, its branch is empty and is not run.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > HOT_ROWS)
    hot = counts.orderBy(F.desc("__n"), *keys).limit(HOT_KEYS).select(*keys).alias("r")
    rows = df.alias("l")
    few = rows.join(hot, same_keys(keys), "left_anti").select(*[F.col(f"l.{c}") for c in df.columns])
    many = rows.join(hot, same_keys(keys), "left_semi").select(*[F.col(f"l.{c}") for c in df.columns])
    return ordinary(few).unionByName(large(many))


def position(
    df: DataFrame,
    keys: Sequence[str],
    slice_by: Column,
    order_by: Sequence[str | Column],
    name: str = "pos",
) -> DataFrame:
    """0-based position of each row inside its group. ``order_by`` must be total."""
    keys, order_by = list(keys), [_col(c) for c in order_by]

    def ordinary(rows: DataFrame) -> DataFrame:
        place = F.row_number().over(W.partitionBy(*keys).orderBy(*order_by)) - 1
        return rows.withColumn(name, place.cast("long"))

    if not keys:
        return _sliced_position(df, keys, slice_by, order_by, name)
    return by_size(df, keys, ordinary, lambda rows: _sliced_position(rows, keys, slice_by, order_by, name))


def _sliced_position(
    df: DataFrame, keys: list[str], slice_by: Column, order_by: Sequence[Column], name: str
) -> DataFrame:
    cut = df.withColumn(SLICE, slice_by)
    sizes = cut.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select(
        *keys,
        SLICE,
        F.coalesce(F.sum("__n").over(_strictly_before(keys)), F.lit(0)).alias("__before"),
    )
    local = cut.withColumn(
        "__local",
        F.row_number().over(W.partitionBy(*keys, SLICE).orderBy(*order_by)),
    )
    return (
        local.join(before, [*keys, SLICE])
        .withColumn(name, F.col("__before") + F.col("__local") - 1)
        .drop(SLICE, "__before", "__local")
    )


def hash_position(
    df: DataFrame,
    keys: Sequence[str],
    salt: Sequence[str | Column],
    ids: Sequence[str],
    name: str = "pos",
) -> DataFrame:
    """Position in a seeded random order that depends on nothing but salt and ids.

    The order is that of an MD5 digest, so it survives repartitioning and lost
    executors. Its leading hex digits cut every group into slices; their number follows the
    rows of the table, so a slice holds some thousands of rows even if one group holds them all.
    """
    digest = F.md5(F.concat_ws("|", *[_col(c).cast("string") for c in [*salt, *ids]]))
    rows = df.agg(F.count(F.lit(1)).cast("double")).scalar()
    digits = F.ceil(F.log(16.0, F.greatest(rows / SLICE_ROWS, F.lit(1.0)))).cast("int")
    return position(
        df.withColumn("__digest", digest).withColumn("__digits", digits),
        keys,
        F.substring(F.col("__digest"), F.lit(1), F.col("__digits")),
        ["__digest", *ids],
        name,
    ).drop("__digest", "__digits")


def running(
    df: DataFrame,
    keys: Sequence[str],
    slice_by: Column | None,
    order_by: Sequence[str | Column],
    values: dict[str, tuple[str, str]],
) -> DataFrame:
    """Inclusive running aggregates; ``values`` maps a new column to ('sum'|'max', column).

    Without ``slice_by`` each group is one window.
    """
    keys = list(keys)
    how = {"sum": F.sum, "max": F.max}
    if slice_by is None:
        upto = W.partitionBy(*keys).orderBy(*[_col(c) for c in order_by])
        upto = upto.rowsBetween(W.unboundedPreceding, 0)
        return df.select("*", *[how[op](c).over(upto).alias(new) for new, (op, c) in values.items()])
    merge = {
        "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
        "max": lambda a, b: F.greatest(a, b),
    }
    cut = df.withColumn(SLICE, slice_by)
    totals = cut.groupBy(*keys, SLICE).agg(
        *[how[op](c).alias(f"__t_{new}") for new, (op, c) in values.items()]
    )
    carried = totals.select(
        *keys,
        SLICE,
        *[
            how[op](f"__t_{new}").over(_strictly_before(keys)).alias(f"__c_{new}")
            for new, (op, _) in values.items()
        ],
    )
    local = (
        W.partitionBy(*keys, SLICE)
        .orderBy(*[_col(c) for c in order_by])
        .rowsBetween(W.unboundedPreceding, 0)
    )
    out = cut.select(
        "*", *[how[op](c).over(local).alias(f"__l_{new}") for new, (op, c) in values.items()]
    ).join(carried, [*keys, SLICE])
    for new, (op, _) in values.items():
        out = out.withColumn(new, merge[op](F.col(f"__l_{new}"), F.col(f"__c_{new}")))
    return out.drop(SLICE, *[f"__{k}_{new}" for new in values for k in "lc"])


def framed(
    curve: DataFrame,
    keys: Sequence[str] = ("run_id",),
    cycle: str = "cycle",
    value: str = "value",
    chunk: int | None = CHUNK,
) -> DataFrame:
    """Add neighbours and positions to every row of a curve.

    ``ix``/``width``: position and number of all rows; ``pos``/``n``: the same over
    non-null values (``pos`` is meaningful on non-null rows); ``prev``/``next``: the
    neighbouring values. A curve longer than ``chunk`` cycles is cut into chunks;
    without ``chunk`` each curve is one window, all from one exchange and one sort.
    """
    keys = list(keys)
    if chunk is None:
        whole = W.partitionBy(*keys)
        order = whole.orderBy(cycle)
        return curve.select(
            "*",
            (F.row_number().over(order) - 1).cast("long").alias("ix"),
            F.count(F.lit(1)).over(whole).alias("width"),
            (F.count(value).over(order.rowsBetween(W.unboundedPreceding, 0)) - 1).alias("pos"),
            F.count(value).over(whole).alias("n"),
            F.lag(value).over(order).alias("prev"),
            F.lead(value).over(order).alias("next"),
        )
    cut = curve.withColumn(SLICE, F.floor(F.col(cycle) / chunk))
    ends = cut.groupBy(*keys, SLICE).agg(
        F.count(F.lit(1)).alias("__rows"),
        F.count(value).alias("__seen"),
        F.min_by(value, cycle).alias("__first"),
        F.max_by(value, cycle).alias("__last"),
    )
    before = _strictly_before(keys)
    whole = W.partitionBy(*keys)
    order = whole.orderBy(SLICE)
    carried = ends.select(
        *keys,
        SLICE,
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__rows_before"),
        F.coalesce(F.sum("__seen").over(before), F.lit(0)).alias("__seen_before"),
        F.sum("__rows").over(whole).alias("width"),
        F.sum("__seen").over(whole).alias("n"),
        F.col("__rows").alias("__chunk_rows"),
        F.lag("__last").over(order).alias("__left"),
        F.lead("__first").over(order).alias("__right"),
    )
    local = W.partitionBy(*keys, SLICE).orderBy(cycle)
    so_far = local.rowsBetween(W.unboundedPreceding, 0)
    out = cut.select(
        "*",
        F.row_number().over(local).alias("__rn"),
        F.count(value).over(so_far).alias("__cnt"),
        F.lag(value).over(local).alias("__lag"),
        F.lead(value).over(local).alias("__lead"),
    ).join(carried, [*keys, SLICE])
    first = F.col("__rn") == 1
    last = F.col("__rn") == F.col("__chunk_rows")
    return out.select(
        *curve.columns,
        (F.col("__rows_before") + F.col("__rn") - 1).alias("ix"),
        "width",
        (F.col("__seen_before") + F.col("__cnt") - 1).alias("pos"),
        "n",
        F.when(first, F.col("__left")).otherwise(F.col("__lag")).alias("prev"),
        F.when(last, F.col("__right")).otherwise(F.col("__lead")).alias("next"),
    )


def first_rows(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column]) -> DataFrame:
    """Keep the first row per key. An aggregate, so copies merge before the shuffle."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    named = [c for c in order_by if isinstance(c, str)]
    rank = F.struct(
        *[_col(c).alias(f"__o{i}") for i, c in enumerate(order_by)],
        *[F.col(c) for c in rest if c not in named],
    )
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), rank).alias("__row"))
        .select(*keys, "__row.*")
        .select(*df.columns)
    )


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    margin: float = 0.002,
    accuracy: int = 2000,
) -> DataFrame:
    """Exact linear-interpolated percentiles; ``probs`` maps output names to fractions.

    A quantile sketch brackets each wanted rank within ``margin``, four times its error bound,
    and its values cut every group into slices. One aggregate keeps the distinct values inside
    the brackets with their counts, and of the values outside only count, minimum and maximum
    per slice. So rows are never shuffled, a group of any size is spread over slices, and a
    rank that lies just outside its bracket is still found at the edge of a slice.
    """
    keys = list(keys)
    steps = (-1.0, -0.5, 0.0, 0.5, 1.0)
    ends = {
        name: [min(1.0, max(0.0, p + margin * step)) for step in steps]
        for name, p in probs.items()
    }
    grid = sorted({g for points in ends.values() for g in points})
    seen = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    # a sketch depends on the order of merging; written down, every later stage sees the same
    bounds = cut_lineage(
        seen.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("__n"),
            F.percentile_approx("__v", grid, accuracy).alias("__cuts"),
        )
    )
    if keys:
        cut = seen.join(bounds, keys)
    else:
        whole = bounds.select(F.struct("__n", "__cuts"))
        cut = seen.withColumn("__b", whole.scalar()).select("__v", "__b.*")
    at = lambda g: F.col("__cuts")[grid.index(g)]
    inside = F.lit(False)
    for points in ends.values():
        inside = inside | F.col("__v").between(at(points[0]), at(points[-1]))
    slice_by = F.lit(0)
    for g in grid:
        slice_by = slice_by + F.when(at(g) < F.col("__v"), 1).otherwise(0)
    counted = (
        cut.select(
            *keys, "__n", slice_by.alias(SLICE), "__v", F.when(inside, F.col("__v")).alias("__kept")
        )
        .groupBy(*keys, SLICE, "__kept")
        .agg(
            F.count(F.lit(1)).alias("__c"),
            F.first("__n").alias("__n"),
            F.min("__v").alias("__low"),
            F.max("__v").alias("__high"),
        )
    )
    # values outside the brackets lie below the kept ones of their slice: edge, middle, edge
    one, rest = F.lit(1).cast("long"), F.col("__c") - 1
    parts = F.when(
        F.col("__kept").isNull(),
        F.array(
            F.struct(F.lit(0).alias("o"), F.col("__low").alias("v"), one.alias("c")),
            F.struct(F.lit(1).alias("o"), F.lit(None).cast(cut.schema["__v"].dataType).alias("v"), (rest - 1).alias("c")),
            F.struct(F.lit(2).alias("o"), F.col("__high").alias("v"), one.alias("c")),
        ),
    ).otherwise(F.array(F.struct(F.lit(3).alias("o"), F.col("__kept").alias("v"), F.col("__c").alias("c"))))
    counted = (
        counted.select(*keys, SLICE, "__n", (rest > 0).alias("__several"), F.explode(parts).alias("p"))
        .filter((F.col("p.o") == 3) | (F.col("p.o") == 0) | (F.col("__several") & (F.col("p.c") > 0)))
        .select(*keys, SLICE, "__n", "p.o", F.col("p.v").alias("__v"), F.col("p.c").alias("__c"))
    )
    sizes = counted.groupBy(*keys, SLICE).agg(F.sum("__c").alias("__rows"))
    before = sizes.select(
        *keys,
        SLICE,
        F.coalesce(F.sum("__rows").over(_strictly_before(keys)), F.lit(0)).alias("__before"),
    )
    local = W.partitionBy(*keys, SLICE).orderBy("o", "__v").rowsBetween(W.unboundedPreceding, 0)
    placed = (
        counted.withColumn("__upto", F.sum("__c").over(local))
        .join(before, [*keys, SLICE])
        .withColumn("__start", F.col("__before") + F.col("__upto") - F.col("__c"))
        .filter("__v is not null")
    )
    picks, out = [], []
    for name, p in probs.items():
        exact = F.lit(p) * (F.col("__n") - 1)
        # 1e-9 keeps an integral rank from sliding below itself in floating point
        low = F.floor(exact + F.lit(1e-9))
        high = F.least(low + 1, F.col("__n") - 1)
        for tag, rank in (("lo", low), ("hi", high)):
            holds = (F.col("__start") <= rank) & (rank < F.col("__start") + F.col("__c"))
            picks.append(F.max(F.when(holds, F.col("__v"))).alias(f"__{tag}_{name}"))
        picks.append(F.first(F.greatest(exact - low, F.lit(0.0))).alias(f"__part_{name}"))
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        out.append((lo + (hi - lo) * F.col(f"__part_{name}")).alias(name))
    return placed.groupBy(*keys).agg(*picks).select(*keys, *out)

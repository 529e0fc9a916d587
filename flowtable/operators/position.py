"""Row positions, and prefix sums over ordered integers, that survive a hot key.

A table has no arrival order, so every positional operator takes explicit sort keys;
`(by, order)` must be unique. Rows are range-partitioned on the whole `(by, order)` key, so
that a key holding a third of all rows spreads over many tasks, and numbered from bounded
per-partition offsets; one way at every size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtable.functions.common import names
from flowtable.session import materialise

_SEQ, _PART, _BEFORE, _RANK, _START = "__seq", "__part", "__before", "__rank", "__start"
_ROW_BITS = 33  # monotonically_increasing_id keeps the row index in its low 33 bits


def with_position(df: DataFrame, by: str | Sequence[str], order: str | Sequence[str], pos: str = "pos") -> DataFrame:
    """Add the 1-based position of each row among the rows of its `by` key.

    `by` may be empty for one numbering over the whole table.
    """
    by, order = names(by), names(order)
    keys = [*by, *order]
    # The numbers depend on where the range bounds fell, so they are written once and
    # read back: tasks that run again after a lost executor see the same numbers.
    numbered = materialise(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn(_SEQ, F.monotonically_increasing_id()),
        "position",
    )
    part = F.shiftright(F.col(_SEQ), _ROW_BITS)
    index = F.col(_SEQ).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    # One row per partition of the range shuffle: bounded by the partition count.
    before = F.sum("n").over(Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1))
    offsets = (
        numbered.groupBy(part.alias(_PART))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(_PART, F.coalesce(before, F.lit(0)).cast("bigint").alias(_BEFORE))
    )
    ranked = (
        numbered.withColumn(_PART, part)
        .join(F.broadcast(offsets), _PART)
        .withColumn(_RANK, F.col(_BEFORE) + index)
        .drop(_SEQ, _BEFORE)
    )
    if not by:
        return ranked.withColumn(pos, F.col(_RANK) + 1).drop(_PART, _RANK)
    # Rows of one key are contiguous in the overall order, so its first rank is enough. It
    # is looked up by key and partition: a hot key spans partitions, so no group is large.
    within = [F.col(b).alias(f"__k_{b}") for b in by]
    key = [f"__k_{b}" for b in by]
    starts = (
        ranked.groupBy(*within, F.col(_PART).alias("__p"))
        .agg(F.min(_RANK).alias(_START))
        .withColumn(_START, F.min(_START).over(Window.partitionBy(*key)))  # a row per partition at most
    )
    same = F.col(_PART) == F.col("__p")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__k_{b}"))
    return (
        ranked.join(starts, same)
        .withColumn(pos, F.col(_RANK) - F.col(_START) + 1)
        .drop(_PART, "__p", _RANK, _START, *key)
    )


def trailing_count(df: DataFrame, by, order, flag: Column, rows: int, out: str, chunk: int = 100_000) -> DataFrame:
    """How many of the last `rows` rows of the same key (this one included) have `flag`.

    Keys are cut by position into chunks of `chunk` rows; the last `rows - 1` rows of a
    chunk are also copied into the next one, so a hot key is many small windows.
    """
    by, order = names(by), names(order)
    hit = F.when(flag, 1).otherwise(0)
    at = F.col("__pos") - 1
    own = F.floor(at / chunk)
    tail = at % chunk >= chunk - rows + 1
    copies = with_position(df, by, order, "__pos").withColumn("__own", own)
    copies = copies.withColumn(
        "__chunk", F.explode(F.when(tail, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own")))
    )
    w = Window.partitionBy(*by, "__chunk").orderBy("__pos").rowsBetween(1 - rows, 0)
    return (
        copies.withColumn(out, F.sum(hit).over(w).cast("bigint"))
        .where(F.col("__own") == F.col("__chunk"))
        .drop("__pos", "__own", "__chunk")
    )


def running_peaks(points: DataFrame, by, at: str, delta: str, width: int) -> DataFrame:
    """Highest running total of `delta` in the order of the integer `at`, per key.

    Deltas are first summed per distinct `at`, so a window of `width` holds at most `width`
    rows whatever the input size; windows are then chained through their net sums.
    """
    by = names(by)
    slot = F.floor(F.col(at) / width).alias("__slot")
    net = points.groupBy(*by, slot, at).agg(F.sum(delta).alias("__d"))
    inside = Window.partitionBy(*by, "__slot").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    slots = (
        net.withColumn("__run", F.sum("__d").over(inside))
        .groupBy(*by, "__slot")
        .agg(F.max("__run").alias("__top"), F.sum("__d").alias("__net"))
    )
    earlier = Window.partitionBy(*by).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("__top") + F.coalesce(F.sum("__net").over(earlier), F.lit(0))
    return slots.withColumn("__peak", total).groupBy(*by).agg(F.max("__peak").cast("bigint").alias("peak"))


def distribution(df: DataFrame, by, value: str, shares: dict[str, float], width: int) -> DataFrame:
    """Count `n`, `total`, `least`, `most` and discrete percentiles of a non-negative integer column.

    Exact at any size. Column `name` of `shares` is the smallest value with at least that
    share of the rows at or below it. Rows are counted per distinct value, values per window
    of `width`; only the windows that hold a wanted rank are looked into, each at most
    `width` values long.
    """
    by = names(by)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.floor(F.col(value) / width).alias("__slot"), F.col(value).alias("__v"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    slots = counts.groupBy(*by, "__slot").agg(
        F.sum("__n").alias("__in"),
        F.sum(F.col("__v") * F.col("__n")).alias("__sum"),
        F.min("__v").alias("__low"),
        F.max("__v").alias("__high"),
    )
    upto = Window.partitionBy(*by).orderBy("__slot").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by).orderBy("__slot").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = F.explode(
        F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in shares.items()])
    )
    # At most one window per key and percentile; the key's totals ride along.
    totals = {"n": F.sum("__in"), "total": F.sum("__sum"), "least": F.min("__low"), "most": F.max("__high")}
    targets = (
        slots.withColumn("__upto", F.sum("__in").over(upto))
        .withColumns({f"__{name}_all": total.over(whole) for name, total in totals.items()})
        .withColumn("__w", wanted)
        .withColumn("__rank", F.greatest(F.lit(1), F.ceil(F.col("__n_all") * F.col("__w.p"))))
        .where((F.col("__rank") <= F.col("__upto")) & (F.col("__rank") > F.col("__upto") - F.col("__in")))
        .select(
            *[F.col(b).alias(f"__k_{b}") for b in by],
            F.col("__slot").alias("__ks"),
            F.col("__w.name").alias("__name"),
            (F.col("__rank") - F.col("__upto") + F.col("__in")).alias("__need"),
            *[f"__{name}_all" for name in totals],
        )
    )
    same = F.col("__slot") == F.col("__ks")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__k_{b}"))
    inside = Window.partitionBy(*by, "__slot", "__name").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    return (
        counts.join(targets, same)
        .withColumn("__cum", F.sum("__n").over(inside))
        .where(F.col("__cum") >= F.col("__need"))
        .groupBy(*by)
        .agg(
            *[F.max(f"__{name}_all").alias(name) for name in totals],
            *[F.min(F.when(F.col("__name") == n, F.col("__v"))).alias(n) for n in shares],
        )
    )

"""Fixed-size batches, buffers and zips over explicitly ordered rows, and batch sizing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtable.functions.common import col, names
from flowtable.operators.position import with_position


RESOURCES = ("cpus", "memory", "disk")


def batch(df: DataFrame, by, order, size: int | Column = 1, batch_id: str = "batch_id") -> DataFrame:
    """Number the batches of exactly `size` rows per key in order; the last may be short.

    `size` may be a column (a per-task setting joined beforehand); a missing or
    non-positive size counts as 1.
    """
    n = F.lit(size) if isinstance(size, int) else size
    n = F.when(n >= 1, n).otherwise(1)
    return with_position(df, by, order, "pos").withColumn(
        batch_id, F.floor((F.col("pos") - 1) / n).cast("bigint")
    )


def buffer(df: DataFrame, by, order, n: int, value) -> DataFrame:
    """Consecutive lists of `n` values per key. `n` bounds every list, so it is required."""
    if n < 1:
        raise ValueError("a buffer needs a size of at least 1")
    by = names(by)
    rows = batch(df.select(*by, *[c for c in names(order) if c not in by], col(value).alias("__value")),
                 by, order, n, "buffer_id")
    listed = F.sort_array(F.collect_list(F.struct(F.col("pos"), F.col("__value").alias("value"))))
    return rows.groupBy(*by, "buffer_id").agg(F.transform(listed, lambda x: x["value"]).alias("values"))


def zip_streams(
    a: DataFrame, b: DataFrame, order_a, order_b, by: str | Sequence[str] = (), pos: str = "pos"
) -> DataFrame:
    """Pair the i-th row of `a` with the i-th of `b`; ends with the shorter.

    The two sides must not share column names other than `by`.
    """
    by = names(by)
    left = with_position(a, by, order_a, pos)
    right = with_position(b, by, order_b, pos)
    return left.join(right, [*by, pos])


def batch_resources(
    items: DataFrame, batch_cols, settings: DataFrame | None = None, precedence: str = "config"
) -> DataFrame:
    """Resources of a batch: the largest cpus, memory and disk of its items, nulls losing.

    `settings` (one row per batch key: cfg_cpus, cfg_memory, cfg_disk) wins over the items
    with `precedence="config"` and only fills gaps with `"runtime"`.
    """
    keys = names(batch_cols)
    fields = [f for f in RESOURCES if f in items.columns]
    top = items.groupBy(*keys).agg(*[F.max(f).alias(f) for f in fields])
    if settings is None:
        return top
    return top.join(settings, keys, "left").select(*keys, *[pick_resource(f, precedence) for f in fields])


def pick_resource(field: str, precedence: str = "config") -> Column:
    """The setting `cfg_<field>` or the items' own value, whichever wins."""
    order = (f"cfg_{field}", field) if precedence == "config" else (field, f"cfg_{field}")
    return F.coalesce(*[F.col(c) for c in order]).alias(field)


def batch_time(items: DataFrame, batch_cols, time: str = "time") -> DataFrame:
    """Time limit of a batch: the largest per-item time times the number of items; null stays null."""
    return items.groupBy(*names(batch_cols)).agg((F.max(time) * F.count(F.lit(1))).alias(time))

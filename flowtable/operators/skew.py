"""Joins with a hot key on the many side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtable.functions.common import names

ROWS_PER_SLICE = 1_000_000


def _hashable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return all(_hashable(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _hashable(dtype.elementType)
    return not isinstance(dtype, T.MapType)


def split_join(many: DataFrame, one: DataFrame, on, rows: int = ROWS_PER_SLICE) -> DataFrame:
    """Inner join of `many` with `one`, which has each key once; no task gets much more than `rows` rows
    of a key.

    Keys of `many` with more rows are counted first (on the map side), their rows are dealt over slices
    by a hash of the row, and their row of `one` is copied to each slice. The table of hot keys has at most
    one row per `rows` rows of `many`, so it is broadcast.
    """
    keys = names(on)
    hot = (
        many.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > rows)
        .select(*keys, F.ceil(F.col("__n") / rows).alias("__slices"))
    )
    spread = F.xxhash64(*[f.name for f in many.schema.fields if _hashable(f.dataType)])
    slices = F.coalesce("__slices", F.lit(1))
    left = many.join(F.broadcast(hot), keys, "left").withColumn("__slice", F.pmod(spread, slices))
    right = one.join(F.broadcast(hot), keys, "left").withColumn("__slice", F.explode(F.sequence(F.lit(0).cast("bigint"), slices - 1)))
    return left.drop("__slices").join(right.drop("__slices"), [*keys, "__slice"]).drop("__slice")

"""Small helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtable.session import prepare, scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written once to the shared folder and read back: later reads prune columns, and a lost
    executor costs no second run of what made it. `session.scope` and `session.release` delete it."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column | str) -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4; a null id counts as the empty text."""
    text = F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(None)).cast("string")
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")) % 4 == 2


def uniform(*columns: Column, seed: str) -> Column:
    """A number in [0, 1) fixed by the values and the seed: the first 52 bits of an MD5."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


_REMEMBERED: dict[tuple, Any] = {}


def remembered(key: tuple, make: Callable[[], Any]) -> Any:
    """What a Python worker remembers for `key` between tasks; what it remembered for another one is let go, so that
    a worker that goes from stage to stage holds the memory of one of them."""
    if key not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[key] = make()
    return _REMEMBERED[key]

"""Session helpers: time zone, the shared folder, and what the library writes there."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR_CONF = "spark.checkpoint.dir"
_scratch: list[str] = []


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session time zone: every timestamp in the library is UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster. There is no fallback."""
    configured = spark.conf.get(SHARED_DIR_CONF, None)
    if configured:
        return configured.rstrip("/")
    raise RuntimeError(f"set {SHARED_DIR_CONF} to a folder all executors share")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path in the shared folder."""
    return f"{shared_dir(spark)}/flowtable/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Used where a value must not change when a lost executor's tasks run again
    (row numbers, results of user functions), and to cut lineage. Parquet rather
    than `checkpoint()`, so that later reads still prune columns.
    `release` deletes the copies.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for an intermediate table, which `scope` or `release` deletes."""
    _scratch.append(new_path(spark, label))
    return _scratch[-1]


def _delete(spark: SparkSession, paths: list[str]) -> int:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return sum(p.getFileSystem(conf).delete(p, True) for p in at)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what intermediate tables were made inside; for work whose result is written inside, too."""
    mark = len(_scratch)
    try:
        yield
    finally:
        made = _scratch[mark:]
        del _scratch[mark:]
        _delete(spark, made)


def release(spark: SparkSession) -> int:
    """Delete all intermediate tables made so far; call it when no frame that was built on them will be read
    again. Returns how many were there."""
    made = _scratch[:]
    _scratch.clear()
    return _delete(spark, made)

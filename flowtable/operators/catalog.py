"""Inventories of paths, object URLs, resource requests and names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtable.functions.common import col, names
from flowtable.functions.paths import extension, kebab, parent_dir, stem, url_join, url_parts
from flowtable.functions.units import duration_ms, parse_capacity, parse_parallelism


def file_catalog(df: DataFrame, path: str) -> DataFrame:
    """Distinct files per folder and per extension: (kind, key, files)."""
    files = df.select(F.col(path).alias("path")).distinct()
    keyed = files.select(parent_dir("path").alias("dir"), extension("path").alias("ext"))
    # One pass for both groupings, with partial sums before the shuffle.
    by_dir = F.grouping("dir") == 0
    return (
        keyed.groupingSets([["dir"], ["ext"]], "dir", "ext")
        .agg(by_dir.alias("__by_dir"), F.count(F.lit(1)).alias("files"))
        .select(
            F.when(F.col("__by_dir"), "dir").otherwise("ext").alias("kind"),
            F.when(F.col("__by_dir"), F.col("dir")).otherwise(F.col("ext")).alias("key"),
            "files",
        )
    )


def stem_collisions(df: DataFrame, path: str) -> DataFrame:
    """Stems shared by more than one file, so that `<stem>.b64` would be written twice."""
    files = df.select(F.col(path).alias("path")).distinct()
    return (
        files.groupBy(stem("path").alias("stem"))
        .agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first"), F.max("path").alias("last"))
        .where("files > 1")
    )


def object_urls(df: DataFrame, url: str, scheme: str = "gs") -> tuple[DataFrame, DataFrame]:
    """(rows with bucket, object and file; rows that are no such URL). Each side parses by itself."""
    split = df.withColumn("__url", url_parts(url, scheme))
    good = split.where(F.col("__url").isNotNull()).select(*df.columns, "__url.*")
    return good, split.where(F.col("__url").isNull()).drop("__url")


def object_inventory(df: DataFrame, url: str, scheme: str = "gs") -> DataFrame:
    """Objects per bucket with how many URLs rebuild exactly; rows that are no such URL under a null bucket."""
    split = df.withColumn("__url", url_parts(url, scheme))
    same = url_join("__url.bucket", "__url.object", scheme=scheme) == col(url)
    return split.groupBy(F.col("__url.bucket").alias("bucket")).agg(
        F.count(F.lit(1)).alias("objects"), F.count(F.when(same, 1)).alias("round_trips")
    )


def normalize_resources(
    df: DataFrame, capacity: str, time: str, time_unit: str, parallelism: str, strict: bool = False
) -> DataFrame:
    """Add bytes, ms and slots, and in `violations` which of them do not parse."""
    par = parse_parallelism(parallelism)
    return df.withColumns(
        {
            "bytes": parse_capacity(capacity, strict),
            "ms": duration_ms(time, time_unit),
            "slots": par["slots"],
        }
    ).withColumn(
        "violations",
        F.array_compact(
            F.array(
                F.when(F.col("bytes").isNull(), "capacity"),
                F.when(F.col("ms").isNull(), "duration"),
                F.when(F.col("slots").isNull(), "parallelism"),
            )
        ),
    )
def resource_totals(normalized: DataFrame, by) -> DataFrame:
    """Totals per key of the clean rows (kind `ok`), and counts of the others by what is wrong with them."""
    clean = F.size("violations") == 0
    kind = F.when(clean, "ok").otherwise(F.concat_ws(",", "violations"))
    of = lambda c: F.when(clean, F.col(c))
    return normalized.groupBy(*names(by), kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(of("bytes")).alias("total_bytes"),
        F.max(of("bytes")).alias("max_bytes"),
        F.sum(of("ms")).alias("total_ms"),
        F.max(of("slots")).alias("max_slots"),
    )


def key_collisions(df: DataFrame, name: str) -> DataFrame:
    """Distinct names that collapse to one key: (key, name, names sharing the key)."""
    distinct = df.select(F.col(name).alias("name")).distinct().withColumn("key", kebab("name"))
    shared = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return distinct.join(shared, "key").select("key", "name", "n")

"""Listings of files."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtable.session import new_path

_FOUND = "path string, folder boolean, length bigint, modified timestamp"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """All regular files below `root`, empty ones too: path, length, modified.

    Empty when there is no such folder. The folders of each depth are listed by many tasks
    (Spark's own file sources leave out empty files, which here are markers), and contents
    are not read. `root` is a URI, or a path on a file system every machine shares.
    """
    schema = pa.schema(
        [("path", pa.string()), ("folder", pa.bool_()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC"))]
    )

    # Defined here so that it travels by value: executors need not have this package.
    def list_folders(batches):
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                store, base = fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)
                inside = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
                for at in range(0, len(inside), 10_000):
                    some = inside[at : at + 10_000]
                    found = {
                        "path": [f"{uri.rstrip('/')}/{i.base_name}" for i in some],
                        "folder": [i.type == fs.FileType.Directory for i in some],
                        "length": [i.size or 0 for i in some],
                        "modified": [i.mtime for i in some],
                    }
                    yield pa.RecordBatch.from_pydict(found, schema)

    store = new_path(spark, "listing")
    folders, waiting, depth = spark.range(1).select(F.lit(root).alias("path")), 1, 0
    while waiting:
        level = f"{store}/depth={depth}"
        spread = folders.repartition(min(waiting, 4 * spark.sparkContext.defaultParallelism), "path")
        spread.mapInArrow(list_folders, _FOUND).write.parquet(level)
        folders = spark.read.schema(_FOUND).parquet(level).where("folder").select("path")
        waiting, depth = folders.count(), depth + 1
    found = spark.read.schema(_FOUND).option("basePath", store).parquet(store)
    return found.where("not folder").select("path", "length", "modified")

"""Outputs as files at their own paths, written by a Python data source in two steps.

Tasks of the write put contents below a staging folder that nothing reads, each attempt into a folder of its own, with
a list of what it wrote: small contents one after another in packs, a large one as a file. On success the driver keeps
the names of the lists of the attempts that count, one per task, and on failure deletes the folder. Then many tasks,
dealt by pack, put the declared files among the listed ones at `outputs/<path>`: a small one is copied from its pack
to a file beside it and moved, a large one moved. So a file that nobody declared never becomes one, the staging folder
that is deleted at the end holds few files, a killed task, a second attempt or a failed write leaves nothing visible,
and doing again what was done already changes nothing.
"""

from __future__ import annotations

import gzip
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from flowtable.functions.common import names
from flowtable.functions.paths import none_marker
from flowtable.sources.listing import list_files

LISTED = "path string, staged string, start bigint, length bigint"
SOURCE = "flowtable_files"
LARGE = 4 << 20  # bytes from which on a content is a staged file of its own
PACK_FILES, PACK_BYTES = 1000, 16 << 20  # a pack ends with the content that reaches one of them
FILES_PER_TASK = 10_000


def located(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)


def checked(path: str) -> str:
    """The path, if it stays below the folder it is taken in."""
    if not path or path.startswith("/") or any(part in ("", ".", "..") for part in path.split("/")):
        raise ValueError(f"not a path below the outputs folder: {path!r}")
    return path


@dataclass
class Attempt(WriterCommitMessage):
    listed: str | None
    files: int


class FilesWriter(DataSourceArrowWriter):
    """Rows (path, content) to files in the staging folder."""

    def __init__(self, options: dict) -> None:
        self.staging = options["staging"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        token, rows = uuid.uuid4().hex, []
        store, base = located(f"{self.staging}/files/{token}")
        schema = pa.schema([("path", pa.string()), ("staged", pa.string()), ("start", pa.int64()), ("length", pa.int64())])
        sink = pack = None
        total = staged = inside = size = 0  # contents and staged files; contents and bytes of the open pack

        def create() -> pa.NativeFile:
            nonlocal staged
            if not staged:
                store.create_dir(base, recursive=True)
            staged += 1
            return store.open_output_stream(f"{base}/{staged}", compression=None, buffer_size=1 << 20)

        def keep() -> None:
            nonlocal sink
            if sink is None:
                lists, at = located(f"{self.staging}/lists")
                lists.create_dir(at, recursive=True)
                sink = pq.ParquetWriter(f"{at}/{token}.parquet", schema, filesystem=lists)
            sink.write_table(pa.Table.from_pylist(rows, schema))
            rows.clear()

        for batch in iterator:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if content is None:
                    continue
                data = content.encode() if isinstance(content, str) else bytes(content)
                if checked(path).endswith(".gz"):
                    data = gzip.compress(data, mtime=0)
                if len(data) >= LARGE:
                    with create() as out:
                        out.write(data)
                    at, start = staged, None
                else:
                    if pack is None:
                        pack, inside, size = create(), 0, 0
                        number = staged  # of the pack; a large content may come in between
                    pack.write(data)
                    at, start, inside, size = number, size, inside + 1, size + len(data)
                    if inside >= PACK_FILES or size >= PACK_BYTES:
                        pack.close()
                        pack = None
                rows.append({"path": path, "staged": f"{token}/{at}", "start": start, "length": len(data)})
                total += 1
                if len(rows) >= 10_000:
                    keep()
        if pack is not None:
            pack.close()
        if rows:
            keep()
        if sink is not None:
            sink.close()
        return Attempt(f"{token}.parquet" if total else None, total)

    def commit(self, messages: list[Attempt | None]) -> None:
        store, at = located(self.staging)
        store.create_dir(at, recursive=True)
        with store.open_output_stream(f"{at}/committed.json", compression=None) as out:
            out.write(json.dumps([m.listed for m in messages if m and m.listed]).encode())

    def abort(self, messages: list[Attempt | None]) -> None:
        store, at = located(self.staging)
        if store.get_file_info(at).type != fs.FileType.NotFound:
            store.delete_dir(at)


class FilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: T.StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options)


def stage(produced: DataFrame, staging: str) -> DataFrame:
    """Write the contents of `produced` (path, content) below `staging`; (path, staged, start, length) of what counts.
    `start` is null where the staged file is the content and not a pack."""
    spark = produced.sparkSession
    spark.dataSource.register(FilesSource)
    rows = produced.select("path", F.col("content").cast("binary").alias("content"))
    rows.write.format(SOURCE).option("staging", staging).mode("append").save()
    store, at = located(staging)
    with store.open_input_stream(f"{at}/committed.json") as lines:
        lists = json.loads(io.BytesIO(lines.read()).read())
    if not lists:
        return spark.createDataFrame([], LISTED)
    return spark.read.schema(LISTED).parquet(*[f"{staging}/lists/{name}" for name in lists])


def write_output_files(
    produced: DataFrame, declared: DataFrame, root: str, task: str, item="item_id", strict: bool = False, epoch: int = 0
) -> DataFrame:
    """Put the declared outputs of a task at `root`/outputs/<path> and return their manifest rows.

    `produced`: path, content (text or bytes; a path that ends in `.gz` is compressed); `declared`: item, path,
    optional. Contents go from the task that makes them to its packs, and from there to their files, without a shuffle;
    what is put at its path is decided from paths alone. A missing optional file leaves an empty `.none` marker; a missing required one gets
    status `missing`, which raises if `strict`. A file that nobody declared is not kept. Of one path made
    twice, one is kept.
    """
    spark, keys, run = produced.sparkSession, names(item), uuid.uuid4().hex
    staging = f"{root}/.staging/{run}"
    made = stage(produced, staging)
    tasks = max(spark.sparkContext.defaultParallelism, -(-made.count() // FILES_PER_TASK))
    listed = made.groupBy("path").agg(F.min(F.struct("staged", "start", "length")).alias("f"))
    status = F.when(F.col("f").isNotNull(), "file").when(F.col("optional"), "none").otherwise("missing")
    plan = declared.join(listed, "path", "left").select(
        F.lit(task).alias("task"), *keys,
        F.when(status == "none", none_marker("path")).otherwise(F.col("path")).alias("path"), status.alias("status"),
        F.coalesce("f.length", F.lit(0)).cast("bigint").alias("length"), F.lit(epoch).cast("bigint").alias("epoch"), "f.staged", "f.start",
    )
    outputs, files = f"{root}/outputs", f"{staging}/files"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, to), (_, held), (_, own) = located(outputs), located(files), located(f"{files}/{uuid.uuid4().hex}")
        made: set[str] = set()
        pack = opened = None
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("path", "status", "staged", "start", "length"))
            for path, kind, staged, start, length in zip(*columns, strict=True):
                if kind == "missing":
                    continue
                at = f"{to}/{checked(path)}"
                folder = at.rsplit("/", 1)[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                if kind == "none":
                    store.open_output_stream(at, compression=None).close()
                elif start is not None:
                    if staged != opened:
                        if pack is None:
                            store.create_dir(own, recursive=True)
                        else:
                            pack.close()
                        pack, opened = store.open_input_file(f"{held}/{staged}"), staged
                    data = pack.read_at(length, start)
                    if len(data) != length:
                        raise EOFError(f"{held}/{staged}")
                    with store.open_output_stream(f"{own}/file", compression=None) as out:
                        out.write(data)
                    store.move(f"{own}/file", at)  # whole or not at all, and again if an earlier attempt did it
                elif store.get_file_info(f"{held}/{staged}").type == fs.FileType.File:
                    store.move(f"{held}/{staged}", at)
                elif store.get_file_info(at).type != fs.FileType.File:  # else an earlier attempt moved it
                    raise FileNotFoundError(f"{held}/{staged}")
            yield batch.drop_columns(["staged", "start"])
        if pack is not None:
            pack.close()

    kept = T.StructType([f for f in plan.schema.fields if f.name not in ("staged", "start")])
    dealt = plan.repartition(tasks, F.coalesce("staged", "path")).sortWithinPartitions("staged", "start", "path")
    dealt.mapInArrow(place, kept).write.parquet(f"{root}/files/run={run}")
    store, at = located(staging)
    store.delete_dir(at)
    manifest = spark.read.schema(kept).parquet(f"{root}/files/run={run}").drop("epoch")
    if strict and not manifest.where(F.col("status") == "missing").isEmpty():
        raise RuntimeError(f"required outputs of task {task} were not created")
    return manifest


def output_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length): the files that are there, paths relative to the outputs folder."""
    base = f"{root}/outputs"
    found = list_files(spark, base)
    return found.select(F.expr(f"substring(path, {len(base) + 2})").alias("path"), "length")

"""The outputs and the history of a workflow, under one folder of the shared file system.

Tables only grow: every write goes to a folder of its own, named by a random token, and carries the time of
its run in `epoch`; of a path, the latest row counts. So two steps may write at once, nothing is overwritten,
and a lost job leaves nothing half done.
"""

from __future__ import annotations

import time
import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtable.operators.history import EXECUTIONS_TYPE, failed_count

FILES_SCHEMA = "path string, length bigint, epoch bigint, task string, status string"
CONTENT_SCHEMA = "path string, content string, epoch bigint"
TASK_RUNS_SCHEMA = (
    "id string, run_id bigint, task_name string, start_time bigint, completion_status string,"
    f" completed_time bigint, executions {EXECUTIONS_TYPE}"
)
RUNS_SCHEMA = "run_id bigint, workflow_name string, start_time bigint, completed_successfully boolean, completed_time bigint"


class Version(NamedTuple):
    epoch: int  # microseconds
    token: str


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], T.StructType.fromDDL(schema))

    def new_version(self) -> Version:
        return Version(time.time_ns() // 1000, uuid.uuid4().hex)

    def path(self, name: str, version: Version) -> str:
        return f"{self.root}/{name}/run={version.token}"

    def _newest(self) -> DataFrame:
        newest = F.max(F.struct("epoch", "status", "length", "task")).alias("f")
        there = self._read("files", FILES_SCHEMA).where("status <> 'missing'").groupBy("path").agg(newest)
        return there.select("path", "f.status", "f.length", "f.task", "f.epoch").where("status <> 'removed'")

    def files(self) -> DataFrame:
        """(path, status, length, task) of the latest version of every path that is there."""
        return self._newest().drop("epoch")

    def manifest(self) -> DataFrame:
        return self.files().select("path")

    def content(self) -> DataFrame:
        """(path, content) of the files that are there."""
        files = self._newest().where("status = 'file'").select("path", "epoch")
        return self._read("content", CONTENT_SCHEMA).join(files, ["path", "epoch"]).select("path", "content")

    def remove(self, paths: DataFrame) -> None:
        """Mark paths as gone; the items they belong to run again."""
        version = self.new_version()
        gone = paths.select(
            "path", F.lit(0).cast("bigint").alias("length"), F.lit(version.epoch).cast("bigint").alias("epoch"),
            F.lit("none").alias("task"), F.lit("removed").alias("status"),
        )
        gone.write.parquet(self.path("files", version))

    def task_runs(self) -> DataFrame:
        """The history, as the operators on run history take it."""
        return self._read("task_runs", TASK_RUNS_SCHEMA)

    def start_run(self, run_id: int, workflow_name: str) -> None:
        self._write_run(run_id, workflow_name, _now(), None, None)

    def complete_run(self, run_id: int) -> bool:
        """Record the end of a run; it succeeded if no task run of it failed."""
        failed = failed_count(self.task_runs().where(F.col("run_id") == run_id)).first().failed
        self._write_run(run_id, None, None, failed == 0, _now())
        return failed == 0

    def _write_run(self, *row) -> None:
        self.spark.createDataFrame([row], RUNS_SCHEMA).coalesce(1).write.parquet(self.path("workflow_runs", self.new_version()))

    def workflow_runs(self) -> DataFrame:
        """One row per run: its start, and its end where it has ended."""
        return self._read("workflow_runs", RUNS_SCHEMA).groupBy("run_id").agg(
            F.max("workflow_name").alias("workflow_name"),
            F.min("start_time").alias("start_time"),
            F.max_by("completed_successfully", "completed_time").alias("completed_successfully"),
            F.max("completed_time").alias("completed_time"),
        )


def _now() -> int:
    return int(time.time() * 1000)

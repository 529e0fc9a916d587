"""Keyed tables that a stream looks up and adds to, at a cost that does not grow with its history.

Each micro-batch adds a run of rows. When a level holds `fan` runs they are merged into one of the next level,
so after n micro-batches there are at most `fan` times log n runs. A run is dealt over buckets of some `rows` rows
by a hash of the key, and has a Bloom filter: bitmaps of the bits its keys set. A lookup asks the filters
first and opens only buckets that may hold a key of the micro-batch.

Which runs count is told by a small file per micro-batch. A micro-batch reads the file of the one before it and
writes its own, so a replay sees the same table and overwrites what its first attempt left; the
stream's commit log decides which file is the last. Runs that no recent file names are deleted.
"""

from __future__ import annotations

import functools
import json
import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtable.functions.common import names

ROWS, FAN = 65_536, 4  # rows of a bucket; runs of a level
BITS, KEYS = 32_768, 2_048  # of a bitmap; its keys, each with two bits: one in 64 others passes
MANY = 512  # keys asked a bucket from which a run is read without its filters


@dataclass(frozen=True)
class Run:
    name: str
    level: int
    rows: int
    buckets: int
    parts: int  # bitmaps of a bucket


class Levels:
    """Rows of `schema` by `key`, with the micro-batch that wrote them in `epoch`. With `latest`, of the rows
    of a key the one of the last micro-batch counts."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key, latest: bool = False, rows: int = ROWS, fan: int = FAN) -> None:
        self.spark, self.root, self.key, self.latest, self.rows, self.fan = spark, root, names(key), latest, rows, fan
        fields = T.StructType.fromDDL(schema).fields
        self.schema = T.StructType([*fields, T.StructField("epoch", T.LongType())])
        self.opened: list[str] = []  # the buckets that the last lookup read

    # --- files ---

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(f"{self.root}/{folder}")
        return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []

    def _delete(self, path: str) -> None:
        fs, at = self._fs(f"{self.root}/{path}")
        fs.delete(at, True)

    def _states(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("states") if n.endswith(".json") and not n.startswith((".", "_")))

    def _state(self, number: int) -> list[Run]:
        fs, at = self._fs(f"{self.root}/states/{number}.json")
        stream = fs.open(at)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Run(**r) for r in json.loads(text)]

    def runs(self, before: int | None = None) -> list[Run]:
        """The runs that count before micro-batch `before` (None: now)."""
        earlier = [n for n in self._states() if before is None or n < before]
        return self._state(earlier[-1]) if earlier else []

    def _commit(self, epoch: int, live: list[Run]) -> None:
        fs, at = self._fs(f"{self.root}/states/{epoch}.json")
        out = fs.create(at, True)
        out.write(bytearray(json.dumps([asdict(r) for r in live]).encode()))
        out.close()
        states = [n for n in self._states() if n <= epoch]
        for old in states[:-2]:
            self._delete(f"states/{old}.json")
        kept = {r.name for n in states[-2:] for r in self._state(n)}
        for name in set(self._names("runs")) - kept:
            self._delete(f"runs/{name}")
            self._delete(f"filters/{name}")

    # --- rows ---

    def _hash(self) -> Column:
        return F.xxhash64(*self.key)

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(*paths)

    def _write(self, df: DataFrame, name: str, level: int, rows: int | None = None) -> Run:
        """Write a run; `rows` is its number of rows, if known, or more."""
        buckets = max(1, math.ceil((rows or 0) / self.rows))
        path, columns = f"{self.root}/runs/{name}", [f.name for f in self.schema]
        dealt = df.select(*columns, F.pmod(self._hash(), F.lit(buckets)).alias("bucket"))
        if buckets > 1:
            dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", *self.key)
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(path)
        written = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.LongType())])).parquet(path)
        count = written.count()
        if rows is None and count > 2 * self.rows:  # a large micro-batch: deal it, now that its size is known
            return self._write(written, f"{name}-dealt", level, count)
        parts = max(1, math.ceil(count / buckets / KEYS))
        bits = written.select("bucket", F.explode(self._bits()).alias("b"), self._part(parts))
        bits = bits.groupBy("bucket", "part").agg(F.bitmap_construct_agg("b").alias("bits"))
        bits.write.mode("overwrite").parquet(f"{self.root}/filters/{name}")
        return Run(name, level, count, buckets, parts)

    def _bits(self) -> Column:
        h = self._hash()
        return F.array(h.bitwiseAND(BITS - 1), F.shiftrightunsigned(h, 45).bitwiseAND(BITS - 1))

    def _part(self, parts: int) -> Column:
        return F.pmod(F.shiftrightunsigned(self._hash(), 20), F.lit(parts)).alias("part")

    def append(self, df: DataFrame, epoch: int, rows: int | None = None) -> None:
        """Add the rows of micro-batch `epoch`; keys once each. `rows` is their number, if known: it spares a large
        micro-batch from being written twice."""
        live = self.runs(epoch)
        made = self._write(df.withColumn("epoch", F.lit(epoch).cast("long")), f"e{epoch}", 0, rows)
        live = [*live, made] if made.rows else live
        level = 0
        while len(full := [r for r in live if r.level == level]) >= self.fan:
            rows = self._newest(self._read([f"{self.root}/runs/{r.name}" for r in full]))
            merged = self._write(rows, f"e{epoch}-level{level + 1}", level + 1, sum(r.rows for r in full))
            live = [r for r in live if r.level != level] + [merged]
            level += 1
        self._commit(epoch, live)
        self._delete(f"asked/epoch={epoch}")

    def _newest(self, rows: DataFrame) -> DataFrame:
        if not self.latest:
            return rows
        columns = [f.name for f in self.schema]
        last = F.max_by(F.struct(*columns), "epoch").alias("__r")
        return rows.groupBy(*[F.col(k).alias(f"__{k}") for k in self.key]).agg(last).select("__r.*")

    def lookup(self, keys: DataFrame, epoch: int) -> DataFrame:
        """The rows, as they were before micro-batch `epoch`, whose key is one of `keys`."""
        live, at = self.runs(epoch), f"{self.root}/asked/epoch={epoch}"
        if not live:
            self.opened = []
            return self.spark.createDataFrame([], self.schema)
        keys.select(*self.key).distinct().write.mode("overwrite").parquet(at)
        asked = keys.sparkSession.read.schema(keys.select(*self.key).schema).parquet(at)
        byte = "cast(conv(hex(substring(bits, cast(b[{0}] div 8 as int) + 1, 1)), 16, 10) as int)"
        held = " and ".join(f"(shiftright({byte}, cast(b[{{0}}] % 8 as int)) & 1) = 1".format(i) for i in (0, 1))

        def passing(run: Run) -> DataFrame:
            filters = self.spark.read.schema("bucket long, part long, bits binary").parquet(f"{self.root}/filters/{run.name}")
            named = asked.select(F.pmod(self._hash(), F.lit(run.buckets)).alias("bucket"), self._part(run.parts), self._bits().alias("b"))
            return named.join(filters, ["bucket", "part"]).where(held).select(F.lit(run.name).alias("run"), "bucket")

        # So many keys a bucket that by chance alone one of them passes: the filters would keep nothing closed.
        count = asked.count()
        whole = [run for run in live if count >= MANY * run.buckets]
        few = [run for run in live if count < MANY * run.buckets]
        hits = functools.reduce(DataFrame.unionAll, map(passing, few)).distinct().collect() if few else []  # no more than there are buckets
        self.opened = sorted([f"{self.root}/runs/{r.run}/bucket={r.bucket}" for r in hits] + [f"{self.root}/runs/{r.name}" for r in whole])
        named = asked.select(*[F.col(k).alias(f"__{k}") for k in self.key])  # a null key is a key, too
        same = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.key])
        return self._newest(self._read(self.opened).join(named, same, "left_semi"))

    def read(self, before: int | None = None) -> DataFrame:
        """All rows."""
        return self._newest(self._read([f"{self.root}/runs/{r.name}" for r in self.runs(before)]))

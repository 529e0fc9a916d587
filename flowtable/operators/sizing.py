"""Resolving resource requests to machine types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtable.functions.units import UNIT_BYTES, bytes_of

# Machine classes, their name prefix, and per size the cpus and memory in GB.
MACHINE_CLASSES = {
    "STANDARD": ("n1-standard", [(1, 3.75), (2, 7.5), (4, 15), (8, 50), (16, 60), (32, 120), (64, 240), (96, 360)]),
    "HIGHMEM": ("n1-highmem", [(2, 13), (4, 26), (8, 52), (16, 104), (32, 208), (64, 416), (96, 624)]),
    "HIGHCPU": ("n1-highcpu", [(2, 1.8), (4, 3.6), (8, 7.2), (16, 14.4), (32, 28.8), (64, 57.6), (96, 86.4)]),
    "ULTRAMEM": ("n1-ultramem", [(40, 961), (80, 1922), (160, 3844)]),
}
# Bounds of memory per cpu of a custom machine.
MIN_MEM_PER_CPU = bytes_of(0.9, "GB")
MAX_MEM_PER_CPU = bytes_of(6.5, "GB")

_REQUEST_COLUMNS = {
    "machine_type": "string",
    "machine_class": "string",
    "cfg_cpus": "int",
    "cfg_memory": "bigint",
    "mem_per_cpu": "bigint",
    "cpus": "int",
    "memory": "bigint",
}


def _smallest(sizes: list[tuple[int, int]], need: Column) -> Column:
    """Cpus of the first size that holds the need; the first for none, the last beyond all."""
    pick = F.when(need.isNull(), sizes[0][0])
    for cpus, capacity in sizes:
        pick = pick.when(need <= capacity, cpus)
    return pick.otherwise(sizes[-1][0])


def class_machine(machine_class: str, cpus: Column, memory: Column) -> Column:
    """Smallest machine of a class with enough cpus and memory."""
    prefix, sizes = MACHINE_CLASSES[machine_class]
    by_cpu = _smallest([(c, c) for c, _ in sizes], cpus)
    by_memory = _smallest([(c, bytes_of(gb, "GB")) for c, gb in sizes], memory)
    return F.concat(F.lit(f"{prefix}-"), F.greatest(by_cpu, by_memory).cast("string"))


def _even(cpus: Column) -> Column:
    return F.when((cpus > 1) & (cpus % 2 == 1), cpus + 1).otherwise(cpus)


def with_machine(df: DataFrame, compat: bool = False) -> DataFrame:
    """Add the `machine` each row resolves to.

    Optional columns (absent ones are null): machine_type (taken as is), machine_class,
    cfg_cpus and cfg_memory (win over) cpus and memory, mem_per_cpu; memory in bytes.
    Without a class it is CUSTOM if only a ratio is given, else STANDARD. `compat` keeps an
    original slip: memory above the allowed ratio drops to the *minimum* per cpu.
    """
    for name, dtype in _REQUEST_COLUMNS.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(dtype))
    ratio = F.greatest(F.least("mem_per_cpu", F.lit(MAX_MEM_PER_CPU)), F.lit(MIN_MEM_PER_CPU))
    staged = df.withColumns(
        {
            "__class": F.coalesce(
                "machine_class", F.when(F.col("mem_per_cpu").isNotNull(), "CUSTOM").otherwise("STANDARD")
            ),
            "__cpus": F.coalesce("cfg_cpus", "cpus"),
            "__mem": F.coalesce("cfg_memory", "memory"),
            "__ratio": F.when(F.col("mem_per_cpu").isNotNull(), ratio),
        }
    )
    cpus, mem, per = F.col("__cpus"), F.col("__mem"), F.col("__ratio")
    even = _even(cpus)
    # A missing side follows from the other one and the ratio.
    staged = staged.withColumns(
        {
            "__ccpus": F.coalesce(even, _even(F.floor(mem / per)).cast("int")),
            "__cmem": F.coalesce(mem, even.cast("bigint") * per),
        }
    )
    ccpus, cmem = F.col("__ccpus").cast("bigint"), F.col("__cmem")
    each = F.floor(cmem / F.when(ccpus != 0, ccpus))
    over = MIN_MEM_PER_CPU if compat else MAX_MEM_PER_CPU
    fitted = (
        F.when(ccpus == 0, F.lit(0).cast("bigint"))
        .when(each < MIN_MEM_PER_CPU, ccpus * F.lit(MIN_MEM_PER_CPU))
        .when(each > MAX_MEM_PER_CPU, ccpus * F.lit(over))
        .otherwise(cmem)
    )
    megabytes = F.floor(fitted / UNIT_BYTES["MB"] + 0.5)
    custom = F.concat(F.lit("custom-"), ccpus.cast("string"), F.lit("-"), megabytes.cast("string"))
    one_sided = (cpus.isNull() | mem.isNull()) & per.isNull()
    machine = F.when(F.col("machine_type").isNotNull(), F.col("machine_type"))
    for name in MACHINE_CLASSES:
        machine = machine.when(F.col("__class") == name, class_machine(name, cpus, mem))
    machine = (
        machine.when(cpus.isNull() & mem.isNull(), class_machine("STANDARD", F.lit(None), F.lit(None)))
        .when(one_sided, class_machine("STANDARD", even, mem))
        .otherwise(custom)
    )
    return staged.withColumn("machine", machine).drop("__class", "__cpus", "__mem", "__ratio", "__ccpus", "__cmem")


def size_plan(batches: DataFrame, compat: bool = False) -> DataFrame:
    """How many batches need each machine type."""
    return with_machine(batches, compat).groupBy("machine").agg(F.count(F.lit(1)).alias("n"))


def size_plan_custom(batches: DataFrame, compat: bool = False) -> DataFrame:
    """The same with every batch on a custom machine."""
    return size_plan(batches.withColumn("machine_class", F.lit("CUSTOM")), compat)

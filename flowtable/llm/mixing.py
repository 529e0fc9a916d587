"""Mixing sources to target weights.

Sizes are words, counted per document and summed per source (map-side first). Sources in code-point
order, null last, weigh 5, 2, 1 and so on around. They share `share` of all words by weight; a target
over `ceiling` times its source's size stops there and the excess is shared again by weight until
none is above. A document is emitted floor(target / size of its source) times, and once more where a
number hashed from seed and document id lies below the fraction.

DataFrame functions only. Null or blank text has size 0; a source without words has target 0. Rows
with the same id (null counts as an id) draw the same number. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtable.llm.common import stored, uniform
from flowtable.operators.position import with_position

WEIGHTS = (5, 2, 1)
SHARE, CEILING, SEED = 1.5, 2.0, "mix-1"


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """source, source_size, target: one row per source of `sizes(source, size)`."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = with_position(by_source.withColumn("last", F.col("source").isNull()), [], ["last", "source"])
    turn = (F.col("pos") - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    rows = stored(placed.select("source", "source_size", weight.alias("weight"), (ceiling * F.col("source_size")).alias("top")), "mix-sources")
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    # Raise the water level until no source is newly above its ceiling: every pass is one small sum
    # over the sources, and the last one changes nothing.
    level, capped = 0.0, -1
    while True:
        full = F.col("top") <= F.col("weight") * level
        held, free, n = rows.agg(
            F.coalesce(F.sum(F.when(full, F.col("top"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
            F.count(F.when(full, 1)),
        ).first()
        if n == capped or not free:
            break
        level, capped = (share * total - held) / free, n
    target = F.when(F.col("top") <= F.col("weight") * level, F.col("top")).otherwise(F.col("weight") * level)
    return rows.select("source", "source_size", target.alias("target"))


def copies(rate: Column, doc_id: Column, seed: str = SEED) -> Column:
    """floor(rate), and one more with the fraction's probability."""
    return (F.floor(rate) + (uniform(doc_id, seed=seed) < rate - F.floor(rate)).cast("int")).cast("long")


def _rated(docs: DataFrame, sizes: DataFrame, **how) -> DataFrame:
    goal = stored(targets(sizes, **how), "mix-targets").select(
        F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target")
    )
    # One row per source on the other side; a hot source's rows are split by adaptive execution.
    key = F.struct(F.col("source").isNull(), F.coalesce("source", F.lit("")))
    other = F.struct(F.col("__source").isNull(), F.coalesce("__source", F.lit("")))
    rows = docs.withColumn("__key", key).join(goal.withColumn("__other", other), F.col("__key") == F.col("__other"))
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    return rows.withColumn("__copies", copies(rate, F.col("doc_id"))).drop("__key", "__other", "__source")


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (copies times size)."""
    sizes = stored(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "mix-sizes")
    return _rated(sizes, sizes, **how).select(
        "doc_id", "source", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        F.col("__copies").alias("copies"), (F.col("__copies") * F.col("size")).alias("taken"),
    )


def emit(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every row of `docs` as often as it is taken, with its columns."""
    sizes = stored(docs.select("source", words(F.col("text")).alias("size")), "mix-sizes")
    rows = _rated(docs, sizes, **how).where(F.col("__copies") > 0)
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))).select(*docs.columns)

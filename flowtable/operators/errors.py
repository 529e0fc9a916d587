"""Failures as data: good rows and failing rows apart, batch errors, retries, chains."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtable.functions.common import names
from flowtable.session import materialise


def tried(df: DataFrame, outputs: Mapping[str, Column], error: Column) -> DataFrame:
    """Apply a step of column expressions and keep all rows: `outputs` are null where `error` is not."""
    marked = df.withColumns({**outputs, "error": error})
    return marked.withColumns({name: F.when(F.col("error").isNull(), F.col(name)) for name in outputs})


def isolate(df: DataFrame, outputs: Mapping[str, Column], error: Column) -> tuple[DataFrame, DataFrame]:
    """Apply a step of column expressions; return (good rows, quarantined rows).

    `error` is a text for a failing row and null for a good one. `outputs` must not throw:
    use the `try_` functions. Both sides are plain filters over the same narrow plan.
    """
    return split_errors(tried(df, outputs, error), list(outputs))


def isolate_rows(
    df: DataFrame, fn: Callable[[dict[str, Any]], dict[str, Any]], schema: T.StructType
) -> tuple[DataFrame, DataFrame]:
    """The same for an opaque Python function from an item to new columns (`schema`).

    The function runs once per row: its result is written out before the two sides split.
    """
    added = schema.fieldNames()
    full = T.StructType([*df.schema.fields, *schema.fields, T.StructField("error", T.StringType())])

    def attempt(row: dict[str, Any]) -> dict[str, Any]:
        try:
            return {**row, **fn(dict(row)), "error": None}
        except Exception as e:  # noqa: BLE001 - any failure of the user's function is data here
            return {**row, **dict.fromkeys(added), "error": f"{type(e).__name__}: {e}"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [attempt(r) for r in pdf.to_dict("records")]
            yield pd.DataFrame(rows, columns=full.fieldNames(), dtype=object)

    return split_errors(materialise(df.mapInPandas(run, full), "isolated"), added)


def split_errors(rows: DataFrame, added: list[str]) -> tuple[DataFrame, DataFrame]:
    ok = rows.where(F.col("error").isNull()).drop("error")
    return ok, rows.where(F.col("error").isNotNull()).drop(*added)


def spread_batch_errors(items: DataFrame, errors: DataFrame, batch="batch") -> DataFrame:
    """Give every item of a batch that raised the batch's error; null elsewhere."""
    keys = names(batch)
    per_batch = errors.groupBy(*keys).agg(F.min("error").alias("error"))
    return items.join(per_batch, keys, "left")


def retry_outcome(attempts: DataFrame, n: int = 3, item="item") -> DataFrame:
    """How each item ended after up to `n` attempts: (item, ok, attempt, error).

    The first success wins; an error that must not be retried ends at once; otherwise the
    last error stands. `attempts`: item, attempt (from 1), ok, retryable, error.
    """
    keys = names(item)
    ok, stop = F.col("ok"), ~F.col("ok") & ~F.col("retryable")
    facts = (
        attempts.where(F.col("attempt") <= n)
        .groupBy(*keys)
        .agg(
            F.min(F.when(ok, F.col("attempt"))).alias("__ok"),
            F.min(F.when(stop, F.col("attempt"))).alias("__stop"),
            F.max("attempt").alias("__last"),
            F.min_by(F.when(stop, F.col("error")), F.when(stop, F.col("attempt"))).alias("__stop_error"),
            F.max_by("error", "attempt").alias("__last_error"),
        )
    )
    won = F.col("__ok").isNotNull() & (F.col("__stop").isNull() | (F.col("__ok") < F.col("__stop")))
    return facts.select(
        *keys,
        won.alias("ok"),
        F.when(won, F.col("__ok")).otherwise(F.coalesce("__stop", "__last")).alias("attempt"),
        F.when(won, F.lit(None))
        .when(F.col("__stop").isNotNull(), F.col("__stop_error"))
        .otherwise(F.col("__last_error"))
        .alias("error"),
    )


def depth_progress(item_steps: DataFrame, steps: int, item="item") -> DataFrame:
    """How many items reach and complete each of the chained steps 1..`steps`.

    `item_steps`: one row per (item, step, failed); an item is lost after its first failure.
    """
    first = item_steps.groupBy(*names(item)).agg(F.min(F.when(F.col("failed"), F.col("step"))).alias("__lost"))
    # At most steps + 1 rows are left from here on.
    tally = first.groupBy("__lost").agg(F.count(F.lit(1)).alias("__n"))
    per_step = tally.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    lost = F.coalesce("__lost", F.lit(steps + 1))
    return per_step.groupBy("step").agg(
        F.sum(F.when(lost >= F.col("step"), F.col("__n")).otherwise(0)).alias("reached"),
        F.sum(F.when(lost > F.col("step"), F.col("__n")).otherwise(0)).alias("completed"),
    )

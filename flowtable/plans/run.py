"""Running steps over their items: skip what is done, run the rest, check, record."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtable.functions.common import names
from flowtable.functions.states import COMPLETED, FAILED, PARTIAL
from flowtable.operators.batches import batch
from flowtable.operators.history import EXECUTIONS_TYPE
from flowtable.operators.incremental import plan_skips
from flowtable.session import materialise
from flowtable.sources.outputs import write_outputs
from flowtable.sources.store import Store


@dataclass(frozen=True)
class StepResult:
    """`done`: items that flow on (run or skipped); `lost`: items with a missing output or
    whose step raised; `planned`: every item's key and action; `error`: what the step raised."""

    done: DataFrame
    lost: DataFrame
    planned: DataFrame
    error: str | None


def run_step(
    store: Store,
    task: str,
    items: DataFrame,
    declare: Callable[[DataFrame], DataFrame],
    run: Callable[[DataFrame], DataFrame],
    *,
    item: str = "item_id",
    run_id: int = 0,
    grouping: int = 1,
    force: bool = False,
    execution: Column | None = None,
) -> StepResult:
    """Run `task` over `items` (one row per `item`, the same at every read), and keep its
    outputs in `store`.

    `declare` maps items to (item, path, optional), `run` maps the items that must run to
    (item, path, content). Items whose outputs are all there are skipped, and flow on. The
    history gets one task run per `grouping` items, in order of `item`; `execution` is a
    struct(image, command, input, output) per item for it. A step that raises loses the
    items it ran, not the skipped ones and not the other steps.
    """
    version, started = store.new_version(), _now()
    keys = names(item)
    # Written once, before the outputs change; keys only, so skipped items are not copied.
    planned = materialise(plan_skips(items.select(*keys), declare(items), store.manifest(), item, force), "plan")
    todo = items.join(planned.where(F.col("action") == "run").select(*keys), keys, "left_semi")
    error = None
    try:
        files = write_outputs(
            run(todo), declare(todo), store.root, task, item, run=version.token, epoch=version.epoch
        )
        missing = files.where(F.col("status") == "missing").select(*keys).distinct()
    except Exception as e:  # noqa: BLE001 - a failing step is an outcome, not the end of the run
        error = f"{type(e).__name__}: {e}"
        missing = planned.where(F.col("action") == "run").select(*keys)
    _record(store, version, task, todo, missing, item, run_id, grouping, execution, started, error)
    return StepResult(
        items.join(missing, keys, "left_anti"), items.join(missing, keys, "left_semi"), planned, error
    )


@dataclass(frozen=True)
class ChainStep:
    """A step of a chain: as in `run_step`; `then` makes the next step's items of those that flow on."""

    task: str
    declare: Callable[[DataFrame], DataFrame]
    run: Callable[[DataFrame], DataFrame]
    then: Callable[[DataFrame], DataFrame] = lambda done: done
    grouping: int = 1


def run_chain(
    store: Store, name: str, items: DataFrame, steps: Sequence[ChainStep], run_id: int, item: str = "item_id"
) -> dict[str, StepResult]:
    """Run the steps one after another as one run of workflow `name`; lost items do not flow on.

    The store gets the run's record at the start and, with its outcome, at the end.
    """
    store.start_run(run_id, name)
    results = {}
    for step in steps:
        result = run_step(store, step.task, items, step.declare, step.run, item=item, run_id=run_id, grouping=step.grouping)
        results[step.task] = result
        items = materialise(step.then(result.done), "chain")
    store.complete_run(run_id)
    return results


@dataclass(frozen=True)
class GraphStep:
    """A step of a graph: as in `run_step`; `items` makes its items of what flows on from the steps it comes `after`."""

    task: str
    items: Callable[[Mapping[str, DataFrame]], DataFrame]
    declare: Callable[[DataFrame], DataFrame]
    run: Callable[[DataFrame], DataFrame]
    after: tuple[str, ...] = ()
    grouping: int = 1


def run_graph(
    store: Store, name: str, steps: Sequence[GraphStep], run_id: int, item: str = "item_id", parallel: int = 4
) -> dict[str, StepResult]:
    """Run a graph of steps as one run of workflow `name`: a step starts when those it comes after have ended, at most
    `parallel` of them at once, each a Spark job group in a scheduler pool of its own.

    A step that raises loses its items; steps that do not come after it go on. Where a step cannot be started at
    all, the others that do not need it are still run; then its error is raised and the run has no end.
    """
    known = {s.task: s for s in steps}
    if len(known) < len(steps):
        raise ValueError("task names are used by more than one task")
    if unknown := {a for s in steps for a in s.after} - known.keys():
        raise ValueError(f"no such tasks: {sorted(unknown)}")
    order = TopologicalSorter({s.task: s.after for s in steps})
    order.prepare()
    store.start_run(run_id, name)
    spark, flow, results, errors = store.spark, {}, {}, []

    def one(step: GraphStep) -> tuple[StepResult, DataFrame]:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{name}-{step.task}")
        items = materialise(step.items({a: flow[a] for a in step.after}), "graph")
        result = run_step(store, step.task, items, step.declare, step.run, item=item, run_id=run_id, grouping=step.grouping)
        return result, materialise(result.done, "graph")

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        running: dict = {}
        while order.is_active():
            running |= {pool.submit(one, known[task]): task for task in order.get_ready()}
            if not running:  # only steps behind one that could not be started are left
                break
            for ended in wait(running, return_when=FIRST_COMPLETED).done:
                task = running.pop(ended)
                if ended.exception():
                    errors.append(ended.exception())
                    continue
                results[task], flow[task] = ended.result()
                order.done(task)
    if errors:
        raise errors[0]
    store.complete_run(run_id)
    return results


def _record(store, version, task, todo, missing, item, run_id, grouping, execution, started, error) -> None:
    """One history row per batch of items, in the place a finished task run has."""
    executed = F.lit(None).cast(EXECUTIONS_TYPE.removeprefix("array<").removesuffix(">")) if execution is None else execution
    slim = todo.select(item, executed.alias("__x")).join(missing.withColumn("__bad", F.lit(True)), item, "left")
    rows = batch(slim, [], item, grouping).groupBy("batch_id").agg(
        F.bool_or(F.coalesce("__bad", F.lit(False))).alias("__bad"),
        F.sort_array(F.collect_list(F.struct("pos", "__x"))).alias("__x"),
    )
    status = F.lit(FAILED) if error else F.when(F.col("__bad"), PARTIAL).otherwise(COMPLETED)
    rows.select(
        F.concat(F.lit(f"{task}-{version.epoch}-"), F.col("batch_id").cast("string")).alias("id"),
        F.lit(run_id).cast("bigint").alias("run_id"),
        F.lit(task).alias("task_name"),
        F.lit(started).cast("bigint").alias("start_time"),
        status.alias("completion_status"),
        F.lit(_now()).cast("bigint").alias("completed_time"),
        F.transform("__x", lambda x: x["__x"]).cast(EXECUTIONS_TYPE).alias("executions"),
    ).write.parquet(store.path("task_runs", version))


def _now() -> int:
    return int(time.time() * 1000)

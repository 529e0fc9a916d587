"""A thin workflow: named steps, each a lazy DataFrame. Catalyst plans, an action runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from flowtable.functions.common import names
from flowtable.operators.position import with_position
from flowtable.operators.tasks import merge_as_json, merge_outputs


@dataclass(frozen=True)
class Step:
    name: str
    input: DataFrame
    output: DataFrame
    labels: tuple[str, ...] = ()


@dataclass
class Workflow:
    """Steps by name. The output of one step is the input of any number of later ones."""

    name: str
    steps: dict[str, Step] = field(default_factory=dict)

    def task(
        self,
        name: str,
        df: DataFrame,
        fn: Callable[[DataFrame], DataFrame],
        labels: Sequence[str] = (),
        keep_order: str | Sequence[str] | None = None,
    ) -> DataFrame:
        """Apply `fn` to `df` as step `name`; works the same on batch and streaming input.

        `keep_order` names unique sort keys: the items then carry their input position in
        `pos`, for a sort where they are finally written.
        """
        if name in self.steps:
            raise ValueError(f"task name {name} is used by more than one task")
        source = df if keep_order is None else with_position(df, [], names(keep_order))
        output = fn(source)
        self.steps[name] = Step(name, source, output, tuple(labels))
        return output

    def import_workflow(self, other: Workflow) -> Workflow:
        """Take over another workflow's steps; those of the same name are replaced."""
        self.steps.update(other.steps)
        return other

    def input(self, name: str) -> DataFrame:
        return self.steps[name].input

    def output(self, name: str) -> DataFrame:
        return self.steps[name].output

    def merged(self, as_json: bool = False) -> DataFrame:
        """The outputs of all steps as one table."""
        outputs = {name: step.output for name, step in self.steps.items()}
        return merge_as_json(outputs) if as_json else merge_outputs(outputs)

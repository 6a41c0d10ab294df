"""Failures that come up in an action, traced to the step that causes them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from weftline.plans.nodes import Node
from weftline.sources.storage import Storage


@dataclass
class Step:
    """A step of a run: its node, the frame before and after it, and the steps inside it, where it is a fork."""

    node: Node
    before: DataFrame
    after: DataFrame
    inside: list[Step] = field(default_factory=list)


def _fails(df: DataFrame, like: PySparkException) -> bool:
    """Whether computing all rows and columns fails as the action did."""
    try:
        df.write.format("noop").mode("overwrite").save()
    except PySparkException as e:
        return e.getCondition() == like.getCondition()
    return False


def failing_step(steps: list[Step], error: PySparkException) -> Step | None:
    """The first step whose result fails as an action on the last one did, found by halving; then the one inside it, where it is a fork.

    What fails in the end is part of every frame from the step that made it on, so that few of them are computed: as many as halvings.
    """
    low, high = 0, len(steps)
    while low < high:
        middle = (low + high) // 2
        if _fails(steps[middle].after, error):
            high = middle
        else:
            low = middle + 1
    if low == len(steps):
        return None
    found = steps[low]
    for inner in found.inside:  # sides of a fork do not follow each other
        if not _fails(inner.before, error) and _fails(inner.after, error):
            return failing_step([inner], error) if inner.inside else inner
    return found


@contextmanager
def watched(steps: list[Step], store: Storage) -> Iterator[None]:
    """Within it, an action that fails leaves the input of the step that makes it fail in storage under ``FAIL_DF_...``, and says so."""
    try:
        yield
    except PySparkException as e:
        if (step := failing_step(steps, e)) is not None:
            key = f"FAIL_DF_{step.node.kind}"
            store.set(key, step.before)
            e.add_note(f"'{step.node.id}' makes this fail; the dataframe before it is in storage under '{key}'")
        raise

"""Pipelines: steps and how their frames part and meet again."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from contextlib import AbstractContextManager
from typing import Any

from pyspark.sql import DataFrame

from weftline.plans.builder import Builder, _skipped, check_apply_to_rows, check_branch, is_keyword, is_transformer
from weftline.plans.config import PipelineConfig
from weftline.plans.executor import Executor
from weftline.plans.failures import Step, watched
from weftline.plans.hooks import LoggingHooks, NoOpHooks, PipelineHooks
from weftline.plans.nodes import InputNode, Node, OutputNode, SequenceNode
from weftline.plans.render import Printer, dot
from weftline.sources.storage import Storage, storage


class TransformerPipeline:
    """A sequence of steps from frame to frame.

    A step is a transformer, a function of a frame, (function, args, kwargs, description), (transformer, description), another pipeline,
    a storage keyword such as {"store": key}, or a list of steps. The pipeline may also:

    - *split*: ``data`` is a dictionary of steps by name and ``split_function`` gives a frame for each; results are unioned;
    - *branch*: ``branch`` = {"end": "append" | "join" | "dead-end", "storage": key, join options}; ``otherwise`` is what the main frame goes through;
    - *apply_to_rows*: steps for the rows where a condition is true, ``otherwise`` for the rest, unioned.

    ``skip`` or ``perform=False`` leave the pipeline, or a branch of it, out.
    """

    def __init__(
        self,
        data: Any,
        *,
        name: str | None = None,
        df_input_name: str | None = None,
        df_output_name: str | None = None,
        interleaved: list | None = None,
        prepend_interleaved: bool = False,
        append_interleaved: bool = False,
        split_function: Callable | None = None,
        split_order: list[str] | None = None,
        split_apply_after_splitting: list | None = None,
        split_apply_before_appending: list | None = None,
        splits_no_merge: str | Iterable[str] | None = None,
        splits_skip_if_empty: str | Iterable[str] | None = None,
        branch: dict[str, Any] | None = None,
        apply_to_rows: dict[str, Any] | None = None,
        otherwise: Any = None,
        allow_missing_columns: bool = False,
        cast_subsets_to_input_schema: bool = False,
        repartition_output_to_original: bool = False,
        coalesce_output_to_original: bool = False,
        skip: bool | None = None,
        perform: bool | None = None,
        store: Storage = storage,
    ):
        self.name, self._store = name, store
        if allow_missing_columns and cast_subsets_to_input_schema:
            raise ValueError("'allow_missing_columns' and 'cast_subsets_to_input_schema' exclude each other")
        if repartition_output_to_original and coalesce_output_to_original:
            raise ValueError("'repartition_output_to_original' and 'coalesce_output_to_original' exclude each other")
        if split_function is not None and not callable(split_function):
            raise TypeError("'split_function' is not callable")
        is_split = split_function is not None
        self._check_forks(is_split, branch, apply_to_rows, otherwise)
        if _skipped({"skip": skip, "perform": perform}, "pipeline"):
            data, branch, apply_to_rows, otherwise, is_split = [], None, None, None, False
        if branch is not None:
            check_branch(branch)
        if apply_to_rows is not None:
            check_apply_to_rows(apply_to_rows)
        if (branch is not None and _skipped(branch, "branch")) or (apply_to_rows is not None and _skipped(apply_to_rows, "apply_to_rows")):
            data, branch, apply_to_rows, otherwise = otherwise if otherwise is not None else [], None, None, None

        builder = Builder(interleaved, prepend_interleaved, append_interleaved)
        merge = {
            "allow_missing_columns": allow_missing_columns,
            "cast_subsets_to_input_schema": cast_subsets_to_input_schema,
            "repartition_output_to_original": repartition_output_to_original,
            "coalesce_output_to_original": coalesce_output_to_original,
        }
        if is_split:
            if not isinstance(data, dict) or len(data) < 2:
                raise ValueError("a split pipeline is a dictionary of two splits or more")
            steps: list[Node] = [
                builder.split(data, split_function, split_order, split_apply_after_splitting, split_apply_before_appending, splits_no_merge, splits_skip_if_empty, merge)
            ]
        elif isinstance(data, dict) and not is_keyword(data):
            raise ValueError("a dictionary is a storage keyword, or splits, which need 'split_function'")
        elif branch is not None:
            steps = [builder.branch(data, branch, otherwise, merge)]
        elif apply_to_rows is not None:
            steps = [builder.apply_to_rows(data, apply_to_rows, otherwise, merge)]
        else:
            steps = builder.sequence(data)
        self._ir = SequenceNode(name=name, steps=[InputNode(name=df_input_name or "DF input"), *steps, OutputNode(name=df_output_name or "DF output")])
        self._ir.assign_ids()
        self._last: list[Step] = []

    @staticmethod
    def _check_forks(is_split: bool, branch: Any, rows: Any, otherwise: Any) -> None:
        if is_split and (branch is not None or rows is not None or otherwise is not None):
            raise ValueError("a split pipeline has no 'branch', 'apply_to_rows' or 'otherwise'")
        if branch is not None and rows is not None:
            raise ValueError("'branch' and 'apply_to_rows' exclude each other")
        if otherwise is None:
            return
        if branch is None and rows is None:
            raise ValueError("'otherwise' goes with 'branch' or 'apply_to_rows'")
        if isinstance(branch, dict) and "storage" in branch:
            raise ValueError("a branch from storage has no 'otherwise'")
        if (isinstance(branch, dict) and branch.get("end") == "dead-end") or (isinstance(rows, dict) and rows.get("dead-end")):
            raise ValueError("a dead end has no 'otherwise'")

    def run(
        self,
        df: DataFrame,
        *,
        hooks: PipelineHooks | None = None,
        resume_from: str | None = None,
        show_params: bool | None = None,
        verbose: bool | None = None,
        after_each_step: Any = None,
    ) -> DataFrame:
        """The frame after all steps. ``after_each_step`` is a transformer or function that runs after every step and merge."""
        if hooks is None:
            loud = PipelineConfig["verbose"] if verbose is None else verbose
            shown = PipelineConfig["show_params"] if show_params is None else show_params
            hooks = LoggingHooks(max_param_length=PipelineConfig["max_param_length"], show_params=shown) if loud else NoOpHooks()
        if after_each_step is not None and not (is_transformer(after_each_step) or callable(after_each_step)):
            raise TypeError("'after_each_step' is a transformer or a function")
        executor = Executor(self._ir, self._store, hooks, resume_from, after_each_step)
        out = executor.run(df)
        self._last = executor.trace
        return out

    def watch(self) -> AbstractContextManager[None]:
        """For actions on what the last run gave: ``with pipeline.watch(): out.collect()``.

        Frames are lazy, so that a value that cannot be computed fails in the action. Then the step that makes it fail is looked for, by computing the
        frames after some of the steps, and its input is put in storage under ``FAIL_DF_...``; the error says which.
        """
        return watched(self._last, self._store)

    #: A pipeline is a transformer too.
    def transform(self, df: DataFrame) -> DataFrame:
        return self.run(df, verbose=False)

    def to_string(self, *, show_params: bool = False, add_ids: bool = False, indent_size: int = 4) -> str:
        return Printer(show_params=show_params, add_ids=add_ids, indent_size=indent_size).text(self._ir)

    def show(self, *, show_params: bool = False, add_ids: bool = False, indent_size: int = 4) -> None:
        print(self.to_string(show_params=show_params, add_ids=add_ids, indent_size=indent_size))

    def to_dot(self, *, show_params: bool = False, add_description: bool = False) -> str:
        """Graphviz source, made without Graphviz."""
        return dot(self._ir, show_params=show_params, add_description=add_description)

    def plot(self, *, show_params: bool = False, add_description: bool = False) -> Any:
        """A graphviz.Source of the pipeline; ImportError where graphviz is not installed."""
        from graphviz import Source

        return Source(self.to_dot(show_params=show_params, add_description=add_description))

    def get_node_ids(self) -> list[str]:
        """Ids in the order of running, those inside forks included."""
        return [n.id for n in self._ir.walk()]

    def find_node(self, node_id: str) -> Node | None:
        return self._ir.find_by_id(node_id)

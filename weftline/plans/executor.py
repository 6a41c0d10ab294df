"""Runs the tree: extends the frame's plan step by step. Spark computes nothing unless a step asks for it."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.conditions import condition
from weftline.functions.frames import cast_to_schema, planned_partitions, split_df
from weftline.operators.combining import append_dataframes, join_dataframes
from weftline.plans.builder import JOIN_KEYS, is_transformer
from weftline.plans.failures import Step
from weftline.plans.hooks import NoOpHooks, PipelineHooks
from weftline.plans.nodes import ConversionNode, ForkNode, FunctionNode, InputNode, Node, OutputNode, SequenceNode, StorageNode, TransformerNode
from weftline.plans.one_scan import Side, one_scan, row_wise, split_paths
from weftline.sources.storage import Storage


def call(step: Any, df: DataFrame) -> DataFrame:
    """A transformer or a function on a frame."""
    return step.transform(df) if is_transformer(step) else step(df)


class Executor:
    """One run of a tree.

    A failing step leaves its input frames in storage under ``FAIL_DF_...``. As frames are lazy, only what fails while plans
    are built, or in a step that runs a job, is caught here; what fails in an action is traced to its step by ``TransformerPipeline.watch``. ``resume_from`` skips every step before the node of that id, wherever in the tree
    it stands: forks on the way to it are entered, those before it are passed by.
    """

    def __init__(
        self, root: SequenceNode, store: Storage, hooks: PipelineHooks | None = None, resume_from: str | None = None, after_each_step: Callable[..., Any] | Any = None
    ):
        self.root, self.store, self.hooks, self.after = root, store, hooks or NoOpHooks(), after_each_step
        self.resume_from = resume_from
        if resume_from is not None and root.find_by_id(resume_from) is None:
            raise ValueError(f"no node has the id '{resume_from}'")
        self.resuming = resume_from is not None
        self._failing: list[dict[str, DataFrame]] = []
        #: The steps done, each with those inside it.
        self.trace: list[Step] = []
        self._inside: list[list[Step]] = [self.trace]

    def run(self, df: DataFrame) -> DataFrame:
        began = time.perf_counter()
        self.hooks.on_pipeline_start(self.root, {"df": df})
        try:
            out = self._node(self.root, df)
        except Exception as e:
            self._keep_failing(e)
        self.hooks.on_pipeline_end(self.root, 1000 * (time.perf_counter() - began), {"df": out})
        return out

    def _keep_failing(self, error: Exception) -> None:
        """Stores the inputs of what failed, the innermost step and the forks around it, and raises the error with their keys."""
        keys = {f"FAIL_DF_{k}": v for held in self._failing for k, v in held.items()}
        if not keys:
            raise error
        for k, v in keys.items():
            self.store.set(k, v)
        told = f"The dataframes before the failure are in storage under {sorted(keys)}"
        if isinstance(error, PySparkException):
            error.add_note(told)
            raise error
        try:
            again = type(error)(f"{told}\n{error}")
        except Exception:  # an exception that is not made from a message
            error.add_note(told)
            raise error from None
        raise again from error

    def _node(self, node: Node, df: DataFrame) -> DataFrame:
        if self.resuming and node.id == self.resume_from:
            self.resuming = False
        if isinstance(node, SequenceNode):
            for n in node.steps:
                df = self._node(n, df)
            return df
        if isinstance(node, (InputNode, OutputNode)):
            return df
        if self.resuming and not (isinstance(node, ForkNode) and node.find_by_id(self.resume_from)):
            self.hooks.on_skip(node, "before the node to resume from", {"df": df})
            return df
        began = time.perf_counter()
        self.hooks.on_node_start(node, {"df": df})
        self._failing.append({node.kind: df} if isinstance(node, (TransformerNode, FunctionNode, ForkNode)) else {})
        self._inside.append([])
        try:
            out = self._leaf_or_fork(node, df)
            if self.after is not None and isinstance(node, (TransformerNode, FunctionNode, ForkNode)):
                out = call(self.after, out)
        except Exception as e:
            self.hooks.on_error(node, e, {"df": df})
            raise
        finally:
            inside = self._inside.pop()
        if isinstance(node, (TransformerNode, FunctionNode, ForkNode)):
            self._inside[-1].append(Step(node, df, out, inside))
        self._failing.pop()
        self.hooks.on_node_end(node, 1000 * (time.perf_counter() - began), {"df": out})
        return out

    def _leaf_or_fork(self, node: Node, df: DataFrame) -> DataFrame:
        if isinstance(node, TransformerNode):
            return node.transformer.transform(df)
        if isinstance(node, FunctionNode):
            return node.func(df, *node.args, **node.kwargs)
        if isinstance(node, StorageNode):
            return self._storage(node, df)
        if isinstance(node, ConversionNode):
            if node.operation in ("collect", "to_lazy"):
                raise TypeError(f"'{node.operation}': Spark frames are always lazy")
            return df
        return self._fork(node, df)

    def _storage(self, node: StorageNode, df: DataFrame) -> DataFrame:
        name, value = node.operation, node.value
        if name == "from_store":
            return self.store.get(value)
        if name in ("store", "store_debug"):
            self.store.set(value, df, debug=name == "store_debug")
            self.hooks.on_checkpoint(node, {"df": df})
        elif name == "storage_debug_mode":
            self.store.allow_debug(value)
        elif name == "clear":
            self.store.clear(value)
        else:
            self.store.clear_except(value)
        return df

    def _steps(self, nodes: list[Node], df: DataFrame) -> DataFrame:
        for n in nodes:
            df = self._node(n, df)
        return df

    def _fork(self, node: ForkNode, df: DataFrame) -> DataFrame:
        target = self.resume_from if self.resuming else None
        if (out := self._in_one_scan(node, df)) is not None:
            return out
        if node.kind_of_fork == "split":
            return self._split(node, df, target)
        if node.kind_of_fork == "branch":
            start = self.store.get(node.config["storage"]) if "storage" in node.config else df
            done = self._side(node.branches["branch"], start, target)
            if node.end == "dead-end":
                return df
            main = self._side(node.otherwise, df, target)
            if node.end == "join":
                return self._merged(node, df, {"branch": done, "main": main}, "join")
            return self._merged(node, df, {"branch": done, "main": main}, "append")
        c = node.config
        matched, rest = split_df(df, c["input_col"], c["operator"], c.get("value"), c.get("comparison_column"))
        done = None
        if not (c.get("skip_if_empty") and matched.isEmpty()):
            done = self._side(node.branches["apply_to_rows"], matched, target)
        if node.end == "dead-end":
            return rest
        rest = self._side(node.otherwise, rest, target)
        return rest if done is None else self._merged(node, df, {"apply_to_rows": done, "otherwise": rest}, "append")

    def _in_one_scan(self, node: ForkNode, df: DataFrame) -> DataFrame | None:
        """The fork as a projection over one scan, where all sides work row by row; else None. Hooks hear of its steps when all are built."""
        plain = not self.resuming and self.after is None and node.end == "append" and not node.no_merge and not node.merge.get("cast_subsets_to_input_schema")
        lists = [*node.branches.values(), *([node.otherwise] if node.otherwise is not None else [])]
        if not plain or "storage" in node.config or not all(row_wise(nodes) for nodes in lists):
            return None
        missing = node.merge.get("allow_missing_columns", False)
        if missing and (node.skip_if_empty or node.config.get("skip_if_empty")):
            return None  # an empty side would add its columns
        if node.kind_of_fork == "split":
            paths = split_paths(df, node.split_function)
            if paths is None or set(paths) != set(node.branches):
                return None
            sides, exclusive = [Side(name, steps, path=paths[name]) for name, steps in node.branches.items()], False
        elif node.kind_of_fork == "branch":
            sides, exclusive = [Side("branch", node.branches["branch"]), Side("main", node.otherwise)], False
        else:
            c = node.config
            chosen = condition(c["input_col"], c["operator"], c.get("value"), c.get("comparison_column"))
            sides, exclusive = [Side("apply_to_rows", node.branches["apply_to_rows"], chosen), Side("otherwise", node.otherwise, ~F.coalesce(chosen, F.lit(False)))], True
        out = one_scan(df, sides, exclusive, missing)
        if out is None:
            return None
        for steps in lists:
            for n in steps:
                for inner in n.walk():
                    if isinstance(inner, TransformerNode):
                        self.hooks.on_node_start(inner, {"df": df})
                        self.hooks.on_node_end(inner, 0.0, {"df": out})
        return self._spread(node, df, out)

    def _side(self, nodes: list[Node] | None, df: DataFrame, target: str | None) -> DataFrame:
        """One side of a fork. While the run looks for a node in another side, this one runs in full."""
        if nodes is None:
            return df
        here = target is None or any(n.find_by_id(target) for n in nodes)
        if here or not self.resuming:
            return self._steps(nodes, df)
        self.resuming = False
        try:
            return self._steps(nodes, df)
        finally:
            self.resuming = True

    def _split(self, node: ForkNode, df: DataFrame, target: str | None) -> DataFrame:
        frames = node.split_function(df)
        if not isinstance(frames, dict) or set(frames) != set(node.branches):
            got = sorted(frames) if isinstance(frames, dict) else type(frames).__name__
            raise KeyError(f"the split function gave {got}, the pipeline has {sorted(node.branches)}")
        kept = {}
        for name, steps in node.branches.items():
            if name in node.skip_if_empty and frames[name].isEmpty():
                continue
            out = self._side(steps, frames[name], target)
            if name not in node.no_merge:
                kept[name] = out
        return self._merged(node, df, kept, "append") if kept else df

    def _merged(self, node: ForkNode, df: DataFrame, frames: dict[str, DataFrame], how: str) -> DataFrame:
        """The sides as one frame, in their order, spread over as many partitions as the input where asked for."""
        doing = "appending" if how == "append" else "joining"
        self._failing.append({f"{k}-df-before-{doing}:{how}": v for k, v in frames.items()})
        options = node.merge
        if how == "join":
            keys = {k: node.config[k] for k in JOIN_KEYS if k in node.config}
            out = join_dataframes(frames["main"], frames["branch"], **keys)
        else:
            sides = list(frames.values())
            if options.get("cast_subsets_to_input_schema"):
                sides = [cast_to_schema(s, df.schema) for s in sides]
            out = append_dataframes(sides, options.get("allow_missing_columns", False))
        out = self._spread(node, df, out)
        self._failing.pop()
        return out

    def _spread(self, node: ForkNode, df: DataFrame, out: DataFrame) -> DataFrame:
        """The result over as many partitions as the input is planned to have, where asked for."""
        if node.merge.get("repartition_output_to_original"):
            out = out.repartition(planned_partitions(df))
        if node.merge.get("coalesce_output_to_original"):
            out = out.coalesce(planned_partitions(df))
        return out

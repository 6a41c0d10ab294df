"""From steps and options, as users write them, to the tree."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable
from copy import copy
from typing import Any

from weftline.functions.conditions import check_condition
from weftline.functions.selectors import as_list
from weftline.operators.combining import check_join
from weftline.plans.nodes import ConversionNode, ForkNode, FunctionNode, InputNode, Node, OutputNode, SequenceNode, StorageNode, TransformerNode

STORAGE_KEYWORDS = ("store", "store_debug", "from_store", "storage_debug_mode", "clear", "clear_except")
CONVERSIONS = ("to_native", "from_native", "collect", "to_lazy")
JOIN_KEYS = ("how", "on", "left_on", "right_on", "suffix", "broadcast", "coalesce_keys")


def is_keyword(step: Any) -> bool:
    """Whether a step is a storage or conversion keyword."""
    if isinstance(step, dict):
        return len(step) == 1 and next(iter(step)) in STORAGE_KEYWORDS
    return isinstance(step, str) and (step == "clear" or step in CONVERSIONS)


def is_transformer(step: Any) -> bool:
    """Whether an object can be used as a step: its ``transform`` takes the frame first and has defaults for the rest."""
    if isinstance(step, type) or not callable(getattr(step, "transform", None)):
        return False
    try:
        first, *rest = inspect.signature(step.transform).parameters.values()
    except (TypeError, ValueError):
        return False
    fits = first.kind in (first.POSITIONAL_ONLY, first.POSITIONAL_OR_KEYWORD, first.VAR_POSITIONAL)
    return fits and all(p.default is not p.empty or p.kind in (p.VAR_POSITIONAL, p.VAR_KEYWORD) for p in rest)


def flattened(steps: Any) -> list[Any]:
    """Steps with nested lists opened and None left out; a single step is a list of one."""
    if steps is None:
        return []
    if isinstance(steps, list):
        return [x for s in steps for x in flattened(s)]
    return [steps]


def _skipped(o: dict[str, Any], what: str) -> bool:
    skip, perform = o.get("skip"), o.get("perform")
    if skip is not None and perform is not None and bool(skip) == bool(perform):
        raise ValueError(f"{what}: 'skip' and 'perform' contradict each other")
    return bool(skip) or perform is False


def check_branch(o: Any) -> None:
    if not isinstance(o, dict):
        raise TypeError("'branch' is a dictionary")
    end = o.get("end")
    if extra := set(o) - {"end", "storage", "skip", "perform", *JOIN_KEYS}:
        raise KeyError(f"unknown keys in 'branch': {sorted(extra)}")
    if "end" not in o:
        raise KeyError("'branch' needs 'end'")
    if end not in ("join", "append", "dead-end"):
        raise ValueError("'end' is 'join', 'append' or 'dead-end'")
    if end == "join":
        if "how" not in o:
            raise KeyError("a join needs 'how'")
        check_join(o["how"], o.get("on"), o.get("left_on"), o.get("right_on"))
    elif extra := set(o) & set(JOIN_KEYS):
        raise KeyError(f"{sorted(extra)} are for joins")


def check_apply_to_rows(o: Any) -> None:
    if not isinstance(o, dict):
        raise TypeError("'apply_to_rows' is a dictionary")
    if missing := {"input_col", "operator"} - set(o):
        raise KeyError(f"'apply_to_rows' needs {sorted(missing)}")
    if extra := set(o) - {"input_col", "operator", "value", "comparison_column", "dead-end", "skip_if_empty", "skip", "perform"}:
        raise KeyError(f"unknown keys in 'apply_to_rows': {sorted(extra)}")
    if o.get("value") is not None and o.get("comparison_column") is not None:
        raise ValueError("give either 'value' or 'comparison_column'")
    if o["input_col"] == o.get("comparison_column"):
        raise ValueError("a column is not compared with itself")
    for flag in ("skip_if_empty", "dead-end"):
        if o.get(flag, False) not in (True, False):
            raise ValueError(f"'{flag}' is True or False")
    check_condition(o["operator"], o.get("value"), o.get("comparison_column"))


class Builder:
    """Builds the tree of one pipeline."""

    def __init__(self, interleaved: Any = None, prepend: bool = False, append: bool = False):
        self.interleaved, self.prepend, self.append = flattened(interleaved), prepend, append

    def node(self, step: Any) -> Node:
        if isinstance(step, Node):
            return step
        if isinstance(step, tuple):
            return self._tuple(step)
        if is_keyword(step):
            return self._keyword(step)
        if hasattr(step, "_ir"):
            return self._nested(step)
        if is_transformer(step):
            described = getattr(step, "get_description", None)
            return TransformerNode(transformer=step, description=described() if described else None)
        if callable(step) and not isinstance(step, type):
            return FunctionNode(func=step)
        raise TypeError(f"not a step: {step!r}")

    def _tuple(self, step: tuple) -> Node:
        if not step:
            raise ValueError("an empty tuple is not a step")
        head, *rest = step
        if is_transformer(head):
            if len(rest) != 1 or not isinstance(rest[0], str):
                raise ValueError(f"a transformer in a tuple has a description behind it: {step!r}")
            return TransformerNode(transformer=head, description=rest[0])
        if not callable(head) or isinstance(head, type) or len(rest) > 3:
            raise ValueError(f"a tuple is (function, args, kwargs, description) or (transformer, description): {step!r}")
        args, kwargs, text = (*rest, *(None, None, None)[len(rest) :])
        if args is not None and not isinstance(args, (list, tuple)):
            raise TypeError(f"args are a list or a tuple: {args!r}")
        if kwargs is not None and not isinstance(kwargs, dict):
            raise TypeError(f"kwargs are a dictionary: {kwargs!r}")
        return FunctionNode(func=head, args=tuple(args or ()), kwargs=dict(kwargs or {}), description=text)

    @staticmethod
    def _keyword(step: Any) -> Node:
        if isinstance(step, str):
            return StorageNode(operation="clear") if step == "clear" else ConversionNode(operation=step)
        ((name, value),) = step.items()
        if name == "storage_debug_mode" and not isinstance(value, bool):
            raise TypeError("'storage_debug_mode' is True or False")
        if name == "clear" and isinstance(value, bool):
            value = None if value else []
        return StorageNode(operation=name, value=value)

    @staticmethod
    def _nested(pipeline: Any) -> Node:
        """The steps of another pipeline, without its input and output; one step alone stands for the pipeline."""
        steps = [n for n in pipeline._ir.steps if not isinstance(n, (InputNode, OutputNode))]
        steps = [_copied(n) for n in steps]
        return steps[0] if len(steps) == 1 and not isinstance(steps[0], ForkNode) and not pipeline.name else SequenceNode(name=pipeline.name, steps=steps)

    def sequence(self, steps: Any) -> list[Node]:
        """Nodes of steps, with the interleaved ones after every transformer, function or pipeline but the last."""
        items = flattened(steps)
        nodes = [self.node(s) for s in items]
        if not self.interleaved:
            return nodes
        out: list[Node] = [self.node(s) for s in self.interleaved] if self.prepend else []
        last = max((i for i, n in enumerate(nodes) if not isinstance(n, (StorageNode, ConversionNode))), default=-1)
        for i, n in enumerate(nodes):
            out.append(n)
            if not isinstance(n, (StorageNode, ConversionNode)) and (i != last or self.append):
                out += [self.node(s) for s in self.interleaved]
        return out

    def split(
        self,
        splits: dict[str, Any],
        function: Callable[..., Any],
        order: list[str] | None,
        after_splitting: Any,
        before_appending: Any,
        no_merge: str | Iterable[str] | None,
        skip_if_empty: str | Iterable[str] | None,
        merge: dict[str, Any],
    ) -> ForkNode:
        names = sorted(splits)
        if order is not None:
            if not isinstance(order, (list, tuple)) or not all(isinstance(x, str) for x in order):
                raise TypeError("'split_order' is a list of names")
            if sorted(order) != names:
                raise KeyError(f"'split_order' {sorted(order)} and the splits {names} differ")
            names = list(order)
        for what, given in (("splits_no_merge", as_list(no_merge)), ("splits_skip_if_empty", as_list(skip_if_empty))):
            if unknown := set(given) - set(names):
                raise KeyError(f"'{what}' has unknown splits: {sorted(unknown)}")
        branches = {n: self.sequence([flattened(after_splitting), flattened(splits[n]), flattened(before_appending)]) for n in names}
        return ForkNode(
            kind_of_fork="split", branches=branches, split_function=function, no_merge=frozenset(as_list(no_merge)), skip_if_empty=frozenset(as_list(skip_if_empty)), merge=merge
        )

    def branch(self, steps: Any, branch: dict[str, Any], otherwise: Any, merge: dict[str, Any]) -> ForkNode:
        return ForkNode(
            kind_of_fork="branch",
            branches={"branch": self.sequence(steps)},
            otherwise=self.sequence(otherwise) if otherwise is not None else None,
            config={k: v for k, v in branch.items() if k not in ("skip", "perform")},
            end=branch["end"],
            merge=merge,
        )

    def apply_to_rows(self, steps: Any, rule: dict[str, Any], otherwise: Any, merge: dict[str, Any]) -> ForkNode:
        return ForkNode(
            kind_of_fork="apply_to_rows",
            branches={"apply_to_rows": self.sequence(steps)},
            otherwise=self.sequence(otherwise) if otherwise is not None else None,
            config={k: v for k, v in rule.items() if k not in ("skip", "perform")},
            end="dead-end" if rule.get("dead-end") else "append",
            merge=merge,
        )


def _copied(node: Node) -> Node:
    """A copy with copied nodes below, so that ids given in one place do not change another."""
    out = copy(node)
    if isinstance(out, SequenceNode):
        out.steps = [_copied(n) for n in out.steps]
    if isinstance(out, ForkNode):
        out.branches = {k: [_copied(n) for n in v] for k, v in out.branches.items()}
        out.otherwise = [_copied(n) for n in out.otherwise] if out.otherwise is not None else None
    return out

"""The tree of a pipeline: sequences of steps and forks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from weftline.operators.base import is_lazy_reference


def describe(value: Any) -> str:
    """A value as printed: texts in quotes, stored ones by their key, functions by name."""
    if is_lazy_reference(value):
        return f'ns.get("{value[1]}")'
    if isinstance(value, str):
        return f'"{value}"'
    if isinstance(value, dict):
        return "{" + ", ".join(f"{describe(k)}: {describe(v)}" for k, v in value.items()) + "}"
    if isinstance(value, (list, tuple)):
        inner = ", ".join(map(describe, value))
        return f"[{inner}]" if isinstance(value, list) else f"({inner})"
    if callable(value) and hasattr(value, "__name__"):
        return value.__name__
    return str(value)


def shortened(text: str, width: int) -> str:
    """The text with its middle left out where it is longer than ``width``."""
    if width <= 0 or len(text) <= width:
        return text
    half = max(1, width // 2 - 3)
    return f"{text[:half]} ... {text[-half:]}"


def parameters(values: dict[str, Any], width: int) -> str:
    """key=value of each parameter, sorted by key."""
    return ", ".join(f"{k}={shortened(describe(v), width)}" for k, v in sorted(values.items()))


@dataclass
class Node:
    """A part of a pipeline. ``id`` tells what it is and where it stands."""

    id: str = field(default="", init=False)

    @property
    def prefix(self) -> str:
        raise NotImplementedError

    @property
    def content(self) -> str:
        """What makes the node differ from others in the same place."""
        return self.prefix

    def children(self) -> list[tuple[str, list[Node]]]:
        """Named lists of nodes below this one, in the order they run."""
        return []

    def walk(self) -> Iterator[Node]:
        yield self
        for _, nodes in self.children():
            for n in nodes:
                yield from n.walk()

    def find_by_id(self, node_id: str) -> Node | None:
        return next((n for n in self.walk() if n.id == node_id), None)

    def assign_ids(self, path: str = "") -> None:
        """Ids of this node and all below: prefix, six hex digits of the content's sha256, place in the tree."""
        digest = hashlib.sha256(self.content.encode()).hexdigest()[:6]
        clean = self.prefix.replace(" ", "_").replace(":", "_")
        self.id = f"{clean}_{digest}@{path or 'root'}"
        for name, nodes in self.children():
            for i, n in enumerate(nodes):
                n.assign_ids(".".join(x for x in (path, name, str(i)) if x))


@dataclass
class InputNode(Node):
    name: str = "DF input"

    @property
    def prefix(self) -> str:
        return "input"

    @property
    def content(self) -> str:
        return f"input:{self.name}"


@dataclass
class OutputNode(Node):
    name: str = "DF output"

    @property
    def prefix(self) -> str:
        return "output"

    @property
    def content(self) -> str:
        return f"output:{self.name}"


@dataclass
class TransformerNode(Node):
    transformer: Any = None
    description: str | None = None

    @property
    def _class(self) -> type:
        return getattr(self.transformer, "trf", type(self.transformer))

    @property
    def name(self) -> str:
        return f"(Lazy) {self._class.__name__}" if hasattr(self.transformer, "trf") else self._class.__name__

    @property
    def params(self) -> dict[str, Any]:
        return getattr(self.transformer, "kwargs", None) or getattr(self.transformer, "transformer_init_parameters", {})

    @property
    def prefix(self) -> str:
        return self._class.__name__

    @property
    def content(self) -> str:
        return f"{self.prefix}:{parameters(self.params, 0)}"

    @property
    def kind(self) -> str:
        return f"transformer:{self._class.__name__}"


@dataclass
class FunctionNode(Node):
    func: Callable[..., Any] | None = None
    args: tuple = ()
    kwargs: dict[str, Any] = field(default_factory=dict)
    description: str | None = None

    @property
    def name(self) -> str:
        return getattr(self.func, "__name__", type(self.func).__name__)

    @property
    def prefix(self) -> str:
        return f"fn_{self.name}"

    @property
    def content(self) -> str:
        return f"{self.name}:{describe(list(self.args))}:{parameters(self.kwargs, 0)}"

    @property
    def kind(self) -> str:
        return f"function:{self.name}"


@dataclass
class StorageNode(Node):
    """operation: store, store_debug, from_store, storage_debug_mode, clear or clear_except; value: its key, keys or flag."""

    operation: str = "store"
    value: Any = None

    @property
    def prefix(self) -> str:
        return f"{self.operation}:{self.value}" if self.operation in ("store", "store_debug", "from_store") else self.operation

    @property
    def content(self) -> str:
        return f"{self.operation}:{self.value}"

    @property
    def message(self) -> str:
        if self.operation == "clear":
            return "Clear all storage" if self.value is None else f"Clear storage keys: {self.value}"
        if self.operation == "storage_debug_mode":
            return f"{'Activate' if self.value else 'Deactivate'} storage debug mode"
        text = {
            "store": 'Store df with key "{}"',
            "store_debug": 'Store df (debug) with key "{}"',
            "from_store": 'Load df from key "{}"',
            "clear_except": "Clear storage except keys: {}",
        }
        return text[self.operation].format(self.value)


@dataclass
class ConversionNode(Node):
    operation: str = "to_native"

    @property
    def prefix(self) -> str:
        return self.operation

    @property
    def message(self) -> str:
        return {
            "to_native": "Convert to native DataFrame",
            "from_native": "Convert from native DataFrame",
            "collect": "Collect lazy frame into eager DataFrame",
            "to_lazy": "Convert eager DataFrame to lazy frame",
        }[self.operation]


@dataclass
class SequenceNode(Node):
    name: str | None = None
    steps: list[Node] = field(default_factory=list)

    @property
    def prefix(self) -> str:
        return f"seq_{self.name}" if self.name else "seq"

    @property
    def content(self) -> str:
        return f"seq:{self.name}" if self.name else "seq"

    def children(self) -> list[tuple[str, list[Node]]]:
        return [("", self.steps)]

    def count(self) -> int:
        """Transformers and functions below, storage steps not counted."""
        return sum(isinstance(n, (TransformerNode, FunctionNode)) for n in self.walk())


@dataclass
class ForkNode(Node):
    """split, branch or apply_to_rows: its branches by name, what the other side goes through, and how it ends."""

    kind_of_fork: str = "split"
    branches: dict[str, list[Node]] = field(default_factory=dict)
    otherwise: list[Node] | None = None
    split_function: Callable[..., Any] | None = None
    config: dict[str, Any] = field(default_factory=dict)
    end: str = "append"
    no_merge: frozenset[str] = frozenset()
    skip_if_empty: frozenset[str] = frozenset()
    merge: dict[str, Any] = field(default_factory=dict)

    @property
    def prefix(self) -> str:
        return f"fork_{self.kind_of_fork}"

    @property
    def content(self) -> str:
        name = getattr(self.split_function, "__name__", "")
        return f"fork:{self.kind_of_fork}:{name}:{parameters(self.config, 0)}:{sorted(self.branches)}"

    @property
    def kind(self) -> str:
        return f"fork:{self.kind_of_fork}"

    def children(self) -> list[tuple[str, list[Node]]]:
        out = [(f"branches.{k}", v) for k, v in self.branches.items()]
        return [*out, ("otherwise", self.otherwise)] if self.otherwise is not None else out

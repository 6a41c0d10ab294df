"""Pipelines as text and as Graphviz source."""

from __future__ import annotations

from weftline.plans.config import PipelineConfig
from weftline.plans.nodes import ConversionNode, ForkNode, FunctionNode, InputNode, Node, OutputNode, SequenceNode, StorageNode, TransformerNode, describe, parameters


def _counted(n: int) -> str:
    return f"{n} transformation{'' if n == 1 else 's'}"


def _below(nodes: list[Node]) -> int:
    return SequenceNode(steps=nodes).count()


class Printer:
    """Lines of a tree, indented by depth."""

    def __init__(self, *, show_params: bool = False, add_ids: bool = False, indent_size: int = 4, width: int | None = None):
        self.params, self.ids, self.indent = show_params, add_ids, indent_size
        self.width = PipelineConfig["max_param_length"] if width is None else width
        self.lines: list[str] = []

    def text(self, root: Node) -> str:
        self.lines = []
        self._visit(root, 0)
        return "\n".join(self.lines)

    def _add(self, depth: int, text: str, node: Node | None = None) -> None:
        self.lines.append(" " * (self.indent * depth) + text + (f" [{node.id}]" if self.ids and node else ""))

    def _visit(self, node: Node, depth: int) -> None:
        if isinstance(node, SequenceNode):
            self._add(depth, f"*** {node.name or 'Pipeline'} *** ({_counted(node.count())})", node)
            self._all(node.steps, depth if depth == 0 else depth + 1)
        elif isinstance(node, (TransformerNode, FunctionNode)):
            self._add(depth, f" - {node.name}{self._arguments(node)}", node)
            if node.description:
                self._add(depth, f"     Description: {node.description}")
        elif isinstance(node, (StorageNode, ConversionNode)):
            self._add(depth, f"   --> {node.message}", node)
        elif isinstance(node, ForkNode):
            self._fork(node, depth)

    def _all(self, nodes: list[Node], depth: int) -> None:
        for n in nodes:
            self._visit(n, depth)

    def _arguments(self, node: TransformerNode | FunctionNode) -> str:
        if not self.params:
            return ""
        if isinstance(node, TransformerNode):
            return f" -> PARAMS: {parameters(node.params, self.width)}" if node.params else ""
        parts = ([f"ARGS={list(node.args)}"] if node.args else []) + ([f"KWARGS={node.kwargs}"] if node.kwargs else [])
        return f" -> {', '.join(parts)}" if parts else ""

    def _fork(self, node: ForkNode, depth: int) -> None:
        self._add(depth, fork_title(node), node)
        if self.params and (shown := {k: v for k, v in {**node.config, **node.merge}.items() if v and k not in ("storage", "input_col", "operator", "value")}):
            self._add(depth, f"     PARAMS: {parameters(shown, self.width)}")
        for name, steps in node.branches.items():
            n = _counted(_below(steps))
            title = {"split": f"**SPLIT <<< {name} >>> ({n}):", "branch": f">> Branch ({n}):", "apply_to_rows": f">> Apply To rows ({n}):"}
            self._add(depth, title[node.kind_of_fork])
            self._all(steps, depth + 1)
        if node.otherwise is not None:
            self._add(depth, f">> Otherwise ({_counted(_below(node.otherwise))}):")
            self._all(node.otherwise, depth + 1)
        self._add(depth, {"append": "<<< Append DFs >>>", "join": "<<< Join DFs >>>", "dead-end": "<<< Dead End (no merge) >>>"}[node.end])


def fork_title(node: ForkNode) -> str:
    c = node.config
    if node.kind_of_fork == "split":
        return f"------ SPLIT ------ (function: {getattr(node.split_function, '__name__', 'function')})"
    if node.kind_of_fork == "branch":
        return f"------ BRANCH (from storage: {c['storage']}) ------" if "storage" in c else "------ BRANCH (from the primary DF) ------"
    value = c.get("comparison_column") if c.get("value") is None else describe(c["value"])
    return f"------ APPLY TO ROWS ({' '.join(str(x) for x in (c['input_col'], c['operator'], value) if x is not None)}) ------"


def dot(root: SequenceNode, *, show_params: bool = False, add_description: bool = False) -> str:
    """Graphviz source: boxes for steps, diamonds for forks, an edge from each step to the next."""
    lines = ["digraph pipeline {", '  node [shape=box, fontname="Helvetica"];']
    number = iter(range(10**9))
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'

    def add(label: str, shape: str, after: list[str], edge: str = "") -> str:
        name = f"n{next(number)}"
        lines.append(f"  {name} [label={quote(label)}, shape={shape}];")
        lines.extend(f"  {a} -> {name}" + (f" [label={quote(edge)}]" if edge else "") + ";" for a in after)
        return name

    def chain(nodes: list[Node], after: list[str], edge: str = "") -> list[str]:
        for n in nodes:
            after = visit(n, after, edge)
            edge = ""
        return after

    def visit(n: Node, after: list[str], edge: str) -> list[str]:
        if isinstance(n, SequenceNode):
            return chain(n.steps, after, edge)
        if isinstance(n, (InputNode, OutputNode)):
            return [add(n.name, "ellipse", after, edge)]
        if isinstance(n, (TransformerNode, FunctionNode)):
            label = n.name
            if show_params and isinstance(n, TransformerNode) and n.params:
                label += "\n" + parameters(n.params, PipelineConfig["max_param_length"])
            if add_description and n.description:
                label += "\n" + n.description
            return [add(label, "box", after, edge)]
        if isinstance(n, (StorageNode, ConversionNode)):
            return [add(n.message, "cylinder", after, edge)]
        fork = add(fork_title(n).strip("- "), "diamond", after, edge)
        ends = []
        for name, steps in n.branches.items():
            out = chain(steps, [fork], name)
            if name not in n.no_merge and n.end != "dead-end":
                ends += out
        ends += chain(n.otherwise, [fork], "otherwise") if n.otherwise else ([fork] if n.kind_of_fork != "split" else [])
        return [add({"append": "Append", "join": "Join", "dead-end": "Dead End"}[n.end], "diamond", ends)]

    visit(root, [], "")
    return "\n".join([*lines, "}"])

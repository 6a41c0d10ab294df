"""What watches a run."""

from __future__ import annotations

import logging
from typing import Any, Protocol

from weftline.plans.nodes import ConversionNode, ForkNode, FunctionNode, Node, SequenceNode, StorageNode, TransformerNode, parameters


class PipelineHooks(Protocol):
    """Called around a run and around each step; ``context`` holds the frame under ``df``."""

    def on_pipeline_start(self, root_node: Node, context: dict) -> None: ...
    def on_pipeline_end(self, root_node: Node, duration_ms: float, context: dict) -> None: ...
    def on_node_start(self, node: Node, context: dict) -> None: ...
    def on_node_end(self, node: Node, duration_ms: float, context: dict) -> None: ...
    def on_error(self, node: Node, error: Exception, context: dict) -> None: ...
    def on_checkpoint(self, node: Node, context: dict) -> None: ...
    def on_skip(self, node: Node, reason: str, context: dict) -> None: ...


class NoOpHooks:
    """Does nothing; a base for hooks that watch a few events. ``on_checkpoint`` is called after a frame is stored."""

    def on_pipeline_start(self, root_node: Node, context: dict) -> None:
        pass

    def on_pipeline_end(self, root_node: Node, duration_ms: float, context: dict) -> None:
        pass

    def on_node_start(self, node: Node, context: dict) -> None:
        pass

    def on_node_end(self, node: Node, duration_ms: float, context: dict) -> None:
        pass

    def on_error(self, node: Node, error: Exception, context: dict) -> None:
        pass

    def on_checkpoint(self, node: Node, context: dict) -> None:
        pass

    def on_skip(self, node: Node, reason: str, context: dict) -> None:
        pass


class LoggingHooks(NoOpHooks):
    """Logs each step."""

    def __init__(self, *, max_param_length: int = 80, show_params: bool = False, logger: logging.Logger | None = None):
        self._width, self._params = max_param_length, show_params
        self._log = logger or logging.getLogger("weftline.pipeline")

    def _name(self, node: Node) -> str:
        if isinstance(node, TransformerNode):
            return f"{node.name} -> PARAMS: {parameters(node.params, self._width)}" if self._params and node.params else node.name
        if isinstance(node, FunctionNode):
            return f"{node.name} -> ARGS={list(node.args)}, KWARGS={node.kwargs}" if self._params and (node.args or node.kwargs) else node.name
        if isinstance(node, (StorageNode, ConversionNode)):
            return node.message
        if isinstance(node, ForkNode):
            return f"fork: {node.kind_of_fork}"
        return node.name if isinstance(node, SequenceNode) and node.name else "pipeline"

    def on_pipeline_start(self, root_node: Node, context: dict) -> None:
        self._log.info("starting %s", self._name(root_node))

    def on_pipeline_end(self, root_node: Node, duration_ms: float, context: dict) -> None:
        self._log.info("completed %s in %.1f ms", self._name(root_node), duration_ms)

    def on_node_start(self, node: Node, context: dict) -> None:
        self._log.info("running %s", self._name(node))

    def on_node_end(self, node: Node, duration_ms: float, context: dict) -> None:
        self._log.info("done %s in %.1f ms", self._name(node), duration_ms)

    def on_error(self, node: Node, error: Exception, context: dict) -> None:
        self._log.error("failed %s: %s", self._name(node), error)

    def on_skip(self, node: Node, reason: str, context: dict) -> None:
        self._log.info("skipped %s: %s", self._name(node), reason)

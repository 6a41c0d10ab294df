"""From configurations, as YAML or JSON give them, to pipelines."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable
from typing import Any

from weftline import operators
from weftline.operators.base import LazyWrapper
from weftline.plans.builder import CONVERSIONS, STORAGE_KEYWORDS, is_keyword
from weftline.plans.loops import expand_loops
from weftline.plans.pipeline import TransformerPipeline
from weftline.sources.storage import Storage, storage

NS = "__ns__"
OPTIONS = {p.name for p in inspect.signature(TransformerPipeline.__init__).parameters.values() if p.kind is p.KEYWORD_ONLY} - {"store"}
RESERVED = OPTIONS | {"loop", "pipeline", "data", "transformer", "function", *STORAGE_KEYWORDS, *CONVERSIONS}
STEP_LISTS = ("interleaved", "split_apply_after_splitting", "split_apply_before_appending", "otherwise")


def _registry(extra: Any) -> dict[str, type]:
    """Transformers by name; the user's, the first of them first, before the built-in ones."""
    built_in = {n: getattr(operators, n) for n in operators.__all__ if n not in ("LazyWrapper", "Transformer", "append_dataframes", "is_lazy_reference", "join_dataframes", "resolve_lazy")}
    out = dict(built_in)
    if extra is None:
        return out
    for container in reversed(extra if isinstance(extra, (list, tuple)) else [extra]):
        found = container if isinstance(container, dict) else {n: getattr(container, n) for n in dir(container) if not n.startswith("_")}
        out.update({n: c for n, c in found.items() if isinstance(c, type) and callable(getattr(c, "transform", None))})
    return out


def _functions(extra: Any) -> dict[str, Callable]:
    """Functions by name, from one function, several of different names, or a dictionary."""
    if extra is None:
        return {}
    if isinstance(extra, dict):
        out = dict(extra)
    else:
        given = [extra] if callable(extra) else list(extra)
        names = [getattr(f, "__name__", None) for f in given]
        if len(set(names)) != len(names) or None in names:
            raise ValueError(f"functions need different names: {names}")
        out = dict(zip(names, given, strict=True))
    for name, f in out.items():
        if not isinstance(name, str) or not callable(f):
            raise TypeError(f"'{name}' is not a function by name")
    return out


class Loader:
    def __init__(self, functions: dict[str, Callable], transformers: dict[str, type], store: Storage):
        self.functions, self.transformers, self.store = functions, transformers, store

    def pipeline(self, o: dict[str, Any]) -> TransformerPipeline:
        if unknown := set(o) - OPTIONS - {"pipeline", "data"}:
            raise AssertionError(f"unknown keys of a pipeline: {sorted(unknown)}")
        body = o.get("pipeline", o.get("data"))
        options = {k: v for k, v in o.items() if k not in ("pipeline", "data")}
        if options.get("skip") or options.get("perform") is False:
            return TransformerPipeline([], name=options.get("name"), skip=options.get("skip"), perform=options.get("perform"), store=self.store)
        if options.get("split_function") is not None:
            options["split_function"] = self._function(options["split_function"])
            if not isinstance(body, dict):
                raise AssertionError("a split pipeline is a dictionary of splits")
            if bad := set(body) & RESERVED:
                raise AssertionError(f"splits cannot have reserved names: {sorted(bad)}")
            data: Any = {name: self.steps(s) for name, s in body.items()}
        else:
            data = self.steps(body)
        for name in STEP_LISTS:
            if options.get(name) is not None:
                options[name] = self.steps(options[name])
        return TransformerPipeline(data, **options, store=self.store)

    def steps(self, o: Any) -> list[Any]:
        if o is None:
            return []
        items = o if isinstance(o, (list, tuple)) else [o]
        return [s for s in (self.step(x) for x in items) if s is not None]

    def step(self, o: Any) -> Any:
        """A step, or None where it is skipped."""
        if o is None:
            return None
        if isinstance(o, (list, tuple)) and not callable(o):
            return self.steps(o)
        if is_keyword(o) or hasattr(o, "transform") or callable(o):
            return o
        if not isinstance(o, dict):
            raise TypeError(f"not a step of a configuration: {o!r}")
        for key, make in (("transformer", self._transformer), ("function", self._function_step), ("pipeline", self.pipeline)):
            if key in o:
                skip, perform = o.get("skip"), o.get("perform")
                if key != "pipeline" and skip is not None and perform is not None and bool(skip) == bool(perform):
                    raise ValueError(f"'skip' and 'perform' contradict each other: {o}")
                return None if key != "pipeline" and (skip or perform is False) else make(o)
        raise TypeError(f"not a step of a configuration: {o!r}")

    def _transformer(self, o: dict[str, Any]) -> Any:
        name, params = o["transformer"], dict(o.get("params") or {})
        if unknown := set(o) - {"transformer", "params", "lazy", "description", "skip", "perform"}:
            raise KeyError(f"unknown keys of a transformer: {sorted(unknown)}")
        if name not in self.transformers:
            raise NameError(f"unknown transformer '{name}'; known are {sorted(self.transformers)}")
        if o.get("lazy"):
            made: Any = LazyWrapper(self.transformers[name], **self._references(params))
        else:
            try:
                made = self.transformers[name](**params)
            except Exception as e:
                raise type(e)(f"{name}({params}): {e}") from e
        if o.get("description") is not None:
            return (made, o["description"])
        return made

    def _references(self, o: Any) -> Any:
        """Texts "__ns__key" as references to the storage."""
        if isinstance(o, str) and o.startswith(NS):
            return (self.store, o[len(NS) :])
        if isinstance(o, dict):
            return {k: self._references(v) for k, v in o.items()}
        if isinstance(o, (list, tuple)):
            return [self._references(x) for x in o]
        return o

    def _function(self, f: Any) -> Callable:
        if callable(f):
            return f
        if f not in self.functions:
            raise NameError(f"unknown function '{f}'; known are {sorted(self.functions)}")
        return self.functions[f]

    def _function_step(self, o: dict[str, Any]) -> Any:
        if unknown := set(o) - {"function", "args", "kwargs", "description", "skip", "perform"}:
            raise KeyError(f"unknown keys of a function: {sorted(unknown)}")
        args, kwargs = o.get("args"), o.get("kwargs")
        if args is not None and not isinstance(args, (list, tuple)):
            raise TypeError(f"args are a list: {args!r}")
        if kwargs is not None and not isinstance(kwargs, dict):
            raise TypeError(f"kwargs are a dictionary: {kwargs!r}")
        return (self._function(o["function"]), list(args or []), dict(kwargs or {}), o.get("description"))


def load_pipeline(
    o: dict[str, Any] | list | tuple,
    *,
    extra_functions: Callable | Iterable[Callable] | dict[str, Callable] | None = None,
    extra_transformers: Any = None,
    evaluate_loops: bool = True,
    store: Storage = storage,
) -> TransformerPipeline:
    """A pipeline from a parsed configuration: a dictionary with ``pipeline``, or a list of steps.

    ``extra_transformers`` is a dictionary of classes, a module or other container of them, or several of these; ``extra_functions`` are
    looked up by name wherever a configuration names a function.
    """
    if isinstance(o, (list, tuple)):
        o = {"pipeline": list(o)}
    if not isinstance(o, dict):
        raise TypeError(f"a configuration is a dictionary or a list, not {type(o).__name__}")
    if "pipeline" not in o:
        raise AssertionError("a configuration needs 'pipeline'")
    if evaluate_loops:
        o = expand_loops(o)
    return Loader(_functions(extra_functions), _registry(extra_transformers), store).pipeline(o)

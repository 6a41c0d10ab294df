"""Loops in configurations, expanded before anything is built."""

from __future__ import annotations

import re
from itertools import product
from typing import Any

PLACEHOLDER = re.compile(r"<<(\w+)>>")


def _values(loop: dict[str, Any]) -> list[dict[str, Any]]:
    """The values of each turn of a loop."""
    if "values" not in loop:
        raise KeyError("a loop needs 'values'")
    values, mode = loop["values"], loop.get("mode", "linear")
    if not isinstance(values, dict):
        raise TypeError("the values of a loop are a dictionary of lists")
    if not values:
        raise ValueError("a loop without values")
    for k, v in values.items():
        if not isinstance(v, (list, tuple)):
            raise TypeError(f"the values of '{k}' are a list")
        if not v:
            raise ValueError(f"'{k}' has no values")
    if not isinstance(mode, str):
        raise TypeError("the mode of a loop is a string")
    if mode not in ("linear", "product"):
        raise ValueError(f"the mode of a loop is 'linear' or 'product', not '{mode}'")
    if mode == "product":
        return [dict(zip(values, turn, strict=True)) for turn in product(*values.values())]
    if len({len(v) for v in values.values()}) > 1:
        raise ValueError(f"the lists of a linear loop differ in length: { {k: len(v) for k, v in values.items()} }")
    return [dict(zip(values, turn, strict=True)) for turn in zip(*values.values(), strict=True)]


def substitute(o: Any, values: dict[str, Any]) -> Any:
    """The object with placeholders replaced, in keys too. One that is a whole text keeps its value's type."""
    if isinstance(o, str):
        whole = PLACEHOLDER.fullmatch(o)
        if whole and whole[1] in values:
            return values[whole[1]]
        return PLACEHOLDER.sub(lambda m: str(values[m[1]]) if m[1] in values else m[0], o)
    if isinstance(o, dict):
        return {substitute(k, values): substitute(v, values) for k, v in o.items()}
    if isinstance(o, (list, tuple)):
        return type(o)(substitute(x, values) for x in o)
    return o


def _left_out(o: dict[str, Any]) -> bool:
    return bool(o.get("skip")) or o.get("perform") is False


def _expanded(o: Any) -> Any:
    """The object with its loops as lists, the innermost first, so that inner names win over outer ones."""
    if isinstance(o, (list, tuple)):
        out: list[Any] = []
        for x in o:
            if isinstance(x, dict) and "loop" in x:
                out += _turns(x)
            else:
                out.append(_expanded(x))
        return out
    if isinstance(o, dict):
        if "loop" in o:
            return _turns(o)
        return {k: _expanded(v) for k, v in o.items()}
    return o


def _turns(o: dict[str, Any]) -> list[Any]:
    if _left_out(o):
        return []
    loop = o["loop"]
    if not isinstance(loop, dict):
        raise TypeError("a loop is a dictionary")
    outer = {k: v for k, v in o.items() if k not in ("loop", "skip", "perform")}
    if _left_out(loop):
        return []
    body = {k: v for k, v in loop.items() if k not in ("values", "mode", "skip", "perform")} | outer
    turns = _values(loop)
    body = _expanded(body)
    out: list[Any] = []
    for values in turns:
        done = substitute(body, values)
        out += done if isinstance(done, list) else [done]
    return out


def expand_loops(config: dict[str, Any]) -> dict[str, Any]:
    """The configuration with loops in its ``pipeline`` expanded; a skipped loop leaves nothing behind."""
    return {k: _expanded(v) if k == "pipeline" else v for k, v in config.items()}

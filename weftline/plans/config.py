"""Settings of printing and logging."""

from __future__ import annotations

from typing import Any

_DEFAULTS = {"max_param_length": 80, "verbose": True, "show_params": False}


class _Config:
    """Known keys only, by attribute or by bracket; KeyError for others."""

    def __init__(self) -> None:
        object.__setattr__(self, "_values", dict(_DEFAULTS))

    def _known(self, key: str) -> str:
        if key not in self._values:
            raise KeyError(f"unknown setting '{key}'; known are {sorted(self._values)}")
        return key

    def __getitem__(self, key: str) -> Any:
        return self._values[self._known(key)]

    def __setitem__(self, key: str, value: Any) -> None:
        self._values[self._known(key)] = value

    def __getattr__(self, key: str) -> Any:
        if key.startswith("_"):
            raise AttributeError(key)
        return self[key]

    def __setattr__(self, key: str, value: Any) -> None:
        self[key] = value

    def reset(self) -> None:
        self._values.update(_DEFAULTS)

    def __repr__(self) -> str:
        return f"PipelineConfig({', '.join(f'{k}={v!r}' for k, v in sorted(self._values.items()))})"


PipelineConfig = _Config()

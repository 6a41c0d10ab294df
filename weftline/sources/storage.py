"""A registry of named frames and values that pipelines read and write. Frames stay lazy in it."""

from __future__ import annotations

import logging
from collections.abc import Hashable, Iterable
from typing import Any

log = logging.getLogger("weftline.storage")


class Storage:
    """Named objects. Overwriting is allowed unless switched off; debug objects are kept in debug mode only."""

    def __init__(self) -> None:
        self._objects: dict[Hashable, Any] = {}
        self._overwrite = True
        self._debug = False

    @property
    def is_overwriting_allowed(self) -> bool:
        return self._overwrite

    @property
    def is_debug_mode(self) -> bool:
        return self._debug

    def allow_overwriting(self) -> None:
        self._overwrite = True

    def disallow_overwriting(self) -> None:
        self._overwrite = False

    def allow_debug(self, active: bool) -> None:
        if not isinstance(active, bool):
            raise TypeError("debug mode is True or False")
        self._debug = active

    def set(self, key: Hashable, value: Any, *, debug: bool = False) -> None:
        """Keeps an object; with ``debug`` only while debug mode is on. KeyError for a known key where overwriting is off."""
        if not isinstance(key, Hashable):
            raise AssertionError(f"a key must be hashable: {key!r}")
        if debug and not self._debug:
            log.info("debug mode is off: %r is not stored", key)
            return
        if not self._overwrite and key in self._objects:
            raise KeyError(f"'{key}' is stored already and overwriting is off")
        self._objects[key] = value

    def get(self, key: Hashable) -> Any:
        return self._objects[key]

    def isin(self, key: Hashable) -> bool:
        return key in self._objects

    def list_keys(self) -> list:
        return sorted(self._objects)

    def count_objects(self) -> int:
        return len(self._objects)

    def clear(self, keys: str | Iterable | None = None) -> None:
        """Drops the keys given; all of them where ``keys`` is None, none where it is empty."""
        if keys is None:
            self._objects.clear()
            return
        for k in [keys] if isinstance(keys, str) else list(keys):
            self._objects.pop(k, None)

    def clear_except(self, keys: str | Iterable) -> None:
        """Drops all but the keys given."""
        if not isinstance(keys, (str, list, tuple, set, dict)):
            raise TypeError("keys to keep are a string or an iterable")
        keep = {keys} if isinstance(keys, str) else set(keys)
        self._objects = {k: v for k, v in self._objects.items() if k in keep}


#: The registry of pipelines that are not given one of their own.
storage = Storage()

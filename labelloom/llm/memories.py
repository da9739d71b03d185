"""What a Python worker remembers between tasks, for one purpose at a time."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_held: dict[Any, Any] = {}


def remembered(purpose: Any, make: Callable[[], Any]) -> Any:
    """This worker's memory for ``purpose``. Workers are reused; what they kept for another is dropped."""
    if purpose not in _held:
        _held.clear()
        _held[purpose] = make()
    return _held[purpose]

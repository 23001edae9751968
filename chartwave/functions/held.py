"""What a Python worker makes once and keeps: tasks import this module, so its table outlives them."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

#: The last thing made, by its key.
HELD: dict[str, Any] = {}


def held(key: str, make: Callable[[], Any]) -> Any:
    """make(), once for each key in each worker process; what an earlier key held is let go."""
    if key not in HELD:
        HELD.clear()
        HELD[key] = make()
    return HELD[key]

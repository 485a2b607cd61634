"""What a Python worker keeps from task to task."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.broadcast import Broadcast


def once(shared: Broadcast, make: Callable[[Any], Any]) -> Any:
    """``make`` of a broadcast value. A worker process keeps it beside the value for its later tasks, and drops it with the broadcast."""
    if not hasattr(shared, "_made"):
        shared._made = make(shared.value)
    return shared._made

"""What a Python worker keeps between tasks: the tables of one operator at a time.

Workers are reused from task to task and from stage to stage, and some stand idle for a while.  Tables that take long to build (a vocabulary, say)
stay for the next task of the same operator; the first task of another operator gives their memory back to the system.  What a task's
batches took goes back at its end.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa

_HELD: dict[str, Any] = {}


def enter(operator: str) -> None:
    """Say that a task of ``operator`` begins in this process."""
    if _HELD.get("operator") != operator:
        release()
        _HELD["operator"] = operator


def built(operator: str, key: str, make: Callable[[], Any]) -> Any:
    """``make()``, made once in this process while it works for ``operator``."""
    enter(operator)
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Forget all tables and return what is free to the system."""
    _HELD.clear()
    tidy()


def tidy() -> None:
    """Return what is free to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def tidied(work: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A task's function over its batches, which tidies up after the last one."""

    @functools.wraps(work)
    def run(*batches: Any) -> Iterator:
        try:
            yield from work(*batches)
        finally:
            tidy()

    return run

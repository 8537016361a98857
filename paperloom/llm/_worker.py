"""Memory of Python workers, which Spark uses again for the tasks of later stages."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable

import pyarrow as pa

_MEMOS: dict[str, dict] = {}


def memo(owner: str) -> dict:
    """What an operator keeps in this worker from one of its tasks to the next."""
    return _MEMOS.setdefault(owner, {})


def trim() -> None:
    """Hand memory that nothing uses back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def task(owner: str) -> Callable:
    """Decorates an operator's function over batches: memos of other operators are dropped before, free memory is handed back after."""

    def wrap(run):
        @functools.wraps(run)
        def whole(batches):
            for other in _MEMOS.keys() - {owner}:
                _MEMOS[other].clear()
            try:
                yield from run(batches)
            finally:
                trim()

        return whole

    return wrap

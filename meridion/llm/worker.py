"""Memory of Python workers, which Spark keeps from task to task and from stage to stage.

What an operator caches in a worker, and what the allocators keep of what was freed, counts for the executor as long as the
worker lives. ``lean`` work begins without the caches of operators that are over, and gives back what it freed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

_caches: list[dict] = []


def cache() -> dict:
    """A dict for an operator's caches in a worker; its owner must be able to fill it again."""
    _caches.append(own := {})
    return own


def drop_caches() -> None:
    for own in _caches:
        own.clear()


def trim() -> None:
    """Hand freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, without other operators' caches, its freed memory given back when the task ends."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        try:
            yield from run(batches)
        finally:
            trim()

    return work

"""Memory of Python workers, which live on for the tasks of other operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def handing_back(run: Run) -> Run:
    """``run`` for ``mapInArrow``; when a task's batches end, what was freed goes from the worker back to the system.

    Allocators keep freed memory for the next task, but that is often the JVM's: an idle worker would hold as much as
    its dearest task took.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library alone
                trim(0)

    return whole

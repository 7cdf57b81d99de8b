"""What Python workers hold between tasks: nothing that a finished task has used.

Workers are kept for later tasks. Memory that a task has freed stays with its process unless it is given back, so that
after some stages each worker would hold as much as its largest task needed.
"""

from __future__ import annotations

import ctypes

import pyarrow as pa


def give_back() -> None:
    """Return freed memory to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def tidy(function, forget=None):
    """For ``mapInArrow``: the same batches, and memory given back at the task's end, after a call of ``forget``."""

    def run(batches):
        yield from function(batches)
        if forget:
            forget()
        give_back()

    return run


def tidy_group(function):
    """For ``applyInArrow``: the same table, and memory given back after each group."""

    def run(table: pa.Table) -> pa.Table:
        out = function(table)
        give_back()
        return out

    return run

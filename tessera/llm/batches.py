"""Arrow batches in slices, so that a Python worker turns few texts at a time into objects."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa

#: Rows that are looked at together. A batch itself is bounded in bytes by ``spark.sql.execution.arrow.maxBytesPerBatch``.
ROWS = 512
#: glibc would raise this threshold by itself, and keep larger blocks.
MAPPED = 1 << 22


def slices(batches, rows: int = ROWS):
    """The batches in runs of at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """The UTF-8 bytes of a batch's texts."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def released(run):
    """The Arrow function ``run``, whose worker gives memory back as soon as it is unused: it waits idle for the next stage.

    Blocks of ``MAPPED`` bytes or more are mapped by themselves, and what a task has left behind is given back at its end.
    """

    def ended(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).mallopt(-3, MAPPED)  # M_MMAP_THRESHOLD
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return ended

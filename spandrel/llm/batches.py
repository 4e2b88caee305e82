"""Batches cut so that what is worked on at once is bounded in rows and bytes, however long single texts are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ROWS, BYTES = 2000, 8 << 20


class Growing:
    """An array that grows at its end; what it has is copied only when its room doubles."""

    def __init__(self, dtype: type) -> None:
        self.room, self.size = np.empty(1024, dtype), 0

    def extend(self, values: np.ndarray) -> None:
        if self.size + len(values) > len(self.room):
            room = np.empty(max(2 * len(self.room), self.size + len(values)), self.room.dtype)
            room[: self.size] = self.room[: self.size]
            self.room = room
        self.room[self.size : self.size + len(values)] = values
        self.size += len(values)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.room[: self.size][at]

    def __len__(self) -> int:
        return self.size


def slices(batch: pa.RecordBatch, text: int | str) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ROWS rows and about BYTES bytes in the column ``text``; a longer text is by itself."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = int(np.searchsorted(ends, before + BYTES, side="right"))
        stop = max(at + 1, min(stop, at + ROWS, batch.num_rows))
        yield batch.slice(at, stop - at)
        at = stop

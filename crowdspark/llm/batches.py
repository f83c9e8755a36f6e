"""Helpers for code that runs on Arrow batches inside tasks: slices and memories bounded by bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
MEMORY_BYTES = 48 << 20
ENTRY_BYTES = 200               # what a remembered item takes beside its own bytes, about


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in parts whose ``column`` holds about ``limit`` bytes at
    most; a longer value is a part of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        first, held = 0, 0
        for i, size in enumerate(sizes):
            if held + size > limit and i > first:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += size
        if first < len(sizes):
            yield batch.slice(first)


class Memory:
    """What a worker remembers of the items it has met (``known``), as many bytes of them as
    ``limit`` at a time: when new ones do not fit, the old ones go."""

    def __init__(self, limit: int = MEMORY_BYTES) -> None:
        self.known: dict = {}           # a plain dict: sets and maps look things up in it fastest
        self.limit, self.held = limit, 0

    def unknown(self, items: set) -> set:
        """The items not known; the caller puts them in."""
        new = items.difference(self.known)
        size = self._bytes(new)
        if self.held + size > self.limit:
            self.known.clear()
            self.held, new, size = 0, items, self._bytes(items)
        self.held += size
        return new

    def learn_one(self, item, value, size: int = 0) -> None:
        """One item, whose value takes ``size`` bytes more."""
        size += self._bytes([item])
        if self.held + size > self.limit:
            self.known.clear()
            self.held = 0
        self.held += size
        self.known[item] = value

    @staticmethod
    def _bytes(items) -> int:
        return sum(map(len, items)) * 2 + ENTRY_BYTES * len(items)

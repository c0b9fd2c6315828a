"""Arrow batches in small pieces, so that what Python makes of a batch does not grow with the table."""

from __future__ import annotations

from collections.abc import Iterator


def pieces(batches: Iterator, rows: int) -> Iterator:
    """Slices of at most so many rows of record batches or arrays; an empty one stays one.

    A table's batches grow with its partitions up to thousands of rows and tens of megabytes; made into Python's objects, one takes many times that.
    """
    for batch in batches:
        for at in range(0, max(len(batch), 1), rows):
            yield batch.slice(at, rows)

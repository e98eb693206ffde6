"""Arrow batches in bounded portions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

PORTION_BYTES = 2_000_000


def portions(texts: pa.Array, limit: int = PORTION_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have at most ``limit`` bytes together, or one row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    begin = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield begin, i
            begin, total = i, 0
        total += size + 16
    if begin < len(sizes):
        yield begin, len(sizes)


def in_portions(batches: Iterable[pa.RecordBatch], column: str,
                limit: int = PORTION_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut by the size of one text column."""
    for batch in batches:
        for begin, end in portions(batch.column(column), limit):
            yield batch.slice(begin, end - begin)


def texts_of(array: pa.Array) -> list[str | None]:
    return array.to_pylist()

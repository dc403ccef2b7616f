"""Parts of Arrow batches, by the size of their texts: a batch may hold texts of any length."""

from __future__ import annotations

from collections.abc import Iterator


def slices(batch, column: int, rows: int = 1024, size: int = 4_000_000) -> Iterator:
    """Parts of at most `rows` rows whose texts have at most `size` bytes together; a longer text is a part of its own."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(total[at - 1]) if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(total, before + size, side="right"))))
        yield batch.slice(at, end - at)
        at = end

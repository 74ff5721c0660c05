"""Helpers shared by the corpus operators: scratch storage and word patterns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

from seqloom.storage import checkpoint_dir, cut, stored

__all__ = ["WORD", "blocks", "checkpoint_dir", "cut", "stored"]

#: Words of the contracts: runs of anything but space, tab, \n, \v, \f, \r.
WORD = r"[^\x20\x09-\x0D]+"


def blocks(batches: Iterator[pa.RecordBatch], *names: str, rows: int = 256) -> Iterator[tuple[list, ...]]:
    """Columns of Arrow batches as Python values, a few rows at a time.

    Only a block's texts are ever held twice, however large the batch.
    """
    for batch in batches:
        columns = [batch.column(name) for name in names]
        for i in range(0, batch.num_rows, rows):
            yield tuple(c.slice(i, rows).to_pylist() for c in columns)

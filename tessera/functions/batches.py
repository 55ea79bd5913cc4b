"""Arrow batches in pieces, so that what a task holds does not follow the rows and the widths of its batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task takes apart at a time.
PIECE = 1 << 20


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in pieces of at most so many bytes of text and one row."""
    for b in batches:
        piece = np.cumsum(pc.binary_length(b.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // size
        cuts = np.r_[0, np.flatnonzero(np.diff(piece)) + 1, b.num_rows]
        for begin, end in zip(cuts, cuts[1:]):
            yield b.slice(int(begin), int(end - begin))

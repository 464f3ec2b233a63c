"""Runs of a batch's texts, so that what a task makes of them stays small whatever the batch holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of a run, about; a longer text is a run of its own.
LOT_CHARS = 1 << 20


def lots(batches: Iterator[pd.Series], chars: int = LOT_CHARS) -> Iterator[list[str]]:
    """The texts of all batches in their order, null ones empty, in runs of about ``chars`` characters."""
    for batch in batches:
        texts, low, size = batch.fillna("").tolist(), 0, 0
        for i, x in enumerate(texts):
            if size and size + len(x) > chars:
                yield texts[low:i]
                low, size = i, 0
            size += len(x)
        if low < len(texts):
            yield texts[low:]


def arrow_lots(batches: Iterator[pa.Array], chars: int = LOT_CHARS) -> Iterator[list[str]]:
    """As ``lots``, of Arrow batches: of a batch only a run's texts are Python strings at a time."""
    for batch in batches:
        ends, low = np.cumsum(pc.fill_null(pc.utf8_length(batch), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while low < len(batch):
            before = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + chars, side="right")))
            yield [x or "" for x in batch.slice(low, high - low).to_pylist()]
            low = high

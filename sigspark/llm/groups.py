"""Runs of equal keys in a sorted partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows) for each run of equal ``keys`` of a partition sorted by them; a run may span batches."""
    held: list[pa.RecordBatch] = []
    held_key: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)) for k in keys]
        change = np.zeros(b.num_rows - 1, bool)
        for c in cols:
            change |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, b.num_rows - 1)))
        cut = np.flatnonzero(change) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows], strict=True):
            key = tuple(c[lo].as_py() for c in cols)
            if key != held_key and held:
                yield held_key, pa.concat_batches(held)
                held = []
            held_key = key
            held.append(b.slice(lo, hi - lo))
    if held:
        yield held_key, pa.concat_batches(held)

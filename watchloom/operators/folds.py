"""Ordered folds: rows of a key in order, batch by batch, with the state carried from one batch to the next.

A task holds one Arrow batch and the states of one key, however many rows the key has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def runs(batch: pa.RecordBatch, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, one for each run of equal keys."""
    if not batch.num_rows:
        return
    new = np.zeros(batch.num_rows, dtype=bool)
    for k in keys:
        values = batch.column(k).to_numpy(zero_copy_only=False)
        new[1:] |= values[1:] != values[:-1]
    ends = [*np.flatnonzero(new).tolist(), batch.num_rows]
    at = 0
    for end in ends:
        yield batch.slice(at, end - at)
        at = end


def fold(rows: DataFrame, key: str, order: list[str], state: Callable[[], object], schema: str) -> DataFrame:
    """Folds each key's rows in order. state() makes an object with step(slice) and finish(), both of which return a dict of columns or None.

    Rows are dealt by key and sorted within partitions. A key's rows may come in several slices; finish() is called after the last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None

        def made(columns: dict | None) -> Iterator[pa.RecordBatch]:
            if columns and len(next(iter(columns.values()))):
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))

        for batch in batches:
            for part in runs(batch, [key]):
                this = part.column(key)[0].as_py()
                if now is None or this != last:
                    if now is not None:
                        yield from made(now.finish())
                    now, last = state(), this
                yield from made(now.step(part))
        if now is not None:
            yield from made(now.finish())

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)

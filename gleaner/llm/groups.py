"""Whole groups out of sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def edges_of(*columns: np.ndarray) -> np.ndarray:
    """Start of every run of equal rows, and the end."""
    rows = len(columns[0])
    new = np.ones(rows + 1, dtype=bool)
    if rows:
        new[1:-1] = False
        for column in columns:
            new[1:-1] |= column[1:] != column[:-1]
    else:
        new[:] = True
        return np.zeros(1, dtype=np.int64)
    return np.flatnonzero(new)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups, of about ``rows`` rows, from batches sorted by ``keys``.

    A group larger than ``rows`` comes as one table, so callers bound their groups first.
    """
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        cut = int(edges_of(*[table[k].to_numpy() for k in keys])[-2])
        if cut:
            yield table.slice(0, cut).combine_chunks()
            rest = table.slice(cut).combine_chunks()
            held, count = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[name].to_numpy() for name in names]

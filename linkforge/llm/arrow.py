"""Arrow helpers for the operators that run Python on batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


#: Bytes of an Arrow batch; a longer single text travels alone.
BATCH_BYTES = 8 << 20
_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """Keep Arrow batches small enough that long texts don't fill a Python worker."""
    conf = df.sparkSession.conf
    if int(re.sub(r"\D", "", conf.get(_CONF)) or 1 << 62) > BATCH_BYTES:
        conf.set(_CONF, str(BATCH_BYTES))
    return df


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with small batches, giving memory back at a task's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()

    return small_batches(df).mapInArrow(run, schema)


def map_texts(df: DataFrame, fn: Callable[[str], tuple], keep: list[str], text: str, schema: str, names: list[str], types: list[pa.DataType]) -> DataFrame:
    """Columns ``keep`` beside the columns ``names`` that ``fn`` gives for each row's whole text.

    A null text counts as empty. Rows are handled one at a time within an Arrow batch, so memory
    follows the batch and not the partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fn(t.as_py() or "") for t in batch.column(len(keep))]
            cols = [batch.column(i) for i in range(len(keep))]
            cols += [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[] for _ in names], types, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *names])

    return map_arrow(df.select(*keep, text), run, schema)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of at least ``rows`` rows that hold whole runs of equal keys of sorted input.

    Only a run that spans batches makes a table longer than ``rows`` and one batch.
    """
    kept: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(kept)
        cols = [table.column(k).to_numpy() for k in keys]
        change = np.zeros(n - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = np.flatnonzero(change)
        if not len(cuts):
            kept = table.combine_chunks().to_batches() if len(kept) > 8 else kept
            continue
        at = int(cuts[-1]) + 1
        yield table.slice(0, at)
        kept = table.slice(at).combine_chunks().to_batches()
        n = sum(b.num_rows for b in kept)
    if kept:
        yield pa.Table.from_batches(kept)


def forest(adjacent: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Spanning-forest edges of the graph whose packed adjacency rows (little bit order) are given."""
    width = adjacent.shape[1]
    todo = np.packbits(np.ones(n, np.uint8), bitorder="little")
    todo = np.concatenate([todo, np.zeros(width - len(todo), np.uint8)])
    edges: list[tuple[int, int]] = []
    some = np.flatnonzero(adjacent.any(axis=1))
    for start in some.tolist():
        if not todo[start >> 3] >> (start & 7) & 1:
            continue
        todo[start >> 3] &= 255 ^ (1 << (start & 7))
        queue = [start]
        while queue:
            at = queue.pop()
            fresh = adjacent[at] & todo
            if fresh.any():
                found = np.flatnonzero(np.unpackbits(fresh, count=n, bitorder="little"))
                todo &= ~fresh
                edges += [(at, x) for x in found.tolist()]
                queue += found.tolist()
    return edges

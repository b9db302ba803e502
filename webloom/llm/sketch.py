"""Counts over a whole corpus in a table of fixed size, whatever the corpus: each task counts its rows into an array, arrays are
added block by block in a shuffle, and the sums come back as logarithms, one byte a counter."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from webloom.operators.sized import shuffle_partitions

BLOCKS = 64


def level(counts: np.ndarray) -> np.ndarray:
    """Twice the binary logarithm, at most 63; 0 for a count of 0 or 1."""
    return np.minimum(np.log2(np.maximum(counts, 1)) * 2, 63).astype(np.uint8)


def counted(df: DataFrame, count: Callable[[Iterator[pa.RecordBatch], np.ndarray], None], cells: int, levels: Callable[[np.ndarray], np.ndarray] = level) -> np.ndarray:
    """``levels`` of the counters, block by block; ``count`` adds a task's batches to an array of ``cells`` counters.

    ``cells`` is a multiple of ``BLOCKS``.  A task's own count of one cell stops at 65535.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(cells, dtype=np.uint32)
        count(batches, counters)
        blocks = np.minimum(counters, 65535).astype(np.uint16).reshape(BLOCKS, -1)
        packed = [(i, zlib.compress(b.tobytes(), 1)) for i, b in enumerate(blocks) if b.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in packed], pa.int32()), pa.array([p for _, p in packed], pa.binary())], names=["block", "counters"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, np.empty(0)

        def done() -> pa.RecordBatch:
            packed = zlib.compress(levels(total).tobytes(), 1)
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([packed], pa.binary())], names=["block", "levels"])

        for batch in batches:
            for b, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != block:
                    if block is not None:
                        yield done()
                    block, total = b, np.zeros(cells // BLOCKS, dtype=np.int64)
                total += np.frombuffer(zlib.decompress(part), np.uint16)
        if block is not None:
            yield done()

    by_block = df.mapInArrow(parts, "block int, counters binary").repartition(min(BLOCKS, shuffle_partitions(df.sparkSession)), "block").sortWithinPartitions("block")
    out = np.zeros((BLOCKS, len(levels(np.zeros(cells // BLOCKS)))), dtype=np.uint8)
    for r in by_block.mapInArrow(summed, "block int, levels binary").collect():  # BLOCKS rows
        out[r.block] = np.frombuffer(zlib.decompress(r.levels), np.uint8)
    return out.ravel()

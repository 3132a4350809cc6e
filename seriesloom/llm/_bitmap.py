"""Bitmaps of fixed size over hashes, added up by a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmap(hashes: DataFrame, bits: int, spread: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """The set of the low ``bits`` bits of one column of hashes, eight places a byte as ``numpy.packbits`` has them.

    Each task gives the filled 64-bit words of its own bitmap, whatever the number of tasks; a grouped
    disjunction joins them, and at most ``2**bits / 64`` words reach the driver. ``spread`` hashes values first.
    """
    mask = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(1 << bits, bool)
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            out[((spread(at) if spread else at) & mask).astype(np.int64)] = True
        words = np.packbits(out, bitorder="little").view("<i8")
        filled = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(words[filled])], ["word", "bits"])

    found = hashes.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros((1 << bits) // 64, "<i8")
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return np.packbits(np.unpackbits(words.view(np.uint8), bitorder="little"))

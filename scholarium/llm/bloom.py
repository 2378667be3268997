"""A Bloom filter that tells keys hit once from keys hit more often, built on the executors.

Every task keeps two planes of bits (hit, hit again) and hands over the segments it touched. Segments of all tasks
are merged in parallel, and one plane of bounded size reaches the driver and goes out to the workers.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PROBES = 3
SEGMENT_BITS = 1 << 15
#: Bound of the filter that every worker holds: 32 MB.
MAX_BITS = 1 << 28
#: Tasks that build a filter; each holds two planes of it.
FILTER_TASKS = 256


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Filter:
    """A plane of bits; ``has`` may be wrong only where it says yes."""

    def __init__(self, n_bits: int, plane: np.ndarray | None = None):
        self.n_bits = n_bits
        self.plane = np.zeros(n_bits // 8, np.uint8) if plane is None else plane

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """One row of bit numbers per key (whole numbers of 64 bits)."""
        keys = keys.astype(np.uint64)
        with np.errstate(over="ignore"):
            steps = [_mix(keys + np.uint64((i + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)) for i in range(PROBES)]
        return np.stack(steps, axis=1) & np.uint64(self.n_bits - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        bits = self.bits(keys)
        return ((self.plane[(bits >> np.uint64(3)).astype(np.int64)] >> (bits & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def size_for(rows: int, max_bits: int = MAX_BITS) -> int:
    """16 bits for each row, up to the bound."""
    n_bits = SEGMENT_BITS
    while n_bits < min(16 * rows, max_bits):
        n_bits *= 2
    return n_bits


def build(keys: DataFrame, n_bits: int, twice: bool, keys_of=None) -> Filter:
    """The filter of the keys of ``keys``; with ``twice`` of those that two or more rows may share.

    ``keys_of`` gives a task's keys from a batch, as an array of whole numbers; by default the first column.
    """
    width = SEGMENT_BITS // 8
    keys_of = keys_of or (lambda batch: batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))

    def planes(batches):
        own = Filter(n_bits)
        once, again = own.plane, np.zeros(n_bits // 8, np.uint8)
        for batch in batches:
            found = keys_of(batch)
            if not len(found):
                continue
            bits, n = np.unique(own.bits(found), return_counts=True)
            at, mask = (bits >> np.uint64(3)).astype(np.int64), np.left_shift(1, bits & np.uint64(7)).astype(np.uint8)
            more = (n > 1) | ((once[at] & mask) > 0)
            np.bitwise_or.at(again, at[more], mask[more])
            np.bitwise_or.at(once, at, mask)
        for s in np.flatnonzero(once.reshape(-1, width).any(axis=1)).tolist():
            cut = slice(s * width, (s + 1) * width)
            yield pa.RecordBatch.from_arrays(
                [pa.array([s], pa.int64()), pa.array([zlib.compress(once[cut].tobytes(), 1)]),
                 pa.array([zlib.compress(again[cut].tobytes(), 1)])],
                names=["segment", "once", "again"],
            )

    def merge(group: pa.Table) -> pa.Table:
        once, again = np.zeros(width, np.uint8), np.zeros(width, np.uint8)
        for a, b in zip(group.column("once").to_pylist(), group.column("again").to_pylist(), strict=True):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
            again |= b | (once & a)
            once |= a
        bits = again if twice else once
        return pa.table({"segment": group.column("segment")[:1], "bits": pa.array([zlib.compress(bits.tobytes(), 1)])})

    merged = (
        keys.coalesce(FILTER_TASKS)
        .mapInArrow(planes, "segment long, once binary, again binary")
        .groupBy("segment")
        .applyInArrow(merge, "segment long, bits binary")
    )
    out = Filter(n_bits)
    for r in merged.collect():
        out.plane[r.segment * width : (r.segment + 1) * width] = np.frombuffer(zlib.decompress(r.bits), np.uint8)
    return out

"""Bounded selections that no single task has to make from all rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops


def least_hashes(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows: those of the least hashes of their keys. Rows of clearly greater hashes are dropped before they are sorted."""
    total = rows.count()
    if total > 2 * most:
        share = min(1.0, 1.5 * most / total)
        rows = rows.where(F.xxhash64(key) < int(-(1 << 63) + share * (1 << 64)))
    return rows.sort(F.xxhash64(key), key).limit(most)


def frequent(counts: DataFrame, most: int, n: str = "n") -> DataFrame:
    """The rows with the greatest counts, at most ``most``: all those from the least power of two on that leaves no more."""
    levels = {r.level: r.rows for r in counts.groupBy(F.floor(F.log2(n)).alias("level")).agg(F.count("*").alias("rows")).collect()}
    least, held = 64, 0
    for level in sorted(levels, reverse=True):
        held += levels[level]
        if held > most:
            break
        least = level
    return counts.where(F.floor(F.log2(n)) >= least)


#: Bits of a filter.
FILTER_BITS = 1 << 26


class BitFilter:
    """A set of 64-bit keys in a fixed number of bits: it has every key that was put in, and others too where it is full."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys.view(np.int64) & (64 * len(self.words) - 1)
        return ((self.words[at >> 6].view(np.uint64) >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def bit_filter(rows: DataFrame, key: str, bits: int | None = None) -> BitFilter:
    """A filter of the keys of the rows. Spark sets the bits; at most bits / 64 numbers reach the driver."""
    bits = bits or FILTER_BITS
    marks = rows.select(F.expr(f"{key} & {bits - 1}L").alias("at"))
    blocks = marks.groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    words = np.zeros(bits // 64, np.int64)
    found = blocks.toArrow()
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    del found
    textops.release()
    return BitFilter(words)

"""Bloom filters of 64-bit hashes, sized from their number and bounded; probed in Python batches or JVM-side.

A filter never loses a hash; what it lets through beside them is sorted out by an exact join behind it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each hash (three probes let 2 in 1000 others through), least and most bits of a filter (2^28 are 32 MB;
#: more than 11 million hashes let more others through).
PER_HASH, LEAST_BITS, MOST_BITS = 24, 16, 28
SHIFTS = (0, 18, 36)


def bits_for(n: int) -> int:
    """Binary logarithm of the bits of a filter for n hashes."""
    return min(MOST_BITS, max(LEAST_BITS, int(n * PER_HASH).bit_length()))


def build(hashes: DataFrame, h: str, bits: int) -> np.ndarray:
    """The filter's 64-bit words; gathered as at most 2^(bits - 6) rows, whatever the number of hashes."""
    mask = (1 << bits) - 1
    bit = F.explode(F.array(*[F.shiftrightunsigned(h, s).bitwiseAND(F.lit(mask)) for s in SHIFTS]))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").bitwiseAND(F.lit(63)).cast("int"))
    got = hashes.select(bit.alias("b")).select(F.shiftright("b", 6).alias("w"), one.alias("v")).groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got.column("w").to_numpy()] = got.column("v").to_numpy()
    return out.view(np.uint64)


def holds(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes (uint64) the filter may know."""
    mask, one = np.uint64(len(words) * 64 - 1), np.uint64(1)
    hit = np.ones(len(h), bool)
    for s in SHIFTS:
        at = (h >> np.uint64(s)) & mask
        hit &= ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & one).astype(bool)
    return hit


def keep(df: DataFrame, h: str, words: np.ndarray) -> DataFrame:
    """The rows of `df` whose hash in the column `h` the filter may know.

    The filter is a side of one row, broadcast, and the test the join's condition, so rows stay in the JVM and those
    that fail are dropped where they are read.
    """
    import pyarrow as pa

    mask = len(words) * 64 - 1
    row = df.sparkSession.createDataFrame(pa.table({"__words": pa.array([words.view(np.int64)], pa.list_(pa.int64()))}))
    test = F.lit(True)
    for s in SHIFTS:
        at = F.shiftrightunsigned(h, s).bitwiseAND(F.lit(mask))
        word = F.get("__words", F.shiftright(at, 6).cast("int"))
        test &= F.call_function("shiftrightunsigned", word, at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return df.join(F.broadcast(row), test).drop("__words")

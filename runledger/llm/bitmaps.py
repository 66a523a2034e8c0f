"""Fixed-size membership filters: what they let through is a superset, at any number of members."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A filter has 2**22 bits (half a megabyte) unless more are asked for, however many values are put in.
BITS = 1 << 22
#: No filter has more (16 megabytes).
MOST_BITS = 1 << 27


def bits_for(n: int) -> int:
    """About eight bits for each of ``n`` values, within the bounds."""
    return min(MOST_BITS, max(BITS, 1 << (8 * n).bit_length()))


def bitmap(df: DataFrame, column: str, size: int = BITS) -> np.ndarray:
    """A filter of the well-mixed longs in ``column`` with ``size`` bits, a power of two.  Bits are
    combined in Spark; the driver gets at most size / 32 words."""
    slots = df.select(F.col(column).bitwiseAND(size - 1).alias("s"))
    words = slots.groupBy(F.shiftright("s", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(s & 31)))").alias("v"))
    found = words.toArrow()
    bits = np.zeros(size >> 5, np.uint32)
    bits[found["w"].to_numpy()] = found["v"].to_numpy().astype(np.uint32)
    return bits


def maybe(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the values may be members."""
    slots = values.view(np.uint64) & np.uint64(len(bits) * 32 - 1)
    return (bits[(slots >> np.uint64(5)).astype(np.int64)] >> (slots & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1

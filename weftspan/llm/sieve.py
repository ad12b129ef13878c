"""A bitmap of bounded size that tells which keys need not be looked at.

A key that was put in always passes; others pass by chance. A sieve only saves
moving rows that a later join would drop, so its size never changes a result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 48
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 30


@dataclass
class Sieve:
    bits: np.ndarray  # packed, low bit first

    def passes(self, places: np.ndarray) -> np.ndarray:
        """Which of the non-negative ``places`` (any multiple of the size is
        taken off first) are set."""
        at = (places & np.asarray(len(self.bits) * 8 - 1, places.dtype)).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def sieve(keys: DataFrame, place: Column) -> Sieve:
    """Bitmap of ``place`` (a long, used modulo the size) over the rows of
    ``keys``: 48 bits a key or more, ``MOST_BITS`` (128 MB) at most."""
    n = keys.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (n * BITS_PER_KEY).bit_length()))
    at = F.pmod(place, F.lit(bits)) + 1  # Spark's bitmap functions count from 1
    parts = (
        keys.select(F.bitmap_bucket_number(at).alias("part"), F.bitmap_bit_position(at).alias("bit"))
        .groupBy("part").agg(F.bitmap_construct_agg("bit").alias("map")).collect()
    )
    held = np.zeros(bits // 8, np.uint8)
    for row in parts:
        begin = (row["part"] - 1) * 4096
        held[begin : begin + 4096] = np.frombuffer(row["map"], np.uint8)[: len(held) - begin]
    return Sieve(held)


def id_place(column: str) -> Column:
    """Place of a binary id: its first four bytes, big-endian."""
    return F.conv(F.hex(F.substring(column, 1, 4)), 16, 10).cast("long")

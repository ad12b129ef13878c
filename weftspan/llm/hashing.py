"""Vectorised 64-bit hashes of words and of runs of words or characters.

A run's hash is a polynomial in an odd multiplier modulo 2**64, taken from
prefix sums (the multiplier has an inverse), and then mixed. One numpy pass
hashes every word, or every n-gram, of a piece of text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Multipliers of the mixing function and of the polynomials.
MIX_A = 0xBF58476D1CE4E5B9
MIX_B = 0x94D049BB133111EB
BYTE_BASE = 0x9E3779B97F4A7C15
GRAM_BASE = 0xD1342543DE82EF95


def mix(values: np.ndarray) -> np.ndarray:
    """Bijective finaliser on unsigned 64-bit values."""
    v = values ^ (values >> np.uint64(30))
    v *= np.uint64(MIX_A)
    v ^= v >> np.uint64(27)
    v *= np.uint64(MIX_B)
    v ^= v >> np.uint64(31)
    return v


@lru_cache(maxsize=4)
def _powers(base: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << exponent
    inverse = pow(base, -1, 1 << 64)
    tables = []
    for b in (base, inverse):
        steps = np.full(size, b, np.uint64)
        steps[0] = 1
        tables.append(np.multiply.accumulate(steps))
    return tables[0], tables[1]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BYTE_BASE) -> np.ndarray:
    """Hash of ``values[s:e]`` for each pair of positions; values are uint64."""
    power, inverse = _powers(base, max(16, int(len(values)).bit_length()))
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum((values + np.uint64(1)) * power[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def byte_table(kind: str) -> np.ndarray:
    """Which bytes belong to words. ``spaced``: all but white space.
    ``plain``: ASCII letters and digits, and every byte of other characters."""
    table = np.ones(256, bool)
    if kind == "spaced":
        table[[0x20, *range(0x09, 0x0E)]] = False
    else:
        table[:128] = False
        for first, last in ("09", "AZ", "az"):
            table[ord(first) : ord(last) + 1] = True
    return table


class Words:
    """Words of several texts: document number, byte bounds, and hash of each."""

    def __init__(self, texts: list[bytes], table: np.ndarray):
        data = b" ".join(texts) + b" "
        self.data = data
        raw = np.frombuffer(data, np.uint8)
        inside = table[raw]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edges = np.concatenate([[0], edges])
        self.starts, self.ends = edges[0::2], edges[1::2]
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.begins = np.concatenate([[0], np.cumsum(lengths)])
        #: first word of each document, and one entry beyond the last
        self.first = np.searchsorted(self.starts, self.begins)
        self.hash = run_hashes(raw.astype(np.uint64), self.starts, self.ends)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Position of the first word, and hash, of every run of n words that
        lies within one document."""
        count = len(self.hash) - n + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.arange(count)
        at = at[self.doc[at] == self.doc[at + n - 1]]
        return at, run_hashes(self.hash, at, at + n, GRAM_BASE)


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)

"""The perfect binary Golay code (23, 12, 7), vectorised: which codewords lie near a 23-bit vector."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
LENGTH, PARITY = 23, 11
KEYS = 6


def _remainder(v: int) -> int:
    for i in range(LENGTH - 1, PARITY - 1, -1):
        if v >> i & 1:
            v ^= GENERATOR << (i - PARITY)
    return v


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and of the high 11 bits, and for each syndrome up to six error patterns:
    the coset leader (weight 3 at most) and, where that has weight 3, the five of weight 4."""
    unit = [_remainder(1 << i) for i in range(LENGTH)]

    def syndromes(bits: range) -> np.ndarray:
        out = np.zeros(1 << len(bits), dtype=np.int64)
        for j, i in enumerate(bits):
            out[1 << j : 2 << j] = out[: 1 << j] ^ unit[i]
        return out

    leader = np.full(1 << PARITY, -1, dtype=np.int64)
    for weight in range(4):
        for bits in combinations(range(LENGTH), weight):
            s = 0
            for i in bits:
                s ^= unit[i]
            leader[s] = sum(1 << i for i in bits)
    patterns = np.repeat(leader[:, None], KEYS, axis=1)
    for s in range(1 << PARITY):
        if int(leader[s]).bit_count() == 3:
            near = {int(leader[s ^ unit[i]]) ^ (1 << i) for i in range(LENGTH)} - {int(leader[s])}
            for j, p in enumerate(sorted(x for x in near if x.bit_count() == 4)):
                patterns[s, j + 1] = p
    return syndromes(range(12)), syndromes(range(12, LENGTH)), patterns


def near_codewords(v: np.ndarray) -> np.ndarray:
    """(n, 6) codeword indices (12 bits). Column 0: the codeword that v decodes to. The row as a set: what v
    and all vectors at distance 1 decode to, so vectors at distance 2 or less share one, and of two vectors
    at distance 1 or less each one's column 0 is in the other's row. Fewer than six repeat column 0."""
    low, high, patterns = _tables()
    s = low[v & 0xFFF] ^ high[v >> 12]
    return (v[:, None] ^ patterns[s]) >> PARITY

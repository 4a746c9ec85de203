"""XXH64 of many byte spans at once."""

from __future__ import annotations

import numpy as np

from dishlens.llm.arrays import MASK, U, lanes

#: Fixed values of XXH64.
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
P1, P2, P3, P4, P5 = (U(p) for p in PRIMES)


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << U(bits)) | (x >> U(64 - bits))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """The hash of the bytes of each span; as many steps as the longest span has lanes."""
    view = lanes(np.concatenate([data, np.zeros(8, np.uint8)]))
    at, left = starts.copy(), ends - starts
    h = np.full(len(starts), (seed + PRIMES[4]) % 2**64, U)
    long = np.flatnonzero(left >= 32)
    if len(long):
        acc = [np.full(len(long), (seed + x) % 2**64, U) for x in (PRIMES[0] + PRIMES[1], PRIMES[1], 0, -PRIMES[0])]
        more, n, place = np.arange(len(long)), left[long], at[long]
        while len(more):
            for k in range(4):
                acc[k][more] = _round(acc[k][more], view[place[more] + 8 * k])
            place[more] += 32
            n[more] -= 32
            more = more[n[more] >= 32]
        total = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
        for k in range(4):
            total = (total ^ _round(np.zeros(len(long), U), acc[k])) * P1 + P4
        h[long], at[long], left[long] = total, place, n
    h += (ends - starts).astype(U)
    while len(more := np.flatnonzero(left >= 8)):
        h[more] = _turn(h[more] ^ _round(np.zeros(len(more), U), view[at[more]]), 27) * P1 + P4
        at[more] += 8
        left[more] -= 8
    more = np.flatnonzero(left >= 4)
    h[more] = _turn(h[more] ^ ((view[at[more]] & MASK[4]) * P1), 23) * P2 + P3
    at[more] += 4
    left[more] -= 4
    while len(more := np.flatnonzero(left > 0)):
        h[more] = _turn(h[more] ^ ((view[at[more]] & MASK[1]) * P5), 11) * P1
        at[more] += 1
        left[more] -= 1
    h = (h ^ (h >> U(33))) * P2
    h = (h ^ (h >> U(29))) * P3
    return h ^ (h >> U(32))

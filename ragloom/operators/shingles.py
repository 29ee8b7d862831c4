"""What near duplicates need of one text, in numpy: the set of character n-grams, a MinHash signature, its band keys.

A signature has a value for each of some seeds: the least hash of the set under it. Two sets agree in one with the
probability of their Jaccard similarity. Values lie in groups of ``rows + 1``; a band is a group without one of its
values, so two sets share a band if they agree in all but one value of a group. ``plan`` takes as many groups as make the
chance of sharing none, at the least similarity asked for, less than MISS.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Chance that a pair of just the least similarity shares no band, and that its signatures are told apart.
MISS = 1e-9
#: Similarity that texts which aren't copies are taken to have at most; a wrong guess costs time only.
UNRELATED = 0.0015
#: Fixed white space of the data model, as code points: what the class SPACE of the text functions holds.
WHITE = (*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_WHITE = np.isin(np.arange(0x3002), WHITE)
_WHITE_BYTES = bytes(x for x in WHITE if x < 0x100)
_ODD, _SPREAD, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOW = (1 << 64) - 1
#: Seeds and shingles that a signature takes at once, so that they stay in the cache.
SEEDS, AT_ONCE = 8, 1 << 13


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h *= _SPREAD
    h ^= h >> np.uint64(27)
    h *= _LAST
    h ^= h >> np.uint64(31)
    return h


def _points(text: str) -> np.ndarray:
    """The code points of a text without white space."""
    try:
        points = np.frombuffer(text.encode("latin-1").translate(None, _WHITE_BYTES), np.uint8)
    except UnicodeEncodeError:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        points = points[~_WHITE[np.minimum(points, 0x3001)]]
    return points.astype(np.uint64)


def _rolled(points: np.ndarray, size: int) -> np.ndarray:
    """The polynomial hashes of all n-grams, put together from those of 1, 2, 4 and so on characters."""
    power, width, factor = points * _ODD, 1, _ODD
    h, done = None, 0
    while True:
        if size & width:
            # longer parts are taken later and stand before what there is
            h = power if h is None else power[: len(h) - width] * _raised(done) + h[width:]
            done += width
        if done == size:
            return h
        power = power[: len(power) - width] * factor + power[width:]
        width, factor = 2 * width, _raised(2 * width)


def _raised(times: int) -> np.uint64:
    return np.uint64(pow(int(_ODD), times, 1 << 64))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's n-grams of characters that aren't white space; none if it has fewer."""
    points = _points(text or "")
    if len(points) < size:
        return np.zeros(0, np.uint64)
    h = mixed(_rolled(points, size))
    h.sort()  # np.unique goes by a hash table, which takes several times as long
    fresh = np.empty(len(h), bool)
    fresh[0] = True
    np.not_equal(h[1:], h[:-1], out=fresh[1:])
    return h[fresh]


def _fold(h: int, values: list[int]) -> int:
    """``mixed`` of a running sum, in whole numbers: arrays of one are slow."""
    for x in values:
        h = (h + x) * int(_ODD) & _LOW
        h = (h ^ h >> 30) * int(_SPREAD) & _LOW
        h = (h ^ h >> 27) * int(_LAST) & _LOW
        h ^= h >> 31
    return h


def set_key(shingles: np.ndarray, lang: str | None) -> int:
    """A 64-bit hash of a set and its language, as a signed long."""
    own = int(np.bitwise_xor.reduce(mixed(shingles * _ODD))) if len(shingles) else 0
    h = _fold(0, [int(shingles.sum(dtype=np.uint64)), own, len(shingles), *map(ord, lang or "\0")])
    return h - (1 << 64) if h >> 63 else h


@dataclass(frozen=True)
class Plan:
    """How signatures are cut: ``groups`` of ``rows + 1`` values; similar sets agree in ``agree`` values or more."""

    rows: int
    groups: int
    agree: int

    @property
    def values(self) -> int:
        """Values of a signature."""
        return self.groups * (self.rows + 1)


def _below(n: int, p: float, k: int) -> float:
    """The chance of fewer than k of n events of chance p."""
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k))


def plan(least: float, documents: int) -> Plan:
    """The cheapest plan for pairs of similarity ``least`` among so many documents: unrelated ones seldom share a band."""
    for rows in range(3, 40):
        missed = _below(rows + 1, least, rows)
        groups = math.ceil(math.log(MISS) / math.log(max(missed, 1e-12)))
        if documents * groups * (rows + 1) * UNRELATED**rows <= 0.5:
            break
    values = groups * (rows + 1)
    agree = 0
    while _below(values, least, agree + 1) < MISS:
        agree += 1
    return Plan(rows, groups, agree)


def signature(shingles: np.ndarray, values: int, seed: int = 11) -> np.ndarray:
    """The least 32-bit hash of a set that isn't empty under each of ``values`` seeds."""
    flips, factors = _seeds(values, seed)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out, room = np.full(values, 0xFFFFFFFF, np.uint32), np.empty((SEEDS, min(AT_ONCE, len(x))), np.uint32)
    for start in range(0, len(x), AT_ONCE):
        own = x[start : start + AT_ONCE]
        for k in range(0, values, SEEDS):
            part = room[: min(SEEDS, values - k), : len(own)]
            np.bitwise_xor(own, flips[k : k + SEEDS], out=part)
            np.multiply(part, factors[k : k + SEEDS], out=part)
            np.minimum(out[k : k + SEEDS], np.minimum.reduce(part, axis=1), out=out[k : k + SEEDS])
    return out


@lru_cache(256)
def _seeds(values: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    keys = mixed(np.arange(1, 2 * values + 1, dtype=np.uint64) * _ODD + np.uint64(seed))
    flips, factors = (keys[:values] >> np.uint64(32)).astype(np.uint32), (keys[values:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return flips[:, None], factors[:, None]


@lru_cache(256)
def _numbers(cut: Plan, lang: str | None) -> np.ndarray:
    """What tells the bands of a signature apart, by place and language."""
    number = np.arange(cut.values, dtype=np.uint64).reshape(cut.groups, cut.rows + 1) + np.uint64(set_key(np.zeros(0, np.uint64), lang) & 0xFFFFFFFF) * np.uint64(cut.values)
    return mixed((number + np.uint64(1)) * _ODD)


def bands(sig: np.ndarray, cut: Plan, lang: str | None) -> np.ndarray:
    """The keys of a signature's bands, as signed longs: of each group all its values but one."""
    values = mixed((sig.astype(np.uint64) + np.uint64(1)) * _ODD).reshape(cut.groups, cut.rows + 1)
    # a sum of the values, each spread by its place, from which one is taken away at a time
    spread = mixed(values + np.arange(1, cut.rows + 2, dtype=np.uint64) * _LAST)
    rest = spread.sum(1, dtype=np.uint64)[:, None] - spread
    return mixed(rest ^ _numbers(cut, lang)).ravel().view(np.int64)

"""The matching-blocks similarity of two texts, fast on long ones.

Blocks are found as the ratio defines them: the longest common substring, earliest in the first text and then in the second among
equals, then the same to its left and to its right. On long parts the longest one is found by a binary search over rolling
hashes in numpy, on short ones by the standard library.
"""

from __future__ import annotations

import difflib
import math

import numpy as np

SHORT = 120
#: Characters of a run that is looked for near its own place: at a ratio of 0.92 over a quarter of the runs of 5 must be found, and few are between unrelated texts; those of 7 would bound nothing.
GRAM = 5
#: Classes of the counts of characters.
CLASSES = 128
_ORIGIN = np.uint64(1 << 30)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class _Hashes:
    """Rolling hashes of a text's code points; all of one length at once."""

    def __init__(self, codes: np.ndarray, up: np.ndarray, down: np.ndarray):
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        self.total = np.concatenate([[np.uint64(0)], np.cumsum(mixed * down[: len(codes)], dtype=np.uint64)])
        self.up = up

    def of(self, lo: int, hi: int, size: int) -> np.ndarray:
        return (self.total[lo + size : hi + 1] - self.total[lo : hi + 1 - size]) * self.up[lo : hi + 1 - size]


def _meet(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two arrays of hashes have one in common. The last bit says which array a hash is of, so that one sort shows neighbours of both."""
    one = np.uint64(1)
    both = np.concatenate([x & ~one, y | one])
    both.sort()
    return bool(((both[1:] ^ both[:-1]) == one).any())


def _longest(a: str, b: str, ha: _Hashes, hb: _Hashes, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    low, high, step = 0, min(ahi - alo, bhi - blo), 8
    while low < high:
        mid = min(step, high) if step else (low + high + 1) // 2
        step *= 4  # until a size fails
        if _meet(ha.of(alo, ahi, mid), hb.of(blo, bhi, mid)):
            low = mid
        else:
            high, step = mid - 1, 0
    if not low:
        return alo, blo, 0
    x, y = ha.of(alo, ahi, low), hb.of(blo, bhi, low)
    for i in np.flatnonzero(np.isin(x, y)).tolist():
        for j in np.flatnonzero(y == x[i]).tolist():
            if a[alo + i : alo + i + low] == b[blo + j : blo + j + low]:
                return alo + i, blo + j, low
    return alo, blo, 0


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def profile(text: str) -> np.ndarray:
    """Counts of the text's characters in ``CLASSES`` classes."""
    return np.bincount(_codes(text) % np.uint32(CLASSES), minlength=CLASSES)


def most_apart(total: int, least: float) -> float:
    """How far apart the profiles of two texts can be whose ratio is ``least``: as far as characters are in no block, at most (1 - ratio) x total."""
    return (1 - least) * total + 1e-6


def placed_runs(text: str) -> np.ndarray:
    """The text's runs of ``GRAM`` characters, sorted: hash and place."""
    c = _codes(text)
    n = len(c) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint32)
    for k in range(GRAM):
        h = (h ^ c[k : k + n]) * np.uint32(2654435761)
        h ^= h >> np.uint32(15)
    out = (h.astype(np.uint64) << np.uint64(32)) + _ORIGIN + np.arange(n, dtype=np.uint64)
    out.sort()
    return out


def may_reach(a: np.ndarray, b: np.ndarray, n: int, m: int, least: float) -> bool:
    """Whether texts of ``n`` and ``m`` characters with the placed runs ``a`` and ``b`` can have the ratio ``least``.

    Let u and v characters of them be in no block. A run of the first text stays whole unless it holds one of the u, which are in GRAM runs each, or one of the v stands
    between its characters, in GRAM - 1 runs; and what stays whole is moved by u to the left or by v to the right at most.
    """
    matched = math.ceil(least * (n + m) / 2 - 1e-6)
    u, v = n - matched, m - matched
    if u < 0 or v < 0:
        return False
    need = n - GRAM + 1 - GRAM * u - (GRAM - 1) * v
    if need <= 0:
        return True
    if not len(b):
        return False
    at = np.searchsorted(b, a - np.uint64(u))
    found = (at < len(b)) & (b[np.minimum(at, len(b) - 1)] <= a + np.uint64(v))
    return int(np.count_nonzero(found)) >= need


def ratio(a: str, b: str, least: float = 0.0) -> float:
    """2 M / (length of both), M the size of all matching blocks; 0 if a sound bound shows that it is under ``least``."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    if least and (2 * min(len(a), len(b)) < least * total - 1e-9 or np.abs(profile(a) - profile(b)).sum() > most_apart(total, least) or not may_reach(placed_runs(a), placed_runs(b), len(a), len(b), least)):
        return 0.0
    n = max(len(a), len(b)) + 1
    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]), dtype=np.uint64)
    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE, np.uint64)]), dtype=np.uint64)
    ha, hb = (_Hashes(_codes(t), up, down) for t in (a, b))
    matched, todo = 0, [(0, len(a), 0, len(b))]
    reach = min(len(a), len(b))  # what is matched plus all that the open parts could still match
    while todo:
        if 2 * reach < least * total - 1e-9:
            return 0.0
        alo, ahi, blo, bhi = todo.pop()
        if alo == ahi or blo == bhi:
            continue
        before = matched
        reach -= min(ahi - alo, bhi - blo)
        if min(ahi - alo, bhi - blo) <= SHORT:
            matched += sum(m.size for m in difflib.SequenceMatcher(None, a[alo:ahi], b[blo:bhi], autojunk=False).get_matching_blocks())
            reach += matched - before
            continue
        i, j, size = _longest(a, b, ha, hb, alo, ahi, blo, bhi)
        if size:
            matched += size
            reach += size + min(i - alo, j - blo) + min(ahi - i - size, bhi - j - size)
            todo += [(alo, i, blo, j), (i + size, ahi, j + size, bhi)]
    return 2 * matched / total

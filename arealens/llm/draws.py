"""Exact random draws for counts of any size, and keyed permutations of ranges."""

from __future__ import annotations

import math

import numpy as np

LIBRARY_LIMIT = 10**9 - 1  # of numpy's hypergeometric draws


def hypergeometric(rng: np.random.Generator, good: int, bad: int, taken: int) -> int:
    """How many of ``taken`` items drawn without replacement are good."""
    if good + bad <= LIBRARY_LIMIT:
        return int(rng.hypergeometric(good, bad, taken)) if taken and good + bad else 0
    low, high = max(0, taken - bad), min(good, taken)
    log_choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    mode = min(high, max(low, (taken + 1) * (good + 1) // (good + bad + 2)))
    up = down = math.exp(log_choose(good, mode) + log_choose(bad, taken - mode) - log_choose(good + bad, taken))
    left, above, below = rng.random() - up, mode, mode
    while left > 0 and (above < high or below > low):
        if above < high:
            up *= (good - above) * (taken - above) / ((above + 1) * (bad - taken + above + 1))
            above += 1
            left -= up
            if left <= 0:
                return above
        if below > low:
            down *= below * (bad - taken + below) / ((good - below + 1) * (taken - below + 1))
            below -= 1
            left -= down
            if left <= 0:
                return below
    return mode


def multivariate(rng: np.random.Generator, counts: np.ndarray, taken: int) -> np.ndarray:
    """How many of each colour are among ``taken`` items drawn without replacement."""
    out, rest = np.zeros(len(counts), np.int64), int(counts.sum())
    for i, c in enumerate(map(int, counts)):
        rest -= c
        out[i] = hypergeometric(rng, c, rest, taken)
        taken -= int(out[i])
    return out


def permuted(values: np.ndarray, size: int, key: int) -> np.ndarray:
    """Places of ``values`` under a permutation of range(size) fixed by ``key``: a four-round Feistel network, walked until inside."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(0, 2**63, 4, dtype=np.uint64)

    def rounds(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & mask)
        return (left << np.uint64(half)) | right

    x = rounds(values.astype(np.uint64))
    while (outside := x >= size).any():
        x[outside] = rounds(x[outside])
    return x.astype(np.int64)

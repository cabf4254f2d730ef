"""Seeded samples for columns: the same key and seed give the same sample on any partitioning."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloop.functions.distributions import Beta, Distribution, Gamma

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _uniforms(keys: np.ndarray, seed: int) -> Callable[[int], Callable[[], np.ndarray]]:
    """Streams of numbers between 0 and 1, for each key by itself: the k-th number is a mixed hash of (key, seed, stream, k)."""

    def stream(number: int) -> Callable[[], np.ndarray]:
        start = ((seed & 0xFFFFFFFF) + 1) * 0xD1B54A32D192ED03 + number * 0x8CB92BA72F3D8DD7
        state = keys.astype(np.int64).view(np.uint64) ^ np.uint64(start & 0xFFFFFFFFFFFFFFFF)

        def more() -> np.ndarray:
            nonlocal state
            state = state + _STEP
            z = (state ^ (state >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(31)
            return ((z >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)

        return more

    return stream


def _sampled(kind: Callable[[np.ndarray, np.ndarray], Distribution], seed: int, key: Column, *args: Column) -> Column:
    @F.pandas_udf("double")
    def sample(k: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(kind(a.to_numpy(float), b.to_numpy(float)).sample(_uniforms(k.to_numpy(np.int64), seed)))

    return sample(F.xxhash64(key), *(c.cast("double") for c in args))


def beta(key: Column, a: Column, b: Column, seed: int) -> Column:
    """A sample of Beta(a, b); NaN where neither is positive."""
    return _sampled(Beta, seed, key, a, b)


def gamma(key: Column, shape: Column, scale: Column, seed: int) -> Column:
    """A sample of Gamma(shape, scale); 0 for a shape that isn't positive."""
    return _sampled(Gamma, seed, key, shape, scale)


def uniform(key: Column, seed: int) -> Column:
    """A number from 0 to 1, by a hash; needs no Python."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) / F.lit(float(1 << 53))

"""Distributions of one variable: mean, density, samples and updates, over whole arrays or as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Number = float | np.ndarray
#: New numbers between 0 and 1 at each call, one for each place; and streams of them, by number.
Uniforms = Callable[[], np.ndarray]
Streams = Callable[[int], Uniforms]
_lgamma = np.vectorize(math.lgamma, otypes=[float])


class Distribution(Protocol):
    """What a distribution has to offer; parameters may be arrays, whose places are independent variables."""

    def mean(self) -> Number: ...

    def density(self, x: Number) -> Number: ...

    def sample(self, streams: Streams) -> np.ndarray: ...


def gamma_samples(shape: np.ndarray, uniforms: Uniforms) -> np.ndarray:
    """Gamma(shape, 1) of each place, by squeezing a normal variable; 0 where the shape isn't positive.

    A place takes three numbers a round until one is accepted, so its sample doesn't depend on other places.
    """
    shape = np.asarray(shape, float)
    low = shape < 1
    d = np.where(low, shape + 1, shape) - 1 / 3
    c = 1 / np.sqrt(9 * np.maximum(d, 1e-12))
    out, todo = np.zeros(len(shape)), shape > 0
    boost = np.where(low & todo, uniforms() ** (1 / np.where(todo, shape, 1.0)), 1.0)
    while todo.any():
        a, b, u = uniforms(), uniforms(), uniforms()
        x = np.sqrt(-2 * np.log(a)) * np.cos(2 * np.pi * b)
        v = (1 + c * x) ** 3
        ok = todo & (v > 0)
        ok &= np.log(u) < 0.5 * x * x + d - d * v + d * np.log(np.where(v > 0, v, 1.0))
        out[ok] = (d * v)[ok]
        todo &= ~ok
    return out * boost


@dataclass
class Beta:
    """Beta(a, b) of success counts: a success adds to a, a failure to b."""

    a: Number = 1.0
    b: Number = 1.0

    def mean(self) -> Number:
        return self.a / (self.a + self.b)

    def density(self, x: Number) -> Number:
        a, b, x = np.asarray(self.a, float), np.asarray(self.b, float), np.asarray(x, float)
        inside = (x > 0) & (x < 1)
        y = np.where(inside, x, 0.5)
        log = (a - 1) * np.log(y) + (b - 1) * np.log1p(-y) + _lgamma(a + b) - _lgamma(a) - _lgamma(b)
        return np.where(inside, np.exp(log), 0.0)

    def sample(self, streams: Streams) -> np.ndarray:
        x, y = gamma_samples(np.atleast_1d(np.asarray(self.a, float)), streams(0)), gamma_samples(np.atleast_1d(np.asarray(self.b, float)), streams(1))
        return np.divide(x, x + y, out=np.full(len(x), np.nan), where=x + y > 0)

    def update(self, successes: Number, failures: Number) -> Beta:
        return Beta(self.a + successes, self.b + failures)


@dataclass
class Gamma:
    """Gamma(shape, scale); all of it at 0 for a shape that isn't positive."""

    shape: Number = 1.0
    scale: Number = 1.0

    def mean(self) -> Number:
        return np.maximum(self.shape, 0) * self.scale

    def density(self, x: Number) -> Number:
        k, s, x = np.asarray(self.shape, float), np.asarray(self.scale, float), np.asarray(x, float)
        inside = (x > 0) & (k > 0)
        y, k = np.where(inside, x, 1.0), np.where(k > 0, k, 1.0)
        return np.where(inside, np.exp((k - 1) * np.log(y) - y / s - _lgamma(k) - k * np.log(s)), 0.0)

    def sample(self, streams: Streams) -> np.ndarray:
        return gamma_samples(np.atleast_1d(np.asarray(self.shape, float)), streams(0)) * self.scale

    def update(self, count: Number, total: Number) -> Gamma:
        """After `count` values of a Poisson variable that add up to `total`."""
        return Gamma(self.shape + total, self.scale / (1 + count * self.scale))


def beta_mean(a: Column, b: Column) -> Column:
    """The mean of Beta(a, b); null where both are 0."""
    return a / F.nullif(a + b, F.lit(0.0))


def gamma_mean(shape: Column, scale: Column) -> Column:
    return F.greatest(shape, F.lit(0.0)) * scale

"""Matrix factorisation policies: periodically refitted factors, and interactive probabilistic factors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from feedloop.policies.base import Policy
from feedloop.policies.neighbours import Preferences

Triples = tuple[np.ndarray, np.ndarray, np.ndarray]


def _by(codes: np.ndarray, n: int) -> list[np.ndarray]:
    """Places of each code's entries."""
    order = np.argsort(codes, kind="stable")
    return np.split(order, np.searchsorted(codes[order], np.arange(1, n)))


def implicit_als(x: Triples, shape: tuple[int, int], k: int, rng: np.random.Generator, alpha: float = 1.0, reg: float = 0.1, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Weighted least squares of implicit feedback: preference 1 with confidence 1 + alpha x value, else 0 with 1."""
    u, i, v = x
    p, q = rng.normal(0, 0.1, (shape[0], k)), rng.normal(0, 0.1, (shape[1], k))
    for _ in range(rounds):
        for mine, other, rows, columns in ((p, q, u, i), (q, p, i, u)):
            gram = other.T @ other + reg * np.eye(k)
            for code, at in enumerate(_by(rows, len(mine))):
                if len(at):
                    y, c = other[columns[at]], alpha * v[at]
                    mine[code] = np.linalg.solve(gram + (y * c[:, None]).T @ y, y.T @ (1 + c))
                else:
                    mine[code] = 0
    return p, q


def coordinate_als(x: Triples, shape: tuple[int, int], k: int, rng: np.random.Generator, alpha: float = 1.0, reg: float = 0.1, rounds: int = 10, use_zeroes: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The same objective, one factor at a time: the missing entries enter through k artificial examples from an
    eigendecomposition, so no k x k system is solved for a row."""
    u, i, v = x
    p, q = rng.normal(0, 0.1, (shape[0], k)), rng.normal(0, 0.1, (shape[1], k))
    for _ in range(rounds):
        for mine, other, rows, columns in ((p, q, u, i), (q, p, i, u)):
            values, vectors = np.linalg.eigh(other.T @ other)
            basis = vectors.T * np.sqrt(np.maximum(values, 0))[:, None] * use_zeroes  # else missing entries don't count
            for code, at in enumerate(_by(rows, len(mine))):
                y, c = other[columns[at]], alpha * v[at]
                w = mine[code]
                # Seen entries ask for 1 with confidence 1 + c; the basis already holds them with target 0 and weight 1.
                miss, zero = (1 + c) / np.where(c > 0, c, 1) - y @ w, -(basis @ w)
                for f in range(k):
                    a, z = y[:, f], basis[:, f]
                    miss += a * w[f]
                    zero += z * w[f]
                    w[f] = (c * a @ miss + z @ zero) / (c * a @ a + z @ z + reg)
                    miss -= a * w[f]
                    zero -= z * w[f]
    return p, q


def weighted_error(x: Triples, p: np.ndarray, q: np.ndarray, alpha: float) -> float:
    """Mean confidence-weighted squared error over the seen entries."""
    u, i, v = x
    c = 1 + alpha * v
    return float((c * (1 - (p[u] * q[i]).sum(axis=1)) ** 2).sum() / c.sum())


def plsa(x: Triples, shape: tuple[int, int], k: int, rng: np.random.Generator, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Latent classes by expectation maximisation: p(i | u) = sum of p(z | u) p(i | z)."""
    u, i, v = x
    p, q = rng.dirichlet(np.ones(k), shape[0]), rng.dirichlet(np.ones(shape[1]), k).T
    for _ in range(rounds):
        share = p[u] * q[i]
        share *= (v / np.maximum(share.sum(axis=1), 1e-12))[:, None]
        p, q = np.full(p.shape, 1e-9), np.full(q.shape, 1e-9)
        np.add.at(p, u, share)
        np.add.at(q, i, share)
        p /= p.sum(axis=1, keepdims=True)
        q /= q.sum(axis=0, keepdims=True)
    return p, q


FACTORISERS: dict[str, Callable] = {"imf": implicit_als, "fastimf": coordinate_als, "plsa": plsa}
#: Positive values between refits, by merge variant.
LIMITS = {"basic": 100, "best": 0, "last": 0, "additive": 0}


class Factorised(Policy):
    """Inner products of factors that are fitted anew when enough positive values have come in."""

    def __init__(self, *args, k: int = 10, factorizer: str = "imf", variant: str = "basic", limit: int | None = None, **kw) -> None:
        own = {n: kw.pop(n) for n in ("alpha", "reg", "rounds", "use_zeroes") if n in kw}
        super().__init__(*args, **kw)
        self.k, self.fit, self.own = k, FACTORISERS[factorizer], own
        self.data, self.limit, self.since = Preferences(variant), LIMITS[variant] if limit is None else limit, 0
        self.p = self.q = None

    def scores(self, user: int, items: np.ndarray) -> np.ndarray:
        return self.rng.random(len(items)) if self.p is None else self.q[items] @ self.p[user]

    def learn(self, user: int, item: int, value: float) -> None:
        old, new = self.data.put(user, item, value)
        self.since += new > 0 and new != old
        if self.since > self.limit or (self.p is None and self.limit == 0 and new > 0):
            x = [(u, i, v) for u, row in self.data.rows.items() for i, v in row.items() if v > 0]
            u, i, v = (np.array(c) for c in zip(*x, strict=True))
            self.p, self.q = self.fit((u, i, v.astype(float)), (self.n_users, self.n_items), self.k, self.rng, **self.own)
            self.since = 0


class ProbabilisticFactors(Policy):
    """Item factors are fixed between refreshes; a user's factors are a ridge regression on them, kept as A and b."""

    def __init__(self, *args, k: int = 10, stdev: float = 0.5, stdev_p: float = 1.0, stdev_q: float = 1.0, lambda_p: float | None = None, lambda_q: float | None = None, rounds: int = 5, **kw) -> None:
        super().__init__(*args, **kw)
        self.k, self.stdev, self.rounds = k, stdev, rounds
        self.reg_p = stdev_p / stdev if lambda_p is None else lambda_p
        self.reg_q = stdev_q / stdev if lambda_q is None else lambda_q
        self.q = np.sqrt(1 / k) + self.rng.random((self.n_items, k))
        self.a = np.tile(self.reg_p * np.eye(k), (self.n_users, 1, 1))
        self.b = np.zeros((self.n_users, k))
        self.log: list[tuple[int, int, float]] = []

    def user(self, user: int) -> tuple[np.ndarray, np.ndarray]:
        """Mean and covariance of the user's factors."""
        inverse = np.linalg.inv(self.a[user])
        return inverse @ self.b[user], inverse * self.stdev

    def scores(self, user: int, items: np.ndarray) -> np.ndarray:
        return self.q[items] @ self.user(user)[0]

    def learn(self, user: int, item: int, value: float) -> None:
        q = self.q[item]
        self.a[user] += np.outer(q, q)
        self.b[user] += value * q
        self.log.append((user, item, value))

    def refit(self) -> None:
        """Item factors by alternating ridge regressions on all values so far, then the users' again."""
        if not self.log:
            return
        u, i, v = (np.array(c) for c in zip(*self.log, strict=True))
        for _ in range(self.rounds):
            self.a = np.tile(self.reg_p * np.eye(self.k), (self.n_users, 1, 1))
            self.b = np.zeros((self.n_users, self.k))
            np.add.at(self.a, u, self.q[i][:, :, None] * self.q[i][:, None, :])
            np.add.at(self.b, u, v[:, None] * self.q[i])
            p = np.linalg.solve(self.a, self.b[:, :, None])[:, :, 0]
            for code, at in enumerate(_by(i, self.n_items)):
                if len(at):
                    x = p[u[at]]
                    self.q[code] = np.linalg.solve(x.T @ x + self.reg_q * np.eye(self.k), x.T @ v[at])

    def warm_up(self, users: np.ndarray, items: np.ndarray, values: np.ndarray) -> None:
        super().warm_up(users, items, values)
        self.refit()


class EpsilonFactors(ProbabilisticFactors):
    """Random with probability epsilon; with a refresh, item factors are refitted every so many positive values."""

    def __init__(self, *args, epsilon: float = 0.1, refresh: int = 0, **kw) -> None:
        super().__init__(*args, **kw)
        self.epsilon, self.refresh, self.positives = epsilon, refresh, 0

    def pick(self, user: int, items: np.ndarray) -> int:
        if len(items) > 1 and self.rng.random() < self.epsilon:
            return int(self.rng.choice(items))
        return super().pick(user, items)

    def rank(self, user: int, items: np.ndarray, k: int) -> list[int]:
        return self.one_by_one(user, items, k)

    def learn(self, user: int, item: int, value: float) -> None:
        super().learn(user, item, value)
        self.positives += value > 0
        if self.refresh and value > 0 and self.positives % self.refresh == 0:
            self.refit()


class LinearBound(ProbabilisticFactors):
    def __init__(self, *args, alpha: float = 1.0, **kw) -> None:
        super().__init__(*args, **kw)
        self.alpha = alpha

    def spread(self, cov: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.einsum("ik,kl,il->i", q, cov, q)

    def scores(self, user: int, items: np.ndarray) -> np.ndarray:
        mean, cov = self.user(user)
        q = self.q[items]
        return q @ mean + self.alpha * np.sqrt(self.spread(cov, q))


class GeneralisedBound(LinearBound):
    """Sigmoid of the inner product, and a bound that grows with log log of the user's feedback; undefined while that
    is small, which ranks lowest."""

    def __init__(self, *args, **kw) -> None:
        super().__init__(*args, **kw)
        self.times = np.zeros(self.n_users)

    def scores(self, user: int, items: np.ndarray) -> np.ndarray:
        mean, cov = self.user(user)
        q = self.q[items]
        with np.errstate(divide="ignore", invalid="ignore"):
            return 1 / (1 + np.exp(-q @ mean)) + self.alpha * np.sqrt(np.log(np.log(self.times[user])) * self.spread(cov, q))

    def learn(self, user: int, item: int, value: float) -> None:
        super().learn(user, item, value)
        self.times[user] += 1


class ThompsonFactors(ProbabilisticFactors):
    """User and item factors are sampled from their normal posteriors; an update uses the item's last sample."""

    def __init__(self, *args, **kw) -> None:
        super().__init__(*args, **kw)
        self.item_a = np.tile(self.reg_q * np.eye(self.k), (self.n_items, 1, 1))
        self.item_b = self.q * self.reg_q
        # Each item's posterior mean and a root of its covariance; only that of a learnt item changes.
        self.mean, self.root = np.empty((self.n_items, self.k)), np.empty((self.n_items, self.k, self.k))
        self._posterior(np.arange(self.n_items))
        self.sampled: tuple[np.ndarray, np.ndarray] = np.zeros(0, int), np.zeros((0, self.k))

    def _posterior(self, items: np.ndarray) -> None:
        inverse = np.linalg.inv(self.item_a[items])
        values, vectors = np.linalg.eigh(inverse * self.stdev)
        self.mean[items] = np.einsum("nkl,nl->nk", inverse, self.item_b[items])
        self.root[items] = vectors * np.sqrt(np.maximum(values, 0))[:, None, :]

    def _draw(self, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh(cov)
        return mean + vectors @ (np.sqrt(np.maximum(values, 0)) * self.rng.standard_normal(self.k))

    def scores(self, user: int, items: np.ndarray) -> np.ndarray:
        self.p = self._draw(*self.user(user))
        noise = self.rng.standard_normal((len(items), self.k))
        q = self.mean[items] + np.einsum("nkl,nl->nk", self.root[items], noise)
        self.sampled = items, q
        return q @ self.p

    def learn(self, user: int, item: int, value: float) -> None:
        at = np.flatnonzero(self.sampled[0] == item)
        q = self.sampled[1][at[0]] if len(at) else self.q[item]
        self.a[user] += np.outer(q, q)
        self.b[user] += value * q
        p = self.user(user)[0]
        self.item_a[item] += np.outer(p, p)
        self.item_b[item] += value * p
        self._posterior(np.array([item]))
        self.log.append((user, item, value))

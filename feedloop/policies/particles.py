"""Particle policies: factor models and topic models of which several samples are kept, weighed and resampled."""

from __future__ import annotations

import copy

import numpy as np

from feedloop.policies.base import Policy


class FactorParticle:
    """User and item factors with Gaussian posteriors, of which one sample each is in use. The users' precision is
    given, or drawn from a Gamma distribution and updated (the Bayesian form)."""

    def __init__(self, n_users: int, n_items: int, k: int, rng: np.random.Generator, stdev: float, lambda_p: float, lambda_q: float, gamma: tuple[float, float] | None = None) -> None:
        self.k, self.rng, self.stdev, self.gamma = k, rng, stdev, gamma
        self.shape, self.rate = gamma or (0.0, 0.0)
        self.lambda_p = rng.gamma(self.shape) / self.rate if gamma else lambda_p
        self.lambda_q = lambda_q
        self.p = rng.normal(0, 1 / np.sqrt(self.lambda_p), (n_users, k))
        self.q = rng.normal(0, 1 / np.sqrt(lambda_q), (n_items, k))
        self.user_a, self.user_b = {}, {}
        self.item_a, self.item_b = {}, {}

    def _posterior(self, a: dict, b: dict, code: int, prior: float) -> tuple[np.ndarray, np.ndarray]:
        precision = a.get(code, 0) / self.stdev**2 + prior * np.eye(self.k)
        cov = np.linalg.inv(precision)
        return cov @ b.get(code, np.zeros(self.k)) / self.stdev**2, cov

    def score(self, user: int, items: np.ndarray) -> np.ndarray:
        return self.q[items] @ self.p[user]

    def weight(self, user: int, item: int, value: float) -> float:
        """Density of the value, with the user's factors integrated out."""
        mean, cov = self._posterior(self.user_a, self.user_b, user, self.lambda_p)
        q = self.q[item]
        var = self.stdev**2 + q @ cov @ q
        return float(np.exp(-((value - q @ mean) ** 2) / (2 * var)) / np.sqrt(2 * np.pi * var))

    def _draw(self, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
        return mean + np.linalg.cholesky(cov + 1e-12 * np.eye(self.k)) @ self.rng.standard_normal(self.k)

    def update(self, user: int, item: int, value: float) -> None:
        q = self.q[item]
        self.user_a[user] = self.user_a.get(user, 0) + np.outer(q, q)
        self.user_b[user] = self.user_b.get(user, 0) + value * q
        self.p[user] = self._draw(*self._posterior(self.user_a, self.user_b, user, self.lambda_p))
        if self.gamma:
            self.shape += self.k / 2
            self.rate += float(self.p[user] @ self.p[user]) / 2
            self.lambda_p = self.rng.gamma(self.shape) / self.rate
        p = self.p[user]
        self.item_a[item] = self.item_a.get(item, 0) + np.outer(p, p)
        self.item_b[item] = self.item_b.get(item, 0) + value * p
        self.q[item] = self._draw(*self._posterior(self.item_a, self.item_b, item, self.lambda_q))

    def clone(self) -> FactorParticle:
        out = copy.copy(self)
        for name in ("p", "q"):
            setattr(out, name, getattr(self, name).copy())
        for name in ("user_a", "user_b", "item_a", "item_b"):  # their arrays are replaced, never changed
            setattr(out, name, dict(getattr(self, name)))
        return out


class TopicParticle:
    """Each user is a mixture of topics, each topic a distribution over items, and an item's reward is normal around
    the product of the user's mixture and the item's regression weights."""

    def __init__(self, n_users: int, n_items: int, k: int, rng: np.random.Generator, alpha: float = 1.0, eta: float = 0.1, stdev: float = 0.5) -> None:
        self.k, self.rng, self.stdev = k, rng, stdev
        self.users = np.full((n_users, k), float(alpha))
        self.topics = np.full((k, n_items), float(eta))
        self.totals = self.topics.sum(axis=1)
        self.precision: dict[int, np.ndarray] = {}
        self.moment: dict[int, np.ndarray] = {}
        self.noise: dict[int, tuple[float, float]] = {}
        self.q = rng.normal(0, 0.1, (n_items, k))
        self.theta = rng.dirichlet(np.full(k, float(alpha)), n_users)

    def score(self, user: int, items: np.ndarray) -> np.ndarray:
        return self.q[items] @ self.theta[user]

    def _item(self, item: int) -> tuple[np.ndarray, np.ndarray]:
        cov = np.linalg.inv(self.precision.get(item, np.zeros((self.k, self.k))) + np.eye(self.k))
        return cov @ self.moment.get(item, np.zeros(self.k)), cov

    def _topic_odds(self, user: int, item: int, value: float) -> np.ndarray:
        fit = np.exp(-((value - self.q[item]) ** 2) / (2 * self.stdev**2)) + 1e-12
        return self.users[user] * self.topics[:, item] / self.totals * fit

    def weight(self, user: int, item: int, value: float) -> float:
        share = self.users[user] / self.users[user].sum()
        return float((share * self._topic_odds(user, item, value) / self.users[user]).sum())

    def update(self, user: int, item: int, value: float) -> None:
        theta = self.theta[user]
        self.precision[item] = self.precision.get(item, 0) + np.outer(theta, theta)
        self.moment[item] = self.moment.get(item, 0) + value * theta
        shape, scale = self.noise.get(item, (2.0, 1.0))
        self.noise[item] = (shape + 0.5, scale + 0.5 * float((value - self.q[item] @ theta) ** 2))
        # Inverse-gamma noise, normal weights, a topic for the event, a Dirichlet mixture for the user.
        variance = self.noise[item][1] / self.rng.gamma(self.noise[item][0])
        mean, cov = self._item(item)
        self.q[item] = mean + np.linalg.cholesky(cov * variance + 1e-12 * np.eye(self.k)) @ self.rng.standard_normal(self.k)
        odds = self._topic_odds(user, item, value)
        topic = int(self.rng.choice(self.k, p=odds / odds.sum()))
        if value > 0:
            self.users[user, topic] += value
            self.topics[topic, item] += value
            self.totals[topic] += value
        self.theta[user] = self.rng.dirichlet(self.users[user])

    def clone(self) -> TopicParticle:
        out = copy.copy(self)
        for name in ("users", "topics", "totals", "q", "theta"):
            setattr(out, name, getattr(self, name).copy())
        for name in ("precision", "moment", "noise"):
            setattr(out, name, dict(getattr(self, name)))
        return out


class Particles(Policy):
    """One particle, drawn at random, scores; an update weighs all by the value's likelihood, resamples, and updates."""

    def __init__(self, *args, particles: int = 5, **kw) -> None:
        own = {n: kw.pop(n) for n in list(kw) if n not in ("ignore_unknown", "ties")}
        super().__init__(*args, **kw)
        self.particles = [self.make(own) for _ in range(particles)]

    def make(self, own: dict) -> FactorParticle | TopicParticle:
        raise NotImplementedError

    def scores(self, user: int, items: np.ndarray) -> np.ndarray:
        return self.particles[self.rng.integers(len(self.particles))].score(user, items)

    def learn(self, user: int, item: int, value: float) -> None:
        w = np.array([p.weight(user, item, value) for p in self.particles])
        total = w.sum()
        share = w / total if total > 0 else np.full(len(w), 1 / len(w))
        drawn = self.rng.choice(len(w), len(w), p=share)
        used: set[int] = set()
        chosen = []
        for k in drawn.tolist():  # the first copy of a particle can stay itself
            chosen.append(self.particles[k].clone() if k in used else self.particles[k])
            used.add(k)
        self.particles = chosen
        for p in self.particles:
            p.update(user, item, value)


class ParticleFactors(Particles):
    def make(self, own: dict) -> FactorParticle:
        return FactorParticle(self.n_users, self.n_items, own.get("k", 5), self.rng, own.get("stdev", 0.5), own.get("lambda_p", 1.0), own.get("lambda_q", 1.0))


class BayesianParticleFactors(Particles):
    def make(self, own: dict) -> FactorParticle:
        gamma = (own.get("alpha", 2.0), own.get("beta", 0.5))
        return FactorParticle(self.n_users, self.n_items, own.get("k", 5), self.rng, own.get("stdev", 0.5), 1.0, 1 / own.get("sigma_q", 1.0) ** 2, gamma)


class TopicRegression(Particles):
    """The mean over particles, plus gamma times their standard deviation if that isn't 0."""

    def __init__(self, *args, gamma: float = 0.0, **kw) -> None:
        super().__init__(*args, **kw)
        self.gamma = gamma

    def make(self, own: dict) -> TopicParticle:
        return TopicParticle(self.n_users, self.n_items, own.get("k", 5), self.rng, own.get("alpha", 1.0), own.get("eta", 0.1), own.get("stdev", 0.5))

    def scores(self, user: int, items: np.ndarray) -> np.ndarray:
        all_ = np.array([p.score(user, items) for p in self.particles])
        return all_.mean(axis=0) + self.gamma * all_.std(axis=0)

"""Bandits over items, and the diversity policy that weighs raters by their information."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from feedloop.policies.base import Average, Policy


#: (old value, what was seen, how often so far, alpha) -> new value.
Step = Callable[[float, float, float, float], float]


class EpsilonGreedy(Policy):
    """With probability epsilon a random candidate, else the best by a value that is updated in one of four ways, or by a function."""

    def __init__(self, *args, epsilon: float = 0.1, step: str | Step = "stationary", alpha: float = 0.1, **kw) -> None:
        super().__init__(*args, **kw)
        if not callable(step) and step not in ("stationary", "nonStationary", "useAll", "count"):
            raise ValueError(f"no such update function: {step}")
        self.epsilon, self.step, self.alpha = epsilon, step, alpha
        self.n, self.value, self.total = np.zeros(self.n_items), np.zeros(self.n_items), 0.0

    def chance(self) -> float:
        return self.epsilon

    def pick(self, user: int, items: np.ndarray) -> int:
        if len(items) > 1 and self.rng.random() < self.chance():
            return int(self.rng.choice(items))
        return super().pick(user, items)

    def rank(self, user: int, items: np.ndarray, k: int) -> list[int]:
        return self.one_by_one(user, items, k)

    def scores(self, user: int, items: np.ndarray) -> np.ndarray:
        return self.value[items]

    def learn(self, user: int, item: int, value: float) -> None:
        old = self.value[item]
        self.n[item] += 1
        if callable(self.step):
            new = self.step(old, value, self.n[item], self.alpha)
        elif self.step == "stationary":
            new = old + (value - old) / self.n[item]
        elif self.step == "nonStationary":
            new = old + self.alpha * (value - old)
        elif self.step == "count":
            new = old + value
        else:  # all values so far share the weight; 0/0 is undefined while nothing but zeros was seen
            weight = self.total + value
            new = (old * self.total + value) / weight if weight else np.nan
        self.total += np.nan_to_num(new) - np.nan_to_num(old)
        self.value[item] = new


class EpsilonTGreedy(EpsilonGreedy):
    """Explores less with time: epsilon = min(1, alpha x items / iteration)."""

    def __init__(self, *args, decay: float = 1.0, **kw) -> None:
        super().__init__(*args, **kw)
        self.decay, self.t = decay, 1

    def chance(self) -> float:
        return min(1.0, self.decay * self.n_items / self.t)

    def learn(self, user: int, item: int, value: float) -> None:
        super().learn(user, item, value)
        self.t += 1


class UCB1(Average):
    def scores(self, user: int, items: np.ndarray) -> np.ndarray:
        n = self.n[items]
        with np.errstate(divide="ignore", invalid="ignore"):
            bound = np.sqrt(2 * np.log(self.n.sum() + 1) / n)
        return np.where(n > 0, self.mean[items] + bound, np.inf)


class UCB1Tuned(Average):
    def __init__(self, *args, **kw) -> None:
        super().__init__(*args, **kw)
        self.squares = np.zeros(self.n_items)

    def scores(self, user: int, items: np.ndarray) -> np.ndarray:
        n, m, log = self.n[items], self.mean[items], np.log(self.n.sum() + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            spread = self.squares[items] - m * m + np.sqrt(2 * log / n)
            bound = np.sqrt(log / n * np.minimum(0.25, spread))
        return np.where(n > 0, m + bound, np.inf)

    def learn(self, user: int, item: int, value: float) -> None:
        before = value - self.mean[item]
        super().learn(user, item, value)
        self.squares[item] += before * (value - self.mean[item])


class Thompson(Policy):
    """Samples each candidate's success rate from its Beta posterior."""

    def __init__(self, *args, alpha: float = 1.0, beta: float = 1.0, **kw) -> None:
        super().__init__(*args, **kw)
        self.a, self.b = np.full(self.n_items, float(alpha)), np.full(self.n_items, float(beta))

    def scores(self, user: int, items: np.ndarray) -> np.ndarray:
        return self.rng.beta(np.maximum(self.a[items], 1e-9), np.maximum(self.b[items], 1e-9))

    def learn(self, user: int, item: int, value: float) -> None:
        self.a[item] += value
        self.b[item] += 1 - value


class DelayedThompson(Thompson):
    """Keeps a sample for `delay` looks, or until its arm is updated."""

    def __init__(self, *args, delay: int = 10, **kw) -> None:
        super().__init__(*args, **kw)
        self.delay, self.left, self.sample = delay, np.zeros(self.n_items, int), np.zeros(self.n_items)

    def scores(self, user: int, items: np.ndarray) -> np.ndarray:
        due = items[self.left[items] <= 0]
        if len(due):
            self.sample[due] = super().scores(user, due)
            self.left[due] = self.delay
        self.left[items] -= 1
        return self.sample[items]

    def learn(self, user: int, item: int, value: float) -> None:
        super().learn(user, item, value)
        self.left[item] = 0


class Roulette(Policy):
    """Draws a candidate with probability in proportion to a weight."""

    def weights(self, items: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def pick(self, user: int, items: np.ndarray) -> int:
        if not len(items):
            return -1
        w = self.weights(items)
        total = w.sum()
        if total <= 0:
            return int(self.rng.choice(items))
        return int(items[min(np.searchsorted(np.cumsum(w), self.rng.random() * total, "right"), len(items) - 1)])

    def rank(self, user: int, items: np.ndarray, k: int) -> list[int]:
        return self.one_by_one(user, items, k)


class CategoricalPopularity(Roulette):
    def __init__(self, *args, alpha: float = 1.0, **kw) -> None:
        super().__init__(*args, **kw)
        self.sum = np.full(self.n_items, float(alpha))

    def weights(self, items: np.ndarray) -> np.ndarray:
        return self.sum[items]

    def learn(self, user: int, item: int, value: float) -> None:
        self.sum[item] += value


class CategoricalAverage(Roulette):
    def __init__(self, *args, alpha: float = 1.0, beta: float = 1.0, **kw) -> None:
        super().__init__(*args, **kw)
        self.hits, self.misses = np.full(self.n_items, float(alpha)), np.full(self.n_items, float(beta))

    def weights(self, items: np.ndarray) -> np.ndarray:
        return self.hits[items] / (self.hits[items] + self.misses[items])

    def learn(self, user: int, item: int, value: float) -> None:
        self.hits[item] += value
        self.misses[item] += 1 - value


class InformationDiversity(Policy):
    """An item's score adds up, over its relevant raters, how surprising a relevant rating of theirs is: users who find
    few things relevant weigh more. log(feedback of the user) - log(relevant feedback of the user)."""

    def __init__(self, *args, threshold: float = 0.5, **kw) -> None:
        super().__init__(*args, **kw)
        self.threshold = threshold
        self.feedback, self.relevant = np.zeros(self.n_users), np.zeros(self.n_users)
        self.liked: list[set[int]] = [set() for _ in range(self.n_users)]
        self.score = np.zeros(self.n_items)

    def _weight(self, user: int) -> float:
        return float(np.log(self.feedback[user]) - np.log(self.relevant[user])) if self.relevant[user] else 0.0

    def scores(self, user: int, items: np.ndarray) -> np.ndarray:
        return self.score[items]

    def learn(self, user: int, item: int, value: float) -> None:
        old = self._weight(user)
        self.feedback[user] += 1
        if value >= self.threshold:
            self.relevant[user] += 1
            self.liked[user].add(item)
            self.score[item] += old
        self.score[list(self.liked[user])] += self._weight(user) - old

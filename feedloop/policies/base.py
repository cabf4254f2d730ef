"""Stateful policies of the feedback loop, used inside one task per run.

A policy scores the candidates of a user and learns from the value that is revealed. State is NumPy arrays over codes
``0 .. n-1``. Everything random comes from the run's generator, so a run is a function of its seed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: What counts as a missing rating's value for policies that don't ignore it.
UNRATED = 0.0


#: (user, items, their scores, how often each was learnt) -> the scores that decide.
ValueFunction = Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


class Policy:
    def __init__(
        self, n_users: int, n_items: int, rng: np.random.Generator, ignore_unknown: bool = True, ties: str = "random", value_function: ValueFunction | None = None
    ) -> None:
        self.n_users, self.n_items, self.rng = n_users, n_items, rng
        self.ignore_unknown, self.ties = ignore_unknown, ties
        self.value_function = value_function
        self.chosen = None if value_function is None else np.zeros(n_items)

    def scores(self, user: int, items: np.ndarray) -> np.ndarray:
        """A score for each candidate; the highest is recommended. NaN counts as lowest."""
        raise NotImplementedError

    def learn(self, user: int, item: int, value: float) -> None:
        """Takes in one value; a missing one has been dealt with."""

    def update(self, user: int, item: int, value: float) -> None:
        if np.isnan(value):
            if self.ignore_unknown:
                return
            value = UNRATED
        if self.value_function is not None:
            self.chosen[item] += 1
        self.learn(user, item, float(value))

    def warm_up(self, users: np.ndarray, items: np.ndarray, values: np.ndarray) -> None:
        for u, i, v in zip(users.tolist(), items.tolist(), values.tolist(), strict=True):
            self.update(u, i, v)

    def _decide(self, user: int, items: np.ndarray) -> np.ndarray:
        s = self.scores(user, items)
        if self.value_function is not None:
            s = self.value_function(user, items, s, self.chosen[items])
        return np.where(np.isnan(s), -np.inf, s)

    def pick(self, user: int, items: np.ndarray) -> int:
        """The recommended item; -1 without candidates."""
        if len(items) < 2:
            return int(items[0]) if len(items) else -1
        s = self._decide(user, items)
        if self.ties == "id":  # rounded, so that equal scores are equal in whatever order they were added up
            return int(items[(s := np.round(s, 9)) == s.max()].min())
        best = items[s == s.max()]
        return int(best[0] if len(best) == 1 else self.rng.choice(best))

    def rank(self, user: int, items: np.ndarray, k: int) -> list[int]:
        """The k best, by score downwards; equal scores in the candidates' order."""
        s = self._decide(user, items)
        return items[np.argsort(-s, kind="stable")[:k]].tolist()

    def one_by_one(self, user: int, items: np.ndarray, k: int) -> list[int]:
        """A ranking for policies that decide anew at each place."""
        out: list[int] = []
        while len(items) and len(out) < k:
            out.append(self.pick(user, items))
            items = items[items != out[-1]]
        return out


class Random(Policy):
    def scores(self, user: int, items: np.ndarray) -> np.ndarray:
        return self.rng.random(len(items))


class Popularity(Policy):
    def __init__(self, *args, threshold: float = 0.5, **kw) -> None:
        super().__init__(*args, **kw)
        self.threshold, self.count = threshold, np.zeros(self.n_items)

    def scores(self, user: int, items: np.ndarray) -> np.ndarray:
        return self.count[items]

    def learn(self, user: int, item: int, value: float) -> None:
        self.count[item] += value >= self.threshold


class Average(Policy):
    def __init__(self, *args, **kw) -> None:
        super().__init__(*args, **kw)
        self.n, self.mean = np.zeros(self.n_items), np.zeros(self.n_items)

    def scores(self, user: int, items: np.ndarray) -> np.ndarray:
        return self.mean[items]

    def learn(self, user: int, item: int, value: float) -> None:
        self.n[item] += 1
        self.mean[item] += (value - self.mean[item]) / self.n[item]

"""The closed feedback loop of one run: choose a user, recommend, reveal, learn."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from math import ceil

import numpy as np

from feedloop.policies.base import Policy


class Lookup:
    """Values by pair of codes, in two sorted arrays; of a repeated pair, the last value."""

    def __init__(self, users: np.ndarray, items: np.ndarray, values: np.ndarray, n_items: int) -> None:
        pairs = np.asarray(users, np.int64) * n_items + items
        if len(pairs) > 1 and not (pairs[1:] > pairs[:-1]).all():
            order = np.argsort(pairs, kind="stable")
            pairs, values = pairs[order], np.asarray(values)[order]
            last = np.r_[pairs[1:] != pairs[:-1], True]
            pairs, values = pairs[last], values[last]
        self.pairs, self.values, self.n_items = pairs, values, n_items

    def get(self, pair: tuple[int, int], default: float | None = None) -> float | None:
        code = pair[0] * self.n_items + pair[1]
        k = int(self.pairs.searchsorted(code))
        return float(self.values[k]) if k < len(self.pairs) and self.pairs[k] == code else default

    def __contains__(self, pair: tuple[int, int]) -> bool:
        return self.get(pair) is not None

    def __getitem__(self, pair: tuple[int, int]) -> float:
        if (found := self.get(pair)) is None:
            raise KeyError(pair)
        return found


@dataclass
class Ratings:
    """What a simulation knows and hides: values by pair, over codes 0 .. n-1."""

    users: np.ndarray
    items: np.ndarray
    values: np.ndarray
    n_users: int
    n_items: int
    known: np.ndarray | None = None
    threshold: float = 0.5
    at: Lookup = field(init=False)

    def __post_init__(self) -> None:
        self.at = Lookup(self.users, self.items, self.values, self.n_items)

    def relevant(self) -> int:
        return int((self.values >= self.threshold).sum())

    def view(self, use: str) -> Ratings:
        """The known, unknown or all ratings."""
        if use == "all" or self.known is None:
            return self
        keep = self.known if use == "known" else ~self.known
        return Ratings(self.users[keep], self.items[keep], self.values[keep], self.n_users, self.n_items, None, self.threshold)


# --- Which user is next -----------------------------------------------------------------------------------------------
class RandomUsers:
    def __init__(self, users: np.ndarray, rng: np.random.Generator) -> None:
        self.left, self.rng = users.tolist(), rng

    def next(self) -> int:
        return self.left[int(self.rng.integers(len(self.left)))]

    def drop(self, user: int) -> None:
        k = bisect_left(self.left, user)  # users come sorted; an own order is searched from the start
        self.left.pop(k if k < len(self.left) and self.left[k] == user else self.left.index(user))


class RoundRobin(RandomUsers):
    """Users in turn; with shuffle, in a new order for each lap."""

    def __init__(self, users: np.ndarray, rng: np.random.Generator, shuffle: bool = False) -> None:
        super().__init__(users, rng)
        self.shuffle, self.k = shuffle, 0
        if shuffle:
            rng.shuffle(self.left)

    def next(self) -> int:
        if self.k >= len(self.left):
            self.k = 0
            if self.shuffle:
                self.rng.shuffle(self.left)
        self.k += 1
        return self.left[self.k - 1]

    def drop(self, user: int) -> None:
        k = self.left.index(user)
        self.left.pop(k)
        self.k -= k < self.k


USERS: dict[str, Callable] = {"random": RandomUsers, "round-robin": RoundRobin, "random-round-robin": lambda u, r: RoundRobin(u, r, True)}


# --- What can be recommended ------------------------------------------------------------------------------------------
class Available:
    """Each pair once; users without ratings, or with nothing left, aren't chosen. contact: never oneself, and a pair's
    reverse is gone with it where edges go both ways."""

    def __init__(self, data: Ratings, rng: np.random.Generator, users: str = "random", contact: bool = False, both_ways: bool = False) -> None:
        self.data, self.both_ways = data, both_ways
        self.seen: dict[int, np.ndarray] = {}
        self.chooser = (users if callable(users) else USERS[users])(np.unique(data.users), rng)
        self.contact = contact

    def _mask(self, user: int) -> np.ndarray:
        if user not in self.seen:
            self.seen[user] = np.ones(self.data.n_items, bool)
            if self.contact:
                self.seen[user][user] = False
        return self.seen[user]

    def take(self, user: int, item: int) -> None:
        self._mask(user)[item] = False
        if self.both_ways:
            self._mask(item)[user] = False

    def next(self) -> tuple[int, np.ndarray] | None:
        while self.chooser.left:
            user = self.chooser.next()
            items = np.flatnonzero(self._mask(user))
            if len(items):
                return user, items
            self.chooser.drop(user)
        return None


class LimitedPool(Available):
    """One unseen relevant item of the user and random others, `size` in all; users without one are left out."""

    def __init__(self, data: Ratings, rng: np.random.Generator, size: int = 20, **kw) -> None:
        super().__init__(data, rng, **kw)
        self.size, self.rng = size, rng
        self.liked: dict[int, list[int]] = {}
        for u, i, v in zip(data.users.tolist(), data.items.tolist(), data.values.tolist(), strict=True):
            if v >= data.threshold:
                self.liked.setdefault(u, []).append(i)

    def next(self) -> tuple[int, np.ndarray] | None:
        while self.chooser.left:
            user = self.chooser.next()
            mask = self._mask(user)
            liked = [i for i in self.liked.get(user, []) if mask[i]]
            if liked:
                one = int(self.rng.choice(liked))
                others = np.setdiff1d(np.flatnonzero(mask), [one])
                some = self.rng.choice(others, min(self.size - 1, len(others)), replace=False)
                return user, np.append(some, one)
            self.chooser.drop(user)
        return None


# --- When it ends, what is learnt -------------------------------------------------------------------------------------
def end_after(limit: float | Callable[[int, int], bool], relevant: int) -> Callable[[int, int], bool]:
    """A function of (iterations done, relevant ratings found), or 0: never; from 1 on: that many iterations; below: that share of the relevant ratings found."""
    if callable(limit):
        return limit
    if limit == 0:
        return lambda done, hits: False
    if limit >= 1:
        return lambda done, hits: done >= limit
    wanted = ceil(limit * relevant)
    return lambda done, hits: hits >= wanted


def revealed(data: Ratings, user: int, item: int, kind: str) -> list[tuple[int, int, float]]:
    """What the policy learns: the pair's value, NaN if there is none. "undirected" contacts are learnt both ways;
    "reciprocal" directed ones also with the reverse edge's own value. Metrics only see the first."""
    value = data.at.get((user, item), float("nan"))
    out = [(user, item, value)]
    if kind == "undirected":
        out.append((item, user, value))
    elif kind == "reciprocal":
        out.append((item, user, data.at.get((item, user), float("nan"))))
    return out


def run(
    policy: Policy, data: Ratings, seed: int, limit: float | Callable[[int, int], bool], selection: str | Callable = "all", users: str | Callable = "random", learn: str = "general", cutoff: int = 1,
    warm: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, stored: list[tuple[int, int]] | None = None, use: str = "all", pool: int = 20,
) -> Iterator[tuple[int, int, int, int, float]]:
    """Rows ``(iter, rank, user, item, value)`` of one run. The end, the selection of candidates and the choice of users go by name, or by an own
    function or class with the same arguments as those here.

    warm: pairs and values to learn before the start, which aren't recommended again. stored: pairs of an interrupted
    run, learnt and given out again before it goes on. use: the ratings that are revealed (known, unknown, all). pool: candidates
    of a limited selection.
    """
    shown = data.view(use)
    rng = np.random.default_rng([seed, 1])
    kind = selection if callable(selection) else {"all": Available, "limited": LimitedPool}[selection]
    contact = learn in ("undirected", "reciprocal")
    size = {"size": pool} if selection == "limited" else {}
    choice = kind(shown, rng, users=users, contact=contact, both_ways=learn == "undirected", **size)
    if warm is not None:
        policy.warm_up(*warm)
        for u, i in zip(warm[0].tolist(), warm[1].tolist(), strict=True):
            choice.take(u, i)
    ended, done, hits = end_after(limit, shown.relevant()), 0, 0
    again = list(stored or [])
    while not ended(done, hits):
        if again:
            user, item = again.pop(0)
            picked = [item]
        else:
            found = choice.next()
            if found is None:
                return
            user, items = found
            picked = [policy.pick(user, items)] if cutoff == 1 else policy.rank(user, items, cutoff)
        done += 1
        for rank, item in enumerate(picked, 1):
            choice.take(user, item)
            facts = revealed(shown, user, item, learn)
            for fact in facts:
                policy.update(*fact)
            hits += facts[0][2] >= data.threshold
            yield done, rank, user, item, facts[0][2]


def replay(
    policy: Policy, rows: Iterator[tuple[int, int, int, float, np.ndarray]], extra: int = 0, rng: np.random.Generator | None = None
) -> Iterator[tuple[int, int, int, float]]:
    """``(seq, user, item, reward)`` of the log rows ``(seq, user, item, reward, candidates)`` whose featured item the
    policy picks; it learns from these only. With extra, the candidates are the featured item and so many others drawn
    at random, instead of the logged ones."""
    rng = rng or np.random.default_rng(0)
    for seq, user, item, reward, candidates in rows:
        if extra:
            others = rng.choice(policy.n_items - 1, min(extra, policy.n_items - 1), replace=False)
            candidates = np.append(others + (others >= item), item)
        if policy.pick(user, candidates) == item:
            policy.update(user, item, reward)
            yield seq, user, item, reward

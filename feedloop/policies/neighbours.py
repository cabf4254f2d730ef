"""Neighbourhood policies: similarities kept up to date, sampled for the bandit forms, and collaborative greedy."""

from __future__ import annotations

import math

import numpy as np

from feedloop.policies.base import Policy

MERGES = ("basic", "best", "last", "additive")


class Preferences:
    """Values by row and by column, under one of the four merge policies."""

    def __init__(self, variant: str) -> None:
        if variant not in MERGES:
            raise ValueError(f"no such variant: {variant}")
        self.variant = variant
        self.rows: dict[int, dict[int, float]] = {}
        self.columns: dict[int, dict[int, float]] = {}

    def put(self, row: int, column: int, value: float) -> tuple[float, float]:
        """(old value, new value); the old one is 0 where there was none."""
        own = self.rows.setdefault(row, {})
        had, old = column in own, own.get(column, 0.0)
        new = value
        if had:
            new = {"basic": old, "best": max(old, value), "last": value, "additive": old + value}[self.variant]
        own[column] = new
        self.columns.setdefault(column, {})[row] = new
        return old, new


class Cosine:
    """Inner products of rows, kept up to date: a new value of (row, column) only touches rows with that column."""

    def __init__(self, n: int) -> None:
        self.dot: list[dict[int, float]] = [{} for _ in range(n)]
        self.square = np.zeros(n)

    def change(self, row: int, others: dict[int, float], old: float, new: float) -> None:
        self.square[row] += new * new - old * old
        for other, value in others.items():
            if other != row:
                s = self.dot[row].get(other, 0.0) + (new - old) * value
                self.dot[row][other] = self.dot[other][row] = s

    def of(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        others = np.fromiter(self.dot[row].keys(), np.int64, len(self.dot[row]))
        dots = np.fromiter(self.dot[row].values(), float, len(self.dot[row]))
        norm = np.sqrt(self.square[row] * self.square[others])
        return others, np.divide(dots, norm, out=np.zeros(len(dots)), where=norm > 0)


class Table:
    """Values by row and by column under one of the four merge policies; a column's rows and values are arrays that grow."""

    def __init__(self, variant: str, n: int) -> None:
        if variant not in MERGES:
            raise ValueError(f"no such variant: {variant}")
        self.variant = variant
        self.rows: dict[int, dict[int, float]] = {}
        self.columns: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.size: dict[int, int] = {}
        self.place: dict[tuple[int, int], int] = {}
        self.order: dict[tuple[int, int], int] = {}
        self.square, self.positives = np.zeros(n), np.zeros(n)
        #: Sums by row, zero between two calls, so that a call takes time by the rows it meets.
        self.sums, self.counts, self.met = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, bool)

    def put(self, row: int, column: int, value: float) -> None:
        own = self.rows.setdefault(row, {})
        had, old = column in own, own.get(column, 0.0)
        new = {"basic": old, "best": max(old, value), "last": value, "additive": old + value}[self.variant] if had else value
        own[column] = new
        self.square[row] += new * new - old * old
        self.positives[row] += (new > 0) - (old > 0)
        if had:
            self.columns[column][1][self.place[row, column]] = new
            return
        at = self.size.get(column, 0)
        who, what = self.columns.get(column) or (np.zeros(4, np.int64), np.zeros(4))
        if at == len(who):
            who, what = np.resize(who, 2 * at), np.resize(what, 2 * at)
        who[at], what[at] = row, new
        self.columns[column] = who, what
        self.size[column], self.place[row, column] = at + 1, at
        self.order[row, column] = len(self.order)

    def column(self, column: int) -> tuple[np.ndarray, np.ndarray]:
        n = self.size.get(column, 0)
        who, what = self.columns[column] if n else (np.zeros(0, np.int64), np.zeros(0))
        return who[:n], what[:n]

    def _parts(self, row: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """(rows, values, own value) of each column of a row."""
        return [(*self.column(c), own) for c, own in self.rows.get(row, {}).items()]

    def products(self, row: int, counted: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows that share a column, inner products, common columns; none of these unless counted) of a row."""
        parts = self._parts(row)
        few = sum(len(who) for who, _, _ in parts) * 16 < len(self.met)  # sorted sooner than flags of all rows are looked through
        for who, what, own in parts:
            self.sums[who] += own * what
            if not few:
                self.met[who] = True
            if counted:
                self.counts[who] += 1
        if few:
            others = np.sort(np.concatenate([who for who, _, _ in parts])) if parts else np.zeros(0, np.int64)
            first = others != row
            first[1:] &= others[1:] != others[:-1]
            others = others[first]
        else:
            self.met[row] = False
            others = np.flatnonzero(self.met)
        out = others, self.sums[others], self.counts[others] if counted else np.zeros(0)
        for who, _, _ in parts:
            self.sums[who] = 0
            if not few:
                self.met[who] = False
            if counted:
                self.counts[who] = 0
        return out

    def product(self, row: int, other: int) -> float | None:
        """The inner product of two rows, added up as in products(); None without a common column."""
        mine, theirs = self.rows.get(row, {}), self.rows.get(other, {})
        common = mine.keys() & theirs.keys()
        if not common:
            return None
        total = 0.0
        for c in sorted(common, key=lambda c: self.order[row, c]) if len(common) > 1 else common:
            total += mine[c] * theirs[c]
        return total

    def hits(self, row: int) -> np.ndarray:
        """By row: the columns in which both are positive; 0 for the row itself."""
        out = np.zeros(len(self.positives))
        for who, what, own in self._parts(row):
            if own > 0:
                out[who] += what > 0
        out[row] = 0
        return out


def cosine(data: Table, row: int, **_) -> tuple[np.ndarray, np.ndarray]:
    others, dots, _ = data.products(row, counted=False)
    norm = data.square[others]
    norm *= data.square[row]
    np.sqrt(np.maximum(norm, 0, out=norm), out=norm)
    if len(norm) and norm.min() > 0:
        return others, np.divide(dots, norm, out=dots)
    return others, np.divide(dots, norm, out=np.zeros(len(dots)), where=norm > 0)


def restricted_cosine(data: Table, row: int, **_) -> tuple[np.ndarray, np.ndarray]:
    """Inner product over the number of common columns; only what is positive."""
    others, dots, common = data.products(row)
    keep = dots > 0
    return others[keep], dots[keep] / common[keep]


def _beta_counts(data: Table, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hits = data.hits(row)
    others = np.delete(np.arange(len(hits)), row)
    return others, hits[others], data.positives[others]


def beta_exact(data: Table, row: int, rng: np.random.Generator, alpha: float, beta: float) -> tuple[np.ndarray, np.ndarray]:
    others, h, p = _beta_counts(data, row)
    return others, (h + alpha) / (p + beta)


def beta_sampled(data: Table, row: int, rng: np.random.Generator, alpha: float, beta: float) -> tuple[np.ndarray, np.ndarray]:
    """Beta(common positives + alpha, positives of the other - common + beta), sampled for every other row."""
    others, h, p = _beta_counts(data, row)
    return others, rng.beta(h + alpha, np.maximum(p - h, 0) + beta)


SIMILARITIES = {"cosine": cosine, "restricted": restricted_cosine, "beta": beta_sampled, "beta-exact": beta_exact}


def _nearest(rng: np.random.Generator, others: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k most similar, ties at the end in random order; k = 0 takes all."""
    if k and len(others) > k:
        least = np.partition(sims, len(sims) - k)[len(sims) - k]
        sure, tied = np.flatnonzero(sims > least), np.flatnonzero(sims == least)
        want = k - len(sure)
        keep = np.r_[sure, tied if len(tied) == want else rng.choice(tied, want, replace=False)]
        others, sims = others[keep], sims[keep]
    return others, sims


class UserKNN(Policy):
    """Sum, over the k most similar users, of similarity x their value; without a neighbour's vote, random."""

    by_items = False

    def __init__(self, *args, k: int = 10, variant: str = "basic", ignore_zeroes: bool = True, similarity: str = "cosine", alpha: float = 1.0, beta: float = 1.0, item_k: int = 0, **kw) -> None:
        super().__init__(*args, **kw)
        n = self.n_items if self.by_items else self.n_users
        self.k, self.item_k, self.ignore_zeroes = k, item_k, ignore_zeroes
        self.data = Table(variant, n)
        if similarity not in SIMILARITIES:
            raise ValueError(f"no such similarity: {similarity}")
        self.similar, self.alpha, self.beta = SIMILARITIES[similarity], alpha, beta

    def learn(self, user: int, item: int, value: float) -> None:
        self.data.put(*((item, user) if self.by_items else (user, item)), value)

    def nearest(self, row: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        return _nearest(self.rng, *self.similar(self.data, row, rng=self.rng, alpha=self.alpha, beta=self.beta), k)

    def votes(self, user: int, items: np.ndarray, wanted: np.ndarray) -> None:
        """Adds up the neighbours' votes for these items in an array by item; NaN where nobody votes."""
        asked = items.tolist()
        for other, sim in zip(*(x.tolist() for x in self.nearest(user, self.k)), strict=True):
            own = self.data.rows.get(other, {})
            found = own.items() if len(own) < len(asked) else [(i, own[i]) for i in asked if i in own]
            for item, value in found:
                if value > 0 or not self.ignore_zeroes:
                    wanted[item] = sim * value if np.isnan(wanted[item]) else wanted[item] + sim * value

    def scores(self, user: int, items: np.ndarray) -> np.ndarray:
        out = np.full(self.n_items, np.nan)
        self.votes(user, items, out)
        return out[items]  # where nobody votes, NaN counts as lowest


class ItemKNN(UserKNN):
    """Sum, over the user's best k items (0: all), of the similarity of their nearest items x the user's value."""

    by_items = True

    def votes(self, user: int, items: np.ndarray, wanted: np.ndarray) -> None:
        who, what = self.data.column(user)
        own = [(i, v) for i, v in zip(who.tolist(), what.tolist(), strict=True) if v > 0 or not self.ignore_zeroes]
        own.sort(key=lambda x: -x[1])
        chosen = own[: self.k] if self.k else own
        if self.similar is cosine and not self.item_k:  # every item votes, so only the asked ones need a similarity
            for item, value in chosen:
                for other in items.tolist():
                    if other != item and (dot := self.data.product(item, other)) is not None:
                        norm = math.sqrt(max(self.data.square[item] * self.data.square[other], 0))
                        so_far = wanted[other]
                        wanted[other] = (0.0 if math.isnan(so_far) else so_far) + (dot / norm if norm > 0 else 0.0) * value
            return
        for item, value in chosen:
            others, sims = self.nearest(item, self.item_k)
            so_far = wanted[others]
            wanted[others] = np.where(np.isnan(so_far), 0.0, so_far) + sims * value


class CollaborativeGreedy(Policy):
    """Random with probability 1 / users^alpha; the next unseen item of one shared order with probability
    1 / (times of the user)^alpha; else the share of likes among users who agree on jointly explored items."""

    def __init__(self, *args, threshold: float = 0.5, alpha: float = 0.5, **kw) -> None:
        super().__init__(*args, **kw)
        self.threshold, self.alpha = threshold, alpha
        self.order = self.rng.permutation(self.n_items)
        self.place = np.empty(self.n_items, int)
        self.place[self.order] = np.arange(self.n_items)
        self.times = np.ones(self.n_users)
        self.joint: dict[int, int] = {}
        self.explored = Cosine(self.n_users)
        self.common = Preferences("last")
        self.seen: list[dict[int, float]] = [{} for _ in range(self.n_users)]

    def pick(self, user: int, items: np.ndarray) -> int:
        if not len(items):
            return -1
        coin, rare, shared = self.rng.random(), 1 / self.n_users**self.alpha, 1 / self.times[user] ** self.alpha
        if coin < rare:
            return int(self.rng.choice(items))
        if coin < rare + shared:
            self.joint[user] = int(items[np.argmin(self.place[items])])
            return self.joint[user]
        return super().pick(user, items)

    def rank(self, user: int, items: np.ndarray, k: int) -> list[int]:
        return self.one_by_one(user, items, k)

    def scores(self, user: int, items: np.ndarray) -> np.ndarray:
        likes, shown = np.zeros(self.n_items), np.zeros(self.n_items)
        others, sims = self.explored.of(user)
        for other in others[sims > self.threshold].tolist():
            own = self.seen[other]
            codes = np.fromiter(own.keys(), np.int64, len(own))
            shown[codes] += 1
            likes[codes] += np.fromiter(own.values(), float, len(own)) > 0
        return np.divide(likes, shown, out=np.full(self.n_items, 0.5), where=shown > 0)[items]

    def learn(self, user: int, item: int, value: float) -> None:
        self.times[user] += 1
        if self.joint.get(user) == item:
            del self.joint[user]
            old, new = self.common.put(user, item, 1.0 if value > 0 else -1.0)
            self.explored.change(user, self.common.columns[item], old, new)
        self.seen[user][item] = value

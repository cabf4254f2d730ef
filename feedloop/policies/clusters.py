"""Cluster bandits: users (and items) whose estimates differ by more than their confidence are set apart."""

from __future__ import annotations

import numpy as np

from feedloop.policies.base import Policy


class Complete:
    """All pairs but those removed: a row of flags for each vertex that had edges removed."""

    def __init__(self, n: int) -> None:
        self.n = n
        self.place = np.full(n, -1)
        self.owner, self.gone = np.zeros(4, int), np.zeros((4, n), bool)
        self.used, self.touched = 0, np.zeros(n, bool)

    def row(self, v: int) -> np.ndarray:
        """Flags of the neighbours."""
        out = np.ones(self.n, bool)
        out[v] = False
        if self.place[v] >= 0:
            out &= ~self.gone[self.place[v]]
        out[self.owner[: self.used][self.gone[: self.used, v]]] = False
        return out

    def near(self, v: int) -> np.ndarray:
        return np.flatnonzero(self.row(v))

    def remove(self, v: int, others: np.ndarray) -> None:
        if self.place[v] < 0:
            if self.used == len(self.owner):
                self.owner, self.gone = np.r_[self.owner, self.owner], np.r_[self.gone, np.zeros_like(self.gone)]
            self.place[v], self.owner[self.used] = self.used, v
            self.used += 1
        self.gone[self.place[v], others] = True
        self.touched[v] = self.touched[others] = True

    def split(self, members: np.ndarray) -> list[np.ndarray]:
        """Connected components within the members."""
        if not self.touched[members].all():  # who lost no edge is everyone's neighbour
            return [np.sort(members)]
        left = np.zeros(self.n, bool)
        left[members] = True
        out = []
        for m in np.sort(members).tolist():
            if not left[m]:
                continue
            found = np.zeros(self.n, bool)
            found[m], left[m] = True, False
            open_ = [m]
            while open_ and left.any():
                if (few := np.flatnonzero(left)).size < len(open_):  # cheaper to ask those that are left
                    new = np.zeros(self.n, bool)
                    new[[w for w in few.tolist() if (self.row(w) & found).any()]] = True
                    open_ = []
                else:
                    new = self.row(open_.pop()) & left
                found |= new
                left &= ~new
                open_ += np.flatnonzero(new).tolist()
            out.append(np.flatnonzero(found))
        return out


class Sparse:
    """Each pair with probability p: lists of neighbours, in memory and time in proportion to the edges."""

    def __init__(self, n: int, p: float, rng: np.random.Generator) -> None:
        self.n = n
        a, b = _drawn(n, p, rng)
        ends, others = np.r_[a, b], np.r_[b, a]
        order = np.lexsort((others, ends))
        self.ends, self.others = ends[order].astype(np.int32), others[order].astype(np.int32)
        self.start = np.searchsorted(self.ends, np.arange(n + 1))
        self.kept = np.ones(len(order), bool)

    def row(self, v: int) -> np.ndarray:
        out = np.zeros(self.n, bool)
        out[self.near(v)] = True
        return out

    def near(self, v: int) -> np.ndarray:
        """The neighbours, lowest first."""
        a, z = self.start[v], self.start[v + 1]
        return self.others[a:z][self.kept[a:z]]

    def remove(self, v: int, others: np.ndarray) -> None:
        for x, y in [(v, others), *((int(w), np.array([v])) for w in others)]:
            a, z = self.start[x], self.start[x + 1]
            self.kept[a:z] &= ~np.isin(self.others[a:z], y)

    def split(self, members: np.ndarray) -> list[np.ndarray]:
        inside = np.zeros(self.n, bool)
        inside[members] = True
        some = np.flatnonzero(self.kept & (self.ends < self.others))
        some = some[inside[self.ends[some]] & inside[self.others[some]]]
        a, b = self.ends[some], self.others[some]
        label = np.arange(self.n)
        while len(a):  # each component gets its least member; an edge between two labels joins them
            x, y = label[a], label[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label != (further := label[label])).any():
                label = further
        members = np.sort(members)
        own = label[members]
        order = np.argsort(own, kind="stable")
        return np.split(members[order], np.flatnonzero(np.diff(own[order])) + 1) if len(members) else []


def _drawn(n: int, p: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Pairs a < b, each with probability p: the gaps between drawn pairs are geometric."""
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.arange(n, dtype=np.int64)
    first = first * (2 * n - first - 1) // 2  # of each row of the upper triangle
    total, at, parts = n * (n - 1) // 2, -1, []
    while at < total:
        parts.append(at + np.cumsum(rng.geometric(p, int(1.1 * p * (total - at)) + 16)))
        at = int(parts[-1][-1])
    pair = np.concatenate(parts)
    pair = pair[pair < total]
    a = np.searchsorted(first, pair, "right") - 1
    a = np.minimum(a, n - 2)  # the last row is empty
    return a, pair - first[a] + a + 1


def start_graph(n: int, kind: str, rng: np.random.Generator) -> Complete | Sparse:
    """A graph without loops: complete, or random with p = 3 ln n / n."""
    return Complete(n) if kind == "complete" else Sparse(n, min(1.0, 3 * np.log(max(n, 2)) / n), rng)


class CLUB(Policy):
    """Clusters of users; an item's bound comes from its cluster's feedback. After each update, edges to neighbours
    that are further away than the two users' confidence allow are removed, and only that component is split anew."""

    def __init__(self, *args, alpha: float = 1.0, alpha2: float = 1.0, graph: str = "complete", **kw) -> None:
        super().__init__(*args, **kw)
        self.alpha, self.alpha2, self.t = alpha, alpha2, 0
        self.graph = start_graph(self.n_users, graph, self.rng)
        self.cluster = np.zeros(self.n_users, int)
        parts = self.graph.split(np.arange(self.n_users))
        for k, part in enumerate(parts):
            self.cluster[part] = k
        self.clusters = len(parts)
        self.b, self.m = np.zeros((self.n_users, self.n_items), np.float32), np.zeros((self.n_users, self.n_items), np.float32)
        self.sums = {k: (np.zeros(self.n_items), np.zeros(self.n_items)) for k in range(self.clusters)}
        self.times = np.zeros(self.n_users)

    def scores(self, user: int, items: np.ndarray) -> np.ndarray:
        b, m = self.sums[int(self.cluster[user])]
        m = m[items] + 1
        return b[items] / m + self.alpha * np.sqrt(np.log(self.t + 1) / m)

    def learn(self, user: int, item: int, value: float) -> None:
        self.t += 1
        self.b[user, item] += value
        self.m[user, item] += 1
        self.times[user] += 1
        own = int(self.cluster[user])
        b, m = self.sums[own]
        b[item] += value
        m[item] += 1
        near = np.flatnonzero(self.graph.row(user))
        if not len(near):
            return
        reach = np.sqrt((1 + np.log(1 + self.times)) / (1 + self.times))
        # Most users have few items: the distance to a neighbour runs over the items that either has.
        mine = self.b[user] / (self.m[user] + 1)
        theirs = self.b[near] / (self.m[near] + 1)
        far = np.sqrt(((theirs - mine) ** 2).sum(axis=1)) > self.alpha2 * (reach[user] + reach[near])
        if not far.any():
            return
        self.graph.remove(user, near[far])
        parts = self.graph.split(np.flatnonzero(self.cluster == own))
        for k, part in enumerate(parts if len(parts) > 1 else []):
            code = own if k == 0 else self.clusters
            self.clusters += k > 0
            self.cluster[part] = code
            self.sums[code] = (self.b[part].sum(axis=0, dtype=float), self.m[part].sum(axis=0, dtype=float))


class COFIBA(Policy):
    """Clusters of items, and for each of them clusters of users. An update sets users apart that differ on the item,
    and items apart that group the users in another way. Sums over a cluster of users are kept until it splits, so a step takes
    time by the user's neighbours and not by all users, once the item has no neighbours left."""

    def __init__(self, *args, alpha: float = 1.0, alpha2: float = 1.0, user_graph: str = "erdos", item_graph: str = "erdos", **kw) -> None:
        super().__init__(*args, **kw)
        self.alpha, self.alpha2, self.t, self.kind = alpha, alpha2, 0, user_graph
        self.items = start_graph(self.n_items, item_graph, self.rng)
        self.item_cluster, self.place = np.zeros(self.n_items, int), np.zeros(self.n_items, int)
        self.b, self.m = np.zeros((self.n_users, self.n_items), np.float32), np.zeros((self.n_users, self.n_items), np.float32)
        self.users: dict[int, Complete | Sparse] = {}
        self.user_cluster: dict[int, np.ndarray] = {}
        self.members: dict[int, np.ndarray] = {}
        self.sums: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
        parts = self.items.split(np.arange(self.n_items))
        for k, part in enumerate(parts):
            self._hold(k, part)
            self._open(k)
        self.clusters = len(parts)

    def _hold(self, item_cluster: int, items: np.ndarray) -> None:
        """Makes these the cluster's items."""
        self.item_cluster[items], self.place[items] = item_cluster, np.arange(len(items))
        self.members[item_cluster], self.sums[item_cluster] = items, {}

    def _open(self, item_cluster: int) -> None:
        graph = start_graph(self.n_users, self.kind, self.rng)
        self.users[item_cluster] = graph
        labels = np.zeros(self.n_users, int)
        for k, part in enumerate(graph.split(np.arange(self.n_users))):
            labels[part] = k
        self.user_cluster[item_cluster] = labels

    def _sums(self, item_cluster: int, label: int) -> tuple[np.ndarray, np.ndarray]:
        """Values and counts of the cluster's items, summed up over one of its clusters of users."""
        kept = self.sums[item_cluster]
        if label not in kept:
            cells = np.ix_(np.flatnonzero(self.user_cluster[item_cluster] == label), self.members[item_cluster])
            kept[label] = self.b[cells].sum(axis=0, dtype=float), self.m[cells].sum(axis=0, dtype=float)
        return kept[label]

    def scores(self, user: int, items: np.ndarray) -> np.ndarray:
        b, m = np.empty(len(items)), np.empty(len(items))
        clusters, places = self.item_cluster[items], self.place[items]
        for c in set(clusters.tolist()):
            here = clusters == c
            own_b, own_m = self._sums(c, int(self.user_cluster[c][user]))
            b[here], m[here] = own_b[places[here]], own_m[places[here]]
        m += 1
        return b / m + self.alpha * np.sqrt(np.log(self.t + 1) / m)

    def _close(self, user: int, others: np.ndarray, items: np.ndarray) -> np.ndarray:
        """[item, other user]: whether the two users' estimates of the item are within their confidence."""
        m, own_m = self.m[others[:, None], items] + 1, self.m[user, items] + 1
        far = np.abs(self.b[others[:, None], items] / m - self.b[user, items] / own_m)
        return (far <= self.alpha2 * (np.sqrt(np.log(self.t + 1) / m) + np.sqrt(np.log(self.t + 1) / own_m))).T

    def learn(self, user: int, item: int, value: float) -> None:
        self.t += 1
        before = float(self.b[user, item])
        self.b[user, item] += value
        self.m[user, item] += 1
        c = int(self.item_cluster[item])
        graph, labels = self.users[c], self.user_cluster[c]
        own = int(labels[user])
        if own in self.sums[c]:
            b, m = self.sums[c][own]
            b[self.place[item]] += float(self.b[user, item]) - before
            m[self.place[item]] += 1
        others = graph.near(user)
        far = others[~self._close(user, others, np.array([item]))[0]]
        if len(far):
            graph.remove(user, far)
            parts = graph.split(np.flatnonzero(labels == own))
            for part in parts[1:]:
                labels[part] = labels.max() + 1
            if len(parts) > 1:
                self.sums[c].pop(own, None)
        near = self.items.near(item)
        if not len(near):
            return
        every = np.delete(np.arange(self.n_users), user)
        alike = (self._close(user, every, near) == np.delete(graph.row(user), user)).all(axis=1)
        apart = near[~alike]
        if not len(apart):
            return
        self.items.remove(item, apart)
        parts = self.items.split(self.members[c])
        for k, part in enumerate(parts if len(parts) > 1 else []):
            self._hold(c if k == 0 else self.clusters, part)
            if k:
                self._open(self.clusters)
                self.clusters += 1

"""Products of a stated set of query rows with every row of a state, in tiles of a matrix: no pair is shuffled unless it is a result."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of the state, a task each; all queries travel to each of them.
PARTS = 24
#: Cells of a tile, queries of a tile, and products that are spread at a time.
CELLS, QUERIES, SPREAD = 1 << 21, 1 << 14, 1 << 21
#: An item that one in so many of a tile's queries has is multiplied as a dense column.
DENSE = 10


@dataclass
class Tile:
    """Queries a (rows of ``common`` and ``dot`` have one of the state's b each, columns a query each), with each side's number
    of items and norm. dot and common are None if they weren't asked for."""

    number: int
    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    norm_a: np.ndarray
    norm_b: np.ndarray
    dot: np.ndarray | None
    common: np.ndarray | None


class _Queries:
    """Some queries, their rows by item."""

    def __init__(self, a: np.ndarray, row: np.ndarray, code: np.ndarray, value: np.ndarray, n_items: int) -> None:
        self.a, n = a, len(a)
        self.n = np.bincount(row, minlength=n)
        self.norm = np.sqrt(np.bincount(row, value * value, minlength=n))
        order = np.argsort(code, kind="stable")
        self.row, self.value = row[order], value[order]
        self.count = np.bincount(code, minlength=n_items)
        self.start = np.cumsum(self.count) - self.count
        dense = np.flatnonzero(self.count * DENSE >= n)
        self.place = np.full(n_items, -1)
        self.place[dense] = np.arange(len(dense))
        inside = self.place[code] >= 0
        self.dense = np.zeros((len(dense), n))
        self.dense[self.place[code[inside]], row[inside]] = value[inside]
        self.has = (self.dense != 0).astype(np.float32)

    def product(self, n: int, row: np.ndarray, code: np.ndarray, value: np.ndarray | None) -> np.ndarray:
        """[row, query]: inner products, or without values the number of common items."""
        place = self.place[code]
        inside = place >= 0
        left = np.zeros((n, len(self.dense)), np.float32 if value is None else float)
        left[row[inside], place[inside]] = 1 if value is None else value[inside]
        out = left @ (self.has if value is None else self.dense)
        row, code, value = row[~inside], code[~inside], None if value is None else value[~inside]
        times = self.count[code]
        ends = np.cumsum(times)
        a = 0
        while a < len(row):
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SPREAD, "right")))
            some = times[a:z]
            total = int(some.sum())
            if total:
                at = np.repeat(self.start[code[a:z]] - (np.cumsum(some) - some), some) + np.arange(total)
                cell = np.repeat(row[a:z] * len(self.a), some) + self.row[at]
                out += np.bincount(cell, None if value is None else np.repeat(value[a:z], some) * self.value[at], n * len(self.a)).reshape(out.shape).astype(out.dtype, copy=False)
            a = z
        return out


def _tiles(batches: Iterator[pa.RecordBatch], dots: bool, commons: bool) -> Iterator[Tile]:
    """Tiles of a part's rows ``(o, k, i, r)``: queries have no o and come first, the state follows by k."""
    queries: list[tuple[np.ndarray, ...]] = []
    held: list[tuple[np.ndarray, ...]] = []
    blocks: list[_Queries] | None = None
    items = np.zeros(0, np.int64)
    wide, rows_held = 16, 0  # the first tiles are small: they give the thresholds of a search

    def indexed() -> tuple[list[_Queries], np.ndarray]:
        k, i, r = (np.concatenate(x) for x in zip(*queries, strict=True)) if queries else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        a, row = np.unique(k, return_inverse=True)
        every, code = np.unique(i, return_inverse=True)
        out = []
        for first in range(0, len(a), QUERIES):
            own = (row >= first) & (row < first + QUERIES)
            out.append(_Queries(a[first : first + QUERIES], row[own] - first, code[own], r[own], len(every)))
        return out, every

    def given(k: np.ndarray, i: np.ndarray, r: np.ndarray) -> Iterator[Tile]:
        """Tiles of whole rows of the state, sorted by k."""
        nonlocal wide
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        most = max(1, CELLS // max(len(q.a) for q in blocks))
        first = 0
        while first < len(starts):
            last = min(len(starts), first + min(wide, most))
            wide = min(2 * wide, most)
            a, z = starts[first], starts[last] if last < len(starts) else len(k)
            b = k[starts[first:last]]
            row = np.repeat(np.arange(last - first), np.diff(np.r_[starts[first:last], z]))
            n_b, norm_b = np.bincount(row, minlength=len(b)), np.sqrt(np.bincount(row, r[a:z] * r[a:z], minlength=len(b)))
            code = np.searchsorted(items, i[a:z])
            found = np.flatnonzero(items[np.minimum(code, len(items) - 1)] == i[a:z])
            row, code, value = row[found], code[found], r[a:z][found]
            for number, q in enumerate(blocks):
                dot = q.product(len(b), row, code, value) if dots else None
                common = q.product(len(b), row, code, None) if commons else None
                own = np.flatnonzero(np.isin(b, q.a, assume_unique=True))
                for x in (dot, common):
                    if x is not None:
                        x[own, np.searchsorted(q.a, b[own])] = 0  # not with itself
                yield Tile(number, q.a, b, q.n, n_b, q.norm, norm_b, dot, common)
            first = last

    for batch in batches:
        asked = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3)]
        if asked.any():
            queries.append(tuple(x[asked] for x in rows))
            rows = [x[~asked] for x in rows]
        if len(rows[0]):
            if blocks is None:
                blocks, items = indexed()
            if not blocks:
                return
            held.append(tuple(rows))
            rows_held += len(rows[0])
            if rows_held >= 50_000 and rows[0][-1] != held[0][0][0]:
                k, i, r = (np.concatenate(x) for x in zip(*held, strict=True))
                whole = int(np.searchsorted(k, k[-1]))  # the last one may go on in the next batch
                yield from given(k[:whole], i[:whole], r[:whole])
                held, rows_held = [(k[whole:], i[whole:], r[whole:])], len(k) - whole
    if held:
        yield from given(*(np.concatenate(x) for x in zip(*held, strict=True)))


def over_tiles(queries: DataFrame, state: DataFrame, work: Callable[[Iterator[Tile]], Iterator[pa.RecordBatch]], schema: str, dots: bool = False, commons: bool = False) -> DataFrame:
    """What work gives for the tiles of each part. Both: ``(k, i, r)`` over whole numbers, a pair (k, i) once, r not zero; the
    queries with all of their rows. Within a part, the state comes in the order of k."""
    columns = [F.col("k").cast("bigint").alias("k"), F.col("i").cast("bigint").alias("i"), F.col("r").cast("double").alias("r")]
    part: Column = F.pmod(F.xxhash64(F.col("k").cast("bigint")), F.lit(PARTS)).cast("int").alias("part")
    every = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")
    asked = queries.select(every, F.lit(None).cast("bigint").alias("o"), *columns)
    rows = asked.unionAll(state.select(part, F.col("k").cast("bigint").alias("o"), *columns))
    rows = rows.repartitionById(PARTS, F.col("part")).sortWithinPartitions(F.asc_nulls_first("o")).select("o", "k", "i", "r")
    return rows.mapInArrow(lambda batches: work(_tiles(batches, dots, commons)), schema)


def _cosine(t: Tile) -> np.ndarray:
    return t.dot / (t.norm_a[None, :] * t.norm_b[:, None])


def _restricted(t: Tile) -> np.ndarray:
    return t.dot / np.maximum(t.common, 1)


def _beta(alpha: float, beta: float) -> Callable[[Tile], np.ndarray]:
    return lambda t: (t.common.astype(float) + alpha) / (t.n_b + beta)[:, None]


def best_of_part(sim: Callable[[Tile], np.ndarray], k: int) -> Callable[[Iterator[Tile]], Iterator[pa.RecordBatch]]:
    """The k most similar b of each a within a part, as ``neighbours.nearest`` orders them."""

    def work(tiles: Iterator[Tile]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, ...]] = {}
        least: dict[int, np.ndarray] = {}
        names: dict[int, np.ndarray] = {}
        for t in tiles:
            n = len(t.a)
            names[t.number] = t.a
            bar = least.setdefault(t.number, np.full(n, -np.inf))
            sims = sim(t)
            scaled = np.floor(sims * 1e9 + 0.5)
            # The state comes by b, so an equal one that comes later stays behind.
            row, col = np.nonzero(scaled > bar[None, :])
            there = (t.dot if t.dot is not None else t.common)[row, col] > 0
            row, col = row[there], col[there]
            if not len(row):
                continue
            new = (col, scaled[row, col], t.b[row], sims[row, col])
            old = held.get(t.number)
            q, s, b, exact = new if old is None else (np.concatenate(x) for x in zip(old, new, strict=True))
            order = np.lexsort((b, -s, q))
            keep = order[np.arange(len(q)) - np.searchsorted(q[order], q[order]) < k]
            held[t.number] = q, s, b, exact = q[keep], s[keep], b[keep], exact[keep]
            full = np.flatnonzero(np.bincount(q, minlength=n) == k)
            bar[full] = s[np.searchsorted(q, full, "right") - 1]
        for number, (q, _, b, exact) in held.items():
            yield pa.record_batch([pa.array(names[number][q]), pa.array(b), pa.array(exact)], names=["a", "b", "sim"])

    return work


def similar(queries: DataFrame, state: DataFrame, kind: str, k: int, alpha: float = 1.0, beta: float = 2.0) -> DataFrame:
    """``(a, b, sim)``: for each query, the k most similar others of each part of the state; similarities as in ``neighbours``, r positive."""
    sim = {"cosine": _cosine, "restricted": _restricted, "beta": _beta(alpha, beta)}[kind]
    return over_tiles(queries, state, best_of_part(sim, k), "a bigint, b bigint, sim double", dots=kind != "beta", commons=kind != "cosine")


def _rounded(values: np.ndarray, places: int | None) -> np.ndarray:
    """As the engine rounds: half up in the decimal digits of a value."""
    if places is None:
        return values
    return np.array([float(Decimal(repr(v)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)) for v in values.tolist()], float)


def pairs_in_common(least: int, places: int | None = None) -> Callable[[Iterator[Tile]], Iterator[pa.RecordBatch]]:
    """``(a, b, common, weight, distance)`` of the pairs with at least so many common items, of which weight and distance depend on
    the number of items that only one of them has: they are worked out, and rounded if wanted, once for each such number."""

    def work(tiles: Iterator[Tile]) -> Iterator[pa.RecordBatch]:
        weight, distance = np.zeros(0), np.zeros(0)
        for t in tiles:
            cell = np.flatnonzero(t.common.ravel() >= least)
            row, col = np.divmod(cell, len(t.a))
            common = t.common.ravel()[cell].astype(np.int64)
            apart = t.n_a[col] + t.n_b[row] - 2 * common
            if len(apart) and apart.max() >= len(weight):
                more = np.arange(len(weight), 2 * int(apart.max()) + 1)
                weight, distance = np.append(weight, _rounded(1.0 / (more + 1), places)), np.append(distance, _rounded(np.sqrt(more), places))
            yield pa.record_batch([pa.array(x) for x in (t.a[col], t.b[row], common, weight[apart], distance[apart])], names=["a", "b", "common", "weight", "distance"])

    return work


def distances_in_common(least: int, most: int) -> Callable[[Iterator[Tile]], Iterator[pa.RecordBatch]]:
    """``(common, edges, distance)`` of a part: the number of pairs and the sum of their distances by common items, most taken as most and more."""

    def work(tiles: Iterator[Tile]) -> Iterator[pa.RecordBatch]:
        edges, distance = np.zeros(most + 1, np.int64), np.zeros(most + 1)
        for t in tiles:
            row, col = np.nonzero(t.common >= least)
            common = t.common[row, col].astype(np.int64)
            apart = t.n_a[col] + t.n_b[row] - 2 * common
            common = np.minimum(common, most)
            edges += np.bincount(common, minlength=most + 1)
            distance += np.bincount(common, np.sqrt(apart), minlength=most + 1)
        some = np.flatnonzero(edges)
        yield pa.record_batch([pa.array(x) for x in (some, edges[some], distance[some])], names=["common", "edges", "distance"])

    return work

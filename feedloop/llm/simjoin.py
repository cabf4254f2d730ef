"""All similar pairs between set-valued records: T-occurrence list merging on partitioned inverted lists.

1. Records become sets; equal sets are one class, represented by its least record.
2. Items are ordered from rare to frequent. Two sets whose similarity reaches the threshold share one of their rarest
   items (prefix filter), so a set is sent to the partitions of its prefix items, with the items that follow there.
3. In a partition, inverted lists of the sets seen so far are probed by size: T is the overlap that the pair's sizes
   ask for. The longest lists are set aside; the short ones are merged by a heap that skips ahead to the next record
   that can still reach its share of T; what it finds is looked up in the long lists by binary search.
4. A partition with more sets than fit a block is cut into blocks, and each pair of blocks is worked off by itself.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from heapq import heapify, heappop, heappush
from itertools import islice
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloop.llm.cooccur import _codes_of, baskets, item_counts
from feedloop.session import cut

#: Items with more than 1/FREQUENT of all entries have a rank by frequency, all others by code below them: so the
#: table of ranks has at most FREQUENT rows, and the order is total whatever the number of items.
FREQUENT = 50_000
#: Sets in a block of a partition.
BLOCK = 4_000
#: Crowded partitions whose number of blocks is broadcast; more are joined by a shuffle.
SMALL = 1_000_000
#: Members of a class of equal sets that one task pairs with all others.
SHARE = 2_000
#: How much longer lists have to be to be set aside: a factor of the logarithm of the longest one's length.
MU = 0.01
#: Postings in a task of the merge.
TASK = 40_000


def _least_overlap(x: int, y: int, t: Fraction) -> int:
    """Common items of sets of x and y items whose Jaccard similarity is t."""
    return -(-(x + y) * t.numerator // (t.numerator + t.denominator))


def probe_prefix(x: int, t: Fraction) -> int:
    """Rarest items of a set by which it looks for sets that aren't larger."""
    return x + (-x * t.numerator // t.denominator) + 1


def index_prefix(x: int, t: Fraction) -> int:
    """Rarest items of a set under which larger sets find it."""
    return x - _least_overlap(x, x, t) + 1


def merge_skip(lists: list[list[int]], starts: list[int], least: int) -> Iterator[tuple[int, int]]:
    """(id, occurrences) of the ids in at least `least` of the sorted lists, from the given places on.

    Heads lie in a heap. Where the smallest id occurs too seldom, least - 1 heads are taken off; no id before the next
    head can be in enough of the other lists, so the lists taken off skip to it by binary search.
    """
    at = list(starts)
    heap = [(lists[k][at[k]], k) for k in range(len(lists)) if at[k] < len(lists[k])]
    heapify(heap)
    while len(heap) >= least:
        head = heap[0][0]
        off = []
        while heap and heap[0][0] == head:
            off.append(heappop(heap)[1])
        if len(off) >= least:
            yield head, len(off)
            goal = head + 1
        else:
            while len(off) < least - 1 and heap:
                off.append(heappop(heap)[1])
            if not heap:
                return
            goal = max(heap[0][0], head + 1)
        for k in off:
            at[k] = bisect_left(lists[k], goal, at[k])
            if at[k] < len(lists[k]):
                heappush(heap, (lists[k][at[k]], k))


def similar_in(block: list[tuple[int, int, int, np.ndarray]], t: Fraction) -> Iterator[tuple[int, int]]:
    """Pairs of one block. Its rows (record, size, place, items from the place on) share the item at the place.

    Rows come by size. A pair is given if its common items from here on suffice; the partition of the first item that
    two sets share sees all of them, so no pair is missed, and one that other partitions find too is the same pair.
    """
    num, both = t.numerator, t.numerator + t.denominator
    index: dict[int, list[int]] = {}
    ids: list[int] = []
    sizes: list[int] = []
    spare: list[int] = []  # items after the place
    for record, size, place, items in block:
        tail = items[1:].tolist()
        smallest = -(-size * num // t.denominator)
        low = bisect_left(sizes, smallest)
        need = _least_overlap(size, smallest, t) - 1  # besides the shared item
        if low < len(ids) and len(tail) >= need:
            lists, starts = [], []
            for item in tail:
                found = index.get(item)
                if found is not None and found[-1] >= low:
                    lists.append(found)
                    starts.append(bisect_left(found, low) if low else 0)
            if len(lists) >= need:
                if need <= 0:
                    hits: Iterator[tuple[int, int]] = ((k, 0) for k in range(low, len(ids)))
                    long, from_ = lists, starts
                else:
                    # Binary search takes the longest lists, the more of them the shorter they are; at least two
                    # occurrences are asked of the others (one, if T is 1).
                    longest = max(len(found) - begin for found, begin in zip(lists, starts, strict=True))
                    aside = max(0, min(need - 2, int(need / (MU * log(longest) + 1))))
                    order = sorted(range(len(lists)), key=lambda k: len(lists[k]) - starts[k])
                    short = order[: len(order) - aside]
                    long, from_ = [lists[k] for k in order[len(short) :]], [starts[k] for k in order[len(short) :]]
                    hits = merge_skip([lists[k] for k in short], [starts[k] for k in short], need - aside)
                for k, n in hits:
                    want = -(-(size + sizes[k]) * num // both) - 1
                    if spare[k] < want:
                        continue
                    left = len(long)
                    for found, begin in zip(long, from_, strict=True):
                        if n >= want or n + left < want:
                            break
                        left -= 1
                        at = bisect_left(found, k, begin)
                        n += at < len(found) and found[at] == k
                    if n >= want:
                        yield ids[k], record
        if place < index_prefix(size, t):
            here = len(ids)
            ids.append(record)
            sizes.append(size)
            spare.append(len(tail))
            for item in tail:
                index.setdefault(item, []).append(here)


def _sets(blocks: DataFrame, ranks: tuple[np.ndarray, np.ndarray], least: int) -> DataFrame:
    """``(record, size, items)`` of sets with enough items; items: unsigned 32-bit ranks, rare to frequent."""
    items, places = ranks

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code in _codes_of(batches):
            record, item = code >> 32, code & 0xFFFFFFFF
            at = np.minimum(np.searchsorted(items, item), max(len(items) - 1, 0))
            if len(items):
                item = np.where(items[at] == item, (1 << 31) + places[at], item)
            order = np.argsort((record << 32) | item, kind="stable")
            record, item = record[order], item[order].astype(np.uint32)
            first = np.flatnonzero(np.concatenate(([True], record[1:] != record[:-1])))
            size = np.diff(np.append(first, len(record)))
            big = size >= least
            first, size = first[big], size[big]
            if len(first):
                sets = [item[a : a + n].tobytes() for a, n in zip(first.tolist(), size.tolist(), strict=True)]
                yield pa.record_batch([pa.array(record[first]), pa.array(size), pa.array(sets, pa.binary())], names=["record", "size", "items"])

    return blocks.mapInArrow(kernel, "record bigint, size bigint, items binary")


def _route(batches: Iterator[pa.RecordBatch], t: Fraction) -> Iterator[pa.RecordBatch]:
    """A row for each prefix item of each set, with the items from there on."""
    for b in batches:
        for from_ in range(0, b.num_rows, 2000):
            out: list[tuple[int, int, int, int, bytes]] = []
            part = b.slice(from_, 2000)
            for record, size, raw in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                prefix = np.frombuffer(raw, np.uint32, probe_prefix(size, t)).tolist()
                out += [(item, record, size, place, raw[4 * place :]) for place, item in enumerate(prefix)]
            if out:
                cols = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["item", "record", "size", "place", "rest"])


def _join(batches: Iterator[pa.RecordBatch], t: Fraction) -> Iterator[pa.RecordBatch]:
    """Similar pairs of each (item, pair of blocks); the rows are sorted by these and size."""

    def found(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        pairs = similar_in(rows, t) if len(rows) > 1 else iter(())
        while some := list(islice(pairs, 1 << 16)):
            a, z = (np.array(c, np.int64) for c in zip(*some, strict=True))
            yield pa.record_batch([pa.array(np.minimum(a, z)), pa.array(np.maximum(a, z))], names=["a", "b"])

    rows: list[tuple] = []
    current = None
    for b in batches:
        for item, pair, record, size, place, rest in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
            if (item, pair) != current:
                yield from found(rows)
                current, rows = (item, pair), []
            rows.append((record, size, place, np.frombuffer(rest, np.uint32)))
    yield from found(rows)


def similar_pairs(df: DataFrame, record: str, item: str, threshold: Fraction, least: int = 1) -> DataFrame:
    """``(a, b)``, a < b: all pairs of records whose sets have `least` items or more and a Jaccard similarity that
    reaches the threshold.

    A record's set is its distinct non-null items. Null records have no set, and records without items are similar to
    none. Equal sets are similar. Codes must be whole numbers from 0 to 2**31 - 1. Other columns are ignored.
    """
    blocks = baskets(df, record, item)
    counts = item_counts(blocks)
    total = counts.agg(F.sum("n_item")).first()[0] or 0
    frequent = np.array([tuple(r) for r in counts.where(F.col("n_item") > total // FREQUENT).collect()] or np.empty((0, 2)), np.int64)
    order = np.lexsort((frequent[:, 0], frequent[:, 1]))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    by_code = np.argsort(frequent[:, 0])
    ranks = frequent[by_code, 0], place[by_code]

    sets = _sets(blocks, ranks, least)
    classes = cut(sets.groupBy("items").agg(F.min("record").alias("record"), F.first("size").alias("size"), F.count("*").alias("n")))

    n, d = threshold.numerator, threshold.denominator
    postings = classes.agg(F.sum(F.col("size") - F.expr(f"(size * {n} + {d - 1}) div {d}") + 1)).first()[0] or 0

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_ = [np.frombuffer(raw, np.uint32, probe_prefix(size, threshold)) for size, raw in zip(*(b.column(k).to_pylist() for k in range(2)), strict=True)]
            if all_:
                item, n = np.unique(np.concatenate(all_), return_counts=True)
                yield pa.record_batch([pa.array(item.astype(np.int64)), pa.array(n)], names=["item", "n"])

    crowded = classes.select("size", "items").mapInArrow(prefixes, "item bigint, n bigint").groupBy("item").agg(F.sum("n").alias("n"))
    cuts = cut(crowded.where(F.col("n") > BLOCK).select("item", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    routed = classes.select("record", "size", "items").mapInArrow(lambda batches: _route(batches, threshold), "item bigint, record bigint, size int, place int, rest binary")
    routed = routed.join(F.broadcast(cuts) if cuts.count() <= SMALL else cuts, "item", "left")
    # A set of a crowded partition goes to each pair of blocks that its own block takes part in.
    own = F.pmod(F.xxhash64("record"), F.col("blocks")).cast("int")
    together = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.least(own, k).cast("bigint") * F.col("blocks") + F.greatest(own, k))
    pair = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(together)).alias("pair")
    routed = routed.select("item", pair, "record", "size", "place", "rest")
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-postings // TASK))
    placed = routed.repartition(tasks, "item", "pair").sortWithinPartitions("item", "pair", "size", "record")
    pairs = cut(placed.mapInArrow(lambda batches: _join(batches, threshold), "a bigint, b bigint").distinct())

    # Equal sets are expanded at the end. Members of a large class are dealt to shares, so that no task pairs all of them.
    shared = classes.where("n > 1").select("items", F.col("record").alias("class"), F.ceil(F.col("n") / SHARE).cast("int").alias("shares"))
    dealt = F.pmod(F.xxhash64("record"), F.col("shares")).cast("int").alias("share")
    members = cut(sets.join(shared, "items").select("class", dealt, "shares", F.col("record").alias("member")))
    sizes = classes.where("n > 1").select(F.col("record").alias("class"), F.ceil(F.col("n") / SHARE).cast("int").alias("shares"))
    every = F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)).alias("share")

    def expanded(rows: DataFrame, side: str) -> DataFrame:
        spread = rows.join(sizes.withColumnRenamed("class", side), side, "left").select("a", "b", F.col("shares").isNull().alias("_one"), every)
        named = members.select(F.col("class").alias(side), "share", F.col("member"))
        # A record that is a class of its own has no members; an empty share of a larger one gives nothing.
        return spread.join(named, [side, "share"], "left").where("_one OR member IS NOT NULL").withColumn(side, F.coalesce("member", side)).select("a", "b")

    across = expanded(expanded(pairs, "a"), "b").select(F.col("a").alias("x"), F.col("b").alias("y"))
    left, right = members.select("class", "share", F.col("member").alias("x")), members.select("class", every, F.col("member").alias("y"))
    within = left.join(right, ["class", "share"]).where("x < y").select("x", "y")
    kind = df.schema[record].dataType
    return across.unionByName(within).select(F.least("x", "y").cast(kind).alias("a"), F.greatest("x", "y").cast(kind).alias("b"))

"""Items that appear together: packed 64-bit pair codes, sorted runs, merge, run-length count, odds ratios.

Records become sorted baskets of distinct items. Each task writes its baskets' pairs as 64-bit codes, block by block:
a block is sorted and run-length counted to a run, and runs are merged as they pile up. Only the merged runs, as packed
differences and counts, are shuffled, by ranges of the code, as many as the counted pairs ask for; the reduce side merges
the runs of a range as streams: a code is given out as soon as all runs have passed it. A large record's pairs are cut
to slices that go to different tasks.
The first item's code is scattered by an odd multiplier before packing, so that ranges are even and hot items spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloop.llm.packed import merge_runs, pack, run_lengths, unpack
from feedloop.session import cut

#: Pair codes in a block, codes that a task keeps in merged runs, entries of a packed row: bounds on memory.
BLOCK, HELD, ROW = 4_000_000, 8_000_000, 1 << 16
#: Ranges of the code space that the reduce side works off one by one: one for so many pairs, between these numbers.
PAIRS, RANGES, MOST_RANGES = 1 << 26, 256, 1 << 20
#: Items from which on a record's pairs are cut to slices.
LARGE = 4096
#: Stands for the item of a row that has none, so that its record is counted.
NONE = 1 << 31
_ODD = 0x9E3779B1
_BACK = pow(_ODD, -1, 1 << 32)
_LOW = 0xFFFFFFFF


def _dedupe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(record << 32 | item) once for each input partition's block: repeated visits don't reach the shuffle."""
    held, count = [], 0
    for b in batches:
        held.append(b.column(0).to_numpy(zero_copy_only=False))
        count += b.num_rows
        if count >= BLOCK:
            yield _split(np.unique(np.concatenate(held)))
            held, count = [], 0
    if held:
        yield _split(np.unique(np.concatenate(held)))


def _split(code: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array((code >> 32).astype(np.int32)), pa.array(code)], names=["_r", "_code"])


def _basket_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted codes of whole records, packed some ROW entries a row. Input: codes sorted within the partition."""
    rest = np.empty(0, np.int64)
    for b in batches:
        code = np.concatenate((rest, b.column(0).to_numpy(zero_copy_only=False)))
        if not len(code):
            continue
        code = code[np.concatenate(([True], code[1:] != code[:-1]))]
        # The last record may go on in the next batch.
        ends = np.searchsorted(code, (code[-1] >> 32) << 32, "left")
        if ends < ROW:
            rest = code
            continue
        yield from _rows(code[:ends])
        rest = code[ends:]
    if len(rest):
        yield from _rows(rest)


def _rows(code: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows ``(block, low, high, sliced)``: whole records, whose entries from low to high are to be paired with all later ones."""
    out: list[tuple[bytes, int, int, bool]] = []
    record = code >> 32
    first = np.flatnonzero(np.concatenate(([True], record[1:] != record[:-1])))
    ends = np.append(first[1:], len(code))
    large = np.flatnonzero(ends - first > LARGE)
    start = 0
    for stop, end in [*zip(first[large].tolist(), ends[large].tolist(), strict=True), (len(code), len(code))]:
        while start < stop:  # records of common size, together
            last = min(start + ROW, stop)
            if last < stop:  # a record stays whole, so its block may be longer
                last = int(np.searchsorted(code, ((code[last - 1] >> 32) + 1) << 32, "left"))
            out.append((pack(code[start:last]), 0, last - start, False))
            start = last
        if end > stop:  # a large record: slices of about BLOCK pairs
            n, blob = end - stop, pack(code[stop:end])
            upto = np.cumsum(np.arange(n - 1, -1, -1))
            cuts = np.unique(np.searchsorted(upto, np.arange(0, int(upto[-1]), BLOCK), "left")).tolist()
            out += [(blob, low, high, True) for low, high in zip([0, *cuts[1:]], [*cuts[1:], n], strict=True)]
            start = end
    for k in range(0, len(out), 64):
        columns = zip(zip(*out[k : k + 64], strict=True), (pa.binary(), pa.int32(), pa.int32(), pa.bool_()), strict=True)
        yield pa.record_batch([pa.array(c, t) for c, t in columns], names=["block", "low", "high", "sliced"])


def baskets(df: DataFrame, record: str, item: str, bare: bool = False) -> DataFrame:
    """``(block, low, high, sliced)``: packed sorted codes (record << 32 | item) of whole records, each item once; checkpointed.

    A large record comes in several rows, each with the slice of entries whose pairs it stands for; low is 0 in the first.
    Rows with a null record or item don't count; bare: a record without an item is kept, with the item NONE. Both must be
    whole numbers from 0 to 2**31 - 1.
    """
    for name in (record, item):
        if not isinstance(df.schema[name].dataType, T.IntegralType):
            raise TypeError(f"{name} must be a whole-number column")
    rows = df.where(F.col(record).isNotNull() if bare else F.col(record).isNotNull() & F.col(item).isNotNull())
    fits = F.col(record).between(0, 0x7FFFFFFF) & F.coalesce(F.col(item).between(0, 0x7FFFFFFF), F.lit(bare))
    code = F.shiftleft(F.col(record).cast("bigint"), 32).bitwiseOR(F.coalesce(F.col(item).cast("bigint"), F.lit(NONE)))
    code = F.when(fits, code).otherwise(F.raise_error(F.lit("codes must lie between 0 and 2147483647")).cast("bigint"))
    once = rows.select(code.alias("_code")).mapInArrow(_dedupe, "_r int, _code bigint")
    # The codes are sorted by record first, so a sort within the partitions brings records together.
    return cut(once.repartition("_r").sortWithinPartitions("_code").select("_code").mapInArrow(_basket_blocks, "block binary, low int, high int, sliced boolean"))


def _codes_of(batches: Iterator[pa.RecordBatch], bare: bool = False) -> Iterator[np.ndarray]:
    """The codes of whole records, each record once; without the items NONE, or with them."""
    for b in batches:
        for blob, low in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            if low == 0:
                code = unpack(blob.as_py(), 1)[0]
                yield code if bare else code[(code & _LOW) != NONE]


def _slices_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int, int]]:
    for b in batches:
        for blob, low, high in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            yield unpack(blob.as_py(), 1)[0], low, high


def size_of(blocks: DataFrame) -> tuple[int, int]:
    """(records, pairs of items in them, each record's counted)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = pairs = 0
        for code in _codes_of(batches, bare=True):
            record = code >> 32
            records += 1 + int((record[1:] != record[:-1]).sum())
            first = np.flatnonzero(np.concatenate(([True], record[1:] != record[:-1])))
            m = np.diff(np.append(first, len(record)))
            pairs += int((m * (m - 1) // 2).sum())
        yield pa.record_batch([pa.array([records]), pa.array([pairs])], names=["records", "pairs"])

    found = blocks.mapInArrow(count, "records bigint, pairs bigint").agg(F.sum("records"), F.sum("pairs")).first()
    return found[0] or 0, found[1] or 0


def item_counts(blocks: DataFrame) -> DataFrame:
    """``(item, n_item)``: records that hold the item."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[tuple[np.ndarray, np.ndarray]] = []
        for code in _codes_of(batches):
            runs.append(run_lengths(code & _LOW))
            if sum(len(r[0]) for r in runs) > BLOCK:
                runs = [merge_runs(runs)]
        if runs:
            items, n = merge_runs(runs)
            yield pa.record_batch([pa.array(items), pa.array(n)], names=["item", "n"])

    return blocks.mapInArrow(count, "item bigint, n bigint").groupBy("item").agg(F.sum("n").alias("n_item"))


def _pair_codes(code: np.ndarray, low: int, high: int) -> Iterator[np.ndarray]:
    """Codes of the pairs of each record whose first entry lies in the slice, in blocks of about BLOCK."""
    record, item = code >> 32, code & _LOW
    none = item == NONE  # the last entry of its record
    first = np.concatenate(([True], record[1:] != record[:-1]))
    at = np.flatnonzero(first)
    end = np.repeat(np.append(at[1:], len(code)), np.diff(np.append(at, len(code))))
    later = end - np.arange(len(code)) - 1 - none[end - 1]  # partners of each entry
    later[none] = 0
    later[:low] = later[high:] = 0
    spread = ((item * _ODD) & _LOW) << 31  # items are below 2**31, so that a code is not negative
    upto = np.cumsum(later)
    start, done = low, 0
    while start < high:
        stop = max(start + 1, min(high, int(np.searchsorted(upto, done + BLOCK, "right"))))
        n = later[start:stop]
        total = int(n.sum())
        if total:
            left = np.repeat(np.arange(start, stop), n)
            right = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + left + 1
            yield spread[left] | item[right]
        done, start = int(upto[stop - 1]), stop


def _unpair(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ((code >> 31) * _BACK) & _LOW, code & 0x7FFFFFFF


class _Merge:
    """Runs of one range, merged as streams: pieces come by their first code, so that all codes below it are complete."""

    def __init__(self, least: int) -> None:
        self.least = least
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = self.merged = 0

    def add(self, first: int, piece: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        self.runs.append(piece)
        self.held += len(piece[0])
        # Merged when as much again has come in, so that each code is sorted a few times at most.
        if self.held > max(HELD // 4, 2 * self.merged):
            codes, counts = merge_runs(self.runs)
            at = int(np.searchsorted(codes, first, "left"))
            yield from self._given_out(codes[:at], counts[:at])
            self.runs = [(codes[at:], counts[at:])]
            self.held = self.merged = len(codes) - at

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.runs:
            yield from self._given_out(*merge_runs(self.runs))

    def _given_out(self, codes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        often = counts >= self.least
        codes, counts = codes[often], counts[often]
        for k in range(0, len(codes), 1 << 17):
            a, b = _unpair(codes[k : k + (1 << 17)])
            yield pa.record_batch([pa.array(a), pa.array(b), pa.array(counts[k : k + (1 << 17)])], names=["a", "b", "n_ab"])


def pair_counts(blocks: DataFrame, pairs: int, least: int = 1) -> DataFrame:
    """``(a, b, n_ab)``, a < b: records that hold both items, for every pair found in at least so many records.

    pairs: how many the records hold (see size_of); sets the number of ranges.
    """
    ranges = min(max(RANGES, -(-pairs // PAIRS)), MOST_RANGES)

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[tuple[np.ndarray, np.ndarray]] = []
        small: list[np.ndarray] = []
        waiting = held = 0
        for code, low, high in _slices_of(batches):
            for found in _pair_codes(code, low, high):
                small.append(found)
                waiting += len(found)
                if waiting < BLOCK:
                    continue
                runs.append(run_lengths(np.concatenate(small)))
                small, waiting = [], 0
                held += len(runs[-1][0])
                if held > HELD and len(runs) > 1:
                    runs = [merge_runs(runs)]
                    held = len(runs[0][0])
                    if held > HELD:  # too many different pairs to keep: this run is spilled to the shuffle
                        yield from _shuffle_rows(*runs[0], ranges)
                        runs, held = [], 0
        if small:
            runs.append(run_lengths(np.concatenate(small)))
        if runs:
            yield from _shuffle_rows(*merge_runs(runs), ranges)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own = None, _Merge(least)
        for b in batches:
            for part, first, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if part != current:
                    yield from own.rest()
                    current, own = part, _Merge(least)
                yield from own.add(first, tuple(unpack(blob.as_py(), 2)))
        yield from own.rest()

    one, many = blocks.where("NOT sliced"), blocks.where("sliced")
    schema = "part int, first bigint, run binary"
    runs = one.mapInArrow(runs_of, schema).unionByName(many.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(runs_of, schema))
    return runs.repartition("part").sortWithinPartitions("part", "first").mapInArrow(merge, "a bigint, b bigint, n_ab bigint")


def _shuffle_rows(codes: np.ndarray, counts: np.ndarray, ranges: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a run, by range: ``(range, first code, packed codes and counts)``."""
    step = (1 << 63) // ranges + 1
    if not len(codes):
        return
    parts = codes // step
    at = np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1]))).tolist() + [len(codes)]
    for begin, end in zip(at, at[1:], strict=False):
        for a in range(begin, end, ROW):
            z = min(a + ROW, end)
            columns = [pa.array([int(parts[a])], pa.int32()), pa.array([int(codes[a])]), pa.array([pack(codes[a:z], counts[a:z])], pa.binary())]
            yield pa.record_batch(columns, names=["part", "first", "run"])


def associations(df: DataFrame, record: str, item: str, least: int = 1) -> DataFrame:
    """``(a, b, n_ab, n_a, n_b, n, lift, log_odds)`` of all item pairs a < b that occur together in `least` records.

    n: distinct non-null records, also those without an item. lift: n_ab * n / (n_a * n_b). log_odds: log of the odds
    ratio of the 2x2 table with 1/2 added to each cell (continuity correction), so that empty cells give finite values.
    An item counts once for a record; null records and items don't count. Other columns are ignored.
    """
    blocks = baskets(df, record, item, bare=True)
    counts = item_counts(blocks)
    n, total = size_of(blocks)
    pairs = pair_counts(blocks, total, least).withColumn("n", F.lit(n).cast("bigint"))
    pairs = pairs.join(counts.select(F.col("item").alias("a"), F.col("n_item").alias("n_a")), "a")
    pairs = pairs.join(counts.select(F.col("item").alias("b"), F.col("n_item").alias("n_b")), "b")
    both, only_a, only_b = F.col("n_ab") + 0.5, F.col("n_a") - F.col("n_ab") + 0.5, F.col("n_b") - F.col("n_ab") + 0.5
    none = F.col("n") - F.col("n_a") - F.col("n_b") + F.col("n_ab") + 0.5
    kind = df.schema[item].dataType
    return pairs.select(
        F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "n_ab", "n_a", "n_b", "n",
        (F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))).alias("lift"),
        F.ln(both * none / (only_a * only_b)).alias("log_odds"),
    )

"""Per-key results where a few keys hold most records: exact offset chunking.

Rows are thought of in the order (key, input partition, place in the partition). Counting keys and summing the counts
up gives every key its offset in that order, hence every row a number, and rows number c*size to (c+1)*size-1 form
chunk c, whichever keys they belong to. Only the keys that a chunk border falls into are looked up in the finer counts
(per input partition), and there are at most as many of them as borders; so the table that numbers the rows is bounded
by the number of chunks, a parameter, and not by keys or rows. Several key columns are chunked together, one after the
other, so that the table is read twice, however many there are: once to count, once to number. States of a chunk are
merged in the order of the input partitions, and those of a key that reaches over borders in the order of the chunks;
so sums of doubles come out the same on every run over the same files.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloop.operators.prefix import sums_before
from feedloop.session import cut

#: Chunks that all rows are cut into; bounds the borders sent to the tasks (a few dozen bytes each).
CHUNKS = 240


@dataclass(frozen=True)
class Borders:
    """Where chunks 1, 2, ... begin: key, input partition and place among that key's rows of that partition."""

    key: np.ndarray
    part: np.ndarray
    place: np.ndarray

    def chunk(self, key: np.ndarray, part: int, seen: dict[int, int]) -> np.ndarray:
        """The chunk of each row. seen: rows so far, by border key, of this partition; brought up to date."""
        low, high = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        out = low.astype(np.int64)
        split = np.flatnonzero(high > low)
        if not len(split):
            return out
        order = split[np.argsort(key[split], kind="stable")]
        first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        for a, b in zip(first, [*first[1:], len(order)], strict=True):
            k = int(key[order[a]])
            lo, hi = int(low[order[a]]), int(high[order[a]])
            place = seen.get(k, 0) + np.arange(b - a)
            seen[k] = seen.get(k, 0) + b - a
            before = self.part[lo:hi] < part
            here = self.place[lo:hi][self.part[lo:hi] == part]
            out[order[a:b]] = lo + int(before.sum()) + np.searchsorted(here, place, "right")
        return out


def part_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """``(_field, _key, _part, _n)``: rows of each key (null included) of each key column in each input partition; checkpointed."""
    cells = F.posexplode(F.array(*(F.col(k).cast("bigint") for k in keys))).alias("_field", "_key")
    return cut(df.select(F.spark_partition_id().alias("_part"), cells).groupBy("_field", "_key", "_part").agg(F.count("*").alias("_n")))


def borders(counts: DataFrame, fields: int, chunks: int) -> list[tuple[Borders, int]]:
    """For each field: the chunk borders that fall into it, and the chunks that begin before it."""
    whole = counts.where("_key IS NOT NULL")
    placed = sums_before(whole.groupBy("_field", "_key").agg(F.sum("_n").alias("_n")), ["_field", "_key"], "_n", settled=True)
    total = placed.agg(F.max(F.col("_before") + F.col("_n"))).first()[0] or 0
    size = max(1, -(-total // chunks))
    # A key is cut where a multiple of the size falls among its rows; a border at its first row needs no finer counts.
    first, last = F.ceil(F.col("_before") / size), F.floor((F.col("_before") + F.col("_n") - 1) / size)
    hit = placed.where(first <= last).select("_field", "_key", "_before", first.alias("_first"), last.alias("_last")).collect()
    inner = [(r["_field"], r["_key"], r["_before"]) for r in hit if r["_last"] * size > r["_before"]]
    found = [(r["_field"], r["_key"], -1, 0) for r in hit if r["_first"] and r["_first"] * size == r["_before"]]
    if inner:
        marked = F.broadcast(counts.sparkSession.createDataFrame(inner, "_field int, _key bigint, _before bigint"))  # a key for each border at most
        earlier = Window.partitionBy("_field", "_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        at = (
            whole.join(marked, ["_field", "_key"])
            .withColumn("_from", F.col("_before") + F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
            .withColumn("_lo", F.ceil(F.col("_from") / size))
            .withColumn("_hi", F.floor((F.col("_from") + F.col("_n") - 1) / size))
            .where("_lo <= _hi")
            .withColumn("_c", F.explode(F.sequence("_lo", "_hi")))
        )
        found += [
            (r["_field"], r["_key"], r["_part"], r["_c"] * size - r["_from"])
            for r in at.where((F.col("_c") * size > F.col("_before")) & (F.col("_c") > 0)).collect()
        ]
    found.sort()
    out = []
    for field in range(fields):
        k, p, i = (np.array([f[x] for f in found if f[0] == field], dtype=np.int64) for x in (1, 2, 3))
        out.append((Borders(k, p, i), sum(f[0] < field for f in found)))
    return out


_STATE = "_field int, _key bigint, _chunk bigint, _part int, _seq int, _rows bigint, _n bigint, _sum double"


def _states(df: DataFrame, keys: list[str], value: str, found: list[tuple[Borders, int]]) -> DataFrame:
    """Each task's states of its rows, by key and chunk: one row from each batch, one from each task for keys with a border in them."""
    cuts = df.sparkSession.sparkContext.broadcast(found)
    columns = [c.split()[0] for c in _STATE.split(", ")]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[dict[int, int]] = [{} for _ in keys]
        kept: dict[tuple[int, int, int], list] = {}
        part = 0
        for seq, b in enumerate(batches):
            if not b.num_rows:
                continue
            part = b.column(len(keys) + 1)[0].as_py()
            values = b.column(len(keys)).to_numpy(zero_copy_only=False).astype(np.float64)
            for field, (border, base) in enumerate(cuts.value):
                there = b.column(field).is_valid().to_numpy(zero_copy_only=False)
                k, v = b.column(field).drop_null().to_numpy(zero_copy_only=False), values[there]
                if not len(k):
                    continue
                chunk = base + border.chunk(k, part, seen[field])
                order = np.lexsort((chunk, k))
                k, chunk, v = k[order], chunk[order], v[order]
                start = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (chunk[1:] != chunk[:-1])])
                good = ~np.isnan(v)
                rows = np.diff(np.r_[start, len(k)])
                k, chunk = k[start], chunk[start]
                n, sums = np.add.reduceat(good.astype(np.int64), start), np.add.reduceat(np.where(good, v, 0.0), start)
                cut_key = np.isin(k, border.key)
                for row in zip(*(x[cut_key].tolist() for x in (k, chunk, rows, n, sums)), strict=True):
                    own = kept.setdefault((field, row[0], row[1]), [0, 0, 0.0])
                    own[0], own[1], own[2] = own[0] + row[2], own[1] + row[3], own[2] + row[4]
                rest = ~cut_key
                m = int(rest.sum())
                if m:
                    cols = (np.full(m, field), k[rest], chunk[rest], np.full(m, part), np.full(m, seq), rows[rest], n[rest], sums[rest])
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=columns)
        if kept:
            cols = zip(*((f, k, c, part, -1, *own) for (f, k, c), own in sorted(kept.items())), strict=True)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=columns)

    rows = df.select(*(F.col(k).cast("bigint").alias(f"_k{j}") for j, k in enumerate(keys)), F.col(value).cast("double").alias("_v"), F.spark_partition_id().alias("_p"))
    return rows.mapInArrow(number, _STATE)


def _merged(states: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """States added up in this order."""
    inside = F.array_sort(F.collect_list(F.struct(*order, "_sum")))
    out = states.groupBy(*by).agg(F.sum("_rows").alias("_rows"), F.sum("_n").alias("_n"), inside.alias("_s"))
    return out.withColumn("_sum", F.aggregate("_s", F.lit(0.0), lambda a, x: a + x["_sum"])).drop("_s")


def field_states(df: DataFrame, keys: list[str], value: str, chunks: int = CHUNKS) -> tuple[DataFrame, int]:
    """(``(_field, _chunk, _key, _rows, _n, _sum)`` for each chunk and each key in it, rows of df). _field is the place of the key column."""
    counts = part_counts(df, keys)
    total = counts.where("_field = 0").agg(F.sum("_n")).first()[0] or 0
    found = borders(counts, len(keys), chunks * len(keys))
    return _merged(_states(df, keys, value, found), ["_field", "_key", "_chunk"], ["_part", "_seq"]), total


def chunked_states(df: DataFrame, key: str, value: str, chunks: int = CHUNKS) -> DataFrame:
    """``(_chunk, _key, _rows, _n, _sum)``: for each chunk and each key in it, its rows, and the values' count and sum.

    Rows with a null key belong to no key. Null and NaN values count as rows only. A task turns its rows to states
    before the shuffle, so that a chunk of one hot key arrives as one row from each task.
    """
    return field_states(df, [key], value, chunks)[0].drop("_field")


def fields_means(df: DataFrame, keys: list[str], value: str, chunks: int = CHUNKS) -> tuple[DataFrame, int]:
    """(``(field, code, n_rows, n_values, mean_value)`` of every non-null key of every key column, rows of df); codes as bigint."""
    states, total = field_states(df, keys, value, chunks)
    merged = _merged(states, ["_field", "_key"], ["_chunk"])
    name = F.element_at(F.array(*map(F.lit, keys)), F.col("_field") + 1)
    mean = F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n"))
    return merged.select(name.alias("field"), F.col("_key").alias("code"), F.col("_rows").alias("n_rows"), F.col("_n").alias("n_values"), mean.alias("mean_value")), total


def key_means(df: DataFrame, key: str, value: str, chunks: int = CHUNKS) -> DataFrame:
    """``(key, n_rows, n_values, mean_value)`` of every non-null key; no key holds a task up, however many rows it has.

    mean_value is over values that are neither null nor NaN, and null where a key has none. An empty frame gives no
    rows; other columns, whatever their names, are ignored.
    """
    rows = fields_means(df.select(F.col(key).alias("_k"), F.col(value).alias("_w")), ["_k"], "_w", chunks)[0]
    return rows.select(F.col("code").cast(df.schema[key].dataType).alias(key), "n_rows", "n_values", "mean_value")


def heavy_keys(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """``(field, code)``: the keys of each field that hold more than this share of all rows, null keys' rows included.

    Code has the widest of the key columns' types.
    """
    rows, total = fields_means(df, keys, value)
    kind = max((df.schema[k].dataType for k in keys), key=lambda t: ("tinyint", "smallint", "int", "bigint").index(t.simpleString()))
    return rows.where(F.col("n_rows") > share * total).select("field", F.col("code").cast(kind).alias("code"))

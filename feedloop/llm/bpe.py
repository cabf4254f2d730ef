"""Encoding of a corpus with a public byte-level BPE tokenizer, and decoding by the offsets kept.

Texts are cut to pieces by ``pretokenize``; each distinct piece is merged once (pairs of lowest rank first) and then
comes from a cache, and the ids of a batch are put together as arrays.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloop.llm.pretokenize import piece_starts

#: Where the public vocabularies lie by default.
FOLDER = "/opt/tokenizers"
BYTE_BPE_50K = f"{FOLDER}/byte_bpe_50k.tiktoken"
#: Codepoints that are worked on together, distinct pieces and ids kept in the cache: bounds on memory.
TOGETHER, PIECES, IDS = 1_000_000, 400_000, 8_000_000
#: Pieces up to so many bytes are merged by plain search, longer ones with a heap.
SHORT = 40
#: A noncharacter that separates pieces while a batch is cut.
_MARK = 0x10FFFF


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Merger(dict):
    """Piece -> number; ids of number k are flat[starts[k]:starts[k + 1]]. Missing pieces are merged and kept."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.ranks = load_ranks(path)
        self.lengths = np.zeros(max(self.ranks.values()) + 1, np.int32)
        for token, rank in self.ranks.items():
            self.lengths[rank] = len(token)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.starts, self.flat = array("q", [0]), array("i")

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self.starts) - 1
        self.flat.extend(self.merge(piece.encode("utf-8", "surrogatepass")))
        self.starts.append(len(self.flat))
        return number

    def merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > SHORT:
            return self._merge_long(piece)
        parts = [piece[k : k + 1] for k in range(len(piece))]
        none = len(ranks)
        pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            k = pairs.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k < len(pairs):
                pairs[k] = ranks.get(parts[k] + parts[k + 1], none)
            if k:
                pairs[k - 1] = ranks.get(parts[k - 1] + parts[k], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same for long pieces: candidates in a heap, parts as a linked list; stale candidates are passed over."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # part that begins at k: piece[k:end[k]]; 0 where none does
        before = list(range(-1, n - 1))
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(piece[k : k + 2])) is not None]
        heapify(heap)
        while heap:
            _, k, stop = heappop(heap)
            middle = end[k]
            if not middle or middle >= n or end[middle] != stop:
                continue
            end[k], end[middle] = stop, 0
            if stop < n:
                before[stop] = k
                if (r := ranks.get(piece[k : end[stop]])) is not None:
                    heappush(heap, (r, k, end[stop]))
            if (b := before[k]) >= 0 and (r := ranks.get(piece[b:stop])) is not None:
                heappush(heap, (r, b, stop))
        out, k = [], 0
        while k < n:
            out.append(ranks[piece[k : end[k]]])
            k = end[k]
        return out

    def encode(self, text: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts written one after another, and how many ids precede each text. starts: where texts begin, in
        codepoints; empty texts begin where the next one does."""
        if len(self) > PIECES or len(self.flat) > IDS:
            self.forget()
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        real = np.unique(starts[starts < len(points)])
        cuts = piece_starts(points, real)
        if not len(cuts):
            return np.empty(0, np.int32), np.zeros(len(starts), np.int64)
        if (points == _MARK).any():
            stops = np.append(cuts[1:], len(points)).tolist()
            pieces = [text[a:b] for a, b in zip(cuts.tolist(), stops, strict=True)]
        else:
            marked = np.empty(len(points) + len(cuts) - 1, np.uint32)
            at = cuts[1:] + np.arange(len(cuts) - 1)
            keep = np.ones(len(marked), bool)
            keep[at] = False
            marked[at], marked[keep] = _MARK, points
            pieces = marked.tobytes().decode("utf-32-le", "surrogatepass").split(chr(_MARK))
        number = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        # Views of the cache, not copies; they are gone when it grows again.
        first, flat = np.frombuffer(self.starts, np.int64), np.frombuffer(self.flat, np.int32)
        size = first[number + 1] - first[number]
        upto = np.cumsum(size)
        ids = flat[np.repeat(first[number] - (upto - size), size) + np.arange(upto[-1])]
        return ids, np.append(0, upto)[np.searchsorted(cuts, starts, "left")]


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    """One for each worker process."""
    return Merger(path)


def _texts(column: pa.Array) -> Iterator[tuple[int, int, str, np.ndarray]]:
    """(first row, rows, texts in one string, where each begins) for a few rows at a time; null is as empty."""
    values = column.to_pylist()
    held: list[str] = []
    first = size = 0
    for k, text in enumerate(values):
        held.append(text or "")
        size += len(held[-1])
        if size >= TOGETHER or k + 1 == len(values):
            starts = np.cumsum([0, *map(len, held)])[:-1]
            yield first, len(held), "".join(held), starts
            first, held, size = k + 1, [], 0


def encode(df: DataFrame, key: str, text: str, path: str = BYTE_BPE_50K, offsets: bool = False) -> DataFrame:
    """``(key, ids)``: the token ids of every text, without special tokens; one row for each row of df.

    Strings that look like control tokens are plain text. Null and empty texts give an empty list. Keys may be null or
    repeated. With offsets, ``offsets`` has the byte at which each token begins in the text's UTF-8 form, by which any
    span of tokens can be cut from the text; bytes of one character may fall to two tokens. Other columns are ignored.
    """
    kind = df.schema[key].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(path)
        for b in batches:
            for first, rows, joined, starts in _texts(b.column(1)):
                ids, before = own.encode(joined, starts)
                edges = pa.array(np.append(before, len(ids)), pa.int32())
                out = [b.column(0).slice(first, rows), pa.ListArray.from_arrays(edges, pa.array(ids, pa.int32()))]
                if offsets:
                    length = own.lengths[ids].astype(np.int64)
                    begin = np.cumsum(length) - length
                    base = np.append(begin, 0)[np.minimum(before, len(begin))] if len(ids) else before
                    begin -= np.repeat(base, np.diff(np.append(before, len(ids))))
                    out.append(pa.ListArray.from_arrays(edges, pa.array(begin, pa.int32())))
                yield pa.record_batch(out, names=["_key", "ids", "offsets"][: len(out)])

    schema = f"_key {kind}, ids array<int>" + ", offsets array<int>" * offsets
    return df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(kernel, schema).withColumnRenamed("_key", key)


def count(df: DataFrame, keys: list[str], text: str, path: str = BYTE_BPE_50K) -> DataFrame:
    """The given columns and ``n_tokens``, the number of ids of the text; 0 for null and empty texts."""
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(path)
        for b in batches:
            for first, rows, joined, starts in _texts(b.column(0)):
                ids, before = own.encode(joined, starts)
                n = pa.array(np.diff(np.append(before, len(ids))))
                yield pa.record_batch([*(c.slice(first, rows) for c in b.columns[1:]), n], names=[*keys, "n_tokens"])

    return df.select(F.col(text).alias("_text"), *keys).mapInArrow(kernel, f"{fields}, n_tokens bigint")


def decode(df: DataFrame, key: str, ids: str = "ids", path: str = BYTE_BPE_50K) -> DataFrame:
    """``(key, text)`` of token ids; an empty list gives an empty text, null gives null."""
    kind = df.schema[key].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {rank: raw for raw, rank in merger(path).ranks.items()}
        for b in batches:
            texts = [None if x is None else b"".join(map(token.__getitem__, x)).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], names=["_key", "text"])

    return df.select(F.col(key).alias("_key"), F.col(ids).alias("_ids")).mapInArrow(kernel, f"_key {kind}, text string").withColumnRenamed("_key", key)

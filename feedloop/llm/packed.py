"""Sorted runs of 64-bit codes with counts, and their compact form for a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_NONE = np.empty(0, np.int64)


def run_lengths(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct codes of codes (which this sorts) and how often each occurs, or the sum of its counts."""
    if not len(codes):
        return _NONE, _NONE
    if counts is None:
        codes.sort()
        first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        return codes[first], np.diff(np.append(first, len(codes)))
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.add.reduceat(counts[order], first)


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted run out of many, counts of equal codes added; the stable sort merges runs that are sorted already."""
    if len(runs) == 1:
        return runs[0]
    return run_lengths(np.concatenate([r[0] for r in runs] or [_NONE]), np.concatenate([r[1] for r in runs] or [_NONE]))


def _planes(values: np.ndarray) -> bytes:
    """The values byte by byte, all lowest bytes first, which makes the upper ones compress to nothing."""
    raw = np.ascontiguousarray(values.astype(np.uint64)).view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(raw.T).tobytes()


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length, non-negative; the first must be sorted and is kept as differences."""
    first = np.diff(columns[0], prepend=0)
    body = b"".join(map(_planes, (first, *columns[1:])))
    return len(first).to_bytes(4, "little") + pa.compress(body, codec="zstd", asbytes=True)


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    body = np.frombuffer(pa.decompress(blob[4:], n * 8 * columns, codec="zstd", asbytes=True), np.uint8)
    out = []
    for k in range(columns):
        planes = body[k * 8 * n : (k + 1) * 8 * n].reshape(8, n)
        out.append(np.ascontiguousarray(planes.T).view(np.int64).reshape(-1))
    if columns:
        out[0] = np.cumsum(out[0])
    return out

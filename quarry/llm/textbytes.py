"""Arrow text columns as numpy byte arrays, and rolling hashes over them, for operators that run inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def rows_as_bytes(column: pa.Array, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` bytes: (first row, bytes, row offsets into them). Null is empty; a longer row stands alone."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        yield row, raw[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse ** i modulo 2 ** 64, for i below at least ``n``."""
    if len(_powers.get("up", ())) < n:
        n = max(n, 1 << 20)
        inverse = U(pow(int(BASE), -1, 1 << 64))
        for name, step in (("up", BASE), ("down", inverse)):
            a = np.full(n, step, U)
            a[0] = 1
            _powers[name] = np.cumprod(a, dtype=U)
    return _powers["up"], _powers["down"]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """P with (P[e] - P[s]) * BASE ** s the hash of data[s:e], the same wherever the bytes stand."""
    _, down = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * down[: len(data)], out=out[1:])
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """Bit mixer of 64-bit values."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values, by prefix and suffix minima of blocks."""
    n = len(values)
    if n < width:
        return values[:0]
    pad = -n % width
    blocks = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])

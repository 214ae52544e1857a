"""The best rows of many queries at once: blocks of vectors times blocks of queries, with one small table of the best per task.

A block's products only say which pairs may be among the best: those within a margin of the worst row that a query holds so far.
Their scores are then added up dimension by dimension, as ``retrieval.similarity`` does, rounded, and cut to ``k`` by (score
down, id up), so the result does not depend on blocks or partitions. A task holds one block of products, and ``k`` rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of the first and of the largest block, queries of a block, and pairs scored at once.
FIRST, ROWS, QUERIES, PAIRS = 32, 2048, 1024, 65_536
#: Sources whose best score is kept for each query.
SOURCES = 64
#: More than rounding to six decimals can move a score.
MARGIN = 2e-6


def _matrix(listed: pa.Array, at: np.ndarray, dims: int) -> np.ndarray:
    return listed.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dims)


def _sizes(listed: pa.Array) -> np.ndarray:
    return np.array([-1 if n is None else n for n in pa.compute.list_value_length(listed).to_pylist()], np.int64)


def _sum(parts: Iterator[np.ndarray], n: int) -> np.ndarray:
    """The sum in order of the dimensions, as an aggregate over an array has it."""
    total = np.zeros(n)
    for p in parts:
        total = total + p
    return total


def _lengths(m: np.ndarray) -> np.ndarray:
    return np.sqrt(_sum((m[:, d] * m[:, d] for d in range(m.shape[1])), len(m)))


def _score(a: np.ndarray, b: np.ndarray, a_length: np.ndarray, b_length: np.ndarray, metric: str) -> np.ndarray:
    dims = range(a.shape[1])
    if metric == "L2":
        return 1 / (1 + np.sqrt(_sum(((a[:, d] - b[:, d]) * (a[:, d] - b[:, d]) for d in dims), len(a))))
    both = _sum((a[:, d] * b[:, d] for d in dims), len(a))
    if metric == "IP":
        return both
    length = a_length * b_length
    return np.where(length == 0, 0.0, both / np.where(length == 0, 1.0, length))


def rounded(score: np.ndarray) -> np.ndarray:
    """Six decimals, halves of the decimal form away from zero, as Spark rounds a double."""
    out = np.sign(score) * np.floor(np.abs(score) * 1e6 + 0.5) / 1e6
    off = np.where(np.isfinite(score), np.abs(score) * 1e6, 0)
    for i in np.flatnonzero(np.abs(off - np.floor(off) - 0.5) < 1e-3):
        out[i] = float(Decimal(repr(float(score[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return np.where(np.isfinite(score), out, score)


def _codes(values: np.ndarray) -> np.ndarray:
    """Places of the values in their order, null first; equal values share one."""
    if values.dtype != object:
        return values
    place = {v: i for i, v in enumerate(sorted(set(values.tolist()), key=lambda v: (v is not None, v)))}
    return np.fromiter((place[v] for v in values), np.int64, len(values))


def _values(column: pa.Array) -> np.ndarray:
    if column.null_count or not (pa.types.is_integer(column.type)):
        return np.array(column.to_pylist() + [None], object)[:-1]
    return column.to_numpy(zero_copy_only=False)


class _Best:
    """The ``k`` best rows (the first of each source, if asked) of the queries of one length."""

    def __init__(self, q: np.ndarray, k: int, metric: str, source: int | None):
        self.q, self.k, self.metric, self.source = q, k, metric, source
        self.length = _lengths(q)
        self.odd = ~np.isfinite(self.length)
        self.least = np.full(len(q), -np.inf)
        self.of_source: dict = {}
        self.source_best = np.full((SOURCES + 1, 0 if source is None else len(q)), -np.inf)
        self.held: list[tuple] = []
        self.waiting, self.rows = 0, FIRST
        with np.errstate(all="ignore"):
            if metric == "L2":
                self.shaped = np.hstack([q, np.ones((len(q), 1))])
            elif metric == "IP":
                self.shaped = q
            else:
                self.shaped = q / np.where(self.length > 0, self.length, 1)[:, None]
        self.shaped = np.ascontiguousarray(np.nan_to_num(self.shaped, nan=0, posinf=0, neginf=0).T)

    def _limit(self, least: np.ndarray, length: np.ndarray, longest: float) -> np.ndarray:
        """The least product that can reach a score."""
        if self.metric == "COSINE":
            return least - MARGIN
        if self.metric == "IP":
            return least - MARGIN - 1e-12 * length * longest
        near = least - MARGIN
        gap = np.where(near > 0, 1 / np.where(near > 0, near, 1) - 1, np.inf)
        return (length * length - gap * gap) / 2 - 1e-12 * (length * length + longest * longest)

    def add(self, x: np.ndarray, columns: list[np.ndarray], asked: np.ndarray | None) -> None:
        """Rows by their vectors, columns (the id first) and which queries they meet (all by default)."""
        at = 0
        while at < len(x):
            end = min(len(x), at + self.rows)
            self._add(x[at:end], [c[at:end] for c in columns], asked)
            at = end

    def _add(self, x: np.ndarray, columns: list[np.ndarray], asked: np.ndarray | None) -> None:
        length = _lengths(x)
        odd = ~np.isfinite(length)
        longest = float(length[~odd].max(initial=0.0))
        if self.metric == "L2":
            shaped = np.hstack([x, -(length * length)[:, None] / 2])
        elif self.metric == "IP":
            shaped = x
        else:
            shaped = x / np.where(length > 0, length, 1)[:, None]
        shaped = np.nan_to_num(shaped, nan=0, posinf=0, neginf=0)
        place = None
        if self.source is not None:
            sources = columns[self.source].tolist()
            for s in set(sources) - self.of_source.keys():
                if len(self.of_source) < SOURCES:
                    self.of_source[s] = len(self.of_source)
            place = np.array([self.of_source.get(s, SOURCES) for s in sources])
        for lo in range(0, len(self.q), QUERIES):
            hi = min(len(self.q), lo + QUERIES)
            product = shaped @ self.shaped[:, lo:hi]
            limit = self._limit(self.least[lo:hi], self.length[lo:hi], longest)
            if place is not None:
                limit = np.maximum(limit[None, :], self._limit(self.source_best[:, lo:hi], self.length[lo:hi], longest))[place]
            may = ~(product < limit)
            may[odd] = True
            may[:, self.odd[lo:hi]] = True
            if asked is not None:
                may &= asked[lo:hi]
            row, col = np.divmod(np.flatnonzero(may), hi - lo)
            for p in range(0, len(row), PAIRS):
                r, c = row[p : p + PAIRS], col[p : p + PAIRS] + lo
                score = _score(x[r], self.q[c], length[r], self.length[c], self.metric)
                self.held.append((c.astype(np.int32), rounded(score), *(x[r] for x in columns)))
            self.waiting += len(row)
            # The first blocks hold the pairs of many queries that have no limit yet.
            if self.waiting > 2 * self.k * len(self.q):
                self.cut()
        self.rows = min(ROWS, self.rows * 4)

    def cut(self) -> None:
        if not self.held:
            return
        held = [np.concatenate(parts) for parts in zip(*self.held, strict=True)]
        query, score, ids = held[:3]
        # NaN comes first, as Spark has it greatest.
        order = np.lexsort((_codes(ids), -np.where(np.isnan(score), np.inf, score), ~np.isnan(score), query))
        if self.source is not None:
            _, first = np.unique(np.stack([query[order].astype(np.int64), _dense(held[2 + self.source][order])]), axis=1, return_index=True)
            order = order[np.sort(first)]
        start = np.searchsorted(query[order], query[order])
        order = order[np.arange(len(order)) - start < self.k]
        held = [x[order] for x in held]
        self.held = [tuple(held)]
        query, score = held[:2]
        full = np.bincount(query, minlength=len(self.q)) >= self.k
        low = np.full(len(self.q), np.inf)
        np.minimum.at(low, query, np.where(np.isnan(score), np.inf, score))
        self.least = np.where(full, low, -np.inf)
        if self.source is not None:
            at = np.array([self.of_source.get(s, SOURCES) for s in held[2 + self.source].tolist()], np.int64)
            known = at < SOURCES
            np.maximum.at(self.source_best, (at[known], query[known]), np.where(np.isnan(score), np.inf, score)[known])
        self.waiting = 0


def _dense(values: np.ndarray) -> np.ndarray:
    place: dict = {}
    return np.fromiter((place.setdefault(v, len(place)) for v in values.tolist()), np.int64, len(values))


def nearest(rows: DataFrame, asked: DataFrame, k: int, metric: str, source: str | None = None, cell: str | None = None, carry: list[str] = []) -> DataFrame:
    """query_id, vec_id, the columns ``carry`` of the row, score: for every task the ``k`` best rows of each query, of equal lengths only.

    ``rows`` has vec_id and embedding; ``asked`` query_id and q, at most a block that fits every task, and is broadcast. With
    ``source``, one of ``carry``, the first row of each of its values counts. With ``cell`` a row meets only the queries whose
    ``cells`` (a bit a cell) hold its cell, and those of negative cells meet all.
    """
    double = lambda c: F.transform(c, lambda x: x.cast("double")).alias(c)
    held = asked.filter("q is not null").select("query_id", double("q"), *(["cells"] if cell else [])).toArrow()
    shipped = rows.sparkSession.sparkContext.broadcast([c.combine_chunks() for c in held.columns])
    kinds = [T.StructField("query_id", asked.schema["query_id"].dataType), rows.schema["vec_id"], *(rows.schema[c] for c in carry), T.StructField("score", T.DoubleType())]
    names, n_columns = [f.name for f in kinds], 1 + len(carry)
    at_source = 1 + carry.index(source) if source else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_of, listed, *bits = shipped.value
        sizes = _sizes(listed)
        at_of = {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}
        best: dict[int, _Best] = {}
        probes: dict[int, np.ndarray] = {}
        types = []
        for b in batches:
            types = [c.type for c in b.columns[:n_columns]]
            own = _sizes(b.column(n_columns))
            columns = [_values(c) for c in b.columns[:n_columns]]
            cells = b.column(n_columns + 1).to_numpy(zero_copy_only=False) if cell else np.zeros(b.num_rows)
            for n in np.unique(own).tolist():
                if n not in at_of:
                    continue
                if n not in best:
                    best[n] = _Best(_matrix(listed, at_of[n], n), k, metric, at_source)
                    if cell:
                        probes[n] = np.stack([np.frombuffer(bits[0][i].as_py(), np.uint8) for i in at_of[n].tolist()])
                for one in np.unique(cells[own == n]).tolist():
                    here = np.flatnonzero((own == n) & (cells == one))
                    meet = (probes[n][:, one >> 3] >> (one & 7) & 1).astype(bool) if cell and one >= 0 else None
                    with np.errstate(all="ignore"):
                        best[n].add(_matrix(b.column(n_columns), here, n), [c[here] for c in columns], meet)
        for n, found in best.items():
            found.cut()
            for query, score, *columns in found.held:
                for p in range(0, len(query), PAIRS):
                    s = slice(p, p + PAIRS)
                    made = [pa.array(c[s], t) for c, t in zip(columns, types, strict=True)]
                    yield pa.RecordBatch.from_arrays([names_of.take(pa.array(at_of[n][query[s]])), *made, pa.array(score[s])], names=names)

    return rows.select("vec_id", *carry, double("embedding"), *([cell] if cell else [])).mapInArrow(run, T.StructType(kinds))

"""Benchmark decontamination by spaced-seed hashing.

Words (runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lowered) are hashed. Fixed masks pick
some positions of a short span and ignore the others, so a seed survives substitutions at the ignored positions. Seeds
of the benchmark are joined with seeds of every document; around each hit the item is laid over the document at the
hit's diagonal, and words are compared position by position: an item is leaked into a document if some window of
``window`` words (the whole item if shorter) agrees in at least ``similarity`` of its words.

With the default window and similarity, every window of 8 to 13 words that agrees enough holds a seed of some mask. Items
shorter than ``window`` words have contiguous seeds of their own length besides, and those of 5 to 7 words, where one
substitution is allowed, one seed for each position left out. The benchmark is the small side: it is
taken in blocks of at most ``BLOCK_BYTES`` of text (usually one), each sent to the tasks that scan the documents, so a
benchmark of any size is covered by bounded broadcasts; no document text is shuffled.

Defined results: null or empty texts have no words and never match; an item without words matches nothing; repeated
rows are judged alike; null ids are carried as null; extra columns are ignored by
``find_leaks`` and pass through ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import free_name
from quarry.llm.textbytes import U, mixed, powers, prefix_sums, rows_as_bytes

BLOCK_BYTES = 8 << 20
SLICE = 1 << 20
#: Positions that a seed looks at; all others in its span may differ.
MASKS = ((0, 1, 3, 6, 7), (0, 2, 3, 5, 8), (0, 1, 2, 4, 5), (0, 3, 4, 7, 9), (0, 1, 2, 3, 4))
#: Lengths of items for which the masks above leave gaps: one seed for each position left out closes them.
ONE_OUT = range(5, 8)
SCHEMA = "doc_id long, item_id long, n_matched int, n_compared int, similarity double, first_word int"

_WORD = np.zeros(256, np.uint8)
for _r in (range(48, 58), range(97, 123), range(128, 256)):
    _WORD[list(_r)] = list(_r)
_WORD[65:91] = _WORD[97:123]


@dataclass(frozen=True)
class LeakParams:
    window: int = 13
    similarity: float = 0.8


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of consecutive texts, and for each text the index of its first word (one more entry at the end)."""
    low = _WORD[data]
    is_word = low > 0
    begins, ends = is_word.copy(), is_word.copy()
    begins[1:] &= ~is_word[:-1]
    ends[:-1] &= ~is_word[1:]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    begins[edge] = is_word[edge]
    last = offsets[1:] - 1
    last = last[last >= 0]
    ends[last] = is_word[last]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = prefix_sums(low)
    up, _ = powers(len(data) + 1)
    return mixed((sums[e] - sums[s]) * up[s]), np.searchsorted(s, offsets)


def seeds(words: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    """Seed at every start position where the mask's span fits."""
    n = len(words) - mask[-1]
    if n <= 0:
        return words[:0]
    out = np.full(n, (salt + 1) * 0xD6E8FEB86659FD93 % (1 << 64), U)
    for k, o in enumerate(mask):
        out = out * U(0xFF51AFD7ED558CCD) + words[o : o + n] * U(2 * k + 1)
    return mixed(out)


class _Index:
    """Seeds of one benchmark block."""

    def __init__(self, items: list[tuple[int, str | None]], p: LeakParams):
        column = pa.array([t for _, t in items], pa.string())
        self.ids = pa.array([i for i, _ in items], pa.int64())
        words, first = [np.zeros(0, U)], [0]
        for _, data, off in rows_as_bytes(column, SLICE):
            w, at = hashed_words(data, off)
            base = first[-1]
            words.append(w)
            first += [base + int(x) for x in at[1:]]
        self.words, self.first, self.p = np.concatenate(words), np.array(first, np.int64), p
        lengths = np.diff(self.first)
        short = sorted({int(n) for n in lengths if 0 < n < p.window})
        #: Masks with the item length that they serve; 0 is any.
        self.masks = [*((m, 0) for m in MASKS), *((tuple(range(n)), n) for n in short)]
        self.masks += [(tuple(j for j in range(n) if j != i), n) for n in short if n in ONE_OUT for i in range(n)]
        owner = np.repeat(np.arange(len(items)), lengths)
        self.tables = []
        for k, (mask, only) in enumerate(self.masks):
            key = seeds(self.words, mask, k)
            at = np.arange(len(key))
            ok = owner[at] == owner[at + mask[-1]] if len(key) else np.zeros(0, bool)
            if only and len(key):
                ok &= lengths[owner[at]] == only
            key, at = key[ok], at[ok]
            order = np.argsort(key, kind="stable")
            key, at = key[order], at[order]
            sieve = np.zeros(1 << 20, bool)
            sieve[(key >> U(44)).astype(np.int64)] = True
            self.tables.append((mask, key, at, sieve))
        self.owner = owner

    def diagonals(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item, document word index that the item's first word falls on) of every seed hit."""
        for k, (mask, key, at, sieve) in enumerate(self.tables):
            here = seeds(words, mask, k)
            pos = np.flatnonzero(sieve[(here >> U(44)).astype(np.int64)]) if len(key) else np.zeros(0, np.int64)
            lo, hi = np.searchsorted(key, here[pos], "left"), np.searchsorted(key, here[pos], "right")
            n = hi - lo
            pos, lo, n = pos[n > 0], lo[n > 0], n[n > 0]
            if len(pos):
                which = at[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                item = self.owner[which]
                yield item, np.repeat(pos, n) - (which - self.first[item])

    def leaks(self, words: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item index, matched, compared, first word) per verified alignment; ``starts``: each row's first word."""
        found = list(self.diagonals(words))
        if not found:
            return
        item, diag = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
        # A hit may start in one row and end in the next; the row of the diagonal is that of each compared word, below.
        pairs = np.unique(np.stack([item, diag]), axis=1)
        for it, d in pairs.T.tolist():
            a, n = int(self.first[it]), int(self.first[it + 1] - self.first[it])
            lo, hi = max(0, -d), min(n, len(words) - d)
            row_lo = int(np.searchsorted(starts, d + lo, "right")) - 1
            row_hi = int(np.searchsorted(starts, d + hi - 1, "right")) - 1
            for row in range(row_lo, row_hi + 1):
                f, t = max(lo, int(starts[row]) - d), min(hi, int(starts[row + 1]) - d)
                w = min(self.p.window, n)
                if t - f < w:
                    continue
                same = self.words[a + f : a + t] == words[d + f : d + t]
                run = np.cumsum(np.concatenate([[0], same]))
                best = run[w:] - run[:-w]
                if int(best.max()) >= self.p.similarity * w:
                    yield row, it, int(same.sum()), t - f, d + f - int(starts[row])


def find_leaks(docs: DataFrame, benchmark: DataFrame, p: LeakParams = LeakParams()) -> DataFrame:
    """One row per leaked (doc_id, item_id): the alignment with most agreeing words."""
    items = benchmark.select("item_id", "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    n_blocks = max(1, -(-(size["b"] + 16 * size["n"]) // BLOCK_BYTES))
    parts = []
    for k in range(n_blocks):
        block = [(r["item_id"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).collect()]
        parts.append(docs.select("doc_id", "text").mapInArrow(_scanner(sorted(block, key=str), p), SCHEMA))
    found = reduce(DataFrame.unionAll, parts)
    best = F.max(F.struct("n_matched", (-F.col("first_word")).alias("back"), "n_compared", "similarity")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "b.n_matched", "b.n_compared", "b.similarity", (-F.col("b.back")).alias("first_word")
    )


def _scanner(items: list[tuple[int, str | None]], p: LeakParams):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(items, p)
        for b in batches:
            ids = b.column(0)
            rows, cols = [], [[], [], [], [], []]
            for first, data, off in rows_as_bytes(b.column(1), SLICE):
                words, starts = hashed_words(data, off)
                for row, it, matched, compared, at in index.leaks(words, starts):
                    rows.append(first + row)
                    for c, v in zip(cols, (it, matched, compared, matched / compared, at), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows, pa.int64())), index.ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.int32())],
                names=["doc_id", "item_id", "n_matched", "n_compared", "similarity", "first_word"],
            )

    return scan


def clean(docs: DataFrame, benchmark: DataFrame, p: LeakParams = LeakParams()) -> DataFrame:
    """``docs`` without the rows that hold a leaked item; rows are told apart by id and text."""
    key = free_name(docs, "row_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    leaked = find_leaks(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark, p).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(leaked, key, "left_anti").drop(key)

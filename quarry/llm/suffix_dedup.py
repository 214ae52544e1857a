"""Exact substring deduplication on Burrows-Wheeler transforms with threshold-bounded interval expansion.

Every byte of a text's UTF-8 form that is covered by a ``length``-byte string which also starts earlier (smaller
doc_id, or same document and smaller offset) is removed; strings are judged on the input, never across documents.

1. *Anchors.* Each ``length``-byte string is represented by its least-hashed ``KGRAM``-gram, which depends on the
   string alone; neighbouring strings mostly share it, so a text becomes runs of strings (about one per 40 bytes). Two
   equal strings have equal anchors at equal offsets.
2. *Contexts.* A run's context is all bytes its strings cover. Runs are shuffled by anchor as hashes only. Equal
   contexts collapse onto their earliest occurrence (the others repeat it string by string); first within each Arrow
   batch, so a passage of a third of all documents is a few rows per task, then within an anchor. A context whose anchor has
   no other context is unique and ends here.
3. *Interval expansion.* The bytes of the remaining distinct contexts go to blocks of about ``BLOCK_BYTES``. A block's
   Burrows-Wheeler transform is expanded breadth-first by backward extension from the empty string: level l sets the
   common-prefix values equal to l, and expansion stops at ``length``. Boundaries never reached separate suffixes with
   at least ``length`` common bytes; each such interval keeps its earliest string and flags the rest.
4. *Heavy anchors* with many distinct contexts (the edges of a very common passage) are dealt by context over many blocks;
   each block then sends its earliest string per interval to one map-side-combined minimum. Which anchors are
   heavy is a hint from per-batch counts, at most ``HEAVY_BOUND`` of them: it spreads work and never changes the result.

Two joins bring runs and flags back to the texts; hashes and offsets are what is shuffled otherwise.

Defined results: null text is empty; texts shorter than ``length`` bytes lose nothing; rows that repeat an id with the
same text are the same document (neither is earlier); rows with a null id are left whole and not compared; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialized
from quarry.llm.textbytes import U, mixed, powers, prefix_sums, rows_as_bytes, sliding_min

LENGTH, KGRAM = 100, 24
SLICE, PIECE, BLOCK_BYTES = 1 << 20, 1 << 22, 96 << 10
HEAVY_LOCAL, HEAVY_SHARE, HEAVY_BOUND = 24, 2_048, 50_000
RUNS = "route long, anchor long, ctx long, doc_id long, at long, n int, heavy boolean, again boolean"


def _runs(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, start in row, number of strings, anchor, context hash) of the runs of consecutive texts."""
    k, out = min(KGRAM, length), []
    base = 0
    while base == 0 or base + length <= len(data):
        part = data[base : base + PIECE + length - 1]
        if len(part) >= length:
            up, _ = powers(len(part) + 1)
            sums = prefix_sums(part)
            grams = mixed((sums[k:] - sums[:-k]) * up[: len(part) - k + 1])
            low = U(0xFFFFFF)
            where = (sliding_min((grams & ~low) | np.arange(len(grams), dtype=U), length - k + 1) & low).astype(np.int64)
            # Strings that end within their row; at a row's end at least length - 1 starts are out, which parts the rows.
            ends = np.repeat(off[1:], np.diff(off))[base : base + len(where)]
            inside = np.arange(base + length, base + length + len(where)) <= ends
            new = inside.copy()
            new[1:] &= (where[1:] != where[:-1]) | ~inside[:-1]
            first = np.flatnonzero(new)
            if len(first):
                n = np.add.reduceat(inside, first, dtype=np.int64)
                ctx = mixed((sums[first + n + length - 1] - sums[first]) * up[first]) + n.astype(U)
                row = np.searchsorted(off, base + first, "right") - 1
                out.append((row, base + first - off[row], n, grams[where[first]], ctx))
        base += PIECE
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z.view(U), z.view(U)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _batch_runs(b: pa.RecordBatch, length: int):
    """Runs of a batch sorted by (anchor, context, id, offset), with a mark on those that repeat an earlier one of it."""
    ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    parts = []
    for first, data, off in rows_as_bytes(b.column(1), SLICE):
        row, *rest = _runs(data, off, length)
        parts.append((ids[first + row], *rest))
    if not parts:
        return None
    doc, at, n, anchor, ctx = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((at, doc, ctx, anchor))
    doc, at, n, anchor, ctx = doc[order], at[order], n[order], anchor[order], ctx[order]
    same = np.zeros(len(doc), bool)
    same[1:] = (anchor[1:] == anchor[:-1]) & (ctx[1:] == ctx[:-1])
    head = np.flatnonzero(~same)
    lead = np.repeat(head, np.diff(np.append(head, len(doc))))
    again = (doc != doc[lead]) | (at != at[lead])
    return doc, at, n, anchor, ctx, again


def heavy_anchors(docs: DataFrame, length: int) -> dict[int, int]:
    """Anchors with many distinct contexts, as far as batches see them, and over how many routes to deal each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [np.stack(_runs(data, off, length)[3:]) for _, data, off in rows_as_bytes(b.column(1), SLICE)]
            if pairs:
                anchor, ctx = np.concatenate(pairs, axis=1)
                found, n = np.unique(anchor, return_counts=True)
                often = np.isin(anchor, found[n >= HEAVY_LOCAL])
                anchor, n = np.unique(np.unique(np.stack([anchor[often], ctx[often]]), axis=1)[0], return_counts=True)
                many = n >= HEAVY_LOCAL
                yield pa.RecordBatch.from_arrays([pa.array(anchor[many].view(np.int64)), pa.array(n[many])], names=["anchor", "n"])

    seen = docs.select("doc_id", "text").mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    top = seen.filter(F.col("n") >= HEAVY_LOCAL * 4).orderBy(F.desc("n"), "anchor").limit(HEAVY_BOUND).collect()
    return {r["anchor"]: max(16, -(-r["n"] // HEAVY_SHARE)) for r in top}


def find_runs(docs: DataFrame, length: int, heavy: dict[int, int]) -> DataFrame:
    """Runs to compare: ``again`` marks those that repeat an earlier run of their batch; these take a route of their own."""
    names = [f.split()[0] for f in RUNS.split(", ")]
    hot = np.array(sorted(heavy), np.int64)
    ways = np.array([heavy[int(x)] for x in hot], np.int64).view(U)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = _batch_runs(b, length)
            if got is None:
                continue
            doc, at, n, anchor, ctx, again = got
            route = anchor.copy()
            is_hot = np.zeros(len(doc), bool)
            if len(hot):
                slot = np.minimum(np.searchsorted(hot, anchor.view(np.int64)), len(hot) - 1)
                is_hot = hot[slot] == anchor.view(np.int64)
                route[is_hot] = mixed(anchor[is_hot] + ctx[is_hot] % ways[slot[is_hot]] + U(1))
            route[again] = mixed(doc[again].view(U) * U(31) + at[again].view(U))
            cols = [route.view(np.int64), anchor.view(np.int64), ctx.view(np.int64), doc, at, n.astype(np.int32), is_hot, again]
            for i in range(0, len(doc), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000]) for c in cols], names=names)

    return docs.select("doc_id", "text").mapInArrow(cut, RUNS)


def sort_runs(runs: DataFrame) -> DataFrame:
    """Runs that repeat an earlier one (``again``) and the distinct contexts that need comparing (not ``again``)."""
    group = Window.partitionBy("route", "anchor")
    turn = F.dense_rank().over(Window.partitionBy("route", "anchor", "ctx").orderBy("doc_id", "at"))
    seen = runs.withColumn("turn", F.when(F.col("again"), 2).otherwise(turn)).withColumn("lo", F.min("ctx").over(group)).withColumn("hi", F.max("ctx").over(group))
    return seen.filter((F.col("turn") > 1) | F.col("heavy") | (F.col("lo") != F.col("hi"))).select(
        "route", "doc_id", "at", "n", "heavy", (F.col("turn") > 1).alias("again")
    )


PACK = 7


def packed_symbols(sym: np.ndarray) -> np.ndarray:
    """The ``PACK`` symbols (below 512) from every position on as one integer."""
    padded = np.concatenate([sym, np.zeros(PACK, np.int64)])
    key = np.zeros(len(sym), np.int64)
    for j in range(PACK):
        key = (key << 9) | padded[j : j + len(sym)]
    return key


def suffix_order(key: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array in the order of the first ``depth`` symbols, by prefix doubling from the packed symbols."""
    n, k = len(key), PACK
    while True:
        order = np.argsort(key)
        rank = np.zeros(n, np.int64)
        rank[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        if k >= depth:
            return order
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        k *= 2


def common_prefix_intervals(sym: np.ndarray, packed: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Interval number of each suffix in ``order``; suffixes of one interval share at least ``length`` symbols.

    Breadth-first backward extension on the Burrows-Wheeler transform: intervals of all strings of l symbols give those
    of l + 1 symbols, and an interval's end that no shorter string has reached has common-prefix value l. Values below
    ``PACK`` come with the packed symbols, so expansion begins with the strings of ``PACK`` symbols; it stops below
    ``length``. An interval's children are the runs
    that its members' last-to-first images form within each letter.
    """
    n, letter = len(sym), sym[order]
    last_to_first = np.empty(n, np.int64)
    last_to_first[np.argsort(sym[order - 1].astype(np.uint16), kind="stable")] = np.arange(n)
    ended = np.ones(n + 1, bool)
    here = packed[order]
    ended[1:n] = here[1:] != here[:-1]
    edge = np.flatnonzero(ended)
    lo, hi = edge[:-1], edge[1:]
    # Strings of PACK symbols whose end was reached last: it differs from the next string in the last symbol only.
    newest = np.zeros(len(lo), bool)
    newest[:-1] = here[lo[:-1]] >> 9 == here[lo[1:]] >> 9
    lo, hi = lo[newest], hi[newest]
    for _ in range(PACK, length):
        if not len(lo):
            break
        width = hi - lo
        owner = np.repeat(np.arange(len(lo)), width)
        image = last_to_first[np.arange(len(owner)) - np.repeat(np.cumsum(width) - width - lo, width)]
        by = np.argsort(image)
        image, owner = image[by], owner[by]
        head = np.ones(len(image), bool)
        head[1:] = (image[1:] != image[:-1] + 1) | (owner[1:] != owner[:-1]) | (letter[image[1:]] != letter[image[:-1]])
        first = np.flatnonzero(head)
        left = image[first]
        right = left + np.diff(np.append(first, len(image)))
        new = ~ended[right]
        lo, hi = left[new], right[new]
        ended[hi] = True
    return np.cumsum(ended[:n]) - 1


def _compare(length: int):
    def block(key, table):
        """Strings of one block that also start earlier, as ranges; heavy contexts' earliest strings, as digests."""
        ctx = [x.as_py() for x in table.column("bytes")]
        doc, at = table.column("doc_id").to_numpy(), table.column("at").to_numpy()
        n, heavy = table.column("n").to_numpy(), table.column("heavy").to_numpy(zero_copy_only=False)
        # Symbols: 0 ends the block, 1 ends a context, bytes are 2 and up.
        sym = np.concatenate([np.frombuffer(b"\x00".join(ctx) + b"\x00\x00", np.uint8).astype(np.int64) + 2])
        sizes = np.fromiter(map(len, ctx), np.int64, len(ctx))
        begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        sym[begin + sizes], sym[-1] = 1, 0
        packed = packed_symbols(sym)
        order = suffix_order(packed, length)
        where = np.empty(len(sym), np.int64)
        where[order] = common_prefix_intervals(sym, packed, order, length)
        owner = np.repeat(np.arange(len(ctx)), n)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        group, d, s = where[begin[owner] + step], doc[owner], at[owner] + step
        by = np.lexsort((s, d, group))
        head = np.flatnonzero(np.concatenate([[True], group[by][1:] != group[by][:-1]]))
        lead = by[np.repeat(head, np.diff(np.append(head, len(by))))]
        late = np.zeros(len(by), bool)
        late[by] = (d[by] != d[lead]) | (s[by] != s[lead])
        first = late.copy()
        first[1:] &= ~late[:-1] | (owner[1:] != owner[:-1])
        last = late.copy()
        last[:-1] &= ~late[1:] | (owner[1:] != owner[:-1])
        f, t = np.flatnonzero(first), np.flatnonzero(last)
        open_ = np.flatnonzero(heavy[owner] & ~late)
        digest = [xxhash.xxh3_128_digest(ctx[o][k : k + length]) for o, k in zip(owner[open_].tolist(), step[open_].tolist(), strict=True)]
        return pa.table({
            "doc_id": pa.array(np.concatenate([d[f], d[open_]]), pa.int64()),
            "lo": pa.array(np.concatenate([s[f], s[open_]]), pa.int64()),
            "hi": pa.array(np.concatenate([s[t], s[open_]]), pa.int64()),
            "digest": pa.array([None] * len(f) + digest, pa.binary()),
        })

    return block


def _contexts(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = b.column(2)
            size = runs.value_lengths().to_numpy(zero_copy_only=False)
            route, at, n, heavy = runs.flatten().flatten()
            spans = zip(at.to_pylist(), (at.to_numpy() + n.to_numpy() + length - 1).tolist(), strict=True)
            pieces = []
            for text, k in zip(b.column(1), size.tolist(), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                pieces += [raw[s:e] for s, e in islice(spans, k)]
            doc = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), size)))
            for i in range(0, len(pieces), 20_000):
                cols = [c.slice(i, 20_000) for c in (route, doc, at, n, heavy)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(pieces[i : i + 20_000], pa.binary())], names=["route", "doc_id", "at", "n", "heavy", "bytes"])

    return cut


def repeated_ranges(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, lo, hi: ranges of start offsets (inclusive) whose ``length``-byte strings also start earlier."""
    docs = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sorted_runs = materialized(sort_runs(find_runs(docs, length, heavy_anchors(docs, length))), "suffix-runs")
    again = sorted_runs.filter("again").select("doc_id", F.col("at").alias("lo"), (F.col("at") + F.col("n") - 1).alias("hi"))
    fresh = sorted_runs.filter("not again")
    total = fresh.agg(F.coalesce(F.sum(F.col("n") + length), F.lit(0))).first()[0]
    if not total:
        return again
    per_doc = fresh.groupBy("doc_id").agg(F.collect_set(F.struct("route", "at", "n", "heavy")).alias("runs"))
    blocks = max(1, -(-total // BLOCK_BYTES))
    texts = docs.join(per_doc, "doc_id").select("doc_id", "text", "runs")
    contexts = texts.mapInArrow(_contexts(length), "route long, doc_id long, at long, n int, heavy boolean, bytes binary")
    contexts = contexts.withColumn("block", F.pmod(F.xxhash64("route"), F.lit(blocks)))
    found = materialized(contexts.groupBy("block").applyInArrow(_compare(length), "doc_id long, lo long, hi long, digest binary"), "suffix-flags")
    late = found.filter("digest is null").select("doc_id", "lo", "hi")
    edge = found.filter("digest is not null")
    least = edge.groupBy("digest").agg(F.min(F.struct("doc_id", "lo")).alias("least"), F.count("*").alias("c")).filter("c > 1")
    more = edge.join(least, "digest").filter(F.struct("doc_id", "lo") > F.col("least")).select("doc_id", "lo", "hi")
    return again.unionByName(late).unionByName(more)


def _keep(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[], [], [], []]
            for i in range(b.num_rows):
                raw = (b.column(1)[i].as_py() or "").encode("utf-8", "surrogatepass")
                r = b.column(2)[i].as_py() or []
                spans: list[list[int]] = []
                for lo, hi in sorted((x["lo"], x["hi"] + length) for x in r):
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], hi)
                    else:
                        spans.append([lo, hi])
                kept, at = [], 0
                for lo, hi in spans:
                    kept.append(raw[at:lo])
                    at = hi
                kept.append(raw[at:])
                for c, v in zip(out, (len(raw), sum(h - s for s, h in spans), [{"lo": s, "hi": h} for s, h in spans], b"".join(kept)), strict=True):
                    c.append(v)
            span = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], span), pa.array(out[3] if with_text else [None] * len(out[3]), pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in out[3]])],
                names=["doc_id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"],
            )

    return run


def _numbered(docs: DataFrame) -> DataFrame | None:
    """number, doc_id, digest of the different (id, text) rows in their order, or None where integer ids already tell all texts apart.

    Numbers follow the order of (id, digest of the text); rows without an id have none.
    """
    keyed = docs.filter("doc_id is not null").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    if dict(docs.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint"):
        shared = keyed.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo <> hi")
        if shared.isEmpty():
            return None
    ordered = keyed.distinct().repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest")
    return materialized(ordered.select(F.monotonically_increasing_id().alias("number"), "doc_id", "digest"), "suffix-numbers")


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (byte ranges removed, end exclusive), kept (bytes, null if not asked for) and kept_sha256.

    Rows with one id and different texts are different documents, the one with the smaller digest of its text first; ids
    that are no integers are put in their own order.
    """
    docs = docs.select("doc_id", "text")
    numbers = _numbered(docs)
    if numbers is not None:
        known = numbers.withColumnRenamed("doc_id", "id")
        rows = docs.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256)).join(numbers, ["doc_id", "digest"], "left").select(F.col("number").alias("doc_id"), "text")
        done = _removed(rows, length, with_text)
        return done.join(known.select("number", "id"), done["doc_id"] == F.col("number"), "left").select(F.col("id").alias("doc_id"), *done.columns[1:])
    return _removed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), length, with_text)


def _removed(docs: DataFrame, length: int, with_text: bool) -> DataFrame:
    ranges = repeated_ranges(docs, length).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    joined = docs.join(ranges, "doc_id", "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(_keep(length, with_text), "doc_id long, n_bytes long, n_removed long, spans array<struct<lo:long,hi:long>>, kept binary, kept_sha256 string")

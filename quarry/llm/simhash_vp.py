"""SimHash near-duplicate groups by a forest of vantage-point trees over the fingerprints.

Fingerprint: A-Z lowered, words ``[^\\x20\\x09-\\x0D]+``, 4-word shingles (fewer words: the whole sequence; none: zero),
XXH64 of each shingle with seed 42, bit set where more than half of the hashes set it.

Two fingerprints at most ``max_bits`` apart agree in at least one of ``BANDS`` bit bands up to ``max_bits // BANDS``
differing bits, and the Hamming distance within a band is a metric. So there is one vantage-point tree per band: inner
nodes hold a vantage value and a radius, a fingerprint lives in one leaf (its home) and queries every leaf that the
triangle inequality cannot rule out for its small band radius, which near shard boundaries is more than one. In each
leaf, homes are compared with queries over all 64 bits, so every link is exact and none is lost. Only the shape of the
trees (vantage values, radii) is fitted, on at most ``SAMPLE`` fingerprints; all fingerprints are indexed and queried.

A crowded leaf is cut on both sides, into parts of about ``PART`` homes and ``PART`` queries each; every part of the one
meets every part of the other in a group of its own, so no group outgrows a task. Links inside a group are reduced to stars at once (never all pairs of a group), and stars are joined into components by alternating
large-star and small-star steps, each written to the shared folder.

Defined results: null text is an empty one; equal fingerprints are one node, so any number of copies costs one row;
repeated rows give repeated results; null ids never name a component unless it has no other id; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialized

SHINGLE, SEED, MAX_BITS = 4, 42, 4
BANDS, SAMPLE, LEAF, PART, MAX_DEPTH = 3, 20_000, 1_000, 8_192, 12
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
U = np.uint64
#: Roles of a fingerprint in a group of homes and queries.
HOME, ASKS = 1, 2


def fingerprint(text: str | None) -> int:
    """Fingerprint of one text as an unsigned integer."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not w:
        return 0
    joined, size = b" ".join(w), np.fromiter(map(len, w), np.int64, len(w)) + 1
    ends = np.cumsum(size) - 1
    k = min(SHINGLE, len(w))
    starts, stops = (ends - size + 1)[: len(w) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, stops, strict=True)), U, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[i : i + (1 << 15)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), U, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def band_masks() -> list[int]:
    """Bit masks of the bands, which together cover all 64 bits."""
    cuts = [round(64 * i / BANDS) for i in range(BANDS + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class VantageTree:
    """Binary vantage-point tree over masked fingerprints; leaves are numbered by -child - 1."""

    def __init__(self, sample: np.ndarray, mask: int, depth: int):
        self.mask, self.nodes, self.n_leaves = U(mask), [], 0
        self.root = self._grow(np.unique(sample & self.mask), depth, 1)

    def _grow(self, values: np.ndarray, depth: int, path: int) -> int:
        if not depth or len(values) < 4:
            self.n_leaves += 1
            return -self.n_leaves
        vantage = values[path * 2654435761 % len(values)]
        d = np.sort(_distance(values, vantage))
        radius = int(d[(len(d) - 1) // 2])
        if radius == d[-1]:
            radius -= 1
        near = _distance(values, vantage) <= radius
        at = len(self.nodes)
        self.nodes.append(None)
        self.nodes[at] = (vantage, radius, self._grow(values[near], depth - 1, 2 * path), self._grow(values[~near], depth - 1, 2 * path + 1))
        return at

    def leaves(self, fps: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, int]]:
        """(row indices, leaf) of every leaf that can hold a value within ``reach``; reach 0 gives each row's home."""
        todo = [(self.root, np.arange(len(fps)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                yield rows, -node - 1
                continue
            vantage, radius, near, far = self.nodes[node]
            d = _distance(fps[rows] & self.mask, vantage).astype(np.int16)
            todo += [(near, rows[d - reach <= radius]), (far, rows[d + reach > radius])]


def forest(nodes: DataFrame) -> list[VantageTree]:
    """Trees for the fingerprints in ``nodes`` (column fp), shaped by a bounded sample of them."""
    n = nodes.count()
    sample = np.array([r["fp"] for r in nodes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(U)
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(1, n / LEAF))))))
    return [VantageTree(sample, m, depth) for m in band_masks()]


def shards(nodes: DataFrame, trees: list[VantageTree]) -> DataFrame:
    """Rows (leaf, fp, home): every fingerprint at its home leaf and at each other leaf its query reaches."""
    reach = MAX_BITS // BANDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(U)
            base = 0
            for tree in trees:
                home = np.full(len(fp), -1, np.int64)
                for rows, leaf in tree.leaves(fp, 0):
                    home[rows] = leaf
                for rows, leaf in tree.leaves(fp, reach):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), base + leaf, np.int32)), pa.array(fp[rows].view(np.int64)), pa.array(home[rows] == leaf)],
                        names=["leaf", "fp", "home"],
                    )
                base += tree.n_leaves

    return nodes.select("fp").mapInArrow(run, "leaf int, fp long, home boolean")


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one part reduced to (node, least node of its component), least node itself excluded."""
    nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = index[: len(u)], index[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _links(key, table):
    """Links between the homes and the queries of one group, as stars."""
    fp = table.column("fp").to_numpy().view(U)
    role = table.column("role").to_numpy()
    kept, asked = fp[role & HOME > 0], fp[role & ASKS > 0]
    us, vs, held = [], [], 0
    for i in range(0, len(asked), 256):
        ask = asked[i : i + 256]
        x = ask[:, None] ^ kept[None, :]
        r, c = np.nonzero((np.bitwise_count(x) <= MAX_BITS) & (x != 0))
        if len(r):
            us.append(ask[r].view(np.int64))
            vs.append(kept[c].view(np.int64))
            held += len(r)
        if held > 1 << 20:
            u, v = stars(np.concatenate(us), np.concatenate(vs))
            us, vs, held = [u], [v], 0
    if us:
        u, v = stars(np.concatenate(us), np.concatenate(vs))
    else:
        u = v = np.zeros(0, np.int64)
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def near_links(nodes: DataFrame) -> DataFrame:
    """Star edges (u, v) that connect exactly the fingerprints linked within ``MAX_BITS``."""
    placed = materialized(shards(nodes, forest(nodes)), "vp-shards")
    parts = lambda n: F.ceil(n / PART).cast("int")
    crowd = placed.groupBy("leaf").agg(F.count_if("home").alias("n_home"), F.count("*").alias("n_ask")).filter(F.greatest("n_home", "n_ask") > PART)
    #: One row per overfull leaf, of which there are at most the trees' leaves (BANDS * 2 ** MAX_DEPTH).
    cut = placed.join(F.broadcast(crowd.select("leaf", parts(F.col("n_home")).alias("h"), parts(F.col("n_ask")).alias("q"))), "leaf", "left")
    h, q = F.greatest(F.coalesce("h", F.lit(1)), F.lit(1)), F.coalesce("q", F.lit(1))
    own = lambda n, salt: F.pmod(F.xxhash64("fp", F.lit(salt)), n).cast("int")
    group = lambda a, b, role: F.struct(a.cast("int").alias("home_part"), b.cast("int").alias("ask_part"), F.lit(role).alias("role"))
    # A home stands in its part against all parts of queries, a query in its own against all parts of homes.
    both = F.array(group(F.lit(0), F.lit(0), HOME | ASKS))
    asks = F.transform(F.sequence(F.lit(0), h - 1), lambda i: group(i, own(q, 1), ASKS))
    homes = F.transform(F.sequence(F.lit(0), q - 1), lambda i: group(own(h, 0), i, HOME))
    none = F.array().cast("array<struct<home_part:int,ask_part:int,role:int>>")
    dealt = F.when((h == 1) & (q == 1), F.when(F.col("home"), both).otherwise(asks)).otherwise(F.concat(asks, F.when(F.col("home"), homes).otherwise(none)))
    spread = cut.select("leaf", "fp", F.inline(dealt))
    return spread.groupBy("leaf", "home_part", "ask_part").applyInArrow(_links, "u long, v long").distinct()


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, root) of every node with a link; root is the least node of the component. ``label`` names the tables that are written."""
    e = materialized(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    seen = None
    while True:
        # Large star: neighbours above a node move to the least node around it.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its neighbours below move to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = materialized(small.filter("u <> v").distinct(), label)
        now = tuple(e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable over links) of every row."""
    prints = materialized(fingerprints(docs), "simhash")
    nodes = materialized(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    joined = components(near_links(nodes))
    member = joined.unionByName(joined.select(F.col("root").alias("node"), "root").distinct())
    group = member.join(nodes, member["node"] == nodes["fp"]).select("root", "node", "least")
    best = group.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = group.join(best, "root").select(F.col("node").alias("fp"), "component_id")
    #: Written out, so that the adaptive join below can split a fingerprint that very many documents share.
    of_fp = materialized(nodes.join(of_fp, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "simhash-class")
    hex16 = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(of_fp, "fp").select("doc_id", hex16.alias("fingerprint"), "component_id")

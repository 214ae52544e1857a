"""Spelling variants grouped by distance-one search in compact tries.

``count_words`` counts the words of a corpus: maximal runs of letters, A-Z lowered, counted once more by Spark after each
task has added up its own. ``group_variants`` then finds all pairs of words that differ by exactly one inserted, deleted
or replaced code point:

* the words are dealt by range into shards of at most ``SHARD`` words, and each task writes its shards as compact tries
  (paths without branches are one edge);
* tries are broadcast in blocks of counted size, ``BLOCK_BYTES`` at most (a trie that is larger stands alone), one job a
  block over all words; jobs leave their rows in the shared folder;
* each word's distance-one automaton walks every trie of the block depth-first: along the path that spells the word, and
  at each of its nodes once through every edit; what an edit leaves to read is then followed without a choice. A
  canonical place is tried for each edit (the first of equal letters), so no neighbour is emitted twice;
* counts of neighbours and the best one are reduced over the blocks.

A word's form is its neighbour of largest count (ties: the smallest in code-point order) if that is at least ``ratio``
times its own. Roots follow forms by pointer doubling; each step multiplies the count by ``ratio``, which bounds the chain
by the logarithm of the largest count.

Defined results: null texts have no words; a null id counts as an empty one in the keyed slips; words of any length are
taken; repeated rows count again; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import marshal
import math
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialized, shared_folder

MIN_CHARS, MIN_COUNT, RATIO = 7, 2, 10
#: Words of a trie, and serialised bytes broadcast at once.
SHARD, BLOCK_BYTES = 100_000, 16 << 20
#: Distinct words a task holds before it hands its counts on.
HELD = 300_000

Trie = tuple[list[dict[str, tuple[str, int]]], list[int]]


def count_words(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, slip: int = 0) -> DataFrame:
    """word, n: words of ``min_chars`` code points or more that occur ``min_count`` times or more.

    ``slip`` makes keyed misspellings: with h the crc32 of ``<doc_id>:<word>``, a word whose h it divides loses the code
    point h modulo its length. 0 leaves all words as they are.
    """
    letters = re.compile("[A-Za-zÀ-ÿ]{%d,}" % min_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for b in batches:
            for i, text in zip(b.column(0), b.column(1)):
                found = Counter(letters.findall((text.as_py() or "").encode().lower().decode()))
                key = zlib.crc32(f"{'' if i.as_py() is None else i.as_py()}:".encode())
                for word, n in found.items():
                    if slip:
                        h = zlib.crc32(word.encode(), key)
                        if h % slip == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < min_chars:
                                continue
                    held[word] += n
                if len(held) >= HELD:
                    yield flush()
        if held:
            yield flush()

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def compact_trie(words: list[str], counts: list[int]) -> Trie:
    """Trie of sorted, distinct words: edges of each node by first letter as (rest of the label, node), and the count of the word that ends in each node (0: none)."""
    nodes: list[dict[str, tuple[str, int]]] = [{}]
    ends = [0]
    todo = [(0, 0, len(words), 0)]
    while todo:
        at, lo, hi, depth = todo.pop()
        if lo < hi and len(words[lo]) == depth:
            ends[at] = counts[lo]
            lo += 1
        while lo < hi:
            first = words[lo]
            end = lo + 1
            while end < hi and words[end][depth] == first[depth]:
                end += 1
            last, stop = words[end - 1], depth + 1
            while stop < len(first) and stop < len(last) and first[stop] == last[stop]:
                stop += 1
            nodes[at][first[depth]] = (first[depth + 1 : stop], len(nodes))
            todo.append((len(nodes), lo, end, stop))
            nodes.append({})
            ends.append(0)
            lo = end
    return nodes, ends


def _accepts(trie: Trie, node: int, label: str, off: int, word: str, i: int) -> int:
    """Count of the word that is read by ``word[i:]`` from ``label[off:]``, the rest of the edge into ``node``; 0 if there is none."""
    nodes, ends = trie
    size = len(word)
    while True:
        if off < len(label):
            if i >= size or word[i] != label[off] or not word.startswith(label[off:] if off else label, i):
                return 0
            i += len(label) - off
        if i >= size:
            return ends[node]
        step = nodes[node].get(word[i])
        if step is None:
            return 0
        label, node = step
        off = 0
        i += 1


def neighbours(trie: Trie, word: str) -> Iterator[tuple[str, int]]:
    """Words of the trie at distance one with their counts."""
    nodes, size = trie[0], len(word)
    node, label, off, before = 0, "", 0, ""
    for i in range(size + 1):
        here = word[i : i + 1]
        inside = off < len(label)
        if here and here != before:
            n = _accepts(trie, node, label, off, word, i + 1)
            if n:
                yield word[:i] + word[i + 1 :], n
        for letter, (rest, child) in ((label[off], (label, node)),) if inside else nodes[node].items():
            skip = off + 1 if inside else 0
            if letter != before:
                n = _accepts(trie, child, rest, skip, word, i)
                if n:
                    yield word[:i] + letter + word[i:], n
            if here and letter != here:
                n = _accepts(trie, child, rest, skip, word, i + 1)
                if n:
                    yield word[:i] + letter + word[i + 1 :], n
        if inside and label[off] == here:
            off += 1
        elif here and not inside and here in nodes[node]:
            label, node = nodes[node][here]
            off = 0
        else:
            return
        before = here


def trie_shards(words: DataFrame, n_words: int, shard: int = SHARD) -> DataFrame:
    """shard, bytes, trie: serialised tries of at most ``shard`` words each, of neighbouring words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int]] = []

        def flush(rows: list[tuple[str, int]]) -> pa.RecordBatch:
            blob = marshal.dumps(compact_trie([w for w, _ in rows], [n for _, n in rows]))
            return pa.RecordBatch.from_arrays([pa.array([rows[0][0]]), pa.array([len(blob)], pa.int64()), pa.array([blob], pa.binary())], names=["shard", "bytes", "trie"])

        for b in batches:
            held.extend(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            while len(held) >= shard:
                yield flush(held[:shard])
                del held[:shard]
        if held:
            yield flush(held)

    dealt = words.select("word", "n").repartitionByRange(max(1, math.ceil(n_words / shard)), "word").sortWithinPartitions("word")
    return dealt.mapInArrow(run, "shard string, bytes long, trie binary")


_held: dict[str, list[Trie]] = {}


def _tries(name: str, blobs: list[bytes]) -> list[Trie]:
    """The tries of a broadcast block, decoded once per worker; the block before is let go."""
    if name not in _held:
        _held.clear()
        _held[name] = [marshal.loads(b) for b in blobs]
    return _held[name]


def near_words(words: DataFrame, shards: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """word, n_near, best (struct of negative count and word): one row for each word and block with a neighbour there."""
    spark = words.sparkSession
    sizes = sorted((r["shard"], r["bytes"]) for r in shards.select("shard", "bytes").collect())
    blocks: list[list[str]] = []
    room = 0
    for name, size in sizes:
        if not blocks or size > room:
            blocks.append([])
            room = block_bytes
        blocks[-1].append(name)
        room -= size
    schema = "word string, n_near long, best struct<less: long, word: string>"
    folder = f"{shared_folder(spark)}/spelling-near-{uuid.uuid4().hex}"
    for names in blocks:
        blobs = [bytes(r["trie"]) for r in shards.filter(F.col("shard").between(names[0], names[-1])).select("trie").collect()]
        name, block = uuid.uuid4().hex, spark.sparkContext.broadcast(blobs)

        def run(batches: Iterator[pa.RecordBatch], name=name, block=block) -> Iterator[pa.RecordBatch]:
            tries = _tries(name, block.value)
            for b in batches:
                near: list[str] = []
                counts: list[int] = []
                best: list[dict] = []
                for word in b.column(0).to_pylist():
                    found = [(-n, other) for other, n in chain.from_iterable(neighbours(t, word) for t in tries)]
                    if found:
                        less, other = min(found)
                        near.append(word)
                        counts.append(len(found))
                        best.append({"less": less, "word": other})
                kind = pa.struct([("less", pa.int64()), ("word", pa.string())])
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.string()), pa.array(counts, pa.int64()), pa.array(best, kind)], names=["word", "n_near", "best"])

        words.select("word").mapInArrow(run, schema).write.mode("append").parquet(folder)
        block.unpersist()
    return spark.read.schema(schema).parquet(folder) if blocks else spark.createDataFrame([], schema)


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """word, root for (word, form) pairs: where following forms ends, by at most ``steps`` steps, doubled each round."""
    at = forms.select("word", F.col("form").alias("root"))
    done = 1
    while done < steps:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = materialized(at.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
        done *= 2
    return at


def group_variants(words: DataFrame, ratio: int = RATIO, shard: int = SHARD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """word, form, root, n, n_near, form_n for distinct words with counts ``n`` of at least 1."""
    words = materialized(words.select("word", "n"), "spelling-words")
    totals = words.agg(F.count("*").alias("words"), F.max("n").alias("most")).first()
    shards = materialized(trie_shards(words, totals["words"], shard), "spelling-tries")
    near = near_words(words, shards, block_bytes)
    own = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<less: long, word: string>").alias("best"))
    both = own.unionByName(near.withColumn("n", F.lit(None).cast("long")))
    reduced = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    better = -F.col("best.less") >= F.col("n") * ratio
    found = materialized(reduced.select("word", "n", "n_near", F.when(better, F.col("best.word")).alias("form"), F.when(better, -F.col("best.less")).alias("form_n")), "spelling-forms")
    steps = max(1, math.ceil(math.log(max(totals["most"] or 1, 1), ratio)))
    ends = roots(found.filter(F.col("form").isNotNull()), steps)
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

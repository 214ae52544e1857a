"""Cross-tokenizer alignment: which ids of a byte-level tokenizer (A) stand where ids of a piece tokenizer (B) stand.

Both tokenizers cut the same bytes, so token occurrences are linked where their byte ranges overlap. Of all ends of A and B
tokens in order, each ends exactly one link; where both end, a group ends.

1. ``encoded``: documents are encoded once, in chunks of about ``CHUNK_BYTES``. A chunk keeps its links as indices into its
   own distinct (B, A) pairs, and hands on these pairs with their counts, cut into ``STRIPES`` stripes (B id modulo that).
2. ``stripes``: pairs are partitioned by stripe, and each stripe adds them with ``np.add.at`` into one dense block of its B
   ids by all A ids. Many chunks are added up in several blocks first (``CHUNKS`` each), so that no stripe is one long
   task. Row maxima of the whole block are the best counts of the B ids.
3. ``scored``: stripes meet the chunks' pairs again, so each chunk gets the counts of its own pairs only; these are
   partitioned like the chunk's links and summed by document.

Memory is a chunk, or one block; a document longer than a chunk is a chunk of its own.

Defined results: null and empty texts, and texts whose tokens do not spell a space and the text, have no tokens (zeros, and
'' for the groups); repeated rows count again and give repeated results; an empty table gives an empty one; of the input's columns
only ``doc_id`` is kept.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import materialized

CHUNK_BYTES, STRIPES, CHUNKS = 4 << 20, 256, 2000
# Fixed value: how the byte-level tokenizer cuts a text before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def byte_letters() -> dict[str, int]:
    """Byte of each letter that a byte-level vocabulary writes: printable Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


@dataclass
class Tokenizers:
    """Files of the two tokenizers, shipped with the tasks; the encoders are made once per worker."""

    a_file: bytes
    b_file: bytes
    _made: tuple | None = None

    @staticmethod
    def load(a_path: str, b_path: str) -> Tokenizers:
        with open(a_path, "rb") as a, open(b_path, "rb") as b:
            return Tokenizers(a.read(), b.read())

    def made(self) -> tuple:
        """(encoder A, bytes by A id, encoder B, bytes by B id)."""
        if not self._made:
            import sentencepiece
            import tiktoken

            model = json.loads(self.a_file)["model"]
            letter = byte_letters()
            vocabulary = model["vocab"]
            pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
            if any(vocabulary[x + y] != 256 + k for k, (x, y) in enumerate(pairs)):
                raise ValueError("ids of the byte-level tokenizer do not follow its merges")
            ranks = {bytes(letter[c] for c in t): i for t, i in vocabulary.items() if i < 256 + len(model["merges"])}
            a = tiktoken.Encoding("aligned", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
            b = sentencepiece.SentencePieceProcessor(model_proto=self.b_file)
            pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
            b_bytes = [bytes.fromhex(BYTE_PIECE.fullmatch(p)[1]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
            self._made = a, [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])], b, b_bytes
        return self._made

    def __getstate__(self) -> dict:
        return {"a_file": self.a_file, "b_file": self.b_file, "_made": None}


@dataclass
class Codes:
    """Pairs (B id, A id) as numbers: stripes one after the other, in a stripe its B ids by all A ids."""

    n_a: int
    n_b: int
    stripes: int

    @property
    def rows(self) -> int:
        return -(-self.n_b // self.stripes)

    @property
    def cells(self) -> int:
        return self.rows * self.n_a

    def pack(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return b % self.stripes * self.cells + b // self.stripes * self.n_a + a

    def ids(self, stripe: int, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(A ids, B ids) of cells of a stripe."""
        return cell % self.n_a, cell // self.n_a * self.stripes + stripe


def _squeeze(values: np.ndarray) -> bytes:
    """Integers as compressed bytes: differences, in the narrowest type that holds them."""
    steps = np.diff(values.astype(np.int64), prepend=np.int64(0))
    most = int(np.abs(steps).max()) if len(steps) else 0
    kind = next(k for k in "bhiq" if most <= np.iinfo(np.dtype(k)).max)
    return kind.encode() + zstandard.ZstdCompressor(level=1).compress(steps.astype(f"<{np.dtype(kind).str[1:]}").tobytes())


def _spread(data: bytes) -> np.ndarray:
    kind = np.dtype(chr(data[0]))
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), f"<{kind.str[1:]}").astype(np.int64))


def align(texts: list[str | None], tokenizers: Tokenizers) -> tuple[list[dict], np.ndarray, np.ndarray, list[str]]:
    """Counts of each text, A id and B id of every link in order of the texts, and the texts' groups."""
    enc_a, bytes_a, enc_b, bytes_b = tokenizers.made()
    rows = [dict.fromkeys(COUNTS, 0) for _ in texts]
    groups = [""] * len(texts)
    some = [k for k, t in enumerate(texts) if t]
    some_a = [enc_a.encode_ordinary(" " + texts[k]) for k in some]
    some_b = enc_b.encode([texts[k] for k in some], num_threads=1) if some else []
    kept = []
    for k, a, b in zip(some, some_a, some_b):
        raw = (" " + texts[k]).encode()
        if b"".join([bytes_a[i] for i in a]) == raw and b"".join([bytes_b[i] for i in b]) == raw:
            kept.append((k, a, b, len(raw)))
    if not kept:
        return rows, np.zeros(0, np.int64), np.zeros(0, np.int64), groups
    flat = lambda lists: np.fromiter(chain.from_iterable(lists), np.int64)
    a, b = flat(x[1] for x in kept), flat(x[2] for x in kept)
    size_a, size_b = np.fromiter(map(len, bytes_a), np.int64), np.fromiter(map(len, bytes_b), np.int64)
    text_ends = np.cumsum([x[3] for x in kept])
    at_a, at_b = np.zeros(text_ends[-1] + 1, bool), np.zeros(text_ends[-1] + 1, bool)
    at_a[np.cumsum(size_a[a])] = True
    at_b[np.cumsum(size_b[b])] = True
    ends = np.flatnonzero(at_a | at_b)
    end_a, end_b = at_a[ends], at_b[ends]
    both = end_a & end_b
    link_a, link_b = a[np.cumsum(end_a) - end_a], b[np.cumsum(end_b) - end_b]
    text = np.searchsorted(text_ends, ends)
    n_links, n_groups = np.bincount(text, minlength=len(kept)), np.bincount(text[both], minlength=len(kept))

    # Groups as text: tokens of A, then of B, group by group; each token carries the sign that follows it.
    group = np.cumsum(both) - both
    of_a, of_b, all_groups = group[end_a], group[end_b], np.arange(int(both.sum()))
    signs = np.empty(len(a) + len(b), object)
    last = lambda g: np.append(g[1:] != g[:-1], True)
    signs[np.arange(len(a)) + np.searchsorted(of_b, all_groups)[of_a]] = _texts(len(size_a))[a + len(size_a) * last(of_a)]
    signs[np.arange(len(b)) + np.searchsorted(of_a, all_groups, "right")[of_b]] = _texts(len(size_b))[b + len(size_b) * 2 * last(of_b)]
    signs = signs.tolist()
    at = 0
    for j, (k, ids_a, ids_b, _) in enumerate(kept):
        upto = at + len(ids_a) + len(ids_b)
        groups[k] = "".join(signs[at:upto])[:-1]
        rows[k] = {"n_a": len(ids_a), "n_b": len(ids_b), "n_groups": int(n_groups[j]), "n_links": int(n_links[j])}
        at = upto
    return rows, link_a, link_b, groups


_signed: dict[int, np.ndarray] = {}


def _texts(n: int) -> np.ndarray:
    """Ids below ``n`` followed by a comma, then by a bar, then by a semicolon."""
    if n not in _signed:
        _signed[n] = np.array([f"{i}{sign}" for sign in ",|;" for i in range(n)], object)
    return _signed[n]


def encoded(docs: DataFrame, tokenizers: Tokenizers, codes: Codes, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of two kinds by chunk: its documents and links (stripe -1), and its pairs and their counts for each stripe."""
    shipped = docs.sparkSession.sparkContext.broadcast(tokenizers)
    doc_id = docs.schema["doc_id"].dataType
    one = T.StructType([T.StructField("doc_id", doc_id), *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("groups_sha256", T.StringType())])
    schema = T.StructType(
        [T.StructField("chunk", T.LongType()), T.StructField("stripe", T.IntegerType()), T.StructField("pairs", T.BinaryType()), T.StructField("counts", T.BinaryType()),
         T.StructField("links", T.BinaryType()), T.StructField("docs", T.ArrayType(one))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        tok = shipped.value
        for b in batches:
            kind = pa.list_(pa.struct([("doc_id", b.column(0).type), *[(c, pa.int64()) for c in COUNTS], ("groups_sha256", pa.string())]))
            texts = b.column(1).to_pylist()
            bounds, room = [0], 0
            for k, t in enumerate(texts):
                room += len(t or "")
                if room >= chunk_bytes:
                    bounds.append(k + 1)
                    room = 0
            for s, e in zip(bounds, [*bounds[1:], len(texts)]):
                if s == e:
                    continue
                rows, link_a, link_b, groups = align(texts[s:e], tok)
                keys, index, counts = np.unique(codes.pack(link_a, link_b), return_inverse=True, return_counts=True)
                for row, i, g in zip(rows, b.column(0)[s:e].to_pylist(), groups):
                    row |= {"doc_id": i, "groups_sha256": hashlib.sha256(g.encode()).hexdigest() if g else ""}
                stripes, first = np.unique(keys // codes.cells, return_index=True)
                parts = list(zip(first, [*first[1:], len(keys)]))
                none = [None] * len(parts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([chunk] * (len(parts) + 1), pa.int64()),
                        pa.array([-1, *stripes.tolist()], pa.int32()),
                        pa.array([None, *(_squeeze(keys[x:y] % codes.cells) for x, y in parts)], pa.binary()),
                        pa.array([None, *(_squeeze(counts[x:y]) for x, y in parts)], pa.binary()),
                        pa.array([_squeeze(index), *none], pa.binary()),
                        pa.array([rows, *none], kind),
                    ],
                    names=schema.names,
                )
                chunk += 1

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _added(parts: DataFrame, codes: Codes, keys: list[str], whole: bool) -> DataFrame:
    """Pairs and counts of each combination of ``keys`` (stripe first), added up in a dense block; ``whole`` doubles the counts and adds 1 to the best of each B id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = np.zeros(codes.cells, np.int64)
        now: tuple | None = None

        def flush() -> pa.RecordBatch:
            used = np.flatnonzero(block)
            counts = block[used]
            if whole:
                most = block.reshape(codes.rows, codes.n_a).max(axis=1)
                counts = counts * 2 + (counts == most[used // codes.n_a])
            block[used] = 0
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([_squeeze(used)], pa.binary()), pa.array([_squeeze(counts)], pa.binary())], names=["stripe", "pairs", "counts"])

        for b in batches:
            for *key, pairs, counts in zip(*(c.to_pylist() for c in b.columns)):
                if now is not None and now != tuple(key):
                    yield flush()
                now = tuple(key)
                np.add.at(block, _spread(pairs), _spread(counts))
        if now is not None:
            yield flush()

    return parts.select(*keys, "pairs", "counts").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "stripe int, pairs binary, counts binary")


def stripes(chunks: DataFrame, codes: Codes, salts: int = 1) -> DataFrame:
    """stripe, pairs, counts: cells of each stripe with twice their count over all chunks, plus 1 for the best of their B id."""
    parts = chunks.filter("stripe >= 0").withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int"))
    return _added(_added(parts, codes, ["stripe", "salt"], whole=False), codes, ["stripe"], whole=True)


def pair_counts(found: DataFrame, codes: Codes) -> DataFrame:
    """b, a, n, best: how many links hold two ids, over all documents; the dictionary between the tokenizers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stripe, pairs, counts in zip(*(c.to_pylist() for c in b.columns)):
                (a, ids), n = codes.ids(stripe, _spread(pairs)), _spread(counts)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(a), pa.array(n >> 1), pa.array(n % 2 == 1)], names=["b", "a", "n", "best"])

    return found.select("stripe", "pairs", "counts").mapInArrow(run, "b long, a long, n long, best boolean")


def scored(chunks: DataFrame, found: DataFrame, salts: int = 1) -> DataFrame:
    """Counts of each document with ``n_best`` and ``count_sum`` over its links."""

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = values = np.zeros(0, np.int64)
        for b in batches:
            out: list[tuple[int, int, bytes]] = []
            for chunk, stripe, pairs, counts in zip(*(b.column(c).to_pylist() for c in ("chunk", "stripe", "pairs", "counts"))):
                if chunk < 0:
                    cells, values = _spread(pairs), _spread(counts)
                else:
                    out.append((chunk, stripe, _squeeze(values[np.searchsorted(cells, _spread(pairs))])))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["chunk", "stripe", "counts"])

    own = ["chunk", "stripe", "salt", "pairs", "counts"]
    pairs = chunks.filter("stripe >= 0").withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int")).select(own)
    blocks = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("chunk", F.lit(-1).cast("long")).select(own)
    answers = pairs.unionByName(blocks).repartition("stripe", "salt").sortWithinPartitions("stripe", "salt", "chunk").mapInArrow(look_up, "chunk long, stripe int, counts binary")

    links = chunks.filter("stripe < 0").select("chunk", F.lit(1 << 30).alias("stripe"), F.lit(None).cast("binary").alias("counts"), "links", "docs")
    both = answers.withColumn("links", F.lit(None).cast("binary")).withColumn("docs", F.lit(None).cast(links.schema["docs"].dataType)).unionByName(links)
    one = links.schema["docs"].dataType.elementType
    schema = T.StructType([*one.fields, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            for k in range(b.num_rows):
                if b.column("counts")[k].is_valid:
                    held.append(_spread(b.column("counts")[k].as_py()))
                    continue
                docs = pa.RecordBatch.from_struct_array(b.column("docs")[k].values)
                values = np.concatenate([*held, np.zeros(0, np.int64)])[_spread(b.column("links")[k].as_py())]
                held = []
                ends = np.cumsum(docs.column("n_links").to_numpy())
                total = lambda v: np.diff(np.append(0, np.append(0, np.cumsum(v))[ends]))
                yield pa.RecordBatch.from_arrays([*docs.columns, pa.array(total(values & 1)), pa.array(total(values >> 1))], names=schema.names)

    return both.repartition("chunk").sortWithinPartitions("chunk", "stripe").mapInArrow(add_up, schema)


def alignments(docs: DataFrame, tokenizers: Tokenizers, n_stripes: int = STRIPES, chunk_bytes: int = CHUNK_BYTES, chunks_a_block: int = CHUNKS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of every document."""
    made = tokenizers.made()
    codes = Codes(len(made[1]), len(made[3]), n_stripes)
    chunks = materialized(encoded(docs, tokenizers, codes, chunk_bytes), "align-chunks")
    salts = max(1, math.ceil(chunks.filter("stripe < 0").count() / chunks_a_block))
    return scored(chunks, materialized(stripes(chunks, codes, salts), "align-stripes"), salts)

"""Line and paragraph deduplication: normalised units are digested, the earliest occurrence of each digest stays, the rest go.

A text is cut into sentences: after ``.``, ``!`` or ``?`` and the white space that follows, after ``。``, ``！``, ``？`` or
``…``, and after every line end. A unit is a paragraph of whole sentences: at every sentence with a word one unit begins,
and it takes sentences (across line ends, if need be) until it holds ``min_words`` words. So a passage that begins and ends
in mid-line shares units with its copies, whatever stands around it. In scripts written without spaces every
``CHARS`` letters count as a word. What is left at a text's end below ``min_words`` words begins no unit.

Units are normalised (A-Z lowered, white space collapsed) and digested. Order is (doc_id, digest of the text, sentence number): a sentence
is removed where it lies in a unit whose digest also occurs earlier, judged on the input. So of each repeated unit the
earliest occurrence stays: what a sentence repeats is again a sentence before it, and the first of them is in no later unit.
Offsets refer to the original text, in code points, end exclusive; neighbouring removed sentences form one span.

Shape of the job: units are emitted in Arrow batches with their digests (texts are not shuffled for this), one
map-side-combined aggregate finds the first occurrence of every digest that occurs twice or more and is written out, one
join returns to the later ones. A very frequent unit is one row of the aggregate, and adaptive execution splits the
join's probe side.

Defined results: null text is an empty one (no unit, nothing removed); rows are told apart by (doc_id, text), so equal
rows are one occurrence and stay together, and of rows with one id and different texts each loses its own repeats only;
null ids come first in order; extra columns of any name pass through, but those named as the outputs are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import materialized

#: Words of a unit. Shorter repeats are left: common notices and footers of a sentence or two are no copied passages.
MIN_WORDS = 20
#: Letters that count as one word in scripts without spaces.
CHARS = 4
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WIDE_ENDS = "。！？…"
_END = re.compile(rb"[.!?][\x20\x09-\x0D]+|\n|" + b"|".join(c.encode() for c in _WIDE_ENDS))
#: Lead bytes of the blocks whose scripts are written without spaces (from U+2E80, and Thai to Khmer in U+0E00 to U+0FFF and U+17xx).
_UNSPACED = re.compile(rb"[\xe3-\xed][\x80-\xbf]{2}|\xe0[\xb8-\xbf][\x80-\xbf]|\xe1[\x9e\x9f][\x80-\xbf]|\xf0[\xa0-\xaf][\x80-\xbf]{2}")


def _size(words: list[bytes], normal: bytes) -> int:
    """Words of a sentence."""
    return len(words) if normal.isascii() else max(len(words), -(-len(_UNSPACED.findall(normal)) // CHARS))


def sentences(text: str | None) -> tuple[list[int], list[int], list[bytes]]:
    """Borders of the sentences of a text in bytes (one more than sentences), their numbers of words, and their normal forms."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    borders = [0, *(m.end() for m in _END.finditer(raw))]
    if borders[-1] < len(raw):
        borders.append(len(raw))
    low, sizes, normal = raw.translate(_LOWER), [], []
    for s, e in zip(borders, borders[1:], strict=False):
        words = low[s:e].split()
        normal.append(b" ".join(words))
        sizes.append(_size(words, normal[-1]))
    return borders, sizes, normal


def units(text: str | None, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, bytes]]:
    """(first sentence, sentence after the last, normal form) of every unit."""
    _, sizes, normal = sentences(text)
    stop = words = 0
    for i, n in enumerate(sizes):
        while words < min_words and stop < len(sizes):
            words += sizes[stop]
            stop += 1
        if words < min_words:
            return
        if n:
            yield i, stop, b" ".join(x for x in normal[i:stop] if x)
        words -= n


def _emit(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, at, high, low = [], [], [], []
            for row, text in enumerate(b.column(2)):
                for i, j, normal in units(text.as_py(), min_words):
                    h = xxhash.xxh3_128_intdigest(normal)
                    rows.append(row)
                    at.append(i << 32 | j - i)
                    high.append((h >> 64) - (1 << 63))
                    low.append((h & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
                if len(rows) > 50_000 or row == b.num_rows - 1:
                    took = pa.array(rows, pa.int64())
                    cols = [b.column(0).take(took), b.column(1).take(took), *(pa.array(x, pa.int64()) for x in (at, high, low))]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "digest", "at", "high", "low"])
                    rows, at, high, low = [], [], [], []

    return run


def repeated_sentences(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, digest (of the text) and ``ranges`` (array<long>: first sentence << 32 | number of sentences) of the units that occur earlier."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("digest"), "text")
    found = materialized(keyed.mapInArrow(_emit(min_words), f"doc_id {kind}, digest long, at long, high long, low long"), "line-units")
    place = F.struct("doc_id", "digest", "at")
    first = found.groupBy("high", "low").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # Written first: with the aggregate right under the join, adaptive execution could not split a very common digest.
    first = materialized(first, "line-first")
    later = found.join(first, ["high", "low"]).filter(place > F.col("first"))
    return later.groupBy("doc_id", "digest").agg(F.collect_set("at").alias("ranges"))


def _cut(text: str, ranges: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """What is left of a text, and the spans removed, in code points."""
    borders, _, _ = sentences(text)
    raw = text.encode("utf-8", "surrogatepass")
    merged: list[list[int]] = []
    for i, j in sorted(ranges):
        if merged and i <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], j)
        else:
            merged.append([i, j])
    kept, spans, at, chars = [], [], 0, 0
    for i, j in merged:
        piece = raw[at : borders[i]].decode("utf-8", "surrogatepass")
        gone = len(raw[borders[i] : borders[j]].decode("utf-8", "surrogatepass"))
        kept.append(piece)
        spans.append((chars + len(piece), chars + len(piece) + gone))
        chars, at = spans[-1][1], borders[j]
    kept.append(raw[at:].decode("utf-8", "surrogatepass"))
    return "".join(kept), spans


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with kept ``text``, ``removed`` (array<struct<start, end>> into the original), ``n_removed_chars`` and ``n_units`` added."""
    added = ("text", "removed", "n_removed_chars", "n_units")
    kept = [c for c in docs.columns if c not in added]
    # Other columns travel in one struct, so that no name of theirs can meet one of ours.
    packed = docs.select(F.struct(*kept).alias("row"), "doc_id", F.xxhash64("text").alias("digest"), "text")
    hit = repeated_sentences(docs, min_words).select(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest"), "ranges")
    joined = packed.join(hit, packed["doc_id"].eqNullSafe(hit["hit_id"]) & (packed["digest"] == hit["hit_digest"]), "left").select("row", "text", "ranges")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    out = [T.StructField("text", T.StringType()), T.StructField("removed", T.ArrayType(span)), T.StructField("n_removed_chars", T.LongType()), T.StructField("n_units", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans, gone, n_units = [], [], [], []
            for text, ranges in zip(b.column(1), b.column(2), strict=True):
                text = text.as_py()
                left, cut = _cut(text, [(r >> 32, (r >> 32) + (r & 0xFFFFFFFF)) for r in ranges.as_py()]) if ranges.is_valid else (text, [])
                texts.append(left)
                spans.append([{"start": s, "end": e} for s, e in cut])
                gone.append(sum(e - s for s, e in cut))
                n_units.append(sum(1 for _ in units(text, min_words)))
            kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            cols = [b.column(0), pa.array(texts, pa.string()), pa.array(spans, kinds), pa.array(gone, pa.int64()), pa.array(n_units, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["row", *added])

    done = joined.mapInArrow(run, T.StructType([joined.schema["row"], *out]))
    return done.select("row.*", *added)

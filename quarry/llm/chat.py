"""Chat formatting on a prefix tree of conversations.

A turn is rendered as ``<|im_start|>role\\ntext <|im_end|>\\n``; control strings inside a text are broken by one more
backslash after their first character (so none of them stands in the output whole), which reading back takes out again. Conversations that share initial turns share tree nodes; a node
is named by the digest of its whole prefix. Whole copies collapse first (a map-side-combined aggregate on the last
digest), so a very common conversation is one row. Distinct conversations are then range-partitioned by their path of digests, so
that a very common first turn is spread over many tasks, and walked in that order, which is depth-first order of the tree.

Each task writes shards of about ``SHARD`` tokens (code points here): within a shard every node's tokens stand once,
with its start in the shard, the position id of its first token (its depth in tokens) and the shard intervals of its
ancestors, which together with its own earlier tokens are all it attends to. A tree that spans shards repeats the open
ancestors at the head of the next one.

Defined results: null text and null role are empty; turns are ordered by (turn, role, text), so ties and repeated rows
are turns of their own; a conversation is one row of the grouped table (its length bounds memory); rows with a null
conv_id form one conversation; an empty table gives empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialized

START, END = "<|im_start|>", " <|im_end|>\n"
# Control strings of common chat templates.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|system|>", "<|user|>", "<|assistant|>"]
#: Patterns of control strings with any, or with one or more, backslashes after their first character.
BROKEN = {mark: "|".join(re.escape(t[0]) + rf"\\{mark}" + re.escape(t[1:]) for t in CONTROL) for mark in "*+"}
_RAW, _SAFE = re.compile(BROKEN["*"]), re.compile(BROKEN["+"])
SHARD = 1 << 18
PACKED = (
    "shard string, seq long, node binary, depth int, tokens string, start long, stop long, position long, "
    "ancestors array<struct<start:long,stop:long>>, loss_start long, loss_stop long, ends_conversation boolean"
)


def escape(text: str) -> str:
    return _RAW.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _SAFE.sub(lambda m: m[0][0] + m[0][2:], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn's tokens, and the range in them that the loss covers (empty unless the assistant speaks)."""
    head, body = f"{START}{quote(role, safe='')}\n", escape(text)
    return head + body + END, len(head), len(head) + (len(body) if role == "assistant" else 0)


def parse(tokens: str) -> tuple[str, str]:
    """Role and text of a rendered turn."""
    role, _, body = tokens[len(START) :].partition("\n")
    return unquote(role), unescape(body[: -len(END)])


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, path (16-byte digests of all prefixes, joined), leaf (the last of them) and turns (array of role and text)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    grouped = grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = []
            for turns_ in b.column(1).to_pylist():
                digest, path = b"", []
                for t in turns_:
                    role, text = t["role"].encode(), t["text"].encode("utf-8", "surrogatepass")
                    digest = hashlib.md5(digest + b"%d:" % len(role) + role + text).digest()
                    path.append(digest)
                paths.append(b"".join(path))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths, pa.binary()), pa.array([p[-16:] for p in paths], pa.binary()), b.column(1)], names=["conv_id", "path", "leaf", "turns"])

    return grouped.mapInArrow(name, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, path binary, leaf binary, turns array<struct<role:string,text:string>>")


def pack(named: DataFrame) -> DataFrame:
    """The tree's shards (columns PACKED) of the distinct conversations in ``named``."""
    distinct = named.groupBy("leaf").agg(F.first("path").alias("path"), F.first("turns").alias("turns"))
    ordered = distinct.repartitionByRange("path").sortWithinPartitions("path").select("path", "turns", F.spark_partition_id().alias("part"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in re.sub(r"<[^>]*>+", "", PACKED).split(", ")]
        open_: list[tuple[bytes, int, int, int]] = []  # node, start, stop, position of the path to the last conversation
        shard, at, seq = 0, 0, 0
        for b in batches:
            rows = []
            for path, turns, part in zip(b.column(0), b.column(1), b.column(2), strict=True):
                path, turns, part = path.as_py(), turns.as_py(), part.as_py()
                nodes = [path[i : i + 16] for i in range(0, len(path), 16)]
                if at > SHARD:
                    shard, at, seq, open_ = shard + 1, 0, 0, []
                shared = 0
                while shared < min(len(open_), len(nodes)) and open_[shared][0] == nodes[shared]:
                    shared += 1
                del open_[shared:]
                for depth in range(shared, len(nodes)):
                    tokens, loss_from, loss_to = render(turns[depth]["role"], turns[depth]["text"])
                    position = open_[-1][3] + open_[-1][2] - open_[-1][1] if open_ else 0
                    rows.append((f"{part}-{shard}", seq, nodes[depth], depth, tokens, at, at + len(tokens), position, [{"start": s, "stop": e} for _, s, e, _ in open_], at + loss_from, at + loss_to, depth == len(nodes) - 1))
                    open_.append((nodes[depth], at, at + len(tokens), position))
                    at, seq = at + len(tokens), seq + 1
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = [pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.int64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return ordered.mapInArrow(walk, PACKED)


def read_back(packed: DataFrame) -> DataFrame:
    """leaf, and what its conversation reads as in the shards: turns digest, loss text digest and sizes."""

    def shard(key, table):
        out = {"leaf": [], "n_turns": [], "turns_sha256": [], "loss_chars": [], "loss_sha256": [], "formatted_chars": []}
        open_: list[dict] = []
        for r in table.sort_by("seq").to_pylist():
            del open_[len(r["ancestors"]) :]
            if [(a["start"], a["stop"]) for a in r["ancestors"]] != [(o["start"], o["stop"]) for o in open_]:
                raise ValueError(f"shard {r['shard']} is not in depth-first order at {r['seq']}")
            open_.append(r)
            if r["ends_conversation"]:
                turns, loss, n_loss = hashlib.sha256(), hashlib.sha256(), 0
                for o in open_:
                    role, text = parse(o["tokens"])
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    said = unescape(o["tokens"][o["loss_start"] - o["start"] : o["loss_stop"] - o["start"]])
                    loss.update(said.encode("utf-8", "surrogatepass"))
                    n_loss += len(said)
                for k, v in zip(out, (r["node"], len(open_), turns.hexdigest(), n_loss, loss.hexdigest(), r["position"] + r["stop"] - r["start"]), strict=True):
                    out[k].append(v)
        return pa.table(out, schema=pa.schema([("leaf", pa.binary()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

    return packed.groupBy("shard").applyInArrow(shard, "leaf binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation: what reading its formatted form back gives."""
    named = materialized(conversations(turns), "chat-paths")
    read = read_back(materialized(pack(named), "chat-packed")).dropDuplicates(["leaf"])
    return named.select("conv_id", "leaf").join(read, "leaf").drop("leaf")

"""Chat formatting as packed prefix trees.

Conversations that share their first turns share the tokens of those turns. Each conversation gets a path, the chain of
hashes of its turns; sorted by path, conversations that share a prefix are neighbours and the order is the depth-first order of the
prefix tree. A range of the order is one task, which walks its conversations with the current branch as a stack: a turn that
equals the branch's turn at that depth is shared, any other one opens a node and is emitted once. A pack closes
when it is full, so shared turns are emitted once for each pack; a first turn that a third of all conversations have fills many packs
in many tasks, since ties of the path are dealt by conv_id.

A pack holds token ids, position ids (counted along the branch, not the pack), nodes with parent, token range, loss range and
the intervals of tokens that it attends to (its ancestors; within a node attention is causal), and the last node of each conversation.

Template: ``<turn:ROLE>TEXT</turn>``, with backslash and angle brackets escaped inside role and text, so that no text can
forge a control string. The loss mask covers the texts of assistant turns.

Defined results: null roles and texts count as empty; rows of equal conv_id and turn all stay, ordered by role and text; null conv_ids
are one conversation; repeated conversations share their last node; an empty table gives no packs; further columns are not carried. A single
conversation must fit in a task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byte_bpe
from .common import partitions

#: A pack closes at so many code points or conversations.
PACK_CHARS, PACK_CONVERSATIONS = 1 << 16, 4096
ESCAPES = {"\\": "\\\\", "<": "\\(", ">": "\\)"}
PLAIN = {v[1]: k for k, v in ESCAPES.items()}
TURN = re.compile(r"<turn:([^<>]*)>([^<>]*)</turn>")
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return re.sub(r"[\\<>]", lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: PLAIN[m[1]], text)


def gathered(rows: DataFrame) -> DataFrame:
    """``(conv_id, turns, path)`` from rows by turn; the path chains a hash for each turn."""
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    zero = F.array().cast("array<bigint>")
    path = F.aggregate("turns", zero, lambda acc, t: F.concat(acc, F.array(F.xxhash64(F.get(acc, F.size(acc) - 1), t["role"], t["text"]))))
    return convs.withColumn("path", path)


class Packer:
    """Builds packs from conversations in depth-first order."""

    def __init__(self, model: byte_bpe.ByteBPE):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.nodes: list[tuple[int, str, str]] = []  # parent, role, text
        self.branch: list[int] = []
        self.convs: list[tuple[int | None, int]] = []
        self.chars = 0

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> dict | None:
        """Put a conversation in; returns the pack that it had to close before, if any."""
        shared = 0
        while shared < min(len(turns), len(self.branch)) and self.nodes[self.branch[shared]][1:] == turns[shared]:
            shared += 1
        more = sum(len(r) + len(t) for r, t in turns[shared:])
        closed = None
        if self.convs and (self.chars + more > PACK_CHARS or len(self.convs) >= PACK_CONVERSATIONS):
            closed, shared = self.close(), 0
        del self.branch[shared:]
        for role, text in turns[shared:]:
            self.nodes.append((self.branch[-1] if self.branch else -1, role, text))
            self.branch.append(len(self.nodes) - 1)
            self.chars += len(role) + len(text)
        self.convs.append((conv_id, self.branch[-1]))
        return closed

    def close(self) -> dict:
        parts = [x for _, role, text in self.nodes for x in (f"<turn:{escape(role)}>", escape(text), "</turn>")]
        ids = [np.frombuffer(x, dtype="<u4") for x in self.model.encode_many(parts)]
        nodes, positions, begin = [], [], 0
        depth_end: list[int] = []
        attends: list[list[dict]] = []
        for i, (parent, role, _) in enumerate(self.nodes):
            head, body, tail = ids[3 * i : 3 * i + 3]
            n = len(head) + len(body) + len(tail)
            first = depth_end[parent] if parent >= 0 else 0
            positions.append(np.arange(first, first + n))
            depth_end.append(first + n)
            seen: list[dict] = []
            if parent >= 0:
                seen = [dict(x) for x in attends[parent]]
                own = nodes[parent]
                if seen and seen[-1]["end"] == own["start"]:
                    seen[-1]["end"] = own["end"]
                else:
                    seen.append({"start": own["start"], "end": own["end"]})
            attends.append(seen)
            loss = (begin + len(head), begin + len(head) + len(body)) if role == LOSS_ROLE else (begin, begin)
            nodes.append({"parent": parent, "start": begin, "end": begin + n, "loss_start": loss[0], "loss_end": loss[1], "attends": seen})
            begin += n
        pack = {
            "tokens": np.concatenate(ids).astype(np.int32), "positions": np.concatenate(positions).astype(np.int32), "nodes": nodes,
            "convs": [{"conv_id": c, "node": n} for c, n in self.convs],
        }
        self.clear()
        return pack


INTERVALS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
NODE = pa.struct([*((n, pa.int32()) for n in ("parent", "start", "end", "loss_start", "loss_end")), ("attends", INTERVALS)])


def packs(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(pack, tokens, positions, nodes, convs)`` from ``rows(conv_id, turn, role, text)``."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    n = partitions(rows.sparkSession)
    ordered = gathered(rows).repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "turns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, made = Packer(byte_bpe.model(path, pattern)), 0
        base = TaskContext.get().partitionId() << 32

        def row(pack: dict, id_type: pa.DataType) -> pa.RecordBatch:
            nonlocal made
            made += 1
            convs = pa.list_(pa.struct([("conv_id", id_type), ("node", pa.int32())]))
            types = {"pack": pa.int64(), "tokens": pa.list_(pa.int32()), "positions": pa.list_(pa.int32()), "nodes": pa.list_(NODE), "convs": convs}
            pack["pack"] = base + made
            return pa.RecordBatch.from_arrays([pa.array([pack[c]], t) for c, t in types.items()], names=list(types))

        id_type = None
        for batch in batches:
            id_type = batch.column("conv_id").type
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for conv, turns in zip(part.column("conv_id").to_pylist(), part.column("turns").to_pylist(), strict=True):
                    closed = packer.add(conv, [(t["role"], t["text"]) for t in turns])
                    if closed:
                        yield row(closed, id_type)
        if packer.convs:
            yield row(packer.close(), id_type)

    nodes = "array<struct<parent:int,start:int,end:int,loss_start:int,loss_end:int,attends:array<struct<start:int,end:int>>>>"
    return ordered.mapInArrow(run, f"pack long, tokens array<int>, positions array<int>, nodes {nodes}, convs array<struct<conv_id:{kind},node:int>>")


def read_back(packed: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` from the tokens of each branch."""
    kind = packed.schema["convs"].dataType.elementType["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digests(decode, tokens: np.ndarray, nodes: list[dict], leaf: int) -> tuple:
        branch, at = [], leaf
        while at >= 0:
            branch.append(nodes[at])
            at = nodes[at]["parent"]
        branch.reverse()
        whole = decode(np.concatenate([tokens[n["start"] : n["end"]] for n in branch]))
        loss = "".join(unescape(decode(tokens[n["loss_start"] : n["loss_end"]])) for n in branch)
        turns = [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(whole)]
        if sum(m.end() - m.start() for m in TURN.finditer(whole)) != len(whole):
            raise ValueError("a branch does not follow the template")
        text = "".join(f"{r}\n{t}\n" for r, t in turns)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return len(turns), sha(text), len(loss), sha(loss), len(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_bpe.model(path, pattern)
        decode = lambda ids: model.decode(ids.astype("<u4").tobytes()).decode()
        for batch in batches:
            for i in range(batch.num_rows):
                tokens = batch.column("tokens")[i].values.to_numpy(zero_copy_only=False)
                nodes, convs = batch.column("nodes")[i].as_py(), batch.column("convs")[i].values
                leaves = convs.field("node").to_pylist()
                known = {leaf: digests(decode, tokens, nodes, leaf) for leaf in set(leaves)}
                cols = list(zip(*(known[leaf] for leaf in leaves), strict=True))
                types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([convs.field("conv_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    return packed.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

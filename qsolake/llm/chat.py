"""Chat formatting as a prefix tree.

Conversations are range-sorted by the hashes of their turns, so those with the same first turns stand together in
depth-first order. A task walks its range, keeps the path of the last conversation and emits only the turns below
the common part: each shared turn's tokens appear once in a block. A block is one training row: token ids, position
ids (a token's place on its own path), a loss mask, and for each node the intervals of its ancestors and itself,
which are all that its tokens attend to. Blocks are closed at BLOCK_TOKENS tokens or BLOCK_CONVERSATIONS, and the
next block repeats the path it starts with, so a first turn that a third of all conversations share is spread
over many blocks.

The template writes a turn as <turn ROLE>TEXT</turn> and a line feed, with \\, < and > of role and text behind a \\,
so no text can imitate a marker and every one is read back as it was.

Defined cases: a null text or role is empty; turns are ordered by turn, nulls first, then role and text; turns that
repeat a number all stay; rows with a null conversation id are one conversation; an empty table gives no block;
other columns are ignored. One conversation is formatted by one task."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qsolake.llm.common import short_batches, tasks
from qsolake.llm.tokens import byte_alphabet, default_tokenizer, encoder

BLOCK_TOKENS, BLOCK_CONVERSATIONS = 16_384, 256
LOSS_ROLE = "assistant"
TURN = re.compile(r"<turn ((?:\\.|[^\\<>])*)>((?:\\.|[^\\<>])*)</turn>\n", re.DOTALL)
INTERVAL = pa.struct([("start", pa.int32()), ("end", pa.int32())])
NODE = pa.struct(
    [("parent", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("position", pa.int32()), ("attends", pa.list_(INTERVAL))]
)
CONVERSATION = pa.struct([("conv_id", pa.int64()), ("leaf", pa.int32())])
SCHEMA = pa.schema(
    [("block_id", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("position_ids", pa.list_(pa.int32())),
     ("loss_mask", pa.list_(pa.bool_())), ("nodes", pa.list_(NODE)), ("conversations", pa.list_(CONVERSATION))]
)
BLOCKS = (
    "block_id long, token_ids array<int>, position_ids array<int>, loss_mask array<boolean>, "
    "nodes array<struct<parent:int,start:int,end:int,position:int,attends:array<struct<start:int,end:int>>>>, "
    "conversations array<struct<conv_id:long,leaf:int>>"
)
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escaped(text: str) -> str:
    return re.sub(r"([\\<>])", r"\\\1", text)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def parsed(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; anything that isn't a turn is an error."""
    out, at = [], 0
    while at < len(text):
        found = TURN.match(text, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        out.append((unescaped(found[1]), unescaped(found[2])))
        at = found.end()
    return out


class _Block:
    def __init__(self):
        self.ids, self.positions, self.loss = [], [], []
        self.nodes, self.path, self.conversations, self.size = [], [], [], 0

    def add(self, conv_id: int, turns: list[tuple[str, str]], code) -> None:
        shared = 0
        while shared < min(len(turns), len(self.path)) and self.path[shared][0] == turns[shared]:
            shared += 1
        del self.path[shared:]
        for turn in turns[shared:]:
            role, text = turn
            parts = [np.frombuffer(code.ids(x), code.dtype) for x in (f"<turn {escaped(role)}>", escaped(text), "</turn>\n")]
            n = sum(map(len, parts))
            parent = self.path[-1][1] if self.path else -1
            position = self.nodes[parent]["position"] + self.nodes[parent]["end"] - self.nodes[parent]["start"] if self.path else 0
            own = {"start": self.size, "end": self.size + n}
            attends = [*(self.nodes[parent]["attends"] if self.path else []), own]
            if len(attends) > 1 and attends[-2]["end"] == own["start"]:  # neighbours are one interval
                attends = [*attends[:-2], {"start": attends[-2]["start"], "end": own["end"]}]
            self.nodes.append({"parent": parent, **own, "position": position, "attends": attends})
            self.ids += parts
            self.positions.append(np.arange(position, position + n))
            mask = np.zeros(n, bool)
            if role == LOSS_ROLE:
                mask[len(parts[0]) : len(parts[0]) + len(parts[1])] = True
            self.loss.append(mask)
            self.size += n
            self.path.append((turn, len(self.nodes) - 1))
        self.conversations.append({"conv_id": conv_id, "leaf": self.path[-1][1]})

    def row(self, block_id: int) -> pa.RecordBatch:
        flat = lambda x: np.concatenate([*x, np.zeros(0, int)])
        values = [block_id, flat(self.ids).astype(np.int32), flat(self.positions).astype(np.int32), flat(self.loss).astype(bool), self.nodes, self.conversations]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, SCHEMA)], schema=SCHEMA)


def chat_blocks(conversations: DataFrame, *, tokenizer: str | None = None) -> DataFrame:
    """conversations (conv_id, turn, role, text) as blocks of prefix trees."""
    tokenizer = tokenizer or default_tokenizer()
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = short_batches(conversations).groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    keyed = whole.withColumn("path", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, first, n = encoder(tokenizer, True), TaskContext.get().partitionId() << 32, 0
        block = _Block()
        for batch in batches:
            for conv_id, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if block.size >= BLOCK_TOKENS or len(block.conversations) >= BLOCK_CONVERSATIONS:
                    yield block.row(first + n)
                    block, n = _Block(), n + 1
                block.add(conv_id, [(t["role"], t["text"]) for t in turns], code)
        if block.conversations:
            yield block.row(first + n)

    ranges = keyed.repartitionByRange(tasks(conversations.sparkSession), "path", "conv_id").sortWithinPartitions("path", "conv_id")
    return ranges.select("conv_id", "turns").mapInArrow(build, BLOCKS)


def read_conversations(blocks: DataFrame, *, tokenizer: str | None = None) -> DataFrame:
    """Each conversation's turns and loss text, read back from the blocks' tokens, as digests."""
    tokenizer = tokenizer or default_tokenizer()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer, True)
        bytes_of = {c: b for b, c in byte_alphabet().items()}
        pieces: dict[int, bytes] = {}

        def text(ids: list[int]) -> str:
            for i in set(ids):
                if i not in pieces:
                    pieces[i] = bytes(bytes_of[c] for c in code.tokenizer.id_to_token(i))
            return b"".join([pieces[i] for i in ids]).decode()

        def digest(parts: list[str]) -> str:
            return hashlib.sha256("".join(parts).encode()).hexdigest()

        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                shown, lost = [], []
                for node in row["nodes"]:
                    ids = row["token_ids"][node["start"] : node["end"]]
                    mask = row["loss_mask"][node["start"] : node["end"]]
                    shown.append(text(ids))
                    lost.append(unescaped(text([i for i, m in zip(ids, mask) if m])))
                out = []
                for conv in row["conversations"]:
                    path, at = [], conv["leaf"]
                    while at >= 0:
                        path.append(at)
                        at = row["nodes"][at]["parent"]
                    path.reverse()
                    formatted = "".join(shown[i] for i in path)
                    turns, loss = parsed(formatted), [lost[i] for i in path]
                    out.append((conv["conv_id"], len(turns), digest([f"{r}\n{t}\n" for r, t in turns]), sum(map(len, loss)), digest(loss), len(formatted)))
                names = [f.split()[0] for f in READ.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if "sha" in n else pa.int64()) for n, c in zip(names, zip(*out))], names)

    return blocks.mapInArrow(read, READ)

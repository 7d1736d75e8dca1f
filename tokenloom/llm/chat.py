"""Chat formatting into prefix trees.

Conversations that share their initial turns are merged: sorted by the hashes
of their turns, they are range-partitioned (by path and id, so a first turn or
a whole conversation that very many share is spread) and streamed in depth-first
order.  Each shared turn is emitted once per partition as a node with its token
ids, the position id of its first token (tokens of its ancestors before it), and
the intervals of the tree's stream that its ancestors occupy (neighbouring ones
merged, so an unbranched path is one interval): a token attends to these and,
causally, to its own node.  Only the current path is held in memory.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``.  Control strings inside roles
and texts get a backslash after their first character, backslashes are doubled
and newlines of roles written as ``\\n``; undoing this gives back the input
exactly.  The loss covers the texts of assistant turns, nothing around them.

Edge cases: rows without a turn number come first, ties go by role, then text;
null roles and texts are empty; rows without a conversation id form one
conversation of their own; repeated rows are repeated turns; an empty table
gives no nodes.  A single conversation is formatted in one task.
"""
from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import by_value
from tokenloom.llm.tokens import encoder

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
CONTROL = re.compile(r"\\|<\||</?s>|\[/?INST\]|<</?SYS>>")
NODE = pa.schema([
    ("part", pa.int32()), ("seq", pa.int64()), ("kind", pa.string()), ("tree", pa.int64()), ("depth", pa.int32()),
    ("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_from", pa.int32()), ("loss_to", pa.int32()),
    ("token_ids", pa.list_(pa.int32())), ("loss_tokens_from", pa.int32()), ("loss_tokens_to", pa.int32()),
    ("start", pa.int64()), ("position", pa.int64()),
    ("attends", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])
NODE_DDL = ("part int, seq long, kind string, tree long, depth int, conv_id long, formatted string, loss_from int, "
            "loss_to int, token_ids array<int>, loss_tokens_from int, loss_tokens_to int, start long, position long, "
            "attends array<struct<start: bigint, stop: bigint>>")


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """Head, body and tail of a formatted turn."""
    return OPEN + escape(role).replace("\n", "\\n") + "\n", escape(text), CLOSE


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if not (formatted.startswith(OPEN) and formatted.endswith(CLOSE)):
        raise ValueError("not a formatted turn")
    role, body = formatted[len(OPEN):-len(CLOSE)].split("\n", 1)
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)
    return role, unescape(body)


def _tokens(path: str | None, *texts: str) -> list[list[int]]:
    """Token ids of each text; without a tokenizer every code point is a token."""
    if path is None:
        return [[ord(c) for c in t] for t in texts]
    enc = encoder(path)
    return [list(memoryview(enc.encode(t)).cast("I")) for t in texts]


def _emit(tokenizer_path: str | None, trained: str):
    def emit(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        # the current path: (turn, tokens up to its end, intervals of it and its ancestors)
        path: list[tuple[tuple[str, str], int, list[tuple[int, int]]]] = []
        seq = tree = stream = 0
        for batch in batches:
            out = {name: [] for name in NODE.names}

            def add(**row):
                for name in NODE.names:
                    out[name].append(row.get(name))

            for conv_id, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist()):
                turns = [(t["role"], t["text"]) for t in turns]
                same = 0
                while same < min(len(path), len(turns)) and path[same][0] == turns[same]:
                    same += 1
                del path[same:]
                if not same and turns:
                    tree, stream = tree + 1, 0
                for depth in range(same, len(turns)):
                    role, text = turns[depth]
                    head, body, tail = format_turn(role, text)
                    a, b, c = _tokens(tokenizer_path, head, body, tail)
                    learns = role == trained
                    n = len(a) + len(b) + len(c)
                    _, position, seen = path[-1] if path else (None, 0, [])
                    add(part=part, seq=seq, kind="turn", tree=tree, depth=depth, formatted=head + body + tail,
                        loss_from=len(head) if learns else None, loss_to=len(head) + len(body) if learns else None,
                        token_ids=a + b + c, loss_tokens_from=len(a) if learns else None,
                        loss_tokens_to=len(a) + len(b) if learns else None, start=stream,
                        position=position, attends=[{"start": start, "stop": stop} for start, stop in seen])
                    # neighbours in the stream are one interval
                    seen = ([*seen[:-1], (seen[-1][0], stream + n)] if seen and seen[-1][1] == stream
                            else [*seen, (stream, stream + n)])
                    path.append((turns[depth], position + n, seen))
                    stream += n
                    seq += 1
                add(part=part, seq=seq, kind="end", tree=tree, depth=len(turns), conv_id=conv_id)
                seq += 1
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in NODE], schema=NODE)
    return emit


def prefix_trees(conversations: DataFrame, tokenizer_path: str | None = None, conv_col: str = "conv_id",
                 turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                 trained: str = "assistant") -> DataFrame:
    """Nodes in depth-first order of (part, seq): rows of kind ``turn`` carry a
    merged turn, rows of kind ``end`` a conversation that ends at the last node."""
    said = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    whole = (conversations.select(F.col(conv_col).cast("long").alias("conv_id"), said.alias("t"))
             .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))
    step = F.transform("turns", lambda t: F.substring(F.sha2(F.concat_ws("\n", t["role"], t["text"]).cast("binary"), 256), 1, 24))
    return (whole.withColumn("path", F.array_join(step, ""))
            .repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
            .mapInArrow(_emit(tokenizer_path, trained), NODE_DDL))


def _read(batches):
    path: list[tuple[str, str, str]] = []  # of the current path: formatted, loss text
    part = None
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if r["part"] != part:
                part, path = r["part"], []
            del path[r["depth"]:]
            if r["kind"] == "turn":
                f = r["formatted"]
                path.append((f, unescape(f[r["loss_from"]:r["loss_to"]]) if r["loss_from"] is not None else ""))
                continue
            said, loss = hashlib.sha256(), "".join(x for _, x in path)
            for f, _ in path:
                role, text = parse_turn(f)
                said.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            rows.append({"conv_id": r["conv_id"], "n_turns": len(path), "turns_sha256": said.hexdigest(),
                         "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(),
                         "formatted_chars": sum(len(f) for f, _ in path)})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_back(nodes: DataFrame) -> DataFrame:
    """The conversations as the written nodes hold them: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    return (nodes.select("part", "seq", "kind", "depth", "conv_id", "formatted", "loss_from", "loss_to")
            .repartition("part").sortWithinPartitions("part", "seq")
            .mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                               "formatted_chars long"))


by_value(__name__)

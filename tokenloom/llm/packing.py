"""Best-fit packing with certified bounds.

A text becomes its token ids and a closing id 0; only longer ones are cut into
pieces of the capacity, the first of which may be shorter.  Pieces (integer
lengths, 1 to the capacity) are dealt by a keyed hash into groups of about
``group_rows`` and packed by best-fit decreasing.

Certificate: for every group, dual feasible functions u_k (Fekete and Schepers'
rounding family) and the threshold family f_t map lengths to values whose sum
bounds the number of sequences from below.  A group that meets its bound is
proved optimal and stays.  Groups with a gap exchange documents: the pieces of
their sequences that are not full are pooled, dealt anew by another hash and
packed again.  A round is kept only if it needs fewer sequences; rounds end
when every group is certified or nothing is gained.

Edge cases: a null or empty text is the single id 0; repeated rows are packed
as often as they occur; an empty table gives an empty result.  No piece is
dropped, and no group grows with the input.
"""
from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import Scratch, by_value
from tokenloom.llm.tokens import encoder

CAPACITY = 2048
GROUP_ROWS = 8192
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECE_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a text of ``n`` ids."""
    head = n % capacity or capacity
    return [(0, head), *((at, capacity) for at in range(head, n, capacity))]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    def split(batches):
        enc = encoder(tokenizer_path)
        for batch in batches:
            row, out = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = memoryview(enc.encode(text) + b"\0\0\0\0")
                for k, (at, n) in enumerate(cut(len(ids) // 4, capacity)):
                    row.append(i)
                    out.append((k, at, n, zlib.crc32(ids[4 * at:4 * (at + n)])))
            k, at, n, crc = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(k, pa.int32()), pa.array(at, pa.int64()),
                 pa.array(n, pa.int64()), pa.array(crc, pa.int64())], PIECE_COLUMNS)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return slim.mapInArrow(split, PIECE)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Largest bound of the dual feasible functions: sequences needed at least."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    best = -(-int((count * x).sum()) // capacity)
    # f_t: lengths over capacity - t count whole, those below t not at all
    at_least = np.cumsum(count[::-1])[::-1]
    mass = np.cumsum((count * x)[::-1])[::-1]
    t = np.arange(1, capacity // 2 + 1)
    whole = np.concatenate((at_least, [0]))[capacity - t + 1]
    middle = mass[t] - np.concatenate((mass, [0]))[capacity - t + 1]
    best = max(best, int((whole + -(-middle // capacity)).max()))
    # u_k: a length x with (k + 1) x divisible by the capacity keeps its share,
    # others are rounded down to a multiple of 1 / k
    for k in range(1, 41):
        up = (k + 1) * x
        even = up % capacity == 0
        total = int((count[even] * x[even] * k).sum()) + capacity * int((count[~even] * (up[~even] // capacity)).sum())
        best = max(best, -(-total // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: (sequence of each piece, its offset, sequences)."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, used = 0, 0  # bit r of rooms: a sequence with room r is open
    for i in order.tolist():
        n = int(lengths[i])
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            bin_ = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, bin_, used = capacity, used, used + 1
        where[i], offset[i] = bin_, capacity - room
        if room > n:
            open_by_room[room - n].append(bin_)
            rooms |= 1 << (room - n)
    return where, offset, used


def _pack(capacity: int):
    def pack(table: pa.Table) -> pa.Table:
        uid, lengths = table.column("uid").to_numpy(), table.column("length").to_numpy()
        order = np.argsort(uid, kind="stable")  # the same result whatever order the rows came in
        table, lengths = table.take(pa.array(order)), lengths[order]
        where, offset, used = best_fit(lengths, capacity)
        fill = np.bincount(where, lengths, minlength=used).astype(np.int64)
        bound = lower_bound(lengths, capacity)
        for name, values in (("bin", where), ("offset", offset), ("room", capacity - fill[where]),
                             ("used", np.full(len(where), used)), ("bound", np.full(len(where), bound))):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table
    return pack


def pack_pieces(rows: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS,
                rounds: int = 4) -> DataFrame:
    """Pack rows with a ``length`` (1 to capacity): the same columns plus
    sequence_id and offset."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "packing")
    cols = rows.columns
    # written once, so that the row numbers below stay the same
    state = scratch.keep(rows.withColumn("uid", F.monotonically_increasing_id()))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema) + (
        ", grp long, bin long, offset long, room long, used long, bound long")

    def deal(df: DataFrame, seed: int) -> DataFrame:
        groups = max(1, -(-df.count() // group_rows))
        # numbers of a round never meet those of another: the round is in the high bits
        grp = F.pmod(F.xxhash64(F.col("uid"), F.lit(seed)), F.lit(groups)) + F.lit(seed << 36)
        return df.withColumn("grp", grp).groupBy("grp").applyInArrow(_pack(capacity), schema)

    packed = scratch.keep(deal(state, 0))
    done = []  # certified or full sequences; each piece is in one of these tables
    for seed in range(1, rounds + 1):
        gap = packed.filter("used > bound and room > 0")
        stay = packed.filter("not (used > bound and room > 0)")
        before = gap.select("grp", "bin").distinct().count()
        if before == 0:
            break
        again = scratch.keep(deal(gap.select(*state.columns), seed))
        after = again.select("grp", "bin").distinct().count()
        if after >= before:
            break
        done.append(stay)
        packed = again
    out = packed
    for d in done:
        out = out.unionByName(d)
    # a group has about group_rows rows, so fewer than 2^20 sequences
    return out.select(*cols, (F.col("grp") * (1 << 20) + F.col("bin")).alias("sequence_id"), "offset")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset."""
    return pack_pieces(pieces(docs, tokenizer_path, id_col, text_col, capacity), capacity, group_rows)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """The packed token ids themselves: sequence_id, ids (array of int), one row
    per sequence.  Ids must be unique; pieces meet by sequence."""
    def ids_of(batches):
        enc = encoder(tokenizer_path)
        for pdf in batches:
            yield pd.DataFrame({"sequence_id": pdf["sequence_id"], "offset": pdf["offset"], "ids": [
                np.frombuffer(enc.encode(t) + b"\0\0\0\0", "<u4")[s:s + n].astype(np.int32)
                for t, s, n in zip(pdf["text"], pdf["start"], pdf["length"])]})

    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    placed = packed.select("doc_id", "start", "length", "sequence_id", "offset").join(texts, "doc_id")
    return (placed.mapInPandas(ids_of, "sequence_id long, offset long, ids array<int>")
            .groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
            .select("sequence_id", F.flatten(F.col("p.ids")).alias("ids")))


by_value(__name__)

"""Benchmark decontamination by a generalised suffix automaton.

Test items and documents are lower-cased (A-Z) and cut into words, runs of
digits, a-z and every character above ASCII.  A window is ``window``
consecutive words of an item; an item of fewer words, but not none, is one
window as a whole.

The items are dealt by a hash into blocks of about ``block_words`` words.  Each
block becomes one generalised suffix automaton over word numbers, built by a
Spark task (one item stays whole).  Documents stream through it: after each
word the automaton's state and match length say how long the longest item
passage is that ends there.  A match of ``window`` words or more ends an
occurrence of a window; the state names the items that hold it.  Short items
are found by suffix links.  One automaton is broadcast at a time, so a task
holds one block, whatever the size of the item table; more blocks are more
passes over the documents.

``scan`` reports the spans, ``decontaminate`` cuts them out and drops the
documents in which they cover more than ``max_coverage`` of the words.

Edge cases: null and wordless texts have no words and no hits; a wordless item
is never found; rows repeating an item id are one item with several texts, a
null item id reads as ''; repeated document rows are scanned alike; with no
items nothing is hit; an empty document table gives an empty result.  Columns
other than the id and the text are not read.
"""
from __future__ import annotations

import marshal
import re
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm.common import Scratch, by_value, process_store

WINDOW = 10
BLOCK_WORDS = 250_000
STEP = 1 << 20  # bytes of a text cut into words at a time
#: A-Z to lower case; digits, letters and all bytes above ASCII stay, everything else parts words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def word_runs(text: str | None):
    """The words of a text as lists of UTF-8 strings, a bounded stretch at a time."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(FOLD)
    at = 0
    while at < len(data):
        stop = data.find(b" ", at + STEP)
        stop = len(data) if stop < 0 else stop
        yield data[at:stop].split()
        at = stop


class Automaton:
    """Generalised suffix automaton of the items of one block."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of the longest string of p followed by c, q's own or a clone of it."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = len(self.length)
        self.step.append(dict(self.step[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.step[last].get(c)
        if q is not None:
            return self._split(last, c, q)
        state, p = len(self.length), last
        self.step.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, c, self.step[p][c])
        return state

    def build(self, items: list[tuple[str, list[bytes]]]) -> "Automaton":
        known = [(name, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for name, words in items if words]
        for _, ids in known:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        # the state that holds the last ``window`` words of a state's strings
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        self.full = [-1] * len(self.length)
        for v in order:
            up = self.link[v]
            self.full[v] = self.full[up] if self.full[up] >= 0 else v if self.length[v] >= self.window else -1
        self.holders: dict[int, list[str]] = {}
        self.whole: dict[int, list[tuple[int, str]]] = {}
        for name, ids in known:
            v, short = 0, len(ids) < self.window
            for n, c in enumerate(ids, 1):
                v = self.step[v][c]
                # the walk's string may be shorter than its state's longest one
                if not short and n >= self.window:
                    held = self.holders.setdefault(self.full[v], [])
                    if not held or held[-1] != name:
                        held.append(name)
            if short:
                self.whole.setdefault(v, []).append((len(ids), name))
        # the nearest state on the way up, itself included, that holds a whole short item
        self.short = [-1] * len(self.length)
        for v in order:
            self.short[v] = v if v in self.whole else self.short[self.link[v]]
        self.least = min((min(len(ids), self.window) for _, ids in known), default=0)
        return self

    def dump(self) -> bytes:
        size = max(1, len(self.vocab))
        moves = {v * size + c: q for v, row in enumerate(self.step) for c, q in row.items()}
        return marshal.dumps((self.window, self.vocab, moves, self.length, self.link, self.full, self.holders, self.whole,
                              self.short if self.whole else [], self.least))


class Matcher:
    """A dumped automaton that texts stream through."""

    def __init__(self, data: bytes):
        (self.window, self.vocab, self.moves, self.length, self.link, self.full, self.holders, self.whole, self.short,
         self.least) = marshal.loads(data)

    def numbers(self, text: str | None) -> np.ndarray:
        """Word numbers of a text, -1 for a word of no item."""
        get, parts = self.vocab.get, [np.zeros(0, np.int32)]
        for words in word_runs(text):
            parts.append(np.fromiter(map(get, words, repeat(-1)), np.int32, len(words)))
        return np.concatenate(parts)

    def match(self, ids: np.ndarray) -> tuple[np.ndarray, list[str], int]:
        """Disjoint hit spans (start, stop) of words, the items with an occurring
        window, and the longest item passage of at least a window."""
        cut = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        starts, stops = cut[::2], cut[1::2]
        far = stops - starts >= max(1, self.least)
        spans: list[tuple[int, int]] = []
        states: set[int] = set()
        names: set[str] = set()
        longest = 0
        moves, link, length, size, window = self.moves, self.link, self.length, max(1, len(self.vocab)), self.window
        short = self.short
        for lo, hi in zip(starts[far].tolist(), stops[far].tolist()):
            v = n = 0
            for at, c in enumerate(ids[lo:hi].tolist(), lo + 1):
                to = moves.get(v * size + c)
                while to is None and v:
                    v = link[v]
                    n = length[v]
                    to = moves.get(v * size + c)
                v, n = to, n + 1  # every known word leaves the root
                if n >= window:
                    spans.append((at - window, at))
                    states.add(self.full[v])
                    longest = max(longest, n)
                if short and short[v] >= 0:
                    up = short[v]
                    while up >= 0:
                        for m, name in self.whole[up]:
                            if m <= n:
                                spans.append((at - m, at))
                                names.add(name)
                                longest = max(longest, m)
                        up = short[link[up]] if up else -1
        for v in states:
            names.update(self.holders[v])
        if not spans:
            return np.zeros((0, 2), np.int64), [], 0
        edge = np.zeros(len(ids) + 1, np.int64)
        ends = np.array(spans)
        np.add.at(edge, ends[:, 0], 1)
        np.add.at(edge, ends[:, 1], -1)
        hit = np.concatenate(([False], np.cumsum(edge[:-1]) > 0, [False]))
        return np.flatnonzero(hit[1:] != hit[:-1]).reshape(-1, 2), sorted(names), longest


def automata(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, id_col: str = "item_id",
             text_col: str = "text") -> DataFrame:
    """One row per block of items: block, automaton (binary)."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = rows.agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(WORD.pattern), 0)))).first()[0] or 0
    blocks = max(1, -(-words // block_words))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        named = [(i, [w for run in word_runs(t) for w in run]) for i, t in zip(pdf["item_id"], pdf["text"])]
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "automaton": [Automaton(window).build(named).dump()]})

    return (rows.distinct().withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
            .groupBy("block").applyInPandas(build, "block long, automaton binary"))


MATCHED = "n_words long, spans array<struct<start:long,stop:long>>, items array<string>, longest long"


def _stream(matcher_of, keep: list[str]):
    def stream(batches):
        matcher = matcher_of()
        span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
        for batch in batches:
            counts, spans, items, longest = [], [], [], []
            for text in batch.column("text"):
                ids = matcher.numbers(text.as_py())
                at, names, most = matcher.match(ids)
                counts.append(len(ids))
                spans.append([{"start": a, "stop": b} for a, b in at.tolist()])
                items.append(names)
                longest.append(most)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(span)),
                 pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int64())],
                [*keep, "n_words", "spans", "items", "longest"])
    return stream


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])))
def _union(parts: pd.Series) -> pd.Series:
    """Overlapping spans as disjoint ones, in order."""
    out = []
    for spans in parts:
        merged: list[list[int]] = []
        for a, b in sorted((s["start"], s["stop"]) for s in spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        out.append([{"start": a, "stop": b} for a, b in merged])
    return pd.Series(out, dtype=object)


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, id_col: str = "doc_id",
         text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, spans (disjoint, in words),
    items (ids as strings, sorted), longest (words of the longest item passage of
    at least a window) and, if wanted, the text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    blocks = scratch.keep(automata(items, window, block_words))
    numbers = sorted(r.block for r in blocks.select("block").collect())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keep = ["doc_id", "text"] if with_text else ["doc_id"]
    if len(numbers) > 1:  # rows meet again by number, ids may repeat
        rows = scratch.keep(rows.withColumn("uid", F.monotonically_increasing_id()))
    kinds = dict((f.name, f.dataType.simpleString()) for f in rows.schema)

    def one_pass(block: int | None, keep: list[str]) -> DataFrame:
        data = (Automaton(window).build([]).dump() if block is None
                else bytes(blocks.filter(F.col("block") == block).first().automaton))
        sent = spark.sparkContext.broadcast(data)

        def matcher_of():
            store = process_store()  # one automaton per process, the last one asked for
            if store.get("decontaminate") is None or store["decontaminate"][0] != sent.value:
                store["decontaminate"] = (sent.value, Matcher(sent.value))
            return store["decontaminate"][1]

        schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", " + MATCHED
        return rows.mapInArrow(_stream(matcher_of, keep), schema)

    if len(numbers) <= 1:
        found = one_pass(numbers[0] if numbers else None, keep)
    else:
        passes = [scratch.keep(one_pass(numbers[0], ["uid"]))]
        passes += [scratch.keep(one_pass(b, ["uid"]).filter(F.size("spans") > 0)) for b in numbers[1:]]
        merged = passes[0]
        for p in passes[1:]:
            merged = merged.unionByName(p)
        merged = merged.groupBy("uid").agg(
            F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"))
        found = rows.select("uid", *keep).join(merged.withColumn("spans", _union("spans")), "uid")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"])
    return found.select(*keep, "n_words", n_hit.alias("n_hit"), "spans", "items", "longest")


@F.pandas_udf(T.StringType())
def _cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts without the given spans of words."""
    out = []
    for text, cut in zip(texts, spans):
        if cut is not None and len(cut):
            kept, at, words = [], 0, enumerate(WORD.finditer(text))
            for s in cut:
                first = next(m for k, m in words if k == s["start"])
                last = first if s["stop"] == s["start"] + 1 else next(m for k, m in words if k == s["stop"] - 1)
                kept.append(text[at:first.start()])
                at = last.end()
            text = "".join(kept) + text[at:]
        out.append(text)
    return pd.Series(out, dtype=object)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = 0.5,
                  block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text without the hit spans, n_words, n_hit; documents with more
    than ``max_coverage`` of their words hit are left out."""
    found = scan(docs, items, window, block_words, id_col, text_col, with_text=True)
    kept = found.filter(F.col("n_hit") <= F.lit(max_coverage) * F.col("n_words"))
    return kept.select("doc_id", _cut("text", "spans").alias("text"), "n_words", "n_hit")


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: the digest columns of a scan."""
    found = scan(docs, items, window)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


by_value(__name__)

"""Alignment of two tokenizers' tokens by pointer jumping.

A is a byte-level BPE over space+text, B a sentence-piece BPE over the text (it
adds the space itself).  Both cut the same bytes; where a token of A and one of
B end together, a group of tokens ends.

Every token points to its farthest-right overlapping token: the token of the
other tokenizer that holds its last byte.  A token of A and the one of B that
ends with it would point at each other; there the token of B is terminal and
points to itself.  Doubling the successors (succ = succ[succ], in numpy over
the tokens of many documents at once) converges after the logarithm of the
longest chain to each group's terminal token, which labels the group.  Ranges
of two documents never overlap, so documents need no separation.

Links are the pairs (token of A, token of B) that end together.  The shorter of
two such tokens is a suffix of the longer, so the possible id pairs are listed
once from the two vocabularies (some hundred thousand; their number is bounded
by the vocabularies, not by the documents).  A document keeps its links as
numbers in that list; the corpus-wide counts of the list are summed on Spark
and broadcast, and every document looks its links up.

Edge cases: a null or empty text, or one whose joined token bytes differ from
space+text (a normalised or an unknown character), has no tokens: zeros and an
empty digest.  Special tokens' strings are plain text.  Null and repeated ids
are rows like any other; an empty table gives an empty result; columns other
than the id and the text are not read.
"""
from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import Scratch, by_value, process_store
from tokenloom.llm.tokens import _byte_of, encoder

CHARS = 1 << 20  # characters aligned at a time


class Vocabularies:
    """Token bytes of both tokenizers and the id pairs that can end together."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer
        self.fast = encoder(path_a)
        self.plain = self.fast.fast.__self__.encode_to_numpy if self.fast.fast else None
        self.exact = Tokenizer.from_file(path_a)
        self.exact.encode_special_tokens = True
        self.model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = _byte_of()
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        plain = dict(spec["model"]["vocab"])
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.a = [b""] * (1 + max([*plain.values(), *special.values()]))
        for token, k in plain.items():
            self.a[k] = bytes(byte_of[c] for c in token) if token not in special else token.encode()
        self.b = [self._piece(k) for k in range(self.model.vocab_size())]
        self.size_a = np.array([len(t) for t in self.a], np.int64)
        self.size_b = np.array([len(t) for t in self.b], np.int64)
        self.pairs = self._pairs()
        # each id followed by what parts it from the next one, as rows of bytes (zero pads)
        written = [f"{k}{sep}".encode() for n, seps in ((len(self.a), ",|"), (len(self.b), ",;")) for sep in seps for k in range(n)]
        self.written = np.array(written, dtype="S8").view(np.uint8).reshape(-1, 8)
        self.width = np.array([len(w) for w in written], np.int64)

    def _piece(self, k: int) -> bytes:
        piece = self.model.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(k) else piece.replace("▁", " ").encode()

    def _pairs(self) -> np.ndarray:
        """Sorted codes (id of A times size of B plus id of B) of tokens one of which ends the other."""
        by_a: dict[bytes, list[int]] = {}
        by_b: dict[bytes, list[int]] = {}
        for tokens, by in ((self.a, by_a), (self.b, by_b)):
            for k, t in enumerate(tokens):
                by.setdefault(t, []).append(k)
        n, codes = len(self.b), set()
        for a, t in enumerate(self.a):
            for lo in range(len(t)):
                codes.update(a * n + b for b in by_b.get(t[lo:], ()))
        for b, t in enumerate(self.b):
            for lo in range(len(t)):
                codes.update(a * n + b for a in by_a.get(t[lo:], ()))
        return np.array(sorted(codes), np.int64)

    def encode_a(self, text: str) -> np.ndarray:
        fast = self.fast
        if fast.fast and fast.latin(text):
            return self.plain(text, disallowed_special=()).astype(np.int64)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.int64)

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and B, None if the text has no tokens."""
        if not text:
            return None
        want = (" " + text).encode("utf-8", "surrogatepass")
        b = self.model.encode(text, num_threads=1)
        if b"".join(map(self.b.__getitem__, b)) != want:
            return None
        a = self.encode_a(" " + text)
        if b"".join(map(self.a.__getitem__, a.tolist())) != want:
            return None
        return a, np.array(b, np.int64)


def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    store = process_store()
    if ("align", path_a, path_b) not in store:
        store[("align", path_a, path_b)] = Vocabularies(path_a, path_b)
    return store[("align", path_a, path_b)]


def terminals(end_a: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """The terminal token of each token's component; tokens are those of A, then
    those of B, given by their ascending end offsets.  The last ends are equal."""
    n_a = len(end_a)
    # the token of the other side that holds a token's last byte: as many as end before it
    before = []
    for ends in (end_a, end_b):
        ended = np.zeros(int(end_a[-1]) + 1, np.int32)
        ended[ends] = 1
        before.append(np.cumsum(ended, dtype=np.int32))
    to_b, to_a = before[1][end_a - 1].astype(np.int64), before[0][end_b - 1].astype(np.int64)
    succ = np.concatenate((to_b + n_a, np.where(end_a[to_a] == end_b, np.arange(len(end_b)) + n_a, to_a)))
    while True:
        further = succ[succ]
        if np.array_equal(further, succ):
            return succ
        succ = further


class Aligned:
    """Groups and links of a stretch of documents."""

    def __init__(self, v: Vocabularies, docs: list[tuple[np.ndarray, np.ndarray]]):
        a, b = (np.concatenate([d[k] for d in docs]) for k in (0, 1))
        end_a, end_b = np.cumsum(v.size_a[a]), np.cumsum(v.size_b[b])
        last = terminals(end_a, end_b)
        label_a, label_b = last[:len(a)], last[len(a):]
        # a group's number: terminal tokens are tokens of B, in order
        ends_b = label_b == np.arange(len(b)) + len(a)
        number = np.cumsum(ends_b) - 1
        group_a, group_b = number[label_a - len(a)], number[label_b - len(a)]
        ends_a = np.concatenate((group_a[1:] != group_a[:-1], [True]))
        self.links = np.searchsorted(v.pairs, a[ends_a] * len(v.b) + b[ends_b]).astype(np.int32)
        # where documents begin among tokens, groups and the written ids
        self.n_a, self.n_b = (np.array([len(d[k]) for d in docs]) for k in (0, 1))
        stop_b = np.cumsum(self.n_b)
        self.group_stop = number[stop_b - 1] + 1
        # a group's ids of A, then its ids of B
        before_b = np.concatenate(([0], np.cumsum(np.bincount(group_b))))
        upto_a = np.cumsum(np.bincount(group_a))
        written = np.empty(len(a) + len(b), np.int64)
        written[np.arange(len(a)) + before_b[group_a]] = a + len(v.a) * ends_a
        written[np.arange(len(b)) + upto_a[group_b]] = b + 2 * len(v.a) + len(v.b) * ends_b
        rows = v.written[written]
        said = memoryview(rows[rows > 0])
        stops = np.cumsum(v.width[written])[np.cumsum(self.n_a + self.n_b) - 1].tolist()
        self.digests = [hashlib.sha256(said[lo:hi - 1]).hexdigest() for lo, hi in zip([0, *stops], stops)]


def _align(path_a: str, path_b: str):
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"]

    def stretches(v, texts):
        """Stretches of documents, the encoded ones and their places."""
        held, at, size = [], [], 0
        for i, text in enumerate(texts):
            text = text.as_py()
            ids = v.encode(text)
            if ids is not None:
                held.append(ids)
                at.append(i)
                size += len(text)
            if size >= CHARS:
                yield held, at
                held, at, size = [], [], 0
        if held:
            yield held, at

    def align(batches):
        v = vocabularies(path_a, path_b)
        for batch in batches:
            n = batch.num_rows
            counts = np.zeros((3, n), np.int64)
            digests, links, of = [""] * n, [np.zeros(0, np.int32)], np.zeros(n, np.int64)
            for held, at in stretches(v, batch.column("text")):
                one = Aligned(v, held)
                groups = np.diff(one.group_stop, prepend=0)
                counts[:, at] = one.n_a, one.n_b, groups
                of[at] = groups
                for i, d in zip(at, one.digests):
                    digests[i] = d
                links.append(one.links)
            offsets = np.concatenate(([0], np.cumsum(of))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c) for c in counts), pa.array(digests, pa.string()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(links)))], names)
    return align


def groups(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, groups_sha256, links
    (array of numbers of ``pair_list``, in text order)."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(_align(path_a, path_b), f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, "
                                                   "links array<int>")


def pair_counts(aligned: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Links of the corpus by pair: pair, a_id, b_id, n; at most as many rows as
    the vocabularies have pairs that can end together."""
    def count(batches):
        v = vocabularies(path_a, path_b)
        total = np.zeros(len(v.pairs), np.int64)
        for batch in batches:
            total += np.bincount(batch.column("links").flatten().to_numpy(zero_copy_only=False), minlength=len(total))
        pair = np.flatnonzero(total)
        a, b = np.divmod(v.pairs[pair], len(v.b))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (pair, a, b, total[pair])], ["pair", "a_id", "b_id", "n"])

    parts = aligned.select("links").mapInArrow(count, "pair long, a_id long, b_id long, n long")
    return parts.groupBy("pair", "a_id", "b_id").agg(F.sum("n").alias("n"))


def with_counts(spark: SparkSession, aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds n_links, n_best (links whose count is their B id's highest) and count_sum."""
    best = counts.groupBy("b_id").agg(F.max("n").alias("top"))
    table = counts.join(best, "b_id").select("pair", "n", (F.col("n") == F.col("top")).alias("best")).toArrow()
    pair = table.column("pair").to_numpy()
    n = np.zeros(1 + int(pair.max(initial=-1)), np.int64)
    top = np.zeros(len(n), bool)
    n[pair], top[pair] = table.column("n").to_numpy(), table.column("best").to_numpy(zero_copy_only=False)
    sent = spark.sparkContext.broadcast((n, top))  # bounded by the vocabularies, see above
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]

    def look_up(batches):
        n, top = sent.value
        for batch in batches:
            links = batch.column("links")
            flat = links.flatten().to_numpy(zero_copy_only=False)
            stop = np.cumsum(links.value_lengths().to_numpy(zero_copy_only=False))
            sums = [np.diff(np.concatenate(([0], np.cumsum(x[flat], dtype=np.int64)))[stop], prepend=0) for x in (top, n)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), *(pa.array(x) for x in (np.diff(stop, prepend=0).astype(np.int64), *sums))],
                [*names, "n_links", "n_best", "count_sum"])

    kind = aligned.schema["doc_id"].dataType.simpleString()
    return aligned.mapInArrow(look_up, f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, "
                                       "n_best long, count_sum long")


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, groups_sha256, n_links,
    n_best, count_sum."""
    scratch = Scratch(docs.sparkSession, "align")
    aligned = scratch.keep(groups(docs, path_a, path_b, id_col, text_col))
    counts = scratch.keep(pair_counts(aligned, path_a, path_b))
    return with_counts(docs.sparkSession, aligned, counts)


by_value(__name__)

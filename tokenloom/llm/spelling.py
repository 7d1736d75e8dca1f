"""Spelling variants by reduced-alphabet neighbourhoods.

Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; the
caller's ``change`` may alter an occurrence.  A vocabulary holds those of at
least ``min_length`` code points and ``min_count`` occurrences over all texts.

Search: every letter is hashed to one of ``symbols`` symbols.  Two words that
differ by one insertion, deletion or replacement reduce to equal words or to
words that differ by one edit.  For every vocabulary word the full one-edit
neighbourhood of its reduced word (itself, every deletion, replacement and
insertion) is generated as 64-bit polynomial hashes, in numpy over many words
at once, and joined with the reduced vocabulary by equality.  The pairs are
verified on the original strings inside the join, so hash collisions add no
pair and no pair is lost; a pair is met once from each side, because the second
word has one reduced word and a neighbourhood's hashes are distinct.  Most of a
neighbourhood is no vocabulary word: a bitmap of 2^``filter_bits`` bits (16 MB,
whatever the input) is broadcast and drops those that cannot join.

A word's form is its near word of most occurrences (ties: the smallest), if it
has ``ratio`` times the word's own; forms are followed to the last by pointer
doubling over the words that have one.  Counts grow at every step, so there is
no cycle and the number of steps is logarithmic in the largest count.

Edge cases: null and wordless texts have no words; a null id reads as '' where
the id enters a hash; repeated rows count as often as they occur; an empty
table gives an empty vocabulary; other columns are not read.
"""
from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import Scratch, by_value

SYMBOLS = 8
FILTER_BITS = 27
HELD_WORDS = 200_000  # distinct words that a task counts before it emits them
STEP = 1 << 20  # characters of a text cut into words at a time
#: Latin-1 bytes: A-Z to lower case, letters from U+00C0 on as they are, all else parts words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
BACK = pow(BASE, -1, 1 << 64)


def word_runs(text: str | None):
    """The words of a text as lists of UTF-8 strings, a bounded stretch at a time."""
    text = text or ""
    at = 0
    while at < len(text):
        stop = at + STEP
        # a stretch ends behind a character that parts words
        while stop < len(text) and ord(c := text[stop - 1]) < 256 and FOLD[ord(c)] != 32:
            stop += 1
        part = text[at:stop].encode("latin-1", "replace").translate(FOLD)
        yield part.decode("latin-1").encode().split()
        at = stop


def keyed_deletion(modulus: int = 199):
    """Deletes one code point of a word where ``modulus`` divides the crc32 of
    '<doc_id>:<word>'; the same for all its occurrences in a document."""
    def of_document(doc_id):
        start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())

        def change(word: bytes) -> bytes:
            h = zlib.crc32(word, start)
            if h % modulus:
                return word
            s = word.decode()
            at = h % len(s)
            return (s[:at] + s[at + 1:]).encode()
        return change
    return of_document


def word_counts(docs: DataFrame, change=None, min_length: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: occurrences over all texts of words of at least ``min_length``
    code points.  ``change(doc_id)`` gives a function of a word, or None."""
    def count(batches):
        held: Counter = Counter()

        def emit():
            out = [(s, n) for w, n in held.items() if len(w) >= min_length and len(s := w.decode()) >= min_length]
            held.clear()
            words, n = zip(*out) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                edit = change(doc_id) if change else None
                for words in word_runs(text.as_py()):
                    if edit is None:
                        held.update(words)
                    else:
                        for w, n in Counter(words).items():
                            if len(w) >= min_length:  # bytes, at least as many as code points
                                held[edit(w)] += n
                    if len(held) > HELD_WORDS:
                        yield emit()
        yield emit()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def reduced(letters: np.ndarray, symbols: int) -> np.ndarray:
    """The symbol of each code point, 1 to ``symbols``."""
    return (letters.astype(np.uint64) * np.uint64(0x9E3779B1) >> np.uint64(7)) % np.uint64(symbols) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    """Spreads a polynomial hash over all 64 bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    out[1:] = np.uint64(BASE)
    return np.multiply.accumulate(out)


def keys(x: np.ndarray) -> np.ndarray:
    """Hash of each row of symbols."""
    return _mix((x * _powers(x.shape[1])[:-1]).sum(1, dtype=np.uint64))


def neighbourhoods(x: np.ndarray, symbols: int) -> np.ndarray:
    """Hashes of a row's symbols and of all words one edit away, one row each;
    equal words of a neighbourhood have equal hashes."""
    n, width = x.shape
    power = _powers(width)
    upto = np.zeros((n, width + 1), np.uint64)
    np.cumsum(x * power[:-1], axis=1, dtype=np.uint64, out=upto[:, 1:])
    whole = upto[:, -1:]
    base, back = np.uint64(BASE), np.uint64(BACK)
    parts = [whole, upto[:, :-1] + (whole - upto[:, 1:]) * back]
    for s in range(1, symbols + 1):
        parts.append(whole + (np.uint64(s) - x) * power[:-1])
        parts.append(upto + np.uint64(s) * power + (whole - upto) * base)
    return _mix(np.concatenate(parts, axis=1))


def _by_length(words: pa.Array):
    """(positions, matrix of code points) of the words of each length."""
    texts = words.to_pylist()
    size = np.array([len(t) for t in texts], np.int64)
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        for lo in range(0, len(at), 4096):
            some = at[lo:lo + 4096]
            joined = "".join(texts[i] for i in some.tolist()).encode("utf-32-le")
            yield some, np.frombuffer(joined, "<u4").reshape(len(some), n)


def _key_column(symbols: int):
    def add(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for at, letters in _by_length(batch.column("word")):
                out[at] = keys(reduced(letters, symbols))
            yield batch.append_column("key", pa.array(out.view(np.int64)))
    return add


def key_filter(spark: SparkSession, reduced_words: DataFrame, bits: int = FILTER_BITS):
    """Broadcast bitmap of the keys' first ``bits`` bits: 2^(bits - 3) bytes."""
    rows = reduced_words.select(F.shiftrightunsigned("key", 64 - bits).alias("slot")).select(
        F.shiftright("slot", 6).alias("at"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
    table = rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.int64)
    words[table.column("at").to_numpy()] = table.column("bits").to_numpy()
    return spark.sparkContext.broadcast(words)


def _generate(symbols: int, sent, bits: int):
    def generate(batches):
        for batch in batches:
            words = sent.value
            rows, found = [], []
            for at, letters in _by_length(batch.column("word")):
                near = neighbourhoods(reduced(letters, symbols), symbols)
                slot = (near >> np.uint64(64 - bits)).astype(np.int64)
                row, col = np.nonzero(words[slot >> 6] >> (slot & 63) & 1)
                hit = near[row, col]
                order = np.lexsort((hit, row))
                row, hit = row[order], hit[order]
                first = np.ones(len(row), bool)
                first[1:] = (row[1:] != row[:-1]) | (hit[1:] != hit[:-1])
                rows.append(at[row[first]])
                found.append(hit[first].view(np.int64))
            row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)), batch.column("word").take(take)],
                ["near_key", "word"])
    return generate


def near_pairs(vocabulary: DataFrame, scratch: Scratch, symbols: int = SYMBOLS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(word, near, near_n) of all pairs at exactly one edit, from both sides."""
    spark = vocabulary.sparkSession
    lookup = scratch.keep(vocabulary.select("word", "n").mapInArrow(_key_column(symbols), "word string, n long, key long"))
    sent = key_filter(spark, lookup, filter_bits)
    asked = vocabulary.select("word").mapInArrow(_generate(symbols, sent, filter_bits), "near_key long, word string")
    other = lookup.select(F.col("key").alias("near_key"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return (asked.join(other, (asked.near_key == other.near_key) & (F.levenshtein("word", "near", 1) == 1))
            .select("word", "near", "near_n"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, form) -> (word, root): the end of each word's chain of forms."""
    at = scratch.keep(forms.select("word", F.col("form").alias("root")))
    while True:
        step = at.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        further = scratch.keep(at.join(step, F.col("root") == F.col("_w"), "left")
                               .select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")))
        more = further.filter("moved").limit(1).count()
        scratch.drop(at)
        at = further.select("word", "root")
        at._scratch_path = further._scratch_path
        if not more:
            return at


def variants(docs: DataFrame, change=None, min_length: int = 6, min_count: int = 5, ratio: int = 5, symbols: int = SYMBOLS,
             filter_bits: int = FILTER_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per vocabulary word: word, form, root, n, n_near, form_n."""
    scratch = Scratch(docs.sparkSession, "spelling")
    counts = word_counts(docs, change, min_length, id_col, text_col)
    vocabulary = scratch.keep(counts.filter(F.col("n") >= min_count))
    best = near_pairs(vocabulary, scratch, symbols, filter_bits).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("top"))
    best = best.select(F.col("word").alias("_w"), "n_near", F.col("top.near").alias("near"), (-F.col("top.less")).alias("near_n"))
    good = F.col("near_n") >= F.lit(ratio) * F.col("n")
    rows = scratch.keep(vocabulary.join(best, F.col("word") == F.col("_w"), "left").select(
        "word", F.when(good, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("near_n")).alias("form_n")))
    ends = roots(rows.filter("form is not null"), scratch).select(F.col("word").alias("_w"), "root")
    return rows.join(ends, F.col("word") == F.col("_w"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


by_value(__name__)

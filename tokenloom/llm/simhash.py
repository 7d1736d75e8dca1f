"""SimHash near-duplicates over deletion-variant signatures.

Fingerprint: words are runs of non-blank ASCII-lower-cased characters, features
the 4-word shingles (repeats included, space-joined), hashed by XXH64 with seed
42; a bit is set if it is set in over half the hashes.

Search: two fingerprints within 4 bits, cut into 3 segments (22, 21 and 21
bits), agree in one segment up to one bit.  Every fingerprint is indexed under
64 variants: one wildcard at each bit position, together with the rest of that
position's segment.  Fingerprints that share a variant are verified by their
bit distance, so no link is lost and none is added.

Only distinct fingerprints are indexed; copies follow their fingerprint.  The
variants are shuffled by key, sorted in their partition and streamed; inside a
variant the members are linked by leaders (each member is compared with every
leader, and two stars are compared member by member only while they are not
yet connected and near enough to hold a link), which yields the same
components as all pairs but at most one edge per member.  The memory of a
variant is eight bytes per distinct fingerprint.

Edge cases: a text with fewer words than a shingle is one shingle of all its
words; a null or wordless text has fingerprint zero and links like any other.
Null ids are grouped and sort below every id (component null only if all ids
of it are null); repeated rows get equal results; an empty table gives an
empty result.
"""
from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import Scratch, by_value, small
from tokenloom.llm.components import connected_components

SEED = 42
STEP = 1 << 18  # shingles of one text hashed at a time
SHORT = 32  # members of a variant compared directly


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of the segments: so many that one differs by at most one bit."""
    parts = max_bits // 2 + 1
    edges = [round(64 * k / parts) for k in range(parts + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def fingerprint(text, shingle: int) -> int:
    import xxhash
    words = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, STEP):
        part = words[lo:lo + STEP + shingle - 1] if n > 1 else words
        joined = map(b" ".join, zip(*(part[k:] for k in range(shingle)))) if n > 1 else [b" ".join(part)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def _hash_texts(shingle: int):
    @F.pandas_udf("long")
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype=np.int64)
    return fingerprints


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the 64-bit fingerprint as a signed long."""
    return docs.select(F.col(id_col).alias("doc_id"), _hash_texts(shingle)(F.col(text_col).cast("string")).alias("fp"))


def _near(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= max_bits


def star_edges(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints."""
    n = len(fps)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    edges = []

    def union(i, j):
        a, b = find(i), find(j)
        if a != b:
            root[a] = b
            edges.append((i, j))

    star = np.full(n, -1)
    leaders = []
    for i in range(n):
        if star[i] >= 0:
            continue
        leaders.append(i)
        near = np.flatnonzero(_near(fps, fps[i], max_bits))
        for j in near.tolist():
            union(i, j)
        star[near[star[near] < 0]] = len(leaders) - 1
    # links between members of two stars whose leaders are near enough
    if len(leaders) > 1:
        lead = fps[leaders]
        members = [np.flatnonzero(star == k) for k in range(len(leaders))]
        for k in range(len(leaders) - 1):
            for other in (np.flatnonzero(_near(lead[k + 1:], lead[k], 3 * max_bits)) + k + 1).tolist():
                if find(leaders[k]) == find(leaders[other]):
                    continue
                small_, large = sorted((members[k], members[other]), key=len)
                for i in small_.tolist():
                    hit = np.flatnonzero(_near(fps[large], fps[i], max_bits))
                    if len(hit):
                        union(i, int(large[hit[0]]))
                        break
    return edges


def _run_edges(key: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the runs of equal keys: short runs are compared at every
    distance at once, long ones by leaders."""
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((at, [len(key)])))
    bits = fp.view(np.uint64)
    left, right = [], []
    short = np.repeat((size > 1) & (size <= SHORT), size)
    for apart in range(1, int(size[(size <= SHORT)].max(initial=1))):
        i = np.flatnonzero(short[:-apart] & (key[apart:] == key[:-apart]))
        i = i[_near(bits[i], bits[i + apart], max_bits)]
        left.append(fp[i])
        right.append(fp[i + apart])
    for k in np.flatnonzero(size > SHORT).tolist():
        run = bits[at[k]:at[k] + size[k]]
        e = np.array(star_edges(run, max_bits), dtype=np.int64).reshape(-1, 2)
        run = run.view(np.int64)
        left.append(run[e[:, 0]])
        right.append(run[e[:, 1]])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def _link(max_bits: int):
    """Sorted (key, fp) rows of a partition -> edges; a variant may span batches."""
    def link(batches):
        held_key, held = None, []  # the run that may go on in the next batch
        for pdf in batches:
            key, fp = pdf["key"].to_numpy(), pdf["fp"].to_numpy()
            if not len(key):
                continue
            if held and key[0] == held_key == key[-1]:
                held.append(fp)
                continue
            if held:
                fp = np.concatenate([*held, fp])
                key = np.concatenate([np.full(len(fp) - len(key), held_key), key])
            last = int(np.searchsorted(key, key[-1]))
            held_key, held = key[-1], [fp[last:]]
            if last:
                a, b = _run_edges(key[:last], fp[:last], max_bits)
                yield pd.DataFrame({"a": a, "b": b})
        if held:
            fp = np.concatenate(held)
            a, b = _run_edges(np.zeros(len(fp), np.int64), fp, max_bits)
            yield pd.DataFrame({"a": a, "b": b})
    return link


def _variants(max_bits: int):
    """Array of 64 keys: the bit position mixed with its segment without that bit."""
    keys = []
    for lo, width in segments(max_bits):
        for bit in range(lo, lo + width):
            mask = ((1 << width) - 1 << lo) & ~(1 << bit)
            mask = mask - (1 << 64) if mask >= 1 << 63 else mask
            # the masked segment, moved to the low bits, above it the position
            part = F.shiftrightunsigned(F.col("fp").bitwiseAND(F.lit(mask).cast("long")), lo)
            keys.append(part + F.lit(bit << 32).cast("long") if width <= 32 else F.xxhash64(F.lit(bit), part))
    return F.array(*keys)


def near_links(distinct: DataFrame, max_bits: int = 4) -> DataFrame:
    """Distinct fingerprints (fp) -> a table (a, b) of verified links that
    spans every component."""
    indexed = distinct.select("fp", F.explode(_variants(max_bits)).alias("key"))
    return (indexed.repartition("key").sortWithinPartitions("key")
            .mapInPandas(_link(max_bits), "a long, b long"))


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id
    (smallest doc_id reachable over links, itself included)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.keep(fingerprints(docs, shingle, id_col, text_col))
    classes = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = connected_components(near_links(classes.select("fp"), max_bits), scratch)
    roots = scratch.keep(roots)
    lowest = (classes.join(roots, F.col("fp") == F.col("node"), "left")
              .select("fp", "low", F.coalesce("root", "fp").alias("root")))
    lowest = scratch.keep(lowest)
    by_root = scratch.keep(lowest.groupBy("root").agg(F.min("low").alias("component_id")))
    of_fp = scratch.keep(lowest.select("fp", "root").join(by_root, "root").select(F.col("fp").alias("_fp"), "component_id"))
    return (rows.join(of_fp, F.col("fp") == F.col("_fp"))
            .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def keep_one_of_each(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """The documents whose id is the smallest of its component, columns
    unchanged; of rows repeating that id one stays."""
    scratch = Scratch(docs.sparkSession, "simhash-keep")
    found = scratch.keep(near_duplicates(docs, shingle, max_bits, id_col, text_col))
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    drop = scratch.keep(found.filter(~stays).select(F.col("doc_id").alias("_tl_id")).distinct())
    again = scratch.keep(found.filter(stays).groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_tl_id")))
    same = F.col(id_col).eqNullSafe(F.col("_tl_id"))
    left = docs.join(small(drop), same, "left_anti")
    if not again.isEmpty():
        again = small(again)
        once = left.join(again, same, "left_semi").dropDuplicates([id_col])
        left = left.join(again, same, "left_anti").unionByName(once)
    return left.select(*docs.columns)


by_value(__name__)

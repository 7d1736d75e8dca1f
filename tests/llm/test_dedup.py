from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash

from tokenloom.llm import exact_dedup, queries, simhash
from tokenloom.llm.common import Scratch
from tokenloom.llm.components import connected_components


def test_exact_groups_follow_brute_force(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    group = defaultdict(list)
    for i, t in docs.items():
        group[t].append(i)
    got = queries.op3_exact_dedup(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = group[docs[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (max(ids), len(ids), r.doc_id == max(ids))
        assert r.text_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_exact_same_result_with_a_tiny_summary(spark, odd_docs):
    """The split between heavy and light digests never shows in the result."""
    few = exact_dedup.duplicate_groups(odd_docs, candidates=1, tracked=2).collect()
    many = exact_dedup.duplicate_groups(odd_docs).collect()
    assert sorted(map(repr, few)) == sorted(map(repr, many))


def test_exact_odd_rows(odd_docs, no_docs):
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup.duplicate_groups(odd_docs).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == 11  # the repeated row of id 4 is one document
    assert {k[0] for k, r in got.items() if k[1] == empty} == {None, 1, 2}
    assert got[1, empty].keep_id == 2 and got[1, empty].group_size == 3 and not got[None, empty].kept
    assert {r.group_size for k, r in got.items() if k[0] == 3} == {4}
    left = exact_dedup.drop_duplicates(odd_docs)
    assert left.columns == odd_docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [2, 4, 5, 6, 7, 8, 9]
    assert exact_dedup.duplicate_groups(no_docs).count() == 0 and exact_dedup.drop_duplicates(no_docs).count() == 0


def _fingerprint(text, shingle=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(fps: dict, bits: int) -> dict:
    ids, f = list(fps), np.array(list(fps.values()), dtype=np.uint64)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(f[k] ^ f[k + 1:]) <= bits).tolist():
            a, b = find(ids[k]), find(ids[k + 1 + j])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_follows_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    fps = {i: _fingerprint(t) for i, t in docs.items()}
    got = {r.doc_id: r for r in queries.op8_simhash_near_dedup(spark, sf).collect()}
    want = _components(fps, 4)
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == want


def test_simhash_links_are_complete_in_dense_groups(spark):
    """Chains and balls of fingerprints around shared centres, short and long runs."""
    draw = np.random.default_rng(3)
    centre = draw.integers(0, 1 << 63, 6, dtype=np.int64).view(np.uint64)
    fps = {0: int(centre[0])}
    for c in centre:
        for _ in range(120):
            f = int(c)
            for b in draw.choice(64, draw.integers(0, 9), replace=False):
                f ^= 1 << int(b)
            fps[len(fps)] = f
    distinct = sorted(set(fps.values()))
    signed = [(int(np.uint64(f).view(np.int64)),) for f in distinct]
    table = spark.createDataFrame(signed, "fp long")
    for bits in (1, 4):
        edges = simhash.near_links(table, bits).collect()
        assert all(bin((e.a ^ e.b) & (1 << 64) - 1).count("1") <= bits for e in edges)
        root = {s[0]: s[0] for s in signed}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for e in edges:
            root[find(e.a)] = find(e.b)
        want = _components(dict(enumerate(distinct)), bits)
        assert len({find(s[0]) for s in signed}) == len(set(want.values()))


def test_simhash_odd_rows(odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} >= {1, 2, 8, None} and {r.component_id for r in zero} == {1}
    kept = simhash.keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {1, 3} <= set(ids) and 4 not in ids and None not in ids
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one_of_each(no_docs).count() == 0


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + k) for k in range(1, 80)] + [
        (2000 + k, 2000 + (k + 1) % 9) for k in range(9)] + [(5, 5), (3000, 3001), (3001, 3000)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + k] == 1000 for k in range(80))
    assert all(got[2000 + k] == 2000 for k in range(9)) and got[3001] == 3000 and len(got) == 61 + 80 + 9 + 2
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0

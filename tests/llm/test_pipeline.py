from __future__ import annotations

import importlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tokenloom.llm import language_id, mixing, packing, queries, simhash
from tokenloom.llm.common import Scratch


def test_every_query_is_registered():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    for n in range(1, 11):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1
    assert names["pipeline"] is corpus_pipeline.run and set(entry.oracle_sql()) <= set(names)


def test_stages_follow_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scratch = Scratch(spark, "t")
    columns, steps = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, sf))
        steps.append(docs)
    assert all(s.columns == columns for s in steps[:-1])
    rows = {r.doc_id: r for r in steps[0].collect()}
    assert all(any(map(str.isalpha, r.text)) for r in rows.values())
    best = {}
    for r in rows.values():
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert {r.doc_id for r in steps[1].collect()} == set(best.values())
    # near copies: the smallest id of each component over the survivors
    ids = sorted(best.values())
    fps = np.array([simhash.fingerprint(rows[i].text, 4) for i in ids], dtype=np.int64).view(np.uint64)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1:]) <= 4).tolist():
            a, b = sorted((find(i), find(i + 1 + j)))
            root[b] = a
    assert sorted(r.doc_id for r in steps[2].collect()) == [ids[k] for k in range(len(ids)) if find(k) == k]
    copies = {r.doc_id: r.copies for r in mixing.mix_plan(steps[2]).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in steps[3].groupBy("doc_id").count().collect()} == copies
    enc = packing.encoder(queries.tokenizer_path())
    want = {r.doc_id: (len(enc.encode(r.text)) // 4 + 1) * copies[r.doc_id] for r in steps[2].collect() if r.doc_id in copies}
    got = steps[4].groupBy("doc_id").agg(F.sum("length").alias("n"), F.count_distinct("sequence_id", "offset").alias("p"),
                                         F.count(F.lit(1)).alias("c")).collect()
    assert {r.doc_id: r.n for r in got} == want and all(r.p == r.c for r in got)


def test_stages_on_odd_and_empty_tables(odd_docs, no_docs, spark):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = Scratch(spark, "t").keep(stage(spark, docs, ""))
        assert {"doc_id", "sequence_id", "offset"} <= set(docs.columns)


def test_unsure_languages_stay(spark, sf):
    """A text that several languages share keeps its place; only one without a letter goes."""
    texts = ["shared words of many tongues", "na na na", "12 34 !!"]
    ids = (i for i in range(10_000) if zlib.crc32(str(i).encode()) % 4 != 2)  # all languages learn the same texts
    docs = spark.createDataFrame([(next(ids), t, lang) for lang in ("a", "b", "c", "d") for t in texts * 8],
                                 "doc_id long, text string, lang string")
    kept = corpus_pipeline.identify_language(spark, docs, sf)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in docs.collect() if r.text != texts[2])

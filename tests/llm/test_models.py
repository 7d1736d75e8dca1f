from __future__ import annotations

import zlib
from collections import Counter

import numpy as np

from tokenloom.llm import language_id, quality, queries


def _fold(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_language_id_on_held_out(spark, sf):
    got = queries.op7_language_id(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(got) == len(docs) and [_fold(i) for i in got.doc_id] == got.held_out.tolist()
    out = both[both.held_out & (both.lang_pred != "und")]
    assert len(out) and (out.lang == out.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_counts_and_scores_follow_brute_force(spark):
    texts = [("en", "The cat, the hat"), ("de", "Der Hut für die Katze"), ("en", None), (None, "skipped"), ("de", "ÄÖ")]
    model = language_id.train(spark.createDataFrame(texts, "lang string, text string"))
    assert model.langs == ["de", "en"]

    def grams(t):
        s = " " + "".join(c if c.isalpha() else " " for c in t.lower()) + " "
        while "  " in s:
            s = s.replace("  ", " ")
        return [s[i:i + n] for n in (2, 3) for i in range(len(s) - n + 1) if (s[i:i + 2].strip() if n == 2 else s[i + 1] != " ")]

    def bucket(g):
        u = [np.uint64(ord(c)) for c in g]
        mul = [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D]
        x = 0
        for c, m in zip(u, mul):
            x ^= int(c) * m & 0xFFFFFFFF
        return (x * (0x27D4EB2F if len(g) == 2 else 0x165667B1) & 0xFFFFFFFF) >> (32 - language_id.BUCKET_BITS)

    for k, lang in enumerate(model.langs):
        n = Counter(bucket(g) for l, t in texts if l == lang and t for g in grams(t))
        total = sum(n.values()) + 0.5 * language_id.BUCKETS
        want = np.full(language_id.BUCKETS, np.log(0.5 / total))
        for b, c in n.items():
            want[b] = np.log((c + 0.5) / total)
        assert np.allclose(model.logp[:, k], want, atol=1e-4)
    total, seen = language_id._scores(["die Katze", "12 3"], model)
    by_hand = [model.prior[k] + sum(model.logp[bucket(g), k] for g in grams("die Katze")) for k in range(2)]
    assert np.allclose(total[0], by_hand, atol=1e-3) and seen.tolist() == [True, False]


def test_language_slices_lose_nothing(spark, monkeypatch):
    model = language_id.train(spark.createDataFrame([("a", "mi na to"), ("b", "sche ich au")], "lang string, text string"))
    texts = ["mi na sche to " * 50, "ich", "au au na " * 30]
    whole = language_id._scores(texts, model)[0]
    monkeypatch.setattr(language_id, "SLICE", 37)
    assert np.allclose(whole, language_id._scores(texts, model)[0])


def test_language_odd_rows(odd_docs, no_docs):
    got = {r.doc_id: r for r in language_id.identify(odd_docs).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 8, 9)) and got[6].lang_pred == "de"
    kept = language_id.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} <= {3, 4, 5, 6, 7, None}
    assert language_id.identify(no_docs).count() == 0 and language_id.keep_identified(no_docs).count() == 0
    unlabelled = language_id.identify(odd_docs.filter("lang is null")).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_quality_on_held_out(spark, sf):
    got = queries.op2_quality_ranking(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().merge(got, on="doc_id")
    out = labels[labels.held_out]
    assert (out.quality == out.predicted).mean() > 0.95 and got.score.between(0, 1).all()
    assert ((got.score >= 0.7) == (got.predicted == 1)).all()
    assert [_fold(i) for i in got.doc_id] == got.held_out.tolist()


def test_pairs_recover_an_order():
    draw = np.random.default_rng(0)
    x, w = draw.normal(size=(400, 3)), np.array([2.0, -1.0, 0.0])
    i, j = draw.integers(0, 400, 4000), draw.integers(0, 400, 4000)
    wins = draw.random(4000) < 1 / (1 + np.exp(-(x[i] - x[j]) @ w))
    got = quality.fit_pairs(np.where(wins[:, None], x[i], x[j]), np.where(wins[:, None], x[j], x[i]))
    assert np.allclose(got, w, atol=0.2)


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (3, 1), (5, None), (None, 1), (6, 1), (6, 0), (9, 0), (7, 0)], "doc_id long, quality int")
    for docs, marks in ((odd_docs, labels), (odd_docs, labels.limit(0)), (no_docs, labels)):
        got = quality.score(docs, quality.train(docs, marks)).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    model = quality.train(odd_docs, labels, sample=1)
    assert {r.score for r in quality.score(odd_docs, model).collect()} == {0.5}


def test_quality_threshold_covers_all_labels(spark):
    """The fit may sample; the cut between bad and good is that of all labelled rows."""
    draw = np.random.default_rng(5)
    words = "alpha Beta 12 gamma, delta. EPS (zeta) eta! theta\n".split(" ")
    rows = [(i, " ".join(draw.choice(words, int(draw.integers(3, 40)))), int(draw.random() < 0.3)) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.train(docs, docs.select("doc_id", "quality"), sample=60)
    seen = [r for r in rows if not _fold(r[0])]
    predicted = {r.doc_id: r.predicted for r in quality.score(docs, model).collect()}
    assert abs(sum(predicted[r[0]] for r in seen) - sum(r[2] for r in seen)) <= 2
    x = np.array([quality.features(r[1]) for r in seen])
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, x.std(0) + 1e-9)

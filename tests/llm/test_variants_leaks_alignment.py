from __future__ import annotations

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tokenloom.llm import align, decontaminate, queries, spelling
from tokenloom.llm.common import Scratch


def _texts(spark, sf, name="documents", key="doc_id"):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(key, "text").collect()]


# ---- spelling variants

def _occurrences(doc_id, text):
    for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
        h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
        yield w[:h % len(w)] + w[h % len(w) + 1:] if h % 199 == 0 else w


def _variants(counts: Counter, ratio=5):
    """word -> (form, root, n, n_near, form_n) by shared deletions and wildcards."""
    near = {w: set() for w in counts}
    shared: dict[tuple, set] = {}
    for w in counts:
        for k in range(len(w)):
            shared.setdefault((k, w[:k], w[k + 1:]), set()).add(w)
            if w[:k] + w[k + 1:] in counts:
                near[w].add(w[:k] + w[k + 1:])
                near[w[:k] + w[k + 1:]].add(w)
    for group in shared.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return {w: (form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts}


def _found(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_spelling_query_follows_brute_force(spark, sf):
    total = Counter(w for i, t in _texts(spark, sf) for w in _occurrences(i, t) if len(w) >= 6)
    want = _variants(Counter({w: n for w, n in total.items() if n >= 5}))
    assert any(f for f, *_ in want.values()) and any(r != w and r != want[w][0] for w, (f, r, *_) in want.items() if f)
    assert _found(queries.op11_spelling_variants(spark, sf)) == want


@pytest.mark.parametrize("symbols, bits", [(1, 8), (2, 27), (8, 10), (16, 20)])
def test_spelling_any_alphabet(spark, symbols, bits):
    rng = random.Random(symbols)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(6, 9))) for _ in range(300)} | {"a" * 40, "a" * 39, "a" * 38}
    counts = Counter({w: rng.choice((5, 6, 40, 300)) for w in words})
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(counts.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert _found(spelling.variants(docs, symbols=symbols, filter_bits=bits)) == _variants(counts)


def test_neighbourhood_is_full_and_distinct():
    x = np.array([[1, 2, 2, 3], [4, 4, 4, 4]], np.uint64)
    for row, hashes in zip(x.tolist(), spelling.neighbourhoods(x, 4)):
        near = {tuple(row)} | {tuple(row[:k] + row[k + 1:]) for k in range(4)}
        near |= {tuple(row[:k] + [s] + row[k + 1:]) for k in range(4) for s in range(1, 5)}
        near |= {tuple(row[:k] + [s] + row[k:]) for k in range(5) for s in range(1, 5)}
        assert set(hashes.tolist()) == {int(spelling.keys(np.array([n], np.uint64))[0]) for n in near}


def test_spelling_ties_chains_and_cuts(spark, monkeypatch):
    said = {"colour": 200, "color": 1000, "colours": 39, "colors": 39, "colourss": 7, "abcdef": 5, "abcdeg": 25, "abcdeh": 25, "Zebraß": 6}
    docs = spark.createDataFrame([(1, " ".join(w for w, n in said.items() for _ in range(n))), (2, None), (None, "")],
                                 "doc_id long, text string")
    got = _found(spelling.variants(docs))
    assert "color" not in got and "zebraß" in got  # too short; only A-Z is lower-cased
    assert got["abcdef"] == ("abcdeg", "abcdeg", 5, 2, 25)
    assert got["colourss"] == ("colours", "colour", 7, 1, 39) and got["colours"][:2] == ("colour", "colour")
    text = "aé " * 50 + "x" * 40 + "中文 abcdefgh" * 9 + "y" * 30
    monkeypatch.setattr(spelling, "STEP", 7)
    assert [w for run in spelling.word_runs(text) for w in run] == [
        w.encode() for w in re.findall("[A-Za-zÀ-ÿ]+", text)]


def test_spelling_odd_rows(odd_docs, no_docs):
    got = _found(spelling.variants(odd_docs, spelling.keyed_deletion(199), min_length=4))
    assert got["word"][2] == 60_000 and got["stand"][2] == 8  # null, repeated and equal rows all count
    assert spelling.variants(no_docs).count() == 0


# ---- decontamination

WORDS = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _leaks(docs, items, window=10):
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = _words(text)
        m = min(len(w), window)
        for k in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[k:k + m]), set()).add("" if item is None else str(item))
    out = []
    sizes = {len(w) for w in windows}
    for doc_id, text in docs:
        w, hit, found = _words(text), set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                held = windows.get(tuple(w[k:k + m]))
                if held:
                    hit |= set(range(k, k + m))
                    found |= held
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def _report(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_leaks_query_follows_brute_force(spark, sf):
    docs, items = _texts(spark, sf), _texts(spark, sf, "benchmark", "item_id")
    want = _leaks(docs, items)
    assert any(r[-1] for r in want) and not all(r[-1] for r in want)
    assert _report(queries.op12_decontamination(spark, sf)) == want


@pytest.mark.parametrize("block_words", [1 << 20, 60])
def test_leaks_random(spark, block_words):
    rng = random.Random(7)

    def said(n):
        return " ".join(rng.choice(("a", "b", "B", "c.", "é")) for _ in range(n))
    items = [(k % 25, said(rng.randint(0, 9))) for k in range(40)] + [(None, "a b a"), (100, ""), (101, None)]
    docs = [(k, said(rng.randint(0, 60))) for k in range(60)] + [(3, "zz a b a zz"), (None, "a b a"), (5, None)]
    for window in (3, 4):
        d = spark.createDataFrame(docs, "doc_id long, text string")
        i = spark.createDataFrame(items, "item_id long, text string")
        got = decontaminate.scan(d, i, window=window, block_words=block_words)
        want = _leaks(docs, items, window)
        assert sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(),
                        r.n_hit > 0) for r in got.collect()), key=str) == want


def test_spans_are_cut_and_coverage_drops(spark):
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Start here: One, two THREE four; and so on and on."), (2, "one two three four five six!"),
                                  (3, "clean text"), (4, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in decontaminate.scan(docs, items, window=4).collect()}
    assert [tuple(s) for s in found[1].spans] == [(2, 6)] and found[1].longest == 4 and found[2].longest == 6
    got = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items, window=4, max_coverage=0.5).collect()}
    assert got == {1: "Start here: ; and so on and on.", 3: "clean text", 4: None}


def test_longest_passage_and_long_texts(monkeypatch):
    rng = random.Random(3)
    items = [(str(k), [rng.choice("abcd").encode() for _ in range(30)]) for k in range(12)]
    m = decontaminate.Matcher(decontaminate.Automaton(5).build(items).dump())
    monkeypatch.setattr(decontaminate, "STEP", 5)
    for _ in range(30):
        text = " ".join(rng.choice("abcde") for _ in range(80))
        words = text.encode().split()
        longest = max((n for _, w in items for i in range(30) for n in range(5, 31 - i)
                       if any(words[k:k + n] == w[i:i + n] for k in range(len(words) - n + 1))), default=0)
        assert len(m.numbers(text)) == 80 and m.match(m.numbers(text))[2] == longest


def test_leaks_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "word " * 30), (1, "the same words"), (2, None)], "item_id long, text string")
    got = decontaminate.report(odd_docs, items).collect()
    assert len(got) == odd_docs.count()
    assert {r.n_hit for r in got if r.doc_id == 5} == {60_000} and {r.n_hit for r in got if r.doc_id == 4} == {3}
    assert {(r.n_words, r.contaminated) for r in got if r.doc_id in (1, 2, 8)} == {(0, False)}
    assert decontaminate.report(no_docs, items).count() == 0
    assert not any(r.contaminated for r in decontaminate.report(odd_docs, items.limit(0)).collect())


# ---- token alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _aligned(docs):
    """The contract's columns from cumulative ends."""
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    vocab = {k: t for t, k in json.load(open(A, encoding="utf-8"))["model"]["vocab"].items()}

    def a_bytes(k):
        return bytes(byte_of[c] for c in vocab[k])

    def b_bytes(k):
        p = model.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode()

    rows, pairs = [], Counter()
    for doc_id, text in docs:
        groups, a, b = [], [], []
        if text:
            a, b = tok.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
            if not b"".join(map(a_bytes, a)) == b"".join(map(b_bytes, b)) == (" " + text).encode():
                a, b = [], []
            ends = [], []
            for ids, size, to in ((a, a_bytes, ends[0]), (b, b_bytes, ends[1])):
                n = 0
                for k in ids:
                    n += len(size(k))
                    to.append(n)
            i = j = 0
            for end in sorted(set(ends[0]) & set(ends[1])):
                p, q = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
                groups.append((a[i:p], b[j:q]))
                i, j = p, q
        links = [(x[-1], y[-1]) for x, y in groups]
        pairs.update(links)
        rows.append((doc_id, a, b, groups, links))
    top = Counter()
    for (_, b), n in pairs.items():
        top[b] = max(top[b], n)
    out = []
    for doc_id, a, b, groups, links in rows:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(pairs[p] == top[p[1]] for p in links),
                    sum(pairs[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


CONTRACT = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _rows(df):
    return sorted(map(tuple, df.select(*CONTRACT).collect()), key=str)


def test_alignment_query_follows_brute_force(spark, sf):
    want = _aligned(_texts(spark, sf))
    assert sum(r[1] for r in want) > 0
    assert _rows(queries.op13_token_alignment(spark, sf)) == want


def test_alignment_of_odd_texts(spark, monkeypatch):
    texts = ["a", " ", "  two  blanks ", "<|endoftext|> is <s> plain </s><unk>", "tab\tand\r\nline\n\n", "▁mark", "é😀中文 naïve ́x",
             "\x00\x01", "don't  stop " * 40, "x" * 3000, "", None, "ﬁ ligature ①", "aaaa" * 50 + "   　", "1234567890 3.14"]
    docs = list(enumerate(texts)) + [(1, " "), (None, "null id")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = _aligned(docs)
    assert sum(r[1] == 0 for r in want) >= 3 and sum(r[1] > 0 for r in want) >= 10
    assert _rows(align.align(df, A, B)) == want
    monkeypatch.setattr(align, "CHARS", 10)
    assert _rows(align.align(df, A, B)) == want


def test_pointer_jumping_against_common_ends():
    rng = np.random.default_rng(5)
    for size in (1, 2, 50, 3000):
        end_a, end_b = (np.unique(np.append(rng.integers(1, size + 1, size // 2), size)) for _ in "ab")
        common = np.intersect1d(end_a, end_b)
        last = align.terminals(end_a, end_b)
        want = len(end_a) + np.searchsorted(end_b, common)
        assert (last == np.concatenate([want[np.searchsorted(common, e)] for e in (end_a, end_b)])).all()
    # a chain over the whole text: two tokens each, shifted by one
    end_a, end_b = np.append(np.arange(2, 20_000, 2), 20_001), np.append(np.arange(1, 20_001, 2), 20_001)
    assert (align.terminals(end_a, end_b) == len(end_a) + len(end_b) - 1).all()


def test_pair_counts_and_odd_rows(spark, odd_docs, no_docs):
    scratch = Scratch(spark, "test")
    aligned = scratch.keep(align.groups(odd_docs, A, B))
    counts = align.pair_counts(aligned, A, B).collect()
    assert sum(r.n for r in counts) == aligned.selectExpr("sum(size(links)) AS n").first().n
    assert len({(r.a_id, r.b_id) for r in counts}) == len(counts) <= len(align.vocabularies(A, B).pairs)
    got = {r.doc_id: r for r in align.align(odd_docs, A, B).collect()}
    assert got[1].n_a == 0 and got[1].groups_sha256 == "" and got[5].n_links > 50_000
    assert align.align(no_docs, A, B).count() == 0

"""Focus scoring, cycles, dead code vs brute force, partition invariance."""
from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tokenloom.operators.focus import focus_score, query_keywords, rank_files


def score(spark, path, content, query):
    df = spark.createDataFrame([(path, content)], "path string, content string")
    return round(df.select(focus_score(query_keywords(query), F.col("path"), F.col("content")).alias("s")).first().s, 2)


def test_focus_scores(spark):
    assert score(spark, "auth/login.py", "pass", "auth") == 3.0
    assert score(spark, "f.py", "auth", "auth") == 1.0
    assert score(spark, "f.py", "auth " * 6, "auth") == 1.8
    assert score(spark, "f.py", "auth", "a b") == 0.0
    # size penalty: 1000 tokens halve the score
    assert score(spark, "f.py", "auth " + "zzz " * 999, "auth") == 0.5


def test_rank_files_top_and_ties(spark):
    rows = [("p", f"m{i}.py", "config " * (i % 3 + 1)) for i in range(12)]
    df = spark.createDataFrame(rows, "project string, path string, content string")
    r = rank_files(df, "config", top=5).orderBy("rank").collect()
    assert [x.rank for x in r] == [1, 2, 3, 4, 5]
    assert [x.score for x in r] == sorted([x.score for x in r], reverse=True)
    assert r[0].reason == "content:config"


def test_cycles_small(spark):
    from tokenloom.operators.graph import find_cycles
    e = spark.createDataFrame([("p", "a.py", "b.py"), ("p", "b.py", "a.py"), ("p", "c.py", "c.py"), ("p", "b.py", "d.py"),
                               ("q", "x", "y"), ("q", "y", "z"), ("q", "z", "x"), ("q", "x", "z")],
                              "project string, src string, dst string")
    got = sorted((r.project, r.chain) for r in find_cycles(spark, e).collect())
    assert got == [("p", "a.py -> b.py -> a.py"), ("p", "c.py -> c.py"), ("q", "x -> y -> z -> x"), ("q", "x -> z -> x")]


def _brute_unused(files):
    out = set()
    for proj, path, text, syms in files:
        for s in syms:
            if s.startswith("_") or text.count(s) > 1:
                continue
            if any(s in t for p2, q2, t, _ in files if p2 == proj and q2 != path):
                continue
            out.add((proj, path, s))
    return out


def test_unused_symbols_vs_brute_force(spark):
    from tokenloom.operators.deadcode import unused_symbols
    rnd = random.Random(3)
    alphabet = ["get", "get_user", "user", "set", "id", "x", "load_all", "_private", "userid", "Getter"]
    files = []
    for proj in ("p1", "p2"):
        for i in range(6):
            words = [rnd.choice(alphabet) + rnd.choice(["", "s", "_v"]) for _ in range(rnd.randint(2, 8))]
            syms = sorted(set(rnd.sample(words, min(3, len(words)))))
            files.append((proj, f"f{i}.py", " ".join(words) + "\n", syms))
    df = spark.createDataFrame(files, "project string, path string, content string, symbols array<string>")
    got = {(r.project, r.path, r.symbol) for r in unused_symbols(df).collect()}
    assert got == _brute_unused(files)


INVARIANT = ["rank_files", "merge_ranges", "unused_symbols", "suggest_rules", "diff_context", "code_cycles",
             "session_usage", "hot_files"]


@pytest.mark.parametrize("parts", [1, 16])
def test_partition_invariance(spark, sf_small, parts):
    """Same results whatever the number of shuffle partitions."""
    from tokenloom.plans.registry import QUERIES
    base = {q: sorted(map(tuple, QUERIES[q](spark, sf_small).collect())) for q in INVARIANT}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        again = {q: sorted(map(tuple, QUERIES[q](spark, sf_small).collect())) for q in INVARIANT}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    for q in INVARIANT:
        assert again[q] == base[q], q


def test_unused_symbols_follow_brute_force(spark):
    """J5 with symbols of all lengths, and a very long word."""
    import random

    from tokenloom.operators.deadcode import unused_symbols
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 12))) for _ in range(120)]
    texts = {f"f{k}.py": " ".join(rnd.sample(words, 40)) + (" " + "abcab" * 4000 if k == 0 else "") for k in range(6)}
    rows = [("p", path, text, sorted(set(text.split()))) for path, text in texts.items()]
    got = {(r.path, r.symbol) for r in unused_symbols(spark.createDataFrame(
        rows, "project string, path string, content string, symbols array<string>")).collect()}
    want = {(p, s) for _, p, t, symbols in rows for s in symbols
            if t.count(s) <= 1 and not any(s in o for q, o in texts.items() if q != p)}
    assert got == want and want


def test_batch_ranking_of_long_path_tokens(spark):
    """W7 batch: keywords inside a path token of 10,000 letters, rows in proportion to its length."""
    from tokenloom.operators.focus import rank_files_batch
    files = spark.createDataFrame([("p", "x" * 5_000 + "needle" + "y" * 5_000 + ".py", "some text"), ("p", "b.py", "needle needle"), ("q", "needle", "")],
                                  "project string, path string, content string")
    queries = spark.createDataFrame([("p", 1, "find the needle"), ("p", 2, "yyy"), ("q", 1, "haystack")], "project string, query_id long, query string")
    got = sorted((r.project, r.query_id, r.path[:1], r.score) for r in rank_files_batch(files, queries).collect())
    assert got == [("p", 1, "b", 1.2), ("p", 1, "x", 3.0), ("p", 2, "x", 3.0)]


def test_hot_grams_are_split(spark):
    """One gram in all words, dealt to many keys, gives the same first and last files."""
    from tokenloom.operators.deadcode import symbol_usage
    words = [f"common{k:03}tail" for k in range(120)]
    rows = [("p", f"f{k:03}.py", [words[k], words[(7 * k) % 120] + "more"]) for k in range(120)] + [("q", "g.py", ["commonality"])]
    summary = spark.createDataFrame(rows, "project string, path string, words array<string>")
    symbols = [("p", s) for s in ("common", "ommon0", "common01", "tailmore", "nothing", "common119tail")] + [("q", "common"), ("q", "commontail")]
    asked = spark.createDataFrame(symbols, "project string, symbol string")
    want = {}
    for p, s in symbols:
        files = sorted(f for q, f, w in rows if q == p and any(s in x for x in w))
        if files:
            want[p, s] = (files[0], files[-1])
    for hot in (1_000, 10, 1):
        got = {(r.project, r.symbol): (r.first_file, r.last_file) for r in symbol_usage(summary, asked, hot).collect()}
        assert got == want


def test_unused_symbols_without_pairs(spark):
    """Thousands of words of two letters share every gram; the symbols meet
    their words in sorted order, and no pair of both is formed and verified."""
    import random

    from tokenloom.operators.deadcode import unused_symbols
    rnd = random.Random(3)
    words = ["".join(rnd.choice("ab") for _ in range(rnd.randint(10, 14))) for _ in range(2_000)]
    texts = {f"f{k:02}.py": " ".join(rnd.sample(words, 60)) for k in range(30)}
    rows = [("p", path, text, sorted(set(text.split()))) for path, text in texts.items()]
    unused = unused_symbols(spark.createDataFrame(rows, "project string, path string, content string, symbols array<string>"))
    want = {(p, s) for _, p, t, symbols in rows for s in symbols
            if t.count(s) <= 1 and not any(s in o for q, o in texts.items() if q != p)}
    assert {(r.path, r.symbol) for r in unused.collect()} == want and want
    assert "Contains(" not in unused._jdf.queryExecution().optimizedPlan().toString()


def test_unused_symbols_of_repeated_and_blank_rows(spark):
    """Rows with one path are one file, overlapping occurrences count once,
    rows without project or path have no neighbours."""
    from tokenloom.operators.deadcode import unused_symbols
    rows = [("p", "a.py", "one two two", ["one", "two"]), ("p", "a.py", "one two", ["one", "two"]),
            ("p", "b.py", "anana 1left", ["ana", "left"]), ("p", "c.py", "thathat 2left", ["that", "left"]), ("p", "d.py", "xyzxyz", ["xyz"]),
            (None, "e.py", "alone", ["alone"]), (None, "f.py", "alone", ["alone"]), ("p", None, "one alone", ["alone"])]
    got = sorted((r.path or "", r.symbol) for r in unused_symbols(spark.createDataFrame(
        rows, "project string, path string, content string, symbols array<string>")).collect())
    assert got == [("", "alone"), ("a.py", "one"), ("a.py", "two"), ("b.py", "ana"), ("c.py", "that"), ("e.py", "alone"), ("f.py", "alone")]

"""Rule suggestions (W6), slim report (A14) and health score (A11) on hand-made tables."""
from __future__ import annotations

from pyspark.sql import functions as F


def files_df(spark, rows):
    return spark.createDataFrame(rows, "project string, path string, tokens long")


def rules_df(spark, rows):
    return spark.createDataFrame(rows, "project string, ord int, pattern string")


def test_suggest_rules(spark):
    from tokenloom.operators.budget import slim_report, suggest_rules
    rows = [("p", "docs/guide.md", 900), ("p", "docs/api.md", 700), ("p", "src/core.py", 9000),
            ("p", "yarn.lock", 400), ("p", "big_notes.txt", 5000), ("p", "examples/demo.py", 600),
            ("p", "logs/run.log", 800), ("p", "tiny/x.txt", 10), ("q", "vendor/lib.js", 2000)]
    rules = rules_df(spark, [("p", 1, "logs/"), ("q", 1, "vendor/")])
    s = {(r.project, r.pattern): r for r in suggest_rules(files_df(spark, rows), rules).collect()}
    assert ("p", "docs/") in s and s[("p", "docs/")].saves_tokens == 1600
    assert s[("p", "docs/")].reason == "Documentation rarely needed during coding"
    assert ("p", "*.lock") in s and ("p", "big_notes.txt") in s and ("p", "*.txt") in s
    assert not any(pat.startswith("src") for _, pat in s)                 # never src/
    assert ("p", "logs/") not in s and ("q", "vendor/") not in s          # already ignored / existing rule
    assert ("p", "tiny/") not in s                                         # under 500 tokens
    ranks = [r.rank for r in sorted(s.values(), key=lambda r: (r.project, r.rank)) if r.project == "p"]
    assert ranks == list(range(1, len(ranks) + 1))
    rep = {r.project: r for r in slim_report(files_df(spark, rows), rules, budget=10_000).collect()}
    assert rep["p"].over_budget and rep["p"].tokens_after >= 0


def test_health_score_parts(spark):
    from tokenloom.operators.health import health_score
    budget = spark.createDataFrame([("p", 1000, 700), ("q", 0, 0)], "project string, baseline long, optimized long")
    facts = spark.createDataFrame([
        ("p", "a.py", ["f", "g"], 1, 4), ("p", "b.py", [], 0, 2), ("q", "c.py", [], 0, 0)],
        "project string, path string, functions array<string>, typed_functions long, complexity long")
    unused = spark.createDataFrame([("p", "a.py", "g", 1)], "project string, path string, symbol string, pos long")
    cycles = spark.createDataFrame([("p", 1), ("q", 0)], "project string, n_cycles long")
    h = {r.project: r for r in health_score(budget, facts, unused, cycles).collect()}
    p = h["p"]
    # savings 30 %; typed 1/2 = 50 %; complexity 6 / (2 + 1) = 2 per function -> 80; one dead file -> 90; one cycle -> 67
    assert (p.token_savings, p.type_coverage, p.complexity_score, p.dead_code_score, p.cycle_score) == (30.0, 50.0, 80.0, 90.0, 67.0)
    assert p.total == round(30 * .3 + 50 * .25 + 80 * .2 + 90 * .15 + 67 * .1, 1) and p.grade == "D"
    q = h["q"]
    assert q.type_coverage == 100.0 and q.complexity_score == 100.0 and q.cycle_score == 100.0

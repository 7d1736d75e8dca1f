"""Scalar functions (C1-C17) and path predicates."""
from __future__ import annotations

import fnmatch
import random

import pytest
from pyspark.sql import functions as F

from tokenloom.functions import paths as P
from tokenloom.functions import scores as S
from tokenloom.functions import text as T
from tokenloom.operators import filters as FL
from tokenloom.operators.focus import query_keywords
from tokenloom.operators.ranges import hunk_range


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return df.select(expr.alias("x")).first()["x"]


def test_word_tokens_and_lines(spark):
    assert one(spark, T.word_tokens("t"), t="Fix the AuthService login_flow; db x9ab 12abc") == [
        "fix", "the", "authservice", "login_flow", "x9ab", "abc"]
    assert one(spark, T.line_count("t"), t="") == 1
    assert one(spark, T.line_count("t"), t="a\nb\n") == 3
    assert query_keywords("Fix the auth bug in auth") == ["auth", "bug", "fix", "the"]


def test_signature_lines(spark):
    src = "class Foo:\n    def bar(self):\n        pass\n    async def  baz(self, x) -> int:\nx = 1\n"
    assert one(spark, T.signature_lines("t"), t=src) == ["class Foo", "  def bar(self)", "  async def baz(self, x) -> int"]


@pytest.mark.parametrize("ext,expected", [
    ("toml", "a = 1  # keep\n; semi"),
    ("ini", "a = 1  # keep"),
    ("md", "# heading\na = 1  # keep\n; semi"),
    ("txt", "# heading\na = 1  # keep\n; semi"),
])
def test_strip_boilerplate(spark, ext, expected):
    text = "\n# heading\n\na = 1  # keep\n   \n; semi\n"
    assert one(spark, T.strip_boilerplate("t", "e"), t=text, e=ext) == expected


@pytest.mark.parametrize("line,rng", [
    ("@@ -1,3 +1,5 @@", (1, 5)), ("@@ -20,2 +23,1 @@", (23, 23)), ("@@ -1 +1 @@", (1, 1)),
    ("@@ -5,0 +6,1 @@", (6, 6)), ("@@ -7,2 +0,0 @@", (0, 0)), ("@@ bogus", None),
])
def test_hunk_range(spark, line, rng):
    r = one(spark, hunk_range(F.col("t")), t=line)
    assert (None if r is None else (r["start_line"], r["end_line"])) == rng


@pytest.mark.parametrize("path,ext,sfx,top", [
    ("a/b.tar.gz", ".gz", ".gz", "a"), ("README", "", "", ""), ("x/.env", ".env", "", "x"), ("a.b/c", ".b/c", "", "a.b"),
])
def test_path_parts(spark, path, ext, sfx, top):
    assert one(spark, P.extension("p"), p=path) == ext
    assert one(spark, P.suffix("p"), p=path) == sfx
    assert one(spark, P.top_dir("p"), p=path) == top


IGNORE_CASES = [
    ("build/out.py", "build/", True), ("src/x.egg-info/PKG", "*.egg-info/", True), ("docs/a/b.md", "docs/*.md", True),
    ("a/b/c.py", "a/b/", False), ("src/build.py", "build", False), ("A.LOG", "*.log", False),
    ("x/ab1.py", "[!b]*", True), ("b/b.py", "[!b]*", False), ("doc_12.md", "doc_1?.md", True), ("keep.py", "!keep.py", False),
]


def _python_rule(rel: str, pat: str) -> bool:
    parts = rel.split("/")
    pat = pat.rstrip("/")
    return (pat in parts or fnmatch.fnmatch(rel, pat) or fnmatch.fnmatch(parts[-1], pat)
            or any(fnmatch.fnmatch(p, pat) for p in parts))


def test_ignore_rule_matching(spark):
    rows = [(f"p{i}", path, pat) for i, (path, pat, _) in enumerate(IGNORE_CASES)]
    files = spark.createDataFrame([(p, path) for p, path, _ in rows], "project string, path string")
    rules = spark.createDataFrame([(p, 1, pat) for p, _, pat in rows], "project string, ord int, pattern string")
    got = {r.project: r.rule_ignored for r in FL.with_rule_match(files, rules).collect()}
    for i, (path, pat, expected) in enumerate(IGNORE_CASES):
        assert got[f"p{i}"] == expected == _python_rule(path, pat), (path, pat)


def test_glob_against_fnmatch(spark):
    pats = ["*.py", "a?c", "[!x]*.md", "[a-c]*", "docs", "x.y+z", "(a)|b", "a$b^c", "we ird{1}", "a[*]b", "a[?]b", "[[]x",
            "[z-a]*", "[]a]", "[!]a]", "[a-]", "[--a]", "[!", "[a", "a[]", "[&&b]", "[\\d]", "a\nb"]
    names = ["a.py", "abc", "x.md", "y.md", "b1", "docs", "x.y+z", "(a)|b", "a$b^c", "we ird{1}", "aXc", "d.py/q", "a*b", "a?b",
             "axb", "[x", "]", "-", "&", "\\", "d", "[a", "[!", "a[]", "a\nb", "", "a"]
    rnd = random.Random(5)
    letters = "ab-z[]!*?^\\/.&~|"
    rows = [(p, n) for p in pats for n in names]
    for _ in range(1500):
        p = "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 8)))
        rows += [(p, "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 5)))), (p, p.replace("*", "a").replace("?", "b"))]
    df = spark.createDataFrame(rows, "p string, n string")
    out = (df.withColumn("rx", P.glob_to_regex("p"))
           .select("p", "n", F.expr("n RLIKE concat('(?s)\\\\A(?:', rx, ')\\\\z')").alias("m")).collect())
    for r in out:
        assert r.m == fnmatch.fnmatchcase(r.n, r.p), (r.p, r.n)


def test_bad_rules_match_nothing(spark):
    files = spark.createDataFrame([("p", "a/[x"), ("p", "a/b.py"), ("q", "z.md")], "project string, path string")
    rules = spark.createDataFrame([("p", 1, "[z-a]*"), ("p", 2, "[[]x"), ("q", 1, "[!z]*")], "project string, ord int, pattern string")
    got = {r.path: r.rule_ignored for r in FL.with_rule_match(files, rules).collect()}
    assert got == {"a/[x": True, "a/b.py": False, "z.md": False}


def test_scores(spark):
    assert one(spark, S.session_cost(F.lit(12), F.lit(7), F.lit(2), F.lit(1)), x="") == 0.00015
    assert one(spark, S.human_count(F.lit(1_234_567)), x="") == "1.23M"
    assert one(spark, S.human_count(F.lit(4500)), x="") == "4.5k"
    assert one(spark, S.health_grade(F.lit(89.99)), x="") == "B"
    assert one(spark, S.complexity_grade(F.lit(11)), x="") == "C"
    assert one(spark, S.classify_dir(F.lit("Docs")), x="") == "Documentation rarely needed during coding"
    assert one(spark, S.reduction_pct(F.lit(5), F.lit(0)), x="") == 0.0


@pytest.mark.parametrize("constant_globs", [64, 0])
def test_rules_of_every_kind_against_fnmatch(spark, constant_globs):
    """F3 on random rules and paths, general globs as constants and by the compiled matcher."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("ab.c") for _ in range(rnd.randint(1, 3)))
    forms = [lambda: word(), lambda: "*" + word(), lambda: word() + "*", lambda: word() + "*" + word(), lambda: "*" + word() + "*",
             lambda: word() + "?" + word(), lambda: f"[{word()}]*", lambda: f"[!{word()}]" + word(), lambda: "*" + word() + "*" + word(),
             lambda: word() + "/" + word(), lambda: word() + "/*", lambda: "*/" + word(), lambda: word() + "/", lambda: "**", lambda: "*"]
    rules = [(f"p{k}", 1, rnd.choice(forms)()) for k in range(60)]
    paths = [(p, "/".join(word() for _ in range(rnd.randint(1, 4)))) for p, _, _ in rules for _ in range(25)] + [("p1", "[ab]*"), ("none", "a")]
    files = spark.createDataFrame(paths, "project string, path string")
    df = FL.with_rule_match(files, spark.createDataFrame(rules, "project string, ord int, pattern string"), constant_globs)
    of = {p: g.rstrip("/") for p, _, g in rules}
    for r in df.collect():
        assert r.has_rules == (r.project in of)
        assert r.rule_ignored == (r.project in of and _python_rule(r.path, of[r.project])), (r.path, of.get(r.project))
    if constant_globs:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "RLIKE full_rx" not in plan and "ArrowEvalPython" not in plan

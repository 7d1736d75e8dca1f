"""R5-R7 as ordered lines, distributed ranks (W5, W8), sinks."""
from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import reports as RP
from tokenloom.operators.ranking import ranked
from tokenloom.sources.sinks import write_json, write_lines, write_table


@pytest.fixture(scope="module")
def snapshot(spark):
    paths = spark.createDataFrame([("a", "pkg/m.py"), ("a", "pkg/sub/n.py"), ("a", "README.md"), ("b", "x.go")], "project string, path string")
    sigs = spark.createDataFrame([("a", "pkg/m.py", ["def f(x)", "class C", "  def g(self)"])], "project string, path string, sigs array<string>")
    docs = spark.createDataFrame([("a", "README.md", "md", "# Title\ntext")], "project string, path string, ext string, body string")
    return RP.snapshot_lines(RP.file_tree(paths), sigs, docs)


def test_snapshot_text(snapshot):
    text = {r.project: r.doc for r in RP.as_text(snapshot).collect()}
    assert text["a"] == "\n".join([
        "# Project Snapshot — a", "", RP.SNAPSHOT_NOTE, "", "## File Tree", "```", "  README.md", "  pkg/", "    m.py", "    sub/", "      n.py",
        "```", "", "## Signatures", "", "### `pkg/m.py`", "```python", "def f(x)", "class C", "  def g(self)", "```", "",
        "## Config & Docs", "", "### `README.md`", "```md", "# Title", "text", "```", ""])
    assert text["b"].endswith("```\n  x.go\n```\n") and "Signatures" not in text["b"] and "Config" not in text["b"]


def test_checkpoint_text(snapshot):
    text = {r.project: r.doc for r in RP.as_text(RP.checkpoint_lines(snapshot, " next step ")).collect()}
    assert text["a"].startswith("# a — Checkpoint\n\n") and "## Project overview\n\n# Project Snapshot — a\n" in text["a"]
    assert text["a"].endswith("```\n\n## Next task\n\nnext step\n")
    assert RP.as_text(RP.checkpoint_lines(snapshot)).where(F.col("doc").contains(RP.NO_TASK)).count() == 2


def test_lines_are_numbered_and_written_in_order(spark, snapshot, tmp_path):
    texts = {r.project: r.doc.split("\n") for r in RP.as_text(snapshot).collect()}
    got = {(r.project, r.line_no): r.line for r in RP.numbered(snapshot).collect()}
    assert got == {(p, k): line for p, lines in texts.items() for k, line in enumerate(lines, 1)}
    write_lines(snapshot, f"{tmp_path}/lines")
    rows = [tuple(r)[:4] for r in spark.read.parquet(f"{tmp_path}/lines").coalesce(1).collect()]
    assert len(rows) == len(got) and all(r in [tuple(x)[:4] for x in snapshot.collect()] for r in rows[:5])
    tokens = {r.project: r.tokens for r in RP.line_tokens(snapshot).collect()}
    assert set(tokens) == {"a", "b"} and tokens["a"] > tokens["b"] > 0


def test_guide_lines(spark):
    facts = spark.createDataFrame([("a", f"pkg/m{k}.py", 100_000, ["f"], ["C"], 1, 3) for k in range(12)] + [("b", "x.py", 1, [], [], 0, 0)],
                                  "project string, path string, lines long, functions array<string>, classes array<string>, "
                                  "typed_functions long, complexity long")
    most = spark.createDataFrame([("a", "pkg/m1.py", 2, 1), ("a", "pkg/m2.py", 1, 2), ("a", "pkg/m3.py", 0, 3)],
                                 "project string, path string, imported_by long, rank long")
    hot = spark.createDataFrame([("a", f"pkg/m{k}.py", 20 - k, k + 1) for k in range(10)], "project string, path string, changes long, rank long")
    unused = spark.createDataFrame([("a", f"pkg/m{k:02}.py", ["f", "g"]) for k in range(12)], "project string, path string, symbols array<string>")
    fw = spark.createDataFrame([("a", "Flask")], "project string, framework string")
    files = spark.createDataFrame([("a", "DECISIONS.md")], "project string, path string")
    budget = spark.createDataFrame([("a", 12.34)], "project string, savings_pct double")
    text = {r.project: r.doc for r in RP.as_text(RP.project_lines(facts, RP.dir_tree(facts), most, hot, unused, fw, files, budget)).collect()}
    a = text["a"]
    assert "- **Lines of code:** 1,200,000\n" in a and "reduction with ignore rules:** 12.3%\n- **Detected frameworks:** Flask\n\n## Project Structure" in a
    assert "review carefully:\n\n| File | Imported by |\n|------|-------------|\n| `pkg/m1.py` | 2 files |\n| `pkg/m2.py` | 1 file |\n\n## Hot" in a
    assert a.count("| `pkg/m") == 2 + 8 and a.count("- **`pkg/m") == 10 and RP.DECISIONS[0] in a
    assert a.endswith("*.lock\n```\n") and "(flat project)" in text["b"] and "## Core" not in text["b"] and "reduction" not in text["b"]


def test_json_of_empty_parts(spark):
    totals = spark.createDataFrame([("a", 1, 2, 0, 0, 0, "python", "")], "project string, files long, total_lines long, total_functions long, "
                                   "total_classes long, typed_functions long, languages string, frameworks string")
    none = spark.createDataFrame([], "project string, path string, imported_by long, changes long, rank long, chain string")
    budget = spark.createDataFrame([("a", 5, 5, 0.0)], "project string, baseline long, optimized long, savings_pct double")
    quality = spark.createDataFrame([("a", 0.0, 0.0)], "project string, avg_complexity double, type_coverage_pct double")
    doc = json.loads(RP.analysis_json(totals, none, none, budget, none, quality).first().json)
    assert doc["frameworks"] == [] and doc["hot_files"] == {} and doc["most_imported"] == [] and doc["cycles"] == [] and doc["languages"] == ["python"]


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_rank_does_not_depend_on_partitions(spark, parts):
    rng = random.Random(parts)
    rows = [("hot" if k % 3 else f"p{k % 11}", f"f{k:04}", rng.randrange(20)) for k in range(1500)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = ranked(spark.createDataFrame(rows, "project string, path string, n long"), F.desc("n"), F.asc("path")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = {}
    for project in {r[0] for r in rows}:
        for k, r in enumerate(sorted((r for r in rows if r[0] == project), key=lambda r: (-r[2], r[1])), 1):
            want[project, r[1]] = k
    assert {(r.project, r.path): r["rank"] for r in got} == want


def test_sinks_keep_rows(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, ["x", "y"]), ("b", None, [])], "project string, n long, l array<string>")
    write_table(df, f"{tmp_path}/t")
    write_json(df, f"{tmp_path}/j")
    want = sorted(map(str, df.collect()))
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/t").select(*df.columns).collect())) == want
    assert sorted(map(str, spark.read.schema(df.schema).json(f"{tmp_path}/j").collect())) == want
    assert spark.read.parquet(f"{tmp_path}/t").where("project = 'a'").count() == 1

"""End to end over the small project below ``sample_project``, read through the
file-tree source (S1)."""
from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

SAMPLE = os.path.join(os.path.dirname(os.path.abspath(__file__)), "sample_project")


@pytest.fixture(scope="module")
def sample(spark):
    from tokenloom.operators.extract import extract_python_facts
    from tokenloom.operators.graph import in_degree, resolve_imports
    from tokenloom.sources.files import scan_files
    files = scan_files(spark, [SAMPLE]).where(~F.col("path").contains("__pycache__")).cache()
    facts = extract_python_facts(files).cache()
    edges = resolve_imports(facts, files).cache()
    return files, facts, edges, in_degree(facts, edges)


def test_scan_keeps_hidden_and_underscore_files(sample):
    assert {r.path for r in sample[0].collect()} == {
        ".env", "main.py", "shop/__init__.py", "shop/config.py", "shop/model.py", "shop/store.py", "shop/api.py"}


def test_totals(sample):
    t = sample[1].agg(F.count(F.lit(1)).alias("n"), F.sum("lines").alias("lines"), F.sum(F.size("functions")).alias("fn"),
                      F.sum(F.size("classes")).alias("cls"), F.sum("typed_functions").alias("typed")).first()
    assert (t.n, t.lines, t.fn, t.cls, t.typed) == (6, 42, 6, 1, 3)


def test_graph(spark, sample):
    from tokenloom.operators.graph import find_cycles
    edges = {(r.src, r.dst) for r in sample[2].collect()}
    assert edges == {("shop/model.py", "shop/config.py"), ("shop/store.py", "shop/model.py"), ("shop/store.py", "shop/api.py"),
                     ("shop/api.py", "shop/store.py"), ("main.py", "shop/api.py"), ("main.py", "shop/__init__.py")}
    assert {r.path: r.imported_by for r in sample[3].collect()} == {
        "shop/api.py": 2, "shop/config.py": 1, "shop/model.py": 1, "shop/store.py": 1, "shop/__init__.py": 1, "main.py": 0}
    assert [r.chain for r in find_cycles(spark, sample[2]).collect()] == ["shop/api.py -> shop/store.py -> shop/api.py"]


def test_unused(spark, sample):
    from tokenloom.operators.deadcode import unused_per_file, unused_symbols
    from tokenloom.operators.extract import extract_python_facts
    facts = extract_python_facts(sample[0], keep_content=True)  # the whole tree lies below tests/, so F4 is not applied
    defs = facts.select("project", "path", "content", F.concat("functions", "classes").alias("symbols"))
    got = {r.path: r.symbols for r in unused_per_file(unused_symbols(defs)).collect()}
    assert got == {"shop/model.py": ["price", "orphan_helper"]}


def test_a_missing_root_is_an_error(spark, tmp_path):
    from tokenloom.sources.files import scan_files
    with pytest.raises(Exception, match="No such file"):
        scan_files(spark, [str(tmp_path / "nowhere")]).count()


def test_scan_shards_split_one_big_folder(spark, tmp_path):
    """A project whose files sit below one folder is still split into many
    partitions, and every file (hidden and underscore names too) is read once."""
    from tokenloom.sources.files import scan_files
    root = tmp_path / "proj"
    for d in range(6):
        sub = root / "src" / f"pkg{d}"
        sub.mkdir(parents=True)
        (sub / "__init__.py").write_text("")
        (sub / f"m{d}.py").write_text("x = 1\n")
    (root / "src" / ".env").write_text("A=1\n")
    (root / ".rules").write_text("*.log\n")
    df = scan_files(spark, [str(root)])
    paths = sorted(r.path for r in df.collect())
    assert len(paths) == len(set(paths)) == 14
    assert "src/.env" in paths and ".rules" in paths and "src/pkg0/__init__.py" in paths
    assert df.rdd.getNumPartitions() >= 6

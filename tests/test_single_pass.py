"""Work in front of a range partitioning is done once, and the parser's walk sees every node."""
from __future__ import annotations

import ast
import inspect

from pyspark.sql import functions as F

from tokenloom.operators import pyfacts
from tokenloom.operators.ranking import ranked


def counted(spark, rows, schema):
    """Rows of some partitions that count how often they are computed."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    return spark.createDataFrame(rows, schema).repartition(6).mapInArrow(count, schema), seen


def test_ranked_computes_its_rows_once(spark):
    rows, seen = counted(spark, [(f"p{k % 3}", f"f{k:03}", k % 7) for k in range(600)], "project string, path string, n long")
    got = ranked(rows, F.desc("n"), F.asc("path"))
    assert got.count() == 600 and seen.value == 600


def test_walk_follows_all_fields():
    source = "\n".join(inspect.getsource(m) for m in (ast, inspect)) + """
@deco(lambda: (yield 1) if a and b else [x for x in y if x or z])
async def f(a: (1 if b else 2) = (c and d and e), *, k=(g or h)) -> int:
    match a:
        case {"x": [1, *_]} if a and b:
            def inner(): return None if a else b
    try:
        pass
    except* (E if a else F):
        import a.b, c
    with open(x if y else z) as w: from .rel import q
    from pkg.mod import (n as m)
    return f"{a if b else c!r:{d or e}}"
"""
    nodes = list(ast.walk(ast.parse(source)))
    defs = [n for n in nodes if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    branches = sum(isinstance(n, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp)) for n in nodes)
    branches += sum(len(n.values) - 1 for n in nodes if isinstance(n, ast.BoolOp))
    functions, classes, imports, cx, typed, broken = pyfacts.python_facts(source)
    assert sorted(functions) == sorted(n.name for n in defs) and typed == sum(n.returns is not None for n in defs)
    assert sorted(classes) == sorted(n.name for n in nodes if isinstance(n, ast.ClassDef))
    assert imports[-3:] == ["a.b", "c", "pkg.mod"] and cx == branches and not broken


def test_views_built_again_keep_what_is_materialised(spark, sf_small):
    from tokenloom.plans.views import load_views
    from tokenloom.session import materialize
    kept = materialize(load_views(spark, sf_small, ["v_code"])["v_code"].select("project", "path"))
    load_views(spark, sf_small, ["v_code_changes"])
    assert "InMemoryRelation" in kept.select("path")._jdf.queryExecution().optimizedPlan().toString()

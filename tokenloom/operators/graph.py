"""Import graph operators: J1/G1 resolve_imports, A6 in_degree, W1 top-n,
G2 find_cycles, G3 cycle_members, G4 cycle_count, X3 distinct edges.

All keyed by ``project`` first; per-project work is a join or a grouped
aggregate, never a collect.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.functions.paths import module_candidates
from tokenloom.operators.components import (CLOSED, CUT, LOCAL_STEPS, OPEN, extend_paths, inner_edges, live_steps,
                                            strong_components)
from tokenloom.session import Tables


def resolve_imports(facts: DataFrame, files: DataFrame | None = None, python_only: bool = True) -> DataFrame:
    """``import a.b`` -> ``a/b.py`` if that file exists, else
    ``a/b/__init__.py``; the edge is kept only when the chosen file is a
    parsed node.  Distinct ``(project, src, dst)``; self-edges allowed.

    ``files`` (all files of the projects) decides existence; when omitted the
    parsed nodes are used.
    """
    nodes = facts.select("project", "path")
    src_rows = facts.where(F.col("language") == "python") if python_only else facts
    imp = src_rows.select("project", F.col("path").alias("src"), F.explode("imports").alias("module")).distinct()
    cand = imp.select("project", "src", "module", F.explode(module_candidates("module")).alias("c")).select(
        "project", "src", "module", F.col("c.prio").alias("prio"), F.col("c.path").alias("dst"))
    existing = (files if files is not None else nodes).select("project", F.col("path").alias("dst")).distinct()
    chosen = (cand.join(existing, ["project", "dst"], "left_semi")
              .groupBy("project", "src", "module").agg(F.min_by("dst", "prio").alias("dst")))
    return chosen.join(nodes.select("project", F.col("path").alias("dst")), ["project", "dst"], "left_semi") \
        .select("project", "src", "dst").distinct()


def in_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Imported-by count per node; nodes without in-edges have 0."""
    cnt = edges.groupBy("project", F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("imported_by"))
    return (nodes.select("project", "path").join(cnt, ["project", "path"], "left")
            .select("project", "path", F.coalesce("imported_by", F.lit(0)).cast("long").alias("imported_by")))


def top_n_per_project(df: DataFrame, order_col: str, n: int, tie: str = "path", drop_zero: bool = False) -> DataFrame:
    """``row_number`` over (project) by ``order_col`` desc, ties by ``tie``."""
    if drop_zero:
        df = df.where(F.col(order_col) > 0)
    w = Window.partitionBy("project").orderBy(F.desc(order_col), tie)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def find_cycles(spark: SparkSession, edges: DataFrame, max_len: int | None = None, local_steps: int = LOCAL_STEPS) -> DataFrame:
    """Every simple cycle once, rooted at its smallest node, as ``project,
    cycle_len, chain, truncated`` with chain ``a -> b -> a``.

    Paths grow one edge per level, only along the live steps of their start
    (inside its component, through larger nodes) and only to nodes from which
    the start can be reached without the nodes they hold, so each cycle is found
    from its smallest node exactly once and every open path ends in a cycle.  A
    level is written, read by the next one and deleted; closed cycles are kept.
    With ``max_len`` a path goes on only if its way back fits; ``truncated`` then
    says that the project has a cycle that is longer.  The number of simple
    cycles can grow exponentially with a component's edges; membership, counts
    up to a bound and yes/no come from ``strong_components``.
    """
    t = Tables(spark, "cycles")
    e = t.keep(edges.select("project", "src", "dst").distinct())
    loops = e.where("src = dst").select("project", F.lit(1).cast("long").alias("cycle_len"),
                                        F.concat_ws(" -> ", "src", "src").alias("chain"))
    live = live_steps(spark, e, local_steps)
    paths = live.where("cur = start").select("project", "start", F.array("start", "nxt").alias("path"))
    n, closed, cut, level = paths.count(), [], [], None
    if max_len is not None and max_len < 2:
        cut, n = [paths.select("project")], 0
    while n:
        grown, seen = t.keep(extend_paths(paths, live, n, max_len), n=F.count_if(F.col("state") == OPEN),
                             done=F.count_if(F.col("state") == CLOSED), cut=F.count_if(F.col("state") == CUT))
        # the level before is used up, but for what closed in it
        t.drop(level)
        n, level = seen["n"], None if seen["done"] or seen["cut"] else grown
        paths = grown.where(F.col("state") == OPEN).select("project", "start", "path")
        if seen["done"]:
            closed.append(grown.where(F.col("state") == CLOSED))
        if seen["cut"]:
            cut.append(grown.where(F.col("state") == CUT).select("project"))
    out = loops
    for c in closed:
        out = out.unionByName(c.select("project", F.size("path").cast("long").alias("cycle_len"),
                                       F.array_join(F.concat("path", F.array("start")), " -> ").alias("chain")))
    if not cut:
        return out.withColumn("truncated", F.lit(False))
    over = cut[0]
    for c in cut[1:]:
        over = over.unionByName(c)
    return out.join(over.distinct().withColumn("truncated", F.lit(True)), "project", "left").select(
        "project", "cycle_len", "chain", F.coalesce("truncated", F.lit(False)).alias("truncated"))


def cycle_members(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """The files that lie on some cycle, by component membership and
    self-edges; no cycle is enumerated."""
    edges = Tables(spark, "members").keep(edges.select("project", "src", "dst").distinct())
    loops = edges.where("src = dst").select("project", F.col("src").alias("path"))
    return strong_components(spark, edges).select("project", "path").unionByName(loops).distinct()


def cycle_proof(spark: SparkSession, nodes: DataFrame, edges: DataFrame, enough: int = 4) -> DataFrame:
    """Per project ``n_cycles`` and whether that is ``exact``, without an
    exponential search.

    A component of m edges and n nodes holds at least m - n + 1 simple cycles:
    it is built from one cycle by adding paths, and every path closes a new one.
    Where these and the self-edges add up to ``enough``, the sum is returned as a
    lower bound.  The other projects' components have fewer than ``enough``
    surplus edges, hence fewer than 2^enough cycles, which are counted exactly.
    """
    t = Tables(spark, "proof")
    e = t.keep(edges.select("project", "src", "dst").distinct())
    parts = strong_components(spark, e)
    inside = t.keep(inner_edges(e.where("src <> dst"), parts))
    n_nodes = parts.groupBy("project").agg((F.count(F.lit(1)) - F.count_distinct("component")).alias("less"))
    n_edges = inside.groupBy("project").agg(F.count(F.lit(1)).alias("m"))
    loops = e.where("src = dst").groupBy("project").agg(F.count(F.lit(1)).alias("loops"))
    least = (nodes.select("project").distinct().join(n_edges, "project", "left").join(n_nodes, "project", "left")
             .join(loops, "project", "left").fillna(0)
             .select("project", "loops", (F.col("m") - F.col("less") + F.col("loops")).alias("least"), F.col("m") > 0))
    few = (F.col("least") < enough) & F.col("tangled")
    least, seen = t.keep(least.toDF("project", "loops", "least", "tangled"), few=F.count_if(few))
    exact = (F.col("least") < enough).alias("exact")
    if not seen["few"]:  # no component, or enough cycles everywhere
        return least.select("project", F.col("least").cast("long").alias("n_cycles"), exact)
    few = least.where(few).select("project")
    found = find_cycles(spark, inside.join(few, "project", "left_semi")).groupBy("project").agg(F.count(F.lit(1)).alias("found"))
    return least.join(found, "project", "left").select(
        "project", F.when(F.col("least") >= enough, F.col("least")).otherwise(F.col("loops") + F.coalesce("found", F.lit(0)))
        .cast("long").alias("n_cycles"), exact)


def cycle_count(nodes: DataFrame, cycles: DataFrame) -> DataFrame:
    """Number of simple cycles per project (0 for projects without any)."""
    c = cycles.groupBy("project").agg(F.count(F.lit(1)).alias("n_cycles"))
    return (nodes.select("project").distinct().join(c, "project", "left")
            .select("project", F.coalesce("n_cycles", F.lit(0)).cast("long").alias("n_cycles")))

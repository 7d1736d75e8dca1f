"""Composite health score (A11) and audit checks (A12), one row set per project."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.scores import health_grade

# Weights of the five parts.
WEIGHTS = {"token_savings": 0.30, "type_coverage": 0.25, "complexity_score": 0.20,
           "dead_code_score": 0.15, "cycle_score": 0.10}


def health_score(budget: DataFrame, src_facts: DataFrame, unused: DataFrame, cycle_counts: DataFrame) -> DataFrame:
    """Five 0-100 parts, weighted total and grade.

    ``budget``: A3 rows; ``src_facts``: source-only Python facts; ``unused``:
    J5 rows; ``cycle_counts``: ``n_cycles`` per project (all Python files).  The
    cycle part is 0 from 4 cycles on, so ``cycle_proof``, exact below 4, gives
    the exact score.  Each input is reduced to one row per project before the
    joins.
    """
    raw_pct = F.when(F.col("baseline") > 0, (F.col("baseline") - F.col("optimized")) / F.col("baseline") * 100.0) \
        .otherwise(F.lit(0.0))
    tok = budget.select("project", F.least(F.greatest(raw_pct, F.lit(0.0)), F.lit(100.0)).alias("token_savings"))
    q = src_facts.groupBy("project").agg(
        F.sum(F.size("functions")).alias("fns"), F.sum("typed_functions").alias("typed"),
        F.sum("complexity").alias("cx"), F.sum(F.greatest(F.size("functions"), F.lit(1))).alias("fn_floor"))
    q = q.select("project",
                 F.when(F.col("fns") > 0, F.col("typed") / F.col("fns") * 100.0).otherwise(F.lit(100.0)).alias("type_coverage"),
                 F.greatest(F.lit(0.0), 100.0 - F.col("cx") / F.col("fn_floor") * 10.0).alias("complexity_score"))
    dead = unused.groupBy("project").agg(F.countDistinct("path").alias("dead_files"))
    j = (q.join(tok, "project", "left").join(dead, "project", "left").join(cycle_counts, "project", "left")
         .fillna({"token_savings": 0.0, "dead_files": 0, "n_cycles": 0}))
    j = j.select("project", "token_savings", "type_coverage", "complexity_score",
                 F.greatest(F.lit(0.0), 100.0 - F.col("dead_files") * 10.0).alias("dead_code_score"),
                 F.greatest(F.lit(0.0), 100.0 - F.col("n_cycles") * 33.0).alias("cycle_score"))
    total = sum(F.col(k) * w for k, w in WEIGHTS.items())
    return j.select("project", F.round(total, 1).alias("total"), health_grade(total).alias("grade"),
                    *[F.round(k, 1).alias(k) for k in WEIGHTS])


def audit_checks(files: DataFrame, budget: DataFrame, cycle_counts: DataFrame, syntax: DataFrame,
                 doc_name: str = "CONTEXT.md") -> DataFrame:
    """Per project rows ``(check, status, detail)`` and ``passed``.

    ``doc_name`` is the project's context document checked for presence and
    freshness (pass the file name your projects use).

    The doc freshness and token checks run only when the doc exists;
    freshness compares it with the newest ``.py`` outside virtual-env and
    cache folders (minutes stale, floored).  ``cycle_counts`` are G4 rows:
    every simple cycle counts.
    """
    doc = files.where(F.col("path") == doc_name).groupBy("project").agg(F.max("mtime").alias("doc_mtime"))
    py = files.where(F.col("path").endswith(".py") & ~F.arrays_overlap(
        F.split("path", "/"), F.array(F.lit("venv"), F.lit(".venv"), F.lit("__pycache__"))))
    newest = py.groupBy("project").agg(F.max("mtime").alias("newest_py"))
    projects = files.select("project").distinct()
    j = (projects.join(doc, "project", "left").join(newest, "project", "left").join(budget, "project", "left")
         .join(cycle_counts, "project", "left").join(syntax, "project", "left")
         .fillna({"n_cycles": 0, "n_errors": 0}))
    has_doc = F.col("doc_mtime").isNotNull()
    stale_min = F.floor((F.unix_micros("newest_py") - F.unix_micros("doc_mtime")) / 60_000_000)
    pct = F.format_number(F.when(F.col("baseline") > 0, (F.col("baseline") - F.col("optimized")) / F.col("baseline") * 100.0)
                          .otherwise(F.lit(0.0)), 1)
    rows = F.array(
        F.struct(F.lit("config_doc").alias("check"), F.when(has_doc, "ok").otherwise("issue").alias("status"),
                 F.when(has_doc, "present").otherwise("missing").alias("detail")),
        F.when(has_doc, F.struct(
            F.lit("freshness").alias("check"),
            F.when(F.col("newest_py") > F.col("doc_mtime"), "issue").otherwise("ok").alias("status"),
            F.when(F.col("newest_py") > F.col("doc_mtime"),
                   F.concat(F.lit("stale by "), stale_min.cast("string"), F.lit(" minutes"))).otherwise("fresh").alias("detail"))),
        F.when(has_doc, F.struct(
            F.lit("token_budget").alias("check"),
            F.when(F.col("optimized") > 100_000, "issue").when(F.col("optimized") > 60_000, "issue").otherwise("ok").alias("status"),
            F.concat(F.when(F.col("optimized") > 100_000, "too large: ").when(F.col("optimized") > 60_000, "large: ")
                     .otherwise(""), pct, F.lit("% saved ("), F.col("baseline").cast("string"), F.lit(" -> "),
                     F.col("optimized").cast("string"), F.lit(")")).alias("detail"))),
        F.struct(F.lit("cycles").alias("check"), F.when(F.col("n_cycles") > 0, "issue").otherwise("ok").alias("status"),
                 F.concat(F.col("n_cycles").cast("string"), F.lit(" cycles")).alias("detail")),
        F.struct(F.lit("syntax").alias("check"), F.when(F.col("n_errors") > 0, "issue").otherwise("ok").alias("status"),
                 F.when(F.col("n_errors") > 0, F.concat(F.col("n_errors").cast("string"), F.lit(" files: "),
                                                        F.col("first_files"), F.col("more")))
                 .otherwise(F.lit("0 files")).alias("detail")),
    )
    out = j.select("project", F.explode(F.array_compact(rows)).alias("r")).select("project", "r.*")
    passed = out.groupBy("project").agg(F.bool_and(F.col("status") == "ok").alias("passed"))
    return out.join(passed, "project")

"""Ignore-rule files (S2) and appending new rules."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.text import pystrip


def load_ignore_rules(rule_files: DataFrame) -> DataFrame:
    """``(project, content)`` rule files -> ``(project, ord, pattern)``.

    Lines are stripped; blank lines and lines starting with '#' are dropped.
    ``ord`` is the 1-based line number in the file.
    """
    lines = rule_files.select(
        "project",
        F.posexplode(F.split(F.col("content"), r"\r\n|\r|\n")).alias("pos", "line"),
    )
    pat = pystrip(F.col("line"))
    return (lines.select("project", (F.col("pos") + 1).cast("int").alias("ord"), pat.alias("pattern"))
            .where((F.col("pattern") != "") & ~F.col("pattern").startswith("#")))


def append_rules(rules: DataFrame, new_patterns: DataFrame) -> DataFrame:
    """Rows to append — new ``(project, pattern)`` not already present, in
    the order of their ``rank`` (the suggestion order) if they have one.

    The result carries ``ord`` after the last existing line so that a plain
    ``unionByName`` (or an append write) yields the updated rule table.  The
    number of rows is the "patterns added" count.
    """
    order = F.min("rank") if "rank" in new_patterns.columns else F.lit(0)
    fresh = new_patterns.groupBy("project", "pattern").agg(order.alias("rank")).join(
        rules.select("project", "pattern"), ["project", "pattern"], "left_anti")
    last = rules.groupBy("project").agg(F.max("ord").alias("last_ord"))
    from pyspark.sql import Window
    w = Window.partitionBy("project").orderBy("rank", "pattern")
    return (fresh.join(last, "project", "left")
            .select("project",
                    (F.coalesce(F.col("last_ord"), F.lit(0)) + F.row_number().over(w)).cast("int").alias("ord"),
                    "pattern"))

"""Change history: S4 read_change_log, W3 last_n_commits, F8 non_root_commits,
A7 hot_files, J7 file_overview."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.operators.graph import top_n_per_project


def newest_commits(commits: DataFrame, n: int, *newest_first) -> DataFrame:
    """W3 on a commit table (one row per commit): the ``n`` newest per project,
    with ``commit_seq`` (1 = newest).  Runs before the files are joined, and
    Spark limits each project's rows before the shuffle."""
    w = Window.partitionBy("project").orderBy(*newest_first)
    return commits.withColumn("commit_seq", F.row_number().over(w).cast("long")).where(F.col("commit_seq") <= n)


def last_n_commits(changes: DataFrame, n: int) -> DataFrame:
    """Changes of the ``n`` newest commits per project (``commit_seq`` 1 =
    newest, given by ``newest_commits`` or by the change log itself)."""
    return changes.where(F.col("commit_seq") <= n)


def non_root_commits(changes: DataFrame) -> DataFrame:
    """F8: applied after W3, so root commits still use up one of the N."""
    return changes.where("has_parent")


def read_change_log(changes: DataFrame) -> DataFrame:
    """One row per touched ``.py`` path: the old name, and the new name
    when it differs (renames count twice)."""
    a = F.when(F.col("a_path").endswith(".py"), F.col("a_path"))
    b = F.when((F.col("b_path") != F.col("a_path")) & F.col("b_path").endswith(".py"), F.col("b_path"))
    return (changes.select("project", "commit_id", F.explode(F.array(a, b)).alias("path"))
            .where(F.col("path").isNotNull()))


def hot_files(changes: DataFrame, n_commits: int = 50, top: int = 20) -> DataFrame:
    """Change counts per path over the last ``n_commits``; top ``top``."""
    touched = read_change_log(non_root_commits(last_n_commits(changes, n_commits)))
    counts = touched.groupBy("project", "path").agg(F.count(F.lit(1)).cast("long").alias("changes"))
    return top_n_per_project(counts, "changes", top)


def file_overview(facts: DataFrame, in_deg: DataFrame, hot: DataFrame) -> DataFrame:
    """Per file lines, functions, classes, imports, imported-by and hot flag."""
    h = hot.select("project", "path", F.lit(True).alias("hot"))
    return (facts.join(in_deg, ["project", "path"], "left").join(h, ["project", "path"], "left")
            .select("project", "path", F.col("lines").cast("long"),
                    F.size("functions").cast("long").alias("functions"), F.size("classes").cast("long").alias("classes"),
                    F.size("imports").cast("long").alias("imports"),
                    F.coalesce("imported_by", F.lit(0)).cast("long").alias("imported_by"),
                    F.coalesce("hot", F.lit(False)).alias("hot")))

"""Incremental re-analysis against a fact store keyed by file signature."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.paths import file_sig
from tokenloom.operators.extract import FACT_COLUMNS, extract_all_facts
from tokenloom.session import small_side


def with_sig(files: DataFrame) -> DataFrame:
    return files.withColumn("sig", file_sig("mtime", "size_bytes"))


def changed_files(files: DataFrame, store: DataFrame, languages=("python", "typescript", "go")) -> DataFrame:
    """Facts for the current ``files``: rows whose ``(project, path, sig)`` is in
    ``store`` are reused; the others are extracted again.  Files that vanished
    are simply not emitted.  Output: FACT_COLUMNS + ``sig`` + ``reused``.

    The keys are settled first, without texts; then one scan reads the texts of
    the files that need it, and the facts get the signature of their row.  The
    keys are broadcast to that scan if their measured size allows it."""
    keys = ["project", "path", "sig"]
    current = with_sig(files.select("project", "path", "mtime", "size_bytes")).select(*keys)
    fresh = small_side(current.join(store.select(*keys), keys, "left_anti"))
    redo = extract_all_facts(files.join(fresh, ["project", "path"], "left_semi"), languages).join(fresh, ["project", "path"])
    reused = store.join(current, keys, "left_semi")
    return (redo.withColumn("reused", F.lit(False))
            .unionByName(reused.select(*FACT_COLUMNS, "sig").withColumn("reused", F.lit(True))))


def invalidate(store: DataFrame, keys: DataFrame) -> DataFrame:
    """Drop store entries for the given ``(project, path)`` keys."""
    return store.join(keys.select("project", "path"), ["project", "path"], "left_anti")

"""Exact duplicate removal with a heavy-hitter split (native).

1. Each row becomes a slim row (id, SHA-256, byte length); texts never shuffle.
2. ``approx_top_k`` -- a mergeable Misra-Gries style frequent-items summary of
   fixed size -- names the digests that may be frequent.
3. Those candidates are verified: one exact, partially aggregated pass gives
   their true group sizes and winners.  The verified winners (at most
   ``candidates`` rows) are broadcast, so frequent groups are decided map-side
   and never meet in one task.
4. The remaining digests, each infrequent by the summary's guarantee, take an
   ordinary shuffle on the digest.

Edge cases: a null text counts as empty; equal texts are equal byte for byte
(SHA-256 and byte length).  A null id sorts below every id.  Rows repeating an
(id, text) pair are one document and give one row; ``group_size`` counts input
rows.  An empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import Scratch, small, text_or_empty

DECISIONS = "doc_id, keep_id, group_size, kept, text_sha256"


def _digest(text_col: str):
    return F.sha2(text_or_empty(text_col).cast("binary"), 256), F.octet_length(text_or_empty(text_col)).cast("long")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     candidates: int = 1024, tracked: int = 8192) -> DataFrame:
    """One row per (id, text): doc_id, keep_id (largest id of the group),
    group_size, kept, text_sha256, n_rows (input rows merged into this one)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    sha, size = _digest(text_col)
    rows = scratch.keep(docs.select(F.col(id_col).alias("doc_id"), sha.alias("text_sha256"), size.alias("n_bytes"))
                        .groupBy("doc_id", "text_sha256", "n_bytes").agg(F.count(F.lit(1)).alias("n_rows")))
    key = ["text_sha256", "n_bytes"]

    summary = rows.agg(F.expr(f"approx_top_k(text_sha256, {candidates}, {tracked})").alias("top"))
    frequent = (summary.select(F.explode("top").alias("t")).select(F.col("t.item").alias("text_sha256"))
                .filter("text_sha256 is not null"))
    frequent = scratch.keep(frequent)  # at most `candidates` rows
    # verified: true sizes, and only groups that really repeat
    winners = scratch.keep(rows.join(F.broadcast(frequent), "text_sha256", "left_semi")
                           .groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.sum("n_rows").alias("group_size"))
                           .filter("group_size > 1"))

    marked = rows.join(F.broadcast(winners.withColumnRenamed("keep_id", "_k").withColumnRenamed("group_size", "_g")),
                       key, "left")
    heavy = (marked.filter("_g is not null")
             .select("doc_id", F.col("_k").alias("keep_id"), F.col("_g").alias("group_size"), *key, "n_rows"))
    group = Window.partitionBy(*key)
    light = (marked.filter("_g is null").select("doc_id", *key, "n_rows")
             .withColumn("keep_id", F.max("doc_id").over(group))
             .withColumn("group_size", F.sum("n_rows").over(group)))
    cols = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            "text_sha256", "n_bytes", "n_rows"]
    return heavy.select(*cols).unionByName(light.select(*cols))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay: of equal texts the row with the largest id, all
    columns unchanged.  Of rows repeating an (id, text) pair one stays."""
    scratch = Scratch(docs.sparkSession, "exact-drop")
    decided = scratch.keep(duplicate_groups(docs, id_col, text_col)
                           .filter("not kept or n_rows > 1")
                           .select(F.col("doc_id").alias("_tl_id"), F.col("text_sha256").alias("_tl_sha"),
                                   F.col("n_bytes").alias("_tl_n"), "kept"))
    sha, size = _digest(text_col)
    keyed = docs.withColumns({"_tl_s": sha, "_tl_b": size})
    same = F.col(id_col).eqNullSafe(F.col("_tl_id")) & (F.col("_tl_s") == F.col("_tl_sha")) & (F.col("_tl_b") == F.col("_tl_n"))
    left = keyed.join(small(decided.filter("not kept")), same, "left_anti")
    repeated = decided.filter("kept")
    if not repeated.isEmpty():
        repeated = small(repeated)
        once = left.join(repeated, same, "left_semi").dropDuplicates([id_col, "_tl_s", "_tl_b"])
        left = left.join(repeated, same, "left_anti").unionByName(once)
    return left.select(*docs.columns)

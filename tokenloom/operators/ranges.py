"""Diff text and changed line ranges: S5 read_unified_diff, C8 hunk_range,
W4 merge_ranges."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.session import materialize

# Unified-diff header patterns.
HUNK_RE = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
FILE_HEADER_RE = r"^diff --git a/(.+?) b/(.+)$"


def hunk_range(line: Column) -> Column:
    """``@@ -a,b +c,d @@`` -> struct(start=c, end=c + max(d or 1, 1) - 1);
    null when the line is not a hunk header."""
    start = F.regexp_extract(line, HUNK_RE, 3).try_cast("bigint")
    raw_len = F.regexp_extract(line, HUNK_RE, 4)
    length = F.when(raw_len == "", F.lit(1).cast("bigint")).otherwise(raw_len.try_cast("bigint"))
    return F.when(line.rlike(HUNK_RE),
                  F.struct(start.alias("start_line"), (start + F.greatest(length, F.lit(1)) - 1).alias("end_line")))


def read_unified_diff(diffs: DataFrame, suffix: str | None = ".py", chunk_lines: int = 4096) -> DataFrame:
    """``(project, diff_id, line_no, line)`` -> hunk ranges per file.

    The file of a hunk is the last header above it; a file whose header
    repeats keeps only its last block that has a valid hunk.  Only paths
    ending with ``suffix`` are kept (``None`` keeps all).

    Carrying the header down is a prefix scan.  It runs in two levels so that
    no task holds a whole diff: lines are cut into chunks of ``chunk_lines``;
    each chunk's last header and header count are carried over the (small)
    per-chunk rows, and combined with a window inside each chunk.
    """
    is_header = F.col("line").rlike(FILE_HEADER_RE)
    # of a diff only headers and hunk starts matter: every other line goes
    # before anything is shuffled, the rest is narrow and computed once
    t = materialize(diffs.where(F.col("line").startswith("@@") | is_header).select(
        "project", "diff_id", "line_no", F.when(is_header, F.regexp_extract("line", FILE_HEADER_RE, 2)).alias("hdr"),
        is_header.cast("int").alias("is_hdr"), hunk_range(F.col("line")).alias("r"),
        F.floor(F.col("line_no") / chunk_lines).cast("long").alias("chunk")))
    # per chunk: last header and number of headers; then carried over earlier chunks
    per_chunk = t.groupBy("project", "diff_id", "chunk").agg(
        F.max_by(F.col("hdr"), F.when(F.col("hdr").isNotNull(), F.col("line_no"))).alias("c_last"),
        F.sum("is_hdr").alias("c_count"))
    wc = Window.partitionBy("project", "diff_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_chunk.select("project", "diff_id", "chunk",
                             F.last("c_last", ignorenulls=True).over(wc).alias("carry_file"),
                             F.coalesce(F.sum("c_count").over(wc), F.lit(0)).alias("carry_count"))
    wl = Window.partitionBy("project", "diff_id", "chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    local = t.select("project", "diff_id", "chunk", "line_no", "r",
                     F.last("hdr", ignorenulls=True).over(wl).alias("l_file"),
                     F.sum("is_hdr").over(wl).alias("l_count"))
    t = local.join(carry, ["project", "diff_id", "chunk"]).select(
        "project", "diff_id", "line_no", "r", F.coalesce("l_file", "carry_file").alias("file"),
        (F.col("carry_count") + F.col("l_count")).alias("block"))
    hunks = t.where(F.col("r").isNotNull() & F.col("file").isNotNull())
    if suffix is not None:
        hunks = hunks.where(F.col("file").endswith(suffix))
    hunks = materialize(hunks)
    last_block = hunks.groupBy("project", "diff_id", "file").agg(F.max("block").alias("block"))
    return (hunks.join(last_block, ["project", "diff_id", "file", "block"], "left_semi")
            .select("project", "diff_id", F.col("file").alias("path"), "line_no", "r.start_line", "r.end_line"))


def merge_ranges(ranges: DataFrame, pad: int = 3, keys=("project", "path"), bucket_lines: int = 4096) -> DataFrame:
    """Pad both sides (start clamped to 1), sort, merge overlapping or
    adjacent ranges — gaps-and-islands with a running max of the ends.

    Two levels, so a file with very many ranges is not one task: rows are
    bucketed by start line; the max end of all earlier rows is the larger of
    the carried max end of earlier buckets and the running max inside the
    bucket, and island ids are carried counts plus running counts.  Islands
    spanning buckets are joined by the final grouped aggregate.
    """
    k = list(keys)
    p = ranges.select(*k, F.greatest(F.col("start_line") - pad, F.lit(1)).alias("s"),
                      (F.col("end_line") + pad).alias("e"))
    p = materialize(p.withColumn("bucket", F.floor(F.col("s") / bucket_lines).cast("long")))
    wb = Window.partitionBy(*k).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bmax = p.groupBy(*k, "bucket").agg(F.max("e").alias("b_max"))
    carry_end = bmax.select(*k, "bucket", F.max("b_max").over(wb).alias("carry_end"))
    w = Window.partitionBy(*k, "bucket").orderBy("s", "e")
    local_prev = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    q = p.join(carry_end, [*k, "bucket"])
    prev_end = F.greatest(F.coalesce(local_prev, F.lit(None)), F.col("carry_end"))
    flagged = materialize(q.withColumn("new", F.when(prev_end.isNull() | (F.col("s") > prev_end + 1), 1).otherwise(0)))
    bflags = flagged.groupBy(*k, "bucket").agg(F.sum("new").alias("b_new"))
    carry_cnt = bflags.select(*k, "bucket", F.coalesce(F.sum("b_new").over(wb), F.lit(0)).alias("carry_cnt"))
    islands = (flagged.join(carry_cnt, [*k, "bucket"])
               .withColumn("island", F.col("carry_cnt") + F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    return islands.groupBy(*k, "island").agg(F.min("s").cast("long").alias("start_line"),
                                             F.max("e").cast("long").alias("end_line")).drop("island")

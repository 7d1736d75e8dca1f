"""Session logs (S3): JSON lines of an assistant session.

Input rows ``(project, session_id, line_no, raw, file_mtime)`` — one per log
line, e.g. from ``spark.read.text`` with ``_metadata.file_path`` /
``_metadata.file_modification_time`` (see ``read_session_files``).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# usage is kept as a map so that "present but empty" can be told apart
EVENT_SCHEMA = "type string, uuid string, message struct<usage: map<string, string>>"

USAGE_KEYS = {
    "input_tokens": "input_tokens",
    "output_tokens": "output_tokens",
    "cache_write": "cache_creation_input_tokens",
    "cache_read": "cache_read_input_tokens",
}


def read_session_log(lines: DataFrame) -> DataFrame:
    """S3: parse every line; bad JSON becomes nulls (PERMISSIVE) and is not an
    assistant row.  Adds ``type``, ``uuid``, ``has_usage`` and the four counts."""
    ev = F.from_json(F.col("raw"), EVENT_SCHEMA)
    p = lines.withColumn("ev", ev)
    usage = F.col("ev.message.usage")
    cols = [F.coalesce(F.expr(f"try_cast(ev.message.usage['{src}'] AS BIGINT)"), F.lit(0)).alias(name)
            for name, src in USAGE_KEYS.items()]
    return p.select("project", "session_id", "line_no", "file_mtime",
                    F.col("ev.type").alias("type"), F.coalesce(F.col("ev.uuid"), F.lit("")).alias("uuid"),
                    (usage.isNotNull() & (F.size(usage) > 0)).alias("has_usage"), *cols)


def assistant_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("type") == "assistant")


def read_session_files(spark: SparkSession, path: str) -> DataFrame:
    """JSONL files below ``path`` (``<project>/<session>.jsonl``) as log lines.

    Line numbers follow the position inside each file: a line's place in its
    split (at most ``maxPartitionBytes``) plus the lines of the splits before, a
    prefix sum over one count per split, so no task holds a whole file.  The
    project is the parent folder name and the session id the file stem.
    """
    t = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("fp"),
        F.col("_metadata.file_block_start").alias("blk"),
        F.col("_metadata.file_modification_time").alias("file_mtime"),
        F.monotonically_increasing_id().alias("pos"))
    before = Window.partitionBy("fp").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    splits = t.groupBy("fp", "blk").agg(F.count(F.lit(1)).alias("n")).select(
        "fp", "blk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines_before"))
    t = t.withColumn("at", F.row_number().over(Window.partitionBy("fp", "blk").orderBy("pos"))).join(splits, ["fp", "blk"])
    parts = F.split("fp", "/")
    return t.select(
        F.element_at(parts, -2).alias("project"),
        F.regexp_replace(F.element_at(parts, -1), r"\.jsonl$", "").alias("session_id"),
        (F.col("at") + F.col("lines_before")).cast("int").alias("line_no"), F.trim("value").alias("raw"), "file_mtime")

"""Session usage and cost: W2, A8, C13, J8, J10, W9."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.scores import session_cost
from tokenloom.sources.sessions import USAGE_KEYS, assistant_rows, read_session_log

COUNTS = list(USAGE_KEYS)


def dedupe_first_by_uuid(assistant: DataFrame) -> DataFrame:
    """The first line (by ``line_no``) of each non-empty uuid wins — whether
    or not it carries usage; rows without uuid are all kept.  A grouped
    ``min_by`` (partial aggregation, no window over a whole session)."""
    keep = ["has_usage", *COUNTS]
    with_id = assistant.where(F.col("uuid") != "")
    first = (with_id.groupBy("project", "session_id", "uuid")
             .agg(F.min_by(F.struct("line_no", *keep), "line_no").alias("r"))
             .select("project", "session_id", "uuid", "r.*"))
    no_id = assistant.where(F.col("uuid") == "").select("project", "session_id", "uuid", "line_no", *keep)
    return first.unionByName(no_id)


def session_usage(lines: DataFrame) -> DataFrame:
    """Per session the four token sums, turns (rows with usage), total
    (input + output) and cost; every session of ``lines`` appears."""
    parsed = read_session_log(lines)
    kept = dedupe_first_by_uuid(assistant_rows(parsed)).where("has_usage")
    sums = kept.groupBy("project", "session_id").agg(
        *[F.sum(c).cast("long").alias(c) for c in COUNTS], F.count(F.lit(1)).cast("long").alias("turns"))
    sessions = lines.groupBy("project", "session_id").agg(F.max("file_mtime").alias("mtime"))
    j = sessions.join(sums, ["project", "session_id"], "left").fillna(0, [*COUNTS, "turns"])
    return j.select(
        "session_id", F.substring("session_id", 1, 8).alias("short_id"), "project", "mtime", *COUNTS,
        (F.col("input_tokens") + F.col("output_tokens")).cast("long").alias("total_tokens"), "turns",
        session_cost("input_tokens", "output_tokens", "cache_write", "cache_read").alias("cost_usd"))


def recent_sessions(usage: DataFrame, now: Column, hours: float = 24, limit: int = 10) -> DataFrame:
    """W9 (+F5): sessions modified strictly after ``now - hours``, newest first."""
    r = usage.where(F.col("mtime") > now - F.make_interval(secs=F.lit(float(hours) * 3600.0)))
    return r.orderBy(F.desc("mtime"), "session_id").limit(limit)


METRICS = ["input_tokens", "output_tokens", "cache_write", "cache_read", "total_tokens", "turns"]


def compare_sessions(usage: DataFrame, a_prefix: str, b_prefix: str) -> DataFrame:
    """Newest session whose id starts with each prefix, side by side per
    metric with ``diff = b - a`` (a pivot of the two rows; no join)."""
    def pick(prefix: str, side: str) -> DataFrame:
        # newest match by a global max_by (partial aggregation), not a window
        # over all matching sessions in one task; ties -> larger session id
        cols = [c for c in usage.columns]
        c = usage.where(F.col("session_id").startswith(prefix))
        best = c.agg(F.max_by(F.struct(*cols), F.struct("mtime", "session_id")).alias("r")).select("r.*")
        return best.where(F.col("session_id").isNotNull()).withColumn("side", F.lit(side))

    both = pick(a_prefix, "a").unionByName(pick(b_prefix, "b"))
    stack = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v"))
                                 for m in METRICS + ["cost_usd"]]))
    long = both.select("side", "session_id", stack.alias("m")).select("side", "session_id", "m.metric", "m.v")
    g = long.groupBy("metric").agg(
        F.max(F.when(F.col("side") == "a", F.col("session_id"))).alias("a_session"),
        F.max(F.when(F.col("side") == "b", F.col("session_id"))).alias("b_session"),
        F.max(F.when(F.col("side") == "a", F.col("v"))).alias("a"),
        F.max(F.when(F.col("side") == "b", F.col("v"))).alias("b"))
    return g.withColumn("diff", F.round(F.col("b") - F.col("a"), 5))


def session_delta(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Change of the four counts since the previous snapshot; all zero
    for a session the previous snapshot does not have."""
    prev = previous.select("project", "session_id", *[F.col(c).alias("p_" + c) for c in COUNTS], F.lit(True).alias("seen"))
    j = current.join(prev, ["project", "session_id"], "left")
    d = {c: F.when(F.col("seen"), F.col(c) - F.col("p_" + c)).otherwise(F.lit(0)).cast("long") for c in COUNTS}
    return j.select(*current.columns, d["input_tokens"].alias("delta_input"), d["output_tokens"].alias("delta_output"),
                    d["cache_write"].alias("delta_cache_w"), d["cache_read"].alias("delta_cache_r"),
                    F.when(F.col("seen"), session_cost(d["input_tokens"], d["output_tokens"], d["cache_write"],
                                                       d["cache_read"])).otherwise(F.lit(0.0)).alias("delta_cost"))

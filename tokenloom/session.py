"""Spark session helpers shared by tests, bench and the entry module."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "tokenloom",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session configured for the operators in this package.

    AQE stays on so that small sides (rules, label tables, per-project
    summaries) become broadcast joins only after their runtime size has been
    measured, and so that a project holding a large share of all rows is split
    by the skew-join handling.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    builder = SparkSession.builder
    # stage and task times without the UI: the event log, into a scratch folder
    event_dir = os.environ.get("TOKENLOOM_EVENT_LOG_DIR")
    if event_dir:
        os.makedirs(event_dir, exist_ok=True)
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_dir)
    spark = (
        builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting points at shared storage and is used as is.
    Only when it is unset (local tests) a scratch folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tokenloom-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint dir for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


class Tables:
    """Written tables of one iterative job below ``spark.checkpoint.dir``.

    Each round of an iteration is written and reread: the plan stays short, a
    lost executor costs one round at most, and the row counts a loop asks for
    come from the write itself (``observed``), not from a second job.  ``drop``
    deletes tables that a later round has replaced, ``close`` all of them.
    """

    def __init__(self, spark: SparkSession, name: str):
        import uuid
        self.spark = spark
        self.base = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
        self.made = 0

    def keep(self, df, **observed):
        """``df`` written and reread; with named aggregates also their values."""
        from pyspark.sql import Observation
        self.made += 1
        path = f"{self.base}/{self.made}"
        seen = Observation() if observed else None
        out = df.observe(seen, *[c.alias(n) for n, c in observed.items()]) if observed else df
        out.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._table_path = path
        return (back, seen.get) if observed else back

    def drop(self, *tables) -> None:
        for df in tables:
            path = getattr(df, "_table_path", None)
            if path:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def close(self) -> None:
        """Delete all tables, once nothing lazy reads them any more."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df):
    """Compute a (narrow) intermediate that several branches of a plan read,
    once: persisted in memory and disk and filled eagerly.  Lost blocks are
    recomputed from lineage; iterative jobs whose lineage must be cut use
    ``checkpoint()`` into ``spark.checkpoint.dir`` instead (see find_cycles)."""
    from pyspark import StorageLevel
    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    return out


# Broadcast limit for sides whose size is measured at run time (bytes).
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def measured_bytes(df) -> int:
    """Size of a materialised DataFrame as Spark's planner sees it (cached size)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_side(df, max_bytes: int = BROADCAST_MAX_BYTES):
    """Materialise ``df`` and hint it for broadcast only when its measured size
    is under ``max_bytes``; otherwise it is joined by shuffle (AQE may still
    split skewed partitions).  Returns the DataFrame to join with."""
    from pyspark.sql import functions as F
    m = materialize(df)
    return F.broadcast(m) if measured_bytes(m) <= max_bytes else m

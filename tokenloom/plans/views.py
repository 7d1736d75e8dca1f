"""Spark side of the proof views (same SQL text as the DuckDB oracle)."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.plans.views_sql import BASE_TABLES, VIEWS, _closure, render

#: Fixed size up to which a table is spread over the cores.
SPREAD_BYTES = 32 << 20


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Read a Parquet table.

    A table of one row group is one scan task, which would run all row-local
    work (tokenising, parsing) on one core.  Tables of at most ``SPREAD_BYTES``
    on storage are spread round-robin over the cores; the bound is fixed, so
    nothing larger is ever shuffled for this, however many cores there are.
    """
    df = spark.read.parquet(path)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(spark.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else df


def load_views(spark: SparkSession, sf_dir: str, names) -> dict[str, DataFrame]:
    """Build the named views (and dependencies) over the parquet tables in ``sf_dir``.

    Base tables are read with ``spark.read.parquet`` (column pruning and
    filters reach the scan); each view is one ``spark.sql`` statement over
    temp views (prefix ``tl_``).  Their names are new in every call and dropped
    before it returns: replacing a temp view would drop what a query has
    materialised from the one before.
    """
    order = _closure(names)
    needed_tables = {d for v in order for d in VIEWS[v][1] if d in BASE_TABLES}
    call, table_names = uuid.uuid4().hex, {}

    def name(df: DataFrame, of: str) -> None:
        table_names[of] = f"tl_{of}_{call}"
        df.createTempView(table_names[of])

    out: dict[str, DataFrame] = {}
    try:
        for t in needed_tables:
            name(read_table(spark, f"{sf_dir}/{t}.parquet"), t)
        for v in order:
            df = spark.sql(render(v, "spark", table_names))
            name(df, v)
            if "mtime_s" in df.columns:
                df = df.withColumn("mtime", F.timestamp_seconds("mtime_s"))
            out[v] = df
    finally:
        for made in table_names.values():
            spark.catalog.dropTempView(made)
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load_views(spark, sf_dir, [name])[name]

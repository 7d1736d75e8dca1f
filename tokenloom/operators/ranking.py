"""Total order of each project's rows without a task that holds a project."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.session import Tables


def ranked(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """Adds ``name``: 1, 2, ... within the project in the given order, which must
    be total.  Rows are written before they are range-partitioned by (project,
    order), since the ranges are sampled first and would compute them twice, and
    written again in that order; a row's rank is its place in its partition plus the project's rows in the
    partitions before, a prefix sum over one count per (project, partition)."""
    t = Tables(df.sparkSession, "ranked")
    computed = t.keep(df)
    rows = t.keep(computed.repartitionByRange("project", *order).withColumn("_part", F.spark_partition_id()))
    t.drop(computed)
    sizes = rows.groupBy("project", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("project").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("project", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("project", "_part").orderBy(*order))
    return (rows.withColumn("_at", place).join(sizes, ["project", "_part"])
            .withColumn(name, (F.col("_at") + F.col("_before")).cast("long")).drop("_part", "_at", "_before"))

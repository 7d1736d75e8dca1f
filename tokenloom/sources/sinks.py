"""Machine-readable outputs of any operator result."""
from __future__ import annotations

from pyspark.sql import DataFrame

from tokenloom.session import Tables


def write_table(df: DataFrame, path: str, partition_by=("project",), mode: str = "overwrite") -> None:
    """Parquet, partitioned by project so later jobs prune to the projects they need."""
    cols = [c for c in partition_by if c in df.columns]
    w = df.write.mode(mode)
    if cols:
        w = w.partitionBy(*cols)
    w.parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines (nested structs and arrays kept)."""
    df.write.mode(mode).json(path)


def write_lines(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A document's lines in order: range-partitioned and sorted Parquet, the
    files of a project one after the other."""
    order = ["project", "section", "sort_key", "pos"]
    t = Tables(lines.sparkSession, "lines")  # computed once: ranges are sampled before they are filled
    t.keep(lines).repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).parquet(path)
    t.close()

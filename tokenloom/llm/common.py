"""Helpers shared by the operators of this package."""
from __future__ import annotations

import sys
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.session import ensure_checkpoint_dir

#: Rows up to which a small side may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


class Scratch:
    """Written tables of one operator call below ``spark.checkpoint.dir``.

    A written table cuts lineage and survives lost executors.  ``keep`` writes
    and rereads a DataFrame; ``drop`` deletes one that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.base}/{self.made}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint ``df`` (a written, cheap to count table) for broadcast if it has at
    most ``max_rows`` rows; otherwise the join it enters is a shuffle join."""
    return F.broadcast(df) if df.count() <= max_rows else df


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def held_out(id_col: Column) -> Column:
    """True where crc32 of the id as text leaves remainder 2 modulo 4."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def process_store() -> dict:
    """A dictionary that lives as long as the (reused) Python worker process."""
    name = "tokenloom_process_store"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def by_value(module_name: str) -> None:
    """Ship a module's functions inside the UDFs that use them, so that
    executors need no installed copy of the package."""
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


by_value(__name__)

"""A log-structured fact store.

A commit appends one folder of rows below ``data`` and then creates an empty
file below ``commits`` whose name carries the commit number, the folder and,
after a compaction, up to which commit it replaces the others.  Creating that
file is the commit: a folder without one is never read, so a batch that was
killed leaves nothing behind and may run again, and a commit number that exists
is not applied twice.

Rows are of four kinds: ``facts`` of a file version, ``seen`` (a file of the
snapshot whose facts are stored already), ``gone`` (a tombstone) and ``marker``
(the snapshot exists).  Reading merges: a project shows the files of its newest
snapshot; of several rows of a file in it the one of the latest commit counts,
and its facts are those stored last for the same signature.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.session import Tables

FACTS = ("language string, lines long, functions array<string>, classes array<string>, imports array<string>, "
         "complexity long, typed_functions long, has_syntax_error boolean")
ROW_SCHEMA = f"project string, path string, {FACTS}, sig string, snapshot_id long, kind string, commit long"
FACT_NAMES = [c.split()[0] for c in FACTS.split(", ")]


class FactStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._Path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def commits(self) -> list[tuple[int, str]]:
        """(number, folder) of the commits that count, in order."""
        folder = self._Path(f"{self.path}/commits")
        if not self.fs.exists(folder):
            return []
        found = [f.getPath().getName().split("_") for f in self.fs.listStatus(folder)]
        named = sorted((int(number), data, int(upto)) for number, data, upto in (n for n in found if len(n) == 3))
        replaced = max((upto for _, _, upto in named), default=-1)
        return [(number, data) for number, data, upto in named if upto == replaced or number > replaced]

    def last_commit(self) -> int:
        return max((number for number, _ in self.commits()), default=-1)

    def append(self, rows: DataFrame, commit: int) -> bool:
        """Write and commit rows (project, path, facts, sig, snapshot_id, kind);
        False if that commit is there already."""
        if commit <= self.last_commit():
            return False
        self._commit(rows.withColumn("commit", F.lit(commit).cast("long")), commit, -1)
        return True

    def _commit(self, rows: DataFrame, commit: int, upto: int) -> None:
        data = uuid.uuid4().hex
        typed = self.spark.createDataFrame([], ROW_SCHEMA).unionByName(rows, allowMissingColumns=True)
        # computed once: ranges are sampled before they are filled
        t = Tables(self.spark, "commit")
        t.keep(typed).repartitionByRange("project", "path").sortWithinPartitions("project", "path").write.parquet(f"{self.path}/data/{data}")
        t.close()
        self.fs.create(self._Path(f"{self.path}/commits/{commit}_{data}_{upto}"), False).close()

    def rows(self) -> DataFrame:
        """All committed rows."""
        folders = [f"{self.path}/data/{data}" for _, data in self.commits()]
        reader = self.spark.read.schema(ROW_SCHEMA)
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], ROW_SCHEMA)

    @staticmethod
    def current(rows: DataFrame) -> DataFrame:
        """(project, current): the newest snapshot of each project."""
        return rows.groupBy("project").agg(F.max("snapshot_id").alias("current"))

    @staticmethod
    def visible(rows: DataFrame) -> DataFrame:
        """(project, path, sig, snapshot_id) of the files of each project's newest
        snapshot: partial aggregates by file, no window."""
        newest = FactStore.current(rows).select("project", F.col("current").alias("snapshot_id"))
        latest = (rows.where("kind <> 'marker'").join(newest, ["project", "snapshot_id"], "left_semi")
                  .groupBy("project", "path", "snapshot_id").agg(
                      F.max_by(F.struct("sig", "kind"), F.struct("commit", F.col("kind") == "gone")).alias("r")))
        return latest.where("r.kind <> 'gone'").select("project", "path", "r.sig", "snapshot_id")

    @staticmethod
    def known(rows: DataFrame) -> DataFrame:
        """The stored facts by (project, path, sig)."""
        facts = rows.where("kind = 'facts'").groupBy("project", "path", "sig").agg(F.max_by(F.struct(*FACT_NAMES), "commit").alias("f"))
        return facts.select("project", "path", "sig", "f.*")

    def read(self) -> DataFrame:
        """The facts of every project's newest snapshot."""
        rows = self.rows()
        return self.visible(rows).join(self.known(rows), ["project", "path", "sig"]).select("project", "path", *FACT_NAMES, "sig", "snapshot_id")

    def compact(self) -> None:
        """One commit in place of all so far: the visible facts and the markers."""
        upto = self.last_commit()
        if upto < 0:
            return
        rows = self.rows()
        marks = self.current(rows).select("project", F.lit("").alias("path"), F.col("current").alias("snapshot_id"), F.lit("marker").alias("kind"))
        merged = self.read().withColumn("kind", F.lit("facts")).unionByName(marks, allowMissingColumns=True)
        old = [data for _, data in self.commits()]
        self._commit(merged.withColumn("commit", F.lit(upto).cast("long")), upto, upto)
        for data in old:  # no longer named by a commit that counts
            self.fs.delete(self._Path(f"{self.path}/data/{data}"), True)

"""Streaming re-analysis into a log-structured fact store.

Rows carry a ``snapshot_id`` per project (rows of streams without the column
form one snapshot per batch).  Rows of a newer snapshot replace the project's
files, rows of the same snapshot add to them, so a snapshot may arrive in any
number of batches; rows of an older one are ignored.  A row without a path says
that the snapshot exists even if it has no files (an emptied project); a row
with ``deleted`` set takes its file out of the snapshot.

A batch appends what it changes and nothing else: the facts of files whose
signature is new, one narrow row for a file that a newer snapshot repeats, a
tombstone for a deleted one.  Files are compared by key and signature before any
text is read (J9).  The batch number is the commit number, so a batch that ran
before, wholly or not, gives the same store when it runs again.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators.extract import FACT_COLUMNS, extract_all_facts
from tokenloom.operators.incremental import with_sig
from tokenloom.session import materialize, small_side
from tokenloom.streaming.store import FACTS, FactStore

STORE_SCHEMA = f"project string, path string, {FACTS}, sig string, snapshot_id long"
MARKER = ""


def read_store(spark: SparkSession, store_path: str) -> DataFrame:
    """The facts of every project's latest snapshot."""
    return FactStore(spark, store_path).read()


def reanalyze_batch(batch: DataFrame, store_path: str, batch_id: int | None = None) -> bool:
    """Commit what a batch changes; False if the batch was committed before.
    Without a number the batch is the next one.  Of rows that repeat a file the
    one modified last counts, and a deletion beside the file itself wins."""
    spark = batch.sparkSession
    store = FactStore(spark, store_path)
    last = store.last_commit()
    if batch_id is None:
        batch_id = last + 1
    if batch_id <= last:
        return False
    if "snapshot_id" not in batch.columns:
        batch = batch.withColumn("snapshot_id", F.lit(batch_id).cast("long"))
    if "deleted" not in batch.columns:
        batch = batch.withColumn("deleted", F.lit(False))
    # one row per project of the batch
    held = materialize(batch.groupBy("project").agg(F.max("snapshot_id").alias("b")))
    stored = store.rows().join(held.select("project"), "project", "left_semi")
    newest = held.join(FactStore.current(stored), "project", "left").select(
        "project", F.greatest("b", "current").alias("snapshot_id"), F.coalesce("current", F.lit(-1)).alias("before"))
    newest = small_side(newest)
    current = batch.join(newest.select("project", "snapshot_id"), ["project", "snapshot_id"], "left_semi")
    files = current.where(F.col("path").isNotNull() & (F.col("path") != MARKER))
    # keys first: what is new, what is known, what is shown already
    files = with_sig(files)
    keys = (files.where(~F.coalesce("deleted", F.lit(False))).select("project", "path", "mtime", "sig", "snapshot_id")
            .groupBy("project", "path", "snapshot_id").agg(F.max_by("sig", F.struct("mtime", "sig")).alias("sig")))
    known = FactStore.known(stored).select("project", "path", "sig", F.lit(True).alias("known"))
    shown = FactStore.visible(stored).withColumn("shown", F.lit(True))
    keys = materialize(keys.join(known, ["project", "path", "sig"], "left").join(shown, ["project", "path", "sig", "snapshot_id"], "left"))
    fresh = small_side(keys.where("known is null").select("project", "path", "sig", "snapshot_id"))
    facts = (extract_all_facts(files.join(fresh, ["project", "path", "sig"], "left_semi").dropDuplicates(["project", "path"]))
             .select(*FACT_COLUMNS).join(fresh, ["project", "path"]).withColumn("kind", F.lit("facts")))
    seen = keys.where("known and shown is null").select("project", "path", "sig", "snapshot_id", F.lit("seen").alias("kind"))
    gone = files.where("deleted").select("project", "path", "snapshot_id", F.lit("gone").alias("kind")).distinct()
    marks = newest.where("snapshot_id > before").select("project", F.lit(MARKER).alias("path"), "snapshot_id", F.lit("marker").alias("kind"))
    out = facts.unionByName(seen, allowMissingColumns=True).unionByName(gone, allowMissingColumns=True).unionByName(
        marks, allowMissingColumns=True)
    done = store.append(out, batch_id)
    for df in (held, keys):
        df.unpersist()
    return done


def stream_reanalyze(files_stream: DataFrame, store_path: str, checkpoint_location: str, trigger=None):
    """Start the T3 query; returns the StreamingQuery."""
    w = (files_stream.writeStream.foreachBatch(lambda df, i: reanalyze_batch(df, store_path, i) and None)
         .option("checkpointLocation", checkpoint_location))
    if trigger is not None:
        w = w.trigger(**trigger)
    return w.start()

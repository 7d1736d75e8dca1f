"""S2/S6 rule files and J9 fact-store helpers."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F


def test_rules_parse_and_append(spark):
    from tokenloom.sources.rules import append_rules, load_ignore_rules
    files = spark.createDataFrame([("p", "# c\n*.log\n\n  build/  \n"), ("q", "# only comments\n")],
                                  "project string, content string")
    rules = load_ignore_rules(files)
    assert sorted((r.project, r.ord, r.pattern) for r in rules.collect()) == [("p", 2, "*.log"), ("p", 4, "build/")]
    new = spark.createDataFrame([("p", "*.log"), ("p", "docs/"), ("p", "docs/"), ("q", "vendor/")],
                                "project string, pattern string")
    added = sorted((r.project, r.ord, r.pattern) for r in append_rules(rules, new).collect())
    # existing patterns are not repeated; numbering continues after the last line
    assert added == [("p", 5, "docs/"), ("q", 1, "vendor/")]


def test_changed_files_and_invalidate(spark):
    from tokenloom.operators.incremental import changed_files, invalidate, with_sig
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    files = spark.createDataFrame([("p", "a.py", "def f():\n    pass\n", 18, t0), ("p", "b.go", "package b\n", 10, t0)],
                                  "project string, path string, content string, size_bytes long, mtime timestamp")
    from tokenloom.streaming.reanalyze import STORE_SCHEMA
    first = changed_files(files, spark.createDataFrame([], STORE_SCHEMA))
    assert sorted((r.path, r.reused) for r in first.collect()) == [("a.py", False), ("b.go", False)]
    store = first.drop("reused")
    edited = files.withColumn("mtime", F.when(F.col("path") == "a.py", F.col("mtime") + F.expr("INTERVAL 1 SECOND"))
                              .otherwise(F.col("mtime")))
    second = {r.path: r for r in changed_files(edited, store).collect()}
    assert (second["a.py"].reused, second["b.go"].reused) == (False, True)
    assert second["a.py"].functions == ["f"]
    sig = with_sig(files).where("path = 'b.go'").first().sig
    assert sig == f"{int(t0.timestamp()) * 1_000_000_000}:10"
    left = invalidate(store, spark.createDataFrame([("p", "a.py")], "project string, path string"))
    assert [r.path for r in left.collect()] == ["b.go"]


def test_store_follows_split_and_emptied_snapshots(spark, tmp_path):
    """A snapshot in two batches keeps all its facts, a newer one replaces
    them, an emptied project leaves none, late rows of an old one change nothing."""
    from tokenloom.streaming.reanalyze import read_store, reanalyze_batch
    store = str(tmp_path / "store")
    schema = "project string, path string, content string, size_bytes long, mtime timestamp, snapshot_id long"
    at = __import__("datetime").datetime(2024, 1, 1)

    def feed(*rows):
        reanalyze_batch(spark.createDataFrame([(p, f, c, len(c or ""), at, s) for p, f, c, s in rows], schema), store)
        return sorted((r.project, r.path, r.functions[0] if r.functions else "") for r in read_store(spark, store).collect())

    a, b = "def a():\n    pass\n", "def bb():\n    pass\n"
    assert feed(("p", "a.py", a, 1), ("q", "q.py", a, 1)) == [("p", "a.py", "a"), ("q", "q.py", "a")]
    assert feed(("p", "b.py", b, 1)) == [("p", "a.py", "a"), ("p", "b.py", "bb"), ("q", "q.py", "a")]
    assert feed(("p", "b.py", b, 2)) == [("p", "b.py", "bb"), ("q", "q.py", "a")]
    assert feed(("p", "a.py", a, 1)) == [("p", "b.py", "bb"), ("q", "q.py", "a")]
    assert feed(("q", None, None, 2)) == [("p", "b.py", "bb")]


def test_new_rules_keep_the_suggestion_order(spark):
    from tokenloom.sources.rules import append_rules
    rules = spark.createDataFrame([("p", 3, "old")], "project string, ord int, pattern string")
    new = spark.createDataFrame([("p", "zz", 1), ("p", "aa", 2), ("p", "old", 3)], "project string, pattern string, rank long")
    assert [(r.ord, r.pattern) for r in append_rules(rules, new).orderBy("ord").collect()] == [(4, "zz"), (5, "aa")]


FILES = "project string, path string, content string, size_bytes long, mtime timestamp, snapshot_id long, deleted boolean"


def _files(spark, *rows):
    at = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(p, f, c, len(c or ""), at, s, gone) for p, f, c, s, gone in rows], FILES)


def _shown(spark, store):
    from tokenloom.streaming.reanalyze import read_store
    return sorted((r.project, r.path, tuple(r.functions)) for r in read_store(spark, store).collect())


def test_store_commits_only_what_changes(spark, tmp_path):
    """A changed file is one row, a repeated batch none, a folder without a
    commit is not read, a tombstone hides its file, compaction changes nothing."""
    from tokenloom.streaming.reanalyze import reanalyze_batch
    from tokenloom.streaming.store import FactStore
    store = str(tmp_path / "store")
    f = {n: f"def {n}():\n    pass\n" for n in ("a", "b", "changed", "later")}
    rows = [("p", f"{k}.py", f["a"], 1, False) for k in range(20)] + [("q", "q.py", f["b"], 1, False)]
    assert reanalyze_batch(_files(spark, *rows), store, 0)
    log = FactStore(spark, store)
    assert log.rows().count() == 21 + 2  # two markers
    assert reanalyze_batch(_files(spark, ("p", "3.py", f["changed"], 1, False)), store, 1)
    assert log.rows().count() == 23 + 1
    assert not reanalyze_batch(_files(spark, ("p", "3.py", f["later"], 1, False)), store, 1)
    before = _shown(spark, store)
    assert ("p", "3.py", ("changed",)) in before and len(before) == 21
    # a batch killed before its commit: rows are there, nothing reads them, the rerun commits
    killed = log.rows().limit(5).withColumn("snapshot_id", F.lit(9).cast("long"))
    killed.write.parquet(f"{store}/data/killed")
    assert _shown(spark, store) == before
    assert reanalyze_batch(_files(spark, ("p", "4.py", None, 1, True), ("q", "q.py", f["b"], 2, False)), store, 2)
    after = _shown(spark, store)
    assert len(after) == 20 and ("p", "4.py", ("a",)) not in after and ("q", "q.py", ("b",)) in after
    assert log.rows().where("commit = 2").groupBy("kind").count().collect().__len__() == 3  # gone, seen, marker
    log.compact()
    assert _shown(spark, store) == after and len(log.commits()) == 1 and log.last_commit() == 2
    assert reanalyze_batch(_files(spark, ("p", "4.py", f["later"], 1, False)), store, 3)
    assert len(_shown(spark, store)) == 21 and log.rows().where("commit = 3").count() == 1


def test_one_pass_extraction(spark):
    """U6 reads the texts once, whatever the languages."""
    from tokenloom.operators.extract import extract_all_facts, extract_go_facts, extract_python_facts, extract_ts_facts
    files = spark.createDataFrame([("p", "a.py", "import os\ndef f() -> int:\n    return 1\n"), ("p", "b.ts", "import x from 'react'\nfunction g() { if (1) {} }"),
                                   ("p", "c.go", "package c\nimport \"fmt\"\nfunc H() int { if true {} }"), ("p", "d.txt", "def n(): pass"),
                                   ("p", "build/e.py", "def no(): pass"), ("p", "g.py", None)], "project string, path string, content string")
    one = {r.path: r for r in extract_all_facts(files).collect()}
    apart = extract_python_facts(files).unionByName(extract_ts_facts(files)).unionByName(extract_go_facts(files))
    assert sorted(map(tuple, one.values()), key=str) == sorted(map(tuple, apart.collect()), key=str)
    assert set(one) == {"a.py", "b.ts", "c.go", "g.py"} and one["b.ts"].imports == ["react"] and one["c.go"].functions == ["H"]
    plan = extract_all_facts(files)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LocalTableScan") + plan.count("Scan ExistingRDD") == 1


def test_file_stream_feeds_the_store(spark, tmp_path):
    """S1 as a stream into T3: added and changed files arrive once, hidden names included."""
    import os

    from tokenloom.sources.files import stream_files
    from tokenloom.streaming.reanalyze import reanalyze_batch
    root, store, out = tmp_path / "trees", str(tmp_path / "store"), str(tmp_path / "out")
    for project in ("p", "q"):
        (root / project / "pkg").mkdir(parents=True)
    at = 1_700_000_000

    def put(path, text, age):
        (root / path).write_text(text)
        os.utime(root / path, (at + age, at + age))

    def run():
        def sink(df, batch_id):
            df.select("project", "path").withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(out)
            reanalyze_batch(df.withColumn("snapshot_id", F.lit(1).cast("long")), store, batch_id)
        q = (stream_files(spark, projects_root=str(root)).writeStream.foreachBatch(sink)
             .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
        q.awaitTermination()
        return sorted((r.project, r.path, r.batch) for r in spark.read.parquet(out).collect())

    put("p/pkg/__init__.py", "", 0)
    put("p/.hidden.py", "def h(): pass\n", 1)
    put("q/a.py", "def a(): pass\n", 2)
    first = run()
    assert [r[:2] for r in first] == [("p", ".hidden.py"), ("p", "pkg/__init__.py"), ("q", "a.py")]
    put("q/a.py", "def changed(): pass\n", 10)
    put("p/new.py", "def new(): pass\n", 11)
    second = [r for r in run() if r not in first]
    assert [r[:2] for r in second] == [("p", "new.py"), ("q", "a.py")]
    assert _shown(spark, store) == [("p", ".hidden.py", ("h",)), ("p", "new.py", ("new",)), ("p", "pkg/__init__.py", ()), ("q", "a.py", ("changed",))]
    assert len(run()) == 5


def test_file_stream_holds_no_list_of_files(tmp_path, monkeypatch):
    """a trigger lists the trees once and sends folders with shares, not files; each file is read once."""
    import os
    import pickle

    from tokenloom.sources import files as S

    def put(path, n, at):
        path.mkdir(parents=True, exist_ok=True)
        for k in range(n):
            (path / f"f{k}.py").write_text(str(k))
            os.utime(path / f"f{k}.py", (at, at))

    def trigger(reader, start):
        """(end offset, bytes of the partitions, sorted rows) and the folders that the driver listed."""
        listed = []
        with monkeypatch.context() as m:
            m.setattr(S, "entries", lambda files, folder, gone=False, f=S.entries: listed.append(folder) or f(files, folder, gone))
            end = reader.latestOffset()
            parts = reader.partitions(start, end)
        rows = [r[:2] for p in parts for r in reader.read(p)]
        return end, len(pickle.dumps([p.value for p in parts])), sorted(rows), listed

    sizes = []
    for n in (40, 400):
        root = tmp_path / str(n)
        for project in ("p", "q"):
            put(root / project / "one", n, 1_700_000_000)
            put(root / project / "two" / ".deep", 3, 1_700_000_000 + n)
        reader = S.ProjectFilesStream({"projects_root": str(root), "shards_per_root": "4"})
        end, size, rows, listed = trigger(reader, reader.initialOffset())
        sizes.append(size)
        want = [(p, f"one/f{k}.py") for p in "pq" for k in range(n)] + [(p, f"two/.deep/f{k}.py") for p in "pq" for k in range(3)]
        assert rows == sorted(want) and len(listed) == len(set(listed)) == 8
        # behind the last offset: the same time and a later name, and a later time
        put(root / "q" / "zzz", 1, 1_700_000_000 + n)
        put(root / "p" / "one", 2, 1_700_009_000)
        for r in (reader, S.ProjectFilesStream({"projects_root": str(root), "shards_per_root": "4"})):  # the second as after a restart
            assert trigger(r, end)[2] == [("p", "one/f0.py"), ("p", "one/f1.py"), ("q", "zzz/f0.py")]
        last = reader.latestOffset()
        assert reader.partitions(last, reader.latestOffset()) == []
    assert sizes[1] < 1.5 * sizes[0]

"""Session usage (S3, W2, A8) on the hand-made log of FIXTURES §5, and its stream replay."""
from __future__ import annotations

import json

from tokenloom.operators.sessions import session_usage


def _u(i, o, w, r):
    return {"input_tokens": i, "output_tokens": o, "cache_creation_input_tokens": w, "cache_read_input_tokens": r}


LOG = [
    {"type": "assistant", "uuid": "u1", "message": {"usage": _u(10, 5, 2, 1)}},
    {"type": "user", "uuid": "u2"},
    {"type": "assistant", "uuid": "u1", "message": {"usage": _u(99, 99, 99, 99)}},
    "not json {",
    {"type": "assistant", "message": {"usage": _u(1, 1, 0, 0)}},
    {"type": "assistant", "message": {"usage": _u(1, 1, 0, 0)}},
    {"type": "assistant", "uuid": "u3", "message": {}},
    {"type": "assistant", "uuid": "u3", "message": {"usage": _u(7, 7, 7, 7)}},
]


def log_df(spark):
    import datetime as dt
    rows = [("proj", "abcdef0123", i + 1, x if isinstance(x, str) else json.dumps(x), dt.datetime(2024, 1, 1))
            for i, x in enumerate(LOG)]
    return spark.createDataFrame(rows, "project string, session_id string, line_no int, raw string, file_mtime timestamp")


def test_session_usage_fixture(spark):
    r = session_usage(log_df(spark)).first()
    assert (r.turns, r.input_tokens, r.output_tokens, r.cache_write, r.cache_read, r.total_tokens) == (3, 12, 7, 2, 1, 19)
    assert r.cost_usd == 0.00015
    assert r.short_id == "abcdef01"


def test_stream_replay_matches_batch(spark, tmp_path):
    """The log arriving in two micro-batches gives the batch totals; T2
    reports the change made by the second arrival."""
    from pyspark.sql import functions as F

    from tokenloom.streaming.sessions import stream_session_usage
    lines = log_df(spark)
    lines.where("line_no <= 4").coalesce(1).write.parquet(str(tmp_path / "in" / "b=0"))
    lines.where("line_no > 4").coalesce(1).write.parquet(str(tmp_path / "in" / "b=1"))
    src = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "b=*"))
    out = str(tmp_path / "out")

    def sink(df, batch_id):
        df.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)

    q = (stream_session_usage(src).writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    rows = sorted(spark.read.parquet(out).collect(), key=lambda r: r.batch_id)
    assert [r.turns for r in rows] == [1, 3]
    last = rows[-1]
    assert (last.input_tokens, last.output_tokens, last.total_tokens, last.cost_usd) == (12, 7, 19, 0.00015)
    assert (last.delta_input, last.delta_output) == (2, 2)


def test_read_session_files(spark, tmp_path):
    """S3 from JSONL files: project = folder, session = file stem, line order kept."""
    from tokenloom.sources.sessions import read_session_files
    d = tmp_path / "logs" / "myproj"
    d.mkdir(parents=True)
    lines = [x if isinstance(x, str) else json.dumps(x) for x in LOG]
    (d / "abcdef0123.jsonl").write_text("\n".join(lines) + "\n")
    (d / "zzz.jsonl").write_text(json.dumps({"type": "assistant", "uuid": "q", "message": {"usage": _u(1, 2, 3, 4)}}) + "\n")
    df = read_session_files(spark, str(tmp_path / "logs" / "*" / "*.jsonl"))
    got = {r.session_id: r for r in session_usage(df).collect()}
    a = got["abcdef0123"]
    assert (a.project, a.turns, a.input_tokens, a.output_tokens, a.total_tokens) == ("myproj", 3, 12, 7, 19)
    assert (got["zzz"].turns, got["zzz"].cache_read) == (1, 4)


def test_sessions_of_two_projects_stay_apart(spark):
    """J10 and T1 key by (project, session): the same id and uuid in two projects."""
    from tokenloom.operators.sessions import session_delta
    lines = log_df(spark)
    both = lines.unionByName(lines.selectExpr("'other' as project", "session_id", "line_no", "raw", "file_mtime").where("line_no = 1"))
    usage = session_usage(both)
    before = session_usage(both.where("line_no = 1"))
    got = {r.project: r for r in session_delta(usage, before).collect()}
    assert {p: (r.input_tokens, r.delta_input) for p, r in got.items()} == {"proj": (12, 2), "other": (10, 0)}


def test_stream_step_ignores_row_order_and_batches(spark):
    """The first line of a uuid wins however rows, Arrow chunks and refreshes are cut."""
    import random

    import pandas as pd

    from tokenloom.streaming.sessions import COUNTS, KEPT, add_rows

    rnd = random.Random(3)
    rows = [("s", n, f"u{n % 4}" if n % 5 else "", n % 3 != 0, n, 2 * n, 1, 1) for n in range(30)]
    names = ["session_id", "line_no", "uuid", "has_usage", *COUNTS]
    pdf = pd.DataFrame(rows, columns=names).assign(project="p", type="assistant", file_mtime=pd.Timestamp("2024-01-01"))

    def run(chunks):
        seen, sums = {}, [0] * 5
        for refresh in chunks:
            for part in refresh:
                add_rows(part[KEPT].itertuples(index=False), sums, seen.get, seen.__setitem__)
        assert len(seen) <= 4
        return sums

    want = run([[pdf]])
    first = pdf[(pdf.uuid != "")].sort_values("line_no").drop_duplicates("uuid")
    used = pd.concat([first, pdf[pdf.uuid == ""]])
    used = used[used.has_usage]
    assert want == [int(used[c].sum()) for c in COUNTS] + [len(used)]
    for _ in range(20):
        order = list(range(30))
        rnd.shuffle(order)
        mixed = pdf.iloc[order]
        parts = [mixed.iloc[i:i + 4] for i in range(0, 30, 4)]
        assert run([parts]) == want and run([parts[:3], parts[3:5], parts[5:]]) == want


def test_stream_cost_rounds_like_the_batch(spark):
    from pyspark.sql import functions as F

    from tokenloom.functions.scores import session_cost
    from tokenloom.streaming.sessions import _cost
    rows = [(i, 3 * i + 1, 7 * i % 13, i % 5) for i in range(0, 4000, 7)]
    df = spark.createDataFrame(rows, "i long, o long, w long, r long").withColumn("c", session_cost("i", "o", "w", "r"))
    assert all(r.c == _cost(r.i, r.o, r.w, r.r) for r in df.collect())


def test_idle_sessions_leave_the_state(spark, tmp_path):
    """Two refreshes a day apart with 2 hours of idle time: the first session's
    state ends, a late row of it is dropped, and it starts from zero afterwards."""
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    from tokenloom.streaming.sessions import stream_session_usage
    t0 = datetime(2024, 1, 1)

    def rows(session, line_no, hours, n):
        raw = json.dumps({"type": "assistant", "uuid": f"{session}-{line_no}", "message": {"usage": _u(n, 0, 0, 0)}})
        return [("p", session, line_no, raw, t0 + timedelta(hours=hours))]

    schema = "project string, session_id string, line_no int, raw string, file_mtime timestamp"
    out, last = str(tmp_path / "out"), []

    def sink(df, batch_id):
        df.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)

    arrivals = [rows("a", 0, 0, 5), rows("a", 1, 1, 7) + rows("b", 0, 24, 1), rows("b", 1, 25, 2), rows("a", 2, 2, 100), rows("a", 3, 26, 9)]
    for k, arrival in enumerate(arrivals):
        spark.createDataFrame(arrival, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = (stream_session_usage(src, idle_hours=2).writeStream.outputMode("update").foreachBatch(sink)
             .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
        q.awaitTermination()
        state = q.lastProgress["stateOperators"][0] if q.lastProgress else {}
        last.append(state.get("customMetrics", {}))
    got = spark.read.parquet(out).orderBy("batch_id").collect()
    a = [(r.input_tokens, r.turns) for r in got if r.session_id == "a"]
    assert a[0] == (5, 1) and a[1] == (12, 2)
    assert a[-1] == (9, 1) and 112 not in [n for n, _ in a]  # the late row is dropped, the session starts from zero
    assert [r.input_tokens for r in got if r.session_id == "b"][-1] == 3


def test_line_numbers_of_split_files(spark, tmp_path):
    """S3: a file read in many splits keeps its line numbers."""
    from tokenloom.sources.sessions import read_session_files
    d = tmp_path / "logs" / "p"
    d.mkdir(parents=True)
    for name, n in (("one", 3000), ("two", 7), ("none", 0)):
        (d / f"{name}.jsonl").write_text("".join(f"{name} line {k} {'x' * (k % 50)}\n" for k in range(n)))
    keep = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = read_session_files(spark, str(tmp_path / "logs" / "*" / "*.jsonl"))
        rows = df.collect()
    finally:
        for c, v in keep.items():
            spark.conf.set(c, v)
    assert len(rows) == 3007 and all(r.raw.startswith(f"{r.session_id} line {r.line_no - 1}") for r in rows)


class _State:
    """A state handle that counts the calls of the processor."""

    def __init__(self):
        self.calls, self.map, self.value, self.timers = 0, {}, None, set()

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        value, outer = type("Value", (), {})(), self
        value.get = lambda: outer.did(outer.value)
        value.exists = lambda: outer.did(outer.value is not None)
        value.update = lambda v: outer.did(setattr(outer, "value", v))
        return value

    def did(self, result=None):
        self.calls += 1
        return result

    def getValue(self, k):
        return self.did(self.map.get(k))

    def updateValue(self, k, v):
        self.did(self.map.__setitem__(k, v))

    def registerTimer(self, at):
        self.did(self.timers.add(at))

    def deleteTimer(self, at):
        self.did(self.timers.discard(at))

    def listTimers(self):
        return self.did(iter(list(self.timers)))


def test_state_calls_of_short_and_long_sessions():
    """A short session's refresh is at most four calls of the state; a long one's
    totals do not depend on which entries lie beside the sums and which in the map."""
    import random

    from pyspark.sql import Row

    from tokenloom.streaming.sessions import COUNTS, INLINE, SessionTotals
    rnd = random.Random(7)

    def row(n, uuid):
        return Row(project="p", session_id="s", line_no=n, type="assistant" if n % 6 else "user", uuid=uuid, has_usage=n % 4 != 0,
                   mtime_us=1_700_000_000_000_000 + n, **{c: n * k for k, c in enumerate(COUNTS, 1)})

    def run(refreshes):
        state, out, calls = _State(), [], []
        step = SessionTotals(2.0)
        step.init(state)
        for part in refreshes:
            state.calls = 0
            out += list(step.handleInputRows(("p", "s"), iter(part), None))
            calls.append(state.calls)
        return out, calls, state

    _, calls, state = run([[row(k, f"u{k}") for k in range(lo, lo + 4)] for lo in (0, 4000, 8000)])
    assert max(calls) <= 4 and len(state.timers) == 1 and not state.map
    many = 4 * INLINE
    rows = [row(n, f"u{n % many}" if n % 5 else "") for n in range(1, 3 * many)]
    first = {}
    for r in rows:
        if r.type == "assistant" and r.uuid:
            first.setdefault(r.uuid, r)
    used = [r for r in [*first.values(), *(r for r in rows if r.type == "assistant" and not r.uuid)] if r.has_usage]
    want = (*(sum(r[c] for r in used) for c in COUNTS), len(used))
    for cuts in (1, 2, 7, 40):
        rnd.shuffle(rows)
        out, calls, state = run([rows[k::cuts] for k in range(cuts)])
        assert tuple(out[-1][c] for c in (*COUNTS, "turns")) == want
        assert len(state.map) == len(first) - INLINE and len(state.timers) == 1
        assert sum(out[k].delta_input for k in range(1, cuts)) == out[-1].input_tokens - out[0].input_tokens
    assert max(calls) <= 4 + 2 * len(rows[::40])  # what is new, not what is held


def _line(session, n, uuid, mtime_us, **more):
    from pyspark.sql import Row

    from tokenloom.streaming.sessions import COUNTS
    return Row(**{"project": "p", "session_id": session, "line_no": n, "type": "assistant", "uuid": uuid, "has_usage": True,
                  "mtime_us": mtime_us, **{c: n * k for k, c in enumerate(COUNTS, 1)}, **more})


def test_state_calls_do_not_grow_with_the_sessions_of_a_bucket():
    """F8: a refresh of hundreds of sessions of one bucket is at most four calls of the state."""
    from tokenloom.streaming.sessions import SessionTotals
    state = _State()
    step = SessionTotals(2.0)
    step.init(state)
    for refresh, n in enumerate((300, 400, 150)):
        state.calls = 0
        rows = [_line(f"s{k}", 10 * refresh + j, f"u{refresh}-{j}", 1_700_000_000_000_000 + refresh) for j in range(2) for k in range(n)]
        out = list(step.handleInputRows((7,), iter(rows), None))
        assert state.calls <= 4 and len(out) == n and len(state.timers) == 1
        assert {r.session_id: r.turns for r in out} == {f"s{k}": 2 * refresh + 2 if k < 300 else 2 * refresh for k in range(n)}
    state.calls = 0
    again = [_line("s399", 90, "v", 1_700_000_000_000_009)]
    assert [(r.turns, r.delta_input) for r in step.handleInputRows((7,), iter(again), None)] == [(3, 90)] and state.calls <= 4


def test_sessions_of_a_bucket_end_one_by_one(spark, tmp_path):
    """F8: all sessions in one bucket, one of them without an id, more uuids than are kept
    with the sums: the idle one ends with all its entries, the other goes on."""
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    from tokenloom.streaming.sessions import INLINE, stream_session_usage
    t0, out, many = datetime(2024, 1, 1), str(tmp_path / "out"), INLINE + 8

    def rows(session, uuids, hours, at):
        raw = [json.dumps({"type": "assistant", "uuid": f"u{k}", "message": {"usage": _u(1, 0, 0, 0)}}) for k in uuids]
        return [("p", session, at + k, r, t0 + timedelta(hours=hours)) for k, r in enumerate(raw)]

    def sink(df, batch_id):
        df.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)

    schema = "project string, session_id string, line_no int, raw string, file_mtime timestamp"
    arrivals = [rows("a", range(many), 0, 0) + rows("b", range(3), 0.5, 0), rows(None, range(many), 24, 0),
                rows("a", range(INLINE + 2), 25, 100) + rows(None, range(many + 5), 25, 100), rows("a", [many - 1], 25.5, 200) + rows("b", [0], 26, 200)]
    for arrival in arrivals:
        spark.createDataFrame(arrival, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = (stream_session_usage(src, idle_hours=2, buckets=1).writeStream.outputMode("update").foreachBatch(sink)
             .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
        q.awaitTermination()
    got = spark.read.parquet(out).orderBy("batch_id").collect()
    turns = {s: [r.turns for r in got if r.session_id == s] for s in ("a", "b", None)}
    assert turns == {"a": [many, INLINE + 2, INLINE + 3], "b": [3, 1], None: [many, many + 5]}

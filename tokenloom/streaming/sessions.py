"""Streaming session monitor: T1 running totals, T2 deltas per refresh, T4
active window.

The stream carries session log rows ``(project, session_id, line_no, raw,
file_mtime)``.  Sessions are dealt by their hash into ``buckets``, and one
stateful processor per bucket keeps a value state with a row for each session it
holds: the running sums (which are also the counts last emitted), the newest
``file_mtime`` and the entries of the session's first ``INLINE`` uuids (a uuid's
smallest line number and that line's counts).  A map state keeps one entry for
each further uuid.  Every access of the state is a call out of the Python
process and every group a batch of output, so a bucket costs one read, one write
and one batch for all the sessions a refresh brings to it; of a long session a
refresh reads and writes only the entries of the uuids it brings.  A refresh reads
the short rows of the buckets it touches: with many millions of sessions held at
a time give more ``buckets``, a number that is fixed with the checkpoint.  Taking the smallest line makes the step independent
of the order of rows, Arrow batches and micro-batches: a smaller line replaces
what the larger one had added, so the first line of a uuid wins exactly as in
the batch operator.

Expiry: with ``idle_hours`` a session's state is removed once the watermark (the
newest ``file_mtime`` seen less ``idle_hours``) passes the session's newest
``file_mtime``; a bucket has one event-time timer, set for the first of its
sessions to end.  Late rule: rows whose ``file_mtime`` lies
behind the watermark are dropped; a session touched again after its state was
removed starts from zero.  Without ``idle_hours`` nothing expires and every row
counts.
"""
from __future__ import annotations

from datetime import datetime, timedelta, timezone
from decimal import ROUND_HALF_UP, Decimal
from itertools import islice
from operator import itemgetter
from typing import Iterable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

import tokenloom.streaming.sessions as _self
from tokenloom.functions.scores import PRICE_CACHE_READ, PRICE_CACHE_WRITE, PRICE_INPUT, PRICE_OUTPUT
from tokenloom.sources.sessions import read_session_log

COUNTS = ["input_tokens", "output_tokens", "cache_write", "cache_read"]
KEPT = ["uuid", "line_no", "has_usage", *COUNTS]
LINE = ["project", "session_id", "type", "mtime_us", *KEPT]
OUTPUT_SCHEMA = ("project string, session_id string, mtime timestamp, input_tokens long, output_tokens long, "
                 "cache_write long, cache_read long, total_tokens long, turns long, cost_usd double, "
                 "delta_input long, delta_output long, delta_cache_w long, delta_cache_r long, delta_cost double")
ENTRY_SCHEMA = "line_no long, has_usage boolean, input_tokens long, output_tokens long, cache_write long, cache_read long"
HELD_SCHEMA = ("sessions array<struct<project string, session_id string, input_tokens long, output_tokens long, "
               f"cache_write long, cache_read long, turns long, mtime_us long, entries array<struct<uuid string, {ENTRY_SCHEMA}>>>>")
INLINE = 32      # uuids of a session whose entries are kept with its sums
BUCKETS = 2048   # groups of sessions that share a state row
CHUNK = 10_000   # rows of a bucket added at a time
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
# Keyed map state needs the RocksDB store; with change logs a refresh writes what it changed.
STORE_CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
              "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def _cost(i, o, w, r) -> float:
    """Rounded half up on the decimal text of the sum, as the batch operator rounds."""
    total = float(i * PRICE_INPUT + o * PRICE_OUTPUT + w * PRICE_CACHE_WRITE + r * PRICE_CACHE_READ)
    return float(Decimal(repr(total)).quantize(Decimal("0.00001"), ROUND_HALF_UP))


def add_rows(rows: Iterable[tuple], sums: list[int], entry, put) -> None:
    """Add assistant rows (the columns ``KEPT``) to ``sums`` (four counts and
    turns).  ``entry(uuid)`` gives what is kept of a uuid, ``put(uuid, entry)``
    keeps a smaller line."""
    def add(counts, sign: int) -> None:
        for k, n in enumerate((*counts, 1)):
            sums[k] += sign * int(n)

    first: dict[str, tuple] = {}
    for uuid, line_no, has_usage, *counts in rows:
        if uuid:
            if uuid not in first or line_no < first[uuid][0]:
                first[uuid] = (int(line_no), bool(has_usage), *map(int, counts))
        elif has_usage:
            add(counts, 1)
    for uuid, new in first.items():
        held = entry(uuid)
        if held is not None and held[0] <= new[0]:
            continue
        if held is not None and held[1]:
            add(held[2:], -1)
        if new[1]:
            add(new[2:], 1)
        put(uuid, new)


def emission(key: tuple, sums: list[int], last: list[int] | None, mtime_us: int | None) -> Row:
    """The row a refresh emits: totals, and the change since the last one."""
    n = sums[:4]
    d = [a - b for a, b in zip(n, last)] if last is not None else [0, 0, 0, 0]
    return Row(project=key[0], session_id=key[1], mtime=None if mtime_us is None else EPOCH + timedelta(microseconds=mtime_us),
               **dict(zip(COUNTS, n)), total_tokens=n[0] + n[1], turns=sums[4], cost_usd=_cost(*n), delta_input=d[0],
               delta_output=d[1], delta_cache_w=d[2], delta_cache_r=d[3], delta_cost=_cost(*d) if last is not None else 0.0)


class Session:
    """What is held of one session: sums, newest time, entries beside the sums."""

    def __init__(self, key: tuple, held: tuple | None, seen):
        self.key, self.seen = key, seen
        self.sums = [int(x) for x in held[2:7]] if held is not None else [0] * 5
        self.last = self.sums[:4] if held is not None else None
        self.mtime = None if held is None or held[7] is None else int(held[7])
        self.inline = {e[0]: tuple(e[1:]) for e in held[8]} if held is not None else {}
        self.more = len(self.inline) >= INLINE  # only then the map may hold entries
        self.fresh: dict[str, tuple] = {}  # what this refresh has put in, if the map held none

    def entry(self, uuid):
        return self.inline.get(uuid) or (self.seen.getValue((*self.key, uuid)) if self.more else self.fresh.get(uuid))

    def keep(self, uuid, new):
        if uuid in self.inline or len(self.inline) < INLINE:
            self.inline[uuid] = new
        else:
            if not self.more:
                self.fresh[uuid] = new
            self.seen.updateValue((*self.key, uuid), new)

    def add(self, lines: list[tuple]) -> None:
        """Add rows (the columns ``LINE``)."""
        times = [r[3] for r in lines if r[3] is not None]
        if times:
            self.mtime = max(self.mtime or 0, *times)
        add_rows((r[4:] for r in lines if r[2] == "assistant"), self.sums, self.entry, self.keep)

    def ends(self) -> int | None:
        """Time of its timer; the watermark already trails by the idle time."""
        return None if self.mtime is None else self.mtime // 1000 + 1

    def held(self) -> tuple:
        return (*self.key, *self.sums, self.mtime, [(u, *e) for u, e in self.inline.items()])


class SessionTotals(StatefulProcessor):
    """The sessions of a bucket: uuids seen, running sums, expiry."""

    def __init__(self, idle_hours: float | None):
        self.idle_ms = None if idle_hours is None else int(idle_hours * 3_600_000)

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "project string, session_id string, uuid string", ENTRY_SCHEMA)
        self.held = handle.getValueState("held", HELD_SCHEMA)

    def _read(self) -> dict[tuple, Session]:
        held = self.held.get()
        return {(h[0], h[1]): Session((h[0], h[1]), h, self.seen) for h in held[0]} if held is not None else {}

    def _write(self, sessions: dict[tuple, Session]) -> None:
        self.held.update(([s.held() for s in sessions.values()],))

    def _first_end(self, sessions: dict[tuple, Session]) -> int | None:
        ends = () if self.idle_ms is None else (s.ends() for s in sessions.values())
        return min((at for at in ends if at is not None), default=None)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        sessions = self._read()
        before = self._first_end(sessions)
        touched: dict[tuple, Session] = {}
        rows = iter(rows)
        while part := list(islice(rows, CHUNK)):
            line = itemgetter(*map(part[0].__fields__.index, LINE))
            lines: dict[tuple, list[tuple]] = {}
            for r in part:
                r = line(tuple(r))
                lines.setdefault(r[:2], []).append(r)
            for k, of_one in lines.items():
                if k not in touched:
                    touched[k] = sessions.setdefault(k, Session(k, None, self.seen))
                touched[k].add(of_one)
        self._write(sessions)
        first = self._first_end(sessions)
        if first != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(first)
        for k, s in touched.items():
            yield emission(k, s.sums, s.last, s.mtime)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        sessions = self._read()
        left = {k: s for k, s in sessions.items() if s.ends() is None or s.ends() > passed}
        if not left:
            self.seen.clear()
            self.held.clear()
            return iter([])
        long = {k for k, s in sessions.items() if k not in left and s.more}
        for k in [k for k in self.seen.keys() if tuple(k[:2]) in long] if long else []:
            self.seen.removeKey(tuple(k))
        self._write(left)
        first = self._first_end(left)
        if first is not None:
            self.handle.registerTimer(first)
        return iter([])

    def close(self) -> None:
        pass


cloudpickle.register_pickle_by_value(_self)


def stream_session_usage(lines: DataFrame, idle_hours: float | None = None, buckets: int = BUCKETS) -> DataFrame:
    """T1 + T2: streaming log rows -> totals per (project, session) and the change
    since the previous emission, in ``update`` output mode.  Keyed map state
    needs the RocksDB state store, which is set for the session's new queries."""
    for name, value in STORE_CONF.items():
        lines.sparkSession.conf.set(name, value)
    if idle_hours is not None:
        lines = lines.withWatermark("file_mtime", f"{int(idle_hours * 3600)} seconds")
    rows = (read_session_log(lines).withColumn("mtime_us", F.unix_micros("file_mtime"))
            .withColumn("bucket", F.pmod(F.xxhash64("project", "session_id"), F.lit(buckets))))
    return rows.groupBy("bucket").transformWithState(
        SessionTotals(idle_hours), OUTPUT_SCHEMA, "Update", "None" if idle_hours is None else "EventTime")


def active_sessions(totals: DataFrame, now, hours: float) -> DataFrame:
    """T4: sessions touched within the last ``hours`` (strictly after now - hours)."""
    return totals.where(F.col("mtime") > now - F.make_interval(secs=F.lit(float(hours) * 3600.0)))

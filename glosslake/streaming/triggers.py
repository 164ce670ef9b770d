"""When a page is scanned again, and what a report repaints: state that waits for time to pass.

A page's events are its key, a time, and perhaps its URL or whether scans are
paused.  It is scanned when it is first seen, once more ``settle`` later, when
its URL has changed (seen at the next tick of a poll that began with the page),
and when a pause ends; a paused page isn't scanned.  Each rule has a batch form
in window functions and a stream form on keyed state with event-time timers;
both give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

SETTLE, POLL = 2_000, 1_000
COOLDOWN = 30_000


def rescan_triggers(events: DataFrame, key: str, ts: str, seq: str, url: str, paused: str, settle: int = SETTLE, poll: int = POLL) -> DataFrame:
    """key, at, cause: ``first``, ``settled``, ``url`` or ``resume``; times in milliseconds.

    Of equal times, events come in the order of ``seq`` and before what falls
    due then.  A null url or paused says nothing about it.  Events without a
    time have no part; an event that is repeated counts once.
    """
    by = Window.partitionBy(key)
    rows = events.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"), F.col(seq).alias("_seq"), F.col(url).alias("_url"), F.col(paused).alias("_paused"))
    rows = rows.where("_at is not null").withColumn("_t0", F.min("_at").over(by))
    none = F.lit(None)
    first = rows.groupBy(key).agg(F.min("_t0").alias("_t0"))
    planned = first.select(key, F.explode(F.array(F.struct(F.col("_t0").alias("_at"), F.lit("first").alias("cause")), F.struct((F.col("_t0") + settle * 1000).alias("_at"), F.lit("settled").alias("cause")))).alias("_p")).select(key, "_p.*")
    tick = F.expr(f"(_at - _t0 + {poll * 1000 - 1}) div {poll * 1000}")
    seen = rows.where("_url is not null").groupBy(key, "_t0", tick.alias("_tick")).agg(F.max_by("_url", F.struct("_at", "_seq")).alias("_url"))
    before = F.lag("_url").over(by.orderBy("_tick"))
    moved = seen.withColumn("_before", before).where("_before <> _url").select(key, (F.col("_t0") + F.col("_tick") * (poll * 1000)).alias("_at"), F.lit("url").alias("cause"))
    flags = rows.where("_paused is not null").select(key, "_at", "_seq", "_paused", F.lag("_paused").over(by.orderBy("_at", "_seq")).alias("_was"))
    resumed = flags.where("_was and not _paused").select(key, "_at", F.lit("resume").alias("cause"))
    asked = planned.unionByName(moved).select(key, "_at", "cause", none.cast(dict(events.dtypes)[seq]).alias("_seq"), none.cast("boolean").alias("_paused"))
    both = asked.unionByName(flags.select(key, "_at", none.cast("string").alias("cause"), "_seq", "_paused"))
    upto = by.orderBy("_at", F.col("cause").isNotNull(), "_seq").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("_held", F.coalesce(F.last("_paused", ignorenulls=True).over(upto), F.lit(False))).where("cause is not null and not _held")
    return held.select(key, "_at", "cause").unionByName(resumed).select(key, F.timestamp_micros("_at").alias("at"), "cause")


def report_changes(events: DataFrame, key: str, ts: str, seq: str, values: list[str], expire: int | None = None) -> DataFrame:
    """key, at, seq and values of the events whose values differ from the last shown ones of their key.

    expire: after so many milliseconds without an event a key is forgotten, and
    its next event is shown whatever its values are.
    """
    rows = events.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"), seq, *values).where("_at is not null").dropDuplicates([key, "_at", seq])
    before = Window.partitionBy(key).orderBy("_at", seq)
    last = F.lag(F.struct("_at", *values)).over(before)
    same = F.struct(*values).eqNullSafe(F.struct(*(last[v].alias(v) for v in values)))
    kept = F.lit(True) if expire is None else F.col("_at") - last["_at"] <= expire * 1000
    shown = rows.withColumn("_shown", last.isNull() | ~(same & kept)).where("_shown")
    return shown.select(key, F.timestamp_micros("_at").alias("at"), seq, *values)


class _InOrder(StatefulProcessor):
    """Holds events back until the watermark has passed them, and folds them in their order.

    ``step(state, events, mark)`` gives the new state (None: forget the key),
    the rows to emit, and when to wake up if nothing else happens, in
    microseconds.  events: (at, seq, ...) tuples, sorted, each once.
    """

    def __init__(self, event: StructType, state: StructType, out: list[str], step: Callable):
        self.event, self.state, self.out, self.step = event, state, out, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.event)
        self.kept = handle.getValueState("kept", self.state)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        mark, new = timerValues.getCurrentWatermarkInMs(), []
        for pdf in rows:
            at = pd.to_datetime(pdf.iloc[:, 1])  # by place: the names may have been changed on their way
            rest = [[None if pd.isna(x) else x for x in pdf.iloc[:, i].tolist()] for i in range(2, pdf.shape[1])]
            new += [(int(t.value // 1000), *r) for t, *r in zip(at, *rest, strict=True) if not pd.isna(t) and t.value // 1_000_000 >= mark]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(_ceil(min(x[0] for x in new)))
        yield pd.DataFrame([], columns=self.out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted({x[:2]: x for x in held if x[0] <= mark}.values(), key=lambda x: x[:2])
        later = [x for x in held if x[0] > mark]
        state, found, wake = self.step(tuple(self.kept.get()) if self.kept.exists() else None, ready, mark)
        if ready:
            self.waiting.clear()
            if later:
                self.waiting.put(later)
        if state is None:
            self.kept.clear()
        else:
            self.kept.update(state)
        soon = [x[0] for x in later] + ([wake] if wake is not None else [])
        if soon:
            self.handle.registerTimer(max(_ceil(min(soon)), mark // 1000 + 1))
        yield pd.DataFrame([(key[0], *x) for x in found], columns=self.out)


def _ceil(micros: int) -> int:
    return -(-micros // 1000)


def in_order(events: DataFrame, key: str, ts: str, columns: list[str], state: str, out: str, step: Callable, late: str) -> DataFrame:
    """A stream folded in event-time order by key; ``columns`` (seq first) go with each event.  Needs the RocksDB state store."""
    own = events.select(key, F.col(ts).cast("timestamp").alias("event_time"), *columns)
    kinds = dict(own.dtypes)
    event = StructType.fromDDL(", ".join(["at long", *(f"c{i} {kinds[c]}" for i, c in enumerate(columns))]))
    shape = StructType.fromDDL(f"`{key}` {kinds[key]}, {out}")
    processor = _InOrder(event, StructType.fromDDL(state), shape.fieldNames(), step)
    return own.withWatermark("event_time", late).groupBy(key).transformWithStateInPandas(processor, shape, "Append", "EventTime")


def _time(micros: int) -> pd.Timestamp:
    return pd.Timestamp(micros, unit="us")


def rescan_triggers_stream(events: DataFrame, key: str, ts: str, seq: str, url: str, paused: str, settle: int = SETTLE, poll: int = POLL, late: str = "10 minutes") -> DataFrame:
    """The stream form of ``rescan_triggers``.

    A key's state: when it was first seen, its URL, the URL that the next tick
    will see and when that is, when it settles, and whether it is paused.
    """

    def step(state, rows, mark):
        t0, shown, coming, tick, settles, held = state or (None, None, None, None, None, False)
        out = []

        def due(until: int) -> None:
            nonlocal shown, coming, tick, settles
            for at, cause in sorted((x, c) for x, c in ((tick, "url"), (settles, "settled")) if x is not None and x < until):
                if cause == "url":
                    if shown is not None and coming != shown and not held:
                        out.append((_time(at), cause))
                    shown, coming, tick = coming, None, None
                else:
                    settles = None
                    if not held:
                        out.append((_time(at), cause))

        opening = None
        for at, _, u, p in rows:
            if t0 is None:
                t0, settles, opening = at, at + settle * 1000, at
            if opening is not None and at > opening:
                out, opening = out + ([] if held else [(_time(opening), "first")]), None
            due(at)
            if u is not None:
                coming, tick = u, t0 + -(-(at - t0) // (poll * 1000)) * poll * 1000
            if p is not None:
                if held and not p:
                    out.append((_time(at), "resume"))
                held = p
        if opening is not None and not held:
            out.append((_time(opening), "first"))
        due(mark + 1)
        wake = min((x for x in (tick, settles) if x is not None), default=None)
        return (t0, shown, coming, tick, settles, held), out, wake

    state = "t0 long, shown string, coming string, tick long, settles long, held boolean"
    return in_order(events, key, ts, [seq, url, paused], state, "at timestamp, cause string", step, late)


def report_changes_stream(events: DataFrame, key: str, ts: str, seq: str, values: list[str], expire: int | None = None, late: str = "10 minutes") -> DataFrame:
    """The stream form of ``report_changes``: a key's state is the time and the values of its last event."""

    def step(state, rows, mark):
        out = []
        for at, n, *now in rows:
            fresh = state is None or expire is not None and at - state[0] > expire * 1000
            if fresh or list(state[1:]) != now:
                out.append((_time(at), n, *now))
            state = (at, *now)
        if state is not None and expire is not None and mark - state[0] > expire * 1000:
            state = None
        return state, out, None if state is None or expire is None else state[0] + expire * 1000 + 1000

    kinds = dict(events.dtypes)
    named = ", ".join(f"`{v}` {kinds[v]}" for v in values)
    held = ", ".join(f"v{i} {kinds[v]}" for i, v in enumerate(values))
    return in_order(events, key, ts, [seq, *values], f"at long, {held}", f"at timestamp, `{seq}` {kinds[seq]}, {named}", step, late)


def cooldown_stream(events: DataFrame, key: str, ts: str, seq: str, millis: int = COOLDOWN, late: str = "10 minutes") -> DataFrame:
    """The stream form of ``state.cooldown``: key, fired; an event fires if the last fired one is more than ``millis`` old."""

    def step(state, rows, mark):
        out, last = [], state[0] if state else None
        for at, *_ in rows:
            if last is None or at - last > millis * 1000:
                last = at
                out.append((_time(at),))
        if last is not None and mark - last > millis * 1000:
            last = None  # the next event fires whatever came before
        return None if last is None else (last,), out, None if last is None else last + millis * 1000 + 1000

    return in_order(events, key, ts, [seq], "last long", "fired timestamp", step, late)

"""Stateful streaming operators: state per stream in the state store, kept in the query's checkpoint.

State is typed and keyed: a value for each stream, or a map of small pages and entries of which a trigger reads
and writes those alone that its events touch. So a stream in which very much waits costs a trigger no more than
what the trigger takes. What waits is never dropped. Values that may go have a time to live in the store (M8);
timers are the store's own (M5, M6). Both need a trigger that goes on (``run_until_drained``); a query that is
to end at the tail (availableNow) is run without them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Events of a stream that are parked under one key of a map.
PAGE = 256


def run_until_drained(writer: DataStreamWriter, every: str = "100 milliseconds", quiet: int = 50) -> int:
    """Start a stream with timers and stop it once a trigger brings nothing and no state waits for another one.

    Returns the number of state rows that are left: 0, as what is let go and what has been taken are gone.

    The first batch may be one that an earlier run left half done, and says nothing of what is new; a stream
    that has never had anything makes no batches, and is stopped after so many quiet looks at it.
    """
    query, first, looks = writer.trigger(processingTime=every).start(), None, 0
    try:
        while not query.awaitTermination(0.1):
            last = query.lastProgress
            looks += 1
            if last:
                first = last["batchId"] if first is None else first
                empty = last["numInputRows"] == 0 and not any(o["numRowsTotal"] for o in last["stateOperators"])
                looks = looks if empty else 0
                if empty and (last["batchId"] > first or looks > quiet):
                    return sum(o["numRowsTotal"] for o in last["stateOperators"])
    finally:
        query.stop()
    return 0


def _stateful(df: DataFrame, key: str, processor: StatefulProcessor, schema: T.StructType | str, timed: bool = False) -> DataFrame:
    df.sparkSession.conf.set(PROVIDER, ROCKS)  # keyed state and timers are in this store only
    return df.groupBy(key).transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="processingTime" if timed else "none")


class Processor(StatefulProcessor):
    def close(self) -> None:
        pass


class Fold(Processor):
    """A state for each stream, folded over its events from the version on."""

    def __init__(self, initial: object, evolve: Callable[[object, dict], object], idle_ms: int | None) -> None:
        self.initial, self.evolve, self.idle_ms = initial, evolve, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("fold", "version long, state string", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        events = sorted((r.asDict() for r in rows), key=lambda e: e["idx"])
        there = self.held.exists()
        if self.idle_ms and not there and events[0]["idx"] > 0:
            yield Row(stream=key[0], version=None, state=None)
            return
        version, state = self.held.get() if there else (0, None)
        state = json.loads(state) if there else self.initial
        for e in events:
            if e["idx"] >= version:
                state, version = self.evolve(state, e), e["idx"] + 1
        text = json.dumps(state)
        self.held.update((version, text))
        yield Row(stream=key[0], version=version, state=text)


def fold_stream(df: DataFrame, initial: object, evolve: Callable[[object, dict], object], columns: list[str], idle_ms: int | None = None) -> DataFrame:
    """(stream, version, state as JSON) after each span, one span of a stream at a time (M1).

    Events below the version are taken as delivered again and left out (M2). State must be JSON-like and is
    read and written whole: where it has many entries, use ``fold_entries``. With ``idle_ms`` the state of a
    stream that gets nothing for so long is let go by the store (M8); if events come after all, and not from
    the first one on, a row with a null version and state tells that the stream is to be folded from its log.
    """
    rows = df.select("stream", "idx", "event_type", *columns)
    return _stateful(rows, "stream", Fold(initial, evolve, idle_ms), "stream string, version long, state string", bool(idle_ms))


class Entries(Processor):
    """Entries of each stream, of which a span touches those alone that its events name."""

    def __init__(self, item: str, evolve: Callable[[object, dict], object]) -> None:
        self.item, self.evolve = item, evolve

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.version, self.entries = handle.getValueState("version", "version long"), handle.getMapState("entries", "item string", "value string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        version = self.version.get()[0] if self.version.exists() else 0
        touched: dict[str, list[dict]] = {}
        for e in sorted((r.asDict() for r in rows), key=lambda e: e["idx"]):
            if e["idx"] >= version:
                touched.setdefault(e[self.item], []).append(e)
                version = e["idx"] + 1
        for item, events in touched.items():
            there = self.entries.containsKey((item,))
            value = json.loads(self.entries.getValue((item,))[0]) if there else None
            for e in events:
                value = self.evolve(value, e)
            text = None if value is None else json.dumps(value)
            if text is not None:
                self.entries.updateValue((item,), (text,))
            elif there:
                self.entries.removeKey((item,))
            yield Row(stream=key[0], item=item, version=version, value=text)
        if touched:
            self.version.update((version,))


def fold_entries(df: DataFrame, item: str, evolve: Callable[[object, dict], object], columns: list[str]) -> DataFrame:
    """(stream, item, version, value as JSON) of the entries that a span changes (M1).

    For states that are maps: an event names one entry by its column ``item``, and ``evolve`` takes the entry's
    value (None where there is none) and the event. A null value removes the entry. However many entries a
    stream holds, a trigger reads and writes those that its events name. Events below the version are left out.
    """
    rows = df.select("stream", "idx", "event_type", item, *[c for c in columns if c != item]).withColumn(item, df[item].cast("string"))
    return _stateful(rows, "stream", Entries(item, evolve), "stream string, item string, version long, value string")


class InSequence(Processor):
    """The next index of each stream, and pages of the events that wait for it."""

    def __init__(self, columns: list[str]) -> None:
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "idx long, parked long")
        self.pages = handle.getMapState("parked", "page long", "events array<struct<idx: long, data: array<string>>>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at, parked = self.next.get() if self.next.exists() else (0, 0)
        new: dict[int, list] = {}
        for r in rows:
            if r["idx"] >= at:
                new.setdefault(r["idx"], [None if r[c] is None else str(r[c]) for c in self.columns])
        read: dict[int, dict[int, list]] = {}
        changed: set[int] = set()

        def page(n: int) -> dict[int, list]:
            if n not in read:
                read[n] = {e[0]: list(e[1]) for e in self.pages.getValue((n,))[0]} if self.pages.containsKey((n,)) else {}
            return read[n]

        out = []
        while True:
            # What came first counts. Where nothing waits, no page is read.
            held = page(at // PAGE).pop(at, None) if parked else None
            if held is not None:
                parked -= 1
                changed.add(at // PAGE)
                new.pop(at, None)
            else:
                held = new.pop(at, None)
            if held is None:
                break
            out.append((at, held))
            at += 1
        for n, data in new.items():
            if page(n // PAGE).setdefault(n, data) is data:
                parked += 1
                changed.add(n // PAGE)
        for n in changed:
            if read[n]:
                self.pages.updateValue((n,), ([(i, d) for i, d in sorted(read[n].items())],))
            else:
                self.pages.removeKey((n,))
        self.next.update((at, parked))
        for n, data in out or [(None, [None] * len(self.columns))]:
            yield Row("stream", "idx", *self.columns, "parked")(key[0], n, *data, parked)


def in_sequence(df: DataFrame, columns: list[str]) -> DataFrame:
    """Events of each stream without gaps: later ones wait until what they follow has come (M3).

    Rows: stream, idx, the columns (as strings), parked: how many wait after this span. A span that releases
    nothing gives one row with a null idx and the number that waits. The next index of a stream and what
    waits are kept for good: without them, later events couldn't be told from a gap. Waiting events lie in
    pages of PAGE indexes, and a trigger reads and writes those of its events and of what it releases.
    """
    schema = f"stream string, idx long, {', '.join(f'{c} string' for c in columns)}, parked long"
    return _stateful(df.select("stream", "idx", *columns), "stream", InSequence(columns), schema)


class Counter(Processor):
    """The next number of each key."""

    def __init__(self, columns: list[str], order: list[str]) -> None:
        self.columns, self.order = columns, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, make = self.next.get()[0] if self.next.exists() else 0, Row(*self.columns, "idx")
        for r in sorted(rows, key=lambda r: [(r[c] is not None, r[c]) for c in self.order]):
            yield make(*(r[c] for c in self.columns), n)
            n += 1
        self.next.update((n,))


def sequence(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Messages with an index within their key that goes on across batches and restarts (S8, M4); nulls come first."""
    fields = [f for f in df.schema if f.name in (key, *order)]
    names = [f.name for f in fields]
    return _stateful(df.select(*names), key, Counter(names, order), T.StructType([*fields, T.StructField("idx", T.LongType())]))


class Watch(Processor):
    """When each open transaction's time is up, and the end of each closed one, which the store lets go in time."""

    def __init__(self, timeout_ms: int, keep_ms: int, terminal: str) -> None:
        self.timeout_ms, self.keep_ms, self.terminal = timeout_ms, keep_ms, terminal

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open, self.closed = handle.getValueState("open", "until long"), handle.getValueState("closed", "status string", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        done = any([r["event_type"] == self.terminal for r in rows])
        status = self.closed.get()[0] if self.closed.exists() else None
        if done:
            if self.open.exists():
                self.handle.deleteTimer(self.open.get()[0])
                self.open.clear()
            if status != "Complete":
                self.closed.update(("Complete",))
                yield Row(stream=key[0], status="Complete")
        elif status is None and not self.open.exists():
            until = timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms
            self.open.update((until,))
            self.handle.registerTimer(until)
            yield Row(stream=key[0], status="Active")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.open.clear()
        self.closed.update(("Stuck",))
        yield Row(stream=key[0], status="Stuck")


def watch(df: DataFrame, timeout_ms: int, terminal: str = "Completed", keep_ms: int | None = None) -> DataFrame:
    """(stream, status) of transactions: Active at first, Complete at a terminal event, Stuck when time is up before (M5).

    Time counts from the first event that comes, whatever comes after it. What is Stuck can still become
    Complete. The end of a transaction, Stuck or Complete, is kept for ``keep_ms`` (the timeout, if not given) and
    then let go by the store (M8): after that, an event that isn't terminal opens the transaction anew. An open
    one is never let go.
    """
    return _stateful(df.select("stream", "event_type"), "stream", Watch(timeout_ms, keep_ms or timeout_ms, terminal), "stream string, status string", True)


class Chunks(Processor):
    """A queue of pages of waiting items for each stream: a trigger takes the first page and fills the last one."""

    def __init__(self, item: str, most: int) -> None:
        self.item, self.most = item, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Pages first to last are there; the last holds ``size`` items. ``timer`` is the one that is set.
        self.ends = handle.getValueState("ends", "first long, last long, size long, timer long")
        self.pages = handle.getMapState("pages", "page long", "items array<struct<idx: long, item: string>>")

    def _page(self, n: int) -> list[tuple]:
        return [tuple(x) for x in self.pages.getValue((n,))[0]]

    def _put(self, n: int, items: list[tuple]) -> None:
        self.pages.updateValue((n,), (items,))

    def _emit(self, key, items: Iterable[tuple]) -> Iterator[Row]:
        items = list(items)
        for i, v in items:
            yield Row(stream=key[0], idx=i, item=v, next_idx=items[-1][0] + 1)

    def _take(self, first: int, last: int, size: int, now: int) -> list[tuple]:
        """Take what a trigger may from the pages, and set the next timer if something is left."""
        out: list[tuple] = []
        while first <= last and len(out) < self.most:
            items = self._page(first)
            room = self.most - len(out)
            out += items[:room]
            if len(items) > room:
                self._put(first, items[room:])
                size -= room if first == last else 0
            else:
                self.pages.removeKey((first,))
                first += 1
        if first > last:
            self.ends.clear()
        else:
            self.ends.update((first, last, size, now + 1))
            self.handle.registerTimer(now + 1)
        return out

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = sorted(((r["idx"], None if r[self.item] is None else str(r[self.item])) for r in rows), key=lambda x: (x[0], x[1] or ""))
        waits = self.ends.exists()
        if not waits and len(new) <= self.most:
            yield from self._emit(key, new)
            return
        first, last, size, timer = self.ends.get() if waits else (0, -1, 0, None)
        if waits:
            self.handle.deleteTimer(timer)  # one chunk for each trigger
        at = 0
        if waits and size < self.most:
            at = self.most - size
            self._put(last, [*self._page(last), *new[:at]])
            size += len(new[:at])
        while at < len(new):
            last, part = last + 1, new[at : at + self.most]
            self._put(last, part)
            size, at = len(part), at + self.most
        yield from self._emit(key, self._take(first, last, size, timerValues.getCurrentProcessingTimeInMs()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.ends.exists():
            first, last, size, _ = self.ends.get()
            yield from self._emit(key, self._take(first, last, size, timerValues.getCurrentProcessingTimeInMs()))


def take_chunks(df: DataFrame, item: str, most: int = 1000) -> DataFrame:
    """(stream, idx, item, next_idx): at most so many of a stream for each trigger; the rest comes with the next ones.

    next_idx is the position after what was taken. A stream in which something waits is called again at the
    next trigger, with or without new events; when nothing waits, its state is let go. What waits lies in
    pages of ``most`` items, in the order of batches and of indexes within one; a trigger reads and writes
    the pages that it takes and those that its new items fill.
    """
    return _stateful(df.select("stream", "idx", item), "stream", Chunks(item, most), "stream string, idx long, item string, next_idx long", True)

"""Stateful processors over a store that counts what a trigger reads and writes; and the metrics of a feed."""

import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from tests.conftest import rows
from tidefold import schema
from tidefold.sources import log
from tidefold.streaming import metrics, stateful, tables


class Value:
    def __init__(self, store):
        self.store, self.held = store, None

    def exists(self):
        return self.held is not None

    def get(self):
        self.store.read += 1
        return self.held

    def update(self, value):
        self.store.written += 1
        self.held = value

    def clear(self):
        self.held = None


class Map:
    def __init__(self, store):
        self.store, self.held = store, {}

    def containsKey(self, key):
        return key in self.held

    def getValue(self, key):
        self.store.read += sum(len(x) if isinstance(x, list) else 1 for x in self.held[key])
        return self.held[key]

    def updateValue(self, key, value):
        self.store.written += sum(len(x) if isinstance(x, list) else 1 for x in value)
        self.held[key] = value

    def removeKey(self, key):
        self.held.pop(key, None)


class Store:
    """A stand-in for the handle of one key, with the time as a counter."""

    def __init__(self, processor):
        self.read = self.written = self.now = 0
        self.timers, self.processor = set(), processor
        processor.init(self)

    def getValueState(self, name, kind, ttl=None):
        return Value(self)

    def getMapState(self, name, key, value, ttl=None):
        return Map(self)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def trigger(self, events=()):
        """Rows that come out of a trigger: of new events first, then of timers whose time has come."""
        self.read = self.written = 0
        self.now += 10
        due = [t for t in self.timers if t <= self.now]
        out = list(self.processor.handleInputRows(("s",), iter(events), self)) if events else []
        for t in due:
            if t in self.timers:
                self.timers.remove(t)
                out += self.processor.handleExpiredTimer(("s",), self, None)
        return out


def test_chunks_touch_what_they_take():
    store = Store(stateful.Chunks("item", 1000))
    event = lambda n: Row(idx=n, item=str(n))
    first = store.trigger([event(n) for n in range(100_500)])
    assert [r.idx for r in first] == list(range(1000))
    seen = [r.idx for r in first]
    while store.timers:
        more = [event(len(seen) + 200_000)] if len(seen) == 50_000 else []
        seen += [r.idx for r in store.trigger(more)]
        assert store.read <= 2600 and store.written <= 1600, (store.read, store.written)
    assert seen == [*range(100_500), 250_000]
    assert not store.processor.pages.held and not store.processor.ends.exists()


def test_chunks_in_any_batches():
    rng = random.Random(4)
    for _ in range(200):
        most, n, seen = rng.randint(1, 5), 0, []
        store = Store(stateful.Chunks("item", most))
        for _ in range(rng.randint(1, 8)):
            new = [Row(idx=n + i, item=rng.choice([None, "x"])) for i in range(rng.randint(0, 12))]
            n += len(new)
            got = store.trigger(rng.sample(new, len(new)))
            assert len(got) <= most and all(r.next_idx == got[-1].idx + 1 for r in got)
            seen += [r.idx for r in got]
        while store.timers:
            seen += [r.idx for r in store.trigger()]
        assert seen == list(range(n)) and not store.processor.pages.held


def test_waiting_events_are_read_when_they_go():
    store = Store(stateful.InSequence(["event_type"]))
    event = lambda n: Row(idx=n, event_type=f"t{n}")
    out = store.trigger([event(n) for n in range(1000, 101_000)])
    assert [(r.idx, r.parked) for r in out] == [(None, 100_000)]
    store.trigger([event(5), event(100_999)])
    assert store.read <= 2 * stateful.PAGE + 2 and store.written <= 2 * stateful.PAGE + 4
    assert [r.idx for r in store.trigger([event(n) for n in range(5)])] == [0, 1, 2, 3, 4, 5]
    assert [r.idx for r in store.trigger([event(n) for n in range(6, 999)])] == list(range(6, 999))
    assert [(r.idx, r.parked) for r in store.trigger([event(999)])] == [(n, 0) for n in range(999, 101_000)]
    assert not store.processor.pages.held


def test_in_sequence_in_any_order():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 40)
        sent = [i for i in range(n) for _ in range(rng.randint(1, 2))]
        rng.shuffle(sent)
        store, got = Store(stateful.InSequence(["event_type"])), []
        while sent:
            k = rng.randint(1, len(sent))
            got += [r.idx for r in store.trigger([Row(idx=i, event_type=None) for i in sent[:k]]) if r.idx is not None]
            sent = sent[k:]
        assert got == list(range(n)) and not store.processor.pages.held


def test_entries_touch_what_events_name():
    add = lambda v, e: None if e["event_type"] == "gone" else (v or 0) + 1
    store = Store(stateful.Entries("item", add))
    store.trigger([Row(idx=n, event_type="come", item=f"i{n}") for n in range(50_000)])
    out = store.trigger([Row(idx=50_000, event_type="come", item="i7"), Row(idx=50_001, event_type="gone", item="i8"), Row(idx=3, event_type="gone", item="i9")])
    assert [(r.item, r.version, r.value) for r in out] == [("i7", 50_002, "2"), ("i8", 50_002, None)]
    assert store.read <= 4 and store.written <= 3 and len(store.processor.entries.held) == 49_999
    assert store.trigger([Row(idx=9, event_type="come", item="i1")]) == []


def test_watch_keeps_the_open_ones():
    store = Store(stateful.Watch(35, 1000, "Completed"))
    begun, done = Row(event_type="Begun"), Row(event_type="Completed")
    assert [r.status for r in store.trigger([begun])] == ["Active"]
    assert store.trigger([begun]) == [] and store.trigger() == [] and store.trigger([begun]) == []
    assert [r.status for r in store.trigger()] == ["Stuck"] and not store.processor.open.exists()
    assert store.trigger([begun]) == []
    assert [r.status for r in store.trigger([begun, done])] == ["Complete"]
    store.processor.closed.clear()  # what the store does in time
    assert [r.status for r in store.trigger([done])] == ["Complete"] and not store.timers


def test_lag_goes_on_from_what_is_committed(spark, tmp_path):
    path, part = str(tmp_path / "log"), lambda n, ps: spark.createDataFrame([("A-1", t, p) for t, p in ps], "stream string, tranche string, position long").coalesce(1).write.mode("append").parquet(path)
    part(0, [("0", 5), ("0", 6), ("1", 2)])
    part(1, [("1", 3), (None, 9)])
    moving = iter([{"0": 6, "1": 4}, {"0": 8, "1": 4}])
    listener = metrics.LagListener("feed", ["0", "1", "2"], lambda: next(moving), {"0": 4})
    feed = metrics.observed(log.tail_log(spark, path, max_files=1), "feed", ["0", "1", "2"])
    lag = metrics.with_lag(lambda: tables.run_batches(feed, lambda b, n: b.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "c")), spark, listener)
    assert rows(lag, "batch", "tranche", "events", "committed", "lag") == [(0, "0", 2, 6, 0), (0, "1", 1, 2, 2), (0, "2", 0, -1, 0), (1, "0", 0, 6, 2), (1, "1", 1, 3, 1), (1, "2", 0, -1, 0)]


def test_span_sizes_of_batches(spark, tmp_path):
    e = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), (None, 3)], "stream string, idx long")
    for n, batch in enumerate((e, e.limit(0), e)):
        metrics.write_spans(batch, n, lambda s: s.write.mode("append").parquet(str(tmp_path / "spans")), str(tmp_path / "sizes"))
    metrics.write_spans(e, 2, lambda s: s.count(), str(tmp_path / "sizes"))  # the last batch again
    assert rows(metrics.read_spans(spark, str(tmp_path / "sizes"))) == [(0, 3, 4, 2), (1, 0, 0, 0), (2, 3, 4, 2)]


def test_state_is_let_go(spark, tmp_path):
    """One stream of 5,000 waiting items is taken in five triggers, and nothing of it is left in the store."""
    src = str(tmp_path / "src")
    e = spark.range(5000).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], schema.EVENT_LOG).schema if f.name not in ("stream", "idx", "event_type")], F.lit("S-1").alias("stream"), F.col("id").alias("idx"), F.col("id").cast("string").alias("event_type"))
    e.write.parquet(src)
    chunks = stateful.take_chunks(log.tail_log(spark, src), "event_type", 1000)
    left = stateful.run_until_drained(chunks.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert left == 0 and rows(got.groupBy("next_idx").count()) == [(n, 1000) for n in range(1000, 6000, 1000)]

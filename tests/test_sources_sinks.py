"""Sources, sinks and streams: replays change nothing, and a stream ends where a batch does."""

import glob
import json
import re
import shutil
import threading
import time
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidefold import schema
from tidefold.operators import filters, folds
from tidefold.sources import log, sinks
from tidefold.streaming import stateful, tables

from .conftest import rows


def events(spark, n=40, streams=5):
    df = spark.range(n).select(F.concat(F.lit("User-"), (F.col("id") % streams)).alias("stream"), F.lit("User").alias("category"), (F.col("id") % streams).cast("string").alias("stream_id"), F.floor(F.col("id") / streams).cast("long").alias("idx"), F.when(F.col("id") % 3 == 0, "Snapshotted").otherwise("Added").alias("event_type"), F.to_json(F.struct("id")).alias("data"), F.timestamp_seconds(F.col("id")).alias("ts"))
    return df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], schema.EVENT_LOG).schema])


def test_dump(spark, tmp_path):
    lines = [json.dumps({"stream": f"A-{n}", "idx": n, "event_type": "X"}) for n in range(6)]
    (tmp_path / "dump").write_text("\n".join([lines[0], "# a comment", *lines[1:4], "no json", *lines[4:]]) + "\n")
    path = str(tmp_path / "dump")
    assert [r.idx for r in log.read_dump(spark, path, truncate=5).orderBy("line").collect()] == [0, 1, 2, 3]
    assert [r.line for r in log.read_dump(spark, path, skip=3, truncate=5).orderBy("line").collect()] == [4, 5]
    (tmp_path / "long").write_text("".join(json.dumps({"stream": f"A-{n}", "idx": n, "event_type": "X"}) + "\n" for n in range(3000)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        got = log.read_dump(spark, str(tmp_path / "long")).select("line", "idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert sorted(tuple(r) for r in got) == [(n + 1, n) for n in range(3000)]  # one file, many splits
    with pytest.raises(Exception, match="line 6"):
        log.read_dump(spark, path).collect()
    assert log.read_dump(spark, path, strict=False).where("bad is not null").select("line").collect()[0][0] == 6


def test_positions(spark):
    df = spark.range(101).withColumnRenamed("id", "position")
    assert log.from_position(df, "start").count() == 101
    assert log.from_position(df, 90).count() == 11
    assert log.from_position(df, 0.5).count() == 51
    assert log.from_position(df, "tail").count() == 0


def test_append_is_idempotent_and_contiguous(spark, tmp_path):
    path, e = str(tmp_path / "log"), events(spark)
    assert sinks.append_events(e.where("idx < 3"), path) == 15
    assert sinks.append_events(e.where("idx < 4"), path) == 5
    assert sinks.append_events(e.where("idx < 4"), path) == 0
    assert sinks.append_events(e.where("idx > 4"), path) == 0  # index 4 is missing
    assert sinks.append_events(e, path) == 20
    assert log.read_log(spark, path, categories=["User"]).count() == 40
    assert log.read_log(spark, path, streams=["User-1"]).count() == 8


def test_view_keeps_the_highest_version(spark, tmp_path):
    path, kind = str(tmp_path / "view"), "stream string, version long, value string"
    first = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y"), ("a", 2, "z")], kind)
    assert rows(sinks.upsert_view(first, path, ["stream"]), "stream", "version", "accepted") == [("a", 1, False), ("a", 2, True), ("b", 5, True)]
    again = spark.createDataFrame([("a", 1, "old"), ("b", 6, "new"), ("c", 0, "c")], kind)
    assert rows(sinks.upsert_view(again, path, ["stream"]), "stream", "accepted") == [("a", False), ("b", True), ("c", True)]
    sinks.upsert_view(again, path, ["stream"])
    assert rows(sinks.read_view(spark, path, first.schema)) == [("a", 2, "z"), ("b", 6, "new"), ("c", 0, "c")]


def test_view_reads_and_writes_touched_buckets(spark, tmp_path):
    """Only the files of buckets to which something is accepted change; a view can be written anew with more buckets."""
    path, kind = str(tmp_path / "view"), "stream string, version long"
    view = lambda *r: spark.createDataFrame(r, kind)
    sinks.upsert_view(view(*[(f"s{n}", 1) for n in range(40)]), path, ["stream"], buckets=8)
    files = lambda: set(glob.glob(f"{path}/bucket=*/part-*"))
    before = files()
    sinks.upsert_view(view(("s1", 2), ("s2", 1)), path, ["stream"], buckets=8)
    changed = {f.split("/")[-2] for f in before ^ files()}
    assert len(changed) == 1
    sinks.upsert_view(view(("s1", 1)), path, ["stream"], buckets=8)
    want = sorted([(f"s{n}", 2 if n == 1 else 1) for n in range(40)])
    schema = view(("a", 1)).schema
    assert rows(sinks.read_view(spark, path, schema)) == want
    one = sinks.held_rows(view(("s1", 0), ("none", 0)), path, schema, ["stream"], 8)
    assert rows(one) == [("s1", 2)] and re.search(r"PartitionFilters: \[[^\]]*bucket", one._jdf.queryExecution().toString())
    sinks.write_view(sinks.read_view(spark, path, schema), str(tmp_path / "wider"), ["stream"], 16)
    assert rows(sinks.read_view(spark, str(tmp_path / "wider"), schema)) == want


def test_writers_of_different_buckets_overlap(spark, tmp_path):
    """Two writers at the same time, each over its own buckets: nothing of either is lost, round after round."""
    path, buckets = str(tmp_path / "view"), 8
    keys = spark.range(400).select(F.col("id").cast("string").alias("stream"))
    of = {r.stream: r.b for r in keys.select("stream", sinks._bucket(["stream"], buckets).alias("b")).collect()}
    own = [[k for k, b in of.items() if b % 2 == half] for half in (0, 1)]
    sinks.upsert_view(keys.withColumn("version", F.lit(0).cast("long")), path, ["stream"], buckets=buckets)
    for n in range(1, 4):
        start = threading.Barrier(2)

        def write(half, n=n, start=start):
            start.wait()
            sinks.upsert_view(spark.createDataFrame([(k, n) for k in own[half]], "stream string, version long"), path, ["stream"], buckets=buckets)

        with ThreadPoolExecutor(2) as pool:
            list(pool.map(write, (0, 1)))
        assert rows(sinks.read_view(spark, path, spark.createDataFrame([], "stream string, version long").schema)) == sorted((k, n) for k in of)


def test_append_by_heads(spark, tmp_path):
    """A batch that comes again adds nothing, before and after the heads have moved; gaps wait; other jobs' files stay."""
    path, heads = str(tmp_path / "log"), str(tmp_path / "heads")
    e = events(spark, 60, 3)
    held = lambda: rows(log.read_log(spark, path), "stream", "idx")
    want = lambda cond: rows(e.where(cond), "stream", "idx")
    assert sinks.append_batch(e.where("idx < 5"), path, heads, "a-0", 4) == 15
    assert sinks.append_batch(e.where("idx < 5"), path, heads, "a-0", 4) == 0  # all of it again
    assert sinks.append_batch(e.where("idx >= 3 and idx < 8 or idx = 11"), path, heads, "a-1", 4) == 9
    assert held() == want("idx < 8")
    before = {f: Path(f).read_bytes() for f in glob.glob(f"{heads}/**/part-*", recursive=True)}
    assert sinks.append_batch(e.where("idx >= 8 and idx < 12"), path, heads, "b-0", 4) == 12
    for f in glob.glob(f"{heads}/**/*", recursive=True):  # the driver was lost before the heads moved
        if Path(f).is_file() and f not in before:
            Path(f).unlink()
    for f, data in before.items():
        Path(f).write_bytes(data)
    spark.catalog.clearCache()
    assert sinks.append_batch(e.where("idx >= 8 and idx < 12"), path, heads, "b-0", 4) == 12
    assert held() == want("idx < 12")


def test_ingest_again(spark, tmp_path):
    src, held = str(tmp_path / "src"), str(tmp_path / "held")
    items = spark.createDataFrame([(n % 7, n) for n in range(30)], "item long, n long")
    for a, b in ((0, 10), (5, 20), (18, 30)):
        items.where(f"n >= {a} and n < {b}").coalesce(1).write.mode("append").parquet(src)
    feed = lambda: spark.readStream.schema("item long, n long").option("maxFilesPerTrigger", 1).parquet(src)
    for c in ("c1", "c2"):
        tables.ingest_job(feed(), held, str(tmp_path / c), ["item"], ["n"], 4).awaitTermination()
    first = rows(spark.read.parquet(held), "item", "n")
    assert first == [(n, n) for n in range(7)]
    shutil.rmtree(f"{tmp_path}/c1/commits")  # all batches of a job come again
    tables.ingest_job(feed(), held, str(tmp_path / "c1"), ["item"], ["n"], 4).awaitTermination()
    assert rows(spark.read.parquet(held), "item", "n") == first


def test_seeded_index(spark, tmp_path):
    """States are combined with new events only, without any log; what is missing is an error then, or read from the log."""
    e = events(spark, 60, 3).withColumn("category", F.lit("User"))
    lift, combine = F.array(F.col("idx")), lambda a, b: F.concat(a, b)
    want = lambda n: rows(e.where(f"idx < {n}").groupBy("stream").agg((F.max("idx") + 1).alias("version"), F.array_sort(F.collect_list("idx")).alias("state")))
    kind = spark.createDataFrame([], "stream string, version long, state array<long>").schema
    src, view = str(tmp_path / "src"), str(tmp_path / "view")
    job = lambda log_path=None: tables.seeded_index_job(log.tail_log(spark, src, max_files=1), view, lift, combine, str(tmp_path / "c"), log_path, 4).awaitTermination()
    _parts(e, src, ["idx < 5", "idx >= 3 and idx < 9", "idx < 2", "idx >= 9 and idx < 12"])
    job()
    assert rows(sinks.read_view(spark, view, kind)) == want(12)
    full = str(tmp_path / "log")
    e.write.partitionBy("category").parquet(full)
    _parts(e, src, ["idx >= 15 and idx < 18"])
    with pytest.raises(Exception, match="missing"):
        job()
    job(full)
    got = {r.stream: r for r in sinks.read_view(spark, view, kind).collect()}
    assert all(r.version == len(r.state) and r.state == list(range(r.version)) for r in got.values()) and max(r.version for r in got.values()) >= 18


def test_filters(spark):
    df = spark.createDataFrame([("$Todo-1", "$Todo", "{}"), ("Todo-1", "Todo", "{}"), ("Todos-2", "Todos", "no"), ("x_checkpoint", "x_checkpoint", "{}")], "stream string, category string, data string")
    assert rows(filters.stream_filter(df, ["Todo"]), "stream") == [("Todo-1",)]
    assert rows(filters.stream_filter(df, ["Tod.*"]), "stream") == [("Todo-1",), ("Todos-2",)]
    assert rows(filters.stream_filter(df, ["Tod."], include_indexes=True, deny_streams=["2$"]), "stream") == [("$Todo-1",), ("Todo-1",)]
    assert rows(filters.guard_payload(df), "stream") == [("Todo-1",), ("x_checkpoint",)]
    assert rows(filters.sync_filter(df), "stream") == [("$Todo-1",), ("Todo-1",), ("Todos-2",)]
    more = spark.createDataFrame([(n, n.split("-")[0]) for n in ("PurchaseOrder-5791", "PurchaseOrder-5792", "Inventory-1", "InventoryLog5", "#serial1")], "stream string, category string")
    assert rows(filters.sync_filter(more), "stream") == [("PurchaseOrder-5792",)]
    assert rows(filters.sync_filter(more, exclude_long=False), "stream") == [("Inventory-1",), ("InventoryLog5",), ("PurchaseOrder-5792",)]
    assert rows(filters.sync_filter(more, long_only=True), "stream") == [("Inventory-1",), ("InventoryLog5",)]
    assert rows(filters.sync_filter(more, allow=["PurchaseOrder"], long_only=True), "stream") == [("PurchaseOrder-5791",), ("PurchaseOrder-5792",)]
    assert rows(filters.sync_filter(more, deny=["PurchaseOrder"]), "stream") == [("#serial1",), ("Inventory-1",), ("InventoryLog5",)]
    with pytest.raises(ValueError, match="exclude"):
        filters.sync_filter(df, deny=["a"], allow=["b"])


def test_codec_round_trip(spark):
    shape = "transaction string, container string, shipments array<string>, amount decimal(18,2)"
    df = spark.createDataFrame([("t", None, ["a", "b"], None), (None, "c", [], None)], shape)
    back = df.select(F.from_json(F.to_json(F.struct("*")), shape).alias("e")).select("e.*")
    assert rows(back) == rows(df)


def _parts(e, path, bounds):
    for n, b in enumerate(bounds):
        e.where(b).coalesce(1).write.mode("append").parquet(path)


def _drain(df, out, checkpoint):
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def _until(df, out, checkpoint, n):
    """Run with timers until n rows have come out."""
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            if glob.glob(f"{out}/part-*") and df.sparkSession.read.schema(df.schema).parquet(out).count() >= n:
                return
        raise AssertionError("nothing came")
    finally:
        q.stop()


def test_stuck_from_the_first_event(spark, tmp_path):
    """Events that go on coming don't put the end off, and what is stuck can still complete."""
    src, out = str(tmp_path / "src"), str(tmp_path / "o1")
    e = events(spark, 40, 2).withColumn("event_type", F.lit("Begun"))
    e.where("idx < 1").coalesce(1).write.mode("append").parquet(src)
    q = stateful.watch(spark.readStream.schema(schema.EVENT_LOG).parquet(src), 4000).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c1")).trigger(processingTime="200 milliseconds").start()
    seen = lambda: rows(spark.read.schema("stream string, status string").parquet(out).distinct()) if glob.glob(f"{out}/part-*") else []
    try:
        for n in range(1, 60):
            time.sleep(0.5)
            e.where(f"idx = {n % 20} and stream = 'User-0'").coalesce(1).write.mode("append").parquet(src)
            if ("User-0", "Stuck") in seen():
                break
        assert seen() == [("User-0", "Active"), ("User-0", "Stuck"), ("User-1", "Active"), ("User-1", "Stuck")]
        e.where("idx = 19 and stream = 'User-1'").withColumn("event_type", F.lit("Completed")).coalesce(1).write.mode("append").parquet(src)
        for _ in range(60):
            time.sleep(0.5)
            if ("User-1", "Complete") in seen():
                break
        assert ("User-1", "Complete") in seen()
    finally:
        q.stop()


def test_idle_fold(spark, tmp_path):
    """State that was let go isn't made up anew: a stream that goes on later is reported, one that begins later is folded."""
    src, out, c = (str(tmp_path / x) for x in ("src", "out", "c"))
    e = events(spark, 20, 3)
    stream = lambda: stateful.fold_stream(spark.readStream.schema(schema.EVENT_LOG).parquet(src), 0, lambda s, x: s + 1, ["data"], idle_ms=200)
    run = lambda: stateful.run_until_drained(stream().writeStream.format("parquet").option("path", out).option("checkpointLocation", c))
    _parts(e.where("stream != 'User-2'"), src, ["idx < 3"])
    run()
    assert sorted((r.stream, r.version, r.state) for r in spark.read.parquet(out).collect()) == [("User-0", 3, "3"), ("User-1", 3, "3")]
    _parts(e.where("stream != 'User-1'"), src, ["idx >= 3 or stream = 'User-2'"])
    run()
    n = e.where("stream = 'User-2'").count()
    assert sorted((r.stream, r.version, r.state) for r in spark.read.parquet(out).collect() if r.version != 3) == [("User-0", None, None), ("User-2", n, str(n))]


def test_stream_equals_batch(spark, tmp_path):
    src, log_path, view = (str(tmp_path / x) for x in ("src", "log", "view"))
    e = events(spark)
    fold = lambda df: folds.versions(df)
    _parts(e, src, ["idx < 3", "idx between 3 and 5", "idx > 5"])
    tables.append_job(log.tail_log(spark, src, max_files=1), log_path, str(tmp_path / "c1")).awaitTermination()
    tables.index_job(log.tail_log(spark, src, max_files=1), log_path, view, fold, str(tmp_path / "c2")).awaitTermination()
    assert log.read_log(spark, log_path).count() == 40
    assert rows(sinks.read_view(spark, view, fold(e).schema)) == rows(fold(e))
    tables.append_job(log.tail_log(spark, src), log_path, str(tmp_path / "c3")).awaitTermination()  # a replay from the start
    assert log.read_log(spark, log_path).count() == 40


def test_handler_positions(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    e = events(spark)
    handler = lambda df: df.groupBy("stream").agg(F.count(F.lit(1)).alias("outcome"), (F.max("idx") + 1).alias("next_idx"))
    _parts(e, src, ["idx < 4", "idx < 8"])
    tables.handler_job(log.tail_log(spark, src, max_files=1), handler, str(tmp_path / "pos"), out, str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(out).agg(F.sum("outcome")).first()[0] == 40


@pytest.mark.parametrize("lost", ["before positions move", "after positions move"])
def test_handler_lost_midway(spark, tmp_path, monkeypatch, lost):
    """A job that is lost between its two writes, or after both, handles nothing twice and loses nothing."""
    src, out, c = (str(tmp_path / x) for x in ("src", "out", "c"))
    e = events(spark)
    handler = lambda df: df.groupBy("stream").agg(F.count(F.lit(1)).alias("outcome"), (F.max("idx") + 1).alias("next_idx"))
    job = lambda: tables.handler_job(log.tail_log(spark, src, max_files=1), handler, str(tmp_path / "pos"), out, c).awaitTermination()
    _parts(e, src, ["idx < 4", "idx < 8"])
    whole = sinks.upsert_view

    def fails(*args):
        if lost.startswith("after"):
            whole(*args)
        raise RuntimeError("lost")

    monkeypatch.setattr(sinks, "upsert_view", fails)
    with pytest.raises(Exception, match="lost"):
        job()
    monkeypatch.setattr(sinks, "upsert_view", whole)
    job()
    assert spark.read.parquet(out).agg(F.sum("outcome")).first()[0] == 40


def test_stateful_fold_and_restart(spark, tmp_path):
    src, out, c = (str(tmp_path / x) for x in ("src", "out", "c"))
    e = events(spark)
    stream = lambda: stateful.fold_stream(spark.readStream.schema(schema.EVENT_LOG).parquet(src), 0, lambda s, x: s + int(json.loads(x["data"])["id"]), ["data"])
    _parts(e, src, ["idx < 5"])
    _drain(stream(), out, c)
    _parts(e, src, ["idx >= 2"])  # some events come again
    _drain(stream(), out, c)
    got = spark.read.parquet(out).groupBy("stream").agg(F.max("version"), F.max_by("state", "version").cast("int"))
    assert rows(got) == rows(e.groupBy("stream").agg(F.max("idx") + 1, F.sum(F.get_json_object("data", "$.id").cast("long")).cast("int")))


def test_gaps_wait(spark, tmp_path):
    src, out, c = (str(tmp_path / x) for x in ("src", "out", "c"))
    e = events(spark, 10, 1)
    stream = lambda: stateful.in_sequence(spark.readStream.schema(schema.EVENT_LOG).parquet(src), ["event_type"])
    _parts(e, src, ["idx in (0, 1, 4, 5)"])
    _drain(stream(), out, c)
    assert sorted(r.idx for r in spark.read.parquet(out).collect()) == [0, 1]
    _parts(e, src, ["idx in (2, 3, 7)"])
    _drain(stream(), out, c)
    got = spark.read.parquet(out)
    assert sorted(r.idx for r in got.collect()) == [0, 1, 2, 3, 4, 5]
    assert got.where("idx = 5").first().parked == 1


def test_sequence_and_chunks(spark, tmp_path):
    src = str(tmp_path / "src")
    e = events(spark, 20, 2)
    _parts(e, src, ["idx < 4"])
    numbered = lambda: stateful.sequence(spark.readStream.schema(schema.EVENT_LOG).parquet(src), "stream", ["ts"])
    chunks = lambda: stateful.take_chunks(spark.readStream.schema(schema.EVENT_LOG).parquet(src), "event_type", 3)
    drained = lambda: stateful.run_until_drained(chunks().writeStream.format("parquet").option("path", str(tmp_path / "o2")).option("checkpointLocation", str(tmp_path / "c2")))
    _drain(numbered(), str(tmp_path / "o1"), str(tmp_path / "c1"))
    drained()
    assert sorted((r.idx, r.next_idx) for r in spark.read.parquet(str(tmp_path / "o2")).where("stream = 'User-0'").collect()) == [(0, 3), (1, 3), (2, 3), (3, 4)]
    _parts(e, src, ["idx >= 4"])
    _drain(numbered(), str(tmp_path / "o1"), str(tmp_path / "c1"))
    drained()
    assert rows(spark.read.parquet(str(tmp_path / "o1")).groupBy("stream").agg(F.max("idx"), F.count_distinct("idx"))) == [("User-0", 9, 10), ("User-1", 9, 10)]
    assert sorted(r.idx for r in spark.read.parquet(str(tmp_path / "o2")).where("stream = 'User-0'").collect()) == list(range(10))


def test_watch(spark, tmp_path):
    src, out, c = (str(tmp_path / x) for x in ("src", "out", "c"))
    e = events(spark, 6, 3).withColumn("event_type", F.when(F.col("stream") == "User-1", "Completed").otherwise("Begun"))
    _parts(e, src, ["true"])
    _until(stateful.watch(spark.readStream.schema(schema.EVENT_LOG).parquet(src), 60_000), out, c, 3)
    assert rows(spark.read.parquet(out)) == [("User-0", "Active"), ("User-1", "Complete"), ("User-2", "Active")]


def test_messages_from_files(spark, tmp_path):
    src = str(tmp_path / "m")
    spark.createDataFrame([("k", "v", 0, 1)], "key string, value string, partition int, offset long").write.parquet(src)
    assert log.read_messages(spark, path=src).select("key", "value").first() == ("k", "v")

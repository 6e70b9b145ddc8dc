"""Sinks with state and streams, over logs that are written from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, folds
from ..schema import EVENT_LOG
from ..sources import log, sinks
from ..sources.work import work_path
from ..streaming import metrics, stateful, tables
from .base import EV, ev, query, table


def as_log(spark: SparkSession, sf: str) -> DataFrame:
    """The events as rows of the log layout."""
    e = ev(spark, sf).withColumns({"stream_id": F.col("user_id").cast("string"), "tranche": (F.col("user_id") % 8).cast("string"), "size": F.octet_length("data").cast("long"), "is_unfold": F.lit(False)})
    return e.select(*[F.col(f.name) if f.name in e.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], EVENT_LOG).schema])


def _written(spark: SparkSession, sf: str, *parts: str) -> str:
    """A log in which each part, by a condition, is a write of its own."""
    path, rows = work_path(spark, "log"), as_log(spark, sf)
    for part in parts:
        rows.where(part).write.mode("append").parquet(path)
    return path


def _tail(spark: SparkSession, path: str, triggers: int, categories: list[str] | None = None) -> DataFrame:
    """A feed of all that a log holds in so many triggers, whatever its size."""
    return log.tail_log(spark, path, categories=categories, max_files=log.files_each(spark, path, triggers))


def _drained(stream: DataFrame) -> DataFrame:
    out, spark = work_path(stream.sparkSession, "stream-out"), stream.sparkSession
    log.run_until_caught_up(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", work_path(spark, "stream-state")))
    return spark.read.schema(stream.schema).parquet(out)


@query(f"WITH {EV} SELECT stream, count(*) AS n, max(idx) AS last_idx FROM ev WHERE user_id % 8 < 4 GROUP BY 1")
def log_append_read(spark: SparkSession, sf: str) -> DataFrame:
    """A log that is appended in two overlapping batches holds each event once; some tranches are read."""
    path, rows = work_path(spark, "log"), as_log(spark, sf)
    sinks.append_events(rows.where("idx < 30"), path)
    sinks.append_events(rows, path)
    read = log.read_log(spark, path, categories=["User"], tranches=["0", "1", "2", "3"])
    return read.groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.max("idx").alias("last_idx"))


@query(f"WITH {EV} SELECT stream, max(idx) + 1 AS version, count(*) AS n FROM ev GROUP BY 1")
def view_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """A view after a newer and then an older state of each stream."""
    path, rows = work_path(spark, "view"), as_log(spark, sf)
    view = lambda df: df.groupBy("stream").agg((F.max("idx") + 1).alias("version"), F.count(F.lit(1)).alias("n"))
    sinks.upsert_view(view(rows.where("idx < 10")), path, ["stream"])
    sinks.upsert_view(view(rows), path, ["stream"])
    sinks.upsert_view(view(rows.where("idx < 20")), path, ["stream"])
    return sinks.read_view(spark, path, view(rows).schema)


@query(f"WITH {EV} SELECT stream, count(*) AS n, sum(idx)::BIGINT AS sum_idx FROM ev GROUP BY 1")
def dump_read(spark: SparkSession, sf: str) -> DataFrame:
    """Events of JSON lines."""
    path = work_path(spark, "dump")
    as_log(spark, sf).select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return log.read_dump(spark, path).groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.sum("idx").alias("sum_idx"))


@query("SELECT user_id % 8 AS partition, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
def message_files(spark: SparkSession, sf: str) -> DataFrame:
    """Messages from files, in the columns that a broker has."""
    path = work_path(spark, "messages")
    e = table(spark, sf, "events")
    e.select(F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"), (F.col("user_id") % 8).cast("int").alias("partition"), F.col("event_id").alias("offset"), F.col("ts").alias("timestamp")).write.parquet(path)
    return log.read_messages(spark, path=path).groupBy(F.col("partition").cast("long").alias("partition")).agg(F.count(F.lit(1)).alias("n"), F.max("offset").alias("last"))


@query(f"WITH {EV} SELECT stream, max(idx) + 1 AS version, sum(k)::BIGINT AS state FROM ev GROUP BY 1")
def stream_fold(spark: SparkSession, sf: str) -> DataFrame:
    """A fold with state over a tailed log, some of which is delivered twice."""
    tail = _tail(spark, _written(spark, sf, "idx < 20", "idx >= 10"), 4, ["User"])
    body = tail.withColumn("k", F.get_json_object("data", "$.k").cast("long"))
    states = _drained(stateful.fold_stream(body, 0, lambda s, e: s + int(e["k"]), ["k"]))
    return states.groupBy("stream").agg(F.max("version").alias("version"), F.max_by("state", "version").cast("long").alias("state"))


@query(f"WITH {EV} SELECT stream, idx, event_type FROM ev")
def stream_in_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """M3: odd indexes come first and wait; all come out in sequence."""
    released = _drained(stateful.in_sequence(_tail(spark, _written(spark, sf, "idx % 2 = 1", "idx % 2 = 0"), 4), ["event_type"]))
    return released.where("idx is not null").select("stream", "idx", "event_type")


@query("SELECT stream, count(*) AS n, max(idx) AS last_idx, count(DISTINCT idx) AS distinct_idx FROM (SELECT concat('User-', user_id) AS stream, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx FROM events) GROUP BY 1")
def stream_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """Indexes go on across batches."""
    numbered = _drained(stateful.sequence(_tail(spark, _written(spark, sf, "idx < 20", "idx >= 20"), 4), "stream", ["position"]))
    return numbered.groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.max("idx").alias("last_idx"), F.countDistinct("idx").alias("distinct_idx"))


@query(f"WITH {EV}, n AS (SELECT stream, max(idx) + 1 AS n FROM ev GROUP BY 1) SELECT stream, idx, event_type AS item, least((idx // 15 + 1) * 15, n) AS next_idx FROM ev JOIN n USING (stream)")
def stream_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Fifteen events of a stream are taken at each trigger, until all have come; each tells the position after its chunk."""
    out = work_path(spark, "chunks")
    chunks = stateful.take_chunks(log.tail_log(spark, _written(spark, sf, "true")), "event_type", 15)
    stateful.run_until_drained(chunks.writeStream.format("parquet").option("path", out).option("checkpointLocation", work_path(spark, "chunk-state")))
    return spark.read.schema(chunks.schema).parquet(out)


@query(f"WITH {EV} SELECT stream, count(*) AS handled, max(idx) + 1 AS version FROM ev GROUP BY 1")
def stream_handler(spark: SparkSession, sf: str) -> DataFrame:
    """A handler's positions leave out what is delivered again."""
    positions, out = work_path(spark, "positions"), work_path(spark, "handled")
    handler = lambda df: df.groupBy("stream").agg(F.count(F.lit(1)).alias("handled"), (F.max("idx") + 1).alias("next_idx"))
    for source in (_written(spark, sf, "idx < 25"), _written(spark, sf, "true")):
        tables.handler_job(log.tail_log(spark, source), handler, positions, out, work_path(spark, "handler-state")).awaitTermination()
    done = spark.read.parquet(out).groupBy("stream").agg(F.sum("handled").alias("handled"))
    return done.join(sinks.read_view(spark, positions, spark.createDataFrame([], "stream string, version long").schema), "stream")


@query(f"WITH {EV} SELECT stream, max(idx) + 1 AS version FROM ev GROUP BY 1")
def stream_index(spark: SparkSession, sf: str) -> DataFrame:
    """A log archived as a stream, twice, and views kept over the copy."""
    source, copy, view = _written(spark, sf, "idx < 25", "idx >= 25"), work_path(spark, "copy"), work_path(spark, "view")
    for _ in range(2):
        tables.append_job(log.tail_log(spark, source), copy, work_path(spark, "append-state")).awaitTermination()
    tables.index_job(log.tail_log(spark, source), copy, view, folds.versions, work_path(spark, "index-state")).awaitTermination()
    return sinks.read_view(spark, view, spark.createDataFrame([], "stream string, version long").schema)


@query(f"WITH {EV} SELECT stream, count(*) AS n, CAST(0 AS BIGINT) AS bodies, max(CASE WHEN event_type = 'click' THEN 'Clicked' ELSE event_type END) AS last_type FROM ev GROUP BY 1")
def stream_parsed(spark: SparkSession, sf: str) -> DataFrame:
    """A feed through a parser of the caller's own, which renames a type and leaves bodies out, into an archive."""
    copy = work_path(spark, "copy")
    parser = lambda df: filters.strip_bodies(df).withColumn("event_type", F.when(F.col("event_type") == "click", "Clicked").otherwise(F.col("event_type")))
    tables.append_job(log.tail_log(spark, _written(spark, sf, "idx < 25", "idx >= 25")), copy, work_path(spark, "append-state"), parser).awaitTermination()
    return log.read_log(spark, copy).groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.count("data").alias("bodies"), F.max("event_type").alias("last_type"))


@query(f"WITH {EV} SELECT stream, event_type AS item, count(*) AS n, sum(k)::BIGINT AS total, max(idx) AS last_idx FROM ev WHERE event_type <> 'view' GROUP BY 1, 2")
def stream_entries(spark: SparkSession, sf: str) -> DataFrame:
    """M1, M2: a state with an entry for each type of a stream's events, some delivered twice; views remove theirs."""
    tail = _tail(spark, _written(spark, sf, "idx < 20", "idx >= 10"), 4, ["User"])
    body = tail.withColumn("k", F.get_json_object("data", "$.k").cast("long")).withColumn("item", F.col("event_type"))

    def evolve(value: dict | None, e: dict) -> dict | None:
        if e["event_type"] == "view":
            return None
        held = value or {"n": 0, "total": 0, "last": -1}
        return {"n": held["n"] + 1, "total": held["total"] + int(e["k"]), "last": e["idx"]}

    out = _drained(stateful.fold_entries(body, "item", evolve, ["k"]))
    newest = out.groupBy("stream", "item").agg(F.max_by("value", "version").alias("value")).where("value is not null")
    value = F.from_json("value", "n long, total long, last long")
    return newest.select("stream", "item", value["n"].alias("n"), value["total"].alias("total"), value["last"].alias("last_idx"))


@query(f"WITH {EV} SELECT stream, CASE WHEN bool_or(event_type = 'purchase') THEN 'Complete' ELSE 'Stuck' END AS status, CAST(0 AS BIGINT) AS kept FROM ev GROUP BY 1")
def stream_watch(spark: SparkSession, sf: str) -> DataFrame:
    """M5, M8: users without a purchase get stuck when their time is up; no state is kept when it has served."""
    out, state = work_path(spark, "watched"), work_path(spark, "watch-state")
    watched = stateful.watch(log.tail_log(spark, _written(spark, sf, "true")), 1000, terminal="purchase", keep_ms=500)
    kept = stateful.run_until_drained(watched.writeStream.format("parquet").option("path", out).option("checkpointLocation", state))
    ends = spark.read.schema(watched.schema).parquet(out).groupBy("stream").agg(F.max(F.col("status") == "Complete").alias("done"))
    return ends.select("stream", F.when(F.col("done"), "Complete").otherwise("Stuck").alias("status"), F.lit(kept).cast("long").alias("kept"))


@query(f"WITH {EV} SELECT stream, least(count(*), 20) AS version, sum(k) FILTER (idx < 20)::BIGINT AS state, count(*) > 20 AS to_refold FROM ev GROUP BY 1")
def stream_idle(spark: SparkSession, sf: str) -> DataFrame:
    """M8: states that get nothing for a while are let go; streams that go on later are named, to be folded from their log."""
    source, out, state = work_path(spark, "log"), work_path(spark, "idle"), work_path(spark, "idle-state")
    rows = as_log(spark, sf)
    for part in ("idx < 20", "idx >= 20"):
        rows.where(part).write.mode("append").parquet(source)
        body = log.tail_log(spark, source).withColumn("k", F.get_json_object("data", "$.k").cast("long"))
        states = stateful.fold_stream(body, 0, lambda s, e: s + int(e["k"]), ["k"], idle_ms=300)
        stateful.run_until_drained(states.writeStream.format("parquet").option("path", out).option("checkpointLocation", state))
    got = spark.read.schema(states.schema).parquet(out)
    return got.groupBy("stream").agg(F.max("version").alias("version"), F.max_by("state", "version").cast("long").alias("state"), F.max(F.col("version").isNull()).alias("to_refold"))


@query(f"""WITH {EV}, p AS (SELECT *, CASE WHEN idx < 10 THEN 0 WHEN idx < 20 THEN 1 ELSE 2 END AS batch, CAST(user_id % 8 AS VARCHAR) AS tranche FROM ev),
b AS (SELECT unnest(range(3)) AS batch), t AS (SELECT tranche, max(position) AS head FROM p GROUP BY 1),
s AS (SELECT batch, count(*) AS spans, max(n) AS largest FROM (SELECT batch, stream, count(*) AS n FROM p GROUP BY 1, 2) GROUP BY 1)
SELECT b.batch, t.tranche, count(p.position) FILTER (p.batch = b.batch) AS events, coalesce(max(p.position), -1) AS committed, t.head, t.head - coalesce(max(p.position), -1) AS lag, any_value(s.spans) AS spans, any_value(s.largest) AS largest
FROM b CROSS JOIN t JOIN s ON s.batch = b.batch LEFT JOIN p ON p.tranche = t.tranche AND p.batch <= b.batch GROUP BY b.batch, t.tranche, t.head""")
def stream_lag(spark: SparkSession, sf: str) -> DataFrame:
    """Lag of each tranche and sizes of spans after each of three batches, observed while the batches run."""
    path, spans, sizes, state, rows = work_path(spark, "log"), work_path(spark, "spans"), work_path(spark, "span-sizes"), work_path(spark, "lag-state"), as_log(spark, sf)
    tranches = [str(n) for n in range(8)]
    listener = metrics.LagListener("feed", tranches, metrics.heads_of(rows))

    def handle(batch: DataFrame, number: int) -> None:
        metrics.write_spans(batch, number, lambda s: s.write.mode("overwrite").parquet(f"{spans}/batch={number}"), sizes)

    for part in ("idx < 10", "idx >= 10 and idx < 20", "idx >= 20"):  # a run of the feed takes what the log has got since the one before it, in as many files as there are
        rows.where(part).write.mode("append").parquet(path)
        feed = metrics.observed(log.tail_log(spark, path), "feed", tranches)
        lag = metrics.with_lag(lambda feed=feed: tables.run_batches(feed, handle, state), spark, listener)
    return lag.join(metrics.read_spans(spark, sizes).select("batch", "spans", "largest"), "batch")


@query(f"WITH {EV} SELECT stream, max(idx) + 1 AS version, count(*) AS n, sum(k)::BIGINT AS total, arg_max(event_type, idx) AS last_type FROM ev GROUP BY 1")
def stream_seeded_index(spark: SparkSession, sf: str) -> DataFrame:
    """Views over many small batches, some delivered twice, that never read the log: states are combined with the batch's own."""
    source = _written(spark, sf, *[f"idx >= {a} and idx < {b}" for a, b in ((0, 8), (4, 16), (16, 24), (20, 40))], "idx >= 40")
    tail = _tail(spark, source, 5, ["User"]).withColumn("k", F.get_json_object("data", "$.k").cast("long"))
    lift = F.struct(F.lit(1).cast("long").alias("n"), F.col("k").alias("total"), F.col("event_type").alias("last_type"))
    combine = lambda a, b: F.struct((a["n"] + b["n"]).alias("n"), (a["total"] + b["total"]).alias("total"), b["last_type"].alias("last_type"))
    view = work_path(spark, "view")
    tables.seeded_index_job(tail, view, lift, combine, work_path(spark, "index-state"), source, buckets=8).awaitTermination()
    rows = sinks.read_view(spark, view, spark.createDataFrame([], "stream string, version long, state struct<n:long,total:long,last_type:string>").schema)
    return rows.select("stream", "version", "state.*")


@query(f"WITH {EV} SELECT stream, count(*) AS n, max(idx) AS last_idx, count(DISTINCT idx) AS distinct_idx FROM ev GROUP BY 1")
def stream_append(spark: SparkSession, sf: str) -> DataFrame:
    """K1, L1, M7: a log archived in batches of which some overlap, by heads of its streams; twice, by two jobs."""
    source, copy, heads = _written(spark, sf, "idx < 15", "idx >= 10 and idx < 25", "idx >= 20"), work_path(spark, "copy"), work_path(spark, "heads")
    for _ in range(2):
        tables.append_job(_tail(spark, source, 3), copy, work_path(spark, "append-state"), heads=heads, buckets=8).awaitTermination()
    return log.read_log(spark, copy).groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.max("idx").alias("last_idx"), F.countDistinct("idx").alias("distinct_idx"))


@query("SELECT user_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events GROUP BY ALL")
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Items of a feed, each held once, whatever batch brings it again; twice, by two jobs."""
    source, held = _written(spark, sf, "idx < 20", "idx >= 15"), work_path(spark, "held")
    for _ in range(2):
        items = _tail(spark, source, 2).select(F.col("stream_id").cast("long").alias("user_id"), F.get_json_object("data", "$.k").cast("int").alias("k"), "position")
        tables.ingest_job(items, held, work_path(spark, "ingest-state"), ["user_id", "k"], ["position"], buckets=8).awaitTermination()
    return spark.read.parquet(held).select("user_id", "k")

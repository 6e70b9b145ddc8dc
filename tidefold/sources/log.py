"""Sources: event logs, feeds, dumps, legacy documents, envelopes and crawls as event rows."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.streams import parse_stream
from ..operators.running import ordinals
from ..schema import EVENT_LOG, SPAN


def _wanted(df: DataFrame, categories: Iterable[str] | None, streams: Iterable[str] | None, tranches: Iterable[str] | None) -> DataFrame:
    for column, values in (("category", categories), ("stream", streams), ("tranche", tranches)):
        if values is not None:
            df = df.where(F.col(column).isin(*values))
    return df


def read_log(spark: SparkSession, path: str, categories: Iterable[str] | None = None, streams: Iterable[str] | None = None, tranches: Iterable[str] | None = None) -> DataFrame:
    """Events of the given categories, streams and tranches; on logs partitioned by category only their files are read."""
    rows = spark.read.schema(EVENT_LOG).parquet(path)
    return _wanted(rows.select(*[f.name for f in T.StructType.fromDDL(EVENT_LOG)]), categories, streams, tranches)


def tail_log(spark: SparkSession, path: str, categories: Iterable[str] | None = None, tranches: Iterable[str] | None = None, max_files: int | None = None, fmt: str = "parquet", schema: str = EVENT_LOG, **options: str) -> DataFrame:
    """A continuous feed of a log; positions are kept in the query's checkpoint, one for each consumer group."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _wanted(reader.load(path), categories, None, tranches)


def files_each(spark: SparkSession, path: str, triggers: int, fmt: str = "parquet", schema: str = EVENT_LOG) -> int:
    """The ``max_files`` with which what a log holds now is taken in so many triggers at most, however many files it has.

    Each trigger opens the state of all partitions, whatever it brings: with a fixed number of files, the cost of a
    backlog grows with its files times its state.
    """
    return max(1, -(-len(spark.read.format(fmt).schema(schema).load(path).inputFiles()) // triggers))


def run_until_caught_up(query) -> None:
    """Start a stream writer, handle all that is there, and stop at the tail (S3)."""
    query.trigger(availableNow=True).start().awaitTermination()


def from_position(df: DataFrame, start: int | str | float | datetime | timedelta, position: str = "position", ts: str = "ts", as_of: datetime | None = None) -> DataFrame:
    """Rows from a start position.

    ``"start"``: all; ``"tail"``: none of those that are there now; an integer: that position and later;
    a float from 0 to 1: that share of the head's position and later; a time: events of it and later; an interval:
    those of so long before ``as_of`` (now, if not given) and later. Times are filters that reach the scan.
    """
    if isinstance(start, timedelta):
        start = (as_of or datetime.now(timezone.utc)) - start
    if isinstance(start, datetime):
        return df.where(F.col(ts) >= F.lit(start))
    if start == "start":
        return df
    if isinstance(start, int):
        return df.where(F.col(position) >= start)
    head = df.agg(F.max(position).alias("_head"))
    bound = F.col("_head") if start == "tail" else F.col("_head") * F.lit(float(start))
    compared = F.col(position) > bound if start == "tail" else F.col(position) >= bound
    return df.join(F.broadcast(head), compared, "left_semi")  # the head is one row


def read_dump(spark: SparkSession, path: str, skip: int = 0, truncate: int | None = None, strict: bool = True) -> DataFrame:
    """Events of a dump with one JSON document per line.

    The dump is cut at line ``truncate`` first, then ``skip`` lines are left out; lines that begin with
    ``#`` are comments. A line that isn't an event document fails with its number; with
    ``strict=False`` such lines come out with a null stream and their text in ``bad``.
    Lines are numbered by split of a file and by what its earlier splits hold, so a large file is read by many tasks.
    """
    lines = spark.read.text(path).withColumns({"file": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start"), "seq": F.monotonically_increasing_id()})
    own = F.row_number().over(Window.partitionBy("file", "block").orderBy("seq"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = lines.groupBy("file", "block").count().select("file", "block", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    numbered = lines.withColumn("own", own).join(before, ["file", "block"]).withColumn("line", F.col("own") + F.col("before")).drop("own", "before")
    if truncate is not None:
        numbered = numbered.where(F.col("line") <= truncate)
    numbered = numbered.where((F.col("line") > skip) & ~F.col("value").rlike(r"^\s*#"))
    parsed = numbered.withColumn("doc", F.from_json("value", EVENT_LOG))
    bad = F.col("doc").isNull() | F.col("doc.stream").isNull()
    if strict:
        said = F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(" isn't an event: "), F.substr("value", F.lit(1), F.lit(80)))
        return parsed.withColumn("doc", F.when(bad, F.raise_error(said)).otherwise(F.col("doc"))).select("line", "doc.*")
    return parsed.select("line", "doc.*", F.when(bad, F.col("value")).alias("bad"))


def read_legacy(docs: DataFrame) -> DataFrame:
    """Event rows of flat documents with s (stream), c (created), t (type), i (index), d (data)."""
    data = F.col("d").cast("string") if docs.schema["d"].dataType.simpleString() in ("string", "binary") else F.to_json("d")
    rows = docs.select(F.col("s").alias("stream"), F.col("i").cast("long").alias("idx"), F.col("t").alias("event_type"), data.alias("data"), F.col("c").cast("timestamp").alias("ts"))
    return parse_stream(rows).drop("id_parts")


def explode_envelope(messages: DataFrame, value: str = "value") -> DataFrame:
    """One row for each event of span messages {s, i, e: [{c, t, d, m}]}."""
    span = messages.select(F.from_json(value, SPAN).alias("v"))
    rows = span.select(F.col("v.s").alias("stream"), F.col("v.i").alias("first"), F.posexplode("v.e").alias("pos", "e"))
    events = rows.select("stream", (F.col("first") + F.col("pos")).alias("idx"), F.col("e.c").alias("event_type"), F.col("e.t").alias("ts"), F.col("e.d").alias("data"), F.col("e.m").alias("meta"))
    return parse_stream(events).drop("id_parts")


def sequence_messages(messages: DataFrame, key: str = "key", *order: str) -> DataFrame:
    """Give messages without versions an index within their key, from 0, in partition and offset order."""
    return ordinals(messages, [key], list(order or ("partition", "offset")), "idx")


def crawl_to_events(crawl: DataFrame, category: str = "Ticket") -> DataFrame:
    """Each row {id, lastUpdated, body} of a full crawl as an event of its own stream."""
    return crawl.select(F.concat(F.lit(f"{category}-"), F.col("id")).alias("stream"), F.lit(category).alias("category"), F.col("id").alias("stream_id"), F.col("lastUpdated").alias("ts"), F.col("body").alias("data"), F.lit("Crawled").alias("event_type"))


def raw_passthrough(docs: DataFrame, partition: str = "p") -> DataFrame:
    """(key, value) of raw documents, without an order within streams."""
    return docs.select(F.col(partition).cast("string").alias("key"), F.to_json(F.struct("id")).alias("value"))


def read_messages(spark: SparkSession, fmt: str = "parquet", streaming: bool = False, **options: str) -> DataFrame:
    """Messages with key, value, partition and offset: from Kafka where its connector is there, else from files."""
    if fmt == "kafka":
        reader = spark.readStream if streaming else spark.read
        rows = reader.format("kafka").options(**{"startingOffsets": "earliest"} | options).load()
        return rows.select(F.col("key").cast("string"), F.col("value").cast("string"), "partition", "offset", "timestamp")
    schema = "key string, value string, partition int, offset long, timestamp timestamp"
    path = options.pop("path")
    reader = (spark.readStream if streaming else spark.read).format(fmt).schema(schema).options(**options)
    return reader.load(path)

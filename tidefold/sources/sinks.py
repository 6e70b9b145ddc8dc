"""Sinks: idempotent appends, version-gated views, envelopes, deletions, bounded writes.

Plain Parquet has no transactions. Appends add files and are idempotent by key; views are partitioned by
buckets of their keys, and a batch overwrites those that it touches. One query writes a view at a time.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.decisions import version_gate
from ..operators.running import in_pages, ordinals, written

BUCKETS = 64


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").option("pathGlobFilter", "_SUCCESS").load(path).schema  # noqa: B018
    except AnalysisException:
        return False
    return True


def touched(log: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows of a log, partitioned by category, that belong to streams of a batch: only their categories' files are read."""
    categories = [r[0] for r in batch.select("category").distinct().collect()]  # as many as there are kinds of streams
    own = log.where(F.col("category").isin([c for c in categories if c is not None]) | (F.col("category").isNull() if None in categories else F.lit(False)))
    return own.join(batch.select("stream").distinct(), "stream", "left_semi")


def append_events(df: DataFrame, path: str, contiguous: bool = True) -> int:
    """Append the events whose (stream, idx) the log lacks; returns how many (K1).

    With ``contiguous``, events that would leave a gap after a stream's last index are not appended;
    they can come again once what precedes them is there. Reads the keys of the categories that it touches; for
    many small batches take ``append_batch``.
    """
    fresh = df.dropDuplicates(["stream", "idx"])
    if exists(df.sparkSession, path):
        held = touched(df.sparkSession.read.parquet(path), fresh).select("stream", "idx")
        fresh = fresh.join(held, ["stream", "idx"], "left_anti")
        heads = held.groupBy("stream").agg((F.max("idx") + 1).alias("_next"))
        fresh = fresh.join(heads, "stream", "left").withColumn("_next", F.coalesce("_next", F.lit(0)))
    else:
        fresh = fresh.withColumn("_next", F.lit(0))
    fresh = (_without_gaps(fresh) if contiguous else fresh).drop("_next").persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").partitionBy("category").parquet(path)
    fresh.unpersist()
    return n


def _without_gaps(fresh: DataFrame) -> DataFrame:
    """Events that follow each other from their stream's ``_next`` on."""
    place = F.row_number().over(Window.partitionBy("stream").orderBy("idx")) - 1
    return fresh.withColumn("_place", place).where(F.col("idx") == F.col("_next") + F.col("_place")).drop("_place")


def append_batch(df: DataFrame, path: str, heads: str, batch: str, buckets: int = BUCKETS) -> int:
    """Append what the log lacks of a numbered batch, by the next index of each stream, kept as a view at ``heads`` (K1, M7).

    Reads the heads of the batch's streams and nothing of the log. The rows are files of the batch's own, so a
    batch that comes again after they were written, whether or not the heads have moved, changes nothing. Events
    that would leave a gap are left out, and can come again later. Returns how many the batch added.
    """
    spark = df.sparkSession
    kind = spark.createDataFrame([], "stream string, version long").schema
    fresh = df.dropDuplicates(["stream", "idx"])
    known = held_rows(fresh.select("stream").distinct(), heads, kind, ["stream"], buckets).select("stream", F.col("version").alias("_next"))
    fresh = fresh.join(known, "stream", "left").withColumn("_next", F.coalesce("_next", F.lit(0))).where(F.col("idx") >= F.col("_next"))
    rows = written(_without_gaps(fresh).drop("_next"), "batch")
    n = rows.count()
    if n:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("category", "batch").parquet(path)
        upsert_view(rows.groupBy("stream").agg((F.max("idx") + 1).alias("version")), heads, ["stream"], buckets=buckets)
    return n


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def read_view(spark: SparkSession, path: str, schema, buckets: Iterable[int] | None = None) -> DataFrame:
    """The rows of a view (N3), or those of some of its buckets, of which alone the files are read.

    Read it anew after each write: a write replaces the files of the buckets that it touches.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    rows = spark.read.schema(f"{kinds}, bucket int").parquet(path)
    return (rows if buckets is None else rows.where(F.col("bucket").isin(list(buckets)))).select(*[f.name for f in schema])


def held_rows(keyed: DataFrame, path: str, schema, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The rows of a view that have the given keys, each once; only their buckets are read."""
    touched = [r[0] for r in keyed.select(_bucket(keys, buckets)).distinct().collect()]  # as many as there are buckets, at most
    schema = keyed.sparkSession.createDataFrame([], schema).schema
    return read_view(keyed.sparkSession, path, schema, touched).join(keyed.select(*keys), keys, "left_semi")


def upsert_view(incoming: DataFrame, path: str, keys: list[str], version: str = "version", buckets: int = BUCKETS) -> DataFrame:
    """Keep the highest version of each key; returns the incoming rows with ``accepted``.

    A view is a Parquet table partitioned by a hash of its keys. Only the buckets to which accepted rows go are
    read and written, by dynamic partition overwrite; what a batch costs follows its buckets, so take as many as
    keep one of them small, and the same number for a view's life. A batch that comes again changes nothing. Writers
    of different buckets don't disturb each other; those of one bucket must be one query, as the last one's
    files stay. A view is derived: one that a lost driver left half replaced is written anew from its log.
    """
    spark = incoming.sparkSession
    rows = written(incoming.withColumn("bucket", _bucket(keys, buckets)), "incoming")
    touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # as many as there are buckets, at most
    decided = written(version_gate(read_view(spark, path, incoming.schema, touched), rows, keys, version), "decided")
    accepted = decided.where("accepted").select(*rows.columns).dropDuplicates(keys)
    changed = [r[0] for r in accepted.select("bucket").distinct().collect()]
    if changed:
        kept = read_view(spark, path, incoming.schema, changed).join(accepted.select(*keys), keys, "left_anti").withColumn("bucket", _bucket(keys, buckets))
        merged = kept.unionByName(accepted).repartition(len(changed), "bucket")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return decided.drop("bucket")


def write_view(rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """Write a view anew, whole: where it is rebuilt, or gets another number of buckets."""
    rows.withColumn("bucket", _bucket(keys, buckets)).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(path)


def to_span_envelopes(df: DataFrame) -> DataFrame:
    """A message per stream with its events in order (K3)."""
    event = F.struct("idx", F.struct(F.col("event_type").alias("c"), F.col("ts").alias("t"), F.col("data").alias("d"), F.col("meta").alias("m")).alias("e"))
    spans = df.groupBy("stream").agg(F.array_sort(F.collect_list(event)).alias("x"))
    return spans.select(F.col("stream").alias("key"), F.to_json(F.struct(F.col("stream").alias("s"), F.col("x")[0]["idx"].alias("i"), F.transform("x", lambda e: e["e"]).alias("e"))).alias("value"))


def to_summary_envelopes(view: DataFrame, tag: str, key: str = "stream") -> DataFrame:
    """A message per stream with its state under a version tag (K4)."""
    rest = [c for c in view.columns if c not in (key, "version")]
    body = F.struct(F.lit(tag).alias("event_type"), F.col("version").alias("version"), F.struct(*rest).alias("value"))
    return view.select(F.col(key).alias("key"), F.to_json(body).alias("value"))


def publish_each(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """One message per event whose type ``mapping`` renames; other events are left out (K5)."""
    name = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[F.col("event_type")]
    return df.where(F.col("event_type").isin(*mapping)).select(F.col("stream").alias("key"), F.to_json(F.struct(name.alias("event_type"), F.col("idx").alias("index"), F.col("data").alias("data"))).alias("value"))


def delete_events(keys: DataFrame, df: DataFrame) -> DataFrame:
    """A log without the given (stream, idx) (K6). Write it as the next generation of the log."""
    return df.join(keys.select("stream", "idx").distinct(), ["stream", "idx"], "left_anti")


def bounded_prefix(df: DataFrame, max_events: int, max_bytes: int, size: str = "size") -> DataFrame:
    """Of each stream what fits in one write: at most so many events and bytes, and at least one event (K7)."""
    order = Window.partitionBy("stream").orderBy("idx")
    place, total = F.row_number().over(order), F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns({"_n": place, "_bytes": total}).where("_n = 1 or (_n <= {} and _bytes <= {})".format(max_events, max_bytes)).drop("_n", "_bytes")


def pages(df: DataFrame, max_events: int, max_bytes: int, size: str = "size") -> DataFrame:
    """Number all writes of each stream under the same bounds, as ``page``.

    A page takes what fits after the one before it, and at least one event. Its end is found by running sums of
    sizes, so a stream of any length is placed in blocks (``in_pages``). A null stream is a stream, a null size 0.
    """
    sizes = df.withColumn("_size", F.coalesce(F.col(size).cast("long"), F.lit(0)))
    numbered = written(ordinals(sizes, ["stream"], ["idx"], "_at", {"_before": F.col("_size")}), "sizes")

    def ends(sums: np.ndarray, _: np.ndarray) -> np.ndarray:
        at = np.arange(len(sums) - 1)
        return np.clip(np.searchsorted(sums, sums[:-1] + max_bytes, "right") - 1, at + 1, at + max_events)

    return in_pages(numbered, ["stream"], "_at", "_before", "_size", max_events, ends).select(*df.columns, F.col("page").cast("int").alias("page"))

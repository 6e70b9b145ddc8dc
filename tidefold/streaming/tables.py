"""Streaming through tables: micro-batches go through the batch operators, state lives in tables (M2, M7).

Delivery is at least once: a batch may come again after a failure. The sinks are idempotent by key, so
a batch that is replayed changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import decisions, filters, folds
from ..operators.running import written
from ..sources import sinks


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Hand micro-batches to ``handle``; with ``available_now`` it ends when the tail is reached (S3)."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _job(checkpoint: str, number: int) -> str:
    """The name of a query's batch, the same whenever it comes again."""
    return f"{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}-{number}"


def append_job(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, heads: str | None = None, buckets: int = sinks.BUCKETS) -> StreamingQuery:
    """Archive or sync as a stream: appends by key and index (L1, L3, K1, M7).

    With ``heads``, a view of the next index of each stream, a batch reads that of its own streams and nothing of the
    log that it adds to.
    """

    def handle(batch: DataFrame, number: int) -> None:
        rows = transform(batch) if transform else batch
        if heads is None:
            sinks.append_events(rows, path)
        else:
            sinks.append_batch(rows, path, heads, _job(checkpoint, number), buckets)

    return run_batches(stream, handle, checkpoint)


def index_job(stream: DataFrame, log_path: str, view_path: str, fold: Callable[[DataFrame], DataFrame], checkpoint: str, known: Sequence[str] | None = None) -> StreamingQuery:
    """Views kept up to date (L6): streams that a batch changes are folded over their log and version-gated into the view.

    For folds of any kind, at the cost of the changed streams' categories; where states can be combined, take
    ``seeded_index_job``.
    """

    def handle(batch: DataFrame, _: int) -> None:
        changed = filters.implies_state_change(batch, keys=("stream", "category"), known=known).where("change")
        sinks.upsert_view(fold(sinks.touched(batch.sparkSession.read.parquet(log_path), changed)), view_path, ["stream"])

    return run_batches(stream, handle, checkpoint)


def seeded_index_job(stream: DataFrame, view_path: str, lift: Column, combine: Callable[[Column, Column], Column], checkpoint: str, log_path: str | None = None, buckets: int = sinks.BUCKETS) -> StreamingQuery:
    """Views whose states are combined with those of new events only.

    Of each batch, the events from a stream's version on are folded by themselves (``folds.fold_combined``), and
    their state is combined with the held one. So a batch reads itself and the buckets of the view that it
    touches, whatever the log holds. Only where events are missing between a stream's version and the batch
    are those of that stream read from ``log_path``; without one, they are an error.
    """

    def handle(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        lifted = batch.select("stream", "category", "idx", lift.alias("_lifted")).where(F.col("stream").isNotNull()).dropDuplicates(["stream", "idx"])
        kind = lifted.schema["_lifted"].dataType.simpleString()
        lifted = written(lifted, "batch")
        held = sinks.held_rows(lifted.select("stream").distinct(), view_path, f"stream string, version long, state {kind}", ["stream"], buckets)
        held = held.select("stream", F.col("version").alias("_from"), F.col("state").alias("_held"))
        at = F.coalesce("_from", F.lit(0))
        fresh = lifted.join(held.select("stream", "_from"), "stream", "left").where(F.col("idx") >= at)
        # All that a stream lacks has come if there are as many events as places from its version to the last.
        behind = fresh.groupBy("stream").agg(F.first("category").alias("category"), F.first(at).alias("_at"), (F.max("idx") + 1 - F.first(at)).alias("_wanted"), F.count(F.lit(1)).alias("_n")).where("_wanted <> _n")
        behind = written(behind, "behind")
        if behind.count():
            if log_path is None:
                raise ValueError("events are missing before those of the batch, and no log is given")
            known = sinks.touched(spark.read.parquet(log_path), behind).select("stream", "idx", lift.alias("_lifted")).join(behind.select("stream", "_at"), "stream").where("idx >= _at").dropDuplicates(["stream", "idx"])
            fresh = fresh.join(behind.select("stream"), "stream", "left_anti").select("stream", "idx", "_lifted").union(known.select("stream", "idx", "_lifted"))
        delta = folds.fold_combined(fresh, F.col("_lifted"), combine).join(held, "stream", "left")
        both = F.when(F.col("_from").isNull(), F.col("state")).otherwise(combine(F.col("_held"), F.col("state")).cast(kind))
        sinks.upsert_view(delta.select("stream", "version", both.alias("state")), view_path, ["stream"], buckets=buckets)

    return run_batches(stream, handle, checkpoint)


def handler_job(stream: DataFrame, handler: Callable[[DataFrame], DataFrame], positions_path: str, out_path: str, checkpoint: str) -> StreamingQuery:
    """Spans to a handler that gives (stream, outcome, next_idx); events before a stream's position are left out.

    A batch's outcomes are written under the job's and the batch's number before positions move. A batch
    that comes again after they were written isn't handled again: positions move on from what is there.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark, out = batch.sparkSession, f"{out_path}/batch={_job(checkpoint, number)}"
        if not sinks.exists(spark, out):
            held = sinks.held_rows(batch.select("stream").distinct(), positions_path, "stream string, version long", ["stream"])
            fresh = batch.join(held, "stream", "left").where(F.col("idx") >= F.coalesce("version", F.lit(0))).drop("version")
            handler(fresh).write.mode("overwrite").parquet(out)
        done = spark.read.parquet(out)
        sinks.upsert_view(done.select("stream", F.col("next_idx").cast("long").alias("version")), positions_path, ["stream"])

    return run_batches(stream, handle, checkpoint)


def ingest_job(stream: DataFrame, held_path: str, checkpoint: str, keys: list[str], order: list[str], buckets: int = sinks.BUCKETS) -> StreamingQuery:
    """Items that aren't held yet are appended, each once, however often a batch comes.

    What is held is partitioned by buckets of its keys, and a batch reads those of its items. Its own are
    files under the batch's name: when it comes again, they don't count as held and are written again.
    """

    def handle(batch: DataFrame, number: int) -> None:
        name = _job(checkpoint, number)
        rows = written(batch.withColumn("bucket", sinks._bucket(keys, buckets)), "batch")
        held = rows.limit(0).select(*keys)
        if sinks.exists(rows.sparkSession, held_path):
            some = [r[0] for r in rows.select("bucket").distinct().collect()]  # as many as there are buckets, at most
            held = rows.sparkSession.read.parquet(held_path).where(F.col("bucket").isin(some) & (F.col("batch") != name)).select(*keys)
        new = decisions.append_new(held, rows, keys, order).withColumn("batch", F.lit(name))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(held_path)

    return run_batches(stream, handle, checkpoint)

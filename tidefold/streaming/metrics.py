"""Statistics of running feeds, collected by the batches themselves: no second pass over what a batch reads."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

LAG = "batch long, tranche string, events long, committed long, head long, lag long"
SPANS = "batch long, spans long, events long, largest long"


def observed(feed: DataFrame, name: str, tranches: Sequence[str], tranche: str = "tranche", position: str = "position") -> DataFrame:
    """The feed with metrics of each batch under ``name``: the number of events and the last position of each tranche.

    The tranches of a feed are a fixed, short list; two numbers for each are carried with a batch's tasks.
    """
    own = [F.when(F.col(tranche) == t, F.col(position)) for t in tranches]
    each = [x for n, p in enumerate(own) for x in (F.count(p).alias(f"events_{n}"), F.max(p).alias(f"last_{n}"))]
    return feed.observe(name, *each)


class LagListener(StreamingQueryListener):
    """Lag of each tranche after each batch of a query, from the metrics that ``observed`` adds.

    ``heads`` gives the last position of each tranche when it's asked: a mapping, or a function for heads
    that move. ``committed`` holds the positions from which the query goes on. A tranche without events
    has position -1.
    """

    def __init__(self, name: str, tranches: Sequence[str], heads: Mapping[str, int] | Callable[[], Mapping[str, int]], committed: Mapping[str, int] | None = None) -> None:
        self.name, self.tranches, self.heads = name, list(tranches), heads
        self.committed, self.rows, self.ended = dict(committed or {}), [], set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        metrics = progress.observedMetrics.get(self.name)
        if metrics is None:
            return
        heads = self.heads() if callable(self.heads) else self.heads
        for n, t in enumerate(self.tranches):
            last = metrics[f"last_{n}"]
            if last is not None:
                self.committed[t] = max(last, self.committed.get(t, -1))
            at, head = self.committed.get(t, -1), heads.get(t, -1)
            self.rows.append((progress.batchId, t, metrics[f"events_{n}"], at, head, max(head - at, 0)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))

    def frame(self, spark: SparkSession) -> DataFrame:
        """(batch, tranche, events, committed, head, lag): a row for each batch and tranche so far."""
        return spark.createDataFrame(self.rows, LAG)


def with_lag(query: Callable[[], StreamingQuery], spark: SparkSession, listener: LagListener, patience: float = 30) -> DataFrame:
    """Run a query that ends at the tail under a listener; the lag rows of its batches, and of those of earlier runs that the listener heard of."""
    spark.streams.addListener(listener)
    try:
        running = query()
        running.awaitTermination()
        until = time.monotonic() + patience  # the listener hears of the end after the query has ended
        while str(running.runId) not in listener.ended and time.monotonic() < until:
            time.sleep(0.05)
    finally:
        spark.streams.removeListener(listener)
    return listener.frame(spark)


def heads_of(log: DataFrame, tranche: str = "tranche", position: str = "position") -> dict[str, int]:
    """The last position of each tranche: as many rows as there are tranches."""
    return {r[0]: r[1] for r in log.groupBy(tranche).agg(F.max(position)).collect()}


def write_spans(batch: DataFrame, number: int, handle: Callable[[DataFrame], None], path: str) -> None:
    """Hand a micro-batch's spans, (stream, first_idx, last_idx, n), to ``handle`` and keep their sizes under the batch's number.

    Sizes are observed while ``handle`` writes the spans. A batch that comes again writes the same row again.
    """
    seen = Observation("spans")
    spans = batch.groupBy("stream").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count(F.lit(1)).alias("n"))
    handle(spans.observe(seen, F.count(F.lit(1)).alias("spans"), F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.coalesce(F.max("n"), F.lit(0)).alias("largest")))
    sizes = seen.get
    batch.sparkSession.createDataFrame([(number, sizes["spans"], sizes["events"], sizes["largest"])], SPANS).write.mode("overwrite").parquet(f"{path}/batch={number}")


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """(batch, spans, events, largest) of the batches so far."""
    return spark.read.schema(SPANS).parquet(path).select("batch", "spans", "events", "largest")

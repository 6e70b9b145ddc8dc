"""Log lifecycle jobs: archive, prune, sync, export, split, index."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import decisions, filters


def archive(hot: DataFrame, warm: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Events to add to the archive: of the categories, and not there yet (L1)."""
    return filters.archivable(hot, categories).join(warm.select("stream", "idx"), ["stream", "idx"], "left_anti")


def prune(hot: DataFrame, warm: DataFrame, as_of: Column, ages: dict[str, int] | int = 30) -> DataFrame:
    """The hot log without what the archive holds and has expired (L2). What only the hot log holds always stays.

    Events go from the head of a stream on: an expired event stays while one before it does.
    """
    expired = filters.prunable(filters.strip_bodies(warm.select("stream", "category", "idx", "ts")), as_of, ages).select("stream", "idx").distinct()
    marked = hot.join(expired.withColumn("_gone", F.lit(True)), ["stream", "idx"], "left")
    keeps = marked.where(F.col("_gone").isNull()).groupBy("stream").agg(F.min("idx").alias("_first"))
    return marked.join(keeps, "stream", "left").where(F.col("_first").isNotNull() & (F.col("idx") >= F.col("_first"))).drop("_gone", "_first")


def sync(source: DataFrame, target: DataFrame, limit: int = 1_000_000, **filter_options) -> DataFrame:
    """Events to add to a copy of a log: filtered, guarded, and from the copy's version on (L3)."""
    return decisions.index_gate(target, filters.guard_payload(filters.sync_filter(source, **filter_options), limit))


def export(source: DataFrame, target: DataFrame, categories: Sequence[str], schema: str, rewrite: Callable[[Column], Column]) -> DataFrame:
    """As ``sync``, with each body decoded and encoded anew; streams of unknown categories fail (L4)."""
    known = F.when(F.col("category").isin(*categories), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unknown category of "), F.col("stream"))))
    return filters.rewrite_bodies(decisions.index_gate(target, source.where(known)), schema, rewrite)


def split_long(df: DataFrame, starts: Sequence[str] = filters.LONG_STARTS) -> tuple[DataFrame, DataFrame]:
    """(rows for the message topic, rows for the store): long categories go to the first."""
    long = filters.is_long(F.col("stream"), starts)
    return df.where(long), df.where(~long)


def index(batch: DataFrame, log: DataFrame, fold: Callable[[DataFrame], DataFrame], view: DataFrame, known: Sequence[str] | None = None) -> DataFrame:
    """View rows with ``accepted`` (L6): only streams whose batch implies a change are folded, over their whole log, and version-gated."""
    touched = filters.implies_state_change(batch, known=known).where("change").select("stream")
    return decisions.version_gate(view, fold(log.join(touched, "stream", "left_semi")), ["stream"])

"""Snapshots: stored states beside the log, when they are valid, and reading from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def read_all(df: DataFrame, fold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A fold over every event."""
    return fold(df)


def since_snapshot(df: DataFrame, snapshots: DataFrame, snapshot_type: str | None = None) -> DataFrame:
    """Events from each stream's snapshot version on, the seed state beside them in ``seed``.

    Only snapshots of the given tag count: a new tag makes older ones invalid. Without a tag all count. Of several
    snapshots of a stream that with the highest version is read, of equal versions that with the last tag. Streams
    with a snapshot and no later event come out as one row with a null idx.
    """
    s = snapshots if snapshot_type is None else snapshots.where(F.col("snapshot_type") == snapshot_type)
    newest = F.max_by(F.struct(F.col("version").alias("_v"), F.col("state").alias("seed")), F.struct("version", "snapshot_type"))
    s = s.groupBy("stream").agg(newest.alias("_s")).select("stream", "_s.*")
    later = df.join(s, "stream", "left").where(F.col("_v").isNull() | (F.col("idx") >= F.col("_v")))
    bare = s.join(later.select("stream").distinct(), "stream", "left_anti")
    return later.drop("_v").unionByName(bare.drop("_v"), allowMissingColumns=True)


def latest_event(df: DataFrame, *columns: str) -> DataFrame:
    """The last event of each stream."""
    return df.groupBy("stream").agg(F.max_by(F.struct("idx", *columns), "idx").alias("e")).select("stream", "e.*")


def audit_snapshots(df: DataFrame, is_origin: Column, snapshots: DataFrame | None = None, snapshot_type: str | None = None) -> DataFrame:
    """(stream, category, result): Valid iff the last item folded is an origin, or the snapshot has the stream's version."""
    last = df.groupBy("stream", "category").agg((F.max("idx") + 1).alias("version"), F.max_by(is_origin, "idx").alias("valid"))
    if snapshots is not None:
        s = snapshots if snapshot_type is None else snapshots.where(F.col("snapshot_type") == snapshot_type)
        s = s.groupBy("stream").agg(F.max("version").alias("_v"))
        last = last.join(s, "stream", "left").withColumn("valid", F.col("valid") | F.coalesce(F.col("_v") == F.col("version"), F.lit(False))).drop("_v")
    return last.select("stream", "category", "version", F.when(F.col("valid"), "Valid").otherwise("Invalid").alias("result"))


def refresh_snapshots(df: DataFrame, is_origin: Column, fold: Callable[[DataFrame], DataFrame], tag: str, snapshots: DataFrame | None = None) -> DataFrame:
    """The whole snapshot table with missing or invalid ones built anew.

    Only the events of streams that fail the audit are folded; ``fold`` gives stream, category, version, state.
    """
    failed = audit_snapshots(df, is_origin, snapshots, tag).where("result = 'Invalid'").select("stream")
    made = fold(df.join(failed, "stream", "left_semi")).select("stream", "category", F.lit(tag).alias("snapshot_type"), "version", "state")
    if snapshots is None:
        return made
    return snapshots.join(made.select("stream", "snapshot_type"), ["stream", "snapshot_type"], "left_anti").unionByName(made)


def all_unfolds_present(snapshots: DataFrame, expected: list[str]) -> DataFrame:
    """(stream, missing, valid): valid only if every expected snapshot type is there."""
    have = snapshots.groupBy("stream").agg(F.collect_set("snapshot_type").alias("_have"))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(t) for t in expected]), "_have"))
    return have.select("stream", missing.alias("missing"), (F.size(missing) == 0).alias("valid"))

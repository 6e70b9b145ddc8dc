"""Feeds over epochs of items: tranches, pages, polling from a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.streams import end_checkpoint, from_checkpoint, to_checkpoint


def tranches(items: DataFrame, series: str = "series") -> DataFrame:
    """(series, epoch): the active epoch of each."""
    return items.groupBy(series).agg(F.max("epoch").alias("epoch"))


def page(items: DataFrame, epochs: DataFrame, series: str = "series") -> DataFrame:
    """All items with their page's position and next checkpoint (E3). ``epochs``: series, epoch, n, closed."""
    ends = epochs.select(series, "epoch", to_checkpoint(F.col("epoch"), F.lit(0)).alias("position"), end_checkpoint(F.col("epoch"), F.col("closed"), F.col("n")).alias("next_checkpoint"))
    return items.join(ends, [series, "epoch"])


def poll(items: DataFrame, epochs: DataFrame, consumers: DataFrame, series: str = "series") -> tuple[DataFrame, DataFrame]:
    """(items, pages) for the checkpoint of each consumer: the items of that epoch from the offset on.

    consumers: consumer, series, checkpoint. pages: consumer, series, next_checkpoint, closed, n.
    """
    at = consumers.withColumn("_c", from_checkpoint(F.col("checkpoint"))).select("consumer", series, F.col("_c.epoch").alias("epoch"), F.col("_c.offset").alias("_from"))
    got = items.join(at, [series, "epoch"]).where(F.col("offset") >= F.col("_from")).drop("_from")
    ends = epochs.select(series, "epoch", "closed", F.col("n").alias("_n"))
    own = at.join(ends, [series, "epoch"], "left")
    n = F.greatest(F.coalesce("_n", F.lit(0)), F.col("_from"))
    pages = own.select("consumer", series, end_checkpoint(F.col("epoch"), F.coalesce("closed", F.lit(False)), n).alias("next_checkpoint"), F.coalesce("closed", F.lit(False)).alias("closed"), F.greatest(F.coalesce("_n", F.lit(0)) - F.col("_from"), F.lit(0)).alias("n"))
    return got, pages


def number_positions(items: DataFrame, page_keys: list[str], position: str, order: list[str]) -> DataFrame:
    """Item positions: that of the page, plus the place in it (E5)."""
    place = F.row_number().over(Window.partitionBy(*page_keys).orderBy(*order)) - 1
    return items.withColumn("item_position", F.col(position) + place)


def consumer_counts(spans: DataFrame, keys: list[str], item: str, ready: str | None = None) -> DataFrame:
    """(keys, added, not_ready, duplicates) of delivered spans; duplicates are counted from 0 up."""
    ok = F.col(ready) if ready else F.lit(True)
    distinct = F.countDistinct(F.when(ok, F.col(item)))
    return spans.groupBy(*keys).agg(distinct.alias("added"), F.count_if(~ok).alias("not_ready"), (F.count_if(ok) - distinct).alias("duplicates"))

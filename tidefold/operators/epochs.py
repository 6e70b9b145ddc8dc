"""Placing items into capped epochs: soft and strict caps, exactly-once and look-back deduplication."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decisions import first_of
from .running import in_pages, ordinals, same, written


def soft_epochs(batches: DataFrame, cap: int, active: DataFrame | None = None) -> DataFrame:
    """(series, req_seq, n, epoch): each batch goes whole into the open epoch, which closes at ``cap`` items.

    An epoch ends with the first batch after whose items it holds ``cap`` or more, so its end is found by running
    sums, and a series of any length is placed in blocks (``in_pages``). Empty batches go to the epoch that is open.
    ``active`` (series, epoch, fill) says where a series stands. A null series is a series.
    """
    rows = batches.select("series", "req_seq", F.col("n").cast("long").alias("n"))
    if active is not None:
        held = active.select(F.col("series").alias("_s"), F.col("epoch").alias("_epoch"), F.col("fill").cast("long").alias("_fill"))
        rows = rows.join(held, F.col("series").eqNullSafe(F.col("_s")), "left").drop("_s")
    else:
        rows = rows.withColumns({"_epoch": F.lit(0), "_fill": F.lit(0).cast("long")})
    full = F.col("n") > 0
    rows = written(ordinals(rows, ["series"], ["req_seq"], "_all", {"_at": full.cast("int"), "_before": F.col("n")}).drop("_all"), "batches")
    start = F.when(F.col("_at") == 0, F.coalesce("_fill", F.lit(0))).otherwise(F.lit(0))

    def ends(sums: np.ndarray, held: np.ndarray) -> np.ndarray:
        return np.maximum(np.searchsorted(sums, sums[:-1] - held + cap), np.arange(1, len(sums)))

    placed = in_pages(rows.where(full).withColumn("_held", start), ["series"], "_at", "_before", "n", cap, ends, "_held")
    epoch = F.coalesce("_epoch", F.lit(0)) + F.col("page")
    columns = ["series", "req_seq", F.col("n").cast("int").alias("n")]
    if rows.where(~full).isEmpty():
        return placed.select(*columns, epoch.cast("int").alias("epoch"))
    placed = written(placed, "placed")
    # An empty batch comes after the batch of the number before its own.
    last = placed.select(F.col("series").alias("_s"), (F.col("_at") + 1).alias("_next"), (F.col("page") + F.col("closes").cast("int")).alias("_page"))
    empty = rows.where(~full).join(last, F.col("series").eqNullSafe(F.col("_s")) & (F.col("_at") == F.col("_next")), "left").withColumn("page", F.coalesce("_page", F.lit(0)))
    return placed.select(*columns, epoch.cast("int").alias("epoch")).union(empty.select(*columns, epoch.cast("int").alias("epoch")))


def exactly_once(held: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested items to insert (D6): not held in the request's origin epoch or a later one, each once, in request order.

    held: series, epoch, item_id; requests: series, req_seq, origin_epoch, pos, item_id. Set-based; it
    assumes that no request of the batch starts after an epoch that the batch itself fills.
    ``ingest_in_order`` makes no such assumption.
    """
    last = held.groupBy("series", "item_id").agg(F.max("epoch").alias("_held"))
    fresh = requests.join(last, ["series", "item_id"], "left").where(F.col("_held").isNull() | (F.col("_held") < F.col("origin_epoch"))).drop("_held")
    return first_of(fresh, ["series", "item_id"], ["req_seq", "pos"])


def ingest_exactly_once(held: DataFrame, requests: DataFrame, cap: int, active: DataFrame | None = None) -> DataFrame:
    """(series, epoch, req_seq, pos, item_id) of what is inserted: ``exactly_once``, then ``soft_epochs``."""
    fresh = exactly_once(held, requests)
    sizes = fresh.groupBy("series", "req_seq").agg(F.count(F.lit(1)).alias("n"))
    return fresh.join(soft_epochs(sizes, cap, active).select("series", "req_seq", "epoch"), ["series", "req_seq"]).select("series", "epoch", "req_seq", "pos", "item_id")


def _without(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of which ``other`` has none with the same keys; null keys are equal."""
    other = other.select(*[F.col(k).alias(f"_x_{k}") for k in keys]).distinct()
    return rows.join(other, same(keys, lambda k: F.col(f"_x_{k}")), "left_anti")


def ingest_in_order(held: DataFrame, requests: DataFrame, cap: int) -> DataFrame:
    """The same, as if a request at a time came to each series, for origins that run ahead of the open epoch.

    An epoch can be settled for all requests at once when the one before it is: it takes the new items of those that
    come to it, in order, each item once, until it has ``cap`` or more; what comes later passes on, without what it
    holds. So the epochs from a series' lowest origin to its highest origin or held epoch take a round of
    joins each, for all series together, and what is left then goes to new epochs by ``soft_epochs``. Nothing
    of a series is brought to one task. A null series is a series, a null item an item.
    """
    key, order = ["series", "item_id"], ["req_seq", "origin_epoch", "pos"]
    spans = requests.groupBy("series").agg(F.min("origin_epoch").alias("_low"), F.max("origin_epoch").alias("_high"))
    known = held.select(F.col("series").alias("_series"), F.col("epoch").alias("_epoch"), F.col("item_id").alias("_item")).distinct()
    tops = known.groupBy("_series").agg(F.max("_epoch").alias("_top"))
    spans = spans.join(tops, F.col("series").eqNullSafe(F.col("_series")), "left")
    spans = written(spans.select(F.col("series").alias("_of"), "_low", F.greatest("_high", "_top").alias("_high")), "epoch-spans")
    of = F.col("series").eqNullSafe(F.col("_of"))
    known = written(known.join(spans, F.col("_series").eqNullSafe(F.col("_of"))).where(F.col("_epoch") >= F.col("_low")).select(F.col("_series").alias("series"), F.col("_item").alias("item_id"), (F.col("_epoch") - F.col("_low")).alias("_round")), "held-items")
    asked = written(requests.select("series", *order, "item_id").join(spans, of).withColumn("_round", F.col("origin_epoch") - F.col("_low")).drop("_of", "_low", "_high"), "requests")
    rounds = spans.agg(F.max(F.col("_high") - F.col("_low"))).first()[0]
    columns = ["series", "epoch", "req_seq", "pos", "item_id"]
    placed, left = [], asked.limit(0).drop("_round")
    for n in range(-1 if rounds is None else rounds + 1):
        have = known.where(F.col("_round") == n)
        new = _without(asked.where(F.col("_round") == n).drop("_round").union(left), have, key)
        first = written(first_of(new, key, order), "first-items")
        sizes = first.groupBy("series", "req_seq", "origin_epoch").agg(F.count(F.lit(1)).alias("_n"))
        full = have.groupBy(F.col("series").alias("_of")).agg(F.count(F.lit(1)).alias("_full"))
        sizes = ordinals(sizes, ["series"], ["req_seq", "origin_epoch"], "_at", {"_before": F.col("_n")}).join(full, of, "left")
        late = sizes.where(F.col("_before") + F.coalesce("_full", F.lit(0)) >= cap)
        taken = written(_without(first, late, ["series", "req_seq", "origin_epoch"]), "taken-items")
        placed.append(taken.join(spans, of).withColumn("epoch", (F.col("_low") + n).cast("int")).select(*columns))
        left = written(_without(new, taken, key), "left-items")
    first = written(first_of(left, key, order), "first-items")
    request = F.struct("req_seq", "origin_epoch")
    batches = first.groupBy("series", request.alias("req_seq")).agg(F.count(F.lit(1)).alias("n"))
    active = spans.select(F.col("_of").alias("series"), (F.lit(rounds or 0) + F.col("_low") + 1).alias("epoch"), F.lit(0).alias("fill"))
    epoch = soft_epochs(batches, cap, active).select(F.col("series").alias("_of"), F.col("req_seq").alias("_req"), "epoch")
    rest = first.join(epoch, of & (request == F.col("_req"))).select(*columns)
    return reduce(DataFrame.union, placed, rest)


def strict_epochs(items: DataFrame, key: str, order: list[str], cap: int, active: DataFrame | None = None) -> DataFrame:
    """Items with epoch and offset: epochs are filled to the cap exactly, in order (D8). ``active``: key, epoch, fill."""
    numbered = ordinals(items, [key], order, "_n")
    if active is not None:
        numbered = numbered.join(active.select(key, F.col("epoch").alias("_e"), F.col("fill").alias("_f")), key, "left")
    else:
        numbered = numbered.withColumns({"_e": F.lit(0), "_f": F.lit(0)})
    place = F.col("_n") + F.coalesce("_f", F.lit(0))
    return numbered.withColumns({"epoch": (F.coalesce("_e", F.lit(0)) + F.floor(place / cap)).cast("int"), "offset": F.pmod(place, F.lit(cap)).cast("int")}).drop("_e", "_f", "_n")


def look_back(held: DataFrame, requests: DataFrame, key: str, item: str, epochs_back: int, order: list[str], dedup_within_batch: bool = True) -> DataFrame:
    """Requested items that the active epoch and the last ``epochs_back`` before it don't hold.

    Older repeats are taken again. ``dedup_within_batch=False`` also keeps repeats within a request.
    """
    active = held.groupBy(key).agg(F.max("epoch").alias("_a"))
    seen = held.join(active, key).where(F.col("epoch") >= F.col("_a") - epochs_back).select(key, item).distinct()
    fresh = requests.join(seen, [key, item], "left_anti")
    return first_of(fresh, [key, item], order) if dedup_within_batch else fresh


def epoch_summary(items: DataFrame, cap: int, series: str = "series") -> DataFrame:
    """(series, epoch, n, closed) of placed items."""
    return items.groupBy(series, "epoch").agg(F.count(F.lit(1)).alias("n")).withColumn("closed", F.col("n") >= cap)

"""Decisions: requests resolved against held state, as sets. Each gives the rows (events) to append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the first by order, all columns; an aggregation with a partial step."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def append_new(held: DataFrame, requests: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Requested items that aren't held, each once."""
    return first_of(requests, keys, order).join(held.select(*keys), keys, "left_anti")


def remove_held(held: DataFrame, requests: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Requested removals of items that are held, each once."""
    return first_of(requests, keys, order).join(held.select(*keys).distinct(), keys, "left_semi")


def post_ledger(stays: DataFrame, posted: DataFrame, requests: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) charges and payments (D2): one per (stream, id), none that is posted already; closed stays reject."""
    status = stays.select("stream", F.col("status").alias("_status"))
    rows = requests.join(status, "stream", "left")
    closed = F.coalesce(F.col("_status") != "Active", F.lit(False))
    fresh = append_new(posted, rows.where(~closed).drop("_status"), ["stream", "id"], order)
    return fresh, rows.where(closed).drop("_status")


def check_in(stays: DataFrame, requests: DataFrame) -> DataFrame:
    """Outcome of check-ins (D3): CheckedIn, or Unchanged at the same time, or Error at another or when not active."""
    s = stays.select("stream", "checked_in_at", "status")
    none, same = F.col("checked_in_at").isNull(), F.col("checked_in_at") == F.col("at")
    active = F.coalesce(F.col("status"), F.lit("Active")) == "Active"
    return requests.join(s, "stream", "left").withColumn("outcome", F.when(~active, "Error").when(none, "CheckedIn").when(same, "Unchanged").otherwise("Error")).drop("checked_in_at", "status")


def check_out(stays: DataFrame, requests: DataFrame) -> DataFrame:
    """Outcome of check-outs (D3): Ok at a balance of exactly 0, else BalanceOutstanding; closed ones are Ok, transferred ones AlreadyCheckedOut."""
    s = stays.select("stream", "balance", "status")
    balance = F.coalesce("balance", F.lit(0).cast("decimal(18,2)"))
    outcome = F.when(F.col("status") == "TransferredToGroup", "AlreadyCheckedOut").when(F.col("status") == "Closed", "Ok").when(balance == 0, "Ok").otherwise("BalanceOutstanding")
    emits = (F.coalesce(F.col("status"), F.lit("Active")) == "Active") & (balance == 0)
    return requests.join(s, "stream", "left").withColumns({"outcome": outcome, "outstanding": balance, "emits": emits}).drop("balance", "status")


def todo_update(items: DataFrame, requests: DataFrame, when_absent: bool = False) -> DataFrame:
    """Updates that change a held item; with ``when_absent`` also those of items that aren't held."""
    held = items.groupBy("stream", "id").agg(F.min_by("value", "pos").alias("_held"), F.count(F.lit(1)).alias("_n"))
    rows = requests.join(held, ["stream", "id"], "left")
    change = F.col("_n").isNotNull() & ~F.col("value").eqNullSafe(F.col("_held"))
    return rows.where(change | F.col("_n").isNull() if when_absent else change).drop("_held", "_n")


def todo_delete(items: DataFrame, requests: DataFrame) -> DataFrame:
    """Deletions of items that are held."""
    return requests.join(items.select("stream", "id").distinct(), ["stream", "id"], "left_semi")


def todo_clear(state: DataFrame, requests: DataFrame) -> DataFrame:
    """Clearings of lists that aren't empty; next_id is kept."""
    return requests.join(state.where("n > 0").select("stream", "next_id"), "stream")


def todo_add(state: DataFrame, requests: DataFrame, order: list[str]) -> DataFrame:
    """Additions with ids from next_id on."""
    place = F.row_number().over(Window.partitionBy("stream").orderBy(*order)) - 1
    return requests.join(state.select("stream", "next_id"), "stream", "left").withColumn("id", F.coalesce("next_id", F.lit(0)) + place).drop("next_id")


def version_gate(held: DataFrame, incoming: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """Incoming rows with ``accepted``: the newest of each key within the batch, if newer than what is held."""
    top = incoming.groupBy(*keys).agg(F.max(version).alias("_top"))
    known = held.groupBy(*keys).agg(F.max(version).alias("_held"))
    rows = incoming.join(top, keys).join(known, keys, "left")
    return rows.withColumn("accepted", (F.col(version) == F.col("_top")) & (F.col(version) > F.coalesce("_held", F.lit(-1)))).drop("_top", "_held")


def index_gate(target: DataFrame, source: DataFrame) -> DataFrame:
    """Source events from the target's version on."""
    heads = target.groupBy("stream").agg((F.max("idx") + 1).alias("_v"))
    return source.join(heads, "stream", "left").where(F.col("idx") >= F.coalesce("_v", F.lit(0))).drop("_v")


def crawl_outcomes(held: DataFrame, crawl: DataFrame) -> DataFrame:
    """Crawl rows with their outcome (D13): Stale if older than what is held, Unchanged if the body is equal, else Changed."""
    h = held.select("id", F.col("lastUpdated").alias("_u"), F.col("body").alias("_b"))
    outcome = F.when(F.col("_u").isNull(), "Changed").when(F.col("lastUpdated") < F.col("_u"), "Stale").when(F.col("body").eqNullSafe(F.col("_b")), "Unchanged").otherwise("Changed")
    return crawl.join(h, "id", "left").withColumn("outcome", outcome).drop("_u", "_b")


def ingest_sku(held: DataFrame, batch: DataFrame, policy: str = "first", keys: tuple[str, str] = ("sku", "location"), newest: str = "message_index") -> DataFrame:
    """Sku rows with ``used``.

    ``first``: a row is used iff no held item has its location; rows of one new location are all used.
    ``newest``: of each location the newest row is used, if newer than what is held.
    """
    if policy == "newest":
        return version_gate(held, batch, list(keys), newest).withColumnRenamed("accepted", "used")
    known = held.select(*keys).distinct().withColumn("_h", F.lit(True))
    return batch.join(known, list(keys), "left").withColumn("used", F.col("_h").isNull()).drop("_h")


def confirm_group(groups: DataFrame) -> DataFrame:
    """Outcome of a group's confirmation (D16); groups have next_action and balance."""
    outcome = F.when(F.col("next_action") == "Finished", "Ok").when(F.col("next_action") == "MergeStays", "Processing").when(F.col("balance") == 0, "Confirmed").otherwise("BalanceOutstanding")
    return groups.withColumn("outcome", outcome)


def advance_pointer(held: Column, seen: Column) -> Column:
    """A series pointer only moves forward, and is never below 0."""
    return F.greatest(held, seen, F.lit(0))

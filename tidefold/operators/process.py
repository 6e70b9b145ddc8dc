"""Process managers as bulk steps: group checkout, container finalization, stuck watchdog.

Within a batch all requests reserve before any reverts, and a contested stay or shipment goes to the
first request by order: one of the interleavings that one-at-a-time processing permits, and always the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decisions import first_of


def merge_stays(groups: DataFrame, stays: DataFrame, order: list[str]) -> DataFrame:
    """(group_id, stay, outcome, residual) for all pending stays of unfinished groups (G1).

    groups: group_id, pending array, next_action and the ``order`` columns; stays: stay, status, balance,
    group_id, residual. Closed stays and those of another group fail; those already in the group keep
    their recorded residual; active ones are transferred with their balance.
    """
    asked = groups.where("next_action = 'MergeStays'").select("group_id", *[c for c in order if c != "group_id"], F.explode("pending").alias("stay"))
    winner = first_of(asked.select("stay", "group_id", *[c for c in order if c != "group_id"]), ["stay"], order).select("stay", F.col("group_id").alias("_first"))
    held = stays.select("stay", F.coalesce("status", F.lit("Active")).alias("_status"), "balance", F.col("group_id").alias("_group"), F.col("residual").alias("_residual"))
    rows = asked.join(held, "stay", "left").join(winner, "stay")
    own, active = F.col("_group") == F.col("group_id"), F.coalesce(F.col("_status"), F.lit("Active")) == "Active"
    zero = F.lit(0).cast("decimal(18,2)")
    outcome = F.when((F.col("_status") == "TransferredToGroup") & own, "ok").when(active & (F.col("_first") == F.col("group_id")), "ok").otherwise("failed")
    residual = F.when(outcome != "ok", None).when(active, F.coalesce("balance", zero)).otherwise(F.coalesce("_residual", zero))
    return rows.select("group_id", "stay", outcome.alias("outcome"), residual.cast("decimal(18,2)").alias("residual"))


def merge_events(merged: DataFrame) -> DataFrame:
    """Per group its StaysMerged and MergesFailed content and the counts."""
    ok = F.col("outcome") == "ok"
    return merged.groupBy("group_id").agg(
        F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"), F.sum("residual").alias("residual"),
        F.array_sort(F.collect_list(F.when(ok, F.struct("stay", "residual")))).alias("merged"), F.array_sort(F.collect_list(F.when(~ok, F.col("stay")))).alias("failed"),
    )


def advance_transactions(requests: DataFrame, shipments: DataFrame | None, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(transactions: tx, success, n, n_failed; shipments: tx, shipment, reserved, revoked, assigned).

    requests: tx, container, shipments array and the ``order`` columns; held shipments: shipment,
    reservation, association. A transaction succeeds if it gets all its shipments; else those that it got
    are revoked. All phases as one fixed plan.
    """
    asked = requests.select("tx", *[c for c in order if c != "tx"], F.explode(F.array_distinct("shipments")).alias("shipment"))
    if shipments is not None:
        asked = asked.join(shipments.select("shipment", "reservation", "association"), "shipment", "left")
    else:
        asked = asked.withColumns({"reservation": F.lit(None).cast(requests.schema["tx"].dataType), "association": F.lit(None).cast("string")})
    free = asked.where(F.col("reservation").isNull())
    winner = first_of(free.select("shipment", "tx", *[c for c in order if c != "tx"]), ["shipment"], order).select("shipment", F.col("tx").alias("_winner"))
    got = asked.join(winner, "shipment", "left").withColumn("reserved", F.coalesce((F.col("reservation") == F.col("tx")) | (F.col("_winner") == F.col("tx")), F.lit(False)))
    transactions = got.groupBy("tx").agg(F.bool_and("reserved").alias("success"), F.count(F.lit(1)).alias("n"), F.count_if(~F.col("reserved")).alias("n_failed"))
    per = got.join(transactions.select("tx", "success"), "tx")
    open_ = F.col("association").isNull()
    rows = per.select("tx", "shipment", "reserved", (F.col("reserved") & ~F.col("success") & open_).alias("revoked"), (F.col("reserved") & F.col("success") & open_).alias("assigned"))
    return transactions, rows


def transaction_events(success: Column) -> Column:
    """The event types that a transaction's own stream gets."""
    ok = F.array(*[F.lit(t) for t in ("FinalizationRequested", "ReservationCompleted", "AssignmentCompleted", "Completed")])
    return F.when(success, ok).otherwise(F.array(*[F.lit(t) for t in ("FinalizationRequested", "RevertCommenced", "Completed")]))


def finalize_requests(requests: DataFrame, shipments: DataFrame | None, order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(transactions, shipments, rejects): new requests run to their end; empty shipment lists are rejects."""
    empty = F.coalesce(F.size("shipments"), F.lit(0)) <= 0
    transactions, rows = advance_transactions(requests.where(~empty), shipments, order)
    return transactions, rows, requests.where(empty)


def classify_stuck(watched: DataFrame, as_of: Column, timeout_seconds: float = 10) -> DataFrame:
    """Transactions with ``status`` (G4): Complete, or Stuck if begun before the cutoff, strictly, or else Active."""
    cutoff = as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(timeout_seconds))
    return watched.withColumn("status", F.when(F.col("completed"), "Complete").when(F.col("started") < cutoff, "Stuck").otherwise("Active"))


def pump_stuck(watched: DataFrame, requests: DataFrame, shipments: DataFrame | None, as_of: Column, order: list[str], timeout_seconds: float = 10) -> DataFrame:
    """Drive stuck transactions to their end; outcome succeeded or failed."""
    stuck = classify_stuck(watched, as_of, timeout_seconds).where("status = 'Stuck'").select(F.col("stream").alias("tx"))
    transactions, _ = advance_transactions(requests.join(stuck, "tx", "left_semi"), shipments, order)
    return transactions.withColumn("outcome", F.when(F.col("success"), "succeeded").otherwise("failed"))

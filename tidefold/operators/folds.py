"""Folds: the state of each stream from its events, set-based.

Folds take decoded rows: stream, idx, event_type and the typed columns that they name. A fold starts
at the last origin event (``prune_to_origin``). Forms that only aggregate keep no stream in one place;
state machines are associative too: an event is a function on their states, and functions of neighbours are one.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Indexes of a stream whose events are combined in one row.
BLOCK = 1024


def is_(*types: str) -> Column:
    return F.col("event_type").isin(*types)


def prune_to_origin(df: DataFrame, is_origin: Column) -> DataFrame:
    """Events from the last origin on; all of a stream that has none (F2).

    An aggregation with a partial step and a join, so that a stream of any length is split at will.
    """
    origins = df.where(is_origin).groupBy("stream").agg(F.max("idx").alias("_origin"))
    return df.join(origins, "stream", "left").where(F.col("_origin").isNull() | (F.col("idx") >= F.col("_origin"))).drop("_origin")


def versions(df: DataFrame) -> DataFrame:
    """(stream, version): the next index of each stream."""
    return df.groupBy("stream").agg((F.max("idx") + 1).alias("version"))


def fold_streams(df: DataFrame, initial: Column, evolve: Callable[[Column, Column], Column], *columns: str) -> DataFrame:
    """(stream, version, state) by a left fold over a stream's events in order; ``evolve`` gives columns."""
    event = F.struct("idx", "event_type", *columns)
    spans = df.groupBy("stream").agg(F.array_sort(F.collect_list(event)).alias("_e"), (F.max("idx") + 1).alias("version"))
    return spans.select("stream", "version", F.aggregate("_e", initial, evolve).alias("state"))


def fold_combined(df: DataFrame, lift: Column, combine: Callable[[Column, Column], Column], block: int = BLOCK) -> DataFrame:
    """(stream, version, state) by an associative fold: ``lift`` makes a state of an event, ``combine`` one of two neighbours.

    Events are combined within blocks of ``block`` indexes, blocks within blocks of blocks, and those within a
    stream: a row holds ``block`` states at most at the first two levels, and a stream's index by the square of ``block``
    at the last. So a stream is never in one place, however much of the log it holds. Indexes are those of a log, from
    0 on without repeats.
    """
    state = df.select(lift.alias("s")).schema["s"].dataType.simpleString()

    def level(rows: DataFrame, keys: list[Column | str]) -> DataFrame:
        grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "_s"))).alias("_x"), F.max("version").alias("version"))
        rest = F.slice("_x", 2, F.size("_x"))
        folded = F.aggregate(rest, F.get("_x", F.lit(0))["_s"].cast(state), lambda a, e: combine(a, e["_s"]).cast(state))
        return grouped.withColumn("_s", folded).drop("_x")

    rows = df.select("stream", F.floor(F.col("idx") / block).alias("_block"), F.col("idx").alias("_at"), lift.alias("_s"), (F.col("idx") + 1).alias("version"))
    rows = level(rows, ["stream", "_block"]).select("stream", F.floor(F.col("_block") / block).alias("_far"), F.col("_block").alias("_at"), "_s", "version")
    rows = level(rows, ["stream", "_far"]).withColumnRenamed("_far", "_at")
    return level(rows, ["stream"]).select("stream", "version", F.col("_s").alias("state"))


def fold_machine(df: DataFrame, states: Sequence[str], steps: Mapping[str, Mapping[str, str]], reset: Column | None = None, block: int = BLOCK) -> DataFrame:
    """(stream, version, status) of a state machine that starts in the first of ``states``.

    ``steps`` says for each event type which states it changes, and to what; other events change nothing. ``reset``
    gives the state to which an event goes from any other, or null. An event is a function on the states,
    written as the list of what it makes of each; two neighbours are one such function, so events can be put together
    in any grouping (``fold_combined``).
    """
    number = {s: n for n, s in enumerate(states)}
    kind = "array<int>"
    same = F.array(*[F.lit(n) for n in range(len(states))]).cast(kind)
    moves = same
    for name, step in steps.items():
        moves = F.when(F.col("event_type") == name, F.array(*[F.lit(number[step.get(s, s)]) for s in states]).cast(kind)).otherwise(moves)
    if reset is not None:
        to = F.array_position(F.array(*map(F.lit, states)), reset).cast("int") - 1
        moves = F.when(reset.isNotNull(), F.array_repeat(to, len(states))).otherwise(moves)
    folded = fold_combined(df, moves, lambda a, b: F.transform(a, lambda x: F.get(b, x)), block)
    return folded.select("stream", "version", F.get(F.array(*map(F.lit, states)), F.get("state", F.lit(0))).alias("status"))


def fold_streams_pandas(df: DataFrame, fold: Callable, schema: str) -> DataFrame:
    """A left fold by a pandas function over a stream's ordered events, where columns can't express it (F1)."""
    return df.groupBy("stream").applyInPandas(lambda pdf: fold(pdf.sort_values("idx")), schema)


def fold_todo(df: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(items: stream, pos, id, value; state: stream, version, next_id, n) of to-do lists.

    Rows: Added(id, value), Updated(id, value), Deleted(id), Cleared(next_id), Snapshotted(next_id,
    items array<struct<id, value>>). An item is born by Added or in a snapshot; it is there unless its
    id is deleted later, and has the value of the last later update. Newest births come first.
    """
    live = prune_to_origin(df, is_("Cleared", "Snapshotted"))
    added = live.where(is_("Added")).select("stream", F.col("idx").alias("born"), F.lit(0).alias("at"), "id", F.col(value).alias("value"))
    born = added
    if "items" in df.columns:
        held = live.where(is_("Snapshotted")).select("stream", F.col("idx").alias("born"), F.posexplode("items").alias("at", "item"))
        born = added.unionByName(held.select("stream", "born", "at", F.col("item.id").alias("id"), F.col(f"item.{value}").alias("value")))
    later = live.where(is_("Updated", "Deleted")).groupBy("stream", "id").agg(
        F.max(F.when(is_("Deleted"), F.col("idx"))).alias("deleted"), F.max(F.when(is_("Updated"), F.col("idx"))).alias("updated"), F.max_by(F.when(is_("Updated"), F.col(value)), F.when(is_("Updated"), F.col("idx"))).alias("last")
    )
    joined = born.join(later, ["stream", "id"], "left").where(F.col("deleted").isNull() | (F.col("deleted") < F.col("born")))
    current = F.when(F.col("updated") > F.col("born"), F.col("last")).otherwise(F.col("value"))
    place = (F.row_number().over(Window.partitionBy("stream").orderBy(F.col("born").desc(), "at")) - 1).alias("pos")
    items = joined.select("stream", place, "id", current.alias("value"))
    base = F.coalesce(F.max(F.when(is_("Cleared", "Snapshotted"), F.col("next_id"))), F.lit(0))
    state = live.groupBy("stream").agg((F.max("idx") + 1).alias("version"), (base + F.count_if(is_("Added"))).alias("next_id"))
    counts = items.groupBy("stream").agg(F.count(F.lit(1)).alias("n"))
    return items, state.join(counts, "stream", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def fold_favorites(df: DataFrame, sku: str = "sku", date: str = "date") -> DataFrame:
    """(stream, sku, date) held: Favorited sets the date, Unfavorited removes, Snapshotted (net array) replaces all."""
    live = prune_to_origin(df, is_("Snapshotted"))
    marks = live.where(is_("Favorited", "Unfavorited")).select("stream", "idx", F.col(sku).alias("sku"), F.col(date).alias("date"), is_("Favorited").alias("held"))
    if "net" in df.columns:
        net = live.where(is_("Snapshotted")).select("stream", "idx", F.explode("net").alias("n"))
        marks = marks.unionByName(net.select("stream", "idx", F.col(f"n.{sku}").alias("sku"), F.col(f"n.{date}").alias("date"), F.lit(True).alias("held")))
    last = marks.groupBy("stream", "sku").agg(F.max_by(F.struct("held", "date"), "idx").alias("l"))
    return last.where("l.held").select("stream", "sku", "l.date")


def fold_saved(df: DataFrame, skus: str = "skus") -> DataFrame:
    """(stream, pos, sku) of saved-for-later lists.

    Added puts skus first, duplicates and all; Removed drops every copy; Merged drops and then puts
    first; Cleared empties. A birth ends by a later Removed or Merged of its sku; newest births first.
    """
    live = prune_to_origin(df, is_("Cleared"))
    each = live.where(is_("Added", "Removed", "Merged")).select("stream", "idx", "event_type", F.posexplode(skus).alias("at", "sku"))
    ends = each.where(is_("Removed", "Merged")).groupBy("stream", "sku").agg(F.max("idx").alias("ended"))
    alive = each.where(is_("Added", "Merged")).join(ends, ["stream", "sku"], "left").where(F.col("ended").isNull() | (F.col("ended") <= F.col("idx")))
    return alive.select("stream", (F.row_number().over(Window.partitionBy("stream").orderBy(F.col("idx").desc(), "at")) - 1).alias("pos"), "sku")


def fold_flag(df: DataFrame, happened: str = "Happened", snapshot_value: Column | None = None) -> DataFrame:
    """(stream, version, flag) (F8)."""
    live = prune_to_origin(df, is_("Snapshotted"))
    on = is_(happened) | (is_("Snapshotted") & snapshot_value if snapshot_value is not None else F.lit(False))
    return live.groupBy("stream").agg((F.max("idx") + 1).alias("version"), F.bool_or(F.coalesce(on, F.lit(False))).alias("flag"))


def fold_stays(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stays, rejects) of guest accounts (F9): balance, the ids of charges and payments in order, and how a stay stands.

    Rows: CheckedIn(ts), Charged(id, amount), Paid(id, amount), CheckedOut, TransferredToGroup(group_id,
    amount). Nothing may follow a closing event: such rows are the rejects.
    """
    closing = is_("CheckedOut", "TransferredToGroup")
    ends = df.where(closing).groupBy("stream").agg(F.min("idx").alias("closed_at"))
    rows = df.join(ends, "stream", "left")
    late = F.coalesce(F.col("idx") > F.col("closed_at"), F.lit(False))
    ok = rows.where(~late)
    money = lambda kind: F.coalesce(F.sum(F.when(is_(kind), F.col("amount"))), F.lit(0).cast("decimal(18,2)"))
    ids = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(is_(kind), F.struct("idx", "id")))), lambda x: x["id"])
    stays = ok.groupBy("stream").agg(
        (F.max("idx") + 1).alias("version"), (money("Charged") - money("Paid")).cast("decimal(18,2)").alias("balance"), ids("Charged").alias("charge_ids"), ids("Paid").alias("payment_ids"),
        F.max_by(F.when(is_("CheckedIn"), F.col("ts")), F.when(is_("CheckedIn"), F.col("idx"))).alias("checked_in_at"),
        F.coalesce(F.max(F.when(is_("CheckedOut"), "Closed").when(is_("TransferredToGroup"), "TransferredToGroup")), F.lit("Active")).alias("status"),
        F.max(F.when(is_("TransferredToGroup"), F.col("group_id"))).alias("group_id"), F.max(F.when(is_("TransferredToGroup"), F.col("amount"))).alias("residual"),
    )
    return stays, rows.where(late).drop("closed_at")


def fold_group_checkout(df: DataFrame) -> DataFrame:
    """Group checkouts (F10, F11): stream, pending, checked_out, failed (distinct stays), balance, completed, next_action.

    Rows: StaysSelected(stays), StaysMerged(residuals array<struct<stay, residual>>), MergesFailed(stays),
    Paid(amount), Confirmed.
    """
    chosen = df.where(is_("StaysSelected")).select("stream", "idx", F.explode("stays").alias("stay"), F.lit("s").alias("k"))
    merged = df.where(is_("StaysMerged")).select("stream", "idx", F.explode("residuals").alias("r")).select("stream", "idx", F.col("r.stay").alias("stay"), F.lit("m").alias("k"))
    failed = df.where(is_("MergesFailed")).select("stream", "idx", F.explode("stays").alias("stay"), F.lit("f").alias("k"))
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("idx")))
    per_stay = chosen.union(merged).union(failed).groupBy("stream", "stay").agg(at("s").alias("s"), at("m").alias("m"), at("f").alias("f"))
    done = F.greatest("m", "f")
    lists = per_stay.groupBy("stream").agg(
        F.sort_array(F.collect_list(F.when(F.col("s").isNotNull() & (done.isNull() | (done < F.col("s"))), F.col("stay")))).alias("pending"),
        F.sort_array(F.collect_list(F.when(F.col("m").isNotNull(), F.col("stay")))).alias("checked_out"), F.sort_array(F.collect_list(F.when(F.col("f").isNotNull(), F.col("stay")))).alias("failed"),
    )
    residual = F.when(is_("StaysMerged"), F.aggregate("residuals", F.lit(0).cast("decimal(18,2)"), lambda a, r: (a + r["residual"]).cast("decimal(18,2)")))
    sums = df.groupBy("stream").agg((F.max("idx") + 1).alias("version"), (F.coalesce(F.sum(residual), F.lit(0)) - F.coalesce(F.sum(F.when(is_("Paid"), F.col("amount"))), F.lit(0))).cast("decimal(18,2)").alias("balance"), F.bool_or(is_("Confirmed")).alias("completed"))
    none = F.array().cast("array<string>")
    state = sums.join(lists, "stream", "left").withColumns({c: F.coalesce(F.col(c).cast("array<string>"), none) for c in ("pending", "checked_out", "failed")})
    return state.withColumn("next_action", next_action(F.col("completed"), F.col("pending")))


def next_action(completed: Column, pending: Column) -> Column:
    """Finished, MergeStays or Ready."""
    return F.when(completed, "Finished").when(F.size(pending) > 0, "MergeStays").otherwise("Ready")


def fold_shipments(df: DataFrame) -> DataFrame:
    """(stream, reservation, association) (F12). Rows: Reserved(tx), Assigned(container), Revoked, Snapshotted(tx, container)."""
    live = prune_to_origin(df, is_("Snapshotted", "Revoked"))
    reserved = F.max(F.when(is_("Reserved"), F.col("idx")))
    sets = is_("Assigned", "Snapshotted")
    agg = live.groupBy("stream").agg(
        (F.max("idx") + 1).alias("version"), F.max_by(F.when(is_("Reserved", "Snapshotted"), F.col("tx")), F.when(is_("Reserved", "Snapshotted"), F.col("idx"))).alias("reservation"), reserved.alias("_r"),
        F.max_by(F.col("container"), F.when(sets, F.col("idx"))).alias("_c"), F.max(F.when(sets, F.col("idx"))).alias("_s"),
    )
    return agg.select("stream", "version", "reservation", F.when(F.col("_s") > F.coalesce("_r", F.lit(-1)), F.col("_c")).alias("association"))


def fold_latest(df: DataFrame, value: str, *types: str) -> DataFrame:
    """(stream, version, value) of the last event of the given types: containers, series pointers, summaries."""
    rows = df.where(is_(*types)) if types else df
    return rows.groupBy("stream").agg((F.max("idx") + 1).alias("version"), F.max_by(value, "idx").alias("value"))


def fold_transactions(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """(stream, version, state<status, container, shipments, success>, phase).

    Rows: FinalizationRequested(container, shipments), ReservationCompleted, RevertCommenced(shipments),
    AssignmentCompleted, Completed, Snapshotted(state). Events that don't fit the state are ignored. The status is
    a state machine's; container and shipments are those of the last event that sets them, and null at the end.
    """
    kind = "struct<status:string,container:string,shipments:array<string>,success:boolean>"
    snapshot = F.col("state").cast(kind) if "state" in df.columns else F.lit(None).cast(kind)
    ends = {True: "Succeeded", False: "Failed"}
    # A completed transaction is in one of two states, so that the status alone tells how it ended.
    held = F.when(snapshot["status"] == "Completed", F.when(snapshot["success"], ends[True]).otherwise(ends[False])).otherwise(snapshot["status"])
    reset = F.when(is_("FinalizationRequested"), F.lit("Reserving")).when(is_("RevertCommenced"), F.lit("Reverting")).when(is_("Snapshotted"), held)
    steps = {"ReservationCompleted": {"Reserving": "Assigning"}, "AssignmentCompleted": {"Assigning": "Assigned"}, "Completed": {"Reverting": ends[False], "Assigned": ends[True]}}
    machine = fold_machine(df, ["Initial", "Reserving", "Assigning", "Assigned", "Reverting", *ends.values()], steps, reset, block)
    own = F.struct(F.when(is_("FinalizationRequested"), F.col("container")).when(is_("Snapshotted"), snapshot["container"]).alias("container"), F.when(is_("Snapshotted"), snapshot["shipments"]).otherwise(F.col("shipments")).alias("shipments"))
    sets = df.where(is_("FinalizationRequested", "RevertCommenced", "Snapshotted")).groupBy("stream").agg(F.max_by(own, "idx").alias("_set"))
    status, ended = F.col("status"), F.col("status").isin(*ends.values())
    joined = machine.join(sets, "stream", "left")
    state = F.struct(
        F.when(ended, "Completed").otherwise(status).alias("status"), F.when(~ended, F.col("_set.container")).alias("container"),
        F.when(~ended, F.col("_set.shipments")).alias("shipments"), F.when(ended, status == ends[True]).alias("success"),
    )
    return joined.select("stream", "version", state.alias("state")).withColumn("phase", phase(F.col("state")))


def phase(state: Column) -> Column:
    """What comes next for a transaction; it is an error to ask before it has begun."""
    s = state["status"]
    return (
        F.when(s == "Reserving", "ReserveShipments").when(s == "Reverting", "RevertReservations").when(s == "Assigning", "AssignShipments")
        .when(s == "Assigned", "FinalizeContainer").when(s == "Completed", "Finish").otherwise(F.raise_error(F.concat(F.lit("no phase for the state "), F.coalesce(s, F.lit("null")))))
    )


def fold_watchdog(df: DataFrame, terminal: str = "Completed") -> DataFrame:
    """(stream, started, completed): the first event's time, and whether a terminal event has come (F16)."""
    return df.groupBy("stream").agg((F.max("idx") + 1).alias("version"), F.min_by("ts", "idx").alias("started"), F.bool_or(is_(terminal)).alias("completed"))


def fold_epoch_items(df: DataFrame, items: str = "ids", newest_first: bool = False, use_snapshots: bool = True) -> tuple[DataFrame, DataFrame]:
    """(items: stream, pos, item; state: stream, version, closed) of epochs (F17 newest first, F18, F19 without snapshots).

    Rows: Ingested(ids), Closed, Snapshotted(ids, closed).
    """
    live = prune_to_origin(df, is_("Snapshotted")) if use_snapshots else df
    each = live.where(is_("Ingested", *(["Snapshotted"] if use_snapshots else []))).select("stream", "idx", F.posexplode(items).alias("at", "item"))
    order = F.col("idx").desc() if newest_first else F.col("idx")
    placed = each.select("stream", (F.row_number().over(Window.partitionBy("stream").orderBy(order, "at")) - 1).alias("pos"), "item")
    closed = is_("Closed") | (is_("Snapshotted") & F.coalesce(F.col("closed"), F.lit(False)) if use_snapshots and "closed" in df.columns else F.lit(False))
    return placed, live.groupBy("stream").agg((F.max("idx") + 1).alias("version"), F.bool_or(closed).alias("closed"))


def fold_series_map(df: DataFrame, key: str = "fc", epoch: str = "epoch", active: str = "active") -> DataFrame:
    """(stream, key, epoch): the last epoch started for each key; Snapshotted (map ``active``) replaces all."""
    live = prune_to_origin(df, is_("Snapshotted"))
    started = live.where(is_("Started")).select("stream", "idx", F.col(key).alias("key"), F.col(epoch).alias("epoch"))
    if active in df.columns:
        started = started.unionByName(live.where(is_("Snapshotted")).select("stream", "idx", F.explode(active).alias("key", "epoch")))
    return started.groupBy("stream", "key").agg(F.max_by("epoch", "idx").alias("epoch"))


def fold_sku_items(df: DataFrame, items: str = "items") -> DataFrame:
    """(stream, pos, item): Ingested puts items first, Snapshotted replaces them."""
    placed, _ = fold_epoch_items(df, items, newest_first=True)
    return placed


def fold_periods(df: DataFrame, items: str = "items") -> tuple[DataFrame, DataFrame]:
    """(items: stream, pos, item; state: stream, status, n) of periods.

    Rows: BroughtForward(items), Added(items), CarriedForward(items).
    """
    each = df.where(is_("BroughtForward", "Added")).select("stream", "idx", F.posexplode(items).alias("at", "item"))
    placed = each.select("stream", (F.row_number().over(Window.partitionBy("stream").orderBy("idx", "at")) - 1).alias("pos"), "item")
    n = F.sum(F.when(is_("BroughtForward", "Added"), F.size(items)).otherwise(0))
    state = df.groupBy("stream").agg((F.max("idx") + 1).alias("version"), F.when(F.bool_or(is_("CarriedForward")), "Closed").otherwise("Open").alias("status"), n.alias("n"))
    return placed, state


@dataclass(frozen=True)
class Entries:
    """A fold whose view has an entry for each ``key`` of a stream's events: there while ``keep`` holds for its last event.

    ``among`` tells the events that take part.
    """

    key: Column
    keep: Column
    among: Column


def fold_by_category(df: DataFrame, folds: Mapping[str, Entries]) -> DataFrame:
    """(category, streams, entries) of views of several categories, other events counted as one row each.

    One pass over the log: each event goes to the fold of its category, and one aggregation has the state of
    all, an entry of a stream under its key.
    """
    key, keep, among = F.lit(None).cast("string"), F.lit(True), F.lit(True)
    for category, fold in folds.items():
        own = F.col("category") == category
        key, keep, among = F.when(own, fold.key.cast("string")).otherwise(key), F.when(own, fold.keep).otherwise(keep), F.when(own, fold.among).otherwise(among)
    rows = df.where(among).select("category", "stream", "idx", key.alias("_key"), keep.alias("_keep"))
    state = rows.groupBy("category", "stream", "_key").agg(F.max_by("_keep", "idx").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    known = F.coalesce(F.col("category").isin(*folds), F.lit(False))
    entries = state.where(F.col("_keep")).groupBy("category", "stream").agg(F.sum(F.when(known, 1).otherwise(F.col("_n"))).alias("_n"))
    return entries.groupBy("category").agg(F.count("stream").alias("streams"), F.sum("_n").alias("entries"))

"""Rolling balances: each period opens with what the one before carried forward."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(activity: DataFrame, key: str, period: str, amount: str) -> DataFrame:
    """(key, period, opening, added, closing) of periods with activity; numeric balances."""
    added = activity.groupBy(key, period).agg(F.sum(amount).alias("added"), F.count(F.lit(1)).alias("n"))
    to_here = Window.partitionBy(key).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    return added.withColumn("closing", F.sum("added").over(to_here)).withColumn("opening", F.col("closing") - F.col("added"))


@dataclass(frozen=True)
class Rules:
    """How balances roll from period to period (U4): functions of plain numbers.

    ``opening`` makes a period's opening balance of what the one before carried forward (None for the
    first), ``take`` its closing balance of the opening one and what is added, ``carry`` what it carries forward.
    """

    opening: Callable = lambda carried: carried or 0
    take: Callable = lambda opening, added: opening + added
    carry: Callable = lambda closing: closing


def roll_forward(activity: DataFrame, key: str, period: str, amount: str, rules: Rules) -> DataFrame:
    """(key, period, opening, added, closing, carried) under any rules.

    Sums of each period are dealt by key and stream past one balance at a time: rules of the caller's own have no
    partial form, and a key has no more rows than periods. A null key is a key.
    """
    money, kind = "decimal(28,2)", pa.decimal128(28, 2)
    added = activity.groupBy(key, period).agg(F.sum(amount).cast(money).alias("added"))
    kinds = {f.name: f.dataType.simpleString() for f in added.schema}
    names = ("opening", "closing", "carried")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, carried = object(), None
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [])
            for k, plus in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                current, carried = k, carried if k == current else None
                opening = rules.opening(carried)
                closing = rules.take(opening, plus)
                carried = rules.carry(closing)
                for c, x in zip(columns, (opening, closing, carried), strict=True):
                    c.append(Decimal(x))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, kind) for c in columns)], names=[*batch.schema.names, *names])

    schema = f"`{key}` {kinds[key]}, `{period}` {kinds[period]}, added {money}, opening {money}, closing {money}, carried {money}"
    return added.repartition(F.col(key)).sortWithinPartitions(key, period).mapInArrow(run, schema)


def carry_items(activity: DataFrame, key: str, period: str, item: str, order: list[str]) -> DataFrame:
    """(key, period, item, pos): each item once, in the period that adds it.

    What a period carries forward, all items so far, are the rows of it and of all before it, in the order of
    pos; lists that repeat them for every later period aren't made.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(period, *order)) - 1
    return activity.select(key, period, F.col(item).alias("item"), place.cast("long").alias("pos"))


def carried_by(items: DataFrame, periods: DataFrame, key: str, period: str) -> DataFrame:
    """(key, period, item, pos) of what the given (key, period) carry forward."""
    asked = periods.select(key, F.col(period).alias("_until"))
    return items.join(asked, key).where(F.col(period) <= F.col("_until")).select(key, F.col("_until").alias(period), "item", "pos")


def close_through(activity: DataFrame, key: str, period: str, amount: str, opened: DataFrame | None = None) -> DataFrame:
    """All periods from the first to the last opened one, empty ones too; all before the last are closed (R2).

    ``opened`` (key, last) tells how far each key has been opened; else its last activity does.
    """
    sums = activity.groupBy(key, period).agg(F.sum(amount).alias("added"))
    spans = activity.groupBy(key).agg(F.min(period).alias("_first"), F.max(period).alias("_last"))
    if opened is not None:
        spans = spans.join(opened.select(key, F.col("last").alias("_o")), key, "left").withColumn("_last", F.greatest("_last", "_o"))
    spine = spans.select(key, "_last", F.explode(F.sequence("_first", "_last")).alias(period))
    rows = spine.join(sums, [key, period], "left").withColumn("added", F.coalesce("added", F.lit(0).cast(sums.schema["added"].dataType)))
    to_here = Window.partitionBy(key).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(key, period, "added", F.sum("added").over(to_here).alias("closing"), (F.col(period) < F.col("_last")).alias("closed"))


def spill_over(requests: DataFrame, key: str, order: str, period: str, n: str, k: int) -> DataFrame:
    """Requests with start_period and end_period.

    A request puts at most ``k`` items in a period; more go on in the next ones, which closes those before.
    A request for a closed period goes to the open one. In closed form: with c the periods that a request
    takes and s the sum of c - 1 so far, the open period after it is s + max(asked - s before it).
    """
    by = Window.partitionBy(key).orderBy(order)
    to_here = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = requests.withColumn("_more", F.greatest(F.ceil(F.col(n) / k), F.lit(1)) - 1)
    rows = rows.withColumn("_s", F.sum("_more").over(to_here)).withColumn("_at", F.max(F.col(period) - (F.col("_s") - F.col("_more"))).over(to_here))
    return rows.withColumn("end_period", F.col("_s") + F.col("_at")).withColumn("start_period", F.col("end_period") - F.col("_more")).drop("_more", "_s", "_at")


def place_items(requests: DataFrame, items: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """Items (key, order, pos) with the period that each goes to."""
    return items.join(requests.select(key, order, "start_period"), [key, order]).withColumn("period", F.col("start_period") + F.floor(F.col("pos") / k)).drop("start_period")

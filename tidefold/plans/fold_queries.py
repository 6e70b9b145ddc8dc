"""Folds, snapshots and counts over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables
from ..operators import folds, snapshots, stats
from ..operators.running import written
from .base import EV, ev, query, table, typed


@query(f"""WITH {EV}, live AS (SELECT e.* FROM ev e LEFT JOIN (SELECT stream, max(idx) AS o FROM ev WHERE event_type = 'signup' GROUP BY 1) USING (stream) WHERE o IS NULL OR idx >= o),
m AS (SELECT *, row_number() OVER (PARTITION BY stream, k ORDER BY idx DESC) AS rn FROM live WHERE event_type IN ('click', 'error'))
SELECT stream, k AS sku, ts AS date FROM m WHERE rn = 1 AND event_type = 'click'""")
def fold_favorites(spark: SparkSession, sf: str) -> DataFrame:
    """click favours k, error takes it away, signup starts anew."""
    rows = typed(ev(spark, sf), {"click": "Favorited", "error": "Unfavorited", "signup": "Snapshotted"})
    return folds.fold_favorites(rows, "k", "ts")


TODO_LISTS = f"""WITH {EV}, live AS (SELECT e.* FROM ev e LEFT JOIN (SELECT stream, max(idx) AS o FROM ev WHERE event_type = 'signup' GROUP BY 1) USING (stream) WHERE o IS NULL OR idx >= o),
born AS (SELECT stream, idx, k, amount FROM live WHERE event_type = 'purchase'),
alive AS (SELECT b.*, (SELECT arg_max(u.amount, u.idx) FROM live u WHERE u.stream = b.stream AND u.k = b.k AND u.event_type = 'view' AND u.idx > b.idx) AS upd FROM born b
  WHERE NOT EXISTS (SELECT 1 FROM live d WHERE d.stream = b.stream AND d.k = b.k AND d.event_type = 'error' AND d.idx > b.idx)),
items AS (SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY idx DESC) - 1 AS pos, k AS id, coalesce(upd, amount) AS value FROM alive),
state AS (SELECT l.stream, max(idx) + 1 AS version, coalesce(max(CASE WHEN event_type = 'signup' THEN k END), 0) + count(*) FILTER (event_type = 'purchase') AS next_id FROM live l GROUP BY 1)"""


def todo_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = typed(ev(spark, sf), {"purchase": "Added", "view": "Updated", "error": "Deleted", "signup": "Cleared", "click": "Seen"})
    return rows.select("stream", "idx", "event_type", F.col("k").alias("id"), F.col("amount").alias("value"), F.col("k").alias("next_id"))


@query(f"{TODO_LISTS} SELECT * FROM items")
def fold_todo(spark: SparkSession, sf: str) -> DataFrame:
    """purchase adds k, view updates it, error deletes it, signup clears."""
    return folds.fold_todo(todo_rows(spark, sf))[0]


@query(f"{TODO_LISTS} SELECT s.*, (SELECT count(*) FROM items i WHERE i.stream = s.stream) AS n FROM state s")
def todo_state(spark: SparkSession, sf: str) -> DataFrame:
    """version, next id and size of each list."""
    return folds.fold_todo(todo_rows(spark, sf))[1]


SAVED = f"""WITH {EV}, live AS (SELECT e.* FROM ev e LEFT JOIN (SELECT stream, max(idx) AS o FROM ev WHERE event_type = 'signup' GROUP BY 1) USING (stream) WHERE o IS NULL OR idx >= o),
each AS (SELECT stream, idx, event_type, 0 AS p, k AS sku FROM live WHERE event_type IN ('click', 'error', 'view') UNION ALL SELECT stream, idx, event_type, 1, k + 1 FROM live WHERE event_type = 'click')"""


@query(f"""{SAVED} SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY idx DESC, p) - 1 AS pos, sku FROM each e WHERE event_type IN ('click', 'view')
AND NOT EXISTS (SELECT 1 FROM each d WHERE d.stream = e.stream AND d.sku = e.sku AND d.event_type IN ('error', 'view') AND d.idx > e.idx)""")
def fold_saved(spark: SparkSession, sf: str) -> DataFrame:
    """click adds [k, k+1], error removes k, view merges k, signup clears."""
    rows = ev(spark, sf).withColumn("skus", F.when(F.col("event_type") == "click", F.array(F.col("k"), F.col("k") + 1)).otherwise(F.array("k")))
    return folds.fold_saved(typed(rows, {"click": "Added", "error": "Removed", "view": "Merged", "signup": "Cleared"}))


@query(f"""WITH {EV}, m AS (SELECT *, row_number() OVER (PARTITION BY stream, k ORDER BY idx DESC) AS rn FROM ev WHERE event_type IN ('click', 'error'))
SELECT stream, count(*) AS n FROM m WHERE rn = 1 AND event_type = 'click' GROUP BY 1""")
def fold_favorite_set(spark: SparkSession, sf: str) -> DataFrame:
    """sizes of sets of favourites, without origins."""
    held = folds.fold_favorites(typed(ev(spark, sf), {"click": "Favorited", "error": "Unfavorited"}), "k", "ts")
    return held.groupBy("stream").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EV} SELECT stream, max(idx) + 1 AS version, bool_or(event_type = 'purchase' AND idx >= coalesce(o, 0)) AS flag FROM ev LEFT JOIN (SELECT stream, max(idx) AS o FROM ev WHERE event_type = 'signup' GROUP BY 1) USING (stream)
WHERE event_type IN ('purchase', 'signup') AND idx >= coalesce(o, 0) GROUP BY stream""")
def fold_flag(spark: SparkSession, sf: str) -> DataFrame:
    """F8: has purchased since the last signup."""
    return folds.fold_flag(typed(ev(spark, sf), {"purchase": "Happened", "signup": "Snapshotted"}))


STAYS = f"""WITH {EV}, c AS (SELECT stream, min(idx) AS closed_at FROM ev WHERE event_type = 'signup' AND idx >= 30 GROUP BY 1),
r AS (SELECT ev.*, closed_at, coalesce(idx > closed_at, false) AS late FROM ev LEFT JOIN c USING (stream) WHERE event_type IN ('purchase', 'click') OR (event_type = 'signup' AND idx >= 30)),
stays AS (SELECT stream, max(idx) + 1 AS version, CAST(coalesce(sum(CASE event_type WHEN 'purchase' THEN amount WHEN 'click' THEN -amount END), 0) AS DECIMAL(18,2)) AS balance,
  array_to_string(list(k ORDER BY idx) FILTER (event_type = 'purchase'), ',') AS charge_ids, array_to_string(list(k ORDER BY idx) FILTER (event_type = 'click'), ',') AS payment_ids, CASE WHEN bool_or(event_type = 'signup') THEN 'Closed' ELSE 'Active' END AS status FROM r WHERE NOT late GROUP BY 1)"""


def stay_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = ev(spark, sf).where("event_type in ('purchase', 'click') or (event_type = 'signup' and idx >= 30)")
    return typed(rows, {"purchase": "Charged", "click": "Paid", "signup": "CheckedOut"}).withColumns({"id": F.col("k").cast("string"), "group_id": F.lit(None).cast("string")})


@query(f"{STAYS} SELECT * REPLACE (coalesce(charge_ids, '') AS charge_ids, coalesce(payment_ids, '') AS payment_ids) FROM stays")
def fold_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """purchases are charges, clicks payments, the first signup after 30 events checks out."""
    stays = folds.fold_stays(stay_rows(spark, sf))[0]
    return stays.select("stream", "version", "balance", *[F.array_join(c, ",").alias(c) for c in ("charge_ids", "payment_ids")], "status")


@query(f"{STAYS} SELECT stream, count(*) AS n, min(idx) AS first_idx FROM r WHERE late GROUP BY 1")
def ledger_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """rows that follow the closing event."""
    return folds.fold_stays(stay_rows(spark, sf))[1].groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"))


@query(f"""WITH {EV} SELECT stream, count(*) AS n, CAST(sum(amount) AS DECIMAL(28,2)) AS amount FROM ev LEFT JOIN (SELECT stream, max(idx) AS o FROM ev WHERE event_type = 'signup' GROUP BY 1) USING (stream) WHERE o IS NULL OR idx >= o GROUP BY 1""")
def origin_prune(spark: SparkSession, sf: str) -> DataFrame:
    """what is left from the last signup on."""
    return folds.prune_to_origin(ev(spark, sf), F.col("event_type") == "signup").groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("decimal(28,2)").alias("amount"))


@query(f"WITH {EV} SELECT stream, max(idx) + 1 AS version FROM ev GROUP BY 1")
def stream_version(spark: SparkSession, sf: str) -> DataFrame:
    """F3."""
    return folds.versions(ev(spark, sf))


@query(f"""WITH {EV}, t AS (SELECT stream, list(CASE event_type WHEN 'purchase' THEN amount WHEN 'click' THEN -amount ELSE 0 END ORDER BY idx) AS l, max(idx) + 1 AS version FROM ev GROUP BY 1)
SELECT stream, version, CAST(list_sum(l) AS DECIMAL(28,2)) AS balance, len(l) AS steps FROM t""")
def fold_generic(spark: SparkSession, sf: str) -> DataFrame:
    """A left fold that a pair of column functions gives."""
    start = F.struct(F.lit(0).cast("decimal(28,2)").alias("balance"), F.lit(0).cast("long").alias("steps"))

    def evolve(s, e):
        delta = F.when(e["event_type"] == "purchase", e["amount"]).when(e["event_type"] == "click", -e["amount"]).otherwise(0)
        return F.struct((s["balance"] + delta).cast("decimal(28,2)").alias("balance"), (s["steps"] + 1).alias("steps"))

    return folds.fold_streams(ev(spark, sf), start, evolve, "amount").select("stream", "version", "state.balance", "state.steps")


@query(f"""WITH {EV} SELECT stream, max(idx) + 1 AS version, CAST(coalesce(sum(amount) FILTER (event_type = 'purchase'), 0) - coalesce(sum(amount) FILTER (event_type = 'click'), 0) AS DECIMAL(28,2)) AS balance,
arg_max(event_type, idx) FILTER (event_type <> 'view') AS last_type, count(*) AS steps FROM ev GROUP BY 1""")
def fold_associative(spark: SparkSession, sf: str) -> DataFrame:
    """A fold whose states are combined in any grouping: sums, a count, and the last type but views."""
    delta = F.when(F.col("event_type") == "purchase", F.col("amount")).when(F.col("event_type") == "click", -F.col("amount")).otherwise(0)
    lift = F.struct(delta.cast("decimal(28,2)").alias("balance"), F.lit(1).cast("long").alias("steps"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("last_type"))

    def combine(a, b):
        return F.struct((a["balance"] + b["balance"]).alias("balance"), (a["steps"] + b["steps"]).alias("steps"), F.coalesce(b["last_type"], a["last_type"]).alias("last_type"))

    return folds.fold_combined(ev(spark, sf), lift, combine, block=8).select("stream", "version", "state.balance", "state.last_type", "state.steps")


@query(f"""WITH {EV}, g AS (SELECT stream, event_type, idx - row_number() OVER (PARTITION BY stream, event_type ORDER BY idx) AS k FROM ev), c AS (SELECT stream, count(*) AS n FROM g GROUP BY stream, event_type, k)
SELECT stream, max(idx) + 1 AS version, (SELECT max(n) FROM c WHERE c.stream = ev.stream) AS longest FROM ev GROUP BY stream""")
def fold_function(spark: SparkSession, sf: str) -> DataFrame:
    """A fold of any kind as a table function in SQL: the longest row of events of one type."""

    def evolve(state: tuple, e) -> tuple:
        last, now, longest = state
        now = now + 1 if e.event_type == last else 1
        return e.event_type, now, max(longest, now)

    tables.register_fold(spark, "longest_streak", (None, 0, 0), evolve, "long", result=lambda s: s[2])
    events = ev(spark, sf).select("stream", "idx", "event_type")
    return spark.sql("SELECT stream, version, state AS longest FROM longest_streak(TABLE({events}))", events=events)


GROUP = """rows AS (SELECT o_custkey, o_orderkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS idx FROM orders)"""


@query(f"""WITH {GROUP} SELECT concat('GroupCheckout-', o_custkey) AS stream, 2 * (max(idx) + 1) AS version, CAST(coalesce(sum(amount) FILTER (o_orderstatus = 'F'), 0) AS DECIMAL(18,2)) AS balance,
count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) FILTER (o_orderstatus = 'F') AS checked_out, count(*) FILTER (o_orderstatus = 'O') AS failed,
CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'MergeStays' ELSE 'Ready' END AS next_action FROM rows GROUP BY o_custkey""")
def fold_group_checkout(spark: SparkSession, sf: str) -> DataFrame:
    """a customer's orders are selected stays; those with status F are merged, those with O fail, the others are pending."""
    from pyspark.sql import Window

    o = table(spark, sf, "orders").withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1)
    stay, stream = F.col("o_orderkey").cast("string"), F.concat(F.lit("GroupCheckout-"), F.col("o_custkey").cast("string"))
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    later = F.when(F.col("o_orderstatus") == "F", "StaysMerged").when(F.col("o_orderstatus") == "O", "MergesFailed").otherwise("Seen")
    residuals = F.when(later == "StaysMerged", F.array(F.struct(stay.alias("stay"), amount.alias("residual"))))
    none = F.lit(None).cast("array<struct<stay:string,residual:decimal(18,2)>>")
    both = F.array(F.struct((2 * F.col("n")).cast("long").alias("idx"), F.lit("StaysSelected").alias("event_type"), F.array(stay).alias("stays"), none.alias("residuals")), F.struct((2 * F.col("n") + 1).cast("long").alias("idx"), later.alias("event_type"), F.array(stay).alias("stays"), residuals.alias("residuals")))
    rows = o.select(stream.alias("stream"), F.explode(both).alias("e")).select("stream", "e.*").withColumn("amount", F.lit(None).cast("decimal(18,2)"))
    state = folds.fold_group_checkout(rows)
    return state.select("stream", "version", "balance", *[F.size(c).cast("long").alias(c) for c in ("pending", "checked_out", "failed")], "next_action")


@query(f"""WITH {EV}, live AS (SELECT e.* FROM ev e LEFT JOIN (SELECT stream, max(idx) AS o FROM ev WHERE event_type IN ('signup', 'error') GROUP BY 1) USING (stream) WHERE o IS NULL OR idx >= o)
SELECT stream, max(idx) + 1 AS version, arg_max(CASE WHEN event_type IN ('click', 'signup') THEN k END, CASE WHEN event_type IN ('click', 'signup') THEN idx END) AS reservation,
CASE WHEN max(CASE WHEN event_type IN ('purchase', 'signup') THEN idx END) > coalesce(max(CASE WHEN event_type = 'click' THEN idx END), -1) THEN arg_max(k, CASE WHEN event_type IN ('purchase', 'signup') THEN idx END) END AS association
FROM live WHERE event_type <> 'view' GROUP BY 1""")
def fold_shipments(spark: SparkSession, sf: str) -> DataFrame:
    """click reserves, purchase assigns, error revokes, signup is a snapshot."""
    rows = typed(ev(spark, sf), {"click": "Reserved", "purchase": "Assigned", "error": "Revoked", "signup": "Snapshotted"})
    return folds.fold_shipments(rows.withColumns({"tx": F.col("k"), "container": F.col("k")}))


@query(f"WITH {EV} SELECT stream, max(idx) + 1 AS version, arg_max(k, idx) AS value FROM ev WHERE event_type IN ('purchase', 'signup') GROUP BY 1")
def fold_latest(spark: SparkSession, sf: str) -> DataFrame:
    """the last of some event types decides."""
    return folds.fold_latest(ev(spark, sf), "k", "purchase", "signup")


STEPS = "CASE event_type WHEN 'signup' THEN 'R' WHEN 'click' THEN 'C' WHEN 'error' THEN 'V' WHEN 'view' THEN 'A' ELSE 'F' END"


@query(f"""WITH RECURSIVE {EV}, e AS (SELECT stream, idx, {STEPS} AS t FROM ev), last AS (SELECT stream, max(idx) AS n FROM e GROUP BY 1),
f AS (SELECT stream, CAST(-1 AS BIGINT) AS idx, 'Initial' AS s FROM last UNION ALL
  SELECT e.stream, e.idx, CASE WHEN t = 'R' THEN 'Reserving' WHEN t = 'C' AND s = 'Reserving' THEN 'Assigning' WHEN t = 'V' THEN 'Reverting' WHEN t = 'A' AND s = 'Assigning' THEN 'Assigned'
    WHEN t = 'F' AND s = 'Reverting' THEN 'Failed' WHEN t = 'F' AND s = 'Assigned' THEN 'Succeeded' ELSE s END FROM f JOIN e ON e.stream = f.stream AND e.idx = f.idx + 1)
SELECT f.stream, f.idx + 1 AS version, CASE WHEN s IN ('Failed', 'Succeeded') THEN 'Completed' ELSE s END AS status, CASE s WHEN 'Succeeded' THEN true WHEN 'Failed' THEN false END AS success
FROM f JOIN last ON f.stream = last.stream AND f.idx = last.n""")
def fold_transactions(spark: SparkSession, sf: str) -> DataFrame:
    """signup requests, click completes reservation, error reverts, view completes assignment, purchase completes."""
    rows = typed(ev(spark, sf), {"signup": "FinalizationRequested", "click": "ReservationCompleted", "error": "RevertCommenced", "view": "AssignmentCompleted", "purchase": "Completed"})
    rows = rows.withColumns({"container": F.col("k").cast("string"), "shipments": F.array(F.col("k").cast("string"))})
    return folds.fold_transactions(rows).select("stream", "version", "state.status", "state.success")


@query(f"""WITH RECURSIVE {EV}, e AS (SELECT stream, idx, {STEPS} AS t FROM ev), last AS (SELECT stream, max(idx) AS n FROM e GROUP BY 1),
f AS (SELECT stream, CAST(-1 AS BIGINT) AS idx, 'Initial' AS s FROM last UNION ALL
  SELECT e.stream, e.idx, CASE WHEN t = 'R' THEN 'Reserving' WHEN t = 'C' AND s = 'Reserving' THEN 'Assigning' WHEN t = 'V' THEN 'Reverting' WHEN t = 'A' AND s = 'Assigning' THEN 'Assigned'
    WHEN t = 'F' AND s = 'Reverting' THEN 'Failed' WHEN t = 'F' AND s = 'Assigned' THEN 'Succeeded' ELSE s END FROM f JOIN e ON e.stream = f.stream AND e.idx = f.idx + 1)
SELECT CASE s WHEN 'Reserving' THEN 'ReserveShipments' WHEN 'Reverting' THEN 'RevertReservations' WHEN 'Assigning' THEN 'AssignShipments' WHEN 'Assigned' THEN 'FinalizeContainer' ELSE 'Finish' END AS phase, count(*) AS n
FROM f JOIN last ON f.stream = last.stream AND f.idx = last.n WHERE s <> 'Initial' GROUP BY 1""")
def transaction_phases(spark: SparkSession, sf: str) -> DataFrame:
    """what comes next for each transaction that has begun."""
    rows = typed(ev(spark, sf), {"signup": "FinalizationRequested", "click": "ReservationCompleted", "error": "RevertCommenced", "view": "AssignmentCompleted", "purchase": "Completed"})
    rows = rows.withColumns({"container": F.col("k").cast("string"), "shipments": F.array(F.col("k").cast("string"))})
    begun = rows.where("event_type in ('FinalizationRequested', 'RevertCommenced')").select("stream").distinct()
    return folds.fold_transactions(rows.join(begun, "stream", "left_semi")).groupBy("phase").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EV} SELECT stream, max(idx) + 1 AS version, arg_min(ts, idx) AS started, bool_or(event_type = 'purchase') AS completed FROM ev GROUP BY 1")
def fold_watchdog(spark: SparkSession, sf: str) -> DataFrame:
    """F16: begun by the first event, ended by a purchase."""
    return folds.fold_watchdog(ev(spark, sf), "purchase")


EPOCH = f"WITH {EV}, live AS (SELECT e.* FROM ev e LEFT JOIN (SELECT stream, max(idx) AS o FROM ev WHERE event_type = 'signup' GROUP BY 1) USING (stream) WHERE o IS NULL OR idx >= o)"


def _epoch_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = typed(ev(spark, sf), {"click": "Ingested", "view": "Ingested", "purchase": "Closed", "signup": "Snapshotted"})
    return rows.withColumns({"ids": F.array(F.col("k"), F.col("k") + 1), "closed": F.lit(False)})


@query(f"{EPOCH}, e AS (SELECT stream, idx, 0 AS p, k AS item FROM live WHERE event_type IN ('click', 'view', 'signup') UNION ALL SELECT stream, idx, 1, k + 1 FROM live WHERE event_type IN ('click', 'view', 'signup')) SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY idx DESC, p) - 1 AS pos, item FROM e")
def fold_list_epoch(spark: SparkSession, sf: str) -> DataFrame:
    """items of epochs, newest first."""
    return folds.fold_epoch_items(_epoch_rows(spark, sf), newest_first=True)[0]


@query(f"{EPOCH}, e AS (SELECT stream, idx, 0 AS p, k AS item FROM live WHERE event_type IN ('click', 'view', 'signup') UNION ALL SELECT stream, idx, 1, k + 1 FROM live WHERE event_type IN ('click', 'view', 'signup')) SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY idx, p) - 1 AS pos, item FROM e")
def fold_ticket_epoch(spark: SparkSession, sf: str) -> DataFrame:
    """items of epochs, in order of arrival."""
    return folds.fold_epoch_items(_epoch_rows(spark, sf))[0]


@query(f"WITH {EV} SELECT stream, max(idx) + 1 AS version, bool_or(event_type = 'purchase') AS closed, 2 * count(*) FILTER (event_type IN ('click', 'view')) AS n FROM ev WHERE event_type <> 'error' GROUP BY 1")
def fold_epoch_reader(spark: SparkSession, sf: str) -> DataFrame:
    """the reader's view of epochs, which looks at no snapshot."""
    items, state = folds.fold_epoch_items(_epoch_rows(spark, sf), use_snapshots=False)
    return state.join(items.groupBy("stream").agg(F.count(F.lit(1)).alias("n")), "stream", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(f"""WITH {EV} SELECT category AS stream, k % 7 AS key, arg_max(user_id, position) AS epoch FROM ev WHERE event_type = 'click' AND position >= (SELECT max(position) FROM ev WHERE event_type = 'signup' AND position < (SELECT max(position) / 2 FROM ev)) GROUP BY 1, 2""")
def fold_series_map(spark: SparkSession, sf: str) -> DataFrame:
    """the last epoch begun for each key, over one log in position order; signups of its first half are snapshots."""
    rows = table(spark, sf, "events").select(F.lit("User").alias("stream"), F.col("event_id").alias("idx"), "event_type", (F.get_json_object("props", "$.k").cast("int") % 7).alias("fc"), F.col("user_id").alias("epoch"))
    half = rows.agg((F.max("idx") / 2).alias("h"))
    rows = rows.join(F.broadcast(half), F.lit(True)).where("event_type = 'click' or (event_type = 'signup' and idx < h)")
    return folds.fold_series_map(typed(rows, {"click": "Started", "signup": "Snapshotted"})).select("stream", "key", "epoch")


@query("""SELECT concat('Period-', year(o_orderdate), '-', o_custkey) AS stream, count(*) AS version, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'Closed' ELSE 'Open' END AS status, count(*) FILTER (o_orderstatus <> 'F') AS n FROM orders GROUP BY year(o_orderdate), o_custkey""")
def fold_periods(spark: SparkSession, sf: str) -> DataFrame:
    """a customer's year is a period; orders with status F carry it forward."""
    from pyspark.sql import Window

    stream = F.concat(F.lit("Period-"), F.year("o_orderdate").cast("string"), F.lit("-"), F.col("o_custkey").cast("string"))
    o = table(spark, sf, "orders").withColumn("stream", stream)
    rows = o.select("stream", (F.row_number().over(Window.partitionBy("stream").orderBy("o_orderdate", "o_orderkey")) - 1).cast("long").alias("idx"), F.when(F.col("o_orderstatus") == "F", "CarriedForward").otherwise("Added").alias("event_type"), F.array("o_orderkey").alias("items"))
    return folds.fold_periods(rows)[1]


@query(f"""WITH {EV}, fav AS (SELECT *, row_number() OVER (PARTITION BY stream, k ORDER BY idx DESC) AS rn FROM ev WHERE event_type IN ('click', 'error'))
SELECT 'even' AS category, count(DISTINCT stream) AS streams, count(*) AS entries FROM fav WHERE rn = 1 AND event_type = 'click' AND user_id % 3 = 0
UNION ALL SELECT 'odd', count(DISTINCT stream), count(*) FROM (SELECT stream, max(idx) FROM ev WHERE user_id % 3 = 1 GROUP BY 1)
UNION ALL SELECT 'rest', count(DISTINCT stream), count(*) FROM ev WHERE user_id % 3 = 2 HAVING count(*) > 0""")
def fold_by_category(spark: SparkSession, sf: str) -> DataFrame:
    """Several categories in one pass, other events counted."""
    rows = ev(spark, sf).withColumn("category", F.element_at(F.array(F.lit("even"), F.lit("odd"), F.lit("rest")), (F.col("user_id") % 3 + 1).cast("int")))
    kind = F.col("event_type")
    favorites = folds.Entries(F.col("k"), kind == "click", kind.isin("click", "error"))
    return folds.fold_by_category(rows, {"even": favorites, "odd": folds.Entries(F.lit("version"), F.lit(True), F.lit(True))})


# Folds that begin at what a snapshot holds

LIVE = f"""WITH {EV}, live AS (SELECT e.* FROM ev e LEFT JOIN (SELECT stream, max(idx) AS o FROM ev WHERE event_type = 'signup' GROUP BY 1) USING (stream) WHERE o IS NULL OR idx >= o)"""


@query(f"""{LIVE}, m AS (SELECT *, row_number() OVER (PARTITION BY stream, k ORDER BY idx DESC) AS rn FROM live WHERE event_type IN ('click', 'error', 'signup'))
SELECT stream, k AS sku, ts AS date FROM m WHERE rn = 1 AND event_type <> 'error'""")
def favorites_from_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """a snapshot's own favourites, here its k, are where the fold begins."""
    rows = typed(ev(spark, sf), {"click": "Favorited", "error": "Unfavorited", "signup": "Snapshotted"})
    return folds.fold_favorites(rows.withColumn("net", F.when(F.col("event_type") == "Snapshotted", F.array(F.struct("k", "ts")))), "k", "ts")


@query(f"{LIVE} SELECT stream, max(idx) + 1 AS version, bool_or(event_type = 'purchase' OR k % 2 = 0) AS flag FROM live WHERE event_type IN ('purchase', 'signup') GROUP BY stream")
def flag_from_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """F8: snapshots of an even k hold a set flag."""
    return folds.fold_flag(typed(ev(spark, sf), {"purchase": "Happened", "signup": "Snapshotted"}), snapshot_value=F.col("k") % 2 == 0)


@query(f"""WITH RECURSIVE {EV}, e AS (SELECT stream, idx, k, {STEPS} AS t FROM ev), last AS (SELECT stream, max(idx) AS n FROM e GROUP BY 1),
f AS (SELECT stream, CAST(-1 AS BIGINT) AS idx, 'Initial' AS s FROM last UNION ALL
  SELECT e.stream, e.idx, CASE WHEN t = 'R' THEN CASE k % 3 WHEN 0 THEN 'Reserving' WHEN 1 THEN 'Assigning' ELSE 'Assigned' END WHEN t = 'C' AND s = 'Reserving' THEN 'Assigning' WHEN t = 'V' THEN 'Reverting' WHEN t = 'A' AND s = 'Assigning' THEN 'Assigned'
    WHEN t = 'F' AND s = 'Reverting' THEN 'Failed' WHEN t = 'F' AND s = 'Assigned' THEN 'Succeeded' ELSE s END FROM f JOIN e ON e.stream = f.stream AND e.idx = f.idx + 1)
SELECT f.stream, f.idx + 1 AS version, CASE WHEN s IN ('Failed', 'Succeeded') THEN 'Completed' ELSE s END AS status, CASE s WHEN 'Succeeded' THEN true WHEN 'Failed' THEN false END AS success
FROM f JOIN last ON f.stream = last.stream AND f.idx = last.n""")
def transactions_from_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """signups are snapshots that hold one of three states."""
    rows = typed(ev(spark, sf), {"signup": "Snapshotted", "click": "ReservationCompleted", "error": "RevertCommenced", "view": "AssignmentCompleted", "purchase": "Completed"})
    status = F.element_at(F.array(F.lit("Reserving"), F.lit("Assigning"), F.lit("Assigned")), F.col("k") % 3 + 1)
    state = F.struct(status.alias("status"), F.col("k").cast("string").alias("container"), F.array(F.col("k").cast("string")).alias("shipments"), F.lit(None).cast("boolean").alias("success"))
    rows = rows.withColumns({"container": F.col("k").cast("string"), "shipments": F.array(F.col("k").cast("string")), "state": F.when(F.col("event_type") == "Snapshotted", state)})
    return folds.fold_transactions(rows).select("stream", "version", "state.status", "state.success")


@query(f"""WITH {EV}, p AS (SELECT max(position) AS p FROM ev WHERE event_type = 'signup' AND position < (SELECT max(position) / 2 FROM ev))
SELECT category AS stream, k % 7 AS key, arg_max(user_id, position) AS epoch FROM ev, p WHERE (event_type = 'click' AND position >= p) OR position = p GROUP BY 1, 2""")
def series_from_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """as fold_series_map, where a snapshot holds the epoch of its own key."""
    rows = table(spark, sf, "events").select(F.lit("User").alias("stream"), F.col("event_id").alias("idx"), "event_type", (F.get_json_object("props", "$.k").cast("int") % 7).alias("fc"), F.col("user_id").alias("epoch"))
    half = rows.agg((F.max("idx") / 2).alias("h"))
    rows = rows.join(F.broadcast(half), F.lit(True)).where("event_type = 'click' or (event_type = 'signup' and idx < h)")
    held = F.when(F.col("event_type") == "Snapshotted", F.create_map("fc", "epoch"))
    return folds.fold_series_map(typed(rows, {"click": "Started", "signup": "Snapshotted"}).withColumn("active", held)).select("stream", "key", "epoch")


@query(f"{LIVE} SELECT stream, max(idx) + 1 AS version, bool_or(event_type = 'purchase' OR (event_type = 'signup' AND k % 2 = 0)) AS closed FROM live WHERE event_type <> 'error' GROUP BY 1")
def epoch_from_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """snapshots of an even k were taken of closed epochs."""
    return folds.fold_epoch_items(_epoch_rows(spark, sf).withColumn("closed", F.col("k") % 2 == 0))[1]


@query("""SELECT concat('GroupCheckout-', o_custkey) AS stream, count(*) AS version, CAST(coalesce(sum(CASE o_orderstatus WHEN 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) WHEN 'P' THEN -CAST(o_totalprice AS DECIMAL(18,2)) END), 0) AS DECIMAL(18,2)) AS balance,
count(*) FILTER (o_orderstatus = 'F') AS checked_out, bool_or(o_orderpriority = '1-URGENT' AND o_orderstatus = 'O') AS completed, CASE WHEN bool_or(o_orderpriority = '1-URGENT' AND o_orderstatus = 'O') THEN 'Finished' ELSE 'Ready' END AS next_action FROM orders GROUP BY o_custkey""")
def group_payments(spark: SparkSession, sf: str) -> DataFrame:
    """orders with status F are merged stays, those with P payments, open urgent ones confirm the group."""
    from pyspark.sql import Window

    stay, amount, status = F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderstatus")
    o = table(spark, sf, "orders").withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1)
    kind = F.when(status == "F", "StaysMerged").when(status == "P", "Paid").when(F.col("o_orderpriority") == "1-URGENT", "Confirmed").otherwise("Seen")
    rows = o.select(F.concat(F.lit("GroupCheckout-"), F.col("o_custkey").cast("string")).alias("stream"), F.col("n").cast("long").alias("idx"), kind.alias("event_type"), F.array(stay).alias("stays"), F.when(status == "F", F.array(F.struct(stay.alias("stay"), amount.alias("residual")))).alias("residuals"), amount.alias("amount"))
    return folds.fold_group_checkout(rows).select("stream", "version", "balance", F.size("checked_out").cast("long").alias("checked_out"), "completed", "next_action")


# Snapshots


@query(f"WITH {EV}, l AS (SELECT stream, arg_max(event_type, idx) AS t FROM ev GROUP BY 1) SELECT CASE WHEN t = 'signup' THEN 'Valid' ELSE 'Invalid' END AS result, count(*) AS n FROM l GROUP BY 1")
def snapshot_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Streams whose last event is a signup need no snapshot."""
    return snapshots.audit_snapshots(ev(spark, sf), F.col("event_type") == "signup").groupBy("result").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EV} SELECT stream, CAST(sum(amount) AS DECIMAL(28,2)) AS balance FROM ev GROUP BY 1")
def snapshot_read(spark: SparkSession, sf: str) -> DataFrame:
    """From the snapshot of the first 20 events and what follows, the same as from all events."""
    e = ev(spark, sf)
    old = e.where("idx < 20").groupBy("stream").agg(F.max("idx").alias("v"), F.sum("amount").alias("state"))
    held = old.select("stream", F.lit("Sum1").alias("snapshot_type"), (F.col("v") + 1).alias("version"), "state")
    rows = snapshots.since_snapshot(e, held, "Sum1")
    return rows.groupBy("stream").agg((F.coalesce(F.max("seed"), F.lit(0)) + F.coalesce(F.sum("amount"), F.lit(0))).cast("decimal(28,2)").alias("balance"))


@query(f"WITH {EV} SELECT stream, CAST(sum(amount) AS DECIMAL(28,2)) AS balance, count(*) FILTER (idx >= 20) AS later FROM ev GROUP BY 1")
def snapshot_read_any_tag(spark: SparkSession, sf: str) -> DataFrame:
    """Of two snapshots of a stream under different tags the newer one is read, and each later event once."""
    e = ev(spark, sf)
    old = lambda n: e.where(F.col("idx") < n).groupBy("stream").agg((F.max("idx") + 1).alias("version"), F.sum("amount").alias("state")).withColumn("snapshot_type", F.lit(f"Sum{n}"))
    rows = snapshots.since_snapshot(e, old(10).unionByName(old(20)))
    return rows.groupBy("stream").agg((F.coalesce(F.max("seed"), F.lit(0)) + F.coalesce(F.sum("amount"), F.lit(0))).cast("decimal(28,2)").alias("balance"), F.count("idx").alias("later"))


@query(f"WITH {EV} SELECT stream, max(idx) + 1 AS version, max(ts) AS last_ts FROM ev GROUP BY 1")
def snapshot_free_read(spark: SparkSession, sf: str) -> DataFrame:
    """Every event is folded, snapshots or not."""
    return snapshots.read_all(ev(spark, sf), lambda df: df.groupBy("stream").agg((F.max("idx") + 1).alias("version"), F.max("ts").alias("last_ts")))


@query(f"WITH {EV} SELECT stream, CAST(max(idx) AS BIGINT) AS idx, arg_max(event_type, idx) AS event_type FROM ev GROUP BY 1")
def latest_event(spark: SparkSession, sf: str) -> DataFrame:
    """N4."""
    return snapshots.latest_event(ev(spark, sf), "event_type")


@query(f"""WITH {EV}, l AS (SELECT stream, arg_max(event_type, idx) AS t, max(idx) + 1 AS version, CAST(count(*) AS VARCHAR) AS state FROM ev GROUP BY 1)
SELECT stream, 'Count1' AS snapshot_type, version, state FROM l WHERE t <> 'signup'""")
def snapshot_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots of the streams that lack a valid one."""
    fold = lambda df: df.groupBy("stream", "category").agg((F.max("idx") + 1).alias("version"), F.count(F.lit(1)).cast("string").alias("state"))
    return snapshots.refresh_snapshots(ev(spark, sf), F.col("event_type") == "signup", fold, "Count1").select("stream", "snapshot_type", "version", "state")


@query(f"""WITH {EV}, l AS (SELECT stream, user_id, arg_max(event_type, idx) AS t, max(idx) + 1 AS version, CAST(count(*) AS VARCHAR) AS state FROM ev GROUP BY 1, 2)
SELECT stream, 'Count1' AS snapshot_type, version, CASE WHEN user_id % 3 = 0 THEN 'held' ELSE state END AS state FROM l WHERE t <> 'signup' OR user_id % 3 = 0
UNION ALL SELECT stream, 'Count1', version - 1, 'stale' FROM l WHERE t = 'signup' AND user_id % 3 = 1""")
def snapshot_renewal(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the streams has a snapshot that still holds, a third one that is behind."""
    e = ev(spark, sf)
    fold = lambda df: df.groupBy("stream", "category").agg((F.max("idx") + 1).alias("version"), F.count(F.lit(1)).cast("string").alias("state"))
    third = F.col("user_id") % 3
    made = e.where(third < 2).groupBy("stream", "category", third.alias("third")).agg((F.max("idx") + 1).alias("version"))
    held = made.select("stream", "category", F.lit("Count1").alias("snapshot_type"), (F.col("version") - F.col("third")).alias("version"), F.when(F.col("third") == 0, "held").otherwise("stale").alias("state"))
    return snapshots.refresh_snapshots(e, F.col("event_type") == "signup", fold, "Count1", held).select("stream", "snapshot_type", "version", "state")


@query(f"WITH {EV}, h AS (SELECT stream, list(DISTINCT event_type) AS have FROM ev WHERE k % 9 = 0 GROUP BY 1) SELECT stream, len(list_filter(['click', 'purchase', 'view'], lambda x: NOT list_contains(have, x))) AS n_missing FROM h")
def snapshot_unfolds(spark: SparkSession, sf: str) -> DataFrame:
    """How many of three expected snapshot types a stream lacks; the types of its events of every ninth k stand for them."""
    rows = ev(spark, sf).where("k % 9 = 0").withColumnRenamed("event_type", "snapshot_type")
    return snapshots.all_unfolds_present(rows, ["click", "purchase", "view"]).select("stream", F.size("missing").cast("long").alias("n_missing"))


# Counts


@query(f"""WITH {EV}, h AS (SELECT *, event_type IN ('click', 'purchase') AS handled FROM ev) SELECT handled, category, event_type, count(*) AS n FROM h GROUP BY ROLLUP (handled, category, event_type)""")
def event_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Handled and ignored, by category and type, with totals."""
    return stats.event_counts(ev(spark, sf), F.col("event_type").isin("click", "purchase"))


@query("SELECT DISTINCT lang AS category FROM documents WHERE lang IS NOT NULL")
def categories_seen(spark: SparkSession, sf: str) -> DataFrame:
    """T3."""
    return stats.categories_seen(table(spark, sf, "documents").where("lang is not null").withColumnRenamed("lang", "category"))


@query(f"WITH {EV} SELECT stream, count(*) AS n FROM ev WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, stream LIMIT 5")
def top_categories(spark: SparkSession, sf: str) -> DataFrame:
    """T4: the five streams with most errors."""
    return stats.top(ev(spark, sf).where("event_type = 'error'"), "stream")


@query(f"""WITH {EV}, s AS (SELECT stream, CAST(ts AS DATE) AS day, bool_or(event_type <> 'view') AS change, count(*) AS n, max(idx) + 1 AS version FROM ev GROUP BY 1, 2),
h AS (SELECT stream, max(idx) + 1 AS v FROM ev WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1), o AS (SELECT *, CASE WHEN NOT change THEN 'Skipped' WHEN version > coalesce(v, -1) THEN 'Ok' ELSE 'Stale' END AS outcome FROM s LEFT JOIN h USING (stream))
SELECT outcome, count(*) AS spans, sum(CASE WHEN outcome = 'Ok' THEN 1 ELSE 0 END)::BIGINT AS used, sum(CASE WHEN outcome = 'Ok' THEN n - 1 ELSE n END)::BIGINT AS unused FROM o GROUP BY 1""")
def outcome_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Spans are days of a user; views change nothing; versions up to a date are held already."""
    e = ev(spark, sf).withColumn("day", F.to_date("ts"))
    spans = e.groupBy("stream", "day").agg(F.bool_or(F.col("event_type") != "view").alias("change"), F.count(F.lit(1)).alias("n"), (F.max("idx") + 1).alias("version"))
    held = folds.versions(e.where("ts < timestamp '2024-01-10'")).withColumnRenamed("version", "v")
    return stats.outcome_counts(spans.join(held, "stream", "left").withColumn("accepted", F.col("version") > F.coalesce("v", F.lit(-1))))


@query(f"""WITH {EV} SELECT event_type AS category, count(*) AS n, CAST(sum(amount) AS DECIMAL(28,2)) AS total, max(amount) AS longest, CAST(round(avg(amount), 4) AS DECIMAL(18,4)) AS mean,
CAST(quantile_disc(amount, 0.5) AS DECIMAL(18,2)) AS p50, CAST(quantile_disc(amount, 0.95) AS DECIMAL(18,2)) AS p95, CAST(quantile_disc(amount, 0.99) AS DECIMAL(18,2)) AS p99 FROM ev GROUP BY ROLLUP (event_type)""")
def latency_by_category(spark: SparkSession, sf: str) -> DataFrame:
    """A measured amount by event type and in all."""
    out = stats.latency(ev(spark, sf), "amount", "event_type")
    return out.select(F.col("event_type").alias("category"), "n", F.col("total").cast("decimal(28,2)").alias("total"), "longest", F.round("mean", 4).cast("decimal(18,4)").alias("mean"), "p50", "p95", "p99")


@query(f"""WITH {EV} SELECT event_type AS category, count(*) AS n, max(amount) AS longest, true AS p50_within, true AS p95_within, true AS p99_within, true AS users_within FROM ev GROUP BY 1""")
def latency_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches by day and type, merged over days; percentiles within 1 % of the rank, distinct users within 5 %."""
    e = ev(spark, sf).withColumn("day", F.to_date("ts"))
    kept = written(stats.sketches(e, "amount", "stream", "day", "event_type"), "sketches")
    merged = stats.merged_sketches(kept, "event_type")
    rows = e.select("event_type", "stream", F.col("amount").cast("double").alias("x")).join(F.broadcast(merged.drop("n", "total", "longest")), "event_type")  # a row for each type
    below = lambda p: F.count_if(F.col("x") < F.col(f"p{p}")) <= (p + 1) / 100 * F.count(F.lit(1))
    up_to = lambda p: F.count_if(F.col("x") <= F.col(f"p{p}")) >= (p - 1) / 100 * F.count(F.lit(1))
    users = F.abs(F.first("distinct_keys") - F.countDistinct("stream")) <= 0.05 * F.countDistinct("stream")
    checked = rows.groupBy("event_type").agg(*[(below(p) & up_to(p)).alias(f"p{p}_within") for p in (50, 95, 99)], users.alias("users_within"))
    return checked.join(merged.select("event_type", "n", "longest"), "event_type").withColumnRenamed("event_type", "category")


@query(f"{TODO_LISTS} SELECT count(DISTINCT stream) AS streams, count(*) AS entries FROM items")
def view_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Of the to-do lists."""
    return stats.view_sizes(fold_todo(spark, sf))


@query(f"""WITH {EV} SELECT count(*) FILTER (event_type = 'view') AS favorited, count(*) FILTER (event_type = 'purchase') AS unfavorited, 2 * count(*) FILTER (event_type = 'click') AS saved, count(*) FILTER (event_type = 'error') AS removed, count(*) FILTER (event_type = 'signup') AS cleared FROM ev""")
def message_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """T10."""
    rows = ev(spark, sf).withColumn("skus", F.when(F.col("event_type") == "click", F.array(F.col("k"), F.col("k") + 1)).otherwise(F.array("k")))
    return stats.message_kinds(typed(rows, {"view": "Favorited", "purchase": "Unfavorited", "click": "Added", "error": "Removed", "signup": "Cleared"}))


@query(f"WITH {EV}, s AS (SELECT CAST(ts AS DATE) AS day, stream, count(*) AS n FROM ev GROUP BY 1, 2) SELECT day, count(*) AS spans, sum(n)::BIGINT AS events, max(n) AS largest FROM s GROUP BY 1")
def span_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Days as batches."""
    return stats.span_sizes(ev(spark, sf).withColumn("day", F.to_date("ts")), "day")


@query(f"""WITH {EV}, h AS (SELECT CAST(user_id % 8 AS VARCHAR) AS tranche, max(position) AS head, max(CASE WHEN ts < TIMESTAMP '2024-01-10' THEN position END) AS committed FROM ev GROUP BY 1)
SELECT tranche, head, committed, head - coalesce(committed, -1) AS lag FROM h""")
def feed_lag(spark: SparkSession, sf: str) -> DataFrame:
    """Eight tranches, committed up to a date."""
    e = ev(spark, sf).withColumn("tranche", (F.col("user_id") % 8).cast("string"))
    return stats.feed_lag(e, e.where("ts < timestamp '2024-01-10'").groupBy("tranche").agg(F.max("position").alias("committed")))


@query(f"WITH {EV} SELECT count(DISTINCT k) FILTER (event_type NOT IN ('click', 'view')) AS keys FROM ev")
def distinct_keys(spark: SparkSession, sf: str) -> DataFrame:
    """T13."""
    return stats.distinct_keys(ev(spark, sf), "k", F.col("event_type").isin("click", "view"))

"""Decisions, epochs, periods, processes and feeds over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import streams
from ..operators import decisions, epochs, feed, folds, periods, process, stats
from .base import EV, PLACED, ev, query, table
from .fold_queries import STAYS, TODO_LISTS, stay_rows, todo_rows

# Decisions


@query("""SELECT DISTINCT l_suppkey AS stream, l_partkey AS sku FROM lineitem WHERE l_linenumber > 3 EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_linenumber <= 3""")
def append_new(spark: SparkSession, sf: str) -> DataFrame:
    """What later lines ask for and earlier ones don't hold."""
    l = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("stream"), F.col("l_partkey").alias("sku"), "l_linenumber", "l_orderkey")  # noqa: E741
    return decisions.append_new(l.where("l_linenumber <= 3"), l.where("l_linenumber > 3"), ["stream", "sku"], ["l_orderkey", "l_linenumber"]).select("stream", "sku")


@query("""SELECT DISTINCT l_suppkey AS stream, l_partkey AS sku FROM lineitem WHERE l_linenumber > 3 INTERSECT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_linenumber <= 3""")
def remove_held(spark: SparkSession, sf: str) -> DataFrame:
    """Removals of what is held."""
    l = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("stream"), F.col("l_partkey").alias("sku"), "l_linenumber", "l_orderkey")  # noqa: E741
    return decisions.remove_held(l.where("l_linenumber <= 3"), l.where("l_linenumber > 3"), ["stream", "sku"], ["l_orderkey", "l_linenumber"]).select("stream", "sku")


ASKED = f"""{STAYS}, q AS (SELECT stream, CAST((7 * k + user_id % 5) % 900 AS VARCHAR) AS id, idx FROM ev WHERE event_type IN ('view', 'error')),
p AS (SELECT DISTINCT stream, CAST(k AS VARCHAR) AS id FROM r WHERE NOT late AND event_type IN ('purchase', 'click')), a AS (SELECT q.*, status FROM q LEFT JOIN stays USING (stream))"""


@query(f"""{ASKED} SELECT stream, id, min(idx) AS idx, 'posted' AS outcome FROM a WHERE coalesce(status, 'Active') = 'Active' AND NOT EXISTS (SELECT 1 FROM p WHERE p.stream = a.stream AND p.id = a.id) GROUP BY 1, 2
UNION ALL SELECT stream, id, idx, 'rejected' FROM a WHERE status <> 'Active'""")
def post_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Views and errors ask for postings; ids that are posted already get none, of repeated ones the first counts, closed stays reject."""
    rows = stay_rows(spark, sf)
    stays, late = folds.fold_stays(rows)
    posted = rows.join(late.select("stream", "idx"), ["stream", "idx"], "left_anti").where("event_type in ('Charged', 'Paid')").select("stream", "id").distinct()
    asked = ev(spark, sf).where("event_type in ('view', 'error')").select("stream", "idx", ((7 * F.col("k") + F.col("user_id") % 5) % 900).cast("string").alias("id"))
    fresh, rejected = decisions.post_ledger(stays.select("stream", "status"), posted, asked, ["idx"])
    return fresh.withColumn("outcome", F.lit("posted")).unionByName(rejected.withColumn("outcome", F.lit("rejected"))).select("stream", "id", "idx", "outcome")


@query(f"""{STAYS} SELECT stream, CASE WHEN status = 'Closed' THEN 'Ok' WHEN balance = 0 THEN 'Ok' ELSE 'BalanceOutstanding' END AS outcome, balance AS outstanding, status = 'Active' AND balance = 0 AS emits FROM stays""")
def check_out(spark: SparkSession, sf: str) -> DataFrame:
    """D3: everybody asks to check out."""
    stays, _ = folds.fold_stays(stay_rows(spark, sf))
    return decisions.check_out(stays, stays.select("stream"))


@query(f"""WITH {EV}, f AS (SELECT stream, arg_min(ts, idx) AS held FROM ev WHERE user_id % 3 <> 0 GROUP BY 1) SELECT e.stream, e.idx, CASE WHEN held IS NULL THEN 'CheckedIn' WHEN held = e.ts THEN 'Unchanged' ELSE 'Error' END AS outcome FROM ev e LEFT JOIN f USING (stream)""")
def check_in(spark: SparkSession, sf: str) -> DataFrame:
    """D3: two thirds of the users have checked in at their first event; every event asks to."""
    e = ev(spark, sf)
    held = e.where("user_id % 3 <> 0").groupBy("stream").agg(F.min_by("ts", "idx").alias("checked_in_at")).withColumn("status", F.lit("Active"))
    return decisions.check_in(held, e.select("stream", "idx", F.col("ts").alias("at"))).select("stream", "idx", "outcome")


@query(f"""{TODO_LISTS}, h AS (SELECT stream, id, arg_min(value, pos) AS held FROM items GROUP BY 1, 2), q AS (SELECT stream, k AS id, amount AS value, idx FROM ev WHERE event_type = 'click')
SELECT q.stream, q.id, q.value, q.idx FROM q JOIN h ON h.stream = q.stream AND h.id = q.id WHERE q.value IS DISTINCT FROM h.held""")
def todo_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks ask for updates; those of held items with another value are events."""
    items, _ = folds.fold_todo(todo_rows(spark, sf))
    asked = ev(spark, sf).where("event_type = 'click'").select("stream", F.col("k").alias("id"), F.col("amount").alias("value"), "idx")
    return decisions.todo_update(items, asked)


@query(f"""{TODO_LISTS}, q AS (SELECT DISTINCT stream, k AS id FROM ev WHERE event_type = 'click') SELECT q.* FROM q WHERE EXISTS (SELECT 1 FROM items i WHERE i.stream = q.stream AND i.id = q.id)""")
def todo_deletes(spark: SparkSession, sf: str) -> DataFrame:
    """Deletions of held items."""
    items, _ = folds.fold_todo(todo_rows(spark, sf))
    return decisions.todo_delete(items, ev(spark, sf).where("event_type = 'click'").select("stream", F.col("k").alias("id")).distinct())


@query(f"""{TODO_LISTS} SELECT e.stream, e.idx, s.next_id + row_number() OVER (PARTITION BY e.stream ORDER BY e.idx) - 1 AS id FROM ev e JOIN state s USING (stream) WHERE e.event_type = 'click'""")
def todo_adds(spark: SparkSession, sf: str) -> DataFrame:
    """A batch of additions takes ids from next_id on."""
    _, state = folds.fold_todo(todo_rows(spark, sf))
    return decisions.todo_add(state, ev(spark, sf).where("event_type = 'click'").select("stream", "idx"), ["idx"])


@query(f"""{TODO_LISTS} SELECT stream, next_id FROM state s WHERE EXISTS (SELECT 1 FROM items i WHERE i.stream = s.stream)""")
def todo_clears(spark: SparkSession, sf: str) -> DataFrame:
    """Clearings of lists that hold something."""
    _, state = folds.fold_todo(todo_rows(spark, sf))
    return decisions.todo_clear(state, state.select("stream"))


@query(f"""WITH {EV}, i AS (SELECT stream, CAST(ts AS DATE) AS day, max(idx) + 1 AS version FROM ev WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY 1, 2), h AS (SELECT stream, max(idx) + 1 AS v FROM ev WHERE ts < TIMESTAMP '2024-01-08' GROUP BY 1)
SELECT i.stream, i.version, i.version = max(i.version) OVER (PARTITION BY i.stream) AND i.version > coalesce(v, -1) AS accepted FROM i LEFT JOIN h USING (stream)""")
def version_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Daily versions against those held at a date."""
    e = ev(spark, sf)
    incoming = e.where("ts >= timestamp '2024-01-05'").groupBy("stream", F.to_date("ts").alias("day")).agg((F.max("idx") + 1).alias("version"))
    return decisions.version_gate(folds.versions(e.where("ts < timestamp '2024-01-08'")), incoming, ["stream"]).select("stream", "version", "accepted")


@query(f"WITH {EV}, h AS (SELECT stream, max(idx) + 1 AS v FROM ev WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1) SELECT stream, idx FROM ev LEFT JOIN h USING (stream) WHERE idx >= coalesce(v, 0)")
def index_gate(spark: SparkSession, sf: str) -> DataFrame:
    """D12."""
    e = ev(spark, sf)
    return decisions.index_gate(e.where("ts < timestamp '2024-01-10'"), e).select("stream", "idx")


CRAWL = "c AS (SELECT c_custkey AS id, max(o_orderdate) FILTER (o_orderstatus <> 'O') AS held_at, max(o_orderdate) AS seen_at, count(*) % 2 AS body FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)"


@query(f"WITH {CRAWL} SELECT CASE WHEN held_at IS NULL THEN 'Changed' WHEN seen_at < held_at THEN 'Stale' WHEN body = 0 THEN 'Unchanged' ELSE 'Changed' END AS outcome, count(*) AS n FROM c GROUP BY 1")
def crawl_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """A crawl of customers against an earlier one."""
    c = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_custkey").alias("id")).agg(
        F.max(F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate"))).alias("held_at"), F.max("o_orderdate").alias("seen_at"), (F.count(F.lit(1)) % 2).cast("string").alias("body"))
    held = c.where("held_at is not null").select("id", F.col("held_at").alias("lastUpdated"), F.lit("0").alias("body"))
    return stats.by_outcome(decisions.crawl_outcomes(held, c.select("id", F.col("seen_at").alias("lastUpdated"), "body")))


@query("""SELECT l_partkey AS sku, l_suppkey AS location, l_orderkey, NOT EXISTS (SELECT 1 FROM lineitem h WHERE h.l_linenumber <= 3 AND h.l_partkey = l.l_partkey AND h.l_suppkey = l.l_suppkey) AS used FROM lineitem l WHERE l_linenumber > 3""")
def sku_first_location(spark: SparkSession, sf: str) -> DataFrame:
    """A location that is held is never taken again."""
    l = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("sku"), F.col("l_suppkey").alias("location"), "l_orderkey", "l_linenumber")  # noqa: E741
    return decisions.ingest_sku(l.where("l_linenumber <= 3"), l.where("l_linenumber > 3")).select("sku", "location", "l_orderkey", "used")


@query("""WITH g AS (SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AS done, count(*) FILTER (o_orderstatus = 'P') AS pending, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'F'), 0) AS DECIMAL(18,2)) AS balance FROM orders GROUP BY 1)
SELECT o_custkey AS stream, CASE WHEN done THEN 'Ok' WHEN pending > 0 THEN 'Processing' WHEN balance = 0 THEN 'Confirmed' ELSE 'BalanceOutstanding' END AS outcome FROM g""")
def confirm_group(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as groups, urgent orders as confirmations."""
    g = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("stream")).agg(
        F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("completed"), F.collect_list(F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey"))).alias("pending"),
        F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice").cast("decimal(18,2)"))), F.lit(0)).alias("balance"))
    return decisions.confirm_group(g.withColumn("next_action", folds.next_action(F.col("completed"), F.col("pending")))).select("stream", "outcome")


@query("SELECT user_id AS series, greatest(coalesce(max(CASE WHEN event_type = 'click' THEN value END), -1), coalesce(max(CASE WHEN event_type = 'view' THEN value END), -1), 0) AS epoch FROM events GROUP BY 1")
def advance_pointer(spark: SparkSession, sf: str) -> DataFrame:
    """D10."""
    g = table(spark, sf, "events").groupBy(F.col("user_id").alias("series")).agg(*[F.coalesce(F.max(F.when(F.col("event_type") == t, F.col("value"))), F.lit(-1.0)).alias(t) for t in ("click", "view")])
    return g.select("series", decisions.advance_pointer(F.col("click"), F.col("view")).alias("epoch"))


# Epochs and feeds


def placed(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("series"), F.col("l_partkey").alias("item_id")).agg(F.min("l_shipdate").alias("first"))
    return epochs.strict_epochs(items, "series", ["first", "item_id"], 5).select("series", "item_id", "epoch", "offset")


@query(f"WITH {PLACED} SELECT * FROM placed")
def strict_epochs(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct parts of a supplier, five to an epoch."""
    return placed(spark, sf)


@query(f"WITH {PLACED} SELECT series, max(epoch) AS epoch FROM eps GROUP BY 1")
def list_tranches(spark: SparkSession, sf: str) -> DataFrame:
    """E2."""
    return feed.tranches(placed(spark, sf))


@query(f"WITH {PLACED} SELECT p.*, CAST(p.epoch AS BIGINT) * 1000000 AS position, CASE WHEN closed THEN (CAST(p.epoch AS BIGINT) + 1) * 1000000 ELSE CAST(p.epoch AS BIGINT) * 1000000 + n END AS next_checkpoint FROM placed p JOIN eps USING (series, epoch)")
def feed_page(spark: SparkSession, sf: str) -> DataFrame:
    """Each epoch as a page."""
    items = placed(spark, sf)
    return feed.page(items, epochs.epoch_summary(items, 5))


CONSUMERS = "c AS (SELECT s_suppkey AS consumer, s_suppkey AS series, (s_suppkey % 4) * 1000000 + s_suppkey % 3 AS checkpoint FROM supplier)"


@query(f"WITH {PLACED}, {CONSUMERS} SELECT consumer, p.item_id, p.\"offset\" FROM c JOIN placed p ON p.series = c.series AND p.epoch = checkpoint // 1000000 AND p.\"offset\" >= checkpoint % 1000000")
def feed_poll(spark: SparkSession, sf: str) -> DataFrame:
    """Many consumers, each from its checkpoint."""
    return feed.poll(placed(spark, sf), epochs.epoch_summary(placed(spark, sf), 5), _consumers(spark, sf))[0].select("consumer", "item_id", "offset")


@query(f"""WITH {PLACED}, {CONSUMERS} SELECT consumer, c.series, CASE WHEN coalesce(closed, false) THEN (checkpoint // 1000000 + 1) * 1000000 ELSE checkpoint // 1000000 * 1000000 + greatest(coalesce(n, 0), checkpoint % 1000000) END AS next_checkpoint,
coalesce(closed, false) AS closed, greatest(coalesce(n, 0) - checkpoint % 1000000, 0) AS n FROM c LEFT JOIN eps e ON e.series = c.series AND e.epoch = checkpoint // 1000000""")
def feed_checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    """Where each consumer goes on."""
    return feed.poll(placed(spark, sf), epochs.epoch_summary(placed(spark, sf), 5), _consumers(spark, sf))[1]


def _consumers(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(s.alias("consumer"), s.alias("series"), ((s % 4) * 1_000_000 + s % 3).alias("checkpoint"))


@query("SELECT event_id, CAST(user_id AS BIGINT) * 1000000 + event_id % 1000 AS checkpoint, CAST(user_id AS INT) AS epoch, CAST(event_id % 1000 AS INT) AS \"offset\" FROM events")
def checkpoint_codec(spark: SparkSession, sf: str) -> DataFrame:
    """Positions as one number and back."""
    rows = table(spark, sf, "events").select("event_id", streams.to_checkpoint(F.col("user_id"), F.col("event_id") % 1000).alias("checkpoint"))
    return rows.withColumn("c", streams.from_checkpoint(F.col("checkpoint"))).select("event_id", "checkpoint", "c.epoch", "c.offset")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS item_position FROM lineitem")
def item_positions(spark: SparkSession, sf: str) -> DataFrame:
    """E5."""
    l = table(spark, sf, "lineitem").withColumn("position", F.col("l_orderkey") * 100)  # noqa: E741
    return feed.number_positions(l, ["l_orderkey"], "position", ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "item_position")


@query("SELECT l_suppkey, count(DISTINCT CASE WHEN l_linestatus = 'F' THEN l_partkey END) AS added, count(*) FILTER (l_linestatus <> 'F') AS not_ready, count(*) FILTER (l_linestatus = 'F') - count(DISTINCT CASE WHEN l_linestatus = 'F' THEN l_partkey END) AS duplicates FROM lineitem GROUP BY 1")
def consumer_counts(spark: SparkSession, sf: str) -> DataFrame:
    """E6."""
    l = table(spark, sf, "lineitem").withColumn("ready", F.col("l_linestatus") == "F")  # noqa: E741
    return feed.consumer_counts(l, ["l_suppkey"], "l_partkey", "ready")


@query("""WITH RECURSIVE b AS (SELECT l_suppkey AS series, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS req_seq, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY req_seq) AS i FROM b),
s AS (SELECT series, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS req_seq, CAST(0 AS BIGINT) AS n, 0 AS epoch, CAST(0 AS BIGINT) AS fill, 0 AS next_epoch FROM r WHERE r.i = 1
UNION ALL SELECT r.series, r.i, r.req_seq, r.n, s.next_epoch, CASE WHEN s.fill + r.n >= 20 THEN 0 ELSE s.fill + r.n END, CASE WHEN s.fill + r.n >= 20 THEN s.next_epoch + 1 ELSE s.next_epoch END FROM s JOIN r ON r.series = s.series AND r.i = s.i + 1)
SELECT series, req_seq, n, epoch FROM s WHERE i > 0""")
def soft_epochs(spark: SparkSession, sf: str) -> DataFrame:
    """The shipments of a supplier's month go whole into an epoch that closes at 20."""
    b = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("series"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long").alias("req_seq")).agg(F.count(F.lit(1)).alias("n"))
    return epochs.soft_epochs(b, 20).withColumn("n", F.col("n").cast("long"))


HELD = """held AS (SELECT l_suppkey AS series, l_partkey AS item_id, CAST(l_orderkey % 8 AS INT) AS epoch FROM lineitem WHERE l_linenumber <= 3),
req AS (SELECT l_suppkey AS series, l_orderkey AS req_seq, CAST(l_orderkey % 4 AS INT) AS origin_epoch, CAST(l_linenumber AS BIGINT) AS pos, l_partkey AS item_id FROM lineitem WHERE l_linenumber > 3)"""


def _held(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    l = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("series"), F.col("l_partkey").alias("item_id"), F.col("l_orderkey").alias("req_seq"), F.col("l_linenumber").cast("long").alias("pos"))  # noqa: E741
    return l.where("pos <= 3").select("series", "item_id", (F.col("req_seq") % 8).cast("int").alias("epoch")), l.where("pos > 3").withColumn("origin_epoch", (F.col("req_seq") % 4).cast("int"))


@query(f"""WITH {HELD} SELECT series, item_id, req_seq, pos FROM (SELECT *, row_number() OVER (PARTITION BY series, item_id ORDER BY req_seq, pos) AS rn FROM req r
WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.series = r.series AND h.item_id = r.item_id AND h.epoch >= r.origin_epoch)) WHERE rn = 1""")
def exactly_once(spark: SparkSession, sf: str) -> DataFrame:
    """Items that no epoch from the request's origin on holds, each once."""
    return epochs.exactly_once(*_held(spark, sf)).select("series", "item_id", "req_seq", "pos")


@query("""WITH RECURSIVE req AS (SELECT l_suppkey AS series, l_partkey AS item_id, CAST(min(l_orderkey) AS BIGINT) AS req_seq FROM lineitem WHERE l_linenumber > 3 GROUP BY 1, 2),
held AS (SELECT DISTINCT l_suppkey AS series, l_partkey AS item_id FROM lineitem WHERE l_linenumber = 1), f AS (SELECT * FROM req WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.series = req.series AND h.item_id = req.item_id)),
b AS (SELECT series, req_seq, count(*) AS n, row_number() OVER (PARTITION BY series ORDER BY req_seq) AS i FROM f GROUP BY 1, 2),
s AS (SELECT series, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS req_seq, 0 AS epoch, CAST(0 AS BIGINT) AS fill, 1 AS next_epoch FROM b WHERE b.i = 1
UNION ALL SELECT b.series, b.i, b.req_seq, s.next_epoch, CASE WHEN s.fill + b.n >= 5 THEN 0 ELSE s.fill + b.n END, CASE WHEN s.fill + b.n >= 5 THEN s.next_epoch + 1 ELSE s.next_epoch END FROM s JOIN b ON b.series = s.series AND b.i = s.i + 1)
SELECT f.series, s.epoch, f.req_seq, f.item_id FROM f JOIN s ON s.series = f.series AND s.req_seq = f.req_seq AND s.i > 0""")
def ingest_placed(spark: SparkSession, sf: str) -> DataFrame:
    """What earlier epochs don't hold goes, once, request by request, into epochs that close at five items."""
    l = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("series"), F.col("l_partkey").alias("item_id"), F.col("l_orderkey").cast("long").alias("req_seq"), F.col("l_linenumber").cast("long").alias("pos"))  # noqa: E741
    held = l.where("pos = 1").select("series", "item_id", F.lit(0).alias("epoch"))
    asked = l.where("pos > 3").withColumn("origin_epoch", F.lit(0))
    active = l.select("series").distinct().select("series", F.lit(1).alias("epoch"), F.lit(0).alias("fill"))
    return epochs.ingest_exactly_once(held, asked, 5, active).select("series", "epoch", "req_seq", "item_id")


@query("""WITH l AS (SELECT l_suppkey AS series, l_partkey AS item_id, l_orderkey AS req_seq, l_orderkey % 3 AS origin FROM lineitem WHERE l_linenumber = 2)
SELECT series, CAST(origin AS INT) AS epoch, min(req_seq) AS req_seq, item_id FROM l GROUP BY series, item_id, origin""")
def ingest_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Requests whose origins run ahead; with room for all, each epoch takes an item once, and a later origin takes it anew."""
    l = table(spark, sf, "lineitem").where("l_linenumber = 2").select(F.col("l_suppkey").alias("series"), F.col("l_partkey").alias("item_id"), F.col("l_orderkey").cast("int").alias("req_seq"), (F.col("l_orderkey") % 3).cast("int").alias("origin_epoch"), F.lit(0).alias("pos"))
    held = l.limit(0).select("series", F.col("origin_epoch").alias("epoch"), "item_id")
    return epochs.ingest_in_order(held, l, 1_000_000).select("series", "epoch", F.col("req_seq").cast("long").alias("req_seq"), "item_id")


@query(f"""WITH {HELD}, a AS (SELECT series, max(epoch) AS a FROM held GROUP BY 1) SELECT series, item_id, min(req_seq) AS req_seq FROM req r
WHERE NOT EXISTS (SELECT 1 FROM held h JOIN a USING (series) WHERE h.series = r.series AND h.item_id = r.item_id AND h.epoch >= a - 2) GROUP BY 1, 2""")
def lookback_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Only the last two epochs and the active one are remembered."""
    held, asked = _held(spark, sf)
    return epochs.look_back(held, asked, "series", "item_id", 2, ["req_seq", "pos"]).select("series", "item_id", "req_seq")


# Periods

MONTHS = "m AS (SELECT o_custkey, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS period, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders)"


def _months(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_custkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("period"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), "o_orderkey")


@query(f"""WITH {MONTHS}, s AS (SELECT o_custkey, period, sum(amount) AS added, count(*) AS n FROM m GROUP BY 1, 2), w AS (SELECT *, sum(added) OVER (PARTITION BY o_custkey ORDER BY period) AS closing FROM s)
SELECT o_custkey, period, CAST(closing - added AS DECIMAL(28,2)) AS opening, CAST(added AS DECIMAL(28,2)) AS added, CAST(closing AS DECIMAL(28,2)) AS closing, n FROM w""")
def carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    """customers' months open with what they closed with before."""
    out = periods.carry_forward(_months(spark, sf), "o_custkey", "period", "amount")
    return out.select("o_custkey", "period", *[F.col(c).cast("decimal(28,2)").alias(c) for c in ("opening", "added", "closing")], "n")


@query(f"""WITH RECURSIVE {MONTHS}, a AS (SELECT o_custkey, period, CAST(sum(amount) AS DECIMAL(28,2)) AS added, row_number() OVER (PARTITION BY o_custkey ORDER BY period) AS i FROM m GROUP BY 1, 2),
s AS (SELECT o_custkey, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS period, CAST(0 AS DECIMAL(28,2)) AS opening, CAST(0 AS DECIMAL(28,2)) AS added, CAST(0 AS DECIMAL(28,2)) AS closing, CAST(0 AS DECIMAL(28,2)) AS carried FROM a WHERE i = 1
UNION ALL SELECT a.o_custkey, a.i, a.period, s.carried, a.added, CAST(s.carried + a.added AS DECIMAL(28,2)), CAST(least(s.carried + a.added, 250000) AS DECIMAL(28,2)) FROM s JOIN a ON a.o_custkey = s.o_custkey AND a.i = s.i + 1)
SELECT o_custkey, period, opening, added, closing, carried FROM s WHERE i > 0""")
def roll_forward(spark: SparkSession, sf: str) -> DataFrame:
    """Balances under rules of the caller's own; no month carries more than 250,000 forward."""
    return periods.roll_forward(_months(spark, sf), "o_custkey", "period", "amount", periods.Rules(carry=lambda closing: min(closing, 250_000)))


@query(f"""WITH {MONTHS.replace(" FROM orders", ", o_orderkey FROM orders")} SELECT o_custkey, period, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY period, o_orderkey) - 1 AS pos FROM m""")
def carry_items(spark: SparkSession, sf: str) -> DataFrame:
    """The orders that months carry forward, each in the month that adds it."""
    return periods.carry_items(_months(spark, sf), "o_custkey", "period", "o_orderkey", ["o_orderkey"])


@query(f"""WITH {MONTHS.replace(" FROM orders", ", o_orderkey FROM orders")}, l AS (SELECT o_custkey, max(period) AS last FROM m GROUP BY 1) SELECT o_custkey, last AS period, count(*) AS n, sum(o_orderkey)::BIGINT AS items FROM m JOIN l USING (o_custkey) GROUP BY 1, 2""")
def carried_last(spark: SparkSession, sf: str) -> DataFrame:
    """What each customer's last month carries forward."""
    months = _months(spark, sf)
    last = months.groupBy("o_custkey").agg(F.max("period").alias("period"))
    carried = periods.carried_by(periods.carry_items(months, "o_custkey", "period", "o_orderkey", ["o_orderkey"]), last, "o_custkey", "period")
    return carried.groupBy("o_custkey", "period").agg(F.count(F.lit(1)).alias("n"), F.sum("item").alias("items"))


@query(f"""WITH {MONTHS}, b AS (SELECT o_custkey, min(period) AS f, max(period) AS l FROM m GROUP BY 1), spine AS (SELECT o_custkey, l, unnest(range(f, l + 1)) AS period FROM b), s AS (SELECT o_custkey, period, sum(amount) AS added FROM m GROUP BY 1, 2)
SELECT spine.o_custkey, spine.period, CAST(coalesce(added, 0) AS DECIMAL(28,2)) AS added, CAST(sum(coalesce(added, 0)) OVER (PARTITION BY spine.o_custkey ORDER BY spine.period) AS DECIMAL(28,2)) AS closing, spine.period < l AS closed
FROM spine LEFT JOIN s ON s.o_custkey = spine.o_custkey AND s.period = spine.period""")
def close_through(spark: SparkSession, sf: str) -> DataFrame:
    """R2: months without orders close as well."""
    out = periods.close_through(_months(spark, sf), "o_custkey", "period", "amount")
    return out.select("o_custkey", "period", F.col("added").cast("decimal(28,2)").alias("added"), F.col("closing").cast("decimal(28,2)").alias("closing"), "closed")


REQUESTS = """q AS (SELECT o_custkey, o_orderkey, CAST((year(o_orderdate) - 1990) * 12 + month(o_orderdate) AS BIGINT) AS period, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, greatest(CAST(ceil(n / 2.0) AS BIGINT), 1) AS c FROM q)"""


@query(f"""WITH RECURSIVE {REQUESTS}, s AS (SELECT o_custkey, i, o_orderkey, period AS start_period, period + c - 1 AS end_period FROM r WHERE i = 1
UNION ALL SELECT r.o_custkey, r.i, r.o_orderkey, greatest(r.period, s.end_period), greatest(r.period, s.end_period) + r.c - 1 FROM s JOIN r ON r.o_custkey = s.o_custkey AND r.i = s.i + 1) SELECT o_custkey, o_orderkey, start_period, end_period FROM s""")
def spill_over(spark: SparkSession, sf: str) -> DataFrame:
    """Orders put at most two lines into a month, and go on in the next ones."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    q = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_custkey", "o_orderkey", ((F.year("o_orderdate") - 1990) * 12 + F.month("o_orderdate")).cast("long").alias("period"), F.coalesce("n", F.lit(0)).alias("n"))
    return periods.spill_over(q, "o_custkey", "o_orderkey", "period", "n", 2).select("o_custkey", "o_orderkey", "start_period", "end_period")


# Processes


@query("""WITH a AS (SELECT DISTINCT o_custkey AS group_id, l_partkey AS stay FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'),
st AS (SELECT p_partkey AS stay, CASE p_size % 5 WHEN 0 THEN 'Closed' WHEN 1 THEN 'TransferredToGroup' ELSE 'Active' END AS status, CAST(p_retailprice AS DECIMAL(18,2)) AS balance, CASE WHEN p_size % 5 = 1 THEN p_size END AS grp FROM part),
w AS (SELECT stay, min(group_id) AS f FROM a GROUP BY 1), o AS (SELECT a.group_id, a.stay, balance, status, CASE WHEN status = 'TransferredToGroup' AND grp = a.group_id THEN true WHEN coalesce(status, 'Active') = 'Active' AND f = a.group_id THEN true ELSE false END AS ok FROM a LEFT JOIN st USING (stay) JOIN w USING (stay))
SELECT group_id, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS n_failed, CAST(sum(CASE WHEN ok THEN balance END) AS DECIMAL(28,2)) AS residual FROM o GROUP BY 1""")
def group_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Customers claim the parts of their pending orders; contested ones go to the first."""
    claims = table(spark, sf, "orders").where("o_orderstatus = 'P'").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    groups = claims.groupBy(F.col("o_custkey").alias("group_id")).agg(F.collect_set("l_partkey").alias("pending")).withColumn("next_action", F.lit("MergeStays"))
    size, price = F.col("p_size") % 5, F.col("p_retailprice").cast("decimal(18,2)")
    stays = table(spark, sf, "part").select(F.col("p_partkey").alias("stay"), F.when(size == 0, "Closed").when(size == 1, "TransferredToGroup").otherwise("Active").alias("status"), price.alias("balance"), F.when(size == 1, F.col("p_size")).cast("long").alias("group_id"), F.when(size == 1, price).alias("residual"))
    merged = process.merge_events(process.merge_stays(groups, stays, ["group_id"]))
    return merged.select("group_id", "n_ok", "n_failed", F.col("residual").cast("decimal(28,2)").alias("residual"))


TX = """a AS (SELECT DISTINCT l_orderkey AS tx, l_partkey AS shipment FROM lineitem), h AS (SELECT p_partkey AS shipment, CASE WHEN p_size % 10 = 0 THEN CAST(-1 AS BIGINT) END AS reservation FROM part),
w AS (SELECT shipment, min(tx) AS f FROM a LEFT JOIN h USING (shipment) WHERE reservation IS NULL GROUP BY 1), g AS (SELECT a.tx, a.shipment, coalesce(reservation = a.tx, f = a.tx, false) AS reserved FROM a LEFT JOIN h USING (shipment) LEFT JOIN w USING (shipment)),
t AS (SELECT tx, bool_and(reserved) AS success, count(*) AS n, count(*) FILTER (NOT reserved) AS n_failed FROM g GROUP BY 1)"""


def _requests(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    requests = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("tx")).agg(F.collect_list("l_partkey").alias("shipments")).withColumn("container", F.col("tx").cast("string"))
    held = table(spark, sf, "part").select(F.col("p_partkey").alias("shipment"), F.when(F.col("p_size") % 10 == 0, F.lit(-1)).cast("long").alias("reservation"), F.lit(None).cast("string").alias("association"))
    return requests, held


@query(f"WITH {TX} SELECT * FROM t")
def finalize(spark: SparkSession, sf: str) -> DataFrame:
    """Orders want all their parts; a tenth of the parts is reserved elsewhere."""
    return process.finalize_requests(*_requests(spark, sf), ["tx"])[0]


@query(f"WITH {TX} SELECT g.tx, g.shipment, reserved, reserved AND NOT success AS revoked, reserved AND success AS assigned FROM g JOIN t USING (tx)")
def finalize_shipments(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of each shipment."""
    return process.finalize_requests(*_requests(spark, sf), ["tx"])[1]


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS tx, l_partkey AS shipment FROM lineitem), f0 AS (SELECT shipment, min(tx) AS first FROM a GROUP BY 1),
h AS (SELECT shipment, CASE p_size % 10 WHEN 0 THEN CAST(-1 AS BIGINT) WHEN 1 THEN first WHEN 2 THEN first END AS reservation, CASE p_size % 10 WHEN 1 THEN 'held' END AS association FROM f0 JOIN part ON p_partkey = shipment),
w AS (SELECT shipment, min(tx) AS f FROM a JOIN h USING (shipment) WHERE reservation IS NULL GROUP BY 1), g AS (SELECT a.tx, a.shipment, association, coalesce(reservation = a.tx, f = a.tx, false) AS reserved FROM a LEFT JOIN h USING (shipment) LEFT JOIN w USING (shipment)),
t AS (SELECT tx, bool_and(reserved) AS success FROM g GROUP BY 1) SELECT g.tx, g.shipment, reserved, reserved AND NOT success AND association IS NULL AS revoked, reserved AND success AND association IS NULL AS assigned FROM g JOIN t USING (tx)""")
def finalize_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions that go on: some shipments are reserved by them already, of which some are assigned and stay so."""
    requests, _ = _requests(spark, sf)
    first = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("shipment")).agg(F.min("l_orderkey").alias("first"))
    tenth = F.col("p_size") % 10
    held = first.join(table(spark, sf, "part"), F.col("p_partkey") == F.col("shipment")).select("shipment", F.when(tenth == 0, F.lit(-1).cast("long")).when(tenth <= 2, F.col("first")).alias("reservation"), F.when(tenth == 1, "held").alias("association"))
    return process.finalize_requests(requests, held, ["tx"])[1]


WATCHED = f"{EV}, wd AS (SELECT stream, arg_min(ts, idx) AS started, bool_or(event_type = 'purchase' AND k % 40 = 0) AS completed FROM ev GROUP BY 1), st AS (SELECT *, CASE WHEN completed THEN 'Complete' WHEN started < TIMESTAMP '2024-01-01 06:00:00' - INTERVAL 10 SECOND THEN 'Stuck' ELSE 'Active' END AS status FROM wd)"


def _watched(spark: SparkSession, sf: str) -> DataFrame:
    ends = (F.col("event_type") == "purchase") & (F.col("k") % 40 == 0)
    return folds.fold_watchdog(ev(spark, sf).withColumn("event_type", F.when(ends, "Completed").otherwise(F.col("event_type"))))


@query(f"WITH {WATCHED} SELECT stream, status FROM st")
def stuck(spark: SparkSession, sf: str) -> DataFrame:
    """Users whose purchases, all but a fortieth of which end nothing, left them open by a fixed time."""
    return process.classify_stuck(_watched(spark, sf), F.lit("2024-01-01 06:00:00").cast("timestamp")).select("stream", "status")


@query(f"WITH {WATCHED} SELECT status AS outcome, count(*) AS n FROM st GROUP BY 1")
def watchdog_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """T7."""
    return stats.by_outcome(process.classify_stuck(_watched(spark, sf), F.lit("2024-01-01 06:00:00").cast("timestamp")), "status").withColumnRenamed("status", "outcome")


@query("""WITH s AS (SELECT l_orderkey AS tx FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 HAVING min(o_orderdate) < TIMESTAMP '1998-01-01' - INTERVAL 10 SECOND AND NOT bool_or(l_linestatus = 'F')), a AS (SELECT DISTINCT l_orderkey AS tx, l_partkey AS shipment FROM lineitem WHERE l_orderkey IN (SELECT tx FROM s)),
h AS (SELECT p_partkey AS shipment, CASE WHEN p_size % 10 = 0 THEN CAST(-1 AS BIGINT) END AS reservation FROM part), w AS (SELECT shipment, min(tx) AS f FROM a LEFT JOIN h USING (shipment) WHERE reservation IS NULL GROUP BY 1)
SELECT a.tx, CASE WHEN bool_and(coalesce(reservation = a.tx, f = a.tx, false)) THEN 'succeeded' ELSE 'failed' END AS outcome FROM a LEFT JOIN h USING (shipment) LEFT JOIN w USING (shipment) GROUP BY 1""")
def pump_stuck(spark: SparkSession, sf: str) -> DataFrame:
    """Old orders without a finished line are driven to an end."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    watched = lines.groupBy(F.col("l_orderkey").alias("stream")).agg(F.min("o_orderdate").alias("started"), F.bool_or(F.col("l_linestatus") == "F").alias("completed"))
    return process.pump_stuck(watched, *_requests(spark, sf), F.lit("1998-01-01").cast("timestamp"), ["tx"]).select("tx", "outcome")

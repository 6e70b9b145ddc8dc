"""Sources, filters, sinks and log jobs over the given tables."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import streams, tables
from ..operators import filters, lifecycle
from ..sources import log, sinks
from .base import EV, ev, query, table, typed


@query("SELECT concat('Line-', l_suppkey, '_', l_returnflag) AS stream, 'Line' AS category, concat(l_suppkey, '_', l_returnflag) AS stream_id, CAST(l_suppkey AS VARCHAR) AS supplier, l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_returnflag")
def parse_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Names that are built of parts come apart again."""
    rows = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    named = rows.select(streams.build_stream("Line", F.col("l_suppkey").cast("string"), F.col("l_returnflag")).alias("stream"), "n")
    return streams.parse_stream(named).select("stream", "category", "stream_id", F.col("id_parts")[0].alias("supplier"), F.col("id_parts")[1].alias("flag"), "n")


@query(f"WITH {EV} SELECT stream, count(*) AS n FROM ev WHERE regexp_matches(stream, '^User-1') AND NOT regexp_matches(stream, '3$') GROUP BY 1")
def stream_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Streams that begin with User-1, but none that ends in 3."""
    return filters.stream_filter(ev(spark, sf), ["User"], [], ["^User-1"], ["3$"]).groupBy("stream").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type = 'click' OR (regexp_matches(event_type, '^[ev]') AND event_type <> 'view') GROUP BY 1")
def event_filter(spark: SparkSession, sf: str) -> DataFrame:
    """P4."""
    return filters.event_filter(table(spark, sf, "events"), ["click", "^[ev]"], ["view"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


NAMED = "s AS (SELECT concat(CASE l_returnflag WHEN 'A' THEN 'Inventory-' WHEN 'N' THEN 'Order-' ELSE '#serial-' END, l_suppkey, CASE WHEN l_linenumber = 7 THEN '_checkpoint' ELSE '' END) AS stream FROM lineitem)"


def _named(spark: SparkSession, sf: str) -> DataFrame:
    first = F.when(F.col("l_returnflag") == "A", "Inventory-").when(F.col("l_returnflag") == "N", "Order-").otherwise("#serial-")
    rows = table(spark, sf, "lineitem").select(F.concat(first, F.col("l_suppkey").cast("string"), F.when(F.col("l_linenumber") == 7, "_checkpoint").otherwise("")).alias("stream"))
    return rows.withColumn("category", F.substring_index("stream", "-", 1))


@query(f"WITH {NAMED} SELECT stream, count(*) AS n FROM s WHERE NOT (starts_with(stream, '#serial') OR ends_with(stream, '_checkpoint') OR starts_with(stream, 'Inventory-')) GROUP BY 1")
def sync_filter(spark: SparkSession, sf: str) -> DataFrame:
    """P5: what a sync copies when no list is given, long streams left out."""
    return filters.sync_filter(_named(spark, sf)).groupBy("stream").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {NAMED} SELECT CASE WHEN starts_with(stream, 'Inventory-') THEN 'topic' ELSE 'store' END AS target, count(*) AS n FROM s GROUP BY 1")
def split_long(spark: SparkSession, sf: str) -> DataFrame:
    """L5."""
    long, rest = lifecycle.split_long(_named(spark, sf))
    both = long.select(F.lit("topic").alias("target")).unionAll(rest.select(F.lit("store").alias("target")))
    return both.groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CASE WHEN octet_length(encode(props)) > 8 THEN '' ELSE props END AS data, octet_length(encode(props)) > 8 AS oversize FROM events")
def sync_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies of more than 8 bytes are emptied."""
    rows = table(spark, sf, "events").select("event_id", F.lit("User-1").alias("stream"), F.col("props").alias("data"))
    return filters.guard_payload(rows, 8).select("event_id", "data", "oversize")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type IN ('click', 'view')")
def decode_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Typed bodies of known types, beside the index."""
    rows = filters.decode(table(spark, sf, "events"), {"click": "k long", "view": "k long"}, "props")
    return rows.select("event_id", F.coalesce("click.k", "view.k").alias("k"))


@query("""SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN concat('event ', event_id, ' has a body that isn''t a ', event_type) ELSE concat('event ', event_id, ' has the unknown type ', event_type) END AS reason
FROM events WHERE event_type NOT IN ('click', 'view') OR event_id % 7 = 0""")
def decode_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of types that no contract knows, and of bodies that don't parse: every seventh lost its end here."""
    torn = F.when(F.col("event_id") % 7 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    rows = table(spark, sf, "events").withColumns({"idx": F.col("event_id"), "props": torn})
    return filters.decode_strict(rows, {"click": "k long", "view": "k long"}, "props")[1].select("event_id", "reason")


@query(f"WITH {EV} SELECT stream, max(idx) AS idx, arg_max(event_type, idx) AS event_type, arg_max(k, idx) AS k FROM ev WHERE event_type IN ('click', 'purchase') GROUP BY 1")
def newest_decodable(spark: SparkSession, sf: str) -> DataFrame:
    """P10."""
    return filters.decode_newest(ev(spark, sf), F.col("event_type").isin("click", "purchase")).select("stream", "idx", "event_type", "k")


@query(f"WITH {EV} SELECT stream, CAST(ts AS DATE) AS day, bool_or(event_type <> 'view') AS change, count(*) AS n FROM ev GROUP BY 1, 2")
def implied_change(spark: SparkSession, sf: str) -> DataFrame:
    """Spans are days of a user, views stand for snapshots."""
    return filters.implies_state_change(ev(spark, sf).withColumn("day", F.to_date("ts")), ["stream", "day"], snapshot="view")


@query(f"WITH {EV} SELECT stream, count(*) AS n, count(*) FILTER (FALSE) AS bodies FROM ev GROUP BY 1")
def strip_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """P11."""
    return filters.strip_bodies(ev(spark, sf)).groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.count("data").alias("bodies"))


ITEMS = "SELECT concat('Order-', l_orderkey) AS stream, l_partkey AS id, l_linenumber AS \"order\", l_returnflag AS title, l_linestatus = 'F' AS completed FROM lineitem"


def _views(spark: SparkSession, sf: str) -> DataFrame:
    item = F.struct(F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("order"), F.col("l_returnflag").alias("title"), (F.col("l_linestatus") == "F").alias("completed"), F.col("l_tax").alias("more"))
    lists = table(spark, sf, "lineitem").groupBy(F.concat(F.lit("Order-"), F.col("l_orderkey").cast("string")).alias("stream")).agg(F.collect_list(item).alias("items"))
    return filters.to_summary_items(lists).select("stream", F.struct("items").alias("value"))


@query(ITEMS)
def render_view(spark: SparkSession, sf: str) -> DataFrame:
    """Contract items of summaries, a row each."""
    return filters.render_view(_views(spark, sf))


@query(f"SELECT * FROM ({ITEMS}) WHERE id = 7")
def view_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """One item by its id."""
    return filters.render_view(_views(spark, sf), id_is=7)


@query("SELECT l_partkey AS sku, CAST(l_orderkey AS VARCHAR) AS po, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem")
def unnest_lines(spark: SparkSession, sf: str) -> DataFrame:
    """P15."""
    line = F.struct(F.col("l_orderkey").cast("string").alias("po"), F.col("l_quantity").cast("long").alias("quantity"))
    return filters.unnest_lines(table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("sku")).agg(F.collect_list(line).alias("purchaseOrderInfo")))


@query(f"WITH {NAMED} SELECT split_part(stream, '-', 1) AS category, count(*) AS n FROM s WHERE split_part(stream, '-', 1) IN ('Order', 'Inventory') GROUP BY 1")
def archivable(spark: SparkSession, sf: str) -> DataFrame:
    """P16."""
    return filters.archivable(_named(spark, sf), ["Order", "Inventory"]).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-02-09 00:00:00' - INTERVAL 30 DAY")
def prunable(spark: SparkSession, sf: str) -> DataFrame:
    """Strictly older than 30 days at a fixed time."""
    return filters.prunable(table(spark, sf, "events"), F.lit("2024-02-09").cast("timestamp")).select("event_id")


@query("SELECT event_id, event_type, '{\"key\":' || CAST(json_extract(props, '$.k') AS BIGINT) || ',\"v\":2}' AS props FROM events")
def rewrite_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies of one contract written in another, all else untouched."""
    rows = filters.rewrite_bodies(table(spark, sf, "events"), "k long", lambda b: F.struct(b["k"].alias("key"), F.lit(2).alias("v")), "props")
    return rows.select("event_id", "event_type", "props")


@query(f"WITH {EV}, t AS (SELECT stream, least(count(*), 25) AS n, min(idx) AS first FROM ev WHERE idx >= 3 GROUP BY 1) SELECT stream, n, first + n AS next_idx FROM t")
def span_chunk(spark: SparkSession, sf: str) -> DataFrame:
    """At most 25 events of a span, and the position after them."""
    taken, after = filters.span_chunk(ev(spark, sf).where("idx >= 3"), 25)
    return taken.groupBy("stream").agg(F.count(F.lit(1)).alias("n")).join(after, "stream")


@query(f"""WITH {EV}, d AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'dump' ELSE 'change feed' END AS form, position % 7 = 0 AS torn FROM ev)
SELECT form, CASE WHEN NOT torn THEN stream END AS stream, count(*) FILTER (NOT torn) AS n, sum(idx) FILTER (NOT torn)::BIGINT AS sum_idx, count(*) FILTER (torn) AS rejects FROM d GROUP BY ALL""")
def feed_function(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of two forms through one table function in SQL; every seventh has lost its end and is a reject."""
    e = ev(spark, sf)
    whole = F.when(F.col("user_id") % 2 == 0, F.to_json(F.struct("stream", "idx", "event_type", "data"))).otherwise(F.to_json(F.struct(F.col("stream").alias("s"), F.col("idx").alias("i"), F.col("event_type").alias("t"), F.col("data").alias("d"))))
    docs = e.select("user_id", F.when(F.col("position") % 7 == 0, F.left(whole, F.length(whole) - 1)).otherwise(whole).alias("value"))
    tables.register_parser(spark)
    parsed = spark.sql(
        "SELECT 'dump' AS form, * FROM parse_feed(TABLE({dump}), 'dump') UNION ALL SELECT 'change feed', * FROM parse_feed(TABLE({feed}), 'change feed')",
        dump=docs.where("user_id % 2 = 0").select("value"), feed=docs.where("user_id % 2 = 1").select("value"),
    )
    return parsed.groupBy("form", "stream").agg(F.count("idx").alias("n"), F.sum("idx").alias("sum_idx"), F.count("reason").alias("rejects"))


# Sources and sinks


@query("SELECT count(*) AS n, min(event_id) AS first FROM events WHERE event_id >= 0.25 * (SELECT max(event_id) FROM events)")
def start_position(spark: SparkSession, sf: str) -> DataFrame:
    """From a quarter of the head's position on."""
    rows = log.from_position(table(spark, sf, "events"), 0.25, "event_id")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


@query("SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-10') AS from_time, count(*) FILTER (ts >= TIMESTAMP '2024-01-20' - INTERVAL 36 HOUR) AS from_interval FROM events")
def start_time(spark: SparkSession, sf: str) -> DataFrame:
    """From a time on, and from an interval before another on."""
    e, count = table(spark, sf, "events"), F.count(F.lit(1))
    at = log.from_position(e, datetime(2024, 1, 10, tzinfo=timezone.utc)).agg(count.alias("from_time"))
    back = log.from_position(e, timedelta(hours=36), as_of=datetime(2024, 1, 20, tzinfo=timezone.utc)).agg(count.alias("from_interval"))
    return at.join(back, F.lit(True))  # a row each


@query("SELECT concat('User-', user_id) AS stream, 'User' AS category, CAST(user_id AS VARCHAR) AS stream_id, event_id AS idx, event_type, props AS data, ts FROM events")
def legacy_documents(spark: SparkSession, sf: str) -> DataFrame:
    """S6."""
    docs = table(spark, sf, "events").select(F.concat(F.lit("User-"), F.col("user_id").cast("string")).alias("s"), F.col("ts").alias("c"), F.col("event_type").alias("t"), F.col("event_id").alias("i"), F.col("props").alias("d"))
    return log.read_legacy(docs).select("stream", "category", "stream_id", "idx", "event_type", "data", "ts")


@query(f"WITH {EV} SELECT stream, count(*) AS n, sum(idx)::BIGINT AS sum_idx, max(idx) AS last_idx, arg_max(event_type, idx) AS last_type, arg_max(data, idx) AS last_data FROM ev GROUP BY 1")
def envelope_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Span messages taken apart again are the events."""
    sent = sinks.to_span_envelopes(ev(spark, sf).withColumn("meta", F.lit(None).cast("string")))
    return log.explode_envelope(sent).groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.sum("idx").alias("sum_idx"), F.max("idx").alias("last_idx"), F.max_by("event_type", "idx").alias("last_type"), F.max_by("data", "idx").alias("last_data"))


@query("SELECT user_id AS key, event_id AS \"offset\", row_number() OVER (PARTITION BY user_id ORDER BY event_id % 4, event_id) - 1 AS idx FROM events")
def sequence_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Four partitions of messages."""
    rows = table(spark, sf, "events").select(F.col("user_id").alias("key"), (F.col("event_id") % 4).alias("partition"), F.col("event_id").alias("offset"))
    return log.sequence_messages(rows).select("key", "offset", "idx")


@query("SELECT concat('Ticket-', page_id) AS stream, 'Ticket' AS category, length(url) AS n FROM pages")
def crawl_events(spark: SparkSession, sf: str) -> DataFrame:
    """S9."""
    pages = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("id"), F.lit("2024-01-01").cast("timestamp").alias("lastUpdated"), F.col("url").alias("body"))
    return log.crawl_to_events(pages).select("stream", "category", F.length("data").cast("long").alias("n"))


@query("SELECT CAST(user_id % 8 AS VARCHAR) AS key, '{\"id\":' || event_id || '}' AS value FROM events")
def raw_passthrough(spark: SparkSession, sf: str) -> DataFrame:
    """S10."""
    return log.raw_passthrough(table(spark, sf, "events").select((F.col("user_id") % 8).alias("p"), F.col("event_id").alias("id")))


@query(f"WITH {EV} SELECT stream AS key, '{{\"event_type\":\"Count1\",\"version\":' || (max(idx) + 1) || ',\"value\":{{\"n\":' || count(*) || '}}}}' AS value FROM ev GROUP BY stream")
def summary_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """K4."""
    view = ev(spark, sf).groupBy("stream").agg((F.max("idx") + 1).alias("version"), F.count(F.lit(1)).alias("n"))
    return sinks.to_summary_envelopes(view, "Count1")


@query(f"WITH {EV} SELECT stream AS key, CASE event_type WHEN 'click' THEN 'Clicked' ELSE 'Viewed' END AS event_type, idx AS index FROM ev WHERE event_type IN ('click', 'view')")
def publish_each(spark: SparkSession, sf: str) -> DataFrame:
    """K5: one message for each event, carrying its index."""
    sent = sinks.publish_each(ev(spark, sf), {"click": "Clicked", "view": "Viewed"}).withColumn("v", F.from_json("value", "event_type string, index long"))
    return sent.select("key", "v.event_type", "v.index")


@query(f"WITH {EV} SELECT stream, idx FROM ev WHERE NOT (event_type = 'error' AND idx < 10)")
def delete_events(spark: SparkSession, sf: str) -> DataFrame:
    """K6."""
    e = ev(spark, sf)
    return sinks.delete_events(e.where("event_type = 'error' and idx < 10"), e).select("stream", "idx")


@query(f"WITH {EV}, c AS (SELECT stream, idx, row_number() OVER w AS n, sum(octet_length(encode(data))) OVER w AS b FROM ev WINDOW w AS (PARTITION BY stream ORDER BY idx)) SELECT stream, idx FROM c WHERE n = 1 OR (n <= 20 AND b <= 100)")
def bounded_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """K7: at most 20 events and 100 bytes of each stream."""
    return sinks.bounded_prefix(ev(spark, sf).withColumn("size", F.octet_length("data")), 20, 100).select("stream", "idx")


@query(f"""WITH RECURSIVE {EV}, e AS (SELECT stream, idx, octet_length(encode(data)) AS s FROM ev), p AS (SELECT stream, idx, s AS bytes, 1 AS n, 0 AS page FROM e WHERE idx = 0
UNION ALL SELECT e.stream, e.idx, CASE WHEN n < 8 AND bytes + s <= 60 THEN bytes + s ELSE s END, CASE WHEN n < 8 AND bytes + s <= 60 THEN n + 1 ELSE 1 END, CASE WHEN n < 8 AND bytes + s <= 60 THEN page ELSE page + 1 END FROM p JOIN e ON e.stream = p.stream AND e.idx = p.idx + 1)
SELECT stream, idx, page FROM p""")
def write_pages(spark: SparkSession, sf: str) -> DataFrame:
    """All writes of a stream under the same bounds."""
    return sinks.pages(ev(spark, sf).withColumn("size", F.octet_length("data")), 8, 60).select("stream", "idx", "page")


# Log jobs


@query(f"WITH {EV} SELECT stream, idx FROM ev WHERE user_id % 2 = 0 AND position >= (SELECT max(position) / 2 FROM ev)")
def archive(spark: SparkSession, sf: str) -> DataFrame:
    """L1: even users are copied; the first half of the log is in the archive already."""
    e = ev(spark, sf).withColumn("category", F.when(F.col("user_id") % 2 == 0, "Even").otherwise("Odd"))
    half = e.agg((F.max("position") / 2).alias("h"))
    return lifecycle.archive(e, e.join(F.broadcast(half), F.col("position") < F.col("h"), "left_semi"), ["Even"]).select("stream", "idx")


@query(f"""WITH {EV}, g AS (SELECT stream, idx, coalesce(user_id % 2 = 0 AND ts < TIMESTAMP '2024-02-09' - INTERVAL 30 DAY, false) AS gone FROM ev), k AS (SELECT stream, min(idx) AS first FROM g WHERE NOT gone GROUP BY 1)
SELECT g.stream, g.idx FROM g JOIN k ON g.stream = k.stream AND g.idx >= k.first""")
def archive_prune(spark: SparkSession, sf: str) -> DataFrame:
    """Archived events of even users that are over 30 days old leave the hot log."""
    e = ev(spark, sf)
    return lifecycle.prune(e, e.where("user_id % 2 = 0"), F.lit("2024-02-09").cast("timestamp")).select("stream", "idx")


@query(f"WITH {EV}, h AS (SELECT stream, max(idx) + 1 AS v FROM ev WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1) SELECT stream, idx FROM ev LEFT JOIN h USING (stream) WHERE idx >= coalesce(v, 0)")
def sync_log(spark: SparkSession, sf: str) -> DataFrame:
    """L3: what a copy of the log up to a date lacks."""
    e = ev(spark, sf)
    return lifecycle.sync(e, e.where("ts < timestamp '2024-01-10'")).select("stream", "idx")


@query(f"WITH {EV}, h AS (SELECT stream, max(idx) + 1 AS v FROM ev WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1) SELECT stream, idx, '{{\"key\":' || k || '}}' AS data FROM ev LEFT JOIN h USING (stream) WHERE idx >= coalesce(v, 0)")
def export_log(spark: SparkSession, sf: str) -> DataFrame:
    """L4: the same with each body encoded anew."""
    e = ev(spark, sf)
    return lifecycle.export(e, e.where("ts < timestamp '2024-01-10'"), ["User"], "k long", lambda b: F.struct(b["k"].alias("key"))).select("stream", "idx", "data")


@query(f"""WITH {EV}, t AS (SELECT DISTINCT stream FROM ev WHERE ts >= TIMESTAMP '2024-01-10' AND event_type <> 'view'), h AS (SELECT stream, max(idx) + 1 AS v FROM ev WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1)
SELECT stream, max(idx) + 1 AS version, count(*) AS n, max(idx) + 1 > coalesce(any_value(v), -1) AS accepted FROM ev JOIN t USING (stream) LEFT JOIN h USING (stream) GROUP BY stream""")
def index_views(spark: SparkSession, sf: str) -> DataFrame:
    """Streams that a batch changes are folded and gated by version."""
    e = ev(spark, sf)
    fold = lambda df: df.groupBy("stream").agg((F.max("idx") + 1).alias("version"), F.count(F.lit(1)).alias("n"))
    renamed = typed(e.where("ts >= timestamp '2024-01-10'"), {"view": "Snapshotted", "click": "Clicked", "purchase": "Bought", "error": "Failed", "signup": "Joined"})
    return lifecycle.index(renamed, e, fold, fold(e.where("ts < timestamp '2024-01-10'"))).select("stream", "version", "n", "accepted")

"""Registration of queries with their DuckDB twins, and the given tables as event rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: The events table as a log with a stream for each user.
EV = """ev AS (SELECT concat('User-', user_id) AS stream, 'User' AS category, user_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, event_id AS position, event_type, ts,
  CAST(value AS DECIMAL(18,2)) AS amount, CAST(json_extract(props, '$.k') AS INT) AS k, props AS data FROM events)"""


def ev(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("stream", F.concat(F.lit("User-"), F.col("user_id").cast("string")))
    return e.select(
        "stream", F.lit("User").alias("category"), "user_id", (F.row_number().over(Window.partitionBy("stream").orderBy("ts", "event_id")) - 1).cast("long").alias("idx"),
        F.col("event_id").alias("position"), "event_type", "ts", F.col("value").cast("decimal(18,2)").alias("amount"), F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("props").alias("data"),
    )


def typed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rows whose event types ``names`` maps to those of a fold; others are left out."""
    name = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("event_type")]
    return df.where(F.col("event_type").isin(*names)).withColumn("event_type", name)


#: Distinct parts of each supplier by first ship date, placed five to an epoch.
PLACED = """items AS (SELECT l_suppkey AS series, l_partkey AS item_id, min(l_shipdate) AS first FROM lineitem GROUP BY 1, 2),
placed AS (SELECT series, item_id, CAST((rn - 1) // 5 AS INT) AS epoch, CAST((rn - 1) % 5 AS INT) AS "offset"
  FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY first, item_id) AS rn FROM items)),
eps AS (SELECT series, epoch, count(*) AS n, count(*) >= 5 AS closed FROM placed GROUP BY 1, 2)"""

"""Counts by category, event type and outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import ordinals


def event_counts(df: DataFrame, handled: Column) -> DataFrame:
    """(category, event_type, handled, n) with subtotals (T1, T2); null keys stand for all."""
    return df.withColumn("handled", handled).rollup("handled", "category", "event_type").agg(F.count(F.lit(1)).alias("n"))


def categories_seen(df: DataFrame) -> DataFrame:
    """Distinct categories in order."""
    return df.select("category").distinct().orderBy("category")


def top(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The n commonest values, ties by name (T4)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), key).limit(n)


def outcome_counts(spans: DataFrame, accepted: str = "accepted") -> DataFrame:
    """(outcome, spans, used, unused) of handled spans (T5): an accepted one uses one event and n - 1 are unused."""
    outcome = F.when(F.col("change").isNull(), "NotApplicable").when(~F.col("change"), "Skipped").when(F.col(accepted), "Ok").otherwise("Stale")
    ok = outcome == "Ok"
    return spans.withColumn("outcome", outcome).groupBy("outcome").agg(F.count(F.lit(1)).alias("spans"), F.sum(F.when(ok, 1).otherwise(0)).alias("used"), F.sum(F.when(ok, F.col("n") - 1).otherwise(F.col("n"))).alias("unused"))


def by_outcome(df: DataFrame, outcome: str = "outcome") -> DataFrame:
    """(outcome, n): crawl outcomes (T6), watchdog outcomes."""
    return df.groupBy(outcome).agg(F.count(F.lit(1)).alias("n"))


def latency(df: DataFrame, duration: str, category: str = "category", percentiles: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """(category, n, total, longest, mean, p50, p95, p99) with a row for all, whose category is null.

    Percentiles are exact: values are numbered in order within their category and among all (``ordinals``), each over
    many tasks, and those at the wanted ranks are taken. Where a rank error of a part of a percent will do, merge
    ``sketches`` instead.
    """
    ways = F.array(F.struct(F.col(category).alias("_c"), F.lit(False).alias("_all")), F.struct(F.lit(None).cast(df.schema[category].dataType).alias("_c"), F.lit(True).alias("_all")))
    rows = df.select(F.explode(ways).alias("_w"), F.col(duration).alias("_d")).select("_w.*", "_d")
    keys = ["_c", "_all"]
    totals = rows.groupBy(*keys).agg(F.count("_d").alias("n"), F.sum("_d").alias("total"), F.max("_d").alias("longest"), F.avg("_d").alias("mean"))
    placed = ordinals(rows.where("_d is not null"), keys, ["_d"], "_at")
    sizes = totals.select(F.col("_c").alias("_c2"), F.col("_all").alias("_all2"), "n")
    placed = placed.join(sizes, F.col("_c").eqNullSafe(F.col("_c2")) & (F.col("_all") == F.col("_all2")))
    rank = lambda p: F.greatest(F.floor((F.col("n") * p + 99) / 100) - 1, F.lit(0))
    values = placed.groupBy("_c2", "_all2").agg(*[F.max(F.when(F.col("_at") == rank(p), F.col("_d"))).alias(f"p{p}") for p in percentiles])
    joined = totals.join(values, F.col("_c").eqNullSafe(F.col("_c2")) & (F.col("_all") == F.col("_all2")), "left")
    return joined.select(F.col("_c").alias(category), "n", "total", "longest", "mean", *[f"p{p}" for p in percentiles])


def sketches(df: DataFrame, duration: str, key: str, *by: str, k: int = 1000) -> DataFrame:
    """(by, n, total, longest, durations, keys): counts and mergeable sketches of durations (KLL) and keys (HLL).

    The two sketches take some 30 kilobytes at most, whatever they have seen. Keep them by day and category, and merge what is asked for.
    """
    d = F.col(duration)
    return df.groupBy(*by).agg(F.count(d).alias("n"), F.sum(d).alias("total"), F.max(d).alias("longest"), F.kll_sketch_agg_double(d.cast("double"), k).alias("durations"), F.hll_sketch_agg(F.col(key), 14).alias("keys"))


def merged_sketches(parts: DataFrame, *by: str, percentiles: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """(by, n, total, longest, p50, p95, p99, distinct_keys) of sketches put together; without ``by``, of all."""
    whole = parts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("longest").alias("longest"), F.kll_merge_agg_double("durations").alias("_d"), F.hll_union_agg("keys").alias("_k"))
    ranks = [F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("_d", F.lit(p / 100))).alias(f"p{p}") for p in percentiles]
    return whole.select(*by, "n", "total", "longest", *ranks, F.hll_sketch_estimate("_k").alias("distinct_keys"))


def view_sizes(entries: DataFrame) -> DataFrame:
    """(streams, entries) of a view's rows."""
    return entries.agg(F.countDistinct("stream").alias("streams"), F.count(F.lit(1)).alias("entries"))


def message_kinds(df: DataFrame, skus: str = "skus") -> DataFrame:
    """Totals of message kinds (T10), each under its own name."""
    n = lambda kind, value: F.coalesce(F.sum(F.when(F.col("event_type") == kind, value)), F.lit(0))
    return df.agg(n("Favorited", F.lit(1)).alias("favorited"), n("Unfavorited", F.lit(1)).alias("unfavorited"), n("Added", F.size(skus)).alias("saved"), n("Removed", F.size(skus)).alias("removed"), n("Cleared", F.lit(1)).alias("cleared"))


def span_sizes(df: DataFrame, *batch: str) -> DataFrame:
    """(batch, spans, events, largest): events of a stream that come together."""
    per = df.groupBy(*batch, "stream").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*batch).agg(F.count(F.lit(1)).alias("spans"), F.sum("n").alias("events"), F.max("n").alias("largest"))


def feed_lag(log: DataFrame, committed: DataFrame, tranche: str = "tranche") -> DataFrame:
    """(tranche, head, committed, lag)."""
    heads = log.groupBy(tranche).agg(F.max("position").alias("head"))
    return heads.join(committed.select(tranche, "committed"), tranche, "left").withColumn("lag", F.col("head") - F.coalesce("committed", F.lit(-1)))


def distinct_keys(df: DataFrame, key: str, known: Column, approximate: bool = False) -> DataFrame:
    """Number of distinct keys of rows that nothing classifies."""
    other = F.when(~known, F.col(key))
    return df.agg((F.approx_count_distinct(other) if approximate else F.countDistinct(other)).alias("keys"))

"""Plans that read and parse once; percentiles, sketches, bodies, snapshots and starts against plain versions."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidefold.operators import filters, folds, snapshots, stats
from tidefold.sources import log

from .conftest import rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bodies_are_parsed_once(spark):
    bodies = ['{"id": 1, "tags": ["a"], "more": {"x": 2.5}}', '{"id": "no", "odd\'name": 3}', "no json", None, "[1]", '{"id": 7}']
    df = spark.createDataFrame([("s", n, t, b) for n, (t, b) in enumerate(zip("ABABAC", bodies, strict=True))], "stream string, idx long, event_type string, data string")
    contracts = {"A": "id int, tags array<string>, more struct<x: double>", "B": "id int, `odd'name` long"}
    got = filters.decode(df, contracts)
    assert plan(got).count("parse_json") + plan(got).count("parseJson") == 1
    found = {r.idx: (r.A and (r.A.id, r.A.tags, r.A.more and r.A.more.x), r.B and tuple(r.B)) for r in got.collect()}
    assert found == {0: ((1, ["a"], 2.5), None), 1: (None, (None, 3)), 2: ((None, None, None), None), 3: (None, None), 4: ((None, None, None), None)}
    fine, rejects = filters.decode_strict(df, contracts)
    assert sorted(r.idx for r in fine.collect()) == [0, 1, 4]
    assert {r.idx: r.reason for r in rejects.collect()} == {2: "event 2 has a body that isn't a A", 3: "event 3 has a body that isn't a B", 5: "event 5 has the unknown type C"}
    assert filters.decode_newest(df.where("idx < 4"), contracts).select("idx", "B").first() == (1, (None, 3))
    renamed = filters.rewrite_bodies(df, "id int", lambda b: F.struct(b["id"].alias("key")))
    assert [r.data for r in renamed.orderBy("idx").collect()] == ['{"key":1}', "{}", "{}", None, "{}", '{"key":7}']


def test_categories_in_one_pass(spark, tmp_path):
    path = str(tmp_path / "log")
    e = [("F", "F-1", 0, "add", "x"), ("F", "F-1", 1, "add", "y"), ("F", "F-1", 2, "drop", "x"), ("F", "F-2", 0, "add", "x"), ("F", "F-2", 1, "drop", "x"), ("V", "V-1", 0, "add", None), ("V", "V-1", 1, "add", None), ("other", "o-1", 0, "add", "q"), ("other", "o-1", 1, "add", "q"), (None, "n-1", 0, "add", "q")]
    spark.createDataFrame(e, "category string, stream string, idx long, event_type string, sku string").write.parquet(path)
    kind = F.col("event_type")
    got = folds.fold_by_category(spark.read.parquet(path), {"F": folds.Entries(F.col("sku"), kind == "add", kind.isin("add", "drop")), "V": folds.Entries(F.lit("v"), F.lit(True), F.lit(True))})
    assert rows(got, "category", "streams", "entries") == [("F", 1, 1), ("V", 1, 1), ("other", 1, 2), (None, 1, 1)] or rows(got, "category", "streams", "entries") == sorted([("F", 1, 1), ("V", 1, 1), ("other", 1, 2), (None, 1, 1)], key=str)
    assert plan(got).count("FileScan") == 1


def test_percentiles_with_ties(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), rng.randrange(20)) for _ in range(700)] + [("one", 5), ("none", None)]
    want = []
    for c in ({c for c, _ in data}) | {"*"}:
        v = sorted(d for k, d in data if (k == c or c == "*") and d is not None)
        want.append((None if c == "*" else c, len(v), sum(v) if v else None, *[v[max(-(-len(v) * p // 100) - 1, 0)] if v else None for p in (50, 95, 99)]))
    got = stats.latency(spark.createDataFrame(data, "category string, d long").repartition(3), "d")
    assert rows(got, "category", "n", "total", "p50", "p95", "p99") == sorted(want, key=str)


def test_sketches_merge(spark):
    """Sketches of forty days, merged, are within 1 % of the rank and 3 % of the number of keys; half of them have no rows."""
    df = spark.range(200_000).select((F.col("id") % 40).alias("day"), (F.col("id") % 3).alias("c"), F.pow(F.rand(5), 3).alias("x"), (F.xxhash64("id") % 15_000).alias("key"))
    parts = stats.sketches(df, "x", "key", "day", "c")
    for by in ((), ("c",)):
        merged = stats.merged_sketches(parts, *by).collect()
        for r in merged:
            own = df.where(F.col("c") == r["c"]) if by else df
            exact = own.agg(F.count(F.lit(1)), F.countDistinct("key"), *[F.count_if(F.col("x") <= r[f"p{p}"]) for p in (50, 95, 99)]).first()
            assert r.n == exact[0] and abs(r.distinct_keys - exact[1]) <= 0.03 * exact[1]
            assert all(abs(at / exact[0] - p / 100) <= 0.01 for p, at in zip((50, 95, 99), exact[2:], strict=True))
    assert stats.merged_sketches(stats.sketches(df.limit(0), "x", "key", "day"), "day").count() == 0


def test_one_snapshot_for_a_stream(spark):
    log_rows = spark.createDataFrame([("s", n) for n in range(6)] + [("t", 0)], "stream string, idx long")
    held = spark.createDataFrame([("s", "A", 4, "old"), ("s", "B", 5, "new"), ("s", "A2", 5, "tied"), ("u", "A", 3, "alone")], "stream string, snapshot_type string, version long, state string")
    assert rows(snapshots.since_snapshot(log_rows, held), "stream", "idx", "seed") == sorted([("s", 5, "new"), ("t", 0, None), ("u", None, "alone")], key=str)
    assert rows(snapshots.since_snapshot(log_rows, held, "A").where("stream = 's'"), "stream", "idx", "seed") == [("s", 4, "old"), ("s", 5, "old")]


def test_start_by_time(spark, tmp_path):
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    spark.createDataFrame([(n, at + timedelta(seconds=n)) for n in range(5)] + [(9, None)], "position long, ts timestamp").write.parquet(str(tmp_path / "log"))
    df = spark.read.parquet(str(tmp_path / "log"))
    got = log.from_position(df, at + timedelta(seconds=3))
    assert rows(got, "position") == [(3,), (4,)] and "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan(got)
    assert rows(log.from_position(df, timedelta(seconds=1), as_of=at + timedelta(seconds=4)), "position") == [(3,), (4,)]
    assert log.from_position(df, timedelta(seconds=1)).count() == 0


@pytest.mark.parametrize("n", [0, 1])
def test_empty_tables(spark, n):
    df = spark.createDataFrame([("s", 0, "A", None)] * n, "stream string, idx long, event_type string, data string")
    assert filters.decode(df, {"A": "id int"}).count() == n
    assert stats.latency(df.withColumn("category", F.lit("c")).withColumn("d", F.lit(None).cast("long")), "d").count() == 2 * n

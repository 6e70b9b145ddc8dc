"""Set-based operators against plain one-at-a-time models."""

import random
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidefold.operators import decisions, epochs, folds, periods, process, running, snapshots
from tidefold.sources import sinks

from .conftest import rows


def test_periods_golden(spark):
    """Two items to a period: overflow closes periods, a skipped one is closed too."""
    asked = [(0, 0, ["a", "b"]), (1, 1, ["c", "d"]), (2, 1, ["e", "f", "g"]), (3, 3, ["h"])]
    requests = spark.createDataFrame([("s", q, p, len(i)) for q, p, i in asked], "series string, req_seq int, period int, n int")
    items = spark.createDataFrame([("s", q, n, x) for q, _, i in asked for n, x in enumerate(i)], "series string, req_seq int, pos int, item string")
    spilt = periods.spill_over(requests, "series", "req_seq", "period", "n", 2)
    placed = periods.place_items(spilt, items, "series", "req_seq", 2)
    by_period = {}
    for r in placed.orderBy("req_seq", "pos").collect():
        by_period.setdefault(r.period, []).append(r.item)
    assert by_period == {0: ["a", "b"], 1: ["c", "d", "e", "f"], 2: ["g"], 3: ["h"]}
    closed = periods.close_through(placed.withColumn("one", F.lit(1)), "series", "period", "one")
    assert rows(closed, "period", "closing", "closed") == [(0, 2, True), (1, 6, True), (2, 7, True), (3, 8, False)]
    items = periods.carry_items(placed, "series", "period", "item", ["req_seq", "pos"])
    asked = spark.createDataFrame([("s", 1), ("s", 3)], "series string, period int")
    carried = periods.carried_by(items, asked, "series", "period").orderBy("period", "pos").collect()
    assert {p: [r.item for r in carried if r.period == p] for p in (1, 3)} == {1: list("abcdef"), 3: list("abcdefgh")}


def test_ordinals(spark):
    """A key with most of the rows, a null key and single rows are numbered in order."""
    rng = random.Random(7)
    data = [("hot", n, n % 3) for n in range(3000)] + [(None, n, 0) for n in range(40)] + [(f"k{n}", n, 1) for n in range(60)]
    rng.shuffle(data)
    want, seen = [], {}
    for k, n, x in sorted(data, key=lambda r: (str(r[0]), r[2], r[1])):
        want.append((k, n, x, seen.setdefault(k, 0)))
        seen[k] += 1
    got = running.ordinals(spark.createDataFrame(data, "k string, n int, x int").repartition(5), ["k"], ["x", "n"], "at")
    assert rows(got, "k", "n", "x", "at") == sorted(want, key=str)


def placed_one_by_one(sizes, state, most, closes):
    """(key, n, page): a state (page, rows, sum) for each key, and ``closes`` says whether the next row begins a page."""
    want = []
    for k, n, size in sizes:
        page, count, held = state.get(k, (0, 0, 0))
        page, count, held = (page + 1, 0, 0) if closes(count, held, size) else (page, count, held)
        want.append((k, n, page))
        state[k] = (page, count + 1, held + size)
    return sorted(want, key=str)


@pytest.mark.parametrize("block", [16, 1 << 16])
def test_placed_in_order(spark, monkeypatch, block):
    """One long list and many short ones, each row placed by what came before it of its key alone; in one block and in many."""
    monkeypatch.setattr(running, "BLOCK", block)
    rng = random.Random(5)
    sizes = [("hot", n, rng.randrange(0, 9)) for n in range(1500)] + [(f"k{n % 50}", n, rng.randrange(0, 9)) for n in range(500)] + [(None, n, 2) for n in range(90)]
    want, state = [], {"k7": (3, 4)}
    for k, n, size in sizes:
        epoch, fill = state.get(k, (0, 0))
        want.append((k, n, epoch))
        state[k] = (epoch + 1, 0) if size and fill + size >= 5 else (epoch, fill + size)
    batches = spark.createDataFrame(sizes, "series string, req_seq int, n int").repartition(7)
    active = spark.createDataFrame([("k7", 3, 4), ("none", 1, 1)], "series string, epoch int, fill int")
    assert rows(epochs.soft_epochs(batches, 5, active), "series", "req_seq", "epoch") == sorted(want, key=str)
    events = batches.select(F.col("series").alias("stream"), F.col("req_seq").cast("long").alias("idx"), F.col("n").cast("long").alias("size"))
    want = placed_one_by_one(sizes, {}, 3, lambda count, held, size: count and (count >= 3 or held + size > 12))
    assert rows(sinks.pages(events, 3, 12), "stream", "idx", "page") == want
    assert epochs.soft_epochs(batches.limit(0), 5).count() == sinks.pages(events.limit(0), 3, 12).count() == 0


def test_null_and_large_keys_stay_apart(spark):
    keys = (None, 2**53, 2**53 + 1)
    df = spark.createDataFrame([(k, n, 1) for k in keys for n in range(4)], "series long, req_seq int, n int")
    want = sorted(((k, n, n // 2) for k in keys for n in range(4)), key=str)
    assert rows(epochs.soft_epochs(df, 2), "series", "req_seq", "epoch") == want
    events = df.select(F.col("series").alias("stream"), F.col("req_seq").cast("long").alias("idx"), F.lit(5).alias("size"))
    assert rows(sinks.pages(events, 2, 100), "stream", "idx", "page") == want
    money = df.select(F.col("series").alias("k"), F.col("req_seq").alias("p"), F.lit(Decimal("1.00")).alias("amount"))
    got = periods.roll_forward(money, "k", "p", "amount", periods.Rules())
    assert rows(got, "k", "p", "opening", "closing") == sorted(((k, n, Decimal(n), Decimal(n + 1)) for k in keys for n in range(4)), key=lambda r: str((r[0], r[1], Decimal(r[2]).quantize(Decimal("0.01")), r[3])))


def test_spill_over_model(spark):
    rng = random.Random(1)
    asked = [(s, q, rng.randrange(12), rng.randrange(9)) for s in range(30) for q in range(rng.randrange(1, 12))]
    want = []
    for s in range(30):
        active = 0
        for _, q, p, n in [r for r in asked if r[0] == s]:
            start = max(p, active)
            active = start + max(-(-n // 3), 1) - 1
            want.append((s, q, start, active))
    df = spark.createDataFrame(asked, "s int, q int, p int, n int")
    assert rows(periods.spill_over(df, "s", "q", "p", "n", 3), "s", "q", "start_period", "end_period") == sorted(want, key=str)


def one_at_a_time(held, requests, cap):
    out, content = [], {}
    for e, i in held:
        content.setdefault(e, set()).add(i)
    for seq, origin, items in requests:
        at, left = origin, list(dict.fromkeys(items))
        while left:
            have = content.setdefault(at, set())
            left = [i for i in left if i not in have]
            if len(have) < cap:
                have.update(left)
                out += [(at, seq, i) for i in left]
                break
            at += 1
    return sorted(out, key=str)


def test_exactly_once_model(spark):
    """Origins anywhere: the ordered form equals the model; from origin 0 the set-based form does as well."""
    rng = random.Random(2)
    for ahead in (0, 3):
        requests = [(q, rng.randrange(ahead + 1), [f"i{rng.randrange(40)}" for _ in range(rng.randrange(1, 5))]) for q in range(25)]
        df = spark.createDataFrame([("s", q, o, n, i) for q, o, x in requests for n, i in enumerate(x)], "series string, req_seq int, origin_epoch int, pos int, item_id string")
        none = spark.createDataFrame([], "series string, epoch int, item_id string")
        want = one_at_a_time([], requests, 5)
        assert rows(epochs.ingest_in_order(none, df, 5), "epoch", "req_seq", "item_id") == want
        if not ahead:
            assert rows(epochs.ingest_exactly_once(none, df, 5), "epoch", "req_seq", "item_id") == want


def test_exactly_once_of_many_series(spark):
    """Held items, origins anywhere, repeats within and between requests; one series has most requests, one is null."""
    rng = random.Random(12)
    series = {"hot": 150, None: 20, **{f"s{n}": rng.randrange(1, 12) for n in range(6)}}
    held, asked, want = [], [], []
    for s, n in series.items():
        have = [(e, f"i{i}") for e in range(3) for i in rng.sample(range(60), rng.choice([0, 2, 5]))]
        requests = [(q, rng.randrange(4), [f"i{rng.randrange(400 if s == 'hot' else 60)}" for _ in range(rng.randrange(1, 6))]) for q in range(n)]
        held += [(s, e, i) for e, i in have]
        asked += [(s, q, o, k, i) for q, o, x in requests for k, i in enumerate(x)]
        want += [(s, *r) for r in one_at_a_time(have, requests, 5)]
    held_df = spark.createDataFrame(held, "series string, epoch int, item_id string")
    df = spark.createDataFrame(rng.sample(asked, len(asked)), "series string, req_seq int, origin_epoch int, pos int, item_id string").repartition(3)
    assert rows(epochs.ingest_in_order(held_df, df, 5), "series", "epoch", "req_seq", "item_id") == sorted(want, key=str)
    assert epochs.ingest_in_order(held_df, df.limit(0), 5).count() == 0


def test_retry_inserts_nothing(spark):
    df = spark.createDataFrame([("s", 0, 0, n, f"i{n}") for n in range(12)], "series string, req_seq int, origin_epoch int, pos int, item_id string")
    none = spark.createDataFrame([], "series string, epoch int, item_id string")
    first = epochs.ingest_exactly_once(none, df, 5)
    assert first.count() == 12
    assert epochs.exactly_once(first, df).count() == 0


def test_look_back(spark):
    """After (look-back + 1) * cap + 1 items a fresh run takes exactly the first five again; other keys are apart."""
    items = spark.createDataFrame([("f", n, f"t{n}") for n in range(16)], "fc string, n int, id string")
    held = epochs.strict_epochs(items, "fc", ["n"], 5)
    again = epochs.look_back(held, items, "fc", "id", 2, ["n"])
    assert [r.id for r in again.orderBy("n").collect()] == [f"t{n}" for n in range(5)]
    other = items.withColumn("fc", F.lit("g"))
    assert epochs.look_back(held, other, "fc", "id", 2, ["n"]).count() == 16
    twice = items.where("n = 0").union(items.where("n = 0"))
    assert epochs.look_back(held, twice, "fc", "id", 2, ["n"], dedup_within_batch=False).count() == 2


def test_strict_epochs_go_on(spark):
    active = spark.createDataFrame([("f", 3, 4)], "fc string, epoch int, fill int")
    items = spark.createDataFrame([("f", n) for n in range(7)], "fc string, n int")
    assert rows(epochs.strict_epochs(items, "fc", ["n"], 5, active), "n", "epoch", "offset") == [(0, 3, 4), (1, 4, 0), (2, 4, 1), (3, 4, 2), (4, 4, 3), (5, 4, 4), (6, 5, 0)]


def test_soft_epochs_edges(spark):
    df = spark.createDataFrame([("s", q, n) for q, n in enumerate([2, 2, 2, 1, 9, 1])], "series string, req_seq int, n int")
    assert [r.epoch for r in epochs.soft_epochs(df, 5).orderBy("req_seq").collect()] == [0, 0, 0, 1, 1, 2]


def test_transactions(spark):
    """The first takes its shipments; the second, which overlaps, is reverted."""
    asked = spark.createDataFrame([("tx1", "c1", ["s1", "s2"]), ("tx2", "c2", ["s2", "s3"]), ("tx3", "c3", [])], "tx string, container string, shipments array<string>")
    done, shipments, rejects = process.finalize_requests(asked, None, ["tx"])
    assert rows(done, "tx", "success") == [("tx1", True), ("tx2", False)]
    assert rows(shipments, "tx", "shipment", "reserved", "revoked", "assigned") == [("tx1", "s1", True, False, True), ("tx1", "s2", True, False, True), ("tx2", "s2", False, False, False), ("tx2", "s3", True, True, False)]
    assert [r.tx for r in rejects.collect()] == ["tx3"]
    events = {r.tx: r.e for r in done.select("tx", process.transaction_events(F.col("success")).alias("e")).collect()}
    assert events["tx2"] == ["FinalizationRequested", "RevertCommenced", "Completed"]
    held = spark.createDataFrame([("s1", "tx1", None), ("s2", "tx1", None)], "shipment string, reservation string, association string")
    assert rows(process.advance_transactions(asked.where("tx = 'tx1'"), held, ["tx"])[0], "success") == [(True,)]


def test_group_checkout_flow(spark):
    stays = spark.createDataFrame([("a", "Active", Decimal("5.00"), None, None), ("b", "Closed", Decimal("0"), None, None), ("c", "TransferredToGroup", Decimal("0"), "g1", Decimal("7.50"))], "stay string, status string, balance decimal(18,2), group_id string, residual decimal(18,2)")
    groups = spark.createDataFrame([("g1", ["a", "b", "c", "d"], "MergeStays"), ("g2", ["a"], "MergeStays"), ("g3", ["a"], "Ready")], "group_id string, pending array<string>, next_action string")
    got = rows(process.merge_stays(groups, stays, ["group_id"]), "group_id", "stay", "outcome", "residual")
    assert got == [("g1", "a", "ok", Decimal("5.00")), ("g1", "b", "failed", None), ("g1", "c", "ok", Decimal("7.50")), ("g1", "d", "ok", Decimal("0.00")), ("g2", "a", "failed", None)]


def test_watchdog_edge(spark):
    df = spark.createDataFrame([("t", "2024-01-01 00:00:00", False), ("u", "2023-12-31 23:59:59", False), ("v", "2020-01-01 00:00:00", True)], "stream string, started string, completed boolean").withColumn("started", F.to_timestamp("started"))
    got = process.classify_stuck(df, F.to_timestamp(F.lit("2024-01-01 00:00:10")))
    assert rows(got, "stream", "status") == [("t", "Active"), ("u", "Stuck"), ("v", "Complete")]


def test_todo_with_snapshots(spark):
    e = [("s", 0, "Added", 0, 1, None, None), ("s", 1, "Snapshotted", None, None, 5, [(3, 30), (4, 40)]), ("s", 2, "Added", 3, 31, None, None), ("s", 3, "Updated", 3, 99, None, None), ("s", 4, "Deleted", 4, None, None, None), ("s", 5, "Added", 4, 41, None, None)]
    df = spark.createDataFrame(e, "stream string, idx long, event_type string, id int, value int, next_id int, items array<struct<id:int,value:int>>")
    items, state = folds.fold_todo(df)
    assert [(r.id, r.value) for r in items.orderBy("pos").collect()] == [(4, 41), (3, 99), (3, 99)]
    assert rows(state, "version", "next_id", "n") == [(6, 7, 3)]
    updates = spark.createDataFrame([("s", 3, 99), ("s", 4, 7), ("s", 8, 1)], "stream string, id int, value int")
    assert rows(decisions.todo_update(items, updates), "id") == [(4,)]
    assert rows(decisions.todo_update(items, updates, when_absent=True), "id") == [(4,), (8,)]


def test_pandas_fold_equals_columns(spark):
    df = spark.range(200).select(F.concat(F.lit("s"), F.col("id") % 7).alias("stream"), F.floor(F.col("id") / 7).alias("idx"), F.lit("Added").alias("event_type"), (F.col("id") % 5).alias("x"))
    by_columns = folds.fold_streams(df, F.lit(0).cast("long"), lambda s, e: s * 2 + e["x"], "x").select("stream", "state")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        s = 0
        for x in pdf.x:
            s = s * 2 + x
        return pd.DataFrame({"stream": [pdf.stream.iloc[0]], "state": [s]})

    assert rows(by_columns) == rows(folds.fold_streams_pandas(df, fold, "stream string, state long"))


def test_snapshot_without_later_events(spark):
    log = spark.createDataFrame([("s", "S", 0, "A")], "stream string, category string, idx long, event_type string")
    held = spark.createDataFrame([("s", "S", "T1", 1, "x"), ("s", "S", "T0", 0, "old")], "stream string, category string, snapshot_type string, version long, state string")
    assert rows(snapshots.since_snapshot(log, held, "T1"), "stream", "idx", "seed") == [("s", None, "x")]


def test_newest_location_wins(spark):
    held = spark.createDataFrame([(1, 1, 5)], "sku int, location int, message_index int")
    batch = spark.createDataFrame([(1, 1, 6), (1, 1, 7), (2, 1, 1), (2, 1, 1)], "sku int, location int, message_index int")
    assert rows(decisions.ingest_sku(held, batch), "sku", "used") == [(1, False), (1, False), (2, True), (2, True)]
    assert rows(decisions.ingest_sku(held, batch, "newest"), "sku", "message_index", "used") == [(1, 6, False), (1, 7, True), (2, 1, True), (2, 1, True)]


def test_transactions_by_composed_functions(spark):
    """Events of random streams, put together in blocks of three, against one at a time; one stream has a third of all rows."""
    rng = random.Random(8)
    kinds = ["FinalizationRequested", "ReservationCompleted", "RevertCommenced", "AssignmentCompleted", "Completed", "Snapshotted"]
    lengths = {"hot": 400, **{f"t{n}": rng.randrange(1, 14) for n in range(100)}}
    events, want = [], []
    for stream, length in lengths.items():
        state = ("Initial", None, None, None)
        for idx in range(length):
            kind, container, shipments = rng.choices(kinds, [2, 4, 1, 4, 3, 1])[0], f"c{idx}", [f"s{idx}"]
            snapshot = rng.choice([("Assigning", "kept", ["k"], None), ("Reverting", None, ["k"], None), ("Completed", None, None, True), ("Completed", None, None, False)]) if kind == "Snapshotted" else None
            events.append((stream, idx, kind, container if kind == "FinalizationRequested" else None, shipments if kind in ("FinalizationRequested", "RevertCommenced") else None, snapshot))
            status, c, s, _ = state
            if kind == "FinalizationRequested":
                state = ("Reserving", container, shipments, None)
            elif kind == "RevertCommenced":
                state = ("Reverting", None, shipments, None)
            elif kind == "Snapshotted":
                state = snapshot
            elif (kind, status) == ("ReservationCompleted", "Reserving"):
                state = ("Assigning", c, s, None)
            elif (kind, status) == ("AssignmentCompleted", "Assigning"):
                state = ("Assigned", c, s, None)
            elif kind == "Completed" and status in ("Reverting", "Assigned"):
                state = ("Completed", None, None, status == "Assigned")
        want.append((stream, length, state))
    df = spark.createDataFrame(events, "stream string, idx long, event_type string, container string, shipments array<string>, state struct<status:string,container:string,shipments:array<string>,success:boolean>").repartition(4)
    for block in (3, 1024):
        got = folds.fold_transactions(df, block).select("stream", "version", "state").collect()
        assert sorted((r.stream, r.version, tuple(r.state)) for r in got) == sorted(want, key=lambda r: r[0])


def test_combined_fold_keeps_the_order(spark):
    df = spark.range(3000).select(F.concat(F.lit("s"), F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 40)).alias("stream"), F.when(F.col("id") < 1000, F.col("id")).otherwise(2000 + F.floor(F.col("id") / 40)).alias("idx"))
    got = folds.fold_combined(df, F.array(F.col("idx")), lambda a, b: F.concat(a, b), block=7).collect()
    want = {}
    for r in df.orderBy("idx").collect():
        want.setdefault(r.stream, []).append(r.idx)
    assert {r.stream: (r.version, r.state) for r in got} == {k: (v[-1] + 1, v) for k, v in want.items()}


def test_tasks_share_of_rows(spark, monkeypatch):
    """Tasks become more with the rows, not larger; a key that spans slices and empty batches are placed as ever."""
    monkeypatch.setattr(running, "TASK_ROWS", 100)
    batches = [("a" if n % 4 else "b", n, n % 3 + 1) for n in range(1000)]
    df = spark.createDataFrame(batches, "series string, req_seq long, n long")
    got = epochs.soft_epochs(df, 5)
    assert got.rdd.getNumPartitions() == 10
    for more in ([], [("a", 5000, 0), ("b", -1, 0)]):
        want = []
        for series in "ab":
            epoch = fill = 0
            for s, seq, n in sorted(batches + more):
                if s == series:
                    want.append((s, seq, epoch))
                    fill += n
                    if fill >= 5:
                        epoch, fill = epoch + 1, 0
        rows = spark.createDataFrame(batches + more, "series string, req_seq long, n long")
        assert sorted(tuple(r) for r in epochs.soft_epochs(rows, 5).select("series", "req_seq", "epoch").collect()) == sorted(want)

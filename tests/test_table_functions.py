"""Table functions: parsers with rejects, and folds that Spark feeds in order."""

import json
import random

import pytest

from tidefold.functions import tables

from .conftest import rows


def test_parser_of_two_forms(spark):
    tables.register_parser(spark, "parse_test")
    dump = [json.dumps({"stream": "A-1", "idx": 3, "event_type": "X", "data": "{}"}), '{"stream": "A-1"}', "torn {", None, "[1]", '{"stream": "A-2", "idx": "no", "event_type": "X"}']
    feed = [json.dumps({"s": "B-1", "i": 5, "e": [{"c": "P", "d": {"x": 1}}, {"c": "Q"}]}), json.dumps({"s": "B-2", "i": 0, "t": "R", "d": "text"}), json.dumps({"s": "B-3", "i": 0, "e": [{"c": "ok"}, {}]})]
    spark.createDataFrame([(d, 1) for d in dump], "value string, other int").createOrReplaceTempView("dump_docs")
    spark.createDataFrame([(d,) for d in feed], "value string").createOrReplaceTempView("feed_docs")
    got = spark.sql("SELECT * FROM parse_test(TABLE(dump_docs), 'dump') UNION ALL SELECT * FROM parse_test(TABLE(feed_docs), 'change feed')")
    assert rows(got.where("reason is null"), "stream", "idx", "event_type", "data") == sorted([("A-1", 3, "X", "{}"), ("B-1", 5, "P", '{"x":1}'), ("B-1", 6, "Q", None), ("B-2", 0, "R", "text")], key=str)
    rejects = {r.document: r.reason for r in got.where("reason is not null").collect()}
    assert set(rejects) == {dump[1], dump[2], dump[4], dump[5], feed[2]} and rejects[dump[1]] == "KeyError: 'idx'"
    with pytest.raises(Exception, match="no form 'other'"):
        spark.sql("SELECT * FROM parse_test(TABLE(dump_docs), 'other')").collect()
    with pytest.raises(Exception, match="a column value"):
        spark.sql("SELECT * FROM parse_test(TABLE(SELECT 1 AS x), 'dump')").collect()


def test_parser_of_the_callers_own(spark):
    tables.register_parser(spark, "parse_lines", {"lines": lambda d: [(d["name"], n, "Line", x, None) for n, x in enumerate(d["lines"])]}, value="doc")
    spark.createDataFrame([('{"name": "L-1", "lines": ["a", "b"]}',)], "doc string").createOrReplaceTempView("line_docs")
    assert rows(spark.sql("SELECT stream, idx, data FROM parse_lines(TABLE(line_docs), 'lines')")) == [("L-1", 0, "a"), ("L-1", 1, "b")]


def test_fold_in_order(spark):
    rng = random.Random(2)
    events = [(s, n, rng.randrange(9)) for s, length in (("hot", 2000), ("a", 3), (None, 4), ("b", 1)) for n in range(length)]
    want = {}
    for s, n, x in events:
        want[s] = (n + 1, [*want.get(s, (0, []))[1], x][-5:])
    shuffled = rng.sample(events, len(events))
    spark.createDataFrame(shuffled, "stream string, idx long, x int").repartition(5).createOrReplaceTempView("fold_events")
    tables.register_fold(spark, "last_five", [], lambda s, e: [*s, e.x][-5:], "array<int>")
    assert {r.stream: (r.version, r.state) for r in spark.sql("SELECT * FROM last_five(TABLE(fold_events))").collect()} == want
    assert spark.sql("SELECT * FROM last_five(TABLE(SELECT * FROM fold_events WHERE idx < 0))").count() == 0

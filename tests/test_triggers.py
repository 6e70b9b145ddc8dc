"""What a backlog costs: triggers and files don't follow the number of files of a log."""

from glob import glob

import pytest

from tidefold.plans import registry
from tidefold.sources import log

SF = "/root/testdata/sf0.001"


@pytest.fixture
def many_files(spark):
    """A session in which each write makes twelve files; gives the paths in its work folder that fit a pattern."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    yield lambda pattern: set(glob(f"{spark.conf.get('spark.checkpoint.dir')}/{pattern}"))
    for k, v in held.items():
        spark.conf.set(k, v)


def triggers(spark, name, many_files):
    before = many_files("*-state-*/commits/[0-9]*")
    registry.QUERIES[name](spark, SF).count()
    return len(many_files("*-state-*/commits/[0-9]*") - before)


def test_files_each(spark, tmp_path):
    spark.range(70).selectExpr("cast(id as string) as stream").repartition(7).write.parquet(str(tmp_path / "log"))
    assert [log.files_each(spark, str(tmp_path / "log"), n) for n in (1, 2, 3, 7, 100)] == [7, 4, 3, 1, 1]


def test_stream_sequence_triggers(spark, many_files):
    assert 2 <= triggers(spark, "stream_sequence", many_files) <= 4


def test_stream_in_sequence_triggers(spark, many_files):
    assert 2 <= triggers(spark, "stream_in_sequence", many_files) <= 4


def test_stream_append_triggers(spark, many_files):
    assert 2 <= triggers(spark, "stream_seeded_index", many_files) <= 5
    assert 2 <= triggers(spark, "stream_ingest", many_files) <= 4
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    assert 2 <= triggers(spark, "stream_append", many_files) <= 6


def test_stream_lag_files(spark, many_files):
    """Each part of the log is written and read by several tasks, and still a batch of its own."""
    before = many_files("log-*/part-*")
    got = registry.QUERIES["stream_lag"](spark, SF)
    assert sorted({r.batch for r in got.collect()}) == [0, 1, 2]
    assert len(many_files("log-*/part-*") - before) > 6

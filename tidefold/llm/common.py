"""Helpers that the corpus operators share: shared storage, words, bucketed comparison, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER_TO_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in a local session that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        folder = tempfile.mkdtemp(prefix="tidefold-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by way of a Parquet table in the shared folder: for wide rows, smaller than a checkpoint."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text in UTF-8, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(UPPER_TO_LOWER).split() if text else []


def root(parent: dict[int, int], x: int) -> int:
    """The root of x in a union-find forest; x joins it if it's new."""
    if parent.setdefault(x, x) == x:
        return x
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def block_groups(batches: Iterator[pa.RecordBatch], payload: str, convert: Callable[[pa.Array], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, ids, left, payload) of each (bucket, bi, bj) of sorted batches in which a left row can meet another id.

    Groups without such a row are skipped by whole batches, without a Python step for each.
    """
    rest: pa.Table | None = None

    def groups(table: pa.Table, n: int, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        bucket, ids, left = (table.column(c).to_numpy()[:n] for c in ("bucket", "id", "left"))
        if not n:
            return
        sizes = np.diff(np.append(starts, n))
        wanted = np.flatnonzero((sizes > 2) & (np.add.reduceat(left.astype(np.int64), starts) > 0))
        if not len(wanted):
            return
        values = convert(table.column(payload).combine_chunks())
        for a, size in zip(starts[wanted].tolist(), sizes[wanted].tolist(), strict=True):
            yield int(bucket[a]), ids[a : a + size], left[a : a + size], values[a : a + size]

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        change = np.zeros(table.num_rows - 1, bool)
        for k in ("bucket", "bi", "bj"):
            v = table.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        starts = np.concatenate(([0], np.flatnonzero(change) + 1))
        yield from groups(table, int(starts[-1]), starts[:-1])
        rest = table.slice(int(starts[-1]))
    if rest is not None:
        yield from groups(rest, rest.num_rows, np.array([0]))


def in_blocks(rows: DataFrame, block: int, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Bring rows of equal ``bucket`` together and hand them to ``work``, sorted by (bucket, bi, bj).

    ``home`` tells rows that are compared with all rows of the bucket. A bucket of over ``block``
    rows is cut into blocks by id: home rows of block bi meet all rows of block bj in one task, so
    that no task holds more than about two blocks, however large a bucket is. Every pair (home,
    other) of a bucket meets once.
    """
    spark = rows.sparkSession
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("home"), 1)).alias("n_home"))
    large = checkpointed(sizes.where((F.col("n") > block) & (F.col("n_home") > 0)).select("bucket", F.ceil(F.col("n_home") / block).cast("int").alias("hi"), F.ceil(F.col("n") / block).cast("int").alias("hj")))
    n_large = large.count()
    if n_large:
        rows = rows.join(F.broadcast(large) if n_large <= 100_000 else large, "bucket", "left")
        hi, hj = F.coalesce("hi", F.lit(1)), F.coalesce("hj", F.lit(1))
        salt = F.xxhash64("id", F.lit(7))
        as_home = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), hj - 1), lambda j: F.struct(F.lit(True).alias("left"), F.pmod(salt, hi).cast("int").alias("bi"), j.alias("bj"))))
        as_other = F.transform(F.sequence(F.lit(0), hi - 1), lambda i: F.struct(F.lit(False).alias("left"), i.alias("bi"), F.pmod(salt, hj).cast("int").alias("bj")))
        kept = [c for c in rows.columns if c not in ("hi", "hj")]
        rows = rows.select(*kept, F.explode(F.concat(F.coalesce(as_home, F.array().cast("array<struct<left:boolean,bi:int,bj:int>>")), as_other)).alias("_p")).select(*kept, "_p.left", "_p.bi", "_p.bj")
    else:
        sides = F.when(F.col("home"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
        rows = rows.select("*", F.explode(sides).alias("left"), F.lit(0).alias("bi"), F.lit(0).alias("bj"))
    parts = max(shuffle_parts(spark), spark.sparkContext.defaultParallelism)
    return rows.repartition(parts, "bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj").mapInArrow(work, schema)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable over ``edges`` (a, b); ids without an edge are left out.

    Alternating large-star and small-star rounds, each one aggregation and one join on the node; the
    edge table is checkpointed after every round, and rounds go on until it stays as it is.
    """
    e = checkpointed(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if seen == tuple(state) or not state[0]:
            return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
        seen = tuple(state)
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(e.groupBy("a").agg(F.min("b").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        e = checkpointed(small.where("a != b").distinct())
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")

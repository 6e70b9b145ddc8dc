"""Places of rows within their key, also of keys that hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.work import work_path

#: Rows of a block of a key, at least.
BLOCK = 1 << 16
#: Rows that a task sorts, about.
TASK_ROWS = 1 << 18


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared work folder."""
    path = work_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def same(keys: list[str], other: Callable[[str], Column]) -> Column:
    """Whether all keys are those of another row; null keys are equal."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(other(k)) for k in keys])


def task_parts(spark: SparkSession, rows: int) -> int:
    """Into how many partitions so many rows are dealt that a task's share stays as it is however many there are; Spark merges none of a given number."""
    return max(min(spark.sparkContext.defaultParallelism, (rows >> 12) + 1), -(-rows // TASK_ROWS))


def ordinals(rows: DataFrame, keys: list[str], order: list[str], out: str, sums: Mapping[str, Column] | None = None) -> DataFrame:
    """The rows with ``out``, their number within their key from 0 on, without bringing a key to one task.

    Rows are dealt by ranges of key and order, and written with the number of their slice, so that it is the
    same wherever it is read. They are numbered within key and slice, and what a key has in earlier slices, a
    number for each, is added: of the keys of a slice only the first can have any, so these are few. ``sums`` names further columns, the sums of what it gives over all rows before. A
    null key is a key.
    """
    sums = dict(sums or {})
    sliced = written(rows.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id()), "slices")
    ahead = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = {f"_own{n}": F.coalesce(F.sum(x).over(ahead), F.lit(0)) for n, x in enumerate(sums.values())}
    own["_own"] = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order)) - 1
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("__c"), *[F.sum(x).alias(f"__c{n}") for n, x in enumerate(sums.values())])
    names = ["", *map(str, range(len(sums)))]
    counts = counts.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy("_slice")))
    before = counts.select("__nth", *[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.col("_slice").alias("_of"), *[F.coalesce(F.sum(f"__c{n}").over(earlier), F.lit(0)).alias(f"_before{n}") for n in names])
    place = {k: n for n, k in enumerate(keys)}
    dealt = sliced.repartition(task_parts(rows.sparkSession, sliced.count()), *keys, "_slice")
    numbered = dealt.withColumns(own).join(F.broadcast(before.where("__nth > 1")), same(keys, lambda k: F.col(f"_k{place[k]}")) & (F.col("_slice") == F.col("_of")), "left")
    each = [(F.col(f"_own{n}") + F.coalesce(f"_before{n}", F.lit(0))).cast("long").alias(c) for n, c in zip(names, [out, *sums], strict=True)]
    return numbered.select(*rows.columns, *each)


def _changes(table: pa.Table, names: list[str]) -> np.ndarray:
    """Where a row differs from the one before it in any of the columns; nulls are equal."""
    out = np.zeros(table.num_rows, bool)
    for name in names:
        column = table.column(name).combine_chunks()
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        out[1:] |= pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return out


def _by_group(batches: Iterator[pa.RecordBatch], names: list[str], work: Callable[[pa.Table], pa.Table]) -> Iterator[pa.RecordBatch]:
    """``work`` on each group of sorted rows that agree in the columns; a task holds one group and a batch."""
    held: pa.Table | None = None

    def finished(table: pa.Table, starts: list[int]) -> Iterator[pa.RecordBatch]:
        for a, b in zip(starts, starts[1:], strict=False):
            out = work(table.slice(a, b - a))
            if out.num_rows:
                yield from out.combine_chunks().to_batches()

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        starts = [0, *np.flatnonzero(_changes(table, names)).tolist()] if table.num_rows else [0]
        yield from finished(table, starts)
        held = table.slice(starts[-1])
    if held is not None and held.num_rows:
        yield from finished(held, [0, held.num_rows])


def in_pages(rows: DataFrame, keys: list[str], n: str, before: str, size: str, most: int, jump: Callable[[np.ndarray, np.ndarray], np.ndarray], extra: str | None = None) -> DataFrame:
    """The rows with ``page``, the number of their page within their key, and ``closes``, whether the next page begins behind them.

    A page begins where the one before it ends. ``jump`` takes running sums of sizes, one more than rows, and what
    pages that begin at the rows hold already (``extra``), and gives for each row where a page that begins there
    ends: an index, of at most ``most`` rows more, beyond all if it stays open. ``n`` and ``before`` number the
    rows of a key and sum up their sizes (``ordinals``).

    A key's rows are cut into blocks, each with the first rows of the next one, as far as a page can reach. For
    each row at which a page may enter a block, it says where the page leaves it that begins the next
    block. Following these from a key's first row takes rounds of joins, twice as many blocks in each; then each
    block knows where its first page begins, and pages are numbered block by block.
    """
    block = max(8 * most, BLOCK)
    own = F.struct(F.floor(F.col(n) / block).alias("_block"), F.lit(True).alias("_own"))
    ahead = F.struct((own["_block"] - 1).alias("_block"), F.lit(False).alias("_own"))
    copies = F.when((F.col(n) >= block) & (F.col(n) % block < most), F.array(own, ahead)).otherwise(F.array(own))
    dealt = rows.withColumn("__c", F.explode(copies)).select(*rows.columns, "__c.*")
    in_order = [*keys, "_block"]
    last, total = rows.agg(F.coalesce(F.max(n), F.lit(0)), F.count(F.lit(1))).first()
    parts = task_parts(rows.sparkSession, total)
    deal = lambda df: df.repartition(parts, *in_order).sortWithinPartitions(*in_order, n)

    def ends(table: pa.Table) -> tuple[np.ndarray, int, int]:
        """Where a page that begins at each row ends, within the table; its own rows; and the number of its first."""
        sums, sizes = table.column(before).to_numpy(), table.column(size).to_numpy()
        held = table.column(extra).to_numpy() if extra else np.zeros(len(sums), np.int64)
        to = jump(np.append(sums, sums[-1] + sizes[-1]), held)
        mine = int(np.count_nonzero(table.column("_own").to_numpy(zero_copy_only=False)))
        return np.minimum(to, len(sums) + 1), mine, int(table.column(n)[0].as_py())

    if last < block:
        dealt = dealt.withColumn("_entry", F.lit(0).cast("long"))
    else:

        def exits(table: pa.Table) -> pa.Table:
            to, mine, first = ends(table)
            stay = to < mine
            while stay.any():
                to[stay] = to[to[stay]]
                stay = to < mine
            enters = np.flatnonzero((table.column(n).to_numpy()[:mine] % block < most) & (to[:mine] < len(to)))
            out = table.select(keys).take(pa.array(enters))
            return out.append_column("_at", pa.array(first + enters)).append_column("_to", pa.array(first + to[enters]))

        kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
        step = written(deal(dealt.select(*keys, n, before, size, *([extra] if extra else []), "_block", "_own")).mapInArrow(lambda bs: _by_group(bs, in_order, exits), f"{kinds}, _at long, _to long"), "page-exits")
        known = rows.where(F.col(n) == 0).select(*keys, F.col(n).alias("_at"))
        for _ in range(int(np.ceil(np.log2(last // block + 1)))):
            far = step.select(*[F.col(k).alias(f"_far_{k}") for k in keys], F.col("_at").alias("_far"), F.col("_to").alias("_far_to"))
            joined = lambda df, at, far=far: df.join(far, same(keys, lambda k: F.col(f"_far_{k}")) & (F.col(at) == F.col("_far")))
            known = written(known.union(joined(known, "_at").select(*keys, "_far_to")), "page-entries")
            step = written(joined(step, "_to").select(*keys, "_at", F.col("_far_to").alias("_to")), "page-exits")
        entries = known.select(*[F.col(k).alias(f"_e_{k}") for k in keys], F.floor(F.col("_at") / block).alias("_e_block"), F.col("_at").alias("_entry"))
        dealt = dealt.join(entries, same(keys, lambda k: F.col(f"_e_{k}")) & (F.col("_block") == F.col("_e_block")), "left").drop("_e_block", *[f"_e_{k}" for k in keys])

    def numbered(table: pa.Table) -> pa.Table:
        to, mine, first = ends(table)
        begins, entry = np.zeros(len(to) + 2, bool), table.column("_entry")[0].as_py()
        if entry is not None:
            begins[entry - first] = True
            hop, marked = np.append(to, [len(to) + 1] * 2), 0
            while (count := int(np.count_nonzero(begins))) > marked:
                begins[hop[np.flatnonzero(begins)]] = True
                hop, marked = hop[hop], count
            begins[-1] = False
        out = table.slice(0, mine).drop_columns(["_own", "_entry"])
        return out.append_column("_page", pa.array(np.cumsum(begins[:mine]))).append_column("closes", pa.array(begins[1 : mine + 1]))

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
    placed = deal(dealt).mapInArrow(lambda bs: _by_group(bs, in_order, numbered), ", ".join([*columns, "_block long", "_page long", "closes boolean"]))
    if last < block:
        return placed.select(*rows.columns, (F.col("_page") - 1).alias("page"), "closes")
    placed = written(placed, "pages")
    counts = placed.groupBy(*in_order).agg(F.max("_page").alias("_count"))
    earlier = F.sum("_count").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col("_block").alias("_o_block"), F.coalesce(earlier, F.lit(0)).alias("_offset"))
    placed = placed.join(offsets, same(keys, lambda k: F.col(f"_o_{k}")) & (F.col("_block") == F.col("_o_block")))
    return placed.select(*rows.columns, (F.col("_offset") + F.col("_page") - 1).alias("page"), "closes")

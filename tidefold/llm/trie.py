"""Prefix tries of conversations by ROLLUP.

A turn's id is a 128-bit hash of its place, role and text. A conversation's ids stand in blocks of COLUMNS
positional columns, and ``GROUP BY block, key, ROLLUP (t1, .., tk)`` aggregates all prefixes of a block
together; grouping_id tells how many turns a row stands for. A longer conversation goes on in further
blocks, whose key is the node that the block before ends in. A node is named by the exclusive-or of the
ids on its path, which needs no order, so that keys come from running sums over blocks and no step walks a trie
level by level.

Sums over subtrees are rollups too. Of each set of equal conversations one is rolled up, with their number.
It owns the nodes of which it is the smallest member: from a first depth on all of its path. So what the
distinct nodes below a node hold is the sum over its members of what they own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_parts, written

#: Turns of a block, and blocks whose running sums one task takes.
COLUMNS, SECTION = 6, 512
#: Children of a node from which its row is copied for the look-up of parents, and hot nodes that are broadcast.
HOT, MOST_HOT = 100_000, 100_000
WORDS = r"[^\x20\x09-\x0D]+"
NOTHING = hashlib.sha256().hexdigest()


def numbered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, d1, d2, words, n): each turn's place in its conversation, digest, words and its conversation's turns.

    Turns are ordered by number (null first), then role and text. Rows are dealt by ranges of that order, so
    that a conversation of any length is spread over tasks: what a slice has before a turn, and what
    earlier slices have, add up to its place. Null roles and texts are empty; rows without a conversation
    belong to none and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    sha = F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), F.concat("role", "text")).cast("binary"), 256))
    sliced = rows.repartitionByRange(shuffle_parts(turns.sparkSession), *order).sortWithinPartitions(*order)
    sliced = sliced.select("conv_id", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("slice"), sha.alias("sha"), F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words"))
    sliced = written(sliced.select("conv_id", "at", "slice", F.xxhash64("sha").alias("d1"), F.xxhash64("sha", F.lit(1)).alias("d2"), "words"), "turns")
    parts = sliced.groupBy("conv_id", "slice").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("size"))
    conv = Window.partitionBy("conv_id")
    before = F.coalesce(F.sum("size").over(conv.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("conv_id", "slice", (F.col("start") - before).alias("start"), F.sum("size").over(conv).alias("n"))
    return sliced.join(parts, ["conv_id", "slice"]).select("conv_id", (F.col("at") - F.col("start")).alias("pos"), "d1", "d2", "words", "n")


def shared_openings(turns: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Numbered turns of which each conversation c opens with the first h = crc32(c) % most turns of conversation c - c % group.

    Then its own turns after its first h follow, if any. One that is left without turns has a row with
    a null ``pos``.
    """
    convs = turns.groupBy("conv_id").agg(F.max("n").alias("own"))
    convs = convs.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % group).alias("source"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"))
    sizes = convs.select(F.col("conv_id").alias("source"), F.least("own", F.lit(most - 1)).alias("there"))
    convs = convs.join(sizes, "source", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    convs = written(convs.select("conv_id", "source", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("total")), "openings")
    opening = turns.where((F.col("conv_id") % group == 0) & (F.col("pos") < most - 1)).select(F.col("conv_id").alias("source"), "pos", "d1", "d2", "words")
    opening = convs.join(opening, "source").where(F.col("pos") < F.col("taken"))
    own = turns.drop("n").join(convs, "conv_id").where(F.col("pos") >= F.col("h")).withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    none = convs.where("total = 0").withColumns({"pos": F.lit(None).cast("long"), "d1": F.lit(None).cast("long"), "d2": F.lit(None).cast("long"), "words": F.lit(0).cast("long")})
    columns = ["conv_id", "pos", "d1", "d2", "words", F.col("total").alias("n")]
    return opening.select(*columns).union(own.select(*columns)).union(none.select(*columns))


def _xor(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseXOR(b), columns)


def _blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, n, block, hi, lo, before, t1 .. tk): a row for each block, with the node and the words before it, and (end_hi, end_lo, total) after it."""
    place, keys = F.coalesce("pos", F.lit(0)), ["conv_id", "section"]
    rows = turns.select("conv_id", "n", F.floor(place / COLUMNS).alias("block"), (place % COLUMNS).alias("column"), "words", F.xxhash64("pos", "d1", "d2").alias("hi"), F.xxhash64("d2", "d1", "pos").alias("lo"), F.col("pos").isNotNull().alias("there"))
    rows = rows.withColumn("section", F.floor(F.col("block") / SECTION)).repartition(*keys)
    at = {c: [F.max(F.when(F.col("there") & (F.col("column") == k), F.col(c))).alias(f"{c}{k}") for k in range(COLUMNS)] for c in ("hi", "lo", "words")}
    # Aggregated where the rows are: they are dealt by conversation and section.
    blocks = rows.groupBy(*keys, "n", "block").agg(*at["hi"], *at["lo"], *at["words"])
    total = {"hi": _xor, "lo": _xor, "words": lambda xs: reduce(lambda a, b: a + b, xs)}
    own = {c: f([F.coalesce(f"{c}{k}", F.lit(0)) for k in range(COLUMNS)]) for c, f in total.items()}
    blocks = blocks.withColumns({f"own_{c}": x for c, x in own.items()})
    fold = {"hi": F.bit_xor, "lo": F.bit_xor, "words": F.sum}
    sections = blocks.where(F.col("n") > COLUMNS * SECTION).groupBy(*keys).agg(*[f(f"own_{c}").alias(f"own_{c}") for c, f in fold.items()])
    up_to = Window.partitionBy("conv_id").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    sections = sections.select(*keys, *[F.coalesce(f(f"own_{c}").over(up_to), F.lit(0)).alias(f"far_{c}") for c, f in fold.items()])
    within = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({f"near_{c}": F.coalesce(f(f"own_{c}").over(within), F.lit(0)) for c, f in fold.items()}).join(sections, keys, "left")
    far = {c: F.coalesce(f"far_{c}", F.lit(0)) for c in fold}
    turn = [F.when(F.col(f"hi{k}").isNotNull(), F.struct(F.col(f"hi{k}").alias("hi"), F.col(f"lo{k}").alias("lo"), F.col(f"words{k}").alias("words"))).alias(f"t{k + 1}") for k in range(COLUMNS)]
    hi, lo = (F.col(f"near_{c}").bitwiseXOR(far[c]) for c in ("hi", "lo"))
    return blocks.select("conv_id", "n", "block", hi.alias("hi"), lo.alias("lo"), (F.col("near_words") + far["words"]).alias("before"), *turn, hi.bitwiseXOR(F.col("own_hi")).alias("end_hi"), lo.bitwiseXOR(F.col("own_lo")).alias("end_lo"), (F.col("near_words") + far["words"] + F.col("own_words")).alias("total"))


def _rolled(blocks: DataFrame, aggregates: str) -> DataFrame:
    """A row for each node: depth, its name (hi, lo), its parent's (up_hi, up_lo), words before its last turn and of it, aggregates."""
    columns = ", ".join(f"t{k + 1}" for k in range(COLUMNS))
    rolled = blocks.sparkSession.sql(f"SELECT block, hi, lo, before, {columns}, grouping_id() AS gid, {aggregates} FROM {{blocks}} GROUP BY block, hi, lo, before, ROLLUP ({columns})", blocks=blocks)
    level = (F.lit(COLUMNS) - F.bit_count("gid")).cast("long")
    rolled = rolled.withColumns({"level": level, "path": F.array_compact(F.array(*[f"t{k + 1}" for k in range(COLUMNS)]))})
    aggregated = rolled.columns[5 + COLUMNS : -2]
    # A column that is null, and not rolled up, stands behind a conversation's end.
    rolled = rolled.where((F.size("path") == F.col("level")) & ((F.col("level") > 0) | (F.col("block") == 0)))
    last = F.get("path", F.size("path") - 1)
    of = lambda c: F.aggregate("path", F.col(c), lambda a, t: a.bitwiseXOR(t[c]))
    rolled = rolled.withColumns({"depth": F.col("block") * COLUMNS + F.col("level"), "last": last, "node_hi": of("hi"), "node_lo": of("lo"), "words": F.coalesce(last["words"], F.lit(0))})
    before = F.aggregate("path", F.col("before"), lambda a, t: a + t["words"]) - F.col("words")
    return rolled.select("depth", F.col("node_hi").alias("hi"), F.col("node_lo").alias("lo"), F.col("node_hi").bitwiseXOR(F.coalesce("last.hi", F.lit(0))).alias("up_hi"), F.col("node_lo").bitwiseXOR(F.coalesce("last.lo", F.lit(0))).alias("up_lo"), before.alias("before"), "words", *aggregated)


def _listed(ends: DataFrame) -> DataFrame:
    """(hi, lo, ends_sha256): digests of the ascending, comma-joined ids of the conversations that end in a node.

    Ids are dealt by node and sorted, and stream through one hash state, however many end in one node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for hi, lo, conv in zip(*(batch.column(n).to_pylist() for n in range(3)), strict=True):
                if (hi, lo) != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = (hi, lo), hashlib.sha256(str(conv).encode())
                else:
                    state.update(b",%d" % conv)
            yield pa.RecordBatch.from_arrays([pa.array([d[n] for d in done], t) for n, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["hi", "lo", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([node[1]]), pa.array([state.hexdigest()])], names=["hi", "lo", "ends_sha256"])

    return ends.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "conv_id").mapInArrow(run, "hi long, lo long, ends_sha256 string")


def _with_parents(nodes: DataFrame) -> DataFrame:
    """Nodes with n_children and parent_conv_id.

    A node whose smallest member has had an earlier node of its path shares it with the parent; only the first
    node of each member looks its parent up. Parents of very many children meet them in several tasks.
    """
    spark, node, up = nodes.sparkSession, ["hi", "lo"], ["up_hi", "up_lo"]
    counts = nodes.where("depth > 0").groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(counts.select(F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo"), "n_children"), node, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = written(nodes, "nodes")
    parents = nodes.where("n_children > 0").select(F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv_id").alias("parent_conv_id"), F.ceil(F.col("n_children") / HOT).cast("int").alias("copies"))
    hot = parents.where("copies > 1").select(*up, "copies")
    n_hot = hot.count()
    first = nodes.where("depth = first_depth and depth > 0")
    if 0 < n_hot <= MOST_HOT:
        first = first.join(F.broadcast(hot), up, "left").withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
        parents = parents.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        first = first.join(parents.drop("copies"), [*up, "salt"]).drop("salt")
    else:
        first = first.join(parents.drop("copies"), up)
    rest = nodes.where("depth > first_depth").withColumn("parent_conv_id", F.col("conv_id"))
    top = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return first.unionByName(rest).unionByName(top)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie of numbered turns (``numbered``), a row for each distinct sequence of first turns.

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (words
    that a cache of prefixes saves in the subtree), ends_sha256 (members that have just these turns). Defined
    results: a conversation that a row with a null ``pos`` names has no turns and ends in the root;
    an empty table has no node; turns with equal roles and texts at one place are equal, whatever their numbers.
    """
    blocks = written(_blocks(turns), "blocks")
    final = F.greatest(F.ceil(F.col("n") / COLUMNS) - 1, F.lit(0))
    ends = blocks.where(F.col("block") == final).select(F.col("end_hi").alias("hi"), F.col("end_lo").alias("lo"), "conv_id", "total")
    # Equal conversations end in one node: the smallest stands for all, with their number.
    equal = ends.groupBy("hi", "lo").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"), F.min("total").alias("total")).select("conv_id", "weight", "total")
    blocks = written(blocks.drop("end_hi", "end_lo", "total").join(equal, "conv_id"), "distinct-blocks")
    owned = _rolled(blocks, "min(conv_id) AS conv_id, max(n) AS deepest")
    owned = owned.groupBy("conv_id").agg(F.min("depth").alias("first_depth"), F.min("before").alias("shared"), F.max((F.col("deepest") == F.col("depth")).cast("long")).alias("leaf"))
    blocks = blocks.join(owned, "conv_id", "left").withColumn("owned", F.coalesce(F.col("total") - F.col("shared"), F.lit(0))).drop("shared")
    nodes = _rolled(blocks, "sum(weight) AS n_convs, sum(weight * total) AS spoken, sum(coalesce(leaf, 0)) AS n_leaves, sum(owned) AS owned_words, min_by(struct(conv_id, first_depth, owned, total), conv_id) AS least")
    saved = F.col("spoken") - F.col("n_convs") * F.col("before") - (F.col("owned_words") - F.col("least.owned") + F.col("least.total") - F.col("before"))
    nodes = nodes.select("depth", "hi", "lo", "up_hi", "up_lo", "least.conv_id", "least.first_depth", "n_convs", "n_leaves", saved.alias("saved_tokens"))
    full = _with_parents(nodes).join(_listed(ends.drop("total")), ["hi", "lo"], "left")
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))

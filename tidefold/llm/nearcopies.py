"""SimHash near-dedup down to a similarity of whole texts: Jaccard of five-word shingle sets, 0.8 or more.

Candidates are the pairs that SimHash brings together: fingerprints of five-word shingles, copied to the
anchors of the covering code and compared there (see simhash), so all pairs within 3 bits. But texts at
similarity 0.8 differ in 10 of 64 bits on average and in up to 17, and a covering of that radius would bring
all texts together. Min-hashes find what is beyond: BANDS bands of ROWS each, of which a pair at similarity
0.8 shares one with probability 1 - (1 - 0.8 ** 6) ** 40 > 0.99999, a closer pair more surely.

What meets is numbers only: random fingerprints meet at anchors the more the larger the input is, and part
there. Texts that candidates connect are brought together once, and the shingle sets themselves are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_groups, checkpointed, components, in_blocks, root, shuffle_parts, written
from .simhash import THRESHOLD, _copies, majority, shingle_hashes

WIDTH = 5
BANDS, ROWS = 40, 6
BLOCK = 512
ANCHOR_BLOCK = 4096
BROADCAST_ROWS = 1_000_000
_RNG = np.random.default_rng(42)
_MULTIPLIERS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RNG.integers(0, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_NO = _RNG.integers(0, 1 << 63, BANDS, np.uint64)


def distinct(hashes: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate([np.empty(0, np.uint64), *hashes]))


def shingles(text: str | None) -> np.ndarray:
    """The sorted set of hashes of five-word shingles; a shorter text is one shingle, a wordless one has none."""
    return distinct(list(shingle_hashes(text, WIDTH)))


def bands(h: np.ndarray) -> np.ndarray:
    """Hashes of the bands of a set of shingles."""
    if not len(h):
        return np.empty(0, np.uint64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 512):
        np.minimum(low, (h[at : at + 512, None] * _MULTIPLIERS).min(axis=0), out=low)
    mixed = (low.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64) + _BAND_NO
    return (mixed ^ (mixed >> np.uint64(29))) * _MIX[0]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, sig, fp, bands): sig stands for the shingle set, fp is the fingerprint."""
    for batch in batches:
        sigs, fps, out = [], [], []
        for text in batch.column(2):
            hashes = list(shingle_hashes(text.as_py(), WIDTH))
            h = distinct(hashes)
            sigs.append(xxhash.xxh64_intdigest(h.tobytes()))
            fps.append(majority(hashes))
            out.append(bands(h).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (sigs, fps)), pa.array(out, pa.list_(pa.int64()))], names=["id", "key", "sig", "fp", "bands"])


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, fp) of the fingerprints of an anchor that differ from another one there in at most THRESHOLD bits."""
    buckets, found, n = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(buckets)), pa.array(np.concatenate(found))], names=["bucket", "fp"])

    for bucket, ids, left, fps in block_groups(batches, "id", lambda c: c.to_numpy().view(np.uint64)):
        li, ri, met = np.flatnonzero(left), np.flatnonzero(~left), np.zeros(len(ids), bool)
        for at in range(0, len(li), 512):
            own = li[at : at + 512]
            apart = np.bitwise_count(fps[own][:, None] ^ fps[ri][None, :])
            near = (apart > 0) & (apart <= THRESHOLD)
            met[own] |= near.any(axis=1)
            met[ri] |= near.any(axis=0)
        if met.any():
            found.append(np.unique(ids[met]))
            buckets.append(np.full(len(found[-1]), bucket))
            n += len(found[-1])
        if n >= 10_000:
            yield batch()
            buckets, found, n = [], [], 0
    if n:
        yield batch()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingle set in place of the text; rows of one text come together."""
    last, held = None, b""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):  # sets are larger than texts: small batches
            part, sets = batch.slice(at, 256), []
            for sig, text in zip(part.column(4).to_pylist(), part.column(5), strict=True):
                if sig != last:
                    last, held = sig, shingles(text.as_py()).tobytes()
                sets.append(held)
            yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(sets, pa.binary())], names=["bucket", "bi", "bj", "b", "sig", "set"])


def cell_links(ids: list[int], blocks: list[int], sets: list[np.ndarray], within: bool) -> list[tuple[int, int]]:
    """Of similar pairs, links enough to connect them; pairs of one block only if ``within``."""
    n, sizes, block = len(ids), np.array([len(x) for x in sets]), np.array(blocks)
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    parent: dict[int, int] = {}
    out = []
    for i in range(n - 1):
        lo, hi = np.searchsorted(tokens, sets[i], "left"), np.searchsorted(tokens, sets[i], "right")
        each = hi - lo
        at = np.repeat(lo - np.cumsum(each) + each, each) + np.arange(each.sum())
        shared = np.bincount(owner[at], minlength=n)
        near = 5 * shared >= 4 * (sizes + sizes[i] - shared)
        near[: i + 1] = False
        if not within:
            near &= block != block[i]
        for j in np.flatnonzero(near).tolist():
            p, q = root(parent, ids[i]), root(parent, ids[j])
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((ids[i], ids[j]))
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each cell of rows sorted by (bucket, bi, bj)."""
    cell, ids, blocks, sets = None, [], [], []

    def found() -> pa.RecordBatch:
        links = cell_links(ids, blocks, sets, cell[1] == cell[2]) if len(ids) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        bucket, bi, bj, b, sig = (batch.column(k).to_pylist() for k in range(5))
        for k in range(batch.num_rows):
            here = (bucket[k], bi[k], bj[k])
            if here != cell:
                if len(ids) > 1:
                    yield found()
                cell, ids, blocks, sets = here, [], [], []
            ids.append(sig[k])
            blocks.append(b[k])
            sets.append(np.frombuffer(batch.column(5)[k].as_py(), np.uint64))
    if len(ids) > 1:
        yield found()


def _small(rows: DataFrame) -> DataFrame:
    """Rows of two or three numbers that were written: broadcast where they are few, else joined by shuffle."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _at_anchors(classes: DataFrame) -> DataFrame:
    """(bucket, sig) of the classes that have another one within THRESHOLD bits at an anchor, or their very fingerprint in common."""
    parts = max(shuffle_parts(classes.sparkSession), classes.sparkSession.sparkContext.defaultParallelism)
    fps = classes.select(F.col("fp").alias("id"), "fp").distinct().repartition(parts, "id")  # a row makes some 36 copies: few tasks would do for the rows
    near = in_blocks(fps.mapInArrow(_copies, "bucket long, home boolean, id long, fp long").drop("fp"), ANCHOR_BLOCK, _within, "bucket long, fp long").distinct()
    equal = classes.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.xxhash64("fp").alias("bucket"), "fp")
    return written(classes.select("sig", "fp").join(_small(written(near.union(equal), "near-anchors")), "fp").select("bucket", "sig"), "near-at-anchors")


def _met(classes: DataFrame, block: int) -> DataFrame:
    """(bucket, sig, cuts): the buckets whose classes are compared with each other, each cut into ``cuts`` blocks.

    Buckets with the same members are one bucket. Classes that buckets connect are one bucket too, so that a text is
    sent to one place; but more than ``block`` of them only if that sends fewer texts than their buckets do.
    """
    in_bands, at_anchors = classes.select(F.explode("bands").alias("bucket"), "sig"), _at_anchors(classes)
    shared = [x.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("sig")).alias("who")).where("n > 1") for x in (in_bands, at_anchors)]
    shared = shared[0].union(shared[1]).groupBy("n", "who").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("n") / block).cast("int").alias("cuts"))
    shared = _small(written(shared, "near-buckets"))
    met = written(in_bands.join(shared, "bucket").union(at_anchors.join(shared, "bucket")), "near-members")
    low = _small(written(met.groupBy("bucket").agg(F.min("sig").alias("b")), "near-lows"))
    reached = checkpointed(components(met.join(low, "bucket").select(F.col("sig").alias("a"), "b"))).withColumnRenamed("id", "sig")
    placed, parts = met.join(reached, "sig"), F.ceil(F.col("n") / block).cast("int")
    sent = reached.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).join(placed.groupBy("component").agg(F.sum("cuts").alias("apart")), "component")
    large = _small(written(sent.select("component", parts.alias("parts"), (F.col("n") * parts <= F.col("apart")).alias("whole")), "near-large"))
    whole = reached.join(large, "component", "left").where("coalesce(whole, true)").select(F.col("component").alias("bucket"), "sig", F.coalesce("parts", F.lit(1)).alias("cuts"))
    return written(whole.union(placed.join(large.where("not whole"), "component").select("bucket", "sig", "cuts")), "near-cells")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, key, component_id): the smallest id that links of similarity 0.8 and more reach; key stands for id and text.

    Equal shingle sets are one class, compared once. A bucket of over ``block`` classes is cut into blocks,
    every two of which meet in some task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    signed = written(rows.mapInArrow(_signatures, "id long, key long, sig long, fp long, bands array<long>"), "near-signatures")
    classes = signed.groupBy("sig").agg(F.min("id").alias("rep"), F.min("key").alias("key"), F.first("fp").alias("fp"), F.first("bands").alias("bands")).where("rep is not null")
    classes = written(classes.drop("rep"), "near-classes")
    met = _met(classes, block)
    wanted = classes.select("sig", F.col("key").alias("_key")).join(met.select("sig").distinct(), "sig", "left_semi")
    texts = rows.select("key", "text").join(_small(written(wanted, "near-texts")), F.col("key") == F.col("_key")).select("sig", "text").dropDuplicates(["sig"])
    b, j = F.col("b"), F.col("j")
    cells = met.select("bucket", "sig", "cuts", F.pmod(F.xxhash64("sig", F.lit(7)), "cuts").cast("int").alias("b")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    cells = cells.select("bucket", F.least(b, j).alias("bi"), F.greatest(b, j).alias("bj"), "b", "sig").join(texts.hint("merge"), "sig").select("bucket", "bi", "bj", "b", "sig", "text")
    cells = cells.mapInArrow(_sets, "bucket long, bi int, bj int, b int, sig long, set binary")
    parts = max(shuffle_parts(spark), spark.sparkContext.defaultParallelism)
    links = cells.repartition(parts, "bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj").mapInArrow(_compare, "a long, b long")
    found = checkpointed(components(links)).withColumnRenamed("id", "sig")
    reps = signed.groupBy("sig").agg(F.min("id").alias("rep"))
    low = reps.join(found, "sig").groupBy("component").agg(F.min("rep").alias("low"))
    linked = found.join(low, "component").select("sig", "low")
    named = reps.join(linked, "sig", "left").select("sig", F.least("rep", "low").alias("component_id"))
    return signed.select("id", "key", "sig").join(named, "sig").select("id", "key", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, one of each group of near copies: that with the smallest id.

    Rows with a null id stay; rows that repeat an id and text are one document and stay or go together;
    of different texts under one id only those go that a smaller id stands for; wordless texts are copies of each other.
    """
    drop = groups(docs, id_col, text_col).where("id is not null and component_id < id").select(F.col("id").alias("__tidefold_id"), F.col("key").alias("__tidefold_key")).distinct()
    drop = written(drop, "near-dropped")
    few = drop.count() <= BROADCAST_ROWS  # else all texts are shuffled
    same = (docs[id_col].cast("long") == F.col("__tidefold_id")) & (F.xxhash64(docs[id_col], docs[text_col]) == F.col("__tidefold_key"))
    return docs.join(drop.hint("broadcast" if few else "shuffle_hash"), same, "left_anti")

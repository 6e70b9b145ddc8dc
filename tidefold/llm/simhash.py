"""SimHash near-duplicates by anchor-point covering.

Two fingerprints of 64 bits that differ in at most 3 differ in at most 1 bit in one of their two
halves. Of each half the anchors are the words of the [31, 26] Hamming code with one free bit beside
it: a covering code of radius 1. A fingerprint's home is its nearest anchor (at most 1 bit away); it
is copied to every anchor within radius plus threshold, 1 + 1 bits, at most 17 of a half. If x and y
are within 1 bit in a half, y has a copy at the home of x, so each link is found at one anchor or more.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER_TO_LOWER, block_groups, checkpointed, components, in_blocks, root

SEED = 42
THRESHOLD = 3
PIECE = 1 << 20
CODE_BITS = 31


def _pieces(data: bytes) -> Iterator[bytes]:
    """Cut at white space into parts of about PIECE bytes, so that a very long text isn't split into words at once."""
    start = 0
    while start < len(data):
        end = start + PIECE
        if end < len(data):
            while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
                end += 1
        yield data[start:end]
        start = end


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 of all ``width``-word shingles of a text, by pieces; a text of fewer words is one shingle, a wordless one has none."""
    tail, n_words, total = [], 0, 0
    digest = xxhash.xxh64_intdigest
    for piece in _pieces((text or "").encode("utf-8", "surrogatepass").translate(UPPER_TO_LOWER)):
        words = piece.split()
        n_words += len(words)
        words = tail + words
        tail = words[-(width - 1) :] if width > 1 else []
        n = len(words) - width + 1
        if n <= 0:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        total += n
        yield np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, n)
    if n_words and not total:
        yield np.array([digest(b" ".join(tail), SEED)], np.uint64)


def majority(hashes: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of all hashes."""
    counts, total = np.zeros(64, np.int64), 0
    for h in hashes:
        total += len(h)
        for at in range(0, len(h), 65536):
            part = h[at : at + 65536].astype("<u8")
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > total).tolist()))


def fingerprint(text: str | None, width: int = 3) -> int:
    """Majority bits of the XXH64 of all ``width``-word shingles of a text, repeats included."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, fp long): key stands for id and text; fp holds the 64 bits in two's complement, 0 for a null or wordless text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py()) for x in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["id", "key", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, key long, fp long")


def _parity_syndrome(half: np.ndarray) -> np.ndarray:
    """XOR of the places (from 1) of the bits that are set among the low 31."""
    s = np.zeros(len(half), np.uint64)
    for i in range(CODE_BITS):
        s ^= ((half >> np.uint64(i)) & np.uint64(1)) * np.uint64(i + 1)
    return s


def anchors(fp: np.ndarray, half_no: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, home) of each copy of the fingerprints at the anchors of one half."""
    half = (fp >> np.uint64(32 * half_no)) & np.uint64(0xFFFFFFFF)
    s = _parity_syndrome(half)
    top = np.uint64(1 << 31)
    nearest = np.where(s > 0, half ^ (np.uint64(1) << (np.maximum(s, np.uint64(1)) - np.uint64(1))), half)
    rows, out, home = [np.arange(len(fp))] * 2, [nearest, nearest ^ top], [np.ones(len(fp), bool), np.zeros(len(fp), bool)]
    for i in range(1, CODE_BITS + 1):
        j = s ^ np.uint64(i)
        ok = (s > 0) & (j > i)
        r = np.flatnonzero(ok)
        rows.append(r)
        out.append(half[r] ^ (np.uint64(1) << np.uint64(i - 1)) ^ (np.uint64(1) << (j[r] - np.uint64(1))))
        home.append(np.zeros(len(r), bool))
    bucket = np.concatenate(out) | np.uint64(half_no << 32)
    return np.concatenate(rows), bucket.astype(np.int64), np.concatenate(home)


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for at in range(0, len(ids), 4096):
            part = fps[at : at + 4096].view(np.uint64)
            for half_no in (0, 1):
                rows, bucket, home = anchors(part, half_no)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(home), pa.array(ids[at : at + 4096][rows]), pa.array(part[rows].view(np.int64))], names=["bucket", "home", "id", "fp"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block, links enough to connect what is linked in it: at most one fewer than it has ids."""
    a_out: list[int] = []
    b_out: list[int] = []
    for _, ids, left, fps in block_groups(batches, "fp", lambda c: c.to_numpy().view(np.uint64)):
        li, ri = np.flatnonzero(left), np.flatnonzero(~left)
        if not len(li) or not len(ri):
            continue
        parent: dict[int, int] = {}
        for at in range(0, len(li), 512):
            own = li[at : at + 512]
            i, j = np.nonzero(np.bitwise_count(fps[own][:, None] ^ fps[ri][None, :]) <= THRESHOLD)
            x, y = ids[own[i]], ids[ri[j]]
            keep = x != y
            for p, q in zip(x[keep].tolist(), y[keep].tolist(), strict=True):
                rp, rq = root(parent, p), root(parent, q)
                if rp != rq:
                    parent[max(rp, rq)] = min(rp, rq)
                    a_out.append(max(p, q))
                    b_out.append(min(p, q))
        if len(a_out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])
            a_out, b_out = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])



def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 4096) -> DataFrame:
    """(id, key, fp, component_id): as ``near_duplicates``, with the key that stands for id and text."""
    fps = checkpointed(fingerprints(docs, id_col, text_col))
    classes = fps.groupBy("fp").agg(F.min("id").alias("rep"))
    copies = classes.where("rep is not null").select(F.col("rep").alias("id"), "fp").mapInArrow(_copies, "bucket long, home boolean, id long, fp long")
    links = in_blocks(copies, block, _compare, "a long, b long")
    found = components(links).withColumnRenamed("id", "rep")
    classes = classes.join(found, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(classes, "fp").select("id", "key", "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 4096) -> DataFrame:
    """(id, fingerprint, component_id): groups of documents that links of at most 3 differing bits connect.

    Equal fingerprints are one class, compared once under its smallest id, so a group of copies of any
    size is one row in the comparison. Defined results: null and empty texts have fingerprint zero and
    link like any other; rows that repeat an id come out as often as they go in; a null id keeps its
    fingerprint and takes the smallest non-null id of its class, if there is one; other columns are ignored.
    """
    found = groups(docs, id_col, text_col, block)
    return found.select("id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, one of each group of near-duplicates: that with the smallest id.

    Rows with a null id stay; rows that repeat an id and text are one document and stay or go together;
    of different texts under one id only those go that a smaller id stands for.
    """
    drop = groups(docs, id_col, text_col).where("id is not null and component_id < id").select(F.col("id").alias("__tidefold_id"), F.col("key").alias("__tidefold_key")).distinct()
    same = (docs[id_col].cast("long") == F.col("__tidefold_id")) & (F.xxhash64(docs[id_col], docs[text_col]) == F.col("__tidefold_key"))
    return docs.join(drop.hint("shuffle_hash"), same, "left_anti")

"""Line dedup by content-defined chunks of lines.

A chunk runs from the start of a line over the fewest whole lines that hold LEAST words, and its rolling
hash is taken over the hashes of these lines. A line opens a chunk if its rolling hash is the smallest
among the starts within some window of WINDOW words. So both limits of a chunk follow from its own
content and from what is beside it within the window: where text is moved, its chunks move along.

Any passage of at least LEAST + WINDOW - 1 words that two documents share line for line has a window all
of whose chunks lie inside it, and so a chunk that both of them cut alike, whatever is beside it there.
Repeated chunks are found by their 128-bit hashes; the bytes are then compared with those of the first
document that holds the chunk, and from there on line by line to both ends of the shared passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Words of the shortest chunk, and of the window of starts of which one is taken: passages of over 50 words are found.
LEAST, WINDOW = 40, 11
#: Words beside a chunk up to which the ends of a passage are looked for: no chunk inside it is farther from them.
BEFORE, AFTER = 2 * WINDOW, LEAST + 2 * WINDOW
CHUNKS = "key long, doc long, start int, n int, high long, low long"
KEEPERS = "high long, low long, keeper long, at int, text binary, before array<binary>, after array<binary>"
_LAST = (1 << 63) - 1
_BASES = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _window_sums(values: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rolling hashes of values[start:end]: the sum of value * base ** place, divided by base ** start (modulo 2 ** 64)."""
    n = len(values)
    with np.errstate(over="ignore"):
        one = np.ones(1, np.uint64)
        powers, inverse = (np.cumprod(np.concatenate((one, np.full(n, b, np.uint64)))) for b in (base, pow(base, -1, 1 << 64)))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * powers[:n])))
        return _mixed((sums[end] - sums[start]) * inverse[start])


def chunks_of(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, high, low) of a document's chunks: line numbers and the 128 bits of the rolling hash."""
    n = len(lines)
    words = np.fromiter((len(x.split()) for x in lines), np.int64, n)
    upto = np.concatenate(([0], np.cumsum(words)))
    end = np.searchsorted(upto, upto[:-1] + LEAST)
    start = np.flatnonzero(end <= n)
    if not len(start):
        return start, start, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    end = end[start]
    digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in lines]), ">u8").reshape(n, 2).astype(np.uint64)
    high, low = (_window_sums(digests[:, k], int(_BASES[k]), start, end) for k in (0, 1))
    # Starts are those of the first len(start) lines; an empty line takes a word's room in a window.
    room = np.concatenate(([0], np.cumsum(np.maximum(words, 1))))[: len(start)]
    at, best = np.arange(len(start)), np.arange(len(start))
    for k in range(1, min(WINDOW, len(start))):
        beside = np.minimum(at + k, len(start) - 1)
        inside = (at + k < len(start)) & (room[beside] - room <= WINDOW - 1)
        best = np.where(inside & (high[beside] <= high[best]), beside, best)
    taken = np.unique(best)
    return start[taken], end[taken], high[taken], low[taken]


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "doc", "start", "n", "high", "low"]
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            found = [chunks_of(x.as_py().split(b"\n")) for x in part.column(2)]
            sizes = [len(f[0]) for f in found]
            start, end, high, low = (np.concatenate([f[k] for f in found]) for k in range(4))
            key, doc = (np.repeat(part.column(k).to_numpy(), sizes) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(start.astype(np.int32)), pa.array((end - start).astype(np.int32)), pa.array(high.view(np.int64)), pa.array(low.view(np.int64))], names=names)


def _beside(lines: list[bytes], words: int) -> list[bytes]:
    """The first lines that hold no more than so many words, an empty line taking a word's room."""
    out, held = [], 0
    for x in lines:
        held += max(len(x.split()), 1)
        if held > words:
            break
        out.append(x)
    return out


def _keeper_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, text, chunks): the bytes of each chunk and the lines beside it."""
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary())]
    names = ["high", "low", "keeper", "at", "text", "before", "after"]
    for batch in batches:
        for key, text, chunks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            lines, rows = text.as_py().split(b"\n"), []
            for c in chunks.as_py():
                a, b = c["start"], c["start"] + c["n"]
                rows.append((c["high"], c["low"], key, a, b"\n".join(lines[a:b]), _beside(lines[max(a - BEFORE, 0) : a][::-1], BEFORE), _beside(lines[b : b + AFTER], AFTER)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _agree(a: list[bytes], b: list[bytes]) -> int:
    """How many lines agree, from the first on."""
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def repeated(lines: list[bytes], hits: list[dict]) -> np.ndarray:
    """Which lines repeat: those of each hit whose bytes are the keeper's, on to both ends of what they share."""
    gone = np.zeros(len(lines), bool)
    for h in hits:
        a, b = h["start"], h["start"] + h["n"]
        if b"\n".join(lines[a:b]) == h["text"]:
            gone[a - _agree(lines[max(a - BEFORE, 0) : a][::-1], h["before"]) : b + _agree(lines[b : b + AFTER], h["after"])] = True
    return gone


def repeats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, doc, hits): of each document, its chunks that an earlier place holds too, with the bytes and lines there."""
    key = F.xxhash64(id_col, text_col).alias("key")
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc")
    source = docs.where(F.col(text_col).isNotNull()).select(key, doc, F.col(text_col).cast("string").cast("binary").alias("text"))
    chunks = written(source.mapInArrow(_chunk_rows, CHUNKS), "line-chunks")
    first = F.min(F.struct("doc", "key", "start", "n")).alias("first")
    again = chunks.groupBy("high", "low").agg(F.count(F.lit(1)).alias("times"), first).where("times > 1")
    holders = again.groupBy("first.key", "first.doc").agg(F.collect_list(F.struct("high", "low", "first.start", "first.n")).alias("chunks"))
    # Rows that repeat an id and text give their chunks' bytes once.
    texts = source.join(holders.hint("shuffle_hash"), ["key", "doc"]).groupBy("key", "doc").agg(F.first("text").alias("text"), F.first("chunks").alias("chunks"))
    # Written, so that the join below deals both of its sides itself and can split a very common chunk.
    keepers = written(texts.select("key", "text", "chunks").mapInArrow(_keeper_rows, KEEPERS), "line-keepers")
    hits = chunks.join(keepers, ["high", "low"]).where("key != keeper or start != at")
    return hits.groupBy("key", "doc").agg(F.collect_list(F.struct("start", "n", "text", "before", "after")).alias("hits"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None) -> DataFrame:
    """The documents without their repeated passages; all rows stay, with their other columns.

    Of a passage that repeats, the document with the smallest id keeps its first copy. Defined results:
    a null text stays null, a text of which nothing is left is empty; rows that repeat an id and text
    are one document; different texts under one id, or under a null id, leave each other's passages, the
    first by a hash keeping them; null ids come last; an empty table gives no rows; chunks whose hashes
    agree but not their bytes stay. ``removed_col`` adds the number of lines that went.
    """
    found = repeats(docs, id_col, text_col).select(F.col("key").alias("__tidefold_key"), F.col("doc").alias("__tidefold_doc"), F.col("hits").alias("__tidefold_hits"))
    same = (F.xxhash64(docs[id_col], docs[text_col]) == F.col("__tidefold_key")) & (F.coalesce(docs[id_col].cast("long"), F.lit(_LAST)) == F.col("__tidefold_doc"))
    joined = docs.join(found.hint("shuffle_hash"), same, "left").select(*[docs[c] for c in docs.columns], "__tidefold_hits")
    place, names = docs.columns.index(text_col), [*docs.columns, *([removed_col] if removed_col else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, hits = batch.columns
            removed = np.zeros(batch.num_rows, np.int32)
            if hits.null_count < len(hits):
                texts = columns[place].to_pylist()
                for i in np.flatnonzero(hits.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    lines = texts[i].encode().split(b"\n")
                    gone = repeated(lines, hits[i].as_py())
                    removed[i] = gone.sum()
                    texts[i] = b"\n".join([x for x, g in zip(lines, gone.tolist(), strict=True) if not g]).decode()
                columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(removed)] if removed_col else [])], names=names)

    schema = docs.schema if not removed_col else docs.limit(0).withColumn(removed_col, F.lit(0)).schema
    return joined.mapInArrow(cut, schema)

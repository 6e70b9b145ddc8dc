"""Sequence packing: shortest pack first over the histogram of piece lengths.

Documents are cut into full sequences and a rest. Only the histogram (one count for each length up to
the sequence length) reaches the driver, which places lengths, longest first, each in the shortest
pack that has room, and so gets packing patterns with counts. Pieces find their place by the rank
among the pieces of their length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path

PIECES = "doc_id long, start long, length int, ids binary, ids_crc32 long, doc_tokens long"
#: Characters of white space in a row from which a text is left to ``tokenizers``.
LONG_SPACE = 100_000


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: itself if it's visible, else the next one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + n): b for n, b in enumerate(hidden)}


def load_encoder(path: str) -> Callable[[str], np.ndarray]:
    """text -> ids of a byte-level BPE file of ``tokenizers``, as its encode(text, add_special_tokens=False) gives them.

    The ids of the file are its merge ranks, so tiktoken can take them, which needs a third of the time. The file's
    added tokens, where a text spells them out, are found before anything else, as ``tokenizers`` does. tiktoken's
    pattern can't go back over very long white space; texts that hold LONG_SPACE of it go to ``tokenizers`` itself.
    """
    import json

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        stored = json.load(f)
    added = {t["content"]: t["id"] for t in stored["added_tokens"]}
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in token): n for token, n in stored["model"]["vocab"].items() if token not in added}
    fast = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    plain = cache(lambda: Tokenizer.from_file(path))
    # Tried where white space begins only, so that the search takes no more than the text's length.
    long_space = re.compile(rf"(?:\A|(?<=\S))\s{{{LONG_SPACE}}}")

    def encode(text: str) -> np.ndarray:
        if len(text) >= LONG_SPACE and long_space.search(text):
            return np.array(plain().encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text, allowed_special="all")

    return encode


def cut(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int, size: int) -> DataFrame:
    """Token pieces of all documents, ids as little-endian unsigned 32-bit numbers; written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(vocabulary)
        names = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ids = encode(text) if text else np.zeros(0, np.uint32)
                data, n = ids.astype("<u4").tobytes() + int(end_id).to_bytes(4, "little"), len(ids) + 1
                for at in range(0, n, size):
                    part = data[4 * at : 4 * (at + size)]
                    rows.append((doc, at, len(part) // 4, part, zlib.crc32(part), n))
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)
    path = new_path(docs.sparkSession, "pieces")
    pieces.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(pieces.schema).parquet(path)


def plan(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths, number of packs), by shortest pack first, longest lengths first."""
    open_packs: list[tuple[int, int, tuple[int, ...], int]] = []  # fill, tie-break, lengths, packs
    tick, done = 0, []
    for length in sorted(histogram, reverse=True):
        count = histogram[length]
        while count:
            if open_packs and open_packs[0][0] + length <= size:
                fill, _, lengths, packs = heappop(open_packs)
                used = min(packs, count)
                if packs > used:
                    heappush(open_packs, (fill, tick, lengths, packs - used))
                added = [((*lengths, length), used)]
                count -= used
            else:  # none has room: new packs, each with as many as would go into it one after another
                each = size // length
                added = [((length,) * each, count // each)] if count >= each else []
                if count % each:
                    added.append(((length,) * (count % each), 1))
                count = 0
            for lengths, packs in added:
                tick += 1
                heappush(open_packs, (sum(lengths), tick, lengths, packs))
        # Packs without room for the next length and packs of equal make-up are merged now and then.
        if len(open_packs) > 4096:
            merged: dict[tuple[int, ...], int] = {}
            for _, _, lengths, packs in open_packs:
                merged[lengths] = merged.get(lengths, 0) + packs
            open_packs = [(sum(k), i, k, v) for i, (k, v) in enumerate(merged.items())]
            heapify(open_packs)
            tick = len(open_packs)
    done += [(lengths, packs) for _, _, lengths, packs in sorted(open_packs)]
    return done


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): which ranks of a length go where."""
    out, rank, sequence = [], {}, 0
    for lengths, packs in patterns:
        offset = 0
        for n in lengths:
            at = rank.get(n, 0)
            out.append((n, at, at + packs, sequence, offset))
            rank[n] = at + packs
            offset += n
        sequence += packs
    return out


def ranked(pieces: DataFrame, total: int, rows_a_window: int = 20_000) -> DataFrame:
    """``rank`` of each piece among those of its length, without bringing a length to one task.

    Pieces are ranked within (length, salt), and the counts of the smaller salts are added.
    """
    salts = max(16, -(-total // rows_a_window))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    own = salted.withColumn("own", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1)
    before = salted.groupBy("length", "salt").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count"))
    return own.join(before.select("length", "salt", "before"), ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "salt")


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 0) -> DataFrame:
    """A row per piece: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.

    Defined results: a null or empty text is the end id alone; rows that repeat an id are packed as
    often as they come; a null id is kept; an empty table gives no rows; other columns are ignored.
    """
    pieces = cut(docs, id_col, text_col, vocabulary, end_id, size)
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``size`` rows
    places = docs.sparkSession.createDataFrame(slots(plan(histogram, size)), "length int, first long, end long, base long, offset int")
    at = ranked(pieces, sum(histogram.values())).join(F.broadcast(places), "length").where("rank >= first and rank < end")
    return at.select("doc_id", "start", F.col("length").cast("long"), "ids", "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank") - F.col("first")).alias("sequence_id"), F.col("offset").cast("long"))

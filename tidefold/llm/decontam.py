"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A mask chooses some places of a window of words and ignores the others; its hash is that of the
chosen words. Hashes of all windows of benchmark items and of documents are joined. Each hit gives a
diagonal (place in the document less place in the item), and the words of both along the diagonal are
then compared, so that an overlap with substituted words counts and a chance hit does not.

The three masks of four places miss nothing that the comparison accepts: for items of 9 to 29 words each set of words
that may be substituted, and each stretch, leaves a window that one of them fits (a test goes through them). Of a
longer item some window of 15 to 29 words has no larger share of its words substituted. No mask takes neighbouring
words alone.

Items of fewer than SHORTEST words have no room for substitutions; they are found whole, word for word, by
the hash of a window of their own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: Places of a window that a mask looks at.
MASKS = ((0, 1, 2, 4), (0, 2, 3, 5), (0, 1, 5, 7))
SPAN = 1 + min(m[-1] for m in MASKS)
#: Words of the shortest item in which words may be substituted; shorter ones are found word for word.
SHORTEST = 9
#: An item is found in a document if on one diagonal this share of its words agrees, or else a stretch of
#: at least STRETCH agreeing words in which no more than one in three is substituted.
SHARE, LEAST, STRETCH = 0.7, 8, 12
BROADCAST_ROWS = 1_000_000
#: Hits of a document that are verified in one row; a document that has more is taken in several.
HITS_A_ROW = 10_000


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-case words (letters and digits) of a text."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _windows(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, place, seed) of rows with a column ``h`` of word hashes, for all masks.

    Where a mask reaches beyond the end, it looks at the words that are there. Places become rows first, and seeds are
    hashed beside them: plain expressions, which are compiled with the join that they feed.
    """
    last = F.size("h") - SPAN
    places = rows.where(last >= 0).select(*keys, "h", F.explode(F.sequence(F.lit(0), last)).alias("place"))
    seeds = F.array(*[F.xxhash64(F.lit(n), *[F.get("h", F.col("place") + k) for k in mask]) for n, mask in enumerate(MASKS)])
    return places.select(*keys, "place", F.explode(seeds).alias("seed"))


def _overlap(a: Column, b: Column) -> Column:
    """(same, stretch): agreeing words of two aligned arrays, and those of the best stretch (+1 each, -2 a substitution)."""
    start = F.struct(F.lit(0).alias("same"), F.lit(0).alias("score"), F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(0).alias("stretch"))

    def step(s: Column, eq: Column) -> Column:
        score = F.when(eq, s["score"] + 1).otherwise(F.greatest(s["score"] - 2, F.lit(0)))
        run = F.when(eq, s["run"] + 1).when(s["score"] <= 2, 0).otherwise(s["run"])
        return F.struct((s["same"] + eq.cast("int")).alias("same"), score.alias("score"), run.alias("run"), F.greatest(s["best"], score).alias("best"), F.when(score > s["best"], run).otherwise(s["stretch"]).alias("stretch"))

    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), start, step, lambda s: F.struct(s["same"].alias("same"), s["stretch"].alias("stretch")))


def _key(id_col: str, text_col: str) -> Column:
    """Stands for a document's id and text."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text"))


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    items = benchmark.select(F.col(item_col).alias("item_id"), word_hashes(F.col(item_text_col).cast("string")).alias("h"))
    return written(items.where(F.size("h") > 0).distinct(), "benchmark-items")


def whole_items(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_key, item_id, same): short items that documents hold word for word; rows: doc_key, h."""
    short = items.where(F.size("h") < SHORTEST)
    lengths = sorted(r[0] for r in short.select(F.size("h")).distinct().collect())  # SHORTEST - 1 numbers at most
    if not lengths:
        return rows.sparkSession.createDataFrame([], T.StructType([rows.schema["doc_key"], items.schema["item_id"], T.StructField("same", T.IntegerType())]))
    whole = short.select("item_id", F.size("h").alias("same"), F.xxhash64("h").alias("seed"))

    def windows(n: int) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size("h") - n), lambda i: F.xxhash64(F.slice("h", i + 1, n)))
        return F.when(F.size("h") >= n, each).otherwise(F.array().cast("array<bigint>"))

    found = rows.select("doc_key", F.explode(F.array_distinct(F.concat(*map(windows, lengths)))).alias("seed"))
    return found.join(F.broadcast(whole) if whole.count() <= BROADCAST_ROWS else whole, "seed").select("doc_key", "item_id", "same").distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_key, item_id, same): overlaps that were verified, and short items held whole; doc_key stands for id and text."""
    all_items = _items(benchmark, item_col, item_text_col)
    items = all_items.where(F.size("h") >= SHORTEST)
    item_seeds = written(_windows(items.withColumn("len", F.size("h")), "item_id", "len").withColumnRenamed("place", "item_place"), "benchmark-seeds")
    rows = docs.where(F.col(text_col).isNotNull()).select(_key(id_col, text_col).alias("doc_key"), word_hashes(F.col(text_col).cast("string")).alias("h"))
    # Only a benchmark of proven size is broadcast; a larger one is joined by shuffle.
    small = item_seeds.count() <= BROADCAST_ROWS
    hits = _windows(rows, "doc_key").join(F.broadcast(item_seeds) if small else item_seeds, "seed")
    diagonals = hits.groupBy("doc_key", "item_id", (F.col("place") - F.col("item_place")).alias("diagonal")).agg(F.first("len").alias("len"))
    # A document's hits are dealt to as many rows as their number asks for.
    counted = written(diagonals, "seed-hits")
    many = counted.groupBy("doc_key").count().where(F.col("count") > HITS_A_ROW).select("doc_key", F.ceil(F.col("count") / HITS_A_ROW).cast("int").alias("cuts"))
    cut = F.pmod(F.xxhash64("item_id", "diagonal"), F.coalesce("cuts", F.lit(1))).alias("cut")
    wanted = counted.join(many, "doc_key", "left").groupBy("doc_key", cut).agg(F.collect_list(F.struct("item_id", "diagonal", "len")).alias("hits"))
    # Hits grow with the documents, so they are never broadcast; texts are dealt once, and only those with hits are hashed again.
    texts = docs.where(F.col(text_col).isNotNull()).select(_key(id_col, text_col).alias("doc_key"), F.col(text_col).cast("string").alias("text"))
    in_docs = texts.join(wanted.withColumnRenamed("doc_key", "k").hint("shuffle_hash"), _same_key("doc_key", "k")).select("doc_key", word_hashes(F.col("text")).alias("h"), "hits")
    beside = lambda x: F.struct(
        x["item_id"].alias("item_id"), x["diagonal"].alias("at"),
        F.slice("h", F.greatest(x["diagonal"], F.lit(0)) + 1, F.greatest(x["len"] + F.least(x["diagonal"], F.lit(0)), F.lit(0))).alias("here"),
    )
    aligned = in_docs.select("doc_key", F.explode(F.transform("hits", beside)).alias("x")).select("doc_key", "x.*")
    pairs = aligned.join(F.broadcast(items) if small else items, "item_id")
    there = F.slice("h", F.greatest(-F.col("at"), F.lit(0)) + 1, F.greatest(F.size("here"), F.lit(1)))
    checked = pairs.select("doc_key", "item_id", F.size("h").alias("n_words"), _overlap(F.col("here"), there).alias("o")).select("*", "o.*").drop("o")
    accepted = checked.where(((F.col("same") >= SHARE * F.col("n_words")) & (F.col("same") >= LEAST)) | (F.col("stretch") >= STRETCH))
    return accepted.select("doc_key", "item_id", "same").union(whole_items(rows, all_items))


def _same_key(a: str, b: str) -> Column:
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.text") == F.col(f"{b}.text"))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, contaminated, item_ids, same): a row per document, with the benchmark items found in it.

    Defined results: a null or wordless text is clean, and an item without words is never found; items of
    fewer than 9 words are found word for word; rows that repeat an id and text come out as often as they
    go in; a null id is kept; equal items are all reported; an empty benchmark leaves all documents clean;
    other columns are ignored.
    """
    found = overlaps(docs, benchmark, id_col, text_col, item_col, item_text_col)
    per_doc = found.groupBy("doc_key").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("same").alias("same")).withColumnRenamed("doc_key", "k")
    item_type = benchmark.schema[item_col].dataType.simpleString()
    rows = docs.select(_key(id_col, text_col).alias("doc_key"))
    joined = rows.join(per_doc, _same_key("doc_key", "k"), "left")
    return joined.select("doc_key.id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast(f"array<{item_type}>")).alias("item_ids"), F.coalesce("same", F.lit(0)).alias("same"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """The documents in which no benchmark item is found, under the rules of ``report``, all columns as they are."""
    bad = overlaps(docs, benchmark, id_col, text_col, **columns).select(F.col("doc_key.id").alias("__tidefold_id"), F.col("doc_key.text").alias("__tidefold_text")).distinct()
    return docs.join(bad.hint("shuffle_hash"), docs[id_col].eqNullSafe(F.col("__tidefold_id")) & (F.xxhash64(docs[text_col]) == F.col("__tidefold_text")), "left_anti")

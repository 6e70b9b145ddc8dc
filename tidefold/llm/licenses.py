"""License scans as an exact set-similarity join, in DataFrame functions only.

Templates of licenses are joined with blocks of text by containment: the share of a template's distinct words
that a block holds. Words are ordered by their number in all texts, the rarest first. A block that holds ``need``
of a template's n words holds one of the template's n - need + 1 rarest (its prefix), so only equal prefix
words bring a block and a template together; a block of fewer than ``need`` words, and a meeting after whose
places too few words are left on either side, go at once; the rest is counted. Words of no template can't
count, so blocks keep the others only.

A block is a window of 2 x STRIDE words, and one starts at every STRIDE-th word: any stretch of up to STRIDE
words stands in one whole. Phrases are templates of which all words are needed; of a block that holds
them, the places are taken where they stand one after the other.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

STRIDE = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """What tells a license: words of which a block must hold a share, or a phrase whose words follow each other."""

    label: str
    text: str
    share: float = 0.8
    phrase: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.lower().split()

    @property
    def tokens(self) -> list[str]:
        return sorted(set(self.words))

    @property
    def need(self) -> int:
        return len(self.tokens) if self.phrase else math.ceil(self.share * len(self.tokens) - 1e-9)


#: The base phrases and their labels.
PHRASES: tuple[Template, ...] = (
    Template("cc-by", "cc by", phrase=True),
    Template("gpl", "general public license", phrase=True),
    Template("reserved", "all rights reserved", phrase=True),
)

#: Short notices, and the opening sentence of licenses that are quoted whole. At most STRIDE words each.
TEMPLATES: tuple[Template, ...] = (
    Template("apache", "licensed under the apache license version 2 0"),
    Template("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("gpl", "this work is licensed under the gnu general public license version 3"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)


def _scanned(docs: DataFrame, id_col: str, text_col: str, vocabulary: list[str]) -> DataFrame:
    """(id, k1, k2, n_words, chunks): of each STRIDE words of a row's text those of the vocabulary, with their places; written.

    (k1, k2) are 128 bits of id and text: rows that repeat both are one document, and get the same result.
    """
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    key = [F.xxhash64("text", "id").alias("k1"), F.xxhash64(F.lit(1), "id", "text").alias("k2")]
    rows = rows.select("id", *key, F.array_remove(F.split("text", BETWEEN_WORDS), "").alias("words"))
    n = F.size("words")

    def chunk(k: Column) -> Column:
        placed = F.transform(F.slice("words", k * STRIDE + 1, STRIDE), lambda w, i: F.struct((k * STRIDE + i).alias("place"), w.alias("word")))
        return F.filter(placed, lambda x: x["word"].isin(vocabulary))

    chunks = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / STRIDE).cast("int")), chunk)).otherwise(F.array())
    return written(rows.select("id", "k1", "k2", n.cast("long").alias("n_words"), chunks.alias("chunks")), "license-words")


def _order(scanned: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary from the rarest to the commonest word of all texts; equally frequent ones by themselves.

    One number for each word of the templates comes to the driver.
    """
    words = scanned.select(F.explode(F.flatten("chunks")).alias("x")).groupBy("x.word").count()
    counts = {r[0]: r[1] for r in words.collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def _index(scanned: DataFrame, templates: tuple[Template, ...], order: list[str]) -> DataFrame:
    """(word, i, t, label, phrase, need, n_t, t_tokens): the prefix words of templates with their places. As large as the templates."""
    rank, rows = {w: n for n, w in enumerate(order)}, []
    for n, t in enumerate(templates):
        tokens = sorted(t.tokens, key=rank.get)
        phrase = [F.lit(w) for w in t.words] if t.phrase else []
        for i, word in enumerate(tokens[: len(tokens) - t.need + 1]):
            row = {"word": F.lit(word), "i": F.lit(i), "t": F.lit(n), "label": F.lit(t.label), "phrase": F.array(*phrase).cast("array<string>"), "need": F.lit(t.need), "n_t": F.lit(len(tokens)), "t_tokens": F.array(*map(F.lit, tokens))}
            rows.append(F.struct(*[v.alias(k) for k, v in row.items()]))
    return scanned.sparkSession.range(1).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def _blocks(scanned: DataFrame, prefix_words: list[str], order: list[str]) -> DataFrame:
    """(id, k1, k2, block, held, tokens): blocks that hold a prefix word, their words with places, and distinct words by rank."""
    both = F.transform("chunks", lambda c, k: F.struct(k.alias("block"), F.concat(c, F.coalesce(F.get("chunks", k + 1), F.array().cast("array<struct<place:int,word:string>>"))).alias("held")))
    some = F.filter(both, lambda b: F.exists(b["held"], lambda x: x["word"].isin(prefix_words)))
    rows = scanned.select("id", "k1", "k2", F.explode(some).alias("b")).select("id", "k1", "k2", "b.*")
    ranked = F.array_sort(F.transform(F.array_distinct("held.word"), lambda w: F.struct(F.array_position(F.array(*map(F.lit, order)), w).alias("rank"), w.alias("word"))))
    return rows.withColumn("tokens", ranked["word"])


def _places(held: Column, phrase: Column) -> Column:
    """Places in the block's first half where the phrase's words follow each other."""

    def follows(x: Column) -> Column:
        return F.forall(F.transform(phrase, lambda w, i: F.array_contains(held, F.struct((x["place"] + i).alias("place"), w.alias("word")))), lambda ok: ok)

    return F.transform(F.filter(held, lambda x: (x["word"] == phrase[0]) & (F.floor(x["place"] / STRIDE) == F.col("block")) & follows(x)), lambda x: x["place"])


def matches(scanned: DataFrame, templates: tuple[Template, ...], order: list[str]) -> DataFrame:
    """(id, k1, k2, block, t, label, places, share): each block and template that meet the containment threshold, once."""
    index = _index(scanned, templates, order)
    prefix_words = sorted({w for t in templates for w in sorted(t.tokens, key=order.index)[: len(t.tokens) - t.need + 1]})
    blocks = _blocks(scanned, prefix_words, order).withColumn("n_b", F.size("tokens"))
    # A block's prefix for the least that any template needs; the join is on equal words of both prefixes.
    reach = F.slice("tokens", 1, F.greatest(F.col("n_b") - min(t.need for t in templates) + 1, F.lit(0)))
    probes = blocks.select("*", F.posexplode(reach).alias("j", "word"))
    met = probes.join(F.broadcast(index), "word")
    met = met.where((F.col("n_b") >= F.col("need")) & (1 + F.least(F.col("n_t") - F.col("i") - 1, F.col("n_b") - F.col("j") - 1) >= F.col("need")))
    # Of the words that a pair shares, the rarest brings it here; it comes by others too, which are left out.
    common = met.withColumn("common", F.array_intersect("tokens", "t_tokens")).where((F.size("common") >= F.col("need")) & (F.get("common", F.lit(0)) == F.col("word")))
    found = common.withColumn("places", F.when(F.size("phrase") > 0, _places(F.col("held"), F.col("phrase")))).where("places is null or size(places) > 0")
    return found.select("id", "k1", "k2", "block", "t", "label", F.coalesce("places", F.array().cast("array<int>")).alias("places"), (F.size("common") / F.col("n_t")).alias("share"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: tuple[Template, ...] = PHRASES, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row.

    Base columns tell of places of phrases: their number, the first and last, and their labels; ``labels``
    also has those of templates, and ``score`` is the largest share of a template that was found, 1 for a phrase
    and 0 for nothing. Defined results: a null or empty text has no words and no labels; rows that
    repeat an id and text get the same result each; a null id is kept; an empty table gives none; other columns are
    ignored.
    """
    rules = (*phrases, *templates)
    vocabulary = sorted({w for t in rules for w in t.tokens})
    scanned = _scanned(docs, id_col, text_col, vocabulary)
    key = ["k1", "k2"]
    # Rows that repeat an id and text find the same: a block and template count once.
    found = matches(scanned, rules, _order(scanned, vocabulary)).groupBy(*key, "block", "t").agg(F.first("label").alias("label"), F.first("places").alias("places"), F.max("share").alias("share"))
    base = F.when(F.size("places") > 0, F.col("label"))
    each = found.groupBy(*key).agg(
        F.sum(F.size("places")).alias("n_base"), F.min(F.array_min("places")).alias("first_word"), F.max(F.array_max("places")).alias("last_word"),
        F.collect_set(base).alias("base_labels"), F.collect_set("label").alias("labels"), F.max("share").alias("score"),
    )
    listed = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return scanned.select("id", *key, "n_words").join(each, key, "left").select(
        "id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        listed("base_labels").alias("base_labels"), listed("labels").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )

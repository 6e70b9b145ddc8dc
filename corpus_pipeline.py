"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. Common to all: an empty
table gives an empty table; other columns, whatever their names, are kept by all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm import decontam, lines, nearcopies, packing, queries, toxicity
from tidefold.llm.common import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go. The models learn from the labels of the whole tables.

    Null, empty and wordless texts have the score of no evidence and stay; repeated rows and rows with a
    null id stay or go by their text alone.
    """
    return toxicity.keep_ordinary(docs, queries.toxicity_model(spark, sf_dir), queries.TOXIC_AT)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat stay in the first document only; n_chars follows the text.

    No row goes. A null text and its n_chars are null, a text of which nothing is left is empty; rows that
    repeat an id and text are one document; null ids come last.
    """
    return lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, that with the smallest id stays.

    Null, empty and wordless texts are copies of each other. Rows that repeat an id and text are one document
    and stay or go together; rows with a null id stay.
    """
    return nearcopies.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and wordless texts stay; rows that repeat an id and text stay or go together; an empty benchmark
    takes nothing.
    """
    return decontam.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of what is left, with its place in a sequence.

    A null or empty text is its end id alone; rows that repeat an id are packed each; ties among pieces of one
    length are broken by id, start and content.
    """
    return packing.pack(docs, queries.vocabulary()).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

#: Learned models and fingerprints can't be written as SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

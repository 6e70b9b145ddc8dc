"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of a file is addressed by its content (SHA-256). The ledger says which blob has been
scanned under which version of which rule; a run scans only the pairs that the ledger lacks, each
blob once however many paths hold it, and joins the findings back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A pattern of one kind of secret. ``body`` is the group whose length counts, 0 for the whole match."""

    kind: str
    version: str
    pattern: str
    body: int
    least: int
    base: bool = True


#: The three base kinds, in the order in which equal starts are listed.
RULES: tuple[Rule, ...] = (
    Rule("assign", "1", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "1", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "1", r"[0-9a-f]+", 0, 24),
)

LEDGER = "blob binary, kind string, rule_version string, spans array<struct<start:int,end:int>>"
#: ``kind_no`` is the place of the kind in the rules of the run that asks, and never stored.
SPANS = "array<struct<start:int,kind_no:int,end:int>>"


def _search(rule: Rule) -> str:
    """The pattern to search by: a run of one class is matched whole, so its least length can stand in the pattern."""
    return rule.pattern if rule.body else rule.pattern.removesuffix("+") + f"{{{rule.least - (4 if rule.kind == 'access' else 0)},}}"


def _segments(text: Column, rule: Rule) -> Column:
    """The text up to the last match, cut after each match; empty without one.

    \\G ties each match to the end of the one before, so the segments (what precedes a match, and the
    match) cover the text from its start, and their lengths add up to places.
    """
    # The plain search goes first: most texts hold none, and it keeps no strings.
    found = F.regexp_extract_all(text, F.lit(rf"\G(?s:.*?)(?:{_search(rule)})"), F.lit(0))
    return F.when(text.rlike(_search(rule)), found).otherwise(F.array().cast("array<string>"))


def _spans(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, kind_no, spans) of (blob, text, kinds): code-point spans of the leftmost non-overlapping matches of each kind due.

    A row for each blob and kind, with no spans where nothing is found. Segments become rows, so a text of
    any number of matches costs no more for each of them.
    """
    due = [F.when(F.array_contains("kinds", r.kind), F.struct(F.lit(n).alias("kind_no"), _segments(F.col("text"), r).alias("segments"))) for n, r in enumerate(rules)]
    rows = blobs.select("blob", F.explode(F.array_compact(F.array(*due))).alias("x")).select("blob", "x.kind_no", F.posexplode_outer("x.segments").alias("i", "segment"))
    at = F.sum(F.length("segment")).over(Window.partitionBy("blob", "kind_no").orderBy("i"))
    match = body = F.lit(None).cast("string")
    for n, r in enumerate(rules):  # a segment's first match is the one that it ends with
        match = F.when(F.col("kind_no") == n, F.regexp_extract("segment", _search(r), 0)).otherwise(match)
        body = F.when(F.col("kind_no") == n, F.regexp_extract("segment", _search(r), r.body)).otherwise(body)
    least = F.get(F.array(*[F.lit(r.least) for r in rules]), F.col("kind_no"))
    placed = rows.select("blob", "kind_no", at.cast("int").alias("end"), F.length(match).alias("n"), (F.length(body) >= least).alias("good"))
    span = F.when(F.col("good"), F.struct((F.col("end") - F.col("n")).alias("start"), "end"))
    return placed.groupBy("blob", "kind_no").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def empty_ledger(spark: SparkSession) -> DataFrame:
    """A ledger that has seen nothing."""
    return spark.createDataFrame([], LEDGER)


def _addressed(versions: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(path, text, blob): every version under its content's address."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    files = versions.select(F.col(path_col).alias("path"), text.alias("text"))
    return files.withColumn("blob", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def additions(versions: DataFrame, path_col: str, text_col: str, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger rows that are due: the spans of every pair of a blob and a rule's version that the ledger lacks.

    Each blob is scanned once, however many versions hold it, and for the rules that are due alone.
    """
    files = _addressed(versions, path_col, text_col)
    todo = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version")) for r in rules])
    pairs = files.groupBy("blob").agg(F.min("path").alias("at")).select("blob", "at", F.explode(todo).alias("r")).select("blob", "at", "r.*")
    unseen = pairs.join(ledger.select("blob", "kind", "rule_version").distinct(), ["blob", "kind", "rule_version"], "left_anti")
    # One row of the versions stands for a blob: that with the smallest path and this content.
    unseen = unseen.groupBy("blob").agg(F.first("at").alias("at"), F.collect_set("kind").alias("kinds")).withColumnRenamed("blob", "b")
    source = files.join(unseen.hint("shuffle_hash"), F.col("path").eqNullSafe(F.col("at")) & (F.col("blob") == F.col("b"))).select("blob", "text", "kinds").dropDuplicates(["blob"])
    names, numbers = F.array(*[F.lit(r.kind) for r in rules]), F.array(*[F.lit(r.version) for r in rules])
    return _spans(source, rules).select("blob", F.get(names, F.col("kind_no")).alias("kind"), F.get(numbers, F.col("kind_no")).alias("rule_version"), "spans")


def findings(versions: DataFrame, path_col: str, text_col: str, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, spans): per version the spans that the ledger holds of its blob under the given rules, ordered by start, then kind."""
    versions_now = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version")) for r in rules])
    current = ledger.where(F.array_contains(versions_now, F.struct("kind", "rule_version")) & (F.size("spans") > 0))
    # A writer that was lost and came again may have added a row twice: it counts once.
    current = current.groupBy("blob", "kind", "rule_version").agg(F.first("spans").alias("spans"))
    number = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind")).cast("int") - 1
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), number.alias("kind_no"), s["end"].alias("end")))
    known = current.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(spans))).alias("spans"))
    paths = _addressed(versions, path_col, text_col).select("path", "blob")
    return paths.join(known, "blob", "left").select("path", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def scan(versions: DataFrame, path_col: str, text_col: str, ledger_path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger under ``ledger_path`` up to date and return (path, blob, spans) of every version.

    Only pairs of a blob and a rule's version that the ledger lacks are scanned, and their rows are
    appended. A run that fails before its append has ended leaves the ledger as it was; a run that is
    repeated adds nothing. Two runs at a time may both scan what neither has found in the ledger; their rows count once.
    Rules may be added, re-ordered and given new versions from run to run. Defined results: a null text counts as empty; rows
    that repeat a path come out as often as they go in; a null path is kept; an empty table gives an empty
    result; other columns are ignored.
    """
    spark = versions.sparkSession
    try:
        ledger = spark.read.schema(LEDGER).parquet(ledger_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        ledger = empty_ledger(spark)
    additions(versions, path_col, text_col, ledger, rules).write.mode("append").parquet(ledger_path)
    return findings(versions, path_col, text_col, spark.read.schema(LEDGER).parquet(ledger_path), rules)


def joined(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

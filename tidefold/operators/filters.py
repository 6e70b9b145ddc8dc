"""Projections, filters and predicates over event rows."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.streams import is_index_stream

PLAIN = re.compile(r"\w+", re.ASCII)


def name_matches(name: Column, patterns: Iterable[str]) -> Column:
    """Plain names (letters, digits, ``_``) match exactly, other patterns as regular expressions anywhere."""
    patterns = list(patterns)
    plain = [p for p in patterns if PLAIN.fullmatch(p)]
    other = [p for p in patterns if not PLAIN.fullmatch(p)]
    out = name.isin(*plain) if plain else F.lit(False)
    for p in other:
        out = out | name.rlike(p)
    return out


def _allowed(name: Column, allow: Sequence[str], deny: Sequence[str]) -> Column:
    ok = name_matches(name, allow) if allow else F.lit(True)
    return ok & ~name_matches(name, deny) if deny else ok


def stream_filter(df: DataFrame, allow_categories: Sequence[str] = (), deny_categories: Sequence[str] = (), allow_streams: Sequence[str] = (), deny_streams: Sequence[str] = (), include_indexes: bool = False, own_categories: Sequence[str] = ()) -> DataFrame:
    """Rows of the streams asked for; nothing allowed means all are, a denial wins, ``$`` streams are out unless asked for."""
    allow = [*allow_categories, *own_categories] if allow_categories else list(own_categories)
    keep = _allowed(F.col("category"), allow, deny_categories) & _allowed(F.col("stream"), allow_streams, deny_streams)
    return df.where(keep if include_indexes else keep & ~is_index_stream(F.col("stream")))


def event_filter(df: DataFrame, allow: Sequence[str] = (), deny: Sequence[str] = ()) -> DataFrame:
    """The same rule on the event type."""
    return df.where(_allowed(F.col("event_type"), allow, deny))


#: What a sync leaves out when it is told nothing.
CHECKPOINT_ENDS, CHECKPOINT_STARTS = ("_checkpoint", "_checkpoints"), ("#serial", "marvel_bookmark")
LONG_STARTS = ("Inventory-", "InventoryCount-", "InventoryLog")
KNOWN_STREAMS = ("SkuFileUpload-534e4362c641461ca27e3d23547f0852", "SkuFileUpload-778f1efeab214f5bab2860d1f802ef24", "PurchaseOrder-5791")


def is_long(stream: Column, starts: Sequence[str] = LONG_STARTS) -> Column:
    out = F.lit(False)
    for s in starts:
        out = out | stream.startswith(s)
    return out


def sync_filter(
    df: DataFrame, deny: Sequence[str] = (), allow: Sequence[str] = (), exclude_long: bool = True, long_only: bool = False,
    known: Sequence[str] = KNOWN_STREAMS, long_starts: Sequence[str] = LONG_STARTS, checkpoint_starts: Sequence[str] = CHECKPOINT_STARTS, checkpoint_ends: Sequence[str] = CHECKPOINT_ENDS,
) -> DataFrame:
    """Streams to copy (P5).

    By an allow or a deny list of categories, and then by it alone. Without one: the long streams with
    ``long_only``, or else all but ``known`` names, checkpoints and, with ``exclude_long``, long ones.
    """
    if allow and deny:
        raise ValueError("an allow list and a deny list exclude each other")
    stream, category = F.col("stream"), F.col("category")
    if allow:
        return df.where(category.isin(*allow))
    if deny:
        return df.where(~category.isin(*deny))
    if long_only:
        return df.where(is_long(stream, long_starts))
    out = stream.isin(*known) if known else F.lit(False)
    for s in checkpoint_starts:
        out = out | stream.startswith(s)
    for s in checkpoint_ends:
        out = out | stream.endswith(s)
    if exclude_long:
        out = out | is_long(stream, long_starts)
    return df.where(~out)


def guard_payload(df: DataFrame, limit: int = 1_000_000, data: str = "data") -> DataFrame:
    """Drop ``$`` streams and rows that aren't JSON; data over the limit is emptied and marked in ``oversize``."""
    json = F.col(data).isNull() | F.try_parse_json(data).isNotNull()
    large = F.coalesce(F.octet_length(data) > limit, F.lit(False))
    return df.where(~is_index_stream(F.col("stream")) & json).withColumns({"oversize": large, data: F.when(large, F.lit("")).otherwise(F.col(data))})


def typed_body(body: Column, schema: str) -> Column:
    """A struct of a contract's fields, each taken from a parsed body (VARIANT); what isn't there or of another type is null."""
    fields = T.StructType.fromDDL(schema).fields
    path = lambda name: f'$["{name}"]' if "'" in name else f"$['{name}']"
    return F.struct(*[F.try_variant_get(body, path(f.name), f.dataType.simpleString()).alias(f.name) for f in fields])


def decode(df: DataFrame, schemas: dict[str, str], data: str = "data") -> DataFrame:
    """Add a struct column for each known event type, named after it; rows of other types are left out.

    Each body is parsed once, whatever the number of types, and its fields are read by the contract of its type. A
    body that isn't JSON gives a struct of nulls, a null one a null. idx and all other columns stay, so the
    result also serves where the index is needed beside the body.
    """
    known = df.where(F.col("event_type").isin(*schemas)).withColumn("_body", F.try_parse_json(data))
    return known.withColumns({t: F.when((F.col("event_type") == t) & F.col(data).isNotNull(), typed_body(F.col("_body"), s)) for t, s in schemas.items()}).drop("_body")


def decode_strict(df: DataFrame, schemas: dict[str, str], data: str = "data") -> tuple[DataFrame, DataFrame]:
    """(decoded rows, rejected rows with a reason): unknown types and bodies that don't parse are rejects."""
    known = F.coalesce(F.col("event_type").isin(*schemas), F.lit(False))
    parsed = df.withColumn("_body", F.try_parse_json(data))
    # A body that isn't JSON would come out as a struct of nulls.
    parsed = parsed.withColumns({t: F.when((F.col("event_type") == t) & F.col("_body").isNotNull(), typed_body(F.col("_body"), s)) for t, s in schemas.items()}).drop("_body")
    read = F.lit(False)
    for t in schemas:
        read = read | F.col(t).isNotNull()
    reason = F.concat(F.lit("event "), F.col("idx").cast("string"), F.when(known, " has a body that isn't a ").otherwise(" has the unknown type "), F.coalesce("event_type", F.lit("null")))
    return parsed.where(known & read), parsed.where(~(known & read)).select(*df.columns, reason.alias("reason"))


def decode_newest(df: DataFrame, decodable: Column | dict[str, str], data: str = "data") -> DataFrame:
    """Of each stream the newest event that decodes (P10).

    ``decodable`` is a condition, or the contracts by type: then an event decodes if its type is known and its body
    parses, and the result has the typed bodies.
    """
    if isinstance(decodable, dict):
        df, decodable = decode_strict(df, decodable, data)[0], F.lit(True)
    rest = [c for c in df.columns if c != "stream"]
    return df.where(decodable).groupBy("stream").agg(F.max_by(F.struct(*rest), "idx").alias("e")).select("stream", "e.*")


def strip_bodies(df: DataFrame) -> DataFrame:
    """Event rows without data and meta; scans that feed this don't read them."""
    return df.withColumns({c: F.lit(None).cast("string") for c in ("data", "meta") if c in df.columns})


def implies_state_change(df: DataFrame, keys: Sequence[str] = ("stream",), known: Sequence[str] | None = None, snapshot: str = "Snapshotted") -> DataFrame:
    """Per span (``keys``): ``change`` true, false, or null where no event is decodable."""
    known_type = F.lit(True) if known is None else F.col("event_type").isin(*known)
    return df.groupBy(*keys).agg(F.max(F.when(known_type, F.col("event_type") != snapshot)).alias("change"), F.count(F.lit(1)).alias("n"))


def to_summary_items(df: DataFrame, items: str = "items") -> DataFrame:
    """State items as contract items {id, order, title, completed}."""
    return df.withColumn(items, F.transform(items, lambda i: F.struct(i["id"].alias("id"), i["order"].alias("order"), i["title"].alias("title"), i["completed"].alias("completed"))))


def render_view(views: DataFrame, items: str = "value.items", id_is: object = None) -> DataFrame:
    """A row for each item of a summary; no row where there is none; ``id_is`` looks one item up."""
    rows = views.select("stream", F.explode(items).alias("item")).select("stream", "item.*")
    return rows if id_is is None else rows.where(F.col("id") == F.lit(id_is))


def unnest_lines(messages: DataFrame, lines: str = "purchaseOrderInfo") -> DataFrame:
    """A row for each purchase-order line of sku messages."""
    rest = [c for c in messages.columns if c != lines]
    return messages.select(*rest, F.explode(lines).alias("line")).select(*rest, "line.*")


def archivable(df: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Rows of the categories to copy."""
    return df.where(F.col("category").isin(*categories))


def prunable(df: DataFrame, as_of: Column, ages: dict[str, int] | int = 30) -> DataFrame:
    """Rows that are strictly older than so many days at ``as_of``, of all or of given categories."""
    if isinstance(ages, int):
        return df.where(F.col("ts") < as_of - F.make_dt_interval(F.lit(ages)))
    days = F.create_map(*[F.lit(x) for pair in ages.items() for x in pair])[F.col("category")]
    return df.where(F.col("category").isin(*ages) & (F.col("ts") < as_of - F.make_dt_interval(days)))


def rewrite_bodies(df: DataFrame, schema: str, rewrite, data: str = "data") -> DataFrame:
    """Decode bodies with one contract and encode them with another; all other columns stay (P18). A null body stays null."""
    parsed = df.withColumn("_parsed", F.try_parse_json(data))
    body = parsed.withColumn("_body", F.when(F.col(data).isNotNull(), typed_body(F.col("_parsed"), schema)))
    return body.withColumn(data, F.when(F.col(data).isNotNull(), F.to_json(rewrite(F.col("_body"))))).drop("_body", "_parsed")


def span_chunk(df: DataFrame, most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(rows taken, next position of each stream): at most so many of a span, and on by what was taken."""
    taken = df.withColumn("_n", F.row_number().over(Window.partitionBy("stream").orderBy("idx"))).where(F.col("_n") <= most).drop("_n")
    return taken, taken.groupBy("stream").agg((F.min("idx") + F.count(F.lit(1))).alias("next_idx"))

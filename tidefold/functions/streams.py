"""Column functions for stream names, ids, JSON bodies and feed positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPOCH_SIZE = 1_000_000


def parse_stream(df: DataFrame, stream: str = "stream") -> DataFrame:
    """Add category, stream_id and id_parts: the first ``-`` separates, ``_`` joins the parts of an id."""
    dash = F.instr(stream, "-")
    category = F.when(dash > 0, F.substring_index(stream, "-", 1)).otherwise(F.col(stream))
    rest = F.when(dash > 0, F.substr(F.col(stream), dash + 1))
    return df.withColumns({"category": category, "stream_id": rest, "id_parts": F.split(rest, "_")})


def build_stream(category: Column | str, *parts: Column) -> Column:
    """Stream name of a category and the parts of an id."""
    return F.concat_ws("-", F.lit(category) if isinstance(category, str) else category, F.concat_ws("_", *parts))


def normal_guid(value: Column) -> Column:
    """32 lower-case hex digits of a GUID in any usual form."""
    return F.lower(F.regexp_replace(value, r"[-{}()]", ""))


def is_index_stream(stream: Column) -> Column:
    """Streams of derived data have names that begin with ``$``."""
    return stream.startswith("$")


def to_checkpoint(epoch: Column, offset: Column) -> Column:
    """A position within a chain of epochs as one number."""
    return epoch.cast("long") * EPOCH_SIZE + offset.cast("long")


def end_checkpoint(epoch: Column, closed: Column, n: Column) -> Column:
    """Where to go on after an epoch's content: the start of the next one, once it is closed."""
    return F.when(closed, to_checkpoint(epoch + 1, F.lit(0))).otherwise(to_checkpoint(epoch, n))


def from_checkpoint(checkpoint: Column) -> Column:
    """struct<epoch, offset> of a position."""
    return F.struct(F.floor(checkpoint / EPOCH_SIZE).cast("int").alias("epoch"), F.pmod(checkpoint, F.lit(EPOCH_SIZE)).cast("int").alias("offset"))

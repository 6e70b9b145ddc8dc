"""Table functions for SQL and DataFrames: parsers of feed documents, and folds that stream past a state.

Functions are registered under a name of the session, and are called with ``TABLE(..)`` arguments. ``analyze``
gives their schema, and for folds the partitioning and order of what they are fed; Spark deals and sorts the
rows, and a task holds one state at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Mapping

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

#: A parsed event, or with a reason and the document itself a reject.
PARSED = "stream string, idx long, event_type string, data string, ts string, reason string, document string"

Event = tuple[str, int, str, str | None, str | None]


def dump_events(document: dict) -> Iterator[Event]:
    """Events of a dump's document: one each, under the names of the log."""
    yield document["stream"], int(document["idx"]), document["event_type"], document.get("data"), document.get("ts")


def change_feed_events(document: dict) -> Iterator[Event]:
    """Events of a change feed's document: those of a span ``e`` from index ``i`` on, or the one that it is itself."""
    stream, start = document["s"], int(document["i"])
    for n, e in enumerate(document["e"] if "e" in document else [document]):
        body = e.get("d")
        yield stream, start + n, e.get("t") or e["c"], body if body is None or isinstance(body, str) else json.dumps(body, separators=(",", ":")), e.get("at")


FORMS: dict[str, Callable[[dict], Iterable[Event]]] = {"dump": dump_events, "change feed": change_feed_events}


def register_parser(spark: SparkSession, name: str = "parse_feed", forms: Mapping[str, Callable[[dict], Iterable[Event]]] = FORMS, value: str = "value") -> None:
    """Register ``name(TABLE(documents), form)``: the events of JSON documents in the column ``value``.

    ``forms`` are the parsers by name, functions of a document to its events; which one is asked for is checked
    before anything runs. A document that isn't JSON, or that its parser fails on, comes out whole as one row with a
    reason, and none of its events; a null document has no events.
    """
    parsers, schema = dict(forms), T.StructType.fromDDL(PARSED)

    class Parser:
        @staticmethod
        def analyze(documents: AnalyzeArgument, form: AnalyzeArgument) -> AnalyzeResult:
            if not documents.isTable or value not in documents.dataType.names:
                raise ValueError(f"the first argument is a table with a column {value}")
            if form.value not in parsers:
                raise ValueError(f"no form {form.value!r}; there are {', '.join(sorted(parsers))}")
            return AnalyzeResult(schema)

        def eval(self, row: Row, form: str) -> Iterator[tuple]:
            text = row[value]
            if text is None:
                return
            try:
                events = [(*e, None, None) for e in parsers[form](json.loads(text))]
            except (ValueError, KeyError, TypeError, AttributeError) as e:
                events = [(None, None, None, None, None, f"{type(e).__name__}: {e}", text)]
            yield from events

    spark.udtf.register(name, F.udtf(Parser))


def register_fold(spark: SparkSession, name: str, initial: object, evolve: Callable[[object, Row], object], state: str, key: str = "stream", order: str = "idx", result: Callable[[object], object] = lambda s: s) -> None:
    """Register ``name(TABLE(events))``: (key, version, state) of each key's events in order, by a fold of any kind.

    ``evolve`` takes the state and an event's row, ``result`` makes the state's value of type ``state``. The table is
    partitioned by ``key`` and sorted by ``order`` by the function itself; events stream past one state, so a key
    of any length takes no more memory than its state. Null keys are one key.
    """

    kind = T.StructType.fromDDL(f"state {state}")["state"]

    class Fold:
        @staticmethod
        def analyze(events: AnalyzeArgument) -> AnalyzeResult:
            if not events.isTable or not {key, order} <= set(events.dataType.names):
                raise ValueError(f"the argument is a table with the columns {key} and {order}")
            schema = T.StructType([T.StructField(key, events.dataType[key].dataType), T.StructField("version", T.LongType()), kind])
            return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key)], orderBy=[OrderingColumn(order)])

        def __init__(self) -> None:
            self.state, self.last = initial, None

        def eval(self, row: Row) -> None:
            self.state, self.last = evolve(self.state, row), row

        def terminate(self) -> Iterator[tuple]:
            if self.last is not None:
                yield self.last[key], self.last[order] + 1, result(self.state)

    spark.udtf.register(name, F.udtf(Fold))

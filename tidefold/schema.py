"""Table layouts, as DDL: a log is a table, a stream is a key, an event's index is its order within the key."""

EVENT_LOG = (
    "stream string, category string, stream_id string, idx long, event_type string, data string, meta string, event_id string, "
    "correlation_id string, causation_id string, ts timestamp, is_unfold boolean, size long, tranche string, position long"
)
SNAPSHOTS = "stream string, category string, snapshot_type string, version long, state string"
EPOCH_ITEMS = "series string, epoch int, offset int, item_id string, payload string"
ENVELOPE = "key string, value string"
SPAN = "s string, i long, e array<struct<c:string,t:timestamp,d:string,m:string>>"

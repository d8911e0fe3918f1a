"""Schemas of the six tables and of the row shapes that travel between jobs."""

from pyspark.sql import types as T

_S, _I, _L, _B, _D = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.DoubleType()
_TS = T.TimestampNTZType()


def _struct(*fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


ENTRIES = _struct(
    ("id", _S), ("mailing_id", _S), ("email", _S), ("token", _S), ("status", _S), ("attempts", _I),
    ("last_attempt", _TS), ("external_id", _S), ("invalid_reason", _S), ("validation_details", _S),
    ("created_at", _TS), ("updated_at", _TS), ("next_attempt_at", _TS),
)
PROGRESS = _struct(
    ("mailing_id", _S), ("total_rows", _I), ("processed_rows", _I), ("last_processed_line", _I), ("status", _S),
    ("created_at", _TS), ("updated_at", _TS),
)
DEAD_LETTERS = _struct(
    ("id", _S), ("mailing_id", _S), ("email", _S), ("reason", _S), ("attempts", _I), ("last_error", _S),
    ("created_at", _TS), ("updated_at", _TS), ("kind", _S),
)
MAILINGS = _struct(
    ("id", _S), ("filename", _S), ("storage_url", _S), ("status", _S), ("attempts", _I), ("last_attempt", _TS),
    ("error_message", _S), ("total_lines", _I), ("processed_lines", _I), ("created_at", _TS), ("updated_at", _TS),
)
OUTBOX = _struct(
    ("id", _S), ("mailing_id", _S), ("target_queue", _S), ("payload", _S), ("attempts", _I), ("published", _B),
    ("published_at", _TS), ("last_error", _S), ("created_at", _TS), ("updated_at", _TS),
)
OUTBOX_DEAD_LETTERS = _struct(
    ("id", _S), ("mailing_id", _S), ("error", _S), ("attempts", _I), ("payload", _S), ("created_at", _TS),
)
TABLES = {
    "mailing_entries": ENTRIES,
    "mailing_progress": PROGRESS,
    "dead_letters": DEAD_LETTERS,
    "mailings": MAILINGS,
    "outbox_messages": OUTBOX,
    "outbox_dead_letters": OUTBOX_DEAD_LETTERS,
}

PAYLOAD = _struct(
    ("mailingId", _S), ("filename", _S), ("storageUrl", _S), ("attempt", _I), ("createdAt", _S),
    ("lastError", _S), ("retriedAt", _S), ("finalError", _S), ("movedToDLQAt", _S), ("totalAttempts", _I),
)
RESPONSE = _struct(
    ("message_id", _S), ("messageId", _S), ("id", _S), ("status", _S), ("timestamp", _S), ("message", _S), ("error", _S),
)
SEND_ATTEMPTS = _struct(
    ("mailing_id", _S), ("email", _S), ("attempt", _I), ("ts", _TS), ("http_status", _I), ("error", _S),
    ("message_id", _S), ("duration_s", _D),
)
EVENT_LOG = _struct(
    ("timestamp", _S), ("level", _S), ("service", _S), ("environment", _S), ("event", _S), ("mailingId", _S),
    ("email", _S), ("status", _S), ("attempts", _I), ("workerId", _S), ("http_status", _I), ("error_code", _S),
    ("duration", _D), ("error", _S), ("externalId", _S), ("reason", _S), ("valid", _B), ("filename", _S),
    ("totalRows", _L), ("processedRows", _L), ("percentage", _S), ("lastLine", _L), ("staleJobs", _L),
    ("staleMailings", _L), ("signal", _S), ("expiresAt", _S), ("message", _S),
)
METRICS = T.StructType([
    T.StructField("metric", _S),
    T.StructField("labels", T.MapType(_S, _S)),
    T.StructField("le", _S),
    T.StructField("value", _D),
])

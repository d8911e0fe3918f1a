"""Queue payloads and provider responses as JSON text."""

from pyspark.sql import Column, functions as F

from postmill import model

ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, ISO_MILLIS)


def job_payload(mailing_id, filename, storage_url, created_at) -> Column:
    """First message of a mailing; a missing storage URL stays as an explicit null."""
    fields = F.struct(
        mailing_id.cast("string").alias("mailingId"),
        filename.alias("filename"),
        storage_url.alias("storageUrl"),
        F.lit(0).alias("attempt"),
        iso_text(created_at).alias("createdAt"),
    )
    return F.to_json(fields, {"ignoreNullFields": "false"})


def field(payload: Column, name) -> Column:
    return F.get_json_object(payload, f"$.{name}")


def parsed(payload: Column) -> Column:
    return F.from_json(payload, model.PAYLOAD)


def _merged(payload: Column, **values) -> Column:
    """The payload's JSON object with some keys set; other keys stay as they are, null values are not set."""
    whole = F.from_json(payload, "map<string,variant>")
    given = F.map_from_entries(F.array(*[
        F.struct(F.lit(k).alias("key"), F.to_json(F.struct(value.alias("v"))).alias("value")) for k, value in values.items()]))
    # A null field leaves no key in its one-field object.
    given = F.map_filter(given, lambda k, v: v != "{}")
    given = F.transform_values(given, lambda k, v: F.variant_get(F.parse_json(v), "$.v", "variant"))
    kept = F.map_filter(whole, lambda k, v: ~F.map_contains_key(given, k))
    return F.to_json(F.map_concat(kept, given), {"ignoreNullFields": "false"})


def retry_payload(payload: Column, attempt: Column, error: Column, at: Column) -> Column:
    return _merged(payload, attempt=attempt.cast("int"), lastError=error, retriedAt=iso_text(at))


def dead_payload(payload: Column, error: Column, at: Column, attempts: Column) -> Column:
    return _merged(payload, finalError=error, movedToDLQAt=iso_text(at), totalAttempts=attempts.cast("int"))


def response(body: Column) -> Column:
    """The response fields that rules look at, parsed once; all null when the body is no JSON object."""
    return F.from_json(body, model.RESPONSE)


def _given(answer: Column, name) -> Column:
    return F.nullif(answer[name], F.lit(""))


def _ident(answer):
    return F.coalesce(_given(answer, "message_id"), _given(answer, "messageId"), _given(answer, "id"))


def message_id(answer: Column) -> Column:
    """Provider's message id under any of its names, else the response status. answer: see `response`."""
    return F.coalesce(_ident(answer), F.concat(F.lit("status:"), F.coalesce(answer["status"], F.lit("undefined"))))


def _as_json(body: Column) -> Column:
    """The body itself when it is JSON, else the text as a JSON string."""
    wrapped = F.to_json(F.struct(body.alias("v")))
    quoted = F.substr(wrapped, F.lit(6), F.length(wrapped) - F.lit(6))
    return F.when(F.try_parse_json(body).isNotNull(), body).otherwise(quoted)


def error_text(answer: Column, body: Column, transport: Column) -> Column:
    """Body message, body error, whole body, else the transport message."""
    whole = F.when(body != "", _as_json(body))
    return F.coalesce(_given(answer, "message"), _given(answer, "error"), whole, transport)


def safe_response(answer: Column) -> Column:
    """The only response fields a report may show."""
    return F.struct(_ident(answer).alias("messageId"), answer["status"].alias("status"),
                    answer["timestamp"].alias("timestamp"))


def safe_error(http_status: Column, status_text: Column, answer: Column) -> Column:
    return F.struct(
        http_status.alias("status"),
        status_text.alias("statusText"),
        F.coalesce(_given(answer, "error"), F.lit("Unknown error")).alias("error"),
    )

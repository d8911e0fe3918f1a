"""Send-error classification, retry decisions, back-off and job routing."""

from pyspark.sql import Column, functions as F

from postmill import constants as K


# The rules below name their inputs as seldom as they can: a filter on a rule's result is pushed through projections, and
# every mention repeats the whole expression behind the input in the generated code.


def _lookup(table, key: Column) -> Column:
    """Value of a constant table, null for other keys."""
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in table.items() for v in pair]), key)


def _hundreds(status: Column) -> Column:
    return F.floor(status / 100).cast("int")


def _no_answer(status: Column) -> Column:
    return F.coalesce(status, F.lit(0)) == 0


def _by_text(error: Column, network, timeout, other) -> Column:
    text = F.coalesce(error, F.lit(""))
    return (
        F.when(text.rlike("|".join(K.NETWORK_WORDS)), network).when(text.contains(K.TIMEOUT_WORD), timeout)
        .otherwise(F.lit(other))
    )


def error_category(status: Column, error: Column) -> Column:
    """Category of a failed send; status null or 0 means that no answer came."""
    by_code = F.coalesce(
        _lookup({408: "timeout", 429: "rate_limit"}, status),
        _lookup({4: "client_error", 5: "server_error"}, _hundreds(status)), F.lit("unknown"))
    return F.when(_no_answer(status), _by_text(error, "network", "timeout", "unknown")).otherwise(by_code)


def error_reason(status: Column, error: Column) -> Column:
    general = {2: " Success - not an error", 4: " Client Error - permanent failure",
               5: " Server Error - temporary failure"}
    rest = F.coalesce(_lookup(general, _hundreds(status)), F.lit(" Unknown status - will retry"))
    by_code = F.coalesce(
        _lookup(K.CLIENT_ERROR_TEXT | K.SERVER_ERROR_TEXT, status), F.concat(status.cast("string"), rest))
    no_answer = _by_text(error, K.TEXT_NETWORK, K.TEXT_TIMEOUT, K.TEXT_UNKNOWN)
    return F.when(_no_answer(status), no_answer).otherwise(by_code)


def is_retryable(status: Column) -> Column:
    """Client errors other than 408 and 429 are permanent; so is a success that was taken for an error."""
    code = F.coalesce(status, F.lit(0))
    return code.isin(408, 429) | ~_hundreds(code).isin(2, 4)


def classify_error(status: Column, error: Column) -> Column:
    """struct<retryable, category, reason> of a failed send."""
    return F.struct(
        is_retryable(status).alias("retryable"), error_category(status, error).alias("category"),
        error_reason(status, error).alias("reason"))


def backoff_ms(attempt: Column, base=K.BACKOFF_BASE_MS, cap=K.BACKOFF_CAP_MS) -> Column:
    """Doubling delay before the next try, capped."""
    doubled = F.lit(float(base)) * F.pow(F.lit(2.0), attempt - F.lit(1))
    return F.floor(F.least(doubled, F.lit(float(cap))) + F.lit(0.5)).cast("bigint")


def jittered_backoff_ms(
    attempt: Column, *row_key, base=K.BACKOFF_BASE_MS, cap=K.BACKOFF_CAP_MS, jitter=K.BACKOFF_JITTER_PERCENT
) -> Column:
    """Capped delay spread by +-jitter percent; the spread is a hash of the row key, so it repeats."""
    steps = 1 << 30
    unit = F.pmod(F.xxhash64(*row_key, attempt), F.lit(steps)) / F.lit(float(steps))
    delay = F.least(F.lit(float(base)) * F.pow(F.lit(2.0), attempt - F.lit(1)), F.lit(float(cap)))
    spread = (unit * 2 - 1) * delay * F.lit(jitter / 100.0)
    return F.greatest(F.floor(delay + spread + F.lit(0.5)), F.lit(0)).cast("bigint")


def decision_reason(attempt: Column, retryable: Column, why: Column, max_attempts=K.ENTRY_MAX_ATTEMPTS) -> Column:
    tries = F.concat(attempt.cast("string"), F.lit(f"/{max_attempts})"))
    return F.concat(
        F.when(~retryable, F.lit("Permanent error"))
        .when(attempt >= max_attempts, F.concat(F.lit("Max retries exceeded ("), tries))
        .otherwise(F.concat(F.lit("Retryable error (attempt "), tries)),
        F.lit(" - "), why,
    )


def retry_decision(attempt: Column, status: Column, error: Column, max_attempts=K.ENTRY_MAX_ATTEMPTS) -> Column:
    """struct<should_retry, reason, delay_ms, move_to_dlq> for one failed attempt (counted from 1)."""
    retryable = is_retryable(status)
    again = retryable & (attempt < max_attempts)
    return F.struct(
        again.alias("should_retry"),
        decision_reason(attempt, retryable, error_reason(status, error), max_attempts).alias("reason"),
        F.when(again, backoff_ms(attempt)).alias("delay_ms"), (~again).alias("move_to_dlq"),
    )


def job_queue(attempt: Column, max_attempts=K.JOB_MAX_ATTEMPTS) -> Column:
    """Queue for a failed job that ran with this attempt counter (counted from 0)."""
    following = attempt + F.lit(1)
    return (
        F.when(following >= max_attempts, K.QUEUE_DEAD)
        .when(following == 1, K.QUEUE_RETRY_1)
        .otherwise(K.QUEUE_RETRY_2)
    )


def job_wait_seconds(queue: Column) -> Column:
    """Time a job waits in its retry queue; null in the dead-letter queue."""
    return F.when(queue == K.QUEUE_RETRY_1, K.RETRY_1_SECONDS).when(queue == K.QUEUE_RETRY_2, K.RETRY_2_SECONDS)


def seconds_later(ts: Column, seconds: Column) -> Column:
    return ts + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))

"""Send outcomes: upserts, retries, dead letters and job routing."""

from pyspark.sql import DataFrame, functions as F

from postmill import constants as K
from postmill.functions import keys, payload, retry, texts
from postmill.operators.spread import last_per_key, running

KEY = ["mailing_id", "email"]


def _column(df, name, kind):
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def latest_outcomes(outcomes: DataFrame, order=("ts", "event_id")) -> DataFrame:
    """Last outcome per recipient and how many there were."""
    return last_per_key(outcomes, KEY, list(order), F.count("*").alias("tries"))


def numbered_attempts(attempts: DataFrame, order=("ts", "event_id"), **options) -> DataFrame:
    """Attempt number per recipient in time order."""
    return running(attempts, KEY, list(order), number="attempt_no", **options)


def _with(table, joined, changed):
    """The table's columns from `joined`, in their order, with the changed ones in place and new ones at the end."""
    kept = [F.col(c) for c in KEY] + [changed[c].alias(c) if c in changed else F.col(c) for c in table.columns if c not in KEY]
    return joined.select(*kept, *[c.alias(name) for name, c in changed.items() if name not in table.columns])


def upsert_outcomes(entries: DataFrame, outcomes: DataFrame, order=("ts", "event_id")) -> DataFrame:
    """Next entries after send outcomes (mailing_id, email, token, status, external_id, reason, ts, ...).

    The result is that of taking the outcomes one by one: a known recipient takes status and time of its last outcome and
    one more attempt per outcome; it keeps its token, and takes the last external id that an outcome has, if any. Reason
    and details stay only while the status is FAILED. An unknown recipient is inserted by its first outcome, which gives
    its token and creation time. Other columns of the entries stay. Both sides have one row per key when they meet.
    """
    at = F.struct(*order)
    folded = last_per_key(
        outcomes, KEY, list(order), F.count("*").alias("tries"), F.min_by("token", at).alias("first_token"),
        F.min_by("ts", at).alias("first_ts"),
        F.max_by("external_id", F.when(F.col("external_id").isNotNull(), at)).alias("last_external_id"))
    last = folded.select(
        *KEY, F.lit(True).alias("_hit"), F.col("status").alias("n_status"), F.col("first_token").alias("n_token"),
        F.col("first_ts").alias("n_first_ts"), F.col("last_external_id").alias("n_external_id"),
        F.col("reason").alias("n_reason"), F.col("ts").alias("n_ts"), "tries",
    )
    hit, new = F.coalesce("_hit", F.lit(False)), F.col("id").isNull()
    status, reason = F.col("n_status"), F.col("n_reason")
    same_id = F.col("id") if entries.schema["id"].dataType.simpleString() == "string" else F.col("id").cast("string")
    changed = {
        "id": F.coalesce(same_id, keys.row_id(F.lit("entry"), F.col("mailing_id"), F.col("email"))),
        "token": F.coalesce(_column(entries, "token", "string"), F.col("n_token")),
        "status": F.when(hit, status).otherwise(F.col("status")),
        "attempts": F.coalesce("attempts", F.lit(0)) + F.coalesce("tries", F.lit(0)).cast("int"),
        "last_attempt": F.when(hit, F.col("n_ts")).otherwise(F.col("last_attempt")),
        "external_id": F.coalesce(F.col("n_external_id"), _column(entries, "external_id", "string")),
        "invalid_reason": F.when(hit, texts.failure_reason(status, reason)).otherwise(
            _column(entries, "invalid_reason", "string")),
        "validation_details": F.when(hit, texts.failure_details(status, reason)).otherwise(
            _column(entries, "validation_details", "string")),
        "created_at": F.when(new, F.col("n_first_ts")).otherwise(F.col("created_at")),
        "updated_at": F.when(hit, F.col("n_ts")).otherwise(_column(entries, "updated_at", "timestamp_ntz")),
    }
    return _with(entries, entries.join(last, KEY, "full_outer"), changed)


def upsert_invalid(entries: DataFrame, rejected: DataFrame, as_of) -> DataFrame:
    """Next entries after rejected addresses (mailing_id, email, reason, details), whatever their status was.

    Columns that a rejection does not touch, such as external_id and next_attempt_at, stay.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    marks = rejected.groupBy(*KEY).agg(F.min(F.struct("reason", "details")).alias("_r")).select(
        *KEY, F.coalesce(F.nullif(F.col("_r.reason"), F.lit("")), F.lit("Unknown")).alias("n_reason"),
        F.to_json(F.struct(F.lit(False).alias("isValid"), F.col("_r.reason").alias("reason"),
                           F.col("_r.details").alias("details"))).alias("n_details"),
    )
    hit, new = F.col("n_reason").isNotNull(), F.col("id").isNull()
    changed = {
        "id": F.coalesce(F.col("id").cast("string"), keys.row_id(F.lit("entry"), F.col("mailing_id"), F.col("email"))),
        "token": F.when(new, "").otherwise(_column(entries, "token", "string")),
        "status": F.when(hit, "INVALID").otherwise(F.col("status")),
        "attempts": F.coalesce("attempts", F.lit(0)),
        "last_attempt": F.col("last_attempt"),
        "invalid_reason": F.when(hit, F.col("n_reason")).otherwise(_column(entries, "invalid_reason", "string")),
        "validation_details": F.when(hit, F.col("n_details")).otherwise(_column(entries, "validation_details", "string")),
        "created_at": F.when(new, now).otherwise(F.col("created_at")),
        "updated_at": F.when(hit, now).otherwise(_column(entries, "updated_at", "timestamp_ntz")),
    }
    return _with(entries, entries.join(marks, KEY, "full_outer"), changed)


def claim_entries(entries: DataFrame, claims: DataFrame) -> DataFrame:
    """Next entries after workers took them up (claims: mailing_id, email, attempt, ts): SENDING, with the number and time
    of the attempt. Entries that are already SENT stay; of several claims the one with the highest attempt counts.
    """
    taken = claims.groupBy(*KEY).agg(F.max(F.struct("attempt", "ts")).alias("_c"))
    hit = F.col("_c").isNotNull() & (F.col("status") != "SENT")
    return entries.join(taken, KEY, "left").withColumn("_hit", F.coalesce(hit, F.lit(False))).withColumns({
        "status": F.when(F.col("_hit"), "SENDING").otherwise(F.col("status")),
        "attempts": F.when(F.col("_hit"), F.col("_c.attempt").cast("int")).otherwise(F.col("attempts")),
        "last_attempt": F.when(F.col("_hit"), F.col("_c.ts")).otherwise(F.col("last_attempt")),
        "updated_at": F.when(F.col("_hit"), F.col("_c.ts")).otherwise(_column(entries, "updated_at", "timestamp_ntz")),
    }).drop("_c", "_hit")


def count_attempts(table: DataFrame, failures: DataFrame, on, order, error="error") -> DataFrame:
    """Add one attempt per failure row, with the time and text of the last one. failures: key, ts, error."""
    on = list(on)
    last = last_per_key(failures.select(*on, *dict.fromkeys(["ts", error, *order])), on, list(order),
                        F.count("*").alias("_tries"))
    last = last.select(*on, F.col("ts").alias("_ts"), F.col(error).alias("_error"), "_tries")
    hit = F.col("_tries").isNotNull()
    return table.join(last, on, "left").withColumns({
        "attempts": F.col("attempts") + F.coalesce("_tries", F.lit(0)).cast("int"),
        "last_attempt": F.when(hit, F.col("_ts")).otherwise(_column(table, "last_attempt", "timestamp_ntz")),
        "last_error": F.when(hit, F.col("_error")).otherwise(_column(table, "last_error", "string")),
    }).drop("_ts", "_error", "_tries")


def decided(attempts: DataFrame, max_attempts=K.ENTRY_MAX_ATTEMPTS, jitter_key=None) -> DataFrame:
    """Attempts with their classification and, for failed ones, the retry decision.

    columns used: attempt, http_status, error. With jitter_key (column names) the delay is spread by a hash of them.
    """
    status, error, attempt = F.col("http_status"), F.col("error"), F.col("attempt")
    if jitter_key:
        wait = retry.jittered_backoff_ms(attempt, *[F.col(k) for k in jitter_key])
    else:
        wait = retry.backoff_ms(attempt)
    failed, again = ~F.col("success"), F.col("should_retry")
    return attempts.withColumns({
        "success": F.coalesce(F.floor(status / 100) == 2, F.lit(False)),
        "retryable": retry.is_retryable(status),
        "category": retry.error_category(status, error),
        "class_reason": retry.error_reason(status, error),
    }).withColumn("should_retry", failed & F.col("retryable") & (attempt < max_attempts)).withColumns({
        "move_to_dlq": failed & ~again,
        "reason": F.when(
            failed, retry.decision_reason(attempt, F.col("retryable"), F.col("class_reason"), max_attempts)),
        "delay_ms": F.when(again, wait),
    })


def failure_step(failed: DataFrame, max_attempts=K.ENTRY_MAX_ATTEMPTS, jitter_key=None) -> DataFrame:
    """Next status of each failed attempt: PENDING with next_attempt_at, or FAILED; `reason` says why."""
    out = decided(failed, max_attempts, jitter_key).where(~F.col("success"))
    wait = F.col("delay_ms") / F.lit(1000)
    return out.withColumns({
        "next_status": F.when(F.col("should_retry"), "PENDING").otherwise("FAILED"),
        "next_attempt_at": F.when(F.col("should_retry"), retry.seconds_later(F.col("ts"), wait)),
    })


def dead_letters(stepped: DataFrame) -> DataFrame:
    """Dead-letter rows of failed attempts that will not be tried again."""
    return stepped.where(F.col("move_to_dlq")).select(
        keys.row_id(F.lit("dead"), F.col("mailing_id"), F.col("email"), F.col("attempt"), F.col("ts")).alias("id"),
        F.lit("entry").alias("kind"), "mailing_id", "email", "reason", F.col("attempt").alias("attempts"),
        texts.audit_text(F.col("http_status"), F.coalesce("error", F.lit("Unknown error"))).alias("last_error"),
        F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"),
    )


def apply_failures(entries: DataFrame, stepped: DataFrame, order=("ts", "event_id")) -> DataFrame:
    """Next entries: the last failure of a recipient sets its status and earliest next attempt; others keep theirs."""
    last = last_per_key(stepped.select(*KEY, *order, "next_status", "next_attempt_at", "attempt"), KEY, list(order))
    last = last.select(*KEY, "next_status", F.col("next_attempt_at").alias("_next"), F.col("attempt").alias("_attempt"),
                       F.col("ts").alias("_ts"))
    waits = F.when(F.col("next_status").isNotNull(), F.col("_next")).otherwise(
        _column(entries, "next_attempt_at", "timestamp_ntz"))
    return entries.join(last, KEY, "left").withColumns({
        "status": F.coalesce("next_status", "status"),
        "attempts": F.coalesce("_attempt", "attempts"),
        "last_attempt": F.coalesce("_ts", "last_attempt"),
        "next_attempt_at": waits,
    }).drop("_attempt", "_ts", "_next", "next_status")


def ready(entries: DataFrame, as_of) -> DataFrame:
    """Pending entries whose waiting time is over."""
    due = F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= F.lit(as_of).cast("timestamp_ntz"))
    return entries.where((F.col("status") == "PENDING") & due)


def job_step(jobs: DataFrame, max_attempts=K.JOB_MAX_ATTEMPTS) -> DataFrame:
    """Route failed jobs (mailing_id, filename, payload, attempt, ts, error) to a retry queue or the dead-letter queue."""
    queue = retry.job_queue(F.col("attempt"), max_attempts)
    dead = F.col("target_queue") == K.QUEUE_DEAD
    following = F.col("attempt") + F.lit(1)
    return jobs.withColumn("target_queue", queue).withColumns({
        "available_at": retry.seconds_later(F.col("ts"), retry.job_wait_seconds(F.col("target_queue"))),
        "status": F.lit("FAILED"),
        "attempts": F.when(dead, F.lit(max_attempts)).otherwise(following).cast("int"),
        "error_message": F.coalesce(
            "error", F.when(dead, K.JOB_DEAD_TEXT).otherwise(F.lit(K.JOB_RETRY_TEXT))),
        "next_payload": F.when(
            dead, payload.dead_payload(F.col("payload"), F.col("error"), F.col("ts"), F.lit(max_attempts))
        ).otherwise(payload.retry_payload(F.col("payload"), following, F.col("error"), F.col("ts"))),
    })


def job_dead_letters(stepped: DataFrame) -> DataFrame:
    """Dead-letter rows of jobs; the file name stands where an entry has its address."""
    return stepped.where(F.col("target_queue") == K.QUEUE_DEAD).select(
        keys.row_id(F.lit("dead-job"), F.col("mailing_id"), F.col("ts")).alias("id"), F.lit("job").alias("kind"),
        "mailing_id", F.col("filename").alias("email"),
        F.coalesce("error", F.lit(K.JOB_DEAD_TEXT)).alias("reason"), "attempts",
        F.coalesce("error", F.lit("Unknown error")).alias("last_error"),
        F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"),
    )


def failure_verdicts(counts: DataFrame, threshold=K.FAILURE_THRESHOLD) -> DataFrame:
    """Per mailing: share of failed rows and whether the job failed. counts: mailing_id, total, failed.

    The limit is strict, and a mailing without rows succeeds.
    """
    rate = F.try_divide(F.col("failed").cast("double"), F.col("total").cast("double"))
    over = F.coalesce(F.col("failure_rate") > threshold, F.lit(False))
    shown = F.round(F.col("failure_rate") * 100, 1)
    return counts.withColumn("failure_rate", rate).withColumn("job_failed", over).withColumn(
        "error", F.when(F.col("job_failed"), F.format_string("Failure rate %.1f%% exceeds threshold", shown)))


def finish_mailings(mailings: DataFrame, verdicts: DataFrame, as_of) -> DataFrame:
    """Mark judged mailings COMPLETED or FAILED (with message); both clear last_attempt."""
    now = F.lit(as_of).cast("timestamp_ntz")
    judged = verdicts.select(F.col("mailing_id").alias("id"), "job_failed", F.col("error").alias("_error"))
    hit = F.col("job_failed").isNotNull()
    return mailings.join(judged, "id", "left").withColumns({
        "status": F.when(F.col("job_failed"), "FAILED").when(hit, "COMPLETED").otherwise(F.col("status")),
        "error_message": F.when(F.col("job_failed"), F.col("_error")).otherwise(
            _column(mailings, "error_message", "string")),
        "last_attempt": F.when(~hit, _column(mailings, "last_attempt", "timestamp_ntz")),
        "updated_at": F.when(hit, now).otherwise(_column(mailings, "updated_at", "timestamp_ntz")),
    }).drop("job_failed", "_error")


def send_requests(entries: DataFrame, secret="postmill") -> DataFrame:
    """Messages to hand to a sender: address, texts with the token, and the attempt's stable key."""
    m, e, attempt = F.col("mailing_id"), F.col("email"), F.col("attempts") + F.lit(1)
    code = keys.alphanumeric_token(secret, m, e)
    return entries.select(
        "id", "mailing_id", F.col("email").alias("to"), attempt.alias("attempt"), code.alias("token"),
        texts.message_subject().alias("subject"), texts.message_body(code).alias("body"),
        keys.idempotency_key(m, e, attempt).alias("idempotency_key"),
    )

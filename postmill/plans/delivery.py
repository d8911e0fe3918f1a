"""Queries on send attempts: classification, retries, upserts, keys and audits."""

from pyspark.sql import functions as F

from postmill.functions import keys, payload, retry, texts
from postmill.operators import delivery as D, intake, lookups as L, recovery, reports as R
from postmill.operators.validate import validate
from postmill.plans import views as v
from postmill.plans.reading import DEAD, attempts_of, entries_of
from postmill.plans.registry import query
from postmill.plans.views import sql
from postmill.session import new_folder
from postmill.sources import tables


def outcomes_of(spark, sf_dir):
    return v.outcomes_from(v.table(spark, sf_dir, "events"))


def known_of(spark, sf_dir):
    return v.known_recipients_from(v.table(spark, sf_dir, "events"))


def jobs_of(spark, sf_dir):
    return v.job_failures_from(v.table(spark, sf_dir, "part"))


@query("idempotency_key", "P07", sql(v.SEND_ATTEMPTS, body="""
SELECT event_id, sha256(mailing_id || ':' || email || ':' || CAST(attempt AS VARCHAR)) AS idempotency_key
FROM send_attempts"""))
def idempotency_key(spark, sf_dir):
    key = keys.idempotency_key(F.col("mailing_id"), F.col("email"), F.col("attempt"))
    return attempts_of(spark, sf_dir).select("event_id", key.alias("idempotency_key"))


@query("salted_key", "P08", sql(v.SEND_ATTEMPTS, body="""
SELECT event_id, sha256(mailing_id || '-' || email || '-' || 'salt' || CAST(event_id AS VARCHAR)) AS salted_key
FROM send_attempts"""))
def salted_key(spark, sf_dir):
    rows = attempts_of(spark, sf_dir).withColumn("salt", F.concat(F.lit("salt"), F.col("event_id").cast("string")))
    return rows.select(
        "event_id", keys.salted_key(F.col("mailing_id"), F.col("email"), F.col("salt")).alias("salted_key"))


@query("rendered_messages", "P10", sql(v.ENTRIES, body="""
SELECT id, 'Complete your registration' AS subject,
 'Thank you for signing up. Please verify your token T' || CAST(id AS VARCHAR) || ' to continue.' AS body,
 'Your token: T' || CAST(id AS VARCHAR) AS pool_body FROM entries"""))
def rendered_messages(spark, sf_dir):
    token = F.concat(F.lit("T"), F.col("id").cast("string"))
    return entries_of(spark, sf_dir).select(
        "id", texts.message_subject().alias("subject"), texts.message_body(token).alias("body"),
        texts.pool_body(token).alias("pool_body"))


@query("send_requests", "P07 P10 F03", sql(v.ENTRIES, body="""
SELECT id, mailing_id, email AS "to", attempts + 1 AS attempt, 'Complete your registration' AS subject,
 sha256(mailing_id || ':' || email || ':' || CAST(attempts + 1 AS VARCHAR)) AS idempotency_key
FROM entries WHERE status = 'PENDING'"""))
def send_requests(spark, sf_dir):
    return D.send_requests(L.pending(entries_of(spark, sf_dir))).select(
        "id", "mailing_id", "to", "attempt", "subject", "idempotency_key")


@query("failure_reasons", "P14", sql(v.SEND_ATTEMPTS, v.OUTCOMES, body="""
SELECT event_id, CASE WHEN status = 'FAILED' THEN substr(reason, 1, 50) END AS invalid_reason,
 CASE WHEN status = 'FAILED' THEN '{"error":"' || reason || '"}' END AS validation_details FROM outcomes"""))
def failure_reasons(spark, sf_dir):
    status, reason = F.col("status"), F.col("reason")
    return outcomes_of(spark, sf_dir).select(
        "event_id", texts.failure_reason(status, reason).alias("invalid_reason"),
        texts.failure_details(status, reason).alias("validation_details"))


@query("classify", "P21", sql(v.SEND_ATTEMPTS, v.CLASSIFIED, body="""
SELECT event_id, retryable, category, class_reason FROM classified"""))
def classify(spark, sf_dir):
    verdict = retry.classify_error(F.col("http_status"), F.col("error")).alias("v")
    return attempts_of(spark, sf_dir).select("event_id", verdict).select(
        "event_id", "v.retryable", "v.category", F.col("v.reason").alias("class_reason"))


@query("retry_decision", "P22", sql(v.SEND_ATTEMPTS, v.CLASSIFIED, body="""
SELECT event_id, attempt, should_retry, move_to_dlq, reason, delay_ms FROM decided"""))
def retry_decision(spark, sf_dir):
    return D.decided(attempts_of(spark, sf_dir)).select(
        "event_id", "attempt", "should_retry", "move_to_dlq", "reason", "delay_ms")


@query("backoff_base", "P23", sql(v.SEND_ATTEMPTS, body="""
SELECT event_id, CAST(least(1000 * pow(2, event_id % 12), 300000) AS BIGINT) AS delay_ms FROM send_attempts"""))
def backoff_base(spark, sf_dir):
    tries = (F.col("event_id") % 12 + 1).cast("int")
    return attempts_of(spark, sf_dir).select("event_id", retry.backoff_ms(tries).alias("delay_ms"))


@query("backoff_jitter", "P23", sql(v.SEND_ATTEMPTS, body="""
SELECT event_id, true AS within_bounds FROM send_attempts"""))
def backoff_jitter(spark, sf_dir):
    tries = (F.col("event_id") % 12 + 1).cast("int")
    base = retry.backoff_ms(tries)
    spread = retry.jittered_backoff_ms(tries, F.col("event_id"))
    return attempts_of(spark, sf_dir).select("event_id", F.abs(spread - base).alias("d"), base.alias("b")).select(
        "event_id", (F.col("d") <= F.col("b") * 0.2 + 1).alias("within_bounds"))


@query("job_routing", "P24", sql(v.JOB_FAILURES, body="""
SELECT mailing_id, CASE WHEN attempt + 1 >= 3 THEN 'mailing.jobs.dlq' WHEN attempt = 0 THEN 'mailing.jobs.retry.1'
 ELSE 'mailing.jobs.retry.2' END AS target_queue, CASE WHEN attempt + 1 >= 3 THEN NULL
 WHEN attempt = 0 THEN ts + INTERVAL '60' SECOND ELSE ts + INTERVAL '300' SECOND END AS available_at
FROM job_failures"""))
def job_routing(spark, sf_dir):
    return D.job_step(jobs_of(spark, sf_dir)).select("mailing_id", "target_queue", "available_at")


@query("job_step", "T09", sql(v.JOB_FAILURES, body="""
SELECT mailing_id, 'FAILED' AS status, least(attempt + 1, 3) AS attempts,
 coalesce(error, CASE WHEN attempt >= 2 THEN 'Max retry attempts exceeded' ELSE 'Processing failed, will retry' END)
 AS error_message FROM job_failures"""))
def job_step(spark, sf_dir):
    return D.job_step(jobs_of(spark, sf_dir)).select("mailing_id", "status", "attempts", "error_message")


@query("job_dead_letters", "T09", sql(v.JOB_FAILURES, body="""
SELECT 'job' AS kind, mailing_id, filename AS email, coalesce(error, 'Max retry attempts exceeded') AS reason,
 3 AS attempts, coalesce(error, 'Unknown error') AS last_error, ts AS created_at FROM job_failures WHERE attempt >= 2"""))
def job_dead_letters(spark, sf_dir):
    return D.job_dead_letters(D.job_step(jobs_of(spark, sf_dir))).select(
        "kind", "mailing_id", "email", "reason", "attempts", "last_error", "created_at")


@query("payload_updates", "P13", sql(v.JOB_FAILURES, body="""
SELECT mailing_id, filename, CASE WHEN attempt >= 2 THEN attempt ELSE attempt + 1 END AS attempt,
 CASE WHEN attempt < 2 THEN error END AS last_error,
 CASE WHEN attempt < 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.000Z' END AS retried_at,
 CASE WHEN attempt >= 2 THEN error END AS final_error,
 CASE WHEN attempt >= 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.000Z' END AS moved_at,
 CASE WHEN attempt >= 2 THEN 3 END AS total_attempts FROM job_failures"""))
def payload_updates(spark, sf_dir):
    p = payload.parsed(F.col("next_payload")).alias("p")
    return D.job_step(jobs_of(spark, sf_dir)).select(p).select(
        F.col("p.mailingId").alias("mailing_id"), F.col("p.filename").alias("filename"),
        F.col("p.attempt").alias("attempt"), F.col("p.lastError").alias("last_error"),
        F.col("p.retriedAt").alias("retried_at"), F.col("p.finalError").alias("final_error"),
        F.col("p.movedToDLQAt").alias("moved_at"), F.col("p.totalAttempts").alias("total_attempts"))


@query("retry_split", "T08", sql(v.SEND_ATTEMPTS, v.CLASSIFIED, body="""
SELECT event_id, mailing_id, email, CASE WHEN should_retry THEN 'PENDING' ELSE 'FAILED' END AS next_status,
 CASE WHEN should_retry THEN ts + (delay_ms // 1000) * INTERVAL '1' SECOND END AS next_attempt_at
FROM decided WHERE NOT success"""))
def retry_split(spark, sf_dir):
    return D.failure_step(attempts_of(spark, sf_dir)).select(
        "event_id", "mailing_id", "email", "next_status", "next_attempt_at")


@query("dead_letters", "T08 P25", sql(v.SEND_ATTEMPTS, v.CLASSIFIED, DEAD, body="""
SELECT kind, mailing_id, email, reason, attempts, last_error, created_at FROM dead"""))
def dead_letters(spark, sf_dir):
    return D.dead_letters(D.failure_step(attempts_of(spark, sf_dir))).select(
        "kind", "mailing_id", "email", "reason", "attempts", "last_error", "created_at")


@query("apply_failures", "T08", sql(v.SEND_ATTEMPTS, v.CLASSIFIED, v.KNOWN, body="""
SELECT k.id, k.mailing_id, k.email,
 coalesce(CASE WHEN f.should_retry THEN 'PENDING' WHEN f.event_id IS NOT NULL THEN 'FAILED' END, k.status) AS status,
 coalesce(f.attempt, k.attempts) AS attempts, coalesce(f.ts, k.last_attempt) AS last_attempt,
 CASE WHEN f.should_retry THEN f.ts + (f.delay_ms // 1000) * INTERVAL '1' SECOND END AS next_attempt_at
FROM known k LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY mailing_id, email ORDER BY ts DESC, event_id DESC)
 AS rn FROM decided WHERE NOT success) f ON f.mailing_id = k.mailing_id AND f.email = k.email AND f.rn = 1"""))
def apply_failures(spark, sf_dir):
    stepped = D.failure_step(attempts_of(spark, sf_dir))
    return D.apply_failures(known_of(spark, sf_dir), stepped).select(
        "id", "mailing_id", "email", "status", "attempts", "last_attempt", "next_attempt_at")


@query("latest_outcomes", "W02", sql(v.SEND_ATTEMPTS, v.OUTCOMES, body="""
SELECT mailing_id, email, event_id, status, external_id, tries FROM
 (SELECT *, row_number() OVER (PARTITION BY mailing_id, email ORDER BY ts DESC, event_id DESC) AS rn,
  count(*) OVER (PARTITION BY mailing_id, email) AS tries FROM outcomes) WHERE rn = 1"""))
def latest_outcomes(spark, sf_dir):
    return D.latest_outcomes(outcomes_of(spark, sf_dir)).select(
        "mailing_id", "email", "event_id", "status", "external_id", "tries")


@query("attempt_numbers", "W03", sql(v.SEND_ATTEMPTS, body="""
SELECT event_id, row_number() OVER (PARTITION BY mailing_id, email ORDER BY ts, event_id) AS attempt_no
FROM send_attempts"""))
def attempt_numbers(spark, sf_dir):
    rows = attempts_of(spark, sf_dir).select("event_id", "ts", "mailing_id", "email")
    return D.numbered_attempts(rows).select("event_id", "attempt_no")


UPSERT = """
SELECT coalesce(k.mailing_id, n.mailing_id) AS mailing_id, coalesce(k.email, n.email) AS email,
 coalesce(k.token, n.first_token) AS token, coalesce(n.status, k.status) AS status,
 CAST(coalesce(k.attempts, 0) + coalesce(n.tries, 0) AS INT) AS attempts, coalesce(n.ts, k.last_attempt) AS last_attempt,
 coalesce(n.any_external_id, k.external_id) AS external_id,
 CASE WHEN n.email IS NULL THEN k.invalid_reason WHEN n.status = 'FAILED' THEN substr(n.reason, 1, 50) END
 AS invalid_reason, CASE WHEN n.status = 'FAILED' THEN '{"error":"' || n.reason || '"}' END AS validation_details,
 coalesce(k.created_at, n.first_ts) AS created_at, coalesce(n.ts, k.created_at) AS updated_at
FROM known k FULL JOIN (SELECT *, row_number() OVER (w ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER w AS tries,
  first(token) OVER (w ORDER BY ts, event_id) AS first_token, first(ts) OVER (w ORDER BY ts, event_id) AS first_ts,
  last(external_id IGNORE NULLS) OVER (w ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
  AS any_external_id FROM outcomes WINDOW w AS (PARTITION BY mailing_id, email) QUALIFY rn = 1) n
 ON n.mailing_id = k.mailing_id AND n.email = k.email"""


@query("upsert_outcomes", "T02 J10 W02", sql(v.SEND_ATTEMPTS, v.OUTCOMES, v.KNOWN, body=UPSERT))
def upsert_outcomes(spark, sf_dir):
    out = D.upsert_outcomes(known_of(spark, sf_dir), outcomes_of(spark, sf_dir))
    return out.select("mailing_id", "email", "token", "status", "attempts", "last_attempt", "external_id",
                      "invalid_reason", "validation_details", "created_at", "updated_at")


SOME = "('m3', 'm6', 'm9')"


@query("change_stored", "T02 T14 S07", sql(v.SEND_ATTEMPTS, v.OUTCOMES, v.KNOWN, body=f"""
SELECT mailing_id, email, token, status, attempts, last_attempt, external_id, invalid_reason FROM (
{UPSERT.replace("FROM outcomes WINDOW", f"FROM outcomes WHERE mailing_id IN {SOME} WINDOW")}) WHERE mailing_id <> 'm0'"""))
def change_stored(spark, sf_dir):
    """Stored entries changed folder by folder: all known ones, then the outcomes of three mailings, then one mailing removed."""
    path, name = new_folder(spark, "changes"), "mailing_entries"
    tables.change(known_of(spark, sf_dir), path, name, lambda _, known: known, "load")
    outcomes = outcomes_of(spark, sf_dir).where(F.col("mailing_id").isin("m3", "m6", "m9"))
    tables.change(outcomes, path, name, D.upsert_outcomes, "outcomes")
    gone = spark.createDataFrame([("m0",)], "mailing_id string")
    tables.change(gone, path, name, lambda rows, ids: recovery.purge(ids, mailing_entries=rows)["mailing_entries"], "removal")
    return tables.current(spark, path, name).select(
        "mailing_id", "email", "token", "status", "attempts", "last_attempt", "external_id", "invalid_reason")


@query("claim_entries", "T15", sql(v.SEND_ATTEMPTS, v.KNOWN, body="""
SELECT k.id, k.mailing_id, k.email, CASE WHEN c.attempt IS NOT NULL THEN 'SENDING' ELSE k.status END AS status,
 CAST(coalesce(c.attempt, k.attempts) AS INT) AS attempts, coalesce(c.ts, k.last_attempt) AS last_attempt
FROM known k LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY mailing_id, email ORDER BY attempt DESC, ts DESC) AS rn
 FROM send_attempts WHERE event_id % 3 = 0) c ON c.mailing_id = k.mailing_id AND c.email = k.email AND c.rn = 1"""))
def claim_entries(spark, sf_dir):
    """Entries that workers took up for an attempt."""
    claims = attempts_of(spark, sf_dir).where(F.col("event_id") % 3 == 0)
    return D.claim_entries(known_of(spark, sf_dir), claims).select(
        "id", "mailing_id", "email", "status", "attempts", "last_attempt")


@query("store_roundtrip", "T08 S07", sql(v.SEND_ATTEMPTS, v.CLASSIFIED, v.KNOWN, body="""
SELECT k.mailing_id, k.email, k.external_id,
 coalesce(CASE WHEN f.should_retry THEN 'PENDING' WHEN f.event_id IS NOT NULL THEN 'FAILED' END, k.status) AS status,
 CASE WHEN f.should_retry THEN f.ts + (f.delay_ms // 1000) * INTERVAL '1' SECOND END AS next_attempt_at,
 f.should_retry IS NOT NULL AND f.should_retry
  AND f.ts + (f.delay_ms // 1000) * INTERVAL '1' SECOND <= TIMESTAMP '2024-01-15 12:00:00' AS ready
FROM known k LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY mailing_id, email ORDER BY ts DESC, event_id DESC)
 AS rn FROM decided WHERE NOT success) f ON f.mailing_id = k.mailing_id AND f.email = k.email AND f.rn = 1"""))
def store_roundtrip(spark, sf_dir):
    """Failures applied twice with the entries stored in between, then what is ready at a given time."""
    path, stepped = new_folder(spark, "roundtrip"), D.failure_step(attempts_of(spark, sf_dir))
    tables.append(D.apply_failures(known_of(spark, sf_dir), stepped), path, "mailing_entries")
    again = D.apply_failures(tables.read_table(spark, path, "mailing_entries").drop("bucket"), stepped)
    second = new_folder(spark, "roundtrip")
    tables.append(again, second, "mailing_entries")
    stored = tables.read_table(spark, second, "mailing_entries")
    due = D.ready(stored, "2024-01-15 12:00:00").select("mailing_id", "email", F.lit(True).alias("ready"))
    return stored.join(due, ["mailing_id", "email"], "left").select(
        "mailing_id", "email", "external_id", "status", "next_attempt_at", F.coalesce("ready", F.lit(False)).alias("ready"))


STORED_AND_BAD = """stored AS (SELECT mailing_id, email, min(line_no) AS id FROM checked WHERE email <> '' AND line_no % 3 = 0
 GROUP BY mailing_id, email),
bad AS (SELECT mailing_id, email, min(reason) AS reason, min(details) AS details FROM checked
 WHERE email <> '' AND NOT is_valid GROUP BY mailing_id, email)"""


@query("upsert_invalid", "T03", sql(v.CHECKED, STORED_AND_BAD, body="""
SELECT coalesce(s.mailing_id, b.mailing_id) AS mailing_id, coalesce(s.email, b.email) AS email,
 CASE WHEN s.id IS NULL THEN '' ELSE 'tok' END AS token,
 CASE WHEN b.email IS NOT NULL THEN 'INVALID' ELSE 'SENT' END AS status, b.reason AS invalid_reason,
 '{"isValid":false,"reason":"' || b.reason || '","details":"' || b.details || '"}' AS validation_details
FROM stored s FULL JOIN bad b ON s.mailing_id = b.mailing_id AND s.email = b.email"""))
def upsert_invalid(spark, sf_dir):
    rows = intake.normalized(v.mail_rows_from(v.table(spark, sf_dir, "orders"))).where(F.col("email") != "")
    stored = rows.where(F.col("line_no") % 3 == 0).groupBy("mailing_id", "email").agg(
        F.min("line_no").cast("string").alias("id")).select(
        "*", F.lit("tok").alias("token"), F.lit("SENT").alias("status"), F.lit(1).alias("attempts"),
        F.lit(v.AS_OF).cast("timestamp_ntz").alias("last_attempt"), F.lit(v.AS_OF).cast("timestamp_ntz").alias("created_at"))
    bad = validate(rows, v.disposable(spark)).where(~F.col("is_valid"))
    return D.upsert_invalid(stored, bad, v.AS_OF).select(
        "mailing_id", "email", "token", "status", "invalid_reason", "validation_details")


@query("already_sent_guard", "F11", sql(v.ENTRIES, body="""
SELECT id, mailing_id FROM entries WHERE status <> 'SENT'"""))
def already_sent_guard(spark, sf_dir):
    entries = entries_of(spark, sf_dir)
    return L.not_sent(entries.select("id", "mailing_id"), entries)


COUNTS = """counts AS (SELECT mailing_id, count(*) AS total, count(*) FILTER (WHERE NOT success) AS failed FROM classified
 GROUP BY mailing_id)"""


def _failure_counts(spark, sf_dir):
    return D.decided(attempts_of(spark, sf_dir)).groupBy("mailing_id").agg(
        F.count("*").alias("total"), F.count_if(~F.col("success")).alias("failed"))


@query("failure_verdict", "A07", sql(v.SEND_ATTEMPTS, v.CLASSIFIED, COUNTS, body="""
SELECT mailing_id, total, failed, CAST(failed AS DOUBLE) / total AS failure_rate,
 CAST(failed AS DOUBLE) / total > 0.2 AS job_failed FROM counts"""))
def failure_verdict(spark, sf_dir):
    return D.failure_verdicts(_failure_counts(spark, sf_dir)).select(
        "mailing_id", "total", "failed", "failure_rate", "job_failed")


@query("finish_mailings", "T05 A07", sql(v.LIFECYCLE, body=f"""
SELECT id, CASE WHEN total_lines IS NULL THEN status WHEN CAST(total_lines - processed_lines AS DOUBLE) / total_lines > 0.2
  THEN 'FAILED' ELSE 'COMPLETED' END AS status,
 CASE WHEN CAST(total_lines - processed_lines AS DOUBLE) / total_lines > 0.2
  THEN 'Failure rate ' || CAST(CAST(round(100.0 * (total_lines - processed_lines) / total_lines, 1) AS DECIMAL(5,1))
   AS VARCHAR) || '% exceeds threshold' END AS error_message, CAST(NULL AS TIMESTAMP) AS last_attempt,
 {v.AS_OF_2024_SQL} AS updated_at FROM lifecycle"""))
def finish_mailings(spark, sf_dir):
    mailings = v.lifecycle_from(v.table(spark, sf_dir, "part"))
    counts = mailings.select(F.col("id").alias("mailing_id"), F.col("total_lines").alias("total"),
                             (F.col("total_lines") - F.col("processed_lines")).alias("failed"))
    return D.finish_mailings(mailings, D.failure_verdicts(counts), v.AS_OF_2024).select(
        "id", "status", "error_message", "last_attempt", "updated_at")


@query("count_attempts", "T06", sql(v.ENTRIES, v.SEND_ATTEMPTS, v.CLASSIFIED, v.KNOWN, body="""
SELECT k.id, k.mailing_id, k.email, CAST(k.attempts + coalesce(f.n, 0) AS INT) AS attempts,
 coalesce(f.ts, k.last_attempt) AS last_attempt, f.error AS last_error
FROM known k LEFT JOIN (SELECT mailing_id, email, ts, error, count(*) OVER (PARTITION BY mailing_id, email) AS n,
 row_number() OVER (PARTITION BY mailing_id, email ORDER BY ts DESC, event_id DESC) AS rn
 FROM classified WHERE NOT success QUALIFY rn = 1) f ON f.mailing_id = k.mailing_id AND f.email = k.email"""))
def count_attempts(spark, sf_dir):
    failed = D.decided(attempts_of(spark, sf_dir)).where(~F.col("success"))
    return D.count_attempts(known_of(spark, sf_dir), failed, ["mailing_id", "email"], ["ts", "event_id"]).select(
        "id", "mailing_id", "email", "attempts", "last_attempt", "last_error")


@query("worker_totals", "A14", sql(v.SEND_ATTEMPTS, v.CLASSIFIED, body="""
SELECT count(*) AS total_jobs, count(*) FILTER (WHERE success) AS completed_jobs, count(*) FILTER (WHERE NOT success) AS failed_jobs,
 count(*) FILTER (WHERE should_retry) AS retried_jobs, count(*) FILTER (WHERE move_to_dlq) AS dead_letter_jobs, max(ts) AS last_processed_at
FROM decided"""))
def worker_totals(spark, sf_dir):
    return R.worker_totals(D.decided(attempts_of(spark, sf_dir)))


@query("status_code_counts", "A15", sql(v.SEND_ATTEMPTS, body="""
SELECT coalesce(http_status, 0) AS status_code, count(*) AS requests, max(ts) AS last_at FROM send_attempts GROUP BY 1"""))
def status_code_counts(spark, sf_dir):
    return R.requests_by_code(attempts_of(spark, sf_dir))


@query("provider_totals", "A15", sql(v.SEND_ATTEMPTS, body="""
SELECT count(*) AS total_requests, count(*) FILTER (WHERE http_status BETWEEN 200 AND 299) AS successful_requests,
 count(*) - count(*) FILTER (WHERE http_status BETWEEN 200 AND 299) AS failed_requests, max(ts) AS last_request_at,
 (SELECT string_agg(c || '=' || n, ',' ORDER BY c) FROM (SELECT CAST(coalesce(http_status, 0) AS VARCHAR) AS c,
  CAST(count(*) AS VARCHAR) AS n FROM send_attempts GROUP BY 1)) AS by_code FROM send_attempts"""))
def provider_totals(spark, sf_dir):
    out = R.provider_totals(attempts_of(spark, sf_dir))
    pairs = F.transform(F.map_entries("requests_by_status_code"),
                        lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string")))
    return out.select("total_requests", "successful_requests", "failed_requests", "last_request_at",
                      F.array_join(F.array_sort(pairs), ",").alias("by_code"))


@query("token_audit", "A20", sql(v.ENTRIES, body="""
SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS distinct_tokens, count(*) FILTER (WHERE n > 1) AS duplicated_tokens FROM
 (SELECT substr(sha256('t' || CAST(id AS VARCHAR)), 1, 4) AS token, count(*) AS n FROM entries GROUP BY 1)"""))
def token_audit(spark, sf_dir):
    short = F.substring(F.sha2(F.concat(F.lit("t"), F.col("id").cast("string")), 256), 1, 4)
    return R.token_audit(entries_of(spark, sf_dir).select(short.alias("token")))


@query("token_collisions", "A20 P09", sql(v.ENTRIES, body="""
SELECT count(*) AS total, count(*) AS distinct_tokens, CAST(0 AS BIGINT) AS duplicated_tokens FROM entries"""))
def token_collisions(spark, sf_dir):
    tokens = entries_of(spark, sf_dir).select(
        keys.hex_token("postmill", F.col("mailing_id"), F.col("email")).alias("token"))
    return R.token_audit(tokens)

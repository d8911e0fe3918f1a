"""Queries on the event log, metric series, send schedule and rates."""

from pyspark.sql import functions as F

from postmill import constants as K
from postmill.functions import texts
from postmill.operators import delivery as D, intake, lookups as L, reports as R, schedule as S, series as M
from postmill.operators.validate import validate
from postmill.plans import views as v
from postmill.plans.reading import attempts_of, entries_of, mailings_of, progress_of
from postmill.plans.registry import query
from postmill.plans.validation import rows_of
from postmill.plans.views import AS_OF_2024_SQL, AS_OF_SQL, sql
from postmill.session import new_folder
from postmill.sources import messages


def decided_of(spark, sf_dir):
    return D.decided(attempts_of(spark, sf_dir))


LOG = """log_rows AS (SELECT CASE WHEN success THEN 'email.sent' WHEN should_retry THEN 'email.failed'
  ELSE 'email.dead_letter' END AS event, CASE WHEN success THEN 'info' WHEN should_retry THEN 'warn' ELSE 'error' END
  AS level, mailing_id, email, attempt, http_status, ts, CASE WHEN success THEN 'Email sent successfully to ' || email
  WHEN should_retry THEN 'Email failed: ' || email || ' (attempt ' || CAST(attempt AS VARCHAR) || ') - '
   || coalesce(error, class_reason)
  ELSE 'Email moved to dead letter queue: ' || email || ' - ' || coalesce(error, class_reason) END AS message
 FROM decided)"""


@query("event_log", "S11", sql(v.SEND_ATTEMPTS, v.CLASSIFIED, LOG, body="""
SELECT event, level, mailing_id, email, attempt AS attempts, http_status,
 strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(CAST(floor(epoch_us(ts) / 1000) AS BIGINT) % 1000 AS VARCHAR), 3, '0')
 || 'Z' AS "timestamp", message FROM log_rows"""))
def event_log(spark, sf_dir):
    """Decided attempts written as JSON lines and read back."""
    path = new_folder(spark, "log")
    messages.write_log(messages.log_events(decided_of(spark, sf_dir)), path)
    log = messages.known_events(messages.read_log(spark, path))
    return log.select("event", "level", F.col("mailingId").alias("mailing_id"), "email", "attempts", "http_status",
                      "timestamp", "message")


@query("event_counts", "S11 A16", sql(v.SEND_ATTEMPTS, v.CLASSIFIED, LOG, body="""
SELECT event, level, count(*) AS count FROM log_rows GROUP BY event, level"""))
def event_counts(spark, sf_dir):
    return R.group_counts(messages.log_events(decided_of(spark, sf_dir)), "event", "level")


@query("counters", "A16", sql(v.SEND_ATTEMPTS, v.CLASSIFIED, v.CHECKED, v.LIFECYCLE, v.PROGRESS, body=f"""
SELECT 'mailing_emails_total' AS metric, CASE WHEN is_valid THEN 'VALID' ELSE 'INVALID' END AS label,
 CAST(count(*) AS DOUBLE) AS value FROM checked GROUP BY is_valid UNION ALL
SELECT 'mailing_api_requests_total', 'POST /send-email ' || CAST(coalesce(http_status, 0) AS VARCHAR),
 CAST(count(*) AS DOUBLE) FROM decided GROUP BY http_status UNION ALL
SELECT 'mailing_retries_total', class_reason, CAST(count(*) AS DOUBLE) FROM decided WHERE NOT success
 GROUP BY class_reason UNION ALL
SELECT 'token_renewals_total', CASE WHEN http_status = 401 THEN 'FAILED' ELSE 'SUCCESS' END, CAST(count(*) AS DOUBLE)
 FROM decided WHERE http_status IN (200, 401) GROUP BY 2 UNION ALL
SELECT 'mailing_crash_recoveries_total', source, CAST(sum(found) AS DOUBLE) FROM (
 SELECT 'mailing' AS source, count(*) FILTER (WHERE status = 'PROCESSING' AND updated_at < {AS_OF_2024_SQL} - INTERVAL '300' SECOND)
  AS found FROM lifecycle UNION ALL
 SELECT 'mailing', count(*) FILTER (WHERE status = 'RUNNING' AND updated_at < {AS_OF_2024_SQL} - INTERVAL '300' SECOND) FROM progress)
GROUP BY source"""))
def counters(spark, sf_dir):
    from postmill.plans.recovery import lifecycle_of

    decided = decided_of(spark, sf_dir)
    checked = validate(intake.normalized(rows_of(spark, sf_dir)), v.disposable(spark), raw="raw_email").select(
        F.when(F.col("is_valid"), "VALID").otherwise("INVALID").alias("status"))
    status = F.col("http_status")
    sends = M.counters(
        decided,
        (K.METRIC_API, F.concat_ws(" ", F.lit("POST"), F.lit("/send-email"), F.coalesce(status, F.lit(0)).cast("string")), None),
        (K.METRIC_RETRIES, F.col("class_reason"), ~F.col("success")),
        (K.METRIC_RENEWALS, F.when(status == 401, "FAILED").otherwise("SUCCESS"), status.isin(200, 401)))
    # A recovery run adds its count even when it found nothing.
    stale = L.stale_work(lifecycle_of(spark, sf_dir), progress_of(spark, sf_dir), v.AS_OF_2024).agg(
        F.count("*").alias("found")).select(F.lit("mailing").alias("type"), "found")
    parts = [
        M.counter(checked, K.METRIC_EMAILS, ["status"]).withColumnRenamed("status", "label"),
        sends,
        M.counter(stale, K.METRIC_RECOVERIES, ["type"], F.col("found")).withColumnRenamed("type", "label"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _histogram_sql(metric, label, value, bounds, source):
    rows = [
        f"SELECT '{metric}' AS metric, {label} AS label, '{b:g}' AS le, CAST(count(*) FILTER (WHERE {value} <= {b}) AS DOUBLE) AS value"
        f" FROM {source} GROUP BY 2" for b in bounds]
    rows += [
        f"SELECT '{metric}', {label}, '{name}', round(CAST({agg} AS DOUBLE), 3) FROM {source} GROUP BY 2"
        for name, agg in (("+Inf", "count(*)"), ("count", "count(*)"), ("sum", f"sum({value})"))]
    return " UNION ALL ".join(rows)


OK_LABEL = "CASE WHEN success THEN 'SENT' ELSE 'FAILED' END"


@query("histogram_le", "A17", sql(v.SEND_ATTEMPTS, v.CLASSIFIED, v.MAILINGS, body=" UNION ALL ".join((
    _histogram_sql(K.METRIC_SEND_SECONDS, OK_LABEL, "duration_s", K.SEND_BOUNDS, "decided"),
    _histogram_sql(K.METRIC_API_SECONDS, "CAST(coalesce(http_status, 0) AS VARCHAR)", "duration_s", K.API_BOUNDS,
                   "decided"),
    _histogram_sql(K.METRIC_CSV_SECONDS, "status", "CAST(total_lines AS DOUBLE)", K.CSV_BOUNDS, "mailings")))))
def histogram_le(spark, sf_dir):
    decided = decided_of(spark, sf_dir).select(
        F.when(F.col("success"), "SENT").otherwise("FAILED").alias("status"), "duration_s",
        F.coalesce("http_status", F.lit(0)).cast("string").alias("status_code"))
    loads = mailings_of(spark, sf_dir).select("status", F.col("total_lines").cast("double").alias("seconds"))
    parts = [
        M.histogram(decided, K.METRIC_SEND_SECONDS, ["status"], "duration_s", K.SEND_BOUNDS),
        M.histogram(decided, K.METRIC_API_SECONDS, ["status_code"], "duration_s", K.API_BOUNDS).withColumnRenamed(
            "status_code", "status"),
        M.histogram(loads, K.METRIC_CSV_SECONDS, ["status"], "seconds", K.CSV_BOUNDS),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("metric", F.col("status").alias("label"), "le", F.round("value", 3).alias("value"))


@query("gauges_latest", "A18", sql(v.SEND_ATTEMPTS, v.PROGRESS, body="""
SELECT 'mailing_queue_size' AS metric, mailing_id AS label, duration_s AS value FROM
 (SELECT *, row_number() OVER (PARTITION BY mailing_id ORDER BY ts DESC, event_id DESC) AS rn FROM send_attempts)
WHERE rn = 1 UNION ALL
SELECT 'mailing_progress_percentage', mailing_id, CASE WHEN total_rows > 0
 THEN CAST(round(100.0 * processed_rows / total_rows, 2) AS DOUBLE) ELSE 0.0 END FROM progress WHERE status IN ('RUNNING', 'PAUSED')
UNION ALL
SELECT 'mailing_active_workers', NULL, CAST(attempt AS DOUBLE) FROM
 (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn FROM send_attempts) WHERE rn = 1"""))
def gauges_latest(spark, sf_dir):
    readings = attempts_of(spark, sf_dir).withColumn("worker_count", F.col("attempt").cast("double"))
    queue = M.gauge(readings, K.METRIC_QUEUE, ["mailing_id"], "duration_s").select(
        "metric", F.col("mailing_id").alias("label"), "value")
    workers = M.gauge(readings, K.METRIC_WORKERS, [], "worker_count").select(
        "metric", F.lit(None).cast("string").alias("label"), "value")
    ongoing = L.active_progress(progress_of(spark, sf_dir)).select(
        F.lit(K.METRIC_PROGRESS).alias("metric"), F.col("mailing_id").alias("label"),
        texts.percent(F.col("processed_rows"), F.col("total_rows")).alias("value"))
    return queue.unionByName(workers).unionByName(ongoing)


@query("metric_series", "S12 A16 A17", sql(v.SEND_ATTEMPTS, v.CLASSIFIED, body=f"""
SELECT 'mailing_emails_total' AS metric, label, CAST(NULL AS VARCHAR) AS le, CAST(count(*) AS DOUBLE) AS value FROM (
 SELECT {OK_LABEL} AS label FROM decided UNION ALL SELECT 'SENDING' FROM decided UNION ALL
 SELECT 'DEAD_LETTER' FROM decided WHERE move_to_dlq) GROUP BY label UNION ALL
SELECT 'mailing_retries_total', class_reason, NULL, CAST(count(*) AS DOUBLE) FROM decided WHERE NOT success
 GROUP BY class_reason UNION ALL """ + _histogram_sql(
    K.METRIC_SEND_SECONDS, OK_LABEL, "duration_s", K.SEND_BOUNDS, "decided")))
def metric_series(spark, sf_dir):
    """Delivery series written to a parquet sink and read back."""
    path = new_folder(spark, "series")
    messages.write_series(M.delivery_series(decided_of(spark, sf_dir)), path)
    stored = messages.read_series(spark, path)
    label = F.coalesce(F.element_at("labels", "status"), F.element_at("labels", "reason"))
    return stored.select("metric", label.alias("label"), "le", F.round("value", 3).alias("value"))


@query("send_plan", "W04", sql(v.ENTRIES, body=f"""
SELECT id, row_number() OVER (ORDER BY created_at, id) - 1 AS slot,
 {AS_OF_SQL} + (row_number() OVER (ORDER BY created_at, id) - 1) * INTERVAL '11' SECOND AS planned_at
FROM entries WHERE status = 'PENDING'"""))
def send_plan(spark, sf_dir):
    pending = entries_of(spark, sf_dir).where(F.col("status") == "PENDING").select("id", "created_at")
    return S.send_plan(pending, v.AS_OF).select("id", "slot", "planned_at")


@query("lane_plan", "W04", sql(v.ENTRIES, body=f"""
SELECT id, mailing_id, row_number() OVER (PARTITION BY mailing_id ORDER BY created_at, id) - 1 AS slot,
 {AS_OF_SQL} + (row_number() OVER (PARTITION BY mailing_id ORDER BY created_at, id) - 1) * INTERVAL '1100' MILLISECOND
 AS planned_at FROM entries WHERE status = 'PENDING'"""))
def lane_plan(spark, sf_dir):
    pending = entries_of(spark, sf_dir).where(F.col("status") == "PENDING").select("id", "mailing_id", "created_at")
    return S.lane_plan(pending, "mailing_id", v.AS_OF, rate=600).select("id", "mailing_id", "slot", "planned_at")


@query("rate_gaps", "W05", sql(v.SEND_ATTEMPTS, body="""
SELECT event_id, mailing_id, gap_ms, coalesce(gap_ms < 11000, false) AS too_fast FROM (SELECT event_id, mailing_id,
 CAST(floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY mailing_id ORDER BY ts, event_id))) / 1000) AS BIGINT)
 AS gap_ms FROM send_attempts)"""))
def rate_gaps(spark, sf_dir):
    rows = attempts_of(spark, sf_dir).select("event_id", "mailing_id", "ts")
    return S.start_gaps(rows).select("event_id", "mailing_id", "gap_ms", "too_fast")


@query("rate_per_minute", "W05 ST8", sql(v.SEND_ATTEMPTS, body="""
SELECT date_trunc('minute', ts) AS minute, count(*) AS requests, count(*) > 6 AS over_limit FROM send_attempts
GROUP BY 1"""))
def rate_per_minute(spark, sf_dir):
    return S.per_minute(attempts_of(spark, sf_dir))


@query("checkpoint_trail", "W06", sql(v.CHECKED, body="""
SELECT * FROM (SELECT mailing_id, line_no, row_number() OVER w AS position,
 CAST(sum(CASE WHEN is_valid THEN 1 ELSE 0 END) OVER w AS BIGINT) AS processed_rows FROM checked
 WINDOW w AS (PARTITION BY mailing_id ORDER BY line_no)) WHERE position % 100 = 0"""))
def checkpoint_trail(spark, sf_dir):
    rows = validate(intake.normalized(rows_of(spark, sf_dir)), v.disposable(spark), raw="raw_email")
    return S.progress_trail(rows.select("mailing_id", "line_no", "is_valid")).select(
        "mailing_id", "line_no", "position", "processed_rows")


@query("send_pace", "A22", sql(v.SEND_ATTEMPTS, body="""
SELECT phase, sends, elapsed_s, round(elapsed_s / sends, 4) AS seconds_per_send FROM (SELECT
 CASE WHEN attempt = 1 THEN 'first' ELSE 'again' END AS phase, count(*) AS sends,
 round(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000) / 1000.0, 3) AS elapsed_s FROM send_attempts GROUP BY 1)"""))
def send_pace(spark, sf_dir):
    phase = F.when(F.col("attempt") == 1, "first").otherwise("again")
    return R.send_pace(attempts_of(spark, sf_dir).withColumn("phase", phase))

"""Queries on stored entries: filters, lookups, counts, order and pages."""

from pyspark.sql import functions as F

from postmill.functions import payload, texts
from postmill.operators import delivery, lookups as L, reports as R
from postmill.operators.outbox import table_counts
from postmill.plans import views as v
from postmill.plans.registry import query
from postmill.plans.views import AS_OF_SQL, sql
from postmill.session import new_folder
from postmill.sources import tables


def entries_of(spark, sf_dir):
    return v.entries_from(v.table(spark, sf_dir, "orders"))


def attempts_of(spark, sf_dir):
    return v.send_attempts_from(v.table(spark, sf_dir, "events"))


def mailings_of(spark, sf_dir):
    return v.mailings_from(v.table(spark, sf_dir, "part"))


def outbox_of(spark, sf_dir):
    return v.outbox_from(v.table(spark, sf_dir, "part"))


def progress_of(spark, sf_dir):
    return v.progress_from(v.table(spark, sf_dir, "part"))


def dead_letters_of(spark, sf_dir):
    return delivery.dead_letters(delivery.failure_step(attempts_of(spark, sf_dir)))


DEAD = """dead AS (SELECT event_id, 'entry' AS kind, mailing_id, email, reason, attempt AS attempts,
 '[' || coalesce(CAST(http_status AS VARCHAR), 'N/A') || '] ' || coalesce(error, 'Unknown error') AS last_error,
 ts AS created_at FROM decided WHERE move_to_dlq)"""


@query("entries_of_mailing", "F01", sql(v.ENTRIES, body="""
SELECT id, email, status, created_at FROM entries WHERE mailing_id = 'm3' AND status = 'SENT'"""))
def entries_of_mailing(spark, sf_dir):
    return L.entries_of(entries_of(spark, sf_dir), "m3", "sent").select("id", "email", "status", "created_at")


@query("find_entry", "F02", sql(v.ENTRIES, body="""
SELECT id, mailing_id, email, status FROM entries
WHERE (mailing_id, email) IN (SELECT mailing_id, email FROM entries WHERE status = 'FAILED')"""))
def find_entry(spark, sf_dir):
    entries = entries_of(spark, sf_dir)
    wanted = L.find(entries, status="FAILED")
    return L.find_many(entries, wanted, ["mailing_id", "email"]).select("id", "mailing_id", "email", "status")


@query("pending_entries", "F03", sql(v.ENTRIES, body="""
SELECT id, mailing_id, email FROM entries WHERE status = 'PENDING'"""))
def pending_entries(spark, sf_dir):
    return L.pending(entries_of(spark, sf_dir)).select("id", "mailing_id", "email")


@query("active_progress", "F07", sql(v.PROGRESS, body="""
SELECT mailing_id, status, total_rows, processed_rows FROM progress WHERE status IN ('RUNNING', 'PAUSED')
ORDER BY mailing_id"""))
def active_progress(spark, sf_dir):
    return L.active_progress(progress_of(spark, sf_dir)).select("mailing_id", "status", "total_rows", "processed_rows")


@query("unpublished_messages", "F09", sql(v.OUTBOX, body="""
SELECT id, mailing_id, attempts, created_at FROM outbox WHERE NOT published"""))
def unpublished_messages(spark, sf_dir):
    return L.unpublished(outbox_of(spark, sf_dir)).select("id", "mailing_id", "attempts", "created_at")


@query("dead_letters_by_reason", "F10", sql(v.SEND_ATTEMPTS, v.CLASSIFIED, DEAD, body="""
SELECT mailing_id, email, reason, attempts, created_at FROM dead
WHERE reason = 'Permanent error - 404 Not Found - resource does not exist' ORDER BY created_at DESC LIMIT 20"""))
def dead_letters_by_reason(spark, sf_dir):
    found = L.dead_letters_for(
        dead_letters_of(spark, sf_dir), "Permanent error - 404 Not Found - resource does not exist", 20)
    return found.select("mailing_id", "email", "reason", "attempts", "created_at")


@query("status_filter", "P15", sql(v.ENTRIES, body="""
SELECT status, count(*) AS count FROM entries WHERE status IN ('PENDING', 'FAILED') GROUP BY status"""))
def status_filter(spark, sf_dir):
    wanted = [texts.status_filter(s) for s in ("pending", "Failed")]
    return R.group_counts(entries_of(spark, sf_dir).where(F.col("status").isin(*wanted)), "status")


@query("status_counts", "A01", sql(v.ENTRIES, body="""
SELECT mailing_id, status, count(*) AS count FROM entries GROUP BY mailing_id, status"""))
def status_counts(spark, sf_dir):
    return R.status_counts(entries_of(spark, sf_dir))


CARD = """SELECT mailing_id, count(*) AS total, count(*) FILTER (WHERE status <> 'INVALID') AS valid,
 count(*) FILTER (WHERE status = 'INVALID') AS invalid, count(*) FILTER (WHERE status = 'PENDING') AS pending,
 count(*) FILTER (WHERE status = 'SENDING') AS sending, count(*) FILTER (WHERE status = 'SENT') AS sent, count(*) FILTER (WHERE status = 'FAILED') AS failed
FROM entries GROUP BY mailing_id"""


@query("status_card", "A02", sql(v.ENTRIES, body=CARD))
def status_card(spark, sf_dir):
    return R.status_card(entries_of(spark, sf_dir))


@query("status_page", "A02 P16", sql(v.ENTRIES, v.PROGRESS, body=f"""
SELECT p.mailing_id, p.status AS progress_status, total_rows, processed_rows,
 CASE WHEN total_rows > 0 THEN CAST(round(100.0 * processed_rows / total_rows, 2) AS DOUBLE) ELSE 0.0 END AS percentage,
 coalesce(total, 0) AS total, coalesce(valid, 0) AS valid, coalesce(sent, 0) AS sent, coalesce(failed, 0) AS failed
FROM progress p LEFT JOIN ({CARD}) c ON c.mailing_id = p.mailing_id"""))
def status_page(spark, sf_dir):
    out = R.status_page(progress_of(spark, sf_dir), entries_of(spark, sf_dir))
    return out.select("mailing_id", "progress_status", "total_rows", "processed_rows", "percentage", "total", "valid",
                      "sent", "failed")


@query("percentages", "P16", sql(v.MAILINGS, body="""
SELECT id, CASE WHEN total_lines > 0 THEN CAST(round(100.0 * processed_lines / total_lines, 2) AS DOUBLE) ELSE 0.0 END
 AS percentage,
 CASE WHEN total_lines > 0 THEN CAST(CAST(round(100.0 * processed_lines / total_lines, 2) AS DECIMAL(9,2)) AS VARCHAR)
 ELSE '0.00' END AS percentage_text FROM mailings"""))
def percentages(spark, sf_dir):
    done, total = F.col("processed_lines"), F.col("total_lines")
    return mailings_of(spark, sf_dir).select(
        "id", texts.percent(done, total).alias("percentage"), texts.percent_text(done, total).alias("percentage_text"))


@query("headline_counts", "A03", sql(v.ENTRIES, v.MAILINGS, v.OUTBOX, v.SEND_ATTEMPTS, v.CLASSIFIED, DEAD, body="""
SELECT 'entries' AS metric, count(*) AS count FROM entries UNION ALL SELECT 'dead_letters', count(*) FROM dead
UNION ALL SELECT 'mailings', count(*) FROM mailings WHERE status = 'QUEUED'
UNION ALL SELECT 'unpublished', count(*) FROM outbox WHERE NOT published"""))
def headline_counts(spark, sf_dir):
    return R.headline_counts(
        entries_of(spark, sf_dir), dead_letters_of(spark, sf_dir), mailings_of(spark, sf_dir),
        outbox_of(spark, sf_dir), "QUEUED")


@query("group_counts", "A13", sql(v.MAILINGS, v.OUTBOX, body="""
SELECT 'mailings' AS source, status AS value, count(*) AS count FROM mailings GROUP BY status
UNION ALL SELECT 'outbox', CAST(published AS VARCHAR), count(*) FROM outbox GROUP BY published"""))
def group_counts(spark, sf_dir):
    one = R.group_counts(mailings_of(spark, sf_dir), "status").select(
        F.lit("mailings").alias("source"), F.col("status").alias("value"), "count")
    two = R.group_counts(outbox_of(spark, sf_dir), "published").select(
        F.lit("outbox").alias("source"), F.col("published").cast("string").alias("value"), "count")
    return one.unionByName(two)


@query("report_summary", "A19", sql(v.ENTRIES, body="""
SELECT mailing_id, count(*) AS processed, count(*) FILTER (WHERE status = 'SENT') AS sent, count(*) FILTER (WHERE status = 'FAILED') AS failed,
 count(*) FILTER (WHERE status = 'INVALID') AS invalid,
 CAST(round(100.0 * count(*) FILTER (WHERE status = 'SENT') / count(*), 1) AS DOUBLE) AS sent_share,
 CAST(round(100.0 * count(*) FILTER (WHERE status = 'FAILED') / count(*), 1) AS DOUBLE) AS failed_share,
 CAST(round(100.0 * count(*) FILTER (WHERE status = 'INVALID') / count(*), 1) AS DOUBLE) AS invalid_share
FROM entries WHERE status IN ('SENT', 'FAILED', 'INVALID') GROUP BY mailing_id"""))
def report_summary(spark, sf_dir):
    return R.delivery_summary(entries_of(spark, sf_dir))


@query("report_ordered", "O05", sql(v.ENTRIES, body="""
SELECT id, email, status, attempts, created_at FROM entries ORDER BY CASE status WHEN 'SENT' THEN 1
 WHEN 'FAILED' THEN 2 WHEN 'INVALID' THEN 3 ELSE 4 END, created_at, id"""))
def report_ordered(spark, sf_dir):
    return L.report_ordered(entries_of(spark, sf_dir)).select("id", "email", "status", "attempts", "created_at")


@query("pending_topk", "O01", sql(v.ENTRIES, body="""
SELECT id, mailing_id, created_at FROM entries WHERE status = 'PENDING' ORDER BY created_at, id LIMIT 50"""))
def pending_topk(spark, sf_dir):
    return L.oldest(L.pending(entries_of(spark, sf_dir)), 50).select("id", "mailing_id", "created_at")


@query("outbox_topk", "O01 F09", sql(v.OUTBOX, body="""
SELECT id, mailing_id, created_at FROM outbox WHERE NOT published ORDER BY created_at, id LIMIT 10"""))
def outbox_topk(spark, sf_dir):
    return L.oldest(L.unpublished(outbox_of(spark, sf_dir)), 10).select("id", "mailing_id", "created_at")


@query("entries_page", "O02", sql(v.ENTRIES, body="""
SELECT id, email, created_at, total, 120 + count(*) OVER () < total AS has_more FROM
 (SELECT id, email, created_at, count(*) OVER () AS total FROM entries WHERE mailing_id = 'm3' AND status = 'SENT'
  ORDER BY created_at, id LIMIT 100 OFFSET 120)"""))
def entries_page(spark, sf_dir):
    return L.page(entries_of(spark, sf_dir), "m3", "sent", 100, 120).select(
        "id", "email", "created_at", "total", "has_more")


@query("entries_page_after", "O02", sql(v.ENTRIES, body="""
SELECT id, email, created_at FROM entries WHERE mailing_id = 'm3'
 AND (created_at > TIMESTAMP '1998-01-01' OR (created_at = TIMESTAMP '1998-01-01' AND id > 0))
ORDER BY created_at, id LIMIT 100"""))
def entries_page_after(spark, sf_dir):
    return L.page_after(entries_of(spark, sf_dir), "m3", v.AS_OF, 0).select("id", "email", "created_at")


@query("mailings_list", "O03", sql(v.MAILINGS, body="""
SELECT id, filename, status, created_at FROM mailings WHERE status = 'QUEUED' ORDER BY created_at DESC, id DESC
LIMIT 20 OFFSET 10"""))
def mailings_list(spark, sf_dir):
    return L.newest(mailings_of(spark, sf_dir), 20, 10, "QUEUED").select("id", "filename", "status", "created_at")


@query("entries_page_deep", "O02 F01", sql(v.ENTRIES, body="""
SELECT CAST(id AS VARCHAR) AS id, email, created_at FROM entries WHERE mailing_id = 'm3'
ORDER BY created_at, CAST(id AS VARCHAR) LIMIT 50 OFFSET 1200"""))
def entries_page_deep(spark, sf_dir):
    """A deep page of stored entries by the marks stored beside them."""
    path = new_folder(spark, "pages")
    tables.append(entries_of(spark, sf_dir), path, "mailing_entries")
    stored = tables.read_table(spark, path, "mailing_entries")
    tables.write_fences(stored, path, every=100)
    marks = L.entries_of(tables.read_fences(spark, path), "m3")
    return L.page_by_fences(L.entries_of(stored, "m3"), marks, 50, 1200).select("id", "email", "created_at")


@query("mailings_page_deep", "O03", sql(v.MAILINGS, body="""
SELECT id, filename, status, created_at FROM mailings ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 170"""))
def mailings_page_deep(spark, sf_dir):
    """The newest mailings from a deep place on."""
    mailings = mailings_of(spark, sf_dir)
    marks = L.fences(mailings, every=50, descending=True)
    return L.page_by_fences(mailings, marks, 20, 170, descending=True).select("id", "filename", "status", "created_at")


@query("latest_dead_letters", "O04", sql(v.SEND_ATTEMPTS, v.CLASSIFIED, DEAD, body="""
SELECT mailing_id, email, reason, created_at FROM dead ORDER BY created_at DESC LIMIT 5"""))
def latest_dead_letters(spark, sf_dir):
    return L.newest(dead_letters_of(spark, sf_dir), 5).select("mailing_id", "email", "reason", "created_at")


@query("oldest_stale", "O06", sql(v.ENTRIES, body=f"""
SELECT id, mailing_id, last_attempt FROM entries WHERE status = 'SENDING'
 AND last_attempt < {AS_OF_SQL} - INTERVAL '300' SECOND ORDER BY last_attempt, id LIMIT 10"""))
def oldest_stale(spark, sf_dir):
    return L.oldest_attempts(entries_of(spark, sf_dir), v.AS_OF).select("id", "mailing_id", "last_attempt")


DELAY = """CASE WHEN ms < 1000 THEN CAST(ms AS VARCHAR) || 'ms'
 WHEN ms < 60000 THEN CAST(((ms + 50) // 100) // 10 AS VARCHAR) || '.' || CAST(((ms + 50) // 100) % 10 AS VARCHAR) || 's'
 WHEN (ms % 60000) // 1000 > 0
  THEN CAST(ms // 60000 AS VARCHAR) || 'm ' || CAST((ms % 60000) // 1000 AS VARCHAR) || 's'
 ELSE CAST(ms // 60000 AS VARCHAR) || 'm' END"""
LONG = """CASE WHEN ms // 86400000 > 0
  THEN CAST(ms // 86400000 AS VARCHAR) || 'd ' || CAST((ms // 3600000) % 24 AS VARCHAR) || 'h'
 WHEN ms // 3600000 > 0 THEN CAST(ms // 3600000 AS VARCHAR) || 'h ' || CAST((ms // 60000) % 60 AS VARCHAR) || 'm'
 WHEN ms // 60000 > 0 THEN CAST(ms // 60000 AS VARCHAR) || 'm ' || CAST((ms // 1000) % 60 AS VARCHAR) || 's'
 ELSE CAST(ms // 1000 AS VARCHAR) || 's' END"""


@query("durations", "P17", sql(v.SEND_ATTEMPTS, body=f"""
SELECT event_id, ms, {DELAY} AS delay_text, {LONG} AS long_text FROM
 (SELECT event_id, CAST(round(duration_s * 100) AS BIGINT) * (CASE event_id % 3 WHEN 0 THEN 7 WHEN 1 THEN 611
  ELSE 33331 END) AS ms FROM send_attempts)"""))
def durations(spark, sf_dir):
    event = F.col("event_id") % 3
    scale = F.when(event == 0, 7).when(event == 1, 611).otherwise(33331)
    ms = (F.round(F.col("duration_s") * 100).cast("bigint") * scale).alias("ms")
    out = attempts_of(spark, sf_dir).select("event_id", ms)
    return out.select("event_id", "ms", texts.delay_text(F.col("ms")).alias("delay_text"),
                      texts.long_duration_text(F.col("ms")).alias("long_text"))


@query("masking", "P18", sql(v.MAILINGS, body="""
SELECT id, CASE WHEN length(k) <= 16 THEN k ELSE substr(k, 1, 8) || '...' || right(k, 8) END AS key_shown,
 CASE WHEN length(t) <= 10 THEN '***' ELSE substr(t, 1, 6) || '...' || right(t, 4) END AS token_shown,
 'https://api.example.com:8443/v1/' || CAST(id AS VARCHAR) AS url_shown
FROM (SELECT id, CASE WHEN id % 2 = 0 THEN sha256(filename) ELSE filename END AS k,
 CASE WHEN id % 3 = 0 THEN 'short' || CAST(id AS VARCHAR) ELSE sha256(filename) END AS t FROM mailings)"""))
def masking(spark, sf_dir):
    key, name = F.col("id"), F.col("filename")
    rows = mailings_of(spark, sf_dir).select(
        "id", F.when(key % 2 == 0, F.sha2(name, 256)).otherwise(name).alias("k"),
        F.when(key % 3 == 0, F.concat(F.lit("short"), key.cast("string"))).otherwise(F.sha2(name, 256)).alias("t"),
        F.concat(F.lit("HTTPS://user:secret@Api.Example.com:8443/v1/"), key.cast("string"),
                 F.lit("?token=abc#frag")).alias("u"))
    return rows.select("id", texts.mask_key(F.col("k")).alias("key_shown"),
                       texts.mask_token(F.col("t")).alias("token_shown"), texts.mask_url(F.col("u")).alias("url_shown"))


def _responses(spark, sf_dir):
    """Provider answers as JSON in the shapes that occur."""
    key, event = F.col("event_id").cast("string"), F.col("event_id") % 5
    body = (
        F.when(event == 0, F.concat(F.lit('{"message_id":"a'), key, F.lit('","status":"queued","secret":"x"}')))
        .when(event == 1, F.concat(F.lit('{"messageId":"b'), key, F.lit('","timestamp":"t1"}')))
        .when(event == 2, F.concat(F.lit('{"id":"c'), key, F.lit('","message":"bad address","error":"E"}')))
        .when(event == 3, F.lit('{"status":"accepted","error":"quota"}'))
        .otherwise(F.lit("gateway down"))
    )
    rows = attempts_of(spark, sf_dir).select("event_id", "http_status", body.alias("body"))
    return rows.withColumn("answer", payload.response(F.col("body")))


RESPONSES = """responses AS (SELECT event_id, http_status, CASE event_id % 5
 WHEN 0 THEN '{"message_id":"a' || CAST(event_id AS VARCHAR) || '","status":"queued","secret":"x"}'
 WHEN 1 THEN '{"messageId":"b' || CAST(event_id AS VARCHAR) || '","timestamp":"t1"}'
 WHEN 2 THEN '{"id":"c' || CAST(event_id AS VARCHAR) || '","message":"bad address","error":"E"}'
 WHEN 3 THEN '{"status":"accepted","error":"quota"}' END AS body FROM send_attempts)"""


@query("message_ids", "P19", sql(v.SEND_ATTEMPTS, RESPONSES, body="""
SELECT event_id, coalesce(json_extract_string(body, '$.message_id'), json_extract_string(body, '$.messageId'),
 json_extract_string(body, '$.id'), 'status:' || coalesce(json_extract_string(body, '$.status'), 'undefined'))
 AS message_id FROM responses"""))
def message_ids(spark, sf_dir):
    return _responses(spark, sf_dir).select("event_id", payload.message_id(F.col("answer")).alias("message_id"))


@query("error_texts", "P20 P25", sql(v.SEND_ATTEMPTS, RESPONSES, body="""
SELECT event_id, '[' || coalesce(CAST(http_status AS VARCHAR), 'N/A') || '] ' || error_text AS audit_text, error_text
FROM (SELECT event_id, http_status, coalesce(json_extract_string(body, '$.message'),
 json_extract_string(body, '$.error'), body, '"gateway down"') AS error_text FROM responses)"""))
def error_texts(spark, sf_dir):
    text = payload.error_text(F.col("answer"), F.col("body"), F.lit("no answer"))
    rows = _responses(spark, sf_dir).withColumn("error_text", text)
    return rows.select("event_id", texts.audit_text(F.col("http_status"), F.col("error_text")).alias("audit_text"),
                       "error_text")


@query("safe_fields", "P26", sql(v.SEND_ATTEMPTS, RESPONSES, body="""
SELECT event_id, coalesce(json_extract_string(body, '$.message_id'), json_extract_string(body, '$.messageId'),
 json_extract_string(body, '$.id')) AS message_id, json_extract_string(body, '$.status') AS status,
 json_extract_string(body, '$.timestamp') AS sent_at,
 coalesce(json_extract_string(body, '$.error'), 'Unknown error') AS error FROM responses"""))
def safe_fields(spark, sf_dir):
    answer = F.col("answer")
    rows = _responses(spark, sf_dir).select(
        "event_id", payload.safe_response(answer).alias("r"),
        payload.safe_error(F.col("http_status"), F.lit("failed"), answer).alias("e"))
    return rows.select("event_id", F.col("r.messageId").alias("message_id"), F.col("r.status").alias("status"),
                       F.col("r.timestamp").alias("sent_at"), F.col("e.error").alias("error"))


@query("table_counts", "A10 U01", sql(v.MAILINGS, v.OUTBOX, v.PUBLISH_RESULTS, body="""
SELECT 'mailings' AS table_name, count(*) AS count FROM mailings UNION ALL
SELECT 'outbox_messages', count(*) FROM outbox UNION ALL
SELECT 'outbox_dead_letters', count(*) FROM outbox WHERE NOT published AND attempts >= 5"""))
def table_counts_query(spark, sf_dir):
    from postmill.operators import outbox as ob

    part = v.table(spark, sf_dir, "part")
    messages = v.outbox_from(part)
    decided = ob.publish_decision(messages, v.publish_results_from(part), v.AS_OF_2024)
    dead = ob.split_published(decided, v.AS_OF_2024)[1]
    return table_counts(mailings=v.mailings_from(part), outbox_messages=messages, outbox_dead_letters=dead)

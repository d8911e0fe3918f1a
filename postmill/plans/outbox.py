"""Queries on mailings and their queue messages."""

from pyspark.sql import functions as F

from postmill.functions import payload
from postmill.operators import outbox as ob
from postmill.plans import views as v
from postmill.plans.reading import mailings_of, outbox_of
from postmill.plans.registry import query
from postmill.plans.views import sql
from postmill.session import new_folder
from postmill.sources import messages as M

NO_MESSAGE = "NOT EXISTS (SELECT 1 FROM outbox o WHERE o.mailing_id = m.id)"


@query("orphans_anti", "J04", sql(v.MAILINGS, v.OUTBOX, body=f"""
SELECT id, filename, status FROM mailings m WHERE status IN ('PENDING', 'QUEUED') AND {NO_MESSAGE}"""))
def orphans_anti(spark, sf_dir):
    return ob.orphans(mailings_of(spark, sf_dir), outbox_of(spark, sf_dir)).select("id", "filename", "status")


@query("orphans_having", "A08", sql(v.MAILINGS, v.OUTBOX, body="""
SELECT m.id, m.filename, m.status, m.created_at, count(o.id) AS message_count FROM mailings m
LEFT JOIN outbox o ON o.mailing_id = m.id GROUP BY m.id, m.filename, m.status, m.created_at HAVING count(o.id) = 0"""))
def orphans_having(spark, sf_dir):
    return ob.orphans_by_count(mailings_of(spark, sf_dir), outbox_of(spark, sf_dir)).select(
        "id", "filename", "status", "created_at", "message_count")


@query("message_counts", "J08", sql(v.MAILINGS, v.OUTBOX, body="""
SELECT id, filename, (SELECT count(*) FROM outbox o WHERE o.mailing_id = m.id) AS message_count FROM mailings m"""))
def message_counts(spark, sf_dir):
    return ob.message_counts(mailings_of(spark, sf_dir), outbox_of(spark, sf_dir)).select(
        "id", "filename", "message_count")


@query("mailing_outbox_left", "J05", sql(v.MAILINGS, v.OUTBOX, body="""
SELECT m.id AS mailing_id, m.filename, m.status AS mailing_status, o.id AS outbox_id, o.published AS outbox_published,
 o.target_queue, o.created_at AS outbox_created_at FROM mailings m LEFT JOIN outbox o ON m.id = o.mailing_id
WHERE m.status IN ('PENDING', 'QUEUED') ORDER BY m.created_at DESC"""))
def mailing_outbox_left(spark, sf_dir):
    return ob.mailings_with_messages(mailings_of(spark, sf_dir), outbox_of(spark, sf_dir)).select(
        "mailing_id", "filename", "mailing_status", "outbox_id", "outbox_published", "target_queue",
        "outbox_created_at")


@query("outbox_with_parent", "J06", sql(v.MAILINGS, v.OUTBOX, body="""
SELECT o.id AS outbox_id, m.id AS mailing_id, m.filename, m.status AS mailing_status FROM outbox o
JOIN mailings m ON m.id = o.mailing_id WHERE NOT o.published"""))
def outbox_with_parent(spark, sf_dir):
    return ob.with_parent(outbox_of(spark, sf_dir), mailings_of(spark, sf_dir)).select(
        "outbox_id", "mailing_id", "filename", "mailing_status")


@query("nested_outbox", "J07", sql(v.MAILINGS, v.OUTBOX, body="""
SELECT m.id AS mailing_id, m.filename, CAST(0 AS BIGINT) AS page_no, CAST(count(o.id) AS INT) AS message_count,
 coalesce(string_agg(CAST(o.id AS VARCHAR), ',' ORDER BY o.id), '') AS message_ids
FROM mailings m LEFT JOIN outbox o ON o.mailing_id = m.id WHERE m.status IN ('PENDING', 'QUEUED')
GROUP BY m.id, m.filename"""))
def nested_outbox(spark, sf_dir):
    nested = ob.nested_messages(mailings_of(spark, sf_dir), outbox_of(spark, sf_dir))
    ids = F.transform("messages", lambda m: m["outbox_id"].cast("string"))
    return nested.select("mailing_id", "filename", "page_no", "message_count", F.array_join(ids, ",").alias("message_ids"))


@query("outbox_stats", "A09 U01", sql(v.MAILINGS, v.OUTBOX, body="""
SELECT 'Total Mailings' AS metric, count(*) AS count FROM mailings UNION ALL
SELECT 'Total Outbox Messages', count(*) FROM outbox UNION ALL
SELECT 'Unpublished Messages', count(*) FROM outbox WHERE NOT published UNION ALL
SELECT 'Published Messages', count(*) FROM outbox WHERE published"""))
def outbox_stats(spark, sf_dir):
    return ob.statistics(mailings_of(spark, sf_dir), outbox_of(spark, sf_dir))


MONITOR = f"""
SELECT 'pending_mailings' AS metric, count(*) AS count FROM mailings WHERE status = 'PENDING' UNION ALL
SELECT 'queued_mailings', count(*) FROM mailings WHERE status = 'QUEUED' UNION ALL
SELECT 'unpublished_outbox', count(*) FROM outbox WHERE NOT published UNION ALL
SELECT 'mailings_without_outbox', count(*) FROM mailings m WHERE status IN ('PENDING', 'QUEUED') AND {NO_MESSAGE}"""


@query("queue_monitor", "A11", sql(v.MAILINGS, v.OUTBOX, body=MONITOR + """ UNION ALL
SELECT 'published_outbox', count(*) FROM outbox WHERE published UNION ALL
SELECT 'failed_mailings', count(*) FROM mailings WHERE status = 'FAILED' UNION ALL
SELECT 'processing_mailings', count(*) FROM mailings WHERE status = 'PROCESSING' UNION ALL
SELECT 'completed_mailings', count(*) FROM mailings WHERE status = 'COMPLETED'"""))
def queue_monitor(spark, sf_dir):
    return ob.queue_monitor(mailings_of(spark, sf_dir), outbox_of(spark, sf_dir))


@query("backfill_stats", "A12", sql(v.MAILINGS, v.OUTBOX, body=MONITOR))
def backfill_stats(spark, sf_dir):
    return ob.backfill_statistics(mailings_of(spark, sf_dir), outbox_of(spark, sf_dir))


@query("payload_extract", "P12", sql(v.OUTBOX, body="""
SELECT id, json_extract_string(payload, '$.mailingId') AS payload_mailing_id,
 json_extract_string(payload, '$.filename') AS payload_filename FROM outbox WHERE NOT published"""))
def payload_extract(spark, sf_dir):
    c = F.col("payload")
    return outbox_of(spark, sf_dir).where(~F.col("published")).select(
        "id", payload.field(c, "mailingId").alias("payload_mailing_id"),
        payload.field(c, "filename").alias("payload_filename"))


@query("payload_fields", "S10", sql(v.OUTBOX, body="""
SELECT target_queue, json_extract_string(payload, '$.mailingId') AS mailing_id,
 json_extract_string(payload, '$.filename') AS filename,
 CAST(json_extract_string(payload, '$.attempt') AS INT) AS attempt, json_extract_string(payload, '$.storageUrl')
 AS storage_url FROM outbox"""))
def payload_fields(spark, sf_dir):
    """Messages written to queue folders as JSON lines and read back."""
    path = new_folder(spark, "queue")
    M.write_messages(outbox_of(spark, sf_dir), path)
    return M.read_queue(spark, path).select(
        "target_queue", F.col("job.mailingId").alias("mailing_id"), F.col("job.filename").alias("filename"),
        F.col("job.attempt").alias("attempt"), F.col("job.storageUrl").alias("storage_url"))


@query("first_payloads", "P11", sql(v.MAILINGS, body=f"""
SELECT id, '{{"mailingId":"' || CAST(id AS VARCHAR) || '","filename":"' || filename || '","storageUrl":'
 || coalesce('"' || storage_url || '"', 'null') || ',"attempt":0,"createdAt":"'
 || strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '.000Z"}}' AS payload FROM mailings"""))
def first_payloads(spark, sf_dir):
    text = payload.job_payload(F.col("id"), F.col("filename"), F.col("storage_url"), F.col("created_at"))
    return mailings_of(spark, sf_dir).select("id", text.alias("payload"))


def _decided(spark, sf_dir):
    part = v.table(spark, sf_dir, "part")
    return ob.publish_decision(v.outbox_from(part), v.publish_results_from(part), v.AS_OF_2024)


DECIDED = """judged AS (SELECT o.*, r.ok, r.error AS new_error,
 CASE WHEN NOT published AND attempts >= 5 THEN 'dead_letter' WHEN NOT published AND r.ok THEN 'published'
  WHEN NOT published AND NOT r.ok THEN 'failed' ELSE 'unchanged' END AS outcome
 FROM outbox o LEFT JOIN (SELECT message_id, bool_or(ok) AS ok,
  max(error) FILTER (rn = 1) AS error FROM
  (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY seq DESC) AS rn FROM publish_results)
  GROUP BY message_id) r ON r.message_id = o.id)"""


@query("publish_step", "T10", sql(v.OUTBOX, v.PUBLISH_RESULTS, DECIDED, body=f"""
SELECT id, mailing_id, outcome, published OR outcome = 'published' AS published,
 CASE WHEN outcome = 'published' THEN {v.AS_OF_2024_SQL} END AS published_at,
 attempts + CASE WHEN outcome = 'failed' THEN 1 ELSE 0 END AS attempts,
 CASE WHEN outcome = 'failed' THEN new_error ELSE last_error END AS last_error FROM judged"""))
def publish_step(spark, sf_dir):
    return _decided(spark, sf_dir).select(
        "id", "mailing_id", "outcome", "published", "published_at", "attempts", "last_error")


@query("count_lines", "T16", sql(v.MAILINGS, body="""
SELECT id, CASE WHEN id % 3 = 0 THEN total_lines // 2 + 1 ELSE processed_lines END AS processed_lines FROM mailings"""))
def count_lines(spark, sf_dir):
    """Lines handled so far, reported after some lines and again later."""
    mailings = mailings_of(spark, sf_dir)
    half = mailings.where(F.col("id") % 3 == 0).select(
        F.col("id").alias("mailing_id"), F.floor(F.col("total_lines") / 2).alias("processed_lines"))
    reports = half.unionByName(half.withColumn("processed_lines", F.col("processed_lines") + 1))
    return ob.count_lines(mailings, reports).select("id", "processed_lines")


@query("publish_batch", "T17", sql(v.OUTBOX, v.PUBLISH_RESULTS, DECIDED, body="""
SELECT id, outcome, attempts + CASE WHEN outcome = 'failed' THEN 1 ELSE 0 END AS attempts
FROM judged WHERE NOT published ORDER BY created_at, id LIMIT 10"""))
def publish_batch(spark, sf_dir):
    """The ten oldest unpublished messages, as one poll takes them."""
    messages = v.outbox_from(v.table(spark, sf_dir, "part"))
    results = v.publish_results_from(v.table(spark, sf_dir, "part"))
    return ob.publish_batch(messages, results, v.AS_OF_2024).select("id", "outcome", "attempts")


@query("move_dead_messages", "U03 T10", sql(v.OUTBOX, v.PUBLISH_RESULTS, DECIDED, body="""
SELECT 'outbox' AS side, id AS message_id, mailing_id, attempts + CASE WHEN outcome = 'failed' THEN 1 ELSE 0 END
 AS attempts, CASE WHEN outcome = 'failed' THEN new_error ELSE last_error END AS error
FROM judged WHERE outcome <> 'dead_letter'
UNION ALL SELECT 'dead_letters', NULL, mailing_id, attempts, coalesce(last_error, 'Max attempts exceeded')
FROM judged WHERE outcome = 'dead_letter'"""))
def move_dead_messages(spark, sf_dir):
    left, dead = ob.split_published(_decided(spark, sf_dir), v.AS_OF_2024)
    one = left.select(F.lit("outbox").alias("side"), F.col("id").alias("message_id"), "mailing_id", "attempts",
                      F.col("last_error").alias("error"))
    two = dead.select(F.lit("dead_letters").alias("side"), F.lit(None).cast("bigint").alias("message_id"),
                      "mailing_id", "attempts", "error")
    return one.unionByName(two)


@query("backfill_plan", "T12", sql(v.MAILINGS, v.OUTBOX, body=f"""
SELECT id, filename, status, CASE WHEN storage_url IS NULL THEN 'failed' ELSE 'created' END AS outcome
FROM mailings m WHERE status IN ('PENDING', 'QUEUED') AND {NO_MESSAGE}"""))
def backfill_plan(spark, sf_dir):
    plan, _ = ob.backfill(mailings_of(spark, sf_dir), outbox_of(spark, sf_dir), v.AS_OF_2024, dry_run=True)
    return plan.select("id", "filename", "status", "outcome")


@query("backfill_messages", "T12 P11", sql(v.MAILINGS, v.OUTBOX, body=f"""
SELECT id AS mailing_id, 'mailing.jobs.process' AS target_queue, false AS published, 0 AS attempts,
 '{{"mailingId":"' || CAST(id AS VARCHAR) || '","filename":"' || filename || '","storageUrl":"' || storage_url
 || '","attempt":0,"createdAt":"2024-01-02T00:00:00.000Z"}}' AS payload
FROM mailings m WHERE status IN ('PENDING', 'QUEUED') AND storage_url IS NOT NULL AND {NO_MESSAGE}"""))
def backfill_messages(spark, sf_dir):
    _, messages = ob.backfill(mailings_of(spark, sf_dir), outbox_of(spark, sf_dir), v.AS_OF_2024)
    return messages.select("mailing_id", "target_queue", "published", "attempts", "payload")

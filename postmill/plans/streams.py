"""Streaming queries: each runs over the available input, stops, and returns what it has stored.

Tables are read as file streams through a path pattern; it fits a single file as well as a folder of files.
"""

import datetime
from contextlib import suppress

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from postmill.operators import intake
from postmill.plans import views as v
from postmill.plans.intake import REGISTERED, _written_csv, registered
from postmill.plans.registry import query
from postmill.plans.views import sql
from postmill.session import new_folder
from postmill.sources import tables
from postmill.streaming import jobs, poll, runner, timers


def arriving(spark, sf_dir, name):
    """A table as a stream of its files."""
    pattern = f"{sf_dir}/{name}.parque[t]"
    return runner.files(spark, pattern, v.table(spark, sf_dir, name).schema)


def _stored(spark, query_of, label):
    """Run a job into a new folder and read the folder."""
    folder = new_folder(spark, label)
    out, checkpoint = f"{folder}/out", f"{folder}/checkpoint"
    runner.finish(query_of(out, checkpoint))
    return out


@query("stream_ingest", "ST1 S01", sql(v.CHECKED, body="""
SELECT email, is_valid, reason, count(*) AS n FROM (SELECT CASE WHEN email IS NULL OR email = '' THEN NULL ELSE email
 END AS email, is_valid, reason FROM checked) GROUP BY ALL"""))
def stream_ingest(spark, sf_dir):
    """CSV files that arrive in a folder are validated as they come."""
    source = runner.files(spark, _written_csv(spark, sf_dir), "email string, name string, line string", "csv",
                          per_trigger=1000, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True,
                          ignoreTrailingWhiteSpace=True, pathGlobFilter="*.csv")
    rows = source.select(F.lit("m").alias("mailing_id"), F.col("email").alias("raw_email"))
    checked = jobs.checked(rows, v.disposable(spark))
    out = _stored(spark, lambda o, c: runner.to_files(checked, o, c), "stream-ingest")
    stored = spark.read.parquet(out)
    return stored.groupBy("email", "is_valid", "reason").agg(F.count("*").alias("n"))


@query("stream_dedupe", "ST2", sql(v.CHECKED, body="SELECT DISTINCT mailing_id, email FROM checked WHERE email <> ''"))
def stream_dedupe(spark, sf_dir):
    """Each recipient once, against what earlier micro-batches stored."""
    rows = intake.normalized(v.mail_rows_from(arriving(spark, sf_dir, "orders"))).where(F.col("email") != "")
    keyed = rows.select("mailing_id", "email", "line_no")
    out = _stored(spark, lambda o, c: jobs.store_unseen(keyed, o, c), "stream-dedupe")
    return runner.stored(spark, out).select("mailing_id", "email")


@query("stream_dedupe_state", "ST2", sql(v.CHECKED, body="""
SELECT DISTINCT mailing_id, email FROM checked WHERE email <> ''"""))
def stream_dedupe_state(spark, sf_dir):
    """The same with the keys kept in stream state."""
    rows = intake.normalized(v.mail_rows_from(arriving(spark, sf_dir, "orders"))).where(F.col("email") != "")
    unique = jobs.dedupe(rows.select("mailing_id", "email"))
    out = _stored(spark, lambda o, c: runner.to_files(unique, o, c), "stream-dedupe-state")
    return spark.read.parquet(out)


@query("stream_resume", "ST3", sql(v.CHECKED, body="""
SELECT reason, count(*) AS rows FROM checked GROUP BY reason"""))
def stream_resume(spark, sf_dir):
    """A job that crashes with files left and starts again from its checkpoint, with more input, handles every row once."""
    rows = v.mail_rows_from(v.table(spark, sf_dir, "orders"))
    folder = new_folder(spark, "stream-resume")
    rows.where("line_no % 5 <> 4").repartition(4).write.parquet(f"{folder}/in")
    source = runner.files(spark, f"{folder}/in", rows.schema, per_trigger=1)
    checked = jobs.checked(source, v.disposable(spark))

    def crash(batch, batch_id):
        if batch_id == 2:
            raise RuntimeError("stopped with input left")
        return batch

    with suppress(StreamingQueryException):
        runner.finish(runner.to_batches(checked, f"{folder}/out", f"{folder}/checkpoint", crash))
    rows.where("line_no % 5 = 4").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    runner.finish(runner.to_batches(checked, f"{folder}/out", f"{folder}/checkpoint"))
    return runner.stored(spark, f"{folder}/out").groupBy("reason").agg(F.count("*").alias("rows"))


@query("stream_publish", "ST4 T10", sql(v.OUTBOX, v.PUBLISH_RESULTS, body="""
SELECT o.id, CASE WHEN NOT published AND attempts >= 5 THEN 'dead_letter' WHEN NOT published AND r.ok THEN 'published'
 WHEN NOT published AND NOT r.ok THEN 'failed' ELSE 'unchanged' END AS outcome
FROM outbox o LEFT JOIN (SELECT message_id, bool_or(ok) AS ok FROM publish_results GROUP BY 1) r ON r.message_id = o.id"""))
def stream_publish(spark, sf_dir):
    """Arriving messages are published; the broker's answers are a table."""
    messages = v.outbox_from(arriving(spark, sf_dir, "part"))
    results = v.publish_results_from(v.table(spark, sf_dir, "part"))
    out = _stored(
        spark, lambda o, c: jobs.publish(messages, lambda batch: results, v.AS_OF_2024, o, c), "stream-publish")
    return runner.stored(spark, out).select("id", "outcome")


@query("stream_poll", "ST4 T10 T17", sql(v.OUTBOX, """tries AS (SELECT id, attempts AS a0, last_error AS e0, (id % 6) IN (1, 4, 5) AS ok0,
  ((id + 1) % 6) IN (1, 4, 5) AS ok1,
  CASE WHEN id % 6 = 3 THEN 'nack 1' ELSE 'No answer from the broker in time' END AS e1,
  CASE WHEN (id + 1) % 6 = 3 THEN 'nack 1' ELSE 'No answer from the broker in time' END AS e2
 FROM outbox WHERE NOT published)""", body="""
SELECT CAST(id AS VARCHAR) AS id, CASE WHEN a0 >= 5 THEN 'dead_letter' WHEN ok0 THEN 'published' WHEN a0 + 1 >= 5 THEN 'dead_letter'
 WHEN ok1 THEN 'published' WHEN a0 + 2 >= 5 THEN 'dead_letter' ELSE 'sent' END AS outcome,
 CAST(CASE WHEN a0 >= 5 OR ok0 THEN a0 WHEN a0 + 1 >= 5 OR ok1 THEN a0 + 1 ELSE a0 + 2 END AS INT) AS attempts,
 CASE WHEN a0 >= 5 OR ok0 THEN e0 WHEN a0 + 1 >= 5 OR ok1 THEN e1 ELSE e2 END AS last_error FROM tries"""))
def stream_poll(spark, sf_dir):
    """Three polls a minute apart: answers arrive as a stream, unanswered and refused messages come back."""
    part, path = v.table(spark, sf_dir, "part"), new_folder(spark, "stream-poll")
    answers = v.broker_answers_from(part)
    for n in range(3):
        now = v.AS_OF_2024 + datetime.timedelta(minutes=n)
        if n:
            answers.where(F.col("poll") == n - 1).drop("poll").write.mode("append").parquet(f"{path}/answers")
            runner.finish(poll.confirm(runner.files(spark, f"{path}/answers", answers.drop("poll").schema), path, now))
        runner.finish(poll.send(v.outbox_from(arriving(spark, sf_dir, "part")), path, now))
    return poll.settled(spark, path).select("id", "outcome", "attempts", "last_error")


@query("stream_retry", "ST5", sql(v.JOB_FAILURES, body="""
SELECT mailing_id, 'dead_letter' AS outcome, 3 AS attempts, ts AS at FROM job_failures WHERE attempt >= 2 UNION ALL
SELECT mailing_id, 'redelivered', attempt + 1, due FROM (SELECT *,
  CASE WHEN attempt = 0 THEN ts + INTERVAL '60' SECOND ELSE ts + INTERVAL '300' SECOND END AS due FROM job_failures
  WHERE attempt < 2) WHERE due <= (SELECT max(ts) FROM job_failures)"""))
def stream_retry(spark, sf_dir):
    """Failed jobs come back when their wait is over; waits that outlast the input are still pending."""
    failures = v.job_failures_from(arriving(spark, sf_dir, "part")).select("mailing_id", "attempt", "ts")
    out = _stored(spark, lambda o, c: runner.to_files(timers.delayed_retry(failures), o, c), "stream-retry")
    return spark.read.parquet(out).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("stream_stale", "ST6", sql(v.SEND_ATTEMPTS, body="""
SELECT mailing_id, email, status, ts AS last_attempt FROM (SELECT *, row_number() OVER (PARTITION BY mailing_id, email
 ORDER BY ts DESC, event_id DESC) AS rn, CASE WHEN http_status BETWEEN 200 AND 299 THEN 'SENT' ELSE 'SENDING' END AS status
 FROM send_attempts) WHERE rn = 1 AND status = 'SENDING'
AND date_trunc('milliseconds', ts) + INTERVAL '300' SECOND <= (SELECT date_trunc('milliseconds', max(ts)) FROM send_attempts)
"""))
def stream_stale(spark, sf_dir):
    """Recipients whose last event left them in flight for longer than allowed."""
    attempts = v.send_attempts_from(arriving(spark, sf_dir, "events"))
    status = F.when(F.coalesce(F.col("http_status").between(200, 299), F.lit(False)), "SENT").otherwise("SENDING")
    events = attempts.select("mailing_id", "email", status.alias("status"), "ts", F.col("event_id").alias("seq"))
    out = _stored(spark, lambda o, c: runner.to_files(timers.in_flight_timeout(events), o, c), "stream-stale")
    return spark.read.parquet(out).select(
        "mailing_id", "email", "status", F.col("last_attempt").cast("timestamp_ntz").alias("last_attempt"))


@query("stream_counts", "ST7", sql(v.ENTRIES, body="""
SELECT mailing_id, status, count(*) AS count FROM entries GROUP BY mailing_id, status"""))
def stream_counts(spark, sf_dir):
    """Counts per mailing and status, kept up to date from status changes."""
    entries = v.entries_from(arriving(spark, sf_dir, "orders")).select(
        "mailing_id", "status", F.when(F.col("status") != "PENDING", "PENDING").alias("was"))
    first = entries.select("mailing_id", F.coalesce("was", "status").alias("status"))
    moved = entries.where(F.col("was").isNotNull())
    changes = jobs.status_changes(first).unionByName(jobs.status_changes(moved, "was"))
    counts = jobs.live_counts(changes)
    out = _stored(spark, lambda o, c: runner.to_batches(counts, o, c, mode="update"), "stream-counts")
    return jobs.latest_counts(runner.stored(spark, out))


@query("stream_rate", "ST8", sql(v.SEND_ATTEMPTS, body="""
SELECT date_trunc('minute', ts) AS minute, count(*) AS requests, count(*) > 6 AS over_limit FROM send_attempts
GROUP BY 1 HAVING date_trunc('minute', min(ts)) + INTERVAL '1' MINUTE <=
 (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL '10' MINUTE FROM send_attempts)"""))
def stream_rate(spark, sf_dir):
    """Requests of every closed minute."""
    counts = jobs.requests_per_minute(v.send_attempts_from(arriving(spark, sf_dir, "events")))
    out = _stored(spark, lambda o, c: runner.to_files(counts, o, c), "stream-rate")
    return spark.read.parquet(out)


@query("stream_replay", "ST9 P07", sql(v.SEND_ATTEMPTS, body="""
SELECT mailing_id, email, attempt, sha256(mailing_id || ':' || email || ':' || CAST(attempt AS VARCHAR))
 AS idempotency_key, CAST(1 AS BIGINT) AS n FROM (SELECT DISTINCT mailing_id, email, attempt FROM send_attempts)"""))
def stream_replay(spark, sf_dir):
    """All input handled again after a lost checkpoint, with other micro-batches: every command is stored once."""
    attempts = v.send_attempts_from(arriving(spark, sf_dir, "events"))
    folder = new_folder(spark, "stream-replay")
    half = jobs.outgoing(attempts.where("event_id % 2 = 0"))
    for commands, run in ((half, "first"), (jobs.outgoing(attempts), "again"), (jobs.outgoing(attempts), "again")):
        runner.finish(jobs.store_unseen(
            commands, f"{folder}/out", f"{folder}/checkpoint-{run}", on=["mailing_id", "email", "attempt"]))
    stored = runner.stored(spark, f"{folder}/out")
    return stored.groupBy("mailing_id", "email", "attempt", "idempotency_key").agg(F.count("*").alias("n"))


@query("stream_register", "ST9 T01", REGISTERED)
def stream_register(spark, sf_dir):
    """Uploads registered as they arrive, and all again after a lost checkpoint: one mailing and one message each."""
    folder = new_folder(spark, "stream-register")
    tables.commit(folder, "stored", mailings=v.mailings_from(v.table(spark, sf_dir, "part")))
    for run in ("first", "again"):
        uploads = v.uploads_from(arriving(spark, sf_dir, "customer"))
        runner.finish(jobs.register_uploads(uploads, folder, v.AS_OF_2024, f"{folder}/checkpoint-{run}"))
    rows = tables.read_committed(spark, folder, "mailings").where(F.col("run") != "stored")
    return registered(rows, tables.read_committed(spark, folder, "outbox_messages"))


@query("stream_watch", "ST1 S09", sql(v.CHECKED, body="""
SELECT CASE WHEN email IS NULL OR email = '' THEN NULL ELSE email END AS email, is_valid, reason, 'checked' AS part, count(*) AS n
FROM checked WHERE line_no % 3 <> 2 GROUP BY ALL UNION ALL
SELECT NULL, NULL, NULL, 'archived', count(*) FROM checked WHERE line_no % 3 = 0 UNION ALL
SELECT NULL, NULL, NULL, 'rejected', count(*) FROM checked WHERE line_no % 3 = 1"""))
def stream_watch(spark, sf_dir):
    """Files dropped into a folder in two parts, the second with rows that have a cell too few; the first files are archived
    when the second ones come."""
    folder = new_folder(spark, "stream-watch")
    rows = v.mail_rows_from(v.table(spark, sf_dir, "orders")).select(
        F.col("raw_email").alias("email"), F.concat_ws(" ", F.lit("Zoë"), "mailing_id").alias("name"), "line_no")
    v.disposable(spark).write.parquet(f"{folder}/domains")
    cells = {0: ["email", "name", F.col("line_no").cast("string").alias("line")], 1: ["email", "name"]}
    for part in (0, 1):
        rows.where(F.col("line_no") % 3 == part).select(*cells[part]).write.mode("append").option("header", True).csv(f"{folder}/in")
        runner.finish(jobs.watch(
            spark, f"{folder}/in", ["email", "name", "line"], f"{folder}/archive", f"{folder}/out", f"{folder}/checkpoint",
            lambda s: s.read.parquet(f"{folder}/domains")))
    found = runner.stored(spark, f"{folder}/out/checked").groupBy("email", "is_valid", "reason").agg(F.count("*").alias("n"))
    out = found.select("email", "is_valid", "reason", F.lit("checked").alias("part"), "n")
    kept = spark.read.option("recursiveFileLookup", True).option("header", True).csv(f"{folder}/archive")
    counts = kept.agg(F.count("*").alias("n")).select(F.lit("archived").alias("part"), "n").unionByName(
        runner.stored(spark, f"{folder}/out/rejected").agg(F.count("*").alias("n")).select(F.lit("rejected").alias("part"), "n"))
    return out.unionByName(counts, allowMissingColumns=True)

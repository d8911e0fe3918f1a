"""Mailing data derived from the test tables: as DataFrames for Spark, and as SQL text for the comparison engine."""

import datetime

from pyspark.sql import functions as F

# One fixed moment stands for "now" in all queries.
AS_OF = datetime.datetime(1998, 1, 1)
AS_OF_SQL = "TIMESTAMP '1998-01-01 00:00:00'"
# Mailings and messages of the test data are dated 2024.
AS_OF_2024 = datetime.datetime(2024, 1, 2)
AS_OF_2024_SQL = "TIMESTAMP '2024-01-02 00:00:00'"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _num(name):
    return F.col(name).cast("string")


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _minutes(c):
    return F.make_dt_interval(mins=c.cast("int"))


def mail_rows_from(orders):
    cust, seven, fifty = F.col("o_custkey"), F.col("o_custkey") % 7, F.col("o_custkey") % 50
    kind = F.col("o_orderkey") % 12
    raw = (
        F.when(kind == 0, _text("  User", cust, "@Mail", seven, ".Example.COM "))
        .when(kind == 1, _text("user", cust, "@tempmail.com"))
        .when(kind == 2, _text("invalid-email", fifty))
        .when(kind == 3, _text("bad", fifty, "@@email.com"))
        .when(kind == 4, _text("@domain", fifty, ".com"))
        .when(kind == 5, "")
        .when(kind == 6, F.lit(None))
        .when(kind == 7, _text("user", cust, "@nodot"))
        .otherwise(_text("user", cust, "@mail", seven, ".example.com"))
    )
    return orders.select(
        F.col("o_orderkey").alias("line_no"), _text("m", cust % 10).alias("mailing_id"), raw.alias("raw_email"))


def entries_from(orders):
    key, state = F.col("o_orderkey"), F.col("o_orderstatus")
    status = (
        F.when(state == "O", "PENDING").when((state == "P") & (key % 5 == 0), "INVALID").when(state == "P", "SENDING")
        .when(key % 10 == 0, "FAILED").otherwise("SENT")
    )
    return orders.select(
        key.alias("id"), _text("m", F.col("o_custkey") % 10).alias("mailing_id"),
        _text("user", key, "@mail", F.col("o_custkey") % 7, ".example.com").alias("email"),
        status.alias("status"), (key % 4).cast("int").alias("attempts"),
        F.when(state != "O", F.col("o_orderdate") + _minutes(key % 90)).alias("last_attempt"),
        F.col("o_orderdate").alias("created_at"),
    )


def send_attempts_from(events):
    event, kind = F.col("event_id"), F.col("event_type")

    def pick(c, values):
        """The c-th value, counted from 0, of a constant list."""
        return F.element_at(F.array(*[F.lit(x) for x in values]), (c + 1).cast("int"))

    status = (
        F.when(kind == "purchase", 200).when(kind == "signup", 202).when(kind == "click", 429)
        .when(kind == "view", pick(event % 4, (500, 502, 503, 504)))
        .otherwise(pick(event % 8, (400, 401, 403, 404, 408, 422, None, 302)))
    )
    error = F.when(
        (kind == "error") & (event % 8 == 6),
        pick(event % 3, ("connect ECONNREFUSED", "timeout of 30000ms exceeded", "socket hang up")))
    return events.select(
        "event_id", "ts", _text("m", F.col("user_id") % 10).alias("mailing_id"),
        _text("user", F.col("user_id"), "@mail", F.col("user_id") % 7, ".example.com").alias("email"),
        (event % 4 + 1).cast("int").alias("attempt"), status.cast("int").alias("http_status"), error.alias("error"),
        F.col("value").alias("duration_s"),
    )


START_2024 = datetime.datetime(2024, 1, 1)


def mailings_from(part):
    key, size = F.col("p_partkey"), F.col("p_size")
    status = (
        F.when(size % 5 == 0, "PENDING").when(size % 5 == 1, "QUEUED").when(size % 5 == 2, "PROCESSING")
        .when(size % 5 == 3, "COMPLETED").otherwise("FAILED")
    )
    return part.select(
        key.alias("id"), _text("file", key, ".csv").alias("filename"),
        F.when(key % 13 != 0, _text("/storage/file", key, ".csv")).alias("storage_url"), status.alias("status"),
        (size * 10).alias("total_lines"),
        F.when(size % 5 == 3, size * 10).otherwise(size * 4).alias("processed_lines"),
        (F.lit(START_2024).cast("timestamp_ntz") + _minutes(key)).alias("created_at"),
    )


def outbox_from(part):
    key, k = F.col("p_partkey"), F.col("k")
    rows = part.where(key % 4 != 0).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    return rows.select(
        (key * 10 + k).alias("id"), key.alias("mailing_id"), F.lit("mailing.jobs.process").alias("target_queue"),
        ((key + k) % 7).cast("int").alias("attempts"), ((key + k) % 3 != 0).alias("published"),
        F.when((key + k) % 7 > 0, "broker unavailable").alias("last_error"),
        (F.lit(START_2024).cast("timestamp_ntz") + _minutes(key * 2 + k)).alias("created_at"),
        _text('{"mailingId":"', key, '","filename":"file', key, '.csv","attempt":', k, "}").alias("payload"),
    )


def lifecycle_from(part):
    """Mailings with the columns that claims and recovery look at."""
    key = F.col("id")
    return mailings_from(part).withColumns({
        "last_attempt": F.when(key % 3 != 0, F.lit(AS_OF_2024).cast("timestamp_ntz") - F.make_dt_interval(
            secs=(key % 90).cast("decimal(18,6)"))),
        "updated_at": F.lit(AS_OF_2024).cast("timestamp_ntz") - F.make_dt_interval(
            secs=(key % 900).cast("decimal(18,6)")),
    })


def progress_from(part):
    """Legacy progress rows of the mailings."""
    key, size = F.col("p_partkey"), F.col("p_size")
    status = F.when(size % 4 == 0, "RUNNING").when(size % 4 == 1, "PAUSED").when(size % 4 == 2, "COMPLETED").otherwise(
        "FAILED")
    return part.select(
        _text("m", key).alias("mailing_id"), (size * 100).alias("total_rows"), (size * 37).alias("processed_rows"),
        (size * 40).alias("last_processed_line"), status.alias("status"),
        (F.lit(START_2024).cast("timestamp_ntz") + _minutes(key)).alias("created_at"),
        (F.lit(AS_OF_2024).cast("timestamp_ntz") - F.make_dt_interval(secs=(key % 900).cast("decimal(18,6)"))).alias(
            "updated_at"),
    )


def publish_results_from(part):
    """Broker answers to the unpublished messages; every fifth message has two answers."""
    rows = outbox_from(part).where(~F.col("published"))
    seqs = F.when(F.col("id") % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = rows.withColumn("seq", F.explode(seqs))
    ok = (F.col("id") + F.col("seq")) % 4 != 0
    return rows.select(
        F.col("id").alias("message_id"), "seq", ok.alias("ok"),
        F.when(~ok, _text("nack ", F.col("seq"))).alias("error"))


def broker_answers_from(part):
    """Broker answers to the first and second try of the unpublished messages, a minute apart: none, a refusal and then a
    success, a success after the time limit, a refusal, two successes, or one."""
    rows = outbox_from(part).where(~F.col("published")).withColumn("poll", F.explode(F.array(F.lit(0), F.lit(1))))
    kind = (F.col("id") + F.col("poll")) % 6

    def answers(*given):
        return F.array(*[F.struct(F.lit(seq).alias("seq"), F.lit(ok).alias("ok"), F.lit(wait).alias("wait"))
                         for seq, ok, wait in given])

    given = (
        F.when(kind == 1, answers((1, False, 5), (2, True, 10))).when(kind == 2, answers((1, True, 45)))
        .when(kind == 3, answers((1, False, 5))).when(kind == 4, answers((1, True, 5), (2, True, 6)))
        .when(kind == 5, answers((1, True, 20)))
    )
    seconds = (F.col("poll") * 60 + F.col("a.wait")).cast("decimal(18,6)")
    return rows.withColumn("a", F.explode(given)).select(
        F.col("id").alias("message_id"), (F.col("attempts") + F.col("poll")).alias("attempt"), "a.seq", "a.ok",
        F.when(~F.col("a.ok"), _text("nack ", F.col("a.seq"))).alias("error"),
        (F.lit(AS_OF_2024).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)).cast("timestamp").alias("answered_at"),
        "poll")


def job_failures_from(part):
    """Failed processing jobs with their attempt counter."""
    key = F.col("p_partkey")
    return part.select(
        _text("m", key).alias("mailing_id"), _text("file", key, ".csv").alias("filename"),
        (key % 4).cast("int").alias("attempt"),
        (F.lit(START_2024).cast("timestamp_ntz") + _minutes(key)).alias("ts"),
        F.when(key % 5 != 0, F.lit("Failure rate 30.0% exceeds threshold")).alias("error"),
        _text('{"mailingId":"m', key, '","filename":"file', key, '.csv","attempt":', key % 4, "}").alias("payload"),
    )


def outcomes_from(events):
    """Send results as upserts: status, external id and reason per attempt."""
    a = send_attempts_from(events)
    sent = F.col("http_status").between(200, 299)
    return a.select(
        "event_id", "ts", "mailing_id", "email", _text("t", F.col("event_id")).alias("token"),
        F.when(F.coalesce(sent, F.lit(False)), "SENT").otherwise("FAILED").alias("status"),
        F.when(sent, _text("msg-", F.col("event_id"))).alias("external_id"),
        F.when(~F.coalesce(sent, F.lit(False)), _text(
            "delivery failed with a long explanation for status ", F.coalesce(F.col("http_status"), F.lit(0)))
        ).alias("reason"),
    )


def known_recipients_from(events):
    """Stored entries that the outcomes partly meet: the recipients of every second event."""
    a = send_attempts_from(events).where(F.col("event_id") % 2 == 0)
    per = a.groupBy("mailing_id", "email").agg(
        F.min("event_id").alias("id"), F.min("ts").alias("created_at"), F.max("ts").alias("last_attempt"))
    key = F.col("id")
    return per.select(
        key.cast("string").alias("id"), "mailing_id", "email", _text("old", key).alias("token"),
        F.when(key % 3 == 0, "FAILED").otherwise("SENDING").alias("status"), (key % 4).cast("int").alias("attempts"),
        "last_attempt", F.when(key % 4 == 0, _text("ext-", key)).alias("external_id"),
        F.when(key % 3 == 0, "earlier reason").alias("invalid_reason"),
        F.lit(None).cast("string").alias("validation_details"), "created_at",
        F.col("created_at").alias("updated_at"),
    )


def disposable(spark):
    return spark.sql("SELECT * FROM VALUES ('10minutemail.com'), ('tempmail.com'), ('guerrillamail.com') AS t(domain)")


def domain_mx(spark):
    """mail0 to mail5 are known; mail6 is absent."""
    return spark.range(6).select(_text("mail", F.col("id"), ".example.com").alias("domain"),
                                 (F.col("id") % 3 != 0).alias("has_mx"))


def uploads_from(customer):
    """Files offered for registration: some with a wrong type, some already registered, some offered twice."""
    key = F.col("c_custkey")
    ending = F.when(key % 4 == 0, ".CSV").when(key % 4 == 1, ".txt").otherwise(".csv")
    number = F.when(key % 6 == 0, key - 1).otherwise(key) * 3
    return customer.select(
        _text("u", key).alias("id"), F.concat(F.lit("file"), number.cast("string"), ending).alias("filename"),
        _text("/storage/u", key).alias("storage_url"), (key % 500).cast("int").alias("total_lines"))


# --- the same data as SQL -------------------------------------------------------------------------------------------

MAIL_ROWS = """mail_rows AS (SELECT o_orderkey AS line_no, 'm' || CAST(o_custkey % 10 AS VARCHAR) AS mailing_id,
 CASE o_orderkey % 12
  WHEN 0 THEN '  User' || CAST(o_custkey AS VARCHAR) || '@Mail' || CAST(o_custkey % 7 AS VARCHAR) || '.Example.COM '
  WHEN 1 THEN 'user' || CAST(o_custkey AS VARCHAR) || '@tempmail.com'
  WHEN 2 THEN 'invalid-email' || CAST(o_custkey % 50 AS VARCHAR)
  WHEN 3 THEN 'bad' || CAST(o_custkey % 50 AS VARCHAR) || '@@email.com'
  WHEN 4 THEN '@domain' || CAST(o_custkey % 50 AS VARCHAR) || '.com'
  WHEN 5 THEN ''
  WHEN 6 THEN NULL
  WHEN 7 THEN 'user' || CAST(o_custkey AS VARCHAR) || '@nodot'
  ELSE 'user' || CAST(o_custkey AS VARCHAR) || '@mail' || CAST(o_custkey % 7 AS VARCHAR) || '.example.com'
 END AS raw_email FROM orders)"""

ADDRESS_PATTERN = (
    r"^[a-z0-9!#$%&''*+/=?^_`{|}~-]+([.][a-z0-9!#$%&''*+/=?^_`{|}~-]+)*"
    r"@([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?[.])+[a-z]{2,63}$"
)

# Needs mail_rows; adds the normalised address, syntax detail and the three layers.
CHECKED = MAIL_ROWS + f""",
normal AS (SELECT line_no, mailing_id, raw_email,
  CASE WHEN raw_email <> '' THEN lower(regexp_replace(raw_email, '^\\s+|\\s+$', '', 'g')) END AS email
  FROM mail_rows),
syntaxed AS (SELECT *, lower(split_part(email, '@', 2)) AS domain,
  CASE WHEN email IS NULL THEN 'Email is empty or not a string'
   WHEN email = '' THEN 'Email is empty'
   WHEN NOT regexp_matches(email, '{ADDRESS_PATTERN}') THEN 'Invalid email syntax'
   WHEN length(split_part(email, '@', 1)) > 64 THEN 'Local part exceeds 64 characters'
   WHEN length(split_part(email, '@', 2)) > 255 THEN 'Domain exceeds 255 characters' END AS syntax_detail
  FROM normal),
checked AS (SELECT line_no, mailing_id, raw_email, email, domain, syntax_detail,
  syntax_detail IS NULL AND (domain IS NULL OR domain NOT IN ('10minutemail.com','tempmail.com','guerrillamail.com'))
   AS is_valid,
  CASE WHEN syntax_detail IS NOT NULL THEN 'syntax'
   WHEN domain IN ('10minutemail.com','tempmail.com','guerrillamail.com') THEN 'disposable' END AS reason,
  CASE WHEN syntax_detail IS NOT NULL THEN syntax_detail
   WHEN domain IN ('10minutemail.com','tempmail.com','guerrillamail.com')
   THEN 'Disposable email domain: ' || domain END AS details
  FROM syntaxed)"""

ENTRIES = """entries AS (SELECT o_orderkey AS id, 'm' || CAST(o_custkey % 10 AS VARCHAR) AS mailing_id,
 'user' || CAST(o_orderkey AS VARCHAR) || '@mail' || CAST(o_custkey % 7 AS VARCHAR) || '.example.com' AS email,
 CASE WHEN o_orderstatus = 'O' THEN 'PENDING' WHEN o_orderstatus = 'P' AND o_orderkey % 5 = 0 THEN 'INVALID'
  WHEN o_orderstatus = 'P' THEN 'SENDING' WHEN o_orderkey % 10 = 0 THEN 'FAILED' ELSE 'SENT' END AS status,
 CAST(o_orderkey % 4 AS INT) AS attempts,
 CASE WHEN o_orderstatus = 'O' THEN NULL
  ELSE o_orderdate + CAST(o_orderkey % 90 AS INT) * INTERVAL '1' MINUTE END AS last_attempt,
 o_orderdate AS created_at FROM orders)"""

SEND_ATTEMPTS = """send_attempts AS (SELECT event_id, ts, 'm' || CAST(user_id % 10 AS VARCHAR) AS mailing_id,
 'user' || CAST(user_id AS VARCHAR) || '@mail' || CAST(user_id % 7 AS VARCHAR) || '.example.com' AS email,
 CAST(event_id % 4 + 1 AS INT) AS attempt,
 CASE event_type WHEN 'purchase' THEN 200 WHEN 'signup' THEN 202 WHEN 'click' THEN 429
  WHEN 'view' THEN CASE event_id % 4 WHEN 0 THEN 500 WHEN 1 THEN 502 WHEN 2 THEN 503 ELSE 504 END
  ELSE CASE event_id % 8 WHEN 0 THEN 400 WHEN 1 THEN 401 WHEN 2 THEN 403 WHEN 3 THEN 404 WHEN 4 THEN 408
   WHEN 5 THEN 422 WHEN 6 THEN NULL ELSE 302 END END AS http_status,
 CASE WHEN event_type = 'error' AND event_id % 8 = 6 THEN
  CASE event_id % 3 WHEN 0 THEN 'connect ECONNREFUSED' WHEN 1 THEN 'timeout of 30000ms exceeded'
   ELSE 'socket hang up' END END AS error,
 value AS duration_s FROM events)"""

MAILINGS = """mailings AS (SELECT p_partkey AS id, 'file' || CAST(p_partkey AS VARCHAR) || '.csv' AS filename,
 CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE '/storage/file' || CAST(p_partkey AS VARCHAR) || '.csv' END AS storage_url,
 CASE p_size % 5 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'QUEUED' WHEN 2 THEN 'PROCESSING' WHEN 3 THEN 'COMPLETED'
  ELSE 'FAILED' END AS status,
 p_size * 10 AS total_lines, CASE WHEN p_size % 5 = 3 THEN p_size * 10 ELSE p_size * 4 END AS processed_lines,
 TIMESTAMP '2024-01-01 00:00:00' + CAST(p_partkey AS INT) * INTERVAL '1' MINUTE AS created_at FROM part)"""

OUTBOX = """outbox AS (SELECT p_partkey * 10 + k AS id, p_partkey AS mailing_id, 'mailing.jobs.process' AS target_queue,
 CAST((p_partkey + k) % 7 AS INT) AS attempts, (p_partkey + k) % 3 <> 0 AS published,
 CASE WHEN (p_partkey + k) % 7 > 0 THEN 'broker unavailable' END AS last_error,
 TIMESTAMP '2024-01-01 00:00:00' + CAST(p_partkey * 2 + k AS INT) * INTERVAL '1' MINUTE AS created_at,
 '{"mailingId":"' || CAST(p_partkey AS VARCHAR) || '","filename":"file' || CAST(p_partkey AS VARCHAR)
  || '.csv","attempt":' || CAST(k AS VARCHAR) || '}' AS payload
 FROM part CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) x WHERE p_partkey % 4 <> 0)"""

LIFECYCLE = MAILINGS + f""",
lifecycle AS (SELECT *, CASE WHEN id % 3 <> 0 THEN {AS_OF_2024_SQL} - CAST(id % 90 AS INT) * INTERVAL '1' SECOND END
  AS last_attempt, {AS_OF_2024_SQL} - CAST(id % 900 AS INT) * INTERVAL '1' SECOND AS updated_at FROM mailings)"""

PROGRESS = f"""progress AS (SELECT 'm' || CAST(p_partkey AS VARCHAR) AS mailing_id, p_size * 100 AS total_rows,
 p_size * 37 AS processed_rows, p_size * 40 AS last_processed_line,
 CASE p_size % 4 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'PAUSED' WHEN 2 THEN 'COMPLETED' ELSE 'FAILED' END AS status,
 TIMESTAMP '2024-01-01 00:00:00' + CAST(p_partkey AS INT) * INTERVAL '1' MINUTE AS created_at,
 {AS_OF_2024_SQL} - CAST(p_partkey % 900 AS INT) * INTERVAL '1' SECOND AS updated_at FROM part)"""

# Needs outbox.
PUBLISH_RESULTS = """publish_results AS (SELECT id AS message_id, seq, (id + seq) % 4 <> 0 AS ok,
 CASE WHEN (id + seq) % 4 = 0 THEN 'nack ' || CAST(seq AS VARCHAR) END AS error
 FROM outbox CROSS JOIN (SELECT 1 AS seq UNION ALL SELECT 2) s
 WHERE NOT published AND (seq = 1 OR id % 5 = 0))"""

JOB_FAILURES = """job_failures AS (SELECT 'm' || CAST(p_partkey AS VARCHAR) AS mailing_id,
 'file' || CAST(p_partkey AS VARCHAR) || '.csv' AS filename, CAST(p_partkey % 4 AS INT) AS attempt,
 TIMESTAMP '2024-01-01 00:00:00' + CAST(p_partkey AS INT) * INTERVAL '1' MINUTE AS ts,
 CASE WHEN p_partkey % 5 <> 0 THEN 'Failure rate 30.0% exceeds threshold' END AS error FROM part)"""

# Needs send_attempts.
OUTCOMES = """outcomes AS (SELECT event_id, ts, mailing_id, email, 't' || CAST(event_id AS VARCHAR) AS token,
 CASE WHEN http_status BETWEEN 200 AND 299 THEN 'SENT' ELSE 'FAILED' END AS status,
 CASE WHEN http_status BETWEEN 200 AND 299 THEN 'msg-' || CAST(event_id AS VARCHAR) END AS external_id,
 CASE WHEN coalesce(http_status, 0) NOT BETWEEN 200 AND 299
  THEN 'delivery failed with a long explanation for status ' || CAST(coalesce(http_status, 0) AS VARCHAR) END AS reason
 FROM send_attempts)"""

KNOWN = """known AS (SELECT CAST(min(event_id) AS VARCHAR) AS id, mailing_id, email,
 'old' || CAST(min(event_id) AS VARCHAR) AS token,
 CASE WHEN min(event_id) % 3 = 0 THEN 'FAILED' ELSE 'SENDING' END AS status,
 CAST(min(event_id) % 4 AS INT) AS attempts, max(ts) AS last_attempt,
 CASE WHEN min(event_id) % 4 = 0 THEN 'ext-' || CAST(min(event_id) AS VARCHAR) END AS external_id,
 CASE WHEN min(event_id) % 3 = 0 THEN 'earlier reason' END AS invalid_reason, min(ts) AS created_at
 FROM send_attempts WHERE event_id % 2 = 0 GROUP BY mailing_id, email)"""

UPLOADS = """uploads AS (SELECT 'u' || CAST(c_custkey AS VARCHAR) AS id,
 'file' || CAST(CASE WHEN c_custkey % 6 = 0 THEN c_custkey - 1 ELSE c_custkey END * 3 AS VARCHAR) ||
  CASE c_custkey % 4 WHEN 0 THEN '.CSV' WHEN 1 THEN '.txt' ELSE '.csv' END AS filename,
 '/storage/u' || CAST(c_custkey AS VARCHAR) AS storage_url, CAST(c_custkey % 500 AS INT) AS total_lines
 FROM customer)"""

# Needs send_attempts. The error classes in the order in which they apply.
CLASSIFIED = """classified AS (SELECT *,
 coalesce(http_status BETWEEN 200 AND 299, false) AS success,
 CASE WHEN coalesce(http_status, 0) = 0 THEN
   CASE WHEN regexp_matches(coalesce(error, ''), 'ECONNREFUSED|ENOTFOUND|ETIMEDOUT|network') THEN 'network'
    WHEN contains(coalesce(error, ''), 'timeout') THEN 'timeout' ELSE 'unknown' END
  WHEN http_status = 408 THEN 'timeout' WHEN http_status = 429 THEN 'rate_limit'
  WHEN http_status BETWEEN 400 AND 499 THEN 'client_error' WHEN http_status BETWEEN 500 AND 599 THEN 'server_error'
  ELSE 'unknown' END AS category,
 CASE WHEN coalesce(http_status, 0) = 0 THEN
   CASE WHEN regexp_matches(coalesce(error, ''), 'ECONNREFUSED|ENOTFOUND|ETIMEDOUT|network')
     THEN 'Network error - connection failed'
    WHEN contains(coalesce(error, ''), 'timeout') THEN 'Request timeout' ELSE 'Unknown error - will retry' END
  WHEN http_status = 400 THEN '400 Bad Request - invalid request format'
  WHEN http_status = 401 THEN '401 Unauthorized - invalid credentials'
  WHEN http_status = 403 THEN '403 Forbidden - access denied'
  WHEN http_status = 404 THEN '404 Not Found - resource does not exist'
  WHEN http_status = 408 THEN '408 Request Timeout'
  WHEN http_status = 422 THEN '422 Unprocessable Entity - validation failed'
  WHEN http_status = 429 THEN '429 Too Many Requests - rate limit exceeded'
  WHEN http_status BETWEEN 400 AND 499 THEN CAST(http_status AS VARCHAR) || ' Client Error - permanent failure'
  WHEN http_status = 500 THEN '500 Internal Server Error'
  WHEN http_status = 502 THEN '502 Bad Gateway'
  WHEN http_status = 503 THEN '503 Service Unavailable'
  WHEN http_status = 504 THEN '504 Gateway Timeout'
  WHEN http_status BETWEEN 500 AND 599 THEN CAST(http_status AS VARCHAR) || ' Server Error - temporary failure'
  WHEN http_status BETWEEN 200 AND 299 THEN CAST(http_status AS VARCHAR) || ' Success - not an error'
  ELSE CAST(http_status AS VARCHAR) || ' Unknown status - will retry' END AS class_reason,
 NOT coalesce((http_status BETWEEN 200 AND 299) OR (http_status BETWEEN 400 AND 499 AND http_status NOT IN (408, 429)),
  false) AS retryable FROM send_attempts),
decided AS (SELECT *, NOT success AND retryable AND attempt < 3 AS should_retry,
 NOT success AND NOT (retryable AND attempt < 3) AS move_to_dlq,
 CASE WHEN success THEN NULL
  WHEN NOT retryable THEN 'Permanent error - ' || class_reason
  WHEN attempt >= 3 THEN 'Max retries exceeded (' || CAST(attempt AS VARCHAR) || '/3) - ' || class_reason
  ELSE 'Retryable error (attempt ' || CAST(attempt AS VARCHAR) || '/3) - ' || class_reason END AS reason,
 CASE WHEN NOT success AND retryable AND attempt < 3
  THEN CAST(least(1000 * pow(2, attempt - 1), 300000) AS BIGINT) END AS delay_ms FROM classified)"""


def sql(*views, body):
    """One statement from view texts and a final select."""
    return "WITH " + ",\n".join(views) + "\n" + body

"""Queries on stale work, claims, progress upkeep and removal."""

from pyspark.sql import functions as F

from postmill.operators import lookups as L, recovery as C
from postmill.plans import views as v
from postmill.plans.reading import dead_letters_of, entries_of, progress_of, DEAD
from postmill.plans.registry import query
from postmill.plans.views import AS_OF_2024_SQL, AS_OF_SQL, sql

STALE = f"status = 'SENDING' AND last_attempt < {AS_OF_SQL} - INTERVAL '300' SECOND"
CLAIMABLE = f"""(status IN ('PENDING', 'QUEUED', 'FAILED') OR (status = 'PROCESSING'
 AND (last_attempt IS NULL OR last_attempt < {AS_OF_2024_SQL} - INTERVAL '30' SECOND)))"""


def lifecycle_of(spark, sf_dir):
    return v.lifecycle_from(v.table(spark, sf_dir, "part"))


@query("stale_entries", "F04", sql(v.ENTRIES, body=f"""
SELECT id, mailing_id, email, last_attempt FROM entries WHERE {STALE}"""))
def stale_entries(spark, sf_dir):
    return L.stale_entries(entries_of(spark, sf_dir), v.AS_OF).select("id", "mailing_id", "email", "last_attempt")


STALE_WORK = f"""stale_work AS (SELECT 'mailings' AS source, CAST(id AS VARCHAR) AS mailing_id, status, updated_at
 FROM lifecycle WHERE status = 'PROCESSING' AND updated_at < {AS_OF_2024_SQL} - INTERVAL '300' SECOND UNION ALL
SELECT 'mailing_progress', mailing_id, status, updated_at FROM progress WHERE status = 'RUNNING'
 AND updated_at < {AS_OF_2024_SQL} - INTERVAL '300' SECOND)"""


@query("stale_mailings", "F05 U01", sql(v.LIFECYCLE, v.PROGRESS, STALE_WORK, body="SELECT * FROM stale_work"))
def stale_mailings(spark, sf_dir):
    return L.stale_work(lifecycle_of(spark, sf_dir), progress_of(spark, sf_dir), v.AS_OF_2024)


@query("claimable_mailings", "F06", sql(v.LIFECYCLE, body=f"""
SELECT id, status, last_attempt, {CLAIMABLE} AS claimable FROM lifecycle"""))
def claimable_mailings(spark, sf_dir):
    rows = lifecycle_of(spark, sf_dir)
    return rows.select("id", "status", "last_attempt", L.claimable(v.AS_OF_2024).alias("claimable"))


@query("claim_step", "T07", sql(v.LIFECYCLE, v.OUTBOX, body=f"""
SELECT id, asked AND ok AS claimed, CASE WHEN asked AND ok THEN 'PROCESSING' ELSE status END AS status,
 CASE WHEN asked AND ok THEN {AS_OF_2024_SQL} ELSE last_attempt END AS last_attempt FROM
 (SELECT id, status, last_attempt, {CLAIMABLE} AS ok, id IN (SELECT mailing_id FROM outbox) AS asked FROM lifecycle)"""))
def claim_step(spark, sf_dir):
    """Every message asks for its mailing; mailings with two messages are asked for twice."""
    wanted = v.outbox_from(v.table(spark, sf_dir, "part")).select(F.col("mailing_id").alias("id"))
    return C.claim(lifecycle_of(spark, sf_dir), wanted, v.AS_OF_2024).select("id", "claimed", "status", "last_attempt")


@query("recovery_step", "T11", sql(v.ENTRIES, body=f"""
SELECT id, coalesce({STALE}, false) AS recovered, CASE WHEN {STALE} THEN 'PENDING' ELSE status END AS status,
 last_attempt FROM entries"""))
def recovery_step(spark, sf_dir):
    return C.recover_entries(entries_of(spark, sf_dir), v.AS_OF).select("id", "recovered", "status", "last_attempt")


@query("recover_mailings", "T11", sql(v.LIFECYCLE, v.PROGRESS, body=f"""
SELECT 'mailings' AS source, CAST(id AS VARCHAR) AS mailing_id, status, stale AS recovered,
 CASE WHEN NOT stale THEN last_attempt END AS last_attempt FROM (SELECT *, status = 'PROCESSING'
  AND updated_at < {AS_OF_2024_SQL} - INTERVAL '300' SECOND AS stale FROM lifecycle)
UNION ALL SELECT 'mailing_progress', mailing_id, CASE WHEN stale THEN 'PAUSED' ELSE status END, stale,
 CAST(NULL AS TIMESTAMP) FROM (SELECT *, status = 'RUNNING'
  AND updated_at < {AS_OF_2024_SQL} - INTERVAL '300' SECOND AS stale FROM progress)"""))
def recover_mailings(spark, sf_dir):
    one = C.recover_mailings(lifecycle_of(spark, sf_dir), v.AS_OF_2024).select(
        F.lit("mailings").alias("source"), F.col("id").cast("string").alias("mailing_id"), "status", "recovered",
        "last_attempt")
    two = C.recover_progress(progress_of(spark, sf_dir), v.AS_OF_2024).select(
        F.lit("mailing_progress").alias("source"), "mailing_id", "status", "recovered",
        F.lit(None).cast("timestamp_ntz").alias("last_attempt"))
    return one.unionByName(two)


@query("recovery_report", "A21", sql(v.ENTRIES, v.LIFECYCLE, v.PROGRESS, STALE_WORK, body=f"""
SELECT jobs AS stale_jobs_found, jobs AS stale_jobs_recovered, work AS stale_mailings_found,
 work AS stale_mailings_recovered, jobs > 0 OR work > 0 AS needs_recovery FROM
 (SELECT (SELECT count(*) FROM entries WHERE status = 'SENDING' AND last_attempt < {AS_OF_2024_SQL}
   - INTERVAL '300' SECOND) AS jobs, (SELECT count(*) FROM stale_work) AS work)"""))
def recovery_report(spark, sf_dir):
    return C.recovery_report(
        entries_of(spark, sf_dir), lifecycle_of(spark, sf_dir), progress_of(spark, sf_dir), v.AS_OF_2024)


REFRESHED = """refreshed AS (SELECT mailing_id, CAST(count(*) AS INT) AS total_rows,
 CAST(count(*) FILTER (WHERE status IN ('SENT', 'FAILED')) AS INT) AS processed_rows, CASE WHEN count(*) FILTER (WHERE status IN ('SENT', 'FAILED'))
 = count(*) THEN 'COMPLETED' ELSE 'RUNNING' END AS status FROM entries GROUP BY mailing_id)"""


@query("progress_refresh", "T13 T04", sql(v.ENTRIES, v.PROGRESS, REFRESHED, body=f"""
SELECT coalesce(p.mailing_id, r.mailing_id) AS mailing_id, coalesce(r.total_rows, p.total_rows) AS total_rows,
 coalesce(r.processed_rows, p.processed_rows) AS processed_rows,
 coalesce(r.processed_rows, p.last_processed_line) AS last_processed_line, coalesce(r.status, p.status) AS status,
 coalesce(p.created_at, {AS_OF_2024_SQL}) AS created_at,
 CASE WHEN r.mailing_id IS NOT NULL THEN {AS_OF_2024_SQL} ELSE p.updated_at END AS updated_at
FROM progress p FULL JOIN refreshed r ON r.mailing_id = p.mailing_id"""))
def progress_refresh(spark, sf_dir):
    return C.progress_upsert(
        progress_of(spark, sf_dir), C.refreshed_progress(entries_of(spark, sf_dir)), v.AS_OF_2024)


@query("progress_complete", "T04", sql(v.ENTRIES, v.PROGRESS, body="""
SELECT coalesce(p.mailing_id, e.mailing_id) AS mailing_id, coalesce(e.n, p.total_rows) AS total_rows,
 coalesce(e.n, p.processed_rows) AS processed_rows, coalesce(p.last_processed_line, e.n) AS last_processed_line,
 CASE WHEN e.n IS NOT NULL THEN 'COMPLETED' ELSE p.status END AS status FROM progress p FULL JOIN
 (SELECT mailing_id, CAST(count(*) AS INT) AS n FROM entries GROUP BY mailing_id) e ON e.mailing_id = p.mailing_id"""))
def progress_complete(spark, sf_dir):
    totals = entries_of(spark, sf_dir).groupBy("mailing_id").agg(F.count("*").alias("total_rows")).withColumn(
        "status", F.lit("COMPLETED"))
    return C.complete(progress_of(spark, sf_dir), totals, v.AS_OF_2024).select(
        "mailing_id", "total_rows", "processed_rows", "last_processed_line", "status")


@query("purge", "T14", sql(v.ENTRIES, v.MAILINGS, v.OUTBOX, v.PROGRESS, v.SEND_ATTEMPTS, v.CLASSIFIED, DEAD,
                           """gone AS (SELECT mailing_id FROM progress WHERE status = 'FAILED')""", body="""
SELECT 'mailing_entries' AS table_name, count(*) AS left_rows FROM entries
 WHERE mailing_id NOT IN (SELECT * FROM gone) UNION ALL
SELECT 'dead_letters', count(*) FROM dead WHERE mailing_id NOT IN (SELECT * FROM gone) UNION ALL
SELECT 'mailing_progress', count(*) FROM progress WHERE mailing_id NOT IN (SELECT * FROM gone) UNION ALL
SELECT 'mailings', count(*) FROM mailings WHERE 'm' || CAST(id AS VARCHAR) NOT IN (SELECT * FROM gone) UNION ALL
SELECT 'outbox_messages', count(*) FROM outbox WHERE 'm' || CAST(mailing_id AS VARCHAR) NOT IN (SELECT * FROM gone)"""))
def purge(spark, sf_dir):
    part = v.table(spark, sf_dir, "part")

    def named(df, column):
        return df.withColumn(column, F.concat(F.lit("m"), F.col(column).cast("string")))

    progress = progress_of(spark, sf_dir)
    left = C.purge(
        progress.where(F.col("status") == "FAILED"),
        mailing_entries=entries_of(spark, sf_dir), dead_letters=dead_letters_of(spark, sf_dir),
        mailing_progress=progress, mailings=named(v.mailings_from(part), "id"),
        outbox_messages=named(v.outbox_from(part), "mailing_id"))
    out = None
    for name, df in left.items():
        one = df.agg(F.count("*").alias("left_rows")).select(F.lit(name).alias("table_name"), "left_rows")
        out = one if out is None else out.unionByName(one)
    return out

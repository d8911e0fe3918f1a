"""Counts and report tables."""

from pyspark.sql import DataFrame, functions as F

from postmill import constants as K
from postmill.functions.texts import percent, percent_text


def status_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("mailing_id", "status").agg(F.count("*").alias("count"))


def _with(status, name=None):
    return F.count_if(F.col("status") == status).alias(name or status.lower())


def status_card(entries: DataFrame) -> DataFrame:
    """One row per mailing with a column per status; missing ones are 0."""
    return entries.groupBy("mailing_id").agg(
        F.count_if(F.col("status").isin(*K.ENTRY_STATUSES)).alias("total"),
        F.count_if(F.col("status").isin("PENDING", "SENDING", "SENT", "FAILED")).alias("valid"),
        _with("INVALID"), _with("PENDING"), _with("SENDING"), _with("SENT"), _with("FAILED"),
    )


def status_page(progress: DataFrame, entries: DataFrame) -> DataFrame:
    """Progress of every mailing with its percentage and status card. Both sides have one row per mailing."""
    card = status_card(entries)
    out = progress.join(card, "mailing_id", "left")
    done, total = F.col("processed_rows"), F.col("total_rows")
    return out.withColumns({
        **{c: F.coalesce(c, F.lit(0)) for c in card.columns if c != "mailing_id"},
        "percentage": percent(done, total), "percentage_text": percent_text(done, total),
    }).withColumnRenamed("status", "progress_status")


def headline_counts(entries, dead_letters, mailings, outbox, mailing_status=None) -> DataFrame:
    """One labelled count per table (mailings optionally of one status; messages not yet published)."""
    if mailing_status is not None:
        mailings = mailings.where(F.col("status") == mailing_status)
    parts = {"entries": entries, "dead_letters": dead_letters, "mailings": mailings,
             "unpublished": outbox.where(~F.col("published"))}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("count")).select(F.lit(name).alias("metric"), "count")
        out = one if out is None else out.unionByName(one)
    return out


def group_counts(df: DataFrame, *columns) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("count"))


def worker_totals(decided: DataFrame) -> DataFrame:
    """One row over decided attempts."""
    return decided.agg(
        F.count("*").alias("total_jobs"), F.count_if("success").alias("completed_jobs"),
        F.count_if(~F.col("success")).alias("failed_jobs"), F.count_if("should_retry").alias("retried_jobs"),
        F.count_if("move_to_dlq").alias("dead_letter_jobs"), F.max("ts").alias("last_processed_at"),
    )


def requests_by_code(attempts: DataFrame) -> DataFrame:
    """Requests per status code (0: no answer), in rows."""
    code = F.coalesce("http_status", F.lit(0))
    return attempts.groupBy(code.alias("status_code")).agg(F.count("*").alias("requests"), F.max("ts").alias("last_at"))


def provider_totals(attempts: DataFrame) -> DataFrame:
    """One row: requests, successes, failures, requests by status code as a map, time of the last request.

    The map has one key per status code, so it does not grow with the attempts.
    """
    code = F.col("status_code")
    good = F.when(code.between(200, 299), F.col("requests")).otherwise(0)
    return requests_by_code(attempts).agg(
        F.sum("requests").alias("total_requests"), F.sum(good).alias("successful_requests"),
        (F.sum("requests") - F.sum(good)).alias("failed_requests"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("status_code", "requests")))).alias(
            "requests_by_status_code"),
        F.max("last_at").alias("last_request_at"),
    )


def delivery_summary(entries: DataFrame) -> DataFrame:
    """Per mailing: finished rows by outcome and their shares in percent."""
    out = entries.where(F.col("status").isin("SENT", "FAILED", "INVALID")).groupBy("mailing_id").agg(
        F.count("*").alias("processed"), _with("SENT"), _with("FAILED"), _with("INVALID"))
    return out.withColumns({f"{c}_share": percent(F.col(c), F.col("processed"), 1) for c in ("sent", "failed", "invalid")})


def token_audit(tokens: DataFrame, token="token") -> DataFrame:
    """One row: tokens, distinct tokens, and tokens that occur more than once."""
    per = tokens.where(F.col(token).isNotNull()).groupBy(token).agg(F.count("*").alias("n"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct_tokens"),
        F.count_if(F.col("n") > 1).alias("duplicated_tokens"))


def send_pace(attempts: DataFrame, phase="phase") -> DataFrame:
    """Elapsed seconds and seconds per send in each phase."""
    seconds = F.timestamp_diff("MILLISECOND", F.min("ts"), F.max("ts")) / F.lit(1000.0)
    out = attempts.groupBy(phase).agg(F.count("*").alias("sends"), F.round(seconds, 3).alias("elapsed_s"))
    return out.withColumn("seconds_per_send", F.round(F.col("elapsed_s") / F.col("sends"), 4))

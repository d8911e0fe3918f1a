"""Claims, recovery after a crash, progress upkeep and removal."""

from pyspark.sql import DataFrame, functions as F

from postmill import constants as K
from postmill.operators import lookups
from postmill.operators.spread import attach


def claim(mailings: DataFrame, wanted: DataFrame, as_of, seconds=K.CLAIM_STALE_SECONDS) -> DataFrame:
    """Next mailings with a `claimed` flag. wanted: ids asked for; asking twice claims once."""
    asked = wanted.select("id").distinct().withColumn("_asked", F.lit(True))
    taken = F.coalesce(F.col("_asked") & lookups.claimable(as_of, seconds), F.lit(False))
    return (
        mailings.join(asked, "id", "left")
        .withColumn("claimed", taken)
        .withColumns({
            "status": F.when(F.col("claimed"), "PROCESSING").otherwise(F.col("status")),
            "last_attempt": F.when(F.col("claimed"), lookups.moment(as_of)).otherwise(F.col("last_attempt")),
        })
        .drop("_asked")
    )


def recover_entries(entries: DataFrame, as_of, seconds=K.RECOVERY_STALE_SECONDS) -> DataFrame:
    """Entries stuck in SENDING go back to PENDING."""
    stale = F.coalesce((F.col("status") == "SENDING") & lookups.is_stale("last_attempt", as_of, seconds), F.lit(False))
    out = entries.withColumn("recovered", stale).withColumn(
        "status", F.when(F.col("recovered"), "PENDING").otherwise(F.col("status")))
    if "updated_at" in entries.columns:
        out = out.withColumn(
            "updated_at", F.when(F.col("recovered"), lookups.moment(as_of)).otherwise(F.col("updated_at")))
    return out


def recover_mailings(mailings: DataFrame, as_of, seconds=K.RECOVERY_STALE_SECONDS) -> DataFrame:
    """Mailings stuck in PROCESSING keep their status and lose last_attempt, so that they can be claimed again."""
    stale = F.coalesce((F.col("status") == "PROCESSING") & lookups.is_stale("updated_at", as_of, seconds), F.lit(False))
    return mailings.withColumn("recovered", stale).withColumn(
        "last_attempt", F.when(~F.col("recovered"), F.col("last_attempt")))


def recover_progress(progress: DataFrame, as_of, seconds=K.RECOVERY_STALE_SECONDS) -> DataFrame:
    """Progress stuck in RUNNING becomes PAUSED."""
    stale = F.coalesce((F.col("status") == "RUNNING") & lookups.is_stale("updated_at", as_of, seconds), F.lit(False))
    return progress.withColumn("recovered", stale).withColumns({
        "status": F.when(F.col("recovered"), "PAUSED").otherwise(F.col("status")),
        "updated_at": F.when(F.col("recovered"), lookups.moment(as_of)).otherwise(F.col("updated_at")),
    })


def recovery_report(entries, mailings, progress, as_of, seconds=K.RECOVERY_STALE_SECONDS) -> DataFrame:
    """One row: stale jobs and mailings found and recovered, and whether recovery is needed."""
    jobs = lookups.stale_entries(entries, as_of, seconds=seconds).select(F.lit("jobs").alias("kind"))
    work = lookups.stale_work(mailings, progress, as_of, seconds).select(F.lit("mailings").alias("kind"))
    kind = F.col("kind")
    found = jobs.unionByName(work).agg(
        F.count_if(kind == "jobs").alias("stale_jobs_found"),
        F.count_if(kind == "mailings").alias("stale_mailings_found"))
    return found.select(
        "stale_jobs_found", F.col("stale_jobs_found").alias("stale_jobs_recovered"),
        "stale_mailings_found", F.col("stale_mailings_found").alias("stale_mailings_recovered"),
        ((F.col("stale_jobs_found") > 0) | (F.col("stale_mailings_found") > 0)).alias("needs_recovery"),
    )


def progress_upsert(progress: DataFrame, changes: DataFrame, as_of) -> DataFrame:
    """Next progress rows. changes: mailing_id, total_rows, processed_rows, last_processed_line, status (one row per
    mailing); a null field leaves the stored value, and a new row starts as RUNNING at 0."""
    now = F.lit(as_of).cast("timestamp_ntz")
    fields = ("total_rows", "processed_rows", "last_processed_line", "status")
    start = {"status": F.lit("RUNNING")}
    side = changes.select("mailing_id", F.lit(True).alias("_hit"), *[F.col(f).alias(f"_{f}") for f in fields])
    hit = F.coalesce("_hit", F.lit(False))
    return progress.join(side, "mailing_id", "full_outer").select(
        "mailing_id",
        *[F.coalesce(F.col(f"_{f}"), F.col(f), start.get(f, F.lit(0))).alias(f) for f in fields],
        F.coalesce("created_at", now).alias("created_at"),
        F.when(hit, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def completion(totals: DataFrame) -> DataFrame:
    """Changes that close a mailing: processed equals total. totals: mailing_id, total_rows, status."""
    rows = F.col("total_rows").cast("int")
    return totals.select(
        "mailing_id", rows.alias("total_rows"), rows.alias("processed_rows"),
        F.lit(None).cast("int").alias("last_processed_line"), "status")


def complete(progress: DataFrame, totals: DataFrame, as_of) -> DataFrame:
    """Close mailings; only a row that did not exist before takes its last line from the total."""
    out = progress_upsert(progress, completion(totals), as_of)
    known = progress.select("mailing_id", F.lit(True).alias("_known"))
    return out.join(known, "mailing_id", "left").withColumn(
        "last_processed_line", F.when(F.col("_known"), F.col("last_processed_line")).otherwise(F.col("total_rows"))
    ).drop("_known")


def refreshed_progress(entries: DataFrame) -> DataFrame:
    """Progress changes from entry counts: processed = sent + failed, COMPLETED when nothing is left."""
    status = F.col("status")
    done = F.count_if(status.isin("SENT", "FAILED")).cast("int")
    counts = entries.groupBy("mailing_id").agg(
        F.count("*").cast("int").alias("total_rows"), done.alias("processed_rows"), done.alias("last_processed_line"))
    return counts.withColumn(
        "status", F.when(F.col("processed_rows") == F.col("total_rows"), "COMPLETED").otherwise("RUNNING"))


def purge(removed: DataFrame, **tables):
    """Tables without the rows of removed mailings (column mailing_id). A table keyed by `id` is the mailing table."""
    ids = removed.select("mailing_id").distinct()
    out = {}
    for name, df in tables.items():
        key = "mailing_id" if "mailing_id" in df.columns else "id"
        out[name] = attach(df, ids.withColumnRenamed("mailing_id", key), [key], "left_anti")
    return out

"""From raw recipient rows to stored entries."""

from pyspark.sql import DataFrame, functions as F

from postmill.functions import address, keys
from postmill.operators.spread import attach, first_per_key
from postmill.operators.validate import validate

KEY = ["mailing_id", "email"]


def normalized(rows: DataFrame, raw="raw_email") -> DataFrame:
    """Add the normalised address; a missing or empty cell gives null."""
    cell = F.col(raw)
    return rows.withColumn("email", F.when(cell != "", address.normalize_email(cell)))


def distinct_addresses(rows: DataFrame, raw="raw_email") -> DataFrame:
    """One row per (mailing_id, email) with its first line and number of copies.

    Validation depends on the address only, so it runs after this step and sees each address once. Sums and minima of
    numbers combine before the shuffle: a repeated address or a mailing with most of the rows stays cheap.
    """
    return normalized(rows, raw).groupBy(*KEY).agg(F.min("line_no").alias("line_no"), F.count("*").alias("copies"))


def candidates(rows: DataFrame, disposable=None, domain_mx=None, raw="raw_email") -> DataFrame:
    """Distinct addresses of each mailing with verdict, first line and number of copies."""
    return validate(distinct_addresses(rows, raw), disposable, domain_mx)


def storable(cands: DataFrame) -> DataFrame:
    """Valid rows and invalid rows that carry an address text; empty ones are only counted."""
    return cands.where(F.col("email").isNotNull() & (F.col("email") != ""))


def not_stored(cands: DataFrame, entries: DataFrame, mailing_ids=None) -> DataFrame:
    """Rows whose (mailing_id, email) is not stored yet, whatever the stored status.

    When the caller knows which mailings a load touches, the filter on mailing_ids reaches the scan of the stored
    entries, and only those partitions are read and shuffled.
    """
    if mailing_ids is not None:
        entries = entries.where(F.col("mailing_id").isin(list(mailing_ids)))
    return cands.join(entries.select(*KEY), KEY, "left_anti")


def as_entries(cands: DataFrame, as_of, secret="postmill") -> DataFrame:
    """Default-filled entry rows: PENDING for valid addresses, INVALID with reason and details for the others."""
    now = F.lit(as_of).cast("timestamp_ntz")
    m, e = F.col("mailing_id"), F.col("email")
    return cands.select(
        keys.row_id(F.lit("entry"), m, e).alias("id"), m, e,
        keys.hex_token(secret, m, e).alias("token"),
        F.when(F.col("is_valid"), "PENDING").otherwise("INVALID").alias("status"),
        F.lit(0).alias("attempts"),
        F.lit(None).cast("timestamp_ntz").alias("last_attempt"),
        F.lit(None).cast("string").alias("external_id"),
        F.col("reason").alias("invalid_reason"),
        F.col("details").alias("validation_details"),
        now.alias("created_at"), now.alias("updated_at"),
    )


def new_entries(
    rows, entries, as_of, disposable=None, domain_mx=None, secret="postmill", mailing_ids=None
) -> DataFrame:
    """Entry rows to append for a load: first copies of addresses that are not stored yet."""
    fresh = not_stored(storable(candidates(rows, disposable, domain_mx)), entries, mailing_ids)
    return as_entries(fresh, as_of, secret)


def load_summary(rows, entries=None, disposable=None, domain_mx=None) -> DataFrame:
    """Per mailing: rows, inserted, duplicates among valid rows, invalid rows, repeated invalid rows, status."""
    cands = candidates(rows, disposable, domain_mx)
    if entries is None:
        cands = cands.withColumn("_new", F.lit(1))
    else:
        stored = entries.select(*KEY).distinct().withColumn("_new", F.lit(0))
        cands = cands.join(stored, KEY, "left").withColumn("_new", F.coalesce("_new", F.lit(1)))
    ok, n = F.col("is_valid"), F.col("copies")
    kept = F.col("email").isNotNull() & (F.col("email") != "")
    inserted = F.sum(F.when(ok, F.col("_new")).otherwise(0))
    return cands.groupBy("mailing_id").agg(
        F.sum(n).alias("total_rows"),
        inserted.cast("bigint").alias("processed_rows"),
        (F.sum(F.when(ok, n).otherwise(0)) - inserted).cast("bigint").alias("duplicates_skipped"),
        F.sum(F.when(ok, 0).otherwise(n)).cast("bigint").alias("invalid_emails"),
        F.sum(F.when(~ok & kept, n - F.col("_new")).otherwise(0)).cast("bigint").alias("invalid_duplicates"),
        F.lit("COMPLETED").alias("status"),
    )


def invalid_breakdown(rows, disposable=None, domain_mx=None) -> DataFrame:
    """Invalid rows and distinct invalid addresses per reason."""
    cands = candidates(rows, disposable, domain_mx).where(~F.col("is_valid"))
    return cands.groupBy(F.col("reason").alias("invalid_reason")).agg(
        F.sum("copies").alias("rows"), F.count("email").alias("addresses")
    )


def after_checkpoint(rows: DataFrame, progress: DataFrame) -> DataFrame:
    """Rows beyond the last processed line of their mailing; all rows of a mailing without progress."""
    last = progress.select("mailing_id", F.col("last_processed_line").alias("_last"))
    seen = F.coalesce("_last", F.lit(0))
    return attach(rows, last, ["mailing_id"]).where(F.col("line_no") > seen).drop("_last")


def resume(rows: DataFrame, progress: DataFrame, mailing_id) -> DataFrame:
    """Rows left to process for one mailing; refuses an unknown or completed mailing."""
    row = progress.where(F.col("mailing_id") == mailing_id).select("status").first()
    if row is None:
        raise ValueError(f"No progress found for mailing {mailing_id}")
    if row["status"] == "COMPLETED":
        raise ValueError(f"Mailing {mailing_id} is already completed")
    return after_checkpoint(rows.where(F.col("mailing_id") == mailing_id), progress)


def accepted_uploads(uploads: DataFrame, mailings: DataFrame) -> DataFrame:
    """Uploads named *.csv (any case) whose filename is neither registered nor taken by an earlier upload."""
    csv = uploads.where(F.lower("filename").endswith(".csv"))
    fresh = first_per_key(csv, ["filename"], ["id"])
    return fresh.join(mailings.select("filename"), "filename", "left_anti")


def known_filenames(uploads: DataFrame, mailings: DataFrame) -> DataFrame:
    return attach(uploads, mailings.select("filename").distinct(), ["filename"], "left_semi")

"""Filters, point lookups, ordered reads and pages."""

from pyspark.sql import DataFrame, Window, functions as F

from postmill import constants as K
from postmill.functions import keys
from postmill.functions.texts import status_filter
from postmill.operators.spread import attach, global_index, running

# Deeper pages are found by distributed numbering instead of a top-k that one task would have to hold.
TOP_ROWS = 100_000


def moment(as_of, seconds_back=0):
    """A fixed point in time, some seconds before as_of."""
    return F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(seconds_back).cast("decimal(18,6)"))


def entries_of(entries: DataFrame, mailing_id, status=None) -> DataFrame:
    """Entries of one mailing; of a stored table only the mailing's folder is read."""
    out = entries.where(F.col("mailing_id") == mailing_id)
    if "bucket" in entries.columns:
        out = out.where(F.col("bucket") == keys.bucket(F.lit(mailing_id)))
    wanted = status_filter(status)
    return out.where(F.col("status") == wanted) if wanted else out


def find(df: DataFrame, **values) -> DataFrame:
    """Rows equal to every given column value."""
    for name, value in values.items():
        df = df.where(F.col(name) == value)
    return df


def find_many(df: DataFrame, wanted: DataFrame, on) -> DataFrame:
    """Rows whose key occurs in a key table."""
    return attach(df, wanted.select(*on).distinct(), list(on), "left_semi")


def pending(entries: DataFrame, mailing_id=None) -> DataFrame:
    out = entries.where(F.col("status") == "PENDING")
    return out if mailing_id is None else out.where(F.col("mailing_id") == mailing_id)


def is_stale(time, as_of, seconds):
    return F.col(time) < moment(as_of, seconds)


def stale_entries(entries, as_of, status="SENDING", seconds=K.RECOVERY_STALE_SECONDS) -> DataFrame:
    return entries.where((F.col("status") == status) & is_stale("last_attempt", as_of, seconds))


def stale_mailings(mailings, as_of, seconds=K.RECOVERY_STALE_SECONDS) -> DataFrame:
    return mailings.where((F.col("status") == "PROCESSING") & is_stale("updated_at", as_of, seconds))


def stale_progress(progress, as_of, seconds=K.RECOVERY_STALE_SECONDS) -> DataFrame:
    return progress.where((F.col("status") == "RUNNING") & is_stale("updated_at", as_of, seconds))


def stale_work(mailings, progress, as_of, seconds=K.RECOVERY_STALE_SECONDS) -> DataFrame:
    """Stale mailings of both tables, labelled by the table they come from."""
    current = stale_mailings(mailings, as_of, seconds).select(
        F.lit("mailings").alias("source"), F.col("id").cast("string").alias("mailing_id"), "status", "updated_at")
    legacy = stale_progress(progress, as_of, seconds).select(
        F.lit("mailing_progress").alias("source"), "mailing_id", "status", "updated_at")
    return current.unionByName(legacy)


def claimable(as_of, seconds=K.CLAIM_STALE_SECONDS):
    """Condition under which a mailing may be taken for processing."""
    status, last = F.col("status"), F.col("last_attempt")
    return status.isin("PENDING", "QUEUED", "FAILED") | (
        (status == "PROCESSING") & (last.isNull() | (last < moment(as_of, seconds))))


def active_progress(progress: DataFrame) -> DataFrame:
    return progress.where(F.col("status").isin("RUNNING", "PAUSED")).orderBy("mailing_id")


def unpublished(outbox: DataFrame) -> DataFrame:
    return outbox.where(~F.col("published"))


def dead_letters_for(dead: DataFrame, reason, limit) -> DataFrame:
    return dead.where(F.col("reason") == reason).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def not_sent(jobs: DataFrame, entries: DataFrame) -> DataFrame:
    """Jobs (one per entry id) whose entry is not SENT yet."""
    return jobs.join(entries.where(F.col("status") == "SENT").select("id"), "id", "left_anti")


def oldest(df: DataFrame, k) -> DataFrame:
    return df.orderBy("created_at", "id").limit(k)


def newest(df: DataFrame, k, skip=0, status=None) -> DataFrame:
    if status is not None:
        df = df.where(F.col("status") == status)
    return df.orderBy(F.desc("created_at"), F.desc("id")).offset(skip).limit(k)


def oldest_attempts(entries, as_of, k=10, seconds=K.RECOVERY_STALE_SECONDS) -> DataFrame:
    """A sample of stale entries, oldest attempt first."""
    return stale_entries(entries, as_of, seconds=seconds).orderBy("last_attempt", "id").limit(k)


def _page_size(limit, offset=0):
    if not 1 <= limit <= K.PAGE_LIMIT_MAX:
        raise ValueError(f"Limit must be between 1 and {K.PAGE_LIMIT_MAX}")
    if offset < 0:
        raise ValueError("Offset must be >= 0")


def page(entries, mailing_id, status=None, limit=K.PAGE_LIMIT_DEFAULT, offset=0) -> DataFrame:
    """One page of a mailing's entries with the total count and whether more rows follow."""
    _page_size(limit, offset)
    rows = entries_of(entries, mailing_id, status)
    total = rows.groupBy("mailing_id").agg(F.count("*").alias("total"))
    if offset + limit <= TOP_ROWS:
        part = rows.orderBy("created_at", "id").offset(offset).limit(limit)
    else:
        slot = F.col("_slot")
        part = global_index(rows, ["created_at", "id"], "_slot").where((slot >= offset) & (slot < offset + limit))
        part = part.drop("_slot")
    # The page has at most PAGE_LIMIT_MAX rows and the total one row.
    here = F.count("*").over(Window.partitionBy("mailing_id"))
    out = part.withColumn("_here", here).join(F.broadcast(total), "mailing_id")
    return out.withColumn("has_more", F.lit(offset) + F.col("_here") < F.col("total")).drop("_here")


def page_after(entries, mailing_id, created_at, last_id, status=None, limit=K.PAGE_LIMIT_DEFAULT) -> DataFrame:
    """The page that follows a given row: its cost does not grow with the depth of the page."""
    _page_size(limit)
    seen = F.lit(created_at).cast("timestamp_ntz")
    later = (F.col("created_at") > seen) | ((F.col("created_at") == seen) & (F.col("id") > F.lit(last_id)))
    return entries_of(entries, mailing_id, status).where(later).orderBy("created_at", "id").limit(limit)


def _ordered(order, descending):
    return [F.desc(c) if descending else F.asc(c) for c in order]


def fences(rows: DataFrame, key=None, order=("created_at", "id"), every=K.FENCE_ROWS, descending=False) -> DataFrame:
    """Every n-th row of the order (of each key), as key, order columns and slot, counted from 0: a table that is smaller
    than the rows by the factor `every`."""
    base = rows.select(*([key] if key else []), *order)
    if key:
        numbered = running(base, [key], _ordered(order, descending) if descending else list(order), number="slot")
        numbered = numbered.withColumn("slot", F.col("slot") - 1)
    else:
        numbered = global_index(base, _ordered(order, descending), "slot")
    return numbered.where(F.col("slot") % every == 0)


def _from(order, values, descending):
    """Condition that a row's place in the order is that of the values or behind it."""
    out = F.lit(True)
    for c, value in reversed(list(zip(order, values))):
        further = F.col(c) < value if descending else F.col(c) > value
        out = further | ((F.col(c) == value) & out)
    return out


def page_by_fences(rows: DataFrame, marks: DataFrame, limit, offset, order=("created_at", "id"), descending=False) -> DataFrame:
    """The rows at offset ... offset + limit - 1 of an order, however deep: only the interval between the marks around them is
    read and sorted, and the driver sees these two marks. rows and marks are those of one key."""
    _page_size(limit, offset)
    slot, row = F.col("slot"), F.struct("slot", *order)
    ends = marks.agg(F.max_by(row, F.when(slot <= offset, slot)).alias("low"),
                     F.min_by(row, F.when(slot >= offset + limit, slot)).alias("high")).first()
    low, high = ends["low"], ends["high"]
    if low is None:
        return rows.limit(0)
    def values(mark):
        return [F.lit(mark[c]).cast(rows.schema[c].dataType) for c in order]

    # The bound of the first column alone reaches the scan.
    first, start = F.col(order[0]), values(low)
    part = rows.where(first <= start[0] if descending else first >= start[0]).where(_from(order, start, descending))
    if high is not None:
        part = part.where(~_from(order, values(high), descending))
    return part.orderBy(*_ordered(order, descending)).offset(offset - low["slot"]).limit(limit)


def report_rank(status):
    return F.when(status == "SENT", 1).when(status == "FAILED", 2).when(status == "INVALID", 3).otherwise(4)


def report_ordered(entries: DataFrame) -> DataFrame:
    """Delivery report order: sent, failed, invalid, others; oldest first inside each."""
    return entries.orderBy(report_rank(F.col("status")), "created_at", "id")

"""Send schedule and rate audit, and the progress trail of a load."""

from pyspark.sql import DataFrame, functions as F

from postmill import constants as K
from postmill.operators.spread import global_index, running


def pace_ms(rate_per_minute=K.RATE_PER_MINUTE):
    """Smallest time between two starts under a per-minute limit."""
    return -(-60000 // rate_per_minute) + K.PACE_MARGIN_MS


def _start(slot, t0, rate):
    wait = (slot * F.lit(pace_ms(rate))).cast("decimal(20,3)") / F.lit(1000).cast("decimal(4,0)")
    return F.lit(t0).cast("timestamp_ntz") + F.make_dt_interval(secs=wait.cast("decimal(18,6)"))


def send_plan(pending: DataFrame, t0, rate=K.RATE_PER_MINUTE) -> DataFrame:
    """First in, first out: slot k starts at t0 + k * pace."""
    slots = global_index(pending, ["created_at", "id"], "slot")
    return slots.withColumn("planned_at", _start(F.col("slot"), t0, rate))


def lane_plan(pending: DataFrame, lane, t0, rate=K.RATE_PER_MINUTE, **options) -> DataFrame:
    """The same plan with an own clock per lane (a provider account or a mailing)."""
    numbered = running(pending, [lane], ["created_at", "id"], number="slot", **options)
    slots = numbered.withColumn("slot", F.col("slot") - 1)
    return slots.withColumn("planned_at", _start(F.col("slot"), t0, rate))


def start_gaps(attempts: DataFrame, lane="mailing_id", rate=K.RATE_PER_MINUTE, **options) -> DataFrame:
    """Time since the previous start of the lane, and whether it is below the pace."""
    out = running(attempts, [lane], ["ts", "event_id"], previous={"previous_ts": "ts"}, **options)
    millis = F.timestamp_diff("MILLISECOND", F.col("previous_ts"), F.col("ts"))
    return out.withColumn("gap_ms", millis).withColumn(
        "too_fast", F.coalesce(F.col("gap_ms") < pace_ms(rate), F.lit(False)))


def per_minute(attempts: DataFrame, rate=K.RATE_PER_MINUTE) -> DataFrame:
    """Requests per minute and whether they exceed the limit."""
    counts = attempts.groupBy(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")).agg(
        F.count("*").alias("requests"))
    return counts.withColumn("over_limit", F.col("requests") > rate)


def progress_trail(rows: DataFrame, every=K.CHECKPOINT_LINES, counted=None, **options) -> DataFrame:
    """State of a load at every n-th line of a mailing: line position and rows counted so far."""
    flag = (F.col("is_valid") if counted is None else counted).cast("bigint")
    out = running(rows, ["mailing_id"], ["line_no"], number="position", total={"processed_rows": flag}, **options)
    return out.where(F.col("position") % every == 0)

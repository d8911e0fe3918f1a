"""JSON messages, the JSON-lines event log and stored metric series."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from postmill import constants as K, model
from postmill.functions.payload import parsed


def read_messages(outbox: DataFrame) -> DataFrame:
    """Messages with their payload fields as a struct."""
    return outbox.withColumn("job", parsed(F.col("payload")))


def write_messages(messages: DataFrame, path):
    """Payloads as JSON lines, one folder per queue."""
    messages.select("target_queue", F.col("payload").alias("value")).write.mode("append").partitionBy(
        "target_queue").text(path)


def read_queue(spark: SparkSession, path) -> DataFrame:
    rows = spark.read.schema("value string, target_queue string").text(path)
    return rows.select("target_queue", parsed(F.col("value")).alias("job"))


def log_events(decided: DataFrame, service="postmill") -> DataFrame:
    """Event-log rows of decided attempts: sent, failed (to be tried again) or dead letter."""
    event = (
        F.when(F.col("success"), "email.sent").when(F.col("should_retry"), "email.failed")
        .otherwise("email.dead_letter")
    )
    level = F.when(F.col("success"), "info").when(F.col("should_retry"), "warn").otherwise("error")
    status = F.when(F.col("success"), "SENT").when(F.col("should_retry"), "PENDING").otherwise("FAILED")
    text = F.coalesce("error", "class_reason")
    tried = F.concat(F.lit(" (attempt "), F.col("attempt").cast("string"), F.lit(") - "), text)
    message = (
        F.when(F.col("success"), F.concat(F.lit("Email sent successfully to "), F.col("email")))
        .when(F.col("should_retry"), F.concat(F.lit("Email failed: "), F.col("email"), tried))
        .otherwise(F.concat(F.lit("Email moved to dead letter queue: "), F.col("email"), F.lit(" - "), text))
    )
    return decided.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), level.alias("level"),
        F.lit(service).alias("service"), event.alias("event"),
        F.col("mailing_id").alias("mailingId"), "email", status.alias("status"), F.col("attempt").alias("attempts"),
        "http_status", F.when(~F.col("success"), text).alias("error"), F.col("duration_s").alias("duration"),
        message.alias("message"),
    )


def write_log(events: DataFrame, path):
    events.write.mode("append").json(path)


def read_log(spark: SparkSession, path) -> DataFrame:
    """The event log under its fixed schema; fields an event does not have are null."""
    return spark.read.schema(model.EVENT_LOG).json(path)


def known_events(log: DataFrame) -> DataFrame:
    return log.where(F.col("event").isin(*K.LOG_EVENTS))


def write_series(series: DataFrame, path):
    series.write.mode("append").parquet(path)


def read_series(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(model.METRICS).parquet(path)

"""Metric series: counters, cumulative histograms and gauges as rows (metric, labels, le, value)."""

from pyspark.sql import DataFrame, functions as F

from postmill import constants as K


def _label_map(labels):
    if not labels:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[x for name in labels for x in (F.lit(name), F.col(name).cast("string"))])


def counter(events: DataFrame, metric, labels, amount=None) -> DataFrame:
    """Rows (or the sum of `amount`) per label combination: metric, one column per label, value."""
    value = F.count("*") if amount is None else F.sum(amount)
    return events.groupBy(*labels).agg(value.cast("double").alias("value")).select(
        F.lit(metric).alias("metric"), *labels, "value")


def counters(events: DataFrame, *parts) -> DataFrame:
    """Several counters in one pass: metric, label, value. parts: (metric, label Column, condition Column or None)."""
    marks = [F.when(F.lit(True) if condition is None else condition, F.struct(F.lit(metric).alias("metric"), label.alias("label")))
             for metric, label, condition in parts]
    hits = events.select(F.explode(F.array(*marks)).alias("m")).where(F.col("m").isNotNull())
    return hits.groupBy("m.metric", "m.label").agg(F.count("*").cast("double").alias("value"))


def histogram(events: DataFrame, metric, labels, value, bounds) -> DataFrame:
    """Cumulative buckets per label combination, with le in (bounds, +Inf, sum, count). One pass over the events."""
    v = F.col(value)
    names = [f"{b:g}" for b in bounds]
    wide = events.where(v.isNotNull()).groupBy(*labels).agg(
        *[F.count_if(v <= b).cast("double").alias(n) for b, n in zip(bounds, names)],
        F.count("*").cast("double").alias("+Inf"), F.sum(v).alias("sum"), F.count("*").cast("double").alias("count"))
    cells = [f"`{n}`" for n in (*names, "+Inf", "sum", "count")]
    return wide.unpivot(list(labels), cells, "le", "value").select(
        F.lit(metric).alias("metric"), *labels, "le", "value")


def gauge(readings: DataFrame, metric, labels, value="value", order=("ts", "event_id")) -> DataFrame:
    """Latest reading per label combination."""
    latest = F.max_by(F.col(value), F.struct(*order)).cast("double")
    return readings.groupBy(*labels).agg(latest.alias("value")).select(F.lit(metric).alias("metric"), *labels, "value")


def as_series(df: DataFrame, labels) -> DataFrame:
    """Label columns -> label map, the stored shape."""
    le = F.col("le") if "le" in df.columns else F.lit(None).cast("string")
    return df.select("metric", _label_map(labels).alias("labels"), le.alias("le"), "value")


def delivery_series(decided: DataFrame) -> DataFrame:
    """The e-mail counters and the send-time histogram of decided attempts, in the stored shape; two passes."""
    status = F.when(F.col("success"), "SENT").otherwise("FAILED")
    counts = counters(
        decided, (K.METRIC_EMAILS, status, None), (K.METRIC_EMAILS, F.lit("SENDING"), None),
        (K.METRIC_EMAILS, F.lit("DEAD_LETTER"), F.col("move_to_dlq")), (K.METRIC_RETRIES, F.col("class_reason"), ~F.col("success")))
    name = F.when(F.col("metric") == K.METRIC_RETRIES, "reason").otherwise("status")
    counted = counts.select("metric", F.create_map(name, F.col("label")).alias("labels"), F.lit(None).cast("string").alias("le"),
                            "value")
    timed = histogram(decided.withColumn("status", status), K.METRIC_SEND_SECONDS, ["status"], "duration_s", K.SEND_BOUNDS)
    return counted.unionByName(as_series(timed, ["status"]))

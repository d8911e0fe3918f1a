"""The outbox poll: messages that are due are sent, sends meet the broker's answers in a stream-stream join, and messages
that failed come back in the next poll.

Folders under `path`, all but the ticks written by file sinks, whose logs make a repeated micro-batch harmless:
  sends      what a poll hands to the broker (outcome `sent`) or gives up (`dead_letter`), with the time of the poll
  outcomes   what became of each send once its time is over: `published` or `failed`
  ticks      the time of each poll; they move the watermarks of both sides also when no message and no answer arrives

`send` reads new messages and the failed rows of `outcomes`; `confirm` joins `sends` with arriving answers (message_id,
attempt, seq, ok, error, answered_at). An answer counts if it belongs to the same attempt and comes within `timeout` seconds
of the send; of several answers one success is enough, else the last error counts. A send without such an answer failed.
Answers may arrive `late` seconds after their time; a send is closed when no answer to it can arrive any more, and both sides'
state ends with it, so the state holds the sends of timeout + late seconds, whatever the age of the outbox.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from postmill import constants as K
from postmill.operators.spread import last_per_key
from postmill.streaming import runner

TIMEOUT_SECONDS = 30
LATE_SECONDS = 20
MESSAGE = "id string, mailing_id string, target_queue string, payload string, attempts int, last_error string"
SENDS = f"{MESSAGE}, outcome string, sent_at timestamp"
OUTCOMES = f"{SENDS}, published_at timestamp"
ANSWERS = "message_id string, attempt int, seq int, ok boolean, error string, answered_at timestamp"
TICKS = "at timestamp, id string, tick boolean, sent int, answered int"
COLUMNS = [part.split()[0] for part in MESSAGE.split(", ")]


def _typed(rows, schema):
    return rows.select(*[F.col(part.split()[0]).cast(part.split()[1]).alias(part.split()[0]) for part in schema.split(", ")])


def send(new: DataFrame, path, as_of, max_attempts=K.OUTBOX_MAX_ATTEMPTS, trigger=None):
    """Take up new unpublished messages (a stream of outbox rows) and those that failed; start the query."""
    spark = new.sparkSession
    fresh = _typed(new.where(~F.col("published")), MESSAGE)
    failed = runner.files(spark, runner.folder(spark, f"{path}/outcomes"), OUTCOMES).where(F.col("outcome") == "failed")
    given_up = F.col("attempts") >= max_attempts
    rows = fresh.unionByName(failed.select(*COLUMNS)).select(
        *COLUMNS, F.when(given_up, "dead_letter").otherwise("sent").alias("outcome"),
        F.lit(as_of).cast("timestamp").alias("sent_at"))
    return runner.to_files(rows, f"{path}/sends", f"{path}/checkpoint-send", trigger)


def outcomes(sends: DataFrame, answers: DataFrame, timeout=TIMEOUT_SECONDS, late=LATE_SECONDS) -> DataFrame:
    """What became of each send; on streams a row comes when its time is over, on tables at once.

    Rows of `sends` with `tick` set only carry the time.
    """
    left = sends.withWatermark("sent_at", f"{late} seconds")
    right = answers.select(
        "message_id", F.col("attempt").alias("answered_attempt"), "seq", "ok", "error", "answered_at"
    ).withWatermark("answered_at", f"{late} seconds")
    wait = F.expr(f"INTERVAL {int(timeout)} SECONDS")
    met = left.join(
        right, (F.col("id") == F.col("message_id")) & (F.col("attempts") == F.col("answered_attempt"))
        & (F.col("answered_at") >= F.col("sent_at")) & (F.col("answered_at") <= F.col("sent_at") + wait), "left_outer")
    # The answer's time goes on as a plain value: one event time may reach the next stateful step.
    met = met.withColumn("_acked", F.when(F.col("ok"), F.col("answered_at"))).drop("answered_at")
    rest = [c for c in COLUMNS if c not in ("id", "attempts")]
    closed = met.groupBy("id", "attempts", "sent_at").agg(
        *[F.first(c).alias(c) for c in rest], F.bool_or("tick").alias("_tick"),
        F.coalesce(F.bool_or("ok"), F.lit(False)).alias("_ok"), F.min("_acked").alias("published_at"),
        F.max_by("error", F.when(~F.col("ok"), F.col("seq"))).alias("_error"))
    failed = ~F.col("_ok")
    return closed.where(~F.col("_tick")).select(
        "id", "mailing_id", "target_queue", "payload", (F.col("attempts") + failed.cast("int")).alias("attempts"),
        F.when(failed, F.coalesce("_error", F.lit(K.NO_ANSWER_TEXT))).otherwise(F.col("last_error")).alias("last_error"),
        F.when(failed, "failed").otherwise("published").alias("outcome"), "sent_at", "published_at")


def confirm(answers: DataFrame, path, as_of, timeout=TIMEOUT_SECONDS, late=LATE_SECONDS, trigger=None):
    """Join the sends so far with a stream of answers up to the moment `as_of`; start the query.

    All that has arrived belongs into the micro-batch of the tick, so sources need no limit of files per micro-batch.
    """
    spark = answers.sparkSession
    now = spark.range(1).select(F.lit(as_of).cast("timestamp").alias("at"), F.lit("").alias("id"), F.lit(True).alias("tick"),
                                F.lit(-1).alias("sent"), F.lit(-2).alias("answered"))
    now.coalesce(1).write.mode("append").parquet(f"{path}/ticks")
    ticks = runner.files(spark, f"{path}/ticks", TICKS)
    sends = runner.files(spark, runner.folder(spark, f"{path}/sends"), SENDS).where(
        F.col("outcome") == "sent").select(*COLUMNS, "sent_at", F.lit(False).alias("tick"))
    # Ticks of the two sides never meet; they are left out behind the aggregation, so that no filter drops them before. Their
    # values come from the file: constants would be folded into the join of a micro-batch without other rows.
    left = sends.unionByName(ticks.select(
        "id", F.col("sent").alias("attempts"), F.col("at").alias("sent_at"), "tick"), allowMissingColumns=True)
    right = _typed(answers, ANSWERS).unionByName(ticks.select(
        F.col("id").alias("message_id"), F.col("answered").alias("attempt"), F.col("at").alias("answered_at")),
        allowMissingColumns=True)
    return runner.to_files(
        outcomes(left, right, timeout, late), f"{path}/outcomes", f"{path}/checkpoint-confirm", trigger)


def settled(spark: SparkSession, path) -> DataFrame:
    """The last state of every message that was taken up: id, outcome, attempts, last_error, published_at."""
    sends = spark.read.schema(SENDS).parquet(f"{path}/sends").withColumns(
        {"published_at": F.lit(None).cast("timestamp"), "_step": F.lit(0)})
    closed = spark.read.schema(OUTCOMES).parquet(f"{path}/outcomes").withColumn("_step", F.lit(1))
    rows = sends.unionByName(closed).select("id", "outcome", "attempts", "last_error", "published_at", "sent_at", "_step")
    return last_per_key(rows, ["id"], ["sent_at", "_step"]).drop("sent_at", "_step")

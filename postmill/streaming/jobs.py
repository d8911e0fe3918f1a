"""The streaming forms of intake, publishing, upkeep and rate control."""

from pyspark.sql import DataFrame, functions as F

from postmill import constants as K
from postmill.functions import keys
from postmill.operators import outbox as outbox_ops
from postmill.operators.intake import KEY, accepted_uploads, normalized
from postmill.operators.validate import validate
from postmill.sources import tables
from postmill.streaming import runner


def checked(rows: DataFrame, disposable=None, domain_mx=None, raw="raw_email") -> DataFrame:
    """Arriving recipient rows with normalised address and verdict; tables of domains are joined as static sides."""
    return validate(normalized(rows, raw), disposable, domain_mx, raw=raw)


def dedupe(rows: DataFrame, on=KEY) -> DataFrame:
    """Each key once, for good. The state holds every key ever seen."""
    return rows.dropDuplicates(list(on))


def dedupe_within(rows: DataFrame, time, delay, on=KEY) -> DataFrame:
    """Each key once while copies arrive within `delay`; older keys leave the state."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(on))


def store_unseen(rows: DataFrame, out, checkpoint, on=KEY, **options):
    """Store each key once without stream state: copies inside a micro-batch are combined before the shuffle, and keys that
    any other micro-batch of any run has stored are excluded by an anti join with the folders of the keys that arrived. A repeated micro-batch ignores what it had
    stored itself, and a run with a new checkpoint adds only keys that earlier runs have not stored."""
    on = list(on)
    rest = [c for c in rows.columns if c not in on]
    folder = keys.bucket(F.col(on[0]).cast("string")).alias("bucket")

    def fresh(batch, batch_id):
        once = batch.groupBy(*on).agg(F.min(F.struct(*rest)).alias("_r")).select(*on, "_r.*") if rest else batch.distinct()
        once = once.select("*", folder)
        if not runner.anything_stored(batch.sparkSession, out):
            return once
        # Only the folders that the micro-batch touches are read: at most K.BUCKETS numbers.
        touched = [r["bucket"] for r in batch.select(folder).distinct().collect()]
        own = (F.col("run").cast("string") == runner.run_of(batch)) & (F.col("batch") == batch_id)
        known = runner.stored(batch.sparkSession, out).where(F.col("bucket").isin(touched) & ~own)
        return once.join(known.select("bucket", *on), ["bucket", *on], "left_anti").select(*once.columns)

    return runner.to_batches(rows, out, checkpoint, fresh, by="bucket", **options)


def commit_batches(rows: DataFrame, path, checkpoint, work, **options):
    """Store what work(batch, run) gives, {table: rows}, as one commit per micro-batch.

    The commit's name comes from the query and the number of the micro-batch, so a micro-batch that runs again replaces
    what it had written, and readers see all of its tables or none.
    """
    def store(batch, batch_id):
        run = f"{runner.run_of(batch)}-{batch_id}"
        tables.commit(path, run, **work(batch, run))

    return runner.for_each(rows, checkpoint, store, **options)


def register_uploads(uploads: DataFrame, path, as_of, checkpoint, **options):
    """Register arriving uploads: a mailing and its first message in one commit; names known from other runs are left out."""
    def work(batch, run):
        known = tables.read_committed(batch.sparkSession, path, "mailings").where(F.col("run") != run)
        rows, messages = outbox_ops.register(accepted_uploads(batch, known), as_of)
        return {"mailings": rows, "outbox_messages": messages}

    return commit_batches(uploads, path, checkpoint, work, **options)


def watch(spark, folder, columns, archive, out, checkpoint, disposable_of=None, raw="email", **options):
    """Take in CSV files dropped into a folder: rows with verdicts in out/checked, rows with another number of cells than the
    files have columns in out/rejected too, as their text; files that are done are moved to the archive.

    disposable_of(spark) gives the list of domains; it is read for each micro-batch, so a list that changes or outgrows a
    broadcast counts from the next one on. Files move when the micro-batch after theirs begins.
    """
    schema = ", ".join(f"{c} string" for c in columns) + ", _text string"
    source = runner.files(
        spark, folder, schema, "csv", header=True, columnNameOfCorruptRecord="_text", quote='"', escape='"',
        ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, pathGlobFilter="*.csv", cleanSource="archive",
        sourceArchiveDir=archive)

    def store(batch, batch_id):
        place = f"run={runner.run_of(batch)}/batch={batch_id}"
        listed = disposable_of(batch.sparkSession) if disposable_of else None
        checked(batch.drop("_text"), listed, raw=raw).write.mode("overwrite").parquet(f"{out}/checked/{place}")
        # The reader fills the text of a bad row only when the cells are read too.
        bad = batch.select("_text", F.struct(*columns).alias("cells")).where(F.col("_text").isNotNull())
        bad.select(F.col("_text").alias("line"), "cells").write.mode("overwrite").parquet(f"{out}/rejected/{place}")

    return runner.for_each(source, checkpoint, store, **options)


def publish(messages: DataFrame, results_of, as_of, out, checkpoint, **options):
    """Publish arriving messages: results_of(batch) gives the broker's answers, every message gets its outcome."""

    def step(batch, batch_id):
        return outbox_ops.publish_decision(batch, results_of(batch), as_of)

    return runner.to_batches(messages, out, checkpoint, step, **options)


def live_counts(changes: DataFrame) -> DataFrame:
    """Entries per mailing and status from change rows (mailing_id, status, delta). Run in update mode."""
    return changes.groupBy("mailing_id", "status").agg(F.sum("delta").alias("count"))


def status_changes(entries: DataFrame, old=None) -> DataFrame:
    """Change rows of entries that moved from `old` (null: new entry) to their status."""
    before = F.lit(None).cast("string") if old is None else F.col(old)
    moves = F.array(
        F.struct(F.col("status").alias("status"), F.lit(1).cast("bigint").alias("delta")),
        F.struct(before.alias("status"), F.lit(-1).cast("bigint").alias("delta")),
    )
    return entries.select("mailing_id", F.explode(moves).alias("m")).select("mailing_id", "m.*").where(
        F.col("status").isNotNull())


def latest_counts(stored: DataFrame) -> DataFrame:
    """Current counts from the stored updates of `live_counts`."""
    current = F.max_by("count", "batch").alias("count")
    return stored.groupBy("mailing_id", "status").agg(current).where(F.col("count") != 0)


def requests_per_minute(attempts: DataFrame, delay="10 minutes", rate=K.RATE_PER_MINUTE) -> DataFrame:
    """Closed minutes with their requests; rows later than `delay` are left out."""
    timed = attempts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    counts = timed.groupBy(F.window("ts", "1 minute")).agg(F.count("*").alias("requests"))
    return counts.select(
        F.col("window.start").cast("timestamp_ntz").alias("minute"), "requests",
        (F.col("requests") > rate).alias("over_limit"))


def outgoing(attempts: DataFrame) -> DataFrame:
    """Send commands whose key depends on the row only, so a repeated command is recognised by its receiver."""
    key = keys.idempotency_key(F.col("mailing_id"), F.col("email"), F.col("attempt"))
    return attempts.select("mailing_id", "email", "attempt", key.alias("idempotency_key"))

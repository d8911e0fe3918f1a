"""Mailings and their queue messages: registration, audits, publishing and backfill."""

from pyspark.sql import DataFrame, functions as F

from postmill import constants as K
from postmill.functions import keys, payload
from postmill.operators.spread import attach, last_per_key, running

OPEN = ("PENDING", "QUEUED")


def first_message(mailings: DataFrame, as_of, queue=K.QUEUE_MAIN) -> DataFrame:
    """The first, unpublished message of each mailing."""
    now = F.lit(as_of).cast("timestamp_ntz")
    return mailings.select(
        keys.row_id(F.lit("outbox"), F.col("id")).alias("id"),
        F.col("id").alias("mailing_id"),
        F.lit(queue).alias("target_queue"),
        payload.job_payload(F.col("id"), F.col("filename"), F.col("storage_url"), now).alias("payload"),
        F.lit(0).alias("attempts"), F.lit(False).alias("published"),
        F.lit(None).cast("timestamp_ntz").alias("published_at"),
        F.lit(None).cast("string").alias("last_error"),
        now.alias("created_at"), now.alias("updated_at"),
    )


def register(uploads: DataFrame, as_of, queue=K.QUEUE_MAIN):
    """(mailing rows, message rows) of accepted uploads; both come from the same input and belong to one commit."""
    now = F.lit(as_of).cast("timestamp_ntz")
    rows = uploads.select(
        "id", "filename", "storage_url", F.lit("PENDING").alias("status"), F.lit(0).alias("attempts"),
        F.lit(None).cast("timestamp_ntz").alias("last_attempt"), F.lit(None).cast("string").alias("error_message"),
        F.col("total_lines").cast("int").alias("total_lines"), F.lit(0).alias("processed_lines"),
        now.alias("created_at"), now.alias("updated_at"),
    )
    return rows, first_message(uploads, as_of, queue)


def orphans(mailings: DataFrame, outbox: DataFrame, statuses=OPEN) -> DataFrame:
    """Mailings in the given statuses (None: all) without any message. Message keys are reduced before the join."""
    if statuses is not None:
        mailings = mailings.where(F.col("status").isin(*statuses))
    owners = outbox.select(F.col("mailing_id").alias("id")).distinct()
    return mailings.join(owners, "id", "left_anti")


def message_counts(mailings: DataFrame, outbox: DataFrame) -> DataFrame:
    """Mailings with their number of messages, 0 where there is none."""
    per = outbox.groupBy(F.col("mailing_id").alias("id")).agg(F.count("id").alias("message_count"))
    return mailings.join(per, "id", "left").withColumn("message_count", F.coalesce("message_count", F.lit(0)))


def orphans_by_count(mailings: DataFrame, outbox: DataFrame) -> DataFrame:
    return message_counts(mailings, outbox).where(F.col("message_count") == 0)


def _named(mailings):
    return mailings.select(
        F.col("id").alias("mailing_id"), "filename", F.col("status").alias("mailing_status"),
        F.col("created_at").alias("mailing_created_at"))


def _messages(outbox):
    return outbox.select(
        "mailing_id", F.col("id").alias("outbox_id"), F.col("published").alias("outbox_published"), "target_queue",
        F.col("created_at").alias("outbox_created_at"))


def with_parent(outbox: DataFrame, mailings: DataFrame) -> DataFrame:
    """Unpublished messages with their mailing."""
    return attach(_messages(outbox.where(~F.col("published"))), _named(mailings), ["mailing_id"], "inner")


def mailings_with_messages(mailings: DataFrame, outbox: DataFrame, statuses=OPEN) -> DataFrame:
    """One row per mailing and message, and one for each mailing without a message; newest mailing first.

    The message side drives the join, so that a mailing with most of the messages spreads over tasks; mailings
    without messages are added by an anti join on the distinct message keys.
    """
    chosen = mailings.where(F.col("status").isin(*statuses))
    matched = attach(_messages(outbox), _named(chosen), ["mailing_id"], "inner")
    alone = _named(orphans(chosen, outbox, None))
    return matched.unionByName(alone, allowMissingColumns=True).orderBy(
        F.desc("mailing_created_at"), F.desc("mailing_id"), "outbox_id")


def nested_messages(mailings, outbox, statuses=OPEN, page_rows=1000, group_rows=None) -> DataFrame:
    """Mailings with a list of their messages, in list pages of at most page_rows messages.

    A mailing has as many rows as it has pages (page 0 with an empty list when it has no message), so no list grows
    with the data and no message is left out.
    """
    chosen = _named(mailings.where(F.col("status").isin(*statuses)))
    messages = _messages(outbox)
    messages = attach(messages, chosen.select("mailing_id"), ["mailing_id"], "left_semi")
    options = {} if group_rows is None else {"group_rows": group_rows}
    placed = running(messages, ["mailing_id"], ["outbox_id"], number="_pos", **options)
    item = F.struct("outbox_id", "outbox_published", "target_queue", "outbox_created_at")
    pages = placed.groupBy("mailing_id", F.floor((F.col("_pos") - 1) / page_rows).alias("page_no")).agg(
        F.sort_array(F.collect_list(item)).alias("messages"))
    kind = "array<struct<outbox_id:%s,outbox_published:boolean,target_queue:string,outbox_created_at:%s>>" % (
        outbox.schema["id"].dataType.simpleString(), outbox.schema["created_at"].dataType.simpleString())
    return (
        attach(pages, chosen, ["mailing_id"], "inner")
        .unionByName(
            chosen.join(pages.select("mailing_id").distinct(), "mailing_id", "left_anti")
            .withColumn("page_no", F.lit(0).cast("bigint"))
            .withColumn("messages", F.array().cast(kind))
        )
        .withColumn("message_count", F.size("messages"))
    )


def _labelled(counts: DataFrame, label="metric", value="count") -> DataFrame:
    """One row of counts -> one row per count."""
    names = counts.columns
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return counts.selectExpr(f"stack({len(names)}, {pairs}) AS ({label}, {value})")


def statistics(mailings: DataFrame, outbox: DataFrame) -> DataFrame:
    """Four labelled counts; each table is read once."""
    first = mailings.agg(F.count("*").alias("Total Mailings"))
    second = outbox.agg(
        F.count("*").alias("Total Outbox Messages"),
        F.count_if(~F.col("published")).alias("Unpublished Messages"),
        F.count_if(F.col("published")).alias("Published Messages"),
    )
    return _labelled(first).unionByName(_labelled(second))


def table_counts(**tables) -> DataFrame:
    """Row count per named table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("count")).select(F.lit(name).alias("table_name"), "count")
        out = one if out is None else out.unionByName(one)
    return out


def queue_monitor(mailings: DataFrame, outbox: DataFrame) -> DataFrame:
    """Eight labelled counts of mailings by status and messages by state."""
    status = F.col("status")
    by_status = mailings.agg(
        F.count_if(status == "PENDING").alias("pending_mailings"),
        F.count_if(status == "QUEUED").alias("queued_mailings"),
        F.count_if(status == "FAILED").alias("failed_mailings"),
        F.count_if(status == "PROCESSING").alias("processing_mailings"),
        F.count_if(status == "COMPLETED").alias("completed_mailings"),
    )
    by_state = outbox.agg(
        F.count_if(~F.col("published")).alias("unpublished_outbox"),
        F.count_if(F.col("published")).alias("published_outbox"),
    )
    without = orphans(mailings, outbox).agg(F.count("*").alias("mailings_without_outbox"))
    return _labelled(by_status).unionByName(_labelled(by_state)).unionByName(_labelled(without))


def backfill_statistics(mailings: DataFrame, outbox: DataFrame) -> DataFrame:
    """Four labelled counts around a backfill run."""
    status = F.col("status")
    by_status = mailings.agg(
        F.count_if(status == "PENDING").alias("pending_mailings"),
        F.count_if(status == "QUEUED").alias("queued_mailings"),
    )
    messages = outbox.agg(F.count_if(~F.col("published")).alias("unpublished_outbox"))
    without = orphans(mailings, outbox).agg(F.count("*").alias("mailings_without_outbox"))
    return _labelled(by_status).unionByName(_labelled(messages)).unionByName(_labelled(without))


def publish_decision(outbox, results, as_of, max_attempts=K.OUTBOX_MAX_ATTEMPTS) -> DataFrame:
    """Each message with its `outcome` and next values.

    results: message_id, seq, ok, error, possibly several per message after redelivery; one success is enough.
    Outcomes: dead_letter (attempts used up), published, failed (one more attempt), unchanged (no result or done).
    """
    per = last_per_key(
        results.select(F.col("message_id").alias("id"), "seq", "ok", F.col("error").alias("_error")),
        ["id"], ["seq"], F.bool_or("ok").alias("_ok"),
    ).select("id", "_error", "_ok")
    open_ = ~F.col("published")
    outcome = (
        F.when(open_ & (F.col("attempts") >= max_attempts), "dead_letter")
        .when(open_ & F.col("_ok"), "published")
        .when(open_ & ~F.col("_ok"), "failed")
        .otherwise("unchanged")
    )
    now = F.lit(as_of).cast("timestamp_ntz")
    done, failed = F.col("outcome") == "published", F.col("outcome") == "failed"
    out = outbox.join(per, "id", "left").withColumn("outcome", outcome)
    if "published_at" not in outbox.columns:
        out = out.withColumn("published_at", F.lit(None).cast("timestamp_ntz"))
    return out.withColumns({
        "published": F.col("published") | done,
        "published_at": F.when(done, now).otherwise(F.col("published_at")),
        "attempts": F.col("attempts") + failed.cast("int"),
        "last_error": F.when(failed, F.col("_error")).otherwise(F.col("last_error")),
    }).drop("_ok", "_error")


def publish_batch(outbox: DataFrame, results, as_of, size=K.OUTBOX_BATCH, max_attempts=K.OUTBOX_MAX_ATTEMPTS) -> DataFrame:
    """One poll: the decision on the `size` oldest unpublished messages. Failed ones stay unpublished for a later poll."""
    due = outbox.where(~F.col("published")).orderBy("created_at", "id").limit(size)
    return publish_decision(due, results, as_of, max_attempts)


def count_lines(mailings: DataFrame, progress: DataFrame) -> DataFrame:
    """Next mailings with the number of lines handled so far (progress: mailing_id, processed_lines; the highest counts)."""
    seen = progress.groupBy(F.col("mailing_id").alias("id")).agg(F.max("processed_lines").alias("_lines"))
    return mailings.join(seen, "id", "left").withColumn(
        "processed_lines", F.coalesce(F.col("_lines").cast("int"), F.col("processed_lines"))).drop("_lines")


def split_published(decided: DataFrame, as_of):
    """(next outbox, outbox dead letters): a dead letter is copied over and leaves the outbox."""
    dead = decided.where(F.col("outcome") == "dead_letter").select(
        keys.row_id(F.lit("outbox-dead"), F.col("id")).alias("id"), "mailing_id",
        F.coalesce("last_error", F.lit(K.OUTBOX_DEAD_TEXT)).alias("error"), "attempts", "payload",
        F.lit(as_of).cast("timestamp_ntz").alias("created_at"),
    )
    return decided.where(F.col("outcome") != "dead_letter").drop("outcome"), dead


def backfill(mailings: DataFrame, outbox: DataFrame, as_of, dry_run=False):
    """(plan, messages): every open mailing without message, and the messages to append (none in a dry run)."""
    plan = orphans(mailings, outbox).select(
        "id", "filename", "storage_url", "status", "created_at",
        F.when(F.col("storage_url").isNull(), "failed").otherwise("created").alias("outcome"))
    messages = first_message(plan.where(F.col("outcome") == "created"), as_of)
    return plan, messages.limit(0) if dry_run else messages

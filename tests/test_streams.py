"""Streams over several files: equal to their batch twins, also after stop, restart and replay."""

import datetime

import pytest
from pyspark.sql import Window, functions as F

from postmill.operators import delivery, intake, lookups, outbox, schedule
from postmill.plans import views as v
from postmill.streaming import jobs, runner, timers

SF = "/root/testdata/sf0.001"
START = datetime.datetime(2024, 1, 1)


def pieces(df, path, n=4, by="line_no"):
    """Write a table as n files in the order of a column, one write after the other."""
    spans = df.withColumn("_p", F.ntile(n).over(Window.orderBy(by))).cache()
    for i in range(1, n + 1):
        spans.where(F.col("_p") == i).drop("_p").coalesce(1).write.mode("append").parquet(str(path))
    spans.unpersist()
    return str(path)


def add(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


@pytest.fixture(scope="module")
def mail(spark):
    rows = v.mail_rows_from(v.table(spark, SF, "orders"))
    return intake.normalized(rows).where(F.col("email") != "").select("mailing_id", "email", "line_no")


def test_dedupe_over_batches_and_restart(spark, mail, tmp_path, rows):
    source = pieces(mail, tmp_path / "in")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")
    stream = runner.files(spark, source, mail.schema, per_trigger=1)
    runner.finish(jobs.store_unseen(stream, out, checkpoint))
    want = rows(mail.groupBy("mailing_id", "email").agg(F.min("line_no")))
    assert rows(runner.stored(spark, out), "mailing_id", "email", "line_no") == want
    assert runner.stored(spark, out).select("batch").distinct().count() > 1
    mail.limit(100).coalesce(1).write.mode("append").parquet(source)
    add(spark, source, [("new", "n@x.org", 1), ("new", "n@x.org", 2)], mail.schema)
    runner.finish(jobs.store_unseen(runner.files(spark, source, mail.schema), out, checkpoint))
    assert rows(runner.stored(spark, out), "mailing_id", "email", "line_no") == sorted(want + [("new", "n@x.org", 1)], key=repr)


def test_state_dedupe(spark, mail, tmp_path, rows):
    source = pieces(mail, tmp_path / "in", 3)
    want = rows(mail.select("mailing_id", "email").distinct())
    exact = jobs.dedupe(runner.files(spark, source, mail.schema, per_trigger=1).select("mailing_id", "email"))
    runner.finish(runner.to_files(exact, str(tmp_path / "a"), str(tmp_path / "ca")))
    assert rows(spark.read.parquet(str(tmp_path / "a"))) == want
    timed = runner.files(spark, source, mail.schema, per_trigger=1).withColumn(
        "at", (F.lit(1704067200) + F.col("line_no")).cast("timestamp"))
    within = jobs.dedupe_within(timed, "at", "30 days")
    runner.finish(runner.to_files(within, str(tmp_path / "b"), str(tmp_path / "cb")))
    assert rows(spark.read.parquet(str(tmp_path / "b")), "mailing_id", "email") == want


def test_stop_after_some_files_and_go_on(spark, mail, tmp_path, rows):
    parts = [mail.where(F.col("line_no") % 3 == i) for i in range(3)]
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(source)
        if i != 1:  # the second file arrives while no job runs
            runner.finish(runner.to_files(runner.files(spark, source, mail.schema), out, checkpoint))
    assert rows(spark.read.parquet(out)) == rows(mail)


def test_a_lost_checkpoint_with_other_batches_adds_nothing(spark, mail, tmp_path, rows):
    source, out = pieces(mail, tmp_path / "in", 3), str(tmp_path / "out")
    for check, files in (("c1", 1), ("c2", 3)):  # the second run has lost the checkpoint of the first
        stream = runner.files(spark, source, mail.schema, per_trigger=files)
        runner.finish(jobs.store_unseen(stream, out, str(tmp_path / check)))
    assert rows(runner.stored(spark, out), "mailing_id", "email", "line_no") == rows(
        mail.groupBy("mailing_id", "email").agg(F.min("line_no")))


def test_retry_timers(spark, tmp_path, rows):
    schema = "mailing_id string, attempt int, ts timestamp_ntz"
    minute = datetime.timedelta(minutes=1)
    failures = [("a", 0, START), ("a", 0, START), ("b", 1, START + minute), ("a", 1, START + 3 * minute),
                ("c", 2, START + 4 * minute), ("a", 2, START + 12 * minute), ("d", 0, START + 20 * minute)]
    source = str(tmp_path / "in")
    for row in failures:
        add(spark, source, [row], schema)
    stream = runner.files(spark, source, schema, per_trigger=2)
    runner.finish(runner.to_files(timers.delayed_retry(stream), str(tmp_path / "out"), str(tmp_path / "check")))
    got = rows(spark.read.parquet(str(tmp_path / "out")).withColumn("at", F.col("at").cast("timestamp_ntz")))
    assert got == sorted([
        ("a", "redelivered", 1, START + minute), ("b", "redelivered", 2, START + 6 * minute),
        ("a", "redelivered", 2, START + 8 * minute), ("c", "dead_letter", 3, START + 4 * minute),
        ("a", "dead_letter", 3, START + 12 * minute)], key=repr)
    batch = delivery.job_step(spark.createDataFrame([(*f, None, None, None) for f in failures[2:6]], schema
                              + ", filename string, payload string, error string"))
    twin = [(r.mailing_id, "dead_letter" if r.available_at is None else "redelivered", r.attempts,
             r.available_at or r.ts) for r in batch.collect()]
    assert set(twin) <= set(got)


def test_late_rows_reach_their_state(spark, tmp_path, rows):
    sec = lambda n: START + datetime.timedelta(seconds=n)
    schema = "mailing_id string, attempt int, ts timestamp_ntz"
    source = str(tmp_path / "failures")
    for row in [("a", 0, sec(4000)), ("z", 0, sec(4001)), ("b", 2, sec(10)), ("c", 0, sec(20)), ("z", 1, sec(9000))]:
        add(spark, source, [row], schema)
    stream = runner.files(spark, source, schema, per_trigger=1)
    runner.finish(runner.to_files(timers.delayed_retry(stream), str(tmp_path / "out"), str(tmp_path / "check")))
    got = rows(spark.read.parquet(str(tmp_path / "out")), "mailing_id", "outcome", "attempts", F.col("at").cast("timestamp_ntz"))
    assert got == sorted([("a", "redelivered", 1, sec(4060)), ("z", "redelivered", 1, sec(4061)),
                          ("b", "dead_letter", 3, sec(10)), ("c", "redelivered", 1, sec(80))], key=repr)

    schema = "mailing_id string, email string, status string, ts timestamp_ntz, seq bigint"
    source = str(tmp_path / "events")
    # When the third and fourth arrive, the watermark is at 5000; a's late SENT comes after its SENDING, b has only a late row.
    for row in [("m", "a", "SENDING", sec(4900), 1), ("m", "z", "SENT", sec(5000), 2), ("m", "a", "SENT", sec(4950), 3),
                ("m", "b", "SENDING", sec(100), 4), ("m", "z", "SENT", sec(9000), 5)]:
        add(spark, source, [row], schema)
    stream = runner.files(spark, source, schema, per_trigger=1)
    runner.finish(runner.to_files(timers.in_flight_timeout(stream), str(tmp_path / "out2"), str(tmp_path / "check2")))
    assert rows(spark.read.parquet(str(tmp_path / "out2")), "email", "status", F.col("last_attempt").cast("timestamp_ntz"),
                F.col("timed_out_at").cast("timestamp_ntz")) == [("b", "SENDING", sec(100), sec(400))]


def test_timeouts_follow_the_last_status(spark, tmp_path, rows):
    schema = "mailing_id string, email string, status string, ts timestamp_ntz, seq bigint"
    sec = lambda n: START + datetime.timedelta(seconds=n)
    batches = [
        [("m", "a", "SENDING", sec(0), 1), ("m", "b", "SENDING", sec(1), 2), ("m", "c", "PROCESSING", sec(2), 3)],
        [("m", "b", "SENT", sec(100), 4), ("m", "a", "SENDING", sec(200), 5)],
        [("m", "z", "SENT", sec(450), 6)],
        [("m", "d", "SENDING", sec(455), 7), ("m", "z", "SENT", sec(600), 8)],
    ]
    source = str(tmp_path / "in")
    for batch in batches:
        add(spark, source, batch, schema)
    stream = runner.files(spark, source, schema, per_trigger=1)
    runner.finish(runner.to_files(timers.in_flight_timeout(stream), str(tmp_path / "out"), str(tmp_path / "check")))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert rows(got, "email", "status", F.col("last_attempt").cast("timestamp_ntz"),
                F.col("timed_out_at").cast("timestamp_ntz")) == [
        ("a", "SENDING", sec(200), sec(500)), ("c", "PROCESSING", sec(2), sec(32))]
    state = spark.createDataFrame([("a", "SENDING", sec(200)), ("d", "SENDING", sec(455))],
                                  "email string, status string, last_attempt timestamp_ntz")
    assert [r.email for r in lookups.stale_entries(state, sec(600)).collect()] == ["a"]


def test_combine_keeps_the_last_row_of_a_hot_key(spark):
    df = spark.range(5000).select(F.lit("hot").alias("k"), F.col("id").alias("ts"))
    out = runner.combine_last(df.coalesce(1), ["k"], ["ts"])
    assert out.count() < 10 and out.agg(F.max("ts")).first()[0] == 4999


def test_rate_windows_and_late_rows(spark, tmp_path, rows):
    attempts = v.send_attempts_from(v.table(spark, SF, "events")).select("event_id", "ts")
    source = pieces(attempts, tmp_path / "in", 4, "ts")
    add(spark, source, [(-1, START - datetime.timedelta(days=9))], attempts.schema)
    add(spark, source, [(-2, START + datetime.timedelta(days=90))], attempts.schema)
    counts = jobs.requests_per_minute(runner.files(spark, source, attempts.schema, per_trigger=1))
    runner.finish(runner.to_files(counts, str(tmp_path / "out"), str(tmp_path / "check")))
    want = schedule.per_minute(attempts)
    assert rows(spark.read.parquet(str(tmp_path / "out")), "minute", "requests", "over_limit") == rows(
        want, "minute", "requests", "over_limit")


def test_live_counts(spark, tmp_path, rows):
    schema = "mailing_id string, was string, status string"
    source = str(tmp_path / "in")
    for batch in ([("m", None, "PENDING"), ("m", None, "PENDING"), ("n", None, "PENDING")],
                  [("m", "PENDING", "SENDING"), ("n", "PENDING", "SENT")], [("m", "SENDING", "FAILED")]):
        add(spark, source, batch, schema)
    stream = runner.files(spark, source, schema, per_trigger=1)
    counts = jobs.live_counts(jobs.status_changes(stream, "was"))
    runner.finish(runner.to_batches(counts, str(tmp_path / "out"), str(tmp_path / "check"), mode="update"))
    assert rows(jobs.latest_counts(runner.stored(spark, str(tmp_path / "out"))), "mailing_id", "status", "count") == [
        ("m", "FAILED", 1), ("m", "PENDING", 1), ("n", "SENT", 1)]


def test_publishing_equals_batch(spark, tmp_path, rows):
    part = v.table(spark, SF, "part")
    box, results = v.outbox_from(part), v.publish_results_from(part)
    source = pieces(box, tmp_path / "in", 3, "id")
    stream = runner.files(spark, source, box.schema, per_trigger=1)
    out = str(tmp_path / "out")
    runner.finish(jobs.publish(stream, lambda batch: results, v.AS_OF_2024, out, str(tmp_path / "check")))
    want = outbox.publish_decision(box, results, v.AS_OF_2024)
    assert rows(runner.stored(spark, out), "id", "outcome", "attempts") == rows(want, "id", "outcome", "attempts")


def test_checked_stream_equals_batch(spark, tmp_path, rows):
    lines = v.mail_rows_from(v.table(spark, SF, "orders"))
    source = pieces(lines, tmp_path / "in", 3)
    listed = v.disposable(spark)
    stream = jobs.checked(runner.files(spark, source, lines.schema, per_trigger=1), listed, v.domain_mx(spark))
    runner.finish(runner.to_files(stream, str(tmp_path / "out"), str(tmp_path / "check")))
    want = intake.validate(intake.normalized(lines), listed, v.domain_mx(spark), raw="raw_email")
    columns = ("line_no", "email", "is_valid", "reason", "details")
    assert rows(spark.read.parquet(str(tmp_path / "out")), *columns) == rows(want, *columns)


def test_timers_touch_a_bounded_number_of_states(spark, tmp_path, rows):
    sec = lambda n: START + datetime.timedelta(seconds=n)
    schema = "mailing_id string, attempt int, ts timestamp_ntz"
    source = str(tmp_path / "in")
    add(spark, source, [(f"m{i}", i % 3, sec(i % 50)) for i in range(2000)] + [(None, 0, sec(5))], schema)
    add(spark, source, [("m0", 0, sec(0)), ("m1", 2, sec(1)), ("z", 2, sec(9000))], schema)
    add(spark, source, [("m0", 0, sec(9001)), ("z", 2, sec(9002))], schema)
    stream = runner.files(spark, source, schema, per_trigger=1)
    query = runner.finish(runner.to_files(
        timers.delayed_retry(stream, buckets=16), str(tmp_path / "out"), str(tmp_path / "check")))
    got = rows(spark.read.parquet(str(tmp_path / "out")), "mailing_id", "outcome", "attempts", F.col("at").cast("timestamp_ntz"))
    want = [(f"m{i}", *(("dead_letter", 3, sec(i % 50)) if i % 3 == 2 else
                        ("redelivered", i % 3 + 1, sec(i % 50 + (60, 300)[i % 3])))) for i in range(2000)]
    want += [(None, "redelivered", 1, sec(65)), ("m1", "dead_letter", 3, sec(1)), ("z", "dead_letter", 3, sec(9000))]
    assert got == sorted(want, key=repr)
    assert max(s.numRowsUpdated for p in query.recentProgress for s in p.stateOperators) <= 16 * 4
    # What is closed for an hour is forgotten: the states hold z, and m0, which came again as a new job.
    assert query.recentProgress[-1].stateOperators[0].numRowsTotal <= 2 * 4

"""State transitions: upserts, retries, claims, publishing, backfill, recovery, removal."""

import datetime

import pytest
from pyspark.sql import functions as F

from postmill.operators import delivery as D, lookups as L, outbox as O, recovery as C, reports as R

NOW = datetime.datetime(2024, 5, 1, 12)
ENTRY = ("id string, mailing_id string, email string, token string, status string, attempts int, "
         "last_attempt timestamp_ntz, external_id string, invalid_reason string, validation_details string, "
         "created_at timestamp_ntz, updated_at timestamp_ntz")
OUTCOME = ("event_id bigint, ts timestamp_ntz, mailing_id string, email string, token string, status string, "
           "external_id string, reason string")
MAILING = ("id string, filename string, storage_url string, status string, last_attempt timestamp_ntz, "
           "created_at timestamp_ntz, updated_at timestamp_ntz")
MESSAGE = ("id string, mailing_id string, target_queue string, attempts int, published boolean, last_error string, "
           "created_at timestamp_ntz, payload string")
PROGRESS = ("mailing_id string, total_rows int, processed_rows int, last_processed_line int, status string, "
            "created_at timestamp_ntz, updated_at timestamp_ntz")


def ago(**kw):
    return NOW - datetime.timedelta(**kw)


def entry(i, status, **kw):
    row = dict(id=f"e{i}", mailing_id="m", email=f"u{i}@x.org", token=f"t{i}", status=status, attempts=0,
               last_attempt=None, external_id=None, invalid_reason=None, validation_details=None, created_at=ago(days=1),
               updated_at=ago(days=1)) | kw
    return tuple(row.values())


def mailing(i, status, last=None, **kw):
    row = dict(id=f"m{i}", filename=f"f{i}.csv", storage_url=f"/s/f{i}", status=status, last_attempt=last,
               created_at=ago(days=1, minutes=-i), updated_at=ago(hours=1)) | kw
    return tuple(row.values())


def test_outcome_upsert(spark):
    entries = spark.createDataFrame([
        entry(1, "SENDING", attempts=1), entry(2, "FAILED", attempts=2, external_id="old", invalid_reason="r"),
        entry(3, "PENDING"), entry(4, "SENT", external_id="keep")], ENTRY)
    outcomes = spark.createDataFrame([
        (1, ago(minutes=9), "m", "u1@x.org", "new1", "FAILED", None, "x" * 70),
        (2, ago(minutes=5), "m", "u1@x.org", "new2", "SENT", "ext", None),
        (3, ago(minutes=4), "m", "u2@x.org", "new3", "SENT", None, None),
        (4, ago(minutes=3), "m", "u4@x.org", "new4", "FAILED", None, "y" * 70),
        (5, ago(minutes=2), "m", "u9@x.org", "new5", "SENT", "e9", None)], OUTCOME)
    out = {r.email: r for r in D.upsert_outcomes(entries, outcomes).collect()}
    assert len(out) == 5
    one, two, three, four, nine = (out[f"u{i}@x.org"] for i in (1, 2, 3, 4, 9))
    assert (one.status, one.attempts, one.token, one.external_id, one.invalid_reason) == ("SENT", 3, "t1", "ext", None)
    assert (two.status, two.attempts, two.external_id, two.invalid_reason) == ("SENT", 3, "old", None)
    assert (three.status, three.attempts, three.last_attempt) == ("PENDING", 0, None)
    assert (four.status, four.invalid_reason, four.external_id) == ("FAILED", "y" * 50, "keep")
    assert four.validation_details == '{"error":"' + "y" * 70 + '"}'
    assert (nine.token, nine.attempts, nine.status, nine.created_at) == ("new5", 1, "SENT", ago(minutes=2))


def test_invalid_upsert_overwrites_even_sent(spark):
    entries = spark.createDataFrame([entry(1, "SENT"), entry(2, "PENDING")], ENTRY)
    bad = spark.createDataFrame([("m", "u1@x.org", "syntax", "d"), ("m", "u7@x.org", None, "d")],
                                "mailing_id string, email string, reason string, details string")
    out = {r.email: (r.status, r.invalid_reason, r.token) for r in D.upsert_invalid(entries, bad, NOW).collect()}
    assert out == {"u1@x.org": ("INVALID", "syntax", "t1"), "u2@x.org": ("PENDING", None, "t2"),
                   "u7@x.org": ("INVALID", "Unknown", "")}


def attempts(spark, *rows):
    return spark.createDataFrame(
        [(i, NOW, "m", f"u{i}@x.org", a, s, e) for i, (a, s, e) in enumerate(rows)],
        "event_id bigint, ts timestamp_ntz, mailing_id string, email string, attempt int, http_status int, error string")


def test_failure_step_and_waiting(spark):
    tried = attempts(spark, (1, 500, None), (2, 429, None), (3, 503, "busy"), (1, 404, None), (1, 200, None))
    step = D.failure_step(tried)
    got = {r.event_id: (r.next_status, r.next_attempt_at) for r in step.collect()}
    later = datetime.timedelta(seconds=1)
    assert got == {0: ("PENDING", NOW + later), 1: ("PENDING", NOW + 2 * later), 2: ("FAILED", None), 3: ("FAILED", None)}
    dead = {r.email: (r.reason, r.attempts, r.last_error, r.kind) for r in D.dead_letters(step).collect()}
    assert dead == {
        "u2@x.org": ("Max retries exceeded (3/3) - 503 Service Unavailable", 3, "[503] busy", "entry"),
        "u3@x.org": ("Permanent error - 404 Not Found - resource does not exist", 1, "[404] Unknown error", "entry")}
    entries = spark.createDataFrame([entry(i, "SENDING") for i in range(5)], ENTRY)
    after = D.apply_failures(entries, step)
    assert {r.email: r.status for r in after.collect()} == {
        "u0@x.org": "PENDING", "u1@x.org": "PENDING", "u2@x.org": "FAILED", "u3@x.org": "FAILED", "u4@x.org": "SENDING"}
    assert [r.email for r in D.ready(after, NOW).collect()] == []
    assert [r.email for r in D.ready(after, NOW + later).collect()] == ["u0@x.org"]
    totals = R.worker_totals(D.decided(tried)).first()
    assert tuple(totals)[:5] == (5, 1, 4, 2, 2)


def test_jittered_step_stays_in_bounds(spark):
    step = D.failure_step(attempts(spark, *[(2, 500, None)] * 50), jitter_key=["mailing_id", "email"])
    low, high, kinds = step.agg(F.min("delay_ms"), F.max("delay_ms"), F.count_distinct("delay_ms")).first()
    assert 1600 <= low < high <= 2400 and kinds > 30


def test_job_step(spark):
    jobs = spark.createDataFrame(
        [(f"m{a}", "f.csv", a, NOW, e, '{"mailingId":"m","filename":"f.csv","attempt":%d}' % a)
         for a, e in ((0, "boom"), (1, None), (2, None), (7, "x"))],
        "mailing_id string, filename string, attempt int, ts timestamp_ntz, error string, payload string")
    out = D.job_step(jobs)
    got = {r.mailing_id: (r.target_queue, r.available_at, r.attempts, r.error_message) for r in out.collect()}
    assert got == {
        "m0": ("mailing.jobs.retry.1", NOW + datetime.timedelta(seconds=60), 1, "boom"),
        "m1": ("mailing.jobs.retry.2", NOW + datetime.timedelta(seconds=300), 2, "Processing failed, will retry"),
        "m2": ("mailing.jobs.dlq", None, 3, "Max retry attempts exceeded"), "m7": ("mailing.jobs.dlq", None, 3, "x")}
    assert sorted((r.email, r.reason, r.kind) for r in D.job_dead_letters(out).collect()) == [
        ("f.csv", "Max retry attempts exceeded", "job"), ("f.csv", "x", "job")]


def test_failure_threshold_is_strict(spark):
    counts = spark.createDataFrame([("a", 10, 2), ("b", 10, 3), ("c", 0, 0)], "mailing_id string, total int, failed int")
    out = {r.mailing_id: (r.job_failed, r.error) for r in D.failure_verdicts(counts).collect()}
    assert out == {"a": (False, None), "b": (True, "Failure rate 30.0% exceeds threshold"), "c": (False, None)}
    mailings = spark.createDataFrame([(x, "PROCESSING", NOW, None, NOW) for x in "abd"], "id string, status string, "
                                     "last_attempt timestamp_ntz, error_message string, updated_at timestamp_ntz")
    done = {r.id: (r.status, r.last_attempt) for r in D.finish_mailings(mailings, D.failure_verdicts(counts), NOW).collect()}
    assert done == {"a": ("COMPLETED", None), "b": ("FAILED", None), "d": ("PROCESSING", NOW)}


@pytest.mark.parametrize("times", [1, 2, 5])
def test_one_claim_wins(spark, times):
    mailings = spark.createDataFrame([mailing(1, "PENDING"), mailing(2, "PENDING")], MAILING)
    wanted = spark.createDataFrame([("m1",)] * times, "id string")
    out = C.claim(mailings, wanted, NOW)
    assert {r.id: (r.claimed, r.status, r.last_attempt) for r in out.collect()} == {
        "m1": (True, "PROCESSING", NOW), "m2": (False, "PENDING", None)}
    again = C.claim(out.drop("claimed"), wanted, NOW)
    assert again.where("claimed").count() == 0


def test_claim_rules(spark):
    cases = [mailing(1, "QUEUED"), mailing(2, "FAILED"), mailing(3, "COMPLETED"), mailing(4, "PROCESSING"),
             mailing(5, "PROCESSING", ago(seconds=31)), mailing(6, "PROCESSING", ago(seconds=30))]
    mailings = spark.createDataFrame(cases, MAILING)
    out = C.claim(mailings, mailings.select("id"), NOW)
    assert sorted(r.id for r in out.where("claimed").collect()) == ["m1", "m2", "m4", "m5"]


def test_publishing(spark):
    rows = [("a", 0, False), ("b", 1, False), ("c", 5, False), ("d", 0, True), ("e", 2, False), ("f", 4, False)]
    box = spark.createDataFrame([(i, "m1", "q", n, p, "old" if n else None, NOW, "{}") for i, n, p in rows], MESSAGE)
    results = spark.createDataFrame(
        [("a", 1, True, None), ("b", 1, False, "down"), ("b", 2, False, "still down"), ("c", 1, True, None),
         ("f", 1, False, "x"), ("f", 2, True, None)], "message_id string, seq int, ok boolean, error string")
    decided = O.publish_decision(box, results, NOW)
    got = {r.id: (r.outcome, r.published, r.attempts, r.last_error) for r in decided.collect()}
    assert got == {
        "a": ("published", True, 0, None), "b": ("failed", False, 2, "still down"), "c": ("dead_letter", False, 5, "old"),
        "d": ("unchanged", True, 0, None), "e": ("unchanged", False, 2, "old"), "f": ("published", True, 4, "old")}
    left, dead = O.split_published(decided, NOW)
    assert left.count() == 5 and [(r.mailing_id, r.error, r.attempts) for r in dead.collect()] == [("m1", "old", 5)]


def test_backfill_adds_one_message_once(spark):
    mailings = spark.createDataFrame(
        [mailing(1, "PENDING"), mailing(2, "QUEUED", storage_url=None), mailing(3, "COMPLETED"), mailing(4, "PENDING")],
        MAILING)
    box = spark.createDataFrame([("x", "m4", "q", 0, False, None, NOW, "{}")], MESSAGE)
    plan, messages = O.backfill(mailings, box, NOW)
    assert {r.id: r.outcome for r in plan.collect()} == {"m1": "created", "m2": "failed"}
    assert [(r.mailing_id, r.published, r.attempts) for r in messages.collect()] == [("m1", False, 0)]
    assert O.backfill(mailings, box, NOW, dry_run=True)[1].count() == 0
    after = box.unionByName(messages.select(*box.columns))
    plan, messages = O.backfill(mailings, after, NOW)
    assert [r.id for r in plan.collect()] == ["m2"] and messages.count() == 0


def test_recovery(spark):
    entries = spark.createDataFrame(
        [entry(i, "SENDING", last_attempt=ago(minutes=10)) for i in range(3)]
        + [entry(3, "SENDING", last_attempt=ago(seconds=30)), entry(4, "SENDING")], ENTRY)
    progress = spark.createDataFrame(
        [("a", 1000, 450, 450, "RUNNING", NOW, ago(minutes=15)), ("b", 100, 50, 50, "RUNNING", NOW, ago(minutes=1))],
        PROGRESS)
    mailings = spark.createDataFrame(
        [mailing(1, "PROCESSING", ago(minutes=20)), mailing(2, "PROCESSING", ago(minutes=1), updated_at=ago(minutes=1))],
        MAILING)
    report = C.recovery_report(entries, mailings, progress, NOW).first()
    assert tuple(report) == (3, 3, 2, 2, True)
    after = C.recover_entries(entries, NOW)
    assert {r.id: r.status for r in after.collect()} == {
        "e0": "PENDING", "e1": "PENDING", "e2": "PENDING", "e3": "SENDING", "e4": "SENDING"}
    assert {r.mailing_id: r.status for r in C.recover_progress(progress, NOW).collect()} == {"a": "PAUSED", "b": "RUNNING"}
    kept = {r.id: (r.status, r.last_attempt) for r in C.recover_mailings(mailings, NOW).collect()}
    assert kept == {"m1": ("PROCESSING", None), "m2": ("PROCESSING", ago(minutes=1))}
    fresh = C.recovery_report(after, mailings.where("id = 'm2'"), progress.where("mailing_id = 'b'"), NOW).first()
    assert not fresh.needs_recovery


def test_progress(spark):
    stored = spark.createDataFrame([("m", 10, 5, 5, "RUNNING", ago(days=1), ago(days=1))], PROGRESS)
    entries = spark.createDataFrame([entry(1, "SENT"), entry(2, "FAILED"), entry(3, "PENDING")], ENTRY)
    out = C.progress_upsert(stored, C.refreshed_progress(entries), NOW).first()
    assert (out.total_rows, out.processed_rows, out.status, out.updated_at) == (3, 2, "RUNNING", NOW)
    done = C.refreshed_progress(entries.where("status != 'PENDING'")).first()
    assert (done.processed_rows, done.status) == (2, "COMPLETED")
    totals = spark.createDataFrame([("m", 10, "COMPLETED"), ("n", 4, "FAILED")],
                                   "mailing_id string, total_rows int, status string")
    closed = {r.mailing_id: tuple(r)[1:5] for r in C.complete(stored, totals, NOW).collect()}
    assert closed == {"m": (10, 10, 5, "COMPLETED"), "n": (4, 4, 4, "FAILED")}


def test_pages(spark, monkeypatch):
    entries = spark.createDataFrame([entry(i, "SENT" if i % 2 else "PENDING") for i in range(30)], ENTRY)
    first = L.page(entries, "m", "sent", 10, 0).collect()
    assert len(first) == 10 and {(r.total, r.has_more) for r in first} == {(15, True)}
    last = L.page(entries, "m", "sent", 10, 10)
    assert {(r.total, r.has_more) for r in last.collect()} == {(15, False)} and last.count() == 5
    monkeypatch.setattr(L, "TOP_ROWS", 0)
    deep = L.page(entries, "m", "sent", 10, 10)
    assert deep.select("id").exceptAll(last.select("id")).count() == 0 and deep.count() == 5
    for bad in ({"limit": 0}, {"limit": 1001}, {"offset": -1}):
        with pytest.raises(ValueError):
            L.page(entries, "m", **bad)
    with pytest.raises(ValueError):
        L.page(entries, "m", "nope")
    row = L.page(entries, "m", "sent", 10, 0).orderBy("created_at", "id").collect()[-1]
    after = L.page_after(entries, "m", row.created_at, row.id, "sent", 10)
    assert after.select("id").exceptAll(last.select("id")).count() == 0 and after.count() == 5


def test_report_of_thirty(spark):
    rows = [entry(i, "SENT" if i < 27 else "FAILED", attempts=1) for i in range(30)]
    out = R.delivery_summary(spark.createDataFrame(rows, ENTRY)).first()
    assert (out.processed, out.sent, out.failed, out.sent_share, out.failed_share, out.invalid_share) == (
        30, 27, 3, 90.0, 10.0, 0.0)


def test_removal(spark):
    entries = spark.createDataFrame([entry(1, "SENT"), entry(2, "SENT", mailing_id="n")], ENTRY)
    mailings = spark.createDataFrame([mailing(1, "SENT", id="m"), mailing(2, "SENT", id="n")], MAILING)
    gone = spark.createDataFrame([("m",), ("m",)], "mailing_id string")
    left = C.purge(gone, mailing_entries=entries, mailings=mailings)
    assert [r.mailing_id for r in left["mailing_entries"].collect()] == ["n"]
    assert [r.id for r in left["mailings"].collect()] == ["n"]


def test_outcomes_at_once_are_like_one_by_one(spark):
    schema = "event_id int, ts timestamp_ntz, mailing_id string, email string, token string, status string, external_id string, reason string"
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    rows = [(1, at(1), "m", "a@x", "n1", "FAILED", None, "why"), (2, at(2), "m", "a@x", "n2", "SENT", "msg-3", None),
            (3, at(3), "m", "a@x", "n3", "FAILED", None, "again"), (4, at(2), "m", "b@x", "n4", "SENT", "msg-1", None),
            (5, at(4), "m", "b@x", "n5", "FAILED", None, "late")]
    entries = spark.createDataFrame(
        [("7", "m", "b@x", "old", "SENDING", 1, None, at(9))],
        "id string, mailing_id string, email string, token string, status string, attempts int, last_attempt timestamp_ntz, next_attempt_at timestamp_ntz"
    ).withColumn("created_at", F.lit(at(0)))
    at_once, single = D.upsert_outcomes(entries, spark.createDataFrame(rows, schema)), entries
    for row in rows:
        single = D.upsert_outcomes(single, spark.createDataFrame([row], schema))
    wanted = ["email", "id", "token", "status", "attempts", "external_id", "invalid_reason", "created_at", "last_attempt", "next_attempt_at"]
    got = sorted(map(tuple, at_once.select(wanted).collect()))
    assert got == sorted(map(tuple, single.select(wanted).collect()))
    assert [(r[0], r[2], r[5], r[7], r[9]) for r in got] == [
        ("a@x", "n1", "msg-3", at(1), None), ("b@x", "old", "msg-1", at(0), at(9))]


def test_a_rejection_keeps_other_columns(spark):
    stored = spark.createDataFrame(
        [("1", "m", "a@x", "t", "SENT", 1, "ext", 5), ("2", "m", "b@x", "t", "SENT", 1, "ext2", 6)],
        "id string, mailing_id string, email string, token string, status string, attempts int, external_id string, next_attempt_at int"
    ).withColumns({"last_attempt": F.lit(None).cast("timestamp_ntz"), "created_at": F.lit(None).cast("timestamp_ntz")})
    bad = spark.createDataFrame([("m", "a@x", "why", "more")], "mailing_id string, email string, reason string, details string")
    out = {r.email: (r.status, r.external_id, r.next_attempt_at) for r in D.upsert_invalid(stored, bad, NOW).collect()}
    assert out == {"a@x": ("INVALID", "ext", 5), "b@x": ("SENT", "ext2", 6)}


def test_unknown_columns_are_not_dropped_silently(spark, tmp_path):
    from postmill.sources import tables

    with pytest.raises(ValueError, match="colour"):
        tables.append(spark.createDataFrame([("m", "red")], "mailing_id string, colour string"), str(tmp_path), "mailing_entries")

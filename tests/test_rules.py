"""Retry rules, keys, texts and payloads."""

import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from postmill.functions import keys, payload, retry, texts


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


CLASSES = [
    (400, None, False, "client_error"), (401, None, False, "client_error"), (403, None, False, "client_error"),
    (404, None, False, "client_error"), (422, None, False, "client_error"), (418, None, False, "client_error"),
    (408, None, True, "timeout"), (429, None, True, "rate_limit"), (500, None, True, "server_error"),
    (502, None, True, "server_error"), (503, None, True, "server_error"), (504, None, True, "server_error"),
    (599, None, True, "server_error"), (None, "connect ECONNREFUSED", True, "network"),
    (None, "getaddrinfo ENOTFOUND", True, "network"), (0, "ETIMEDOUT", True, "network"), (0, "network down", True, "network"),
    (None, "timeout of 5 ms", True, "timeout"), (None, "Timeout", True, "unknown"), (None, None, True, "unknown"),
    (200, None, False, "unknown"), (302, None, True, "unknown"), (600, None, True, "unknown"),
]


@pytest.fixture(scope="module")
def decisions(spark):
    df = spark.createDataFrame([(i, s, e, a) for i, (s, e, _, _) in enumerate(CLASSES) for a in (1, 3)],
                               "i int, status int, error string, attempt int")
    out = df.select("i", "attempt", retry.classify_error(F.col("status"), F.col("error")).alias("c"),
                    retry.retry_decision(F.col("attempt"), F.col("status"), F.col("error")).alias("d")).collect()
    return {(r.i, r.attempt): r for r in out}


def test_classification(decisions):
    assert [(decisions[i, 1].c.retryable, decisions[i, 1].c.category) for i in range(len(CLASSES))] == [
        (r, c) for _, _, r, c in CLASSES]


def test_decision(decisions):
    for i, (_, _, retryable, _) in enumerate(CLASSES):
        first, last = decisions[i, 1].d, decisions[i, 3].d
        assert first.should_retry == retryable and first.move_to_dlq == (not retryable)
        assert last.move_to_dlq and last.delay_ms is None
        assert first.delay_ms == (1000 if retryable else None)
    assert decisions[3, 1].d.reason == "Permanent error - 404 Not Found - resource does not exist"
    assert decisions[5, 1].d.reason == "Permanent error - 418 Client Error - permanent failure"
    assert decisions[8, 1].d.reason == "Retryable error (attempt 1/3) - 500 Internal Server Error"
    assert decisions[8, 3].d.reason == "Max retries exceeded (3/3) - 500 Internal Server Error"
    assert decisions[12, 1].d.reason.endswith("599 Server Error - temporary failure")


def test_backoff(spark):
    df = spark.range(1, 11).withColumn("a", F.col("id").cast("int"))
    got = [r[0] for r in df.orderBy("id").select(retry.backoff_ms(F.col("a"))).collect()]
    assert got == [1000, 2000, 4000, 8000, 16000, 32000, 64000, 128000, 256000, 300000]
    far = spark.range(1).select(retry.backoff_ms(F.lit(2000)), retry.backoff_ms(F.lit(0))).first()
    assert tuple(far) == (300000, 500)


def test_jitter_is_spread_bounded_and_repeatable(spark):
    df = spark.range(20000).select("id", retry.jittered_backoff_ms(F.lit(10), F.col("id")).alias("ms"))
    low, high, mean = df.agg(F.min("ms"), F.max("ms"), F.avg("ms")).first()
    assert 240000 <= low < 242000 and 358000 < high <= 360000 and abs(mean - 300000) < 1500
    assert df.exceptAll(df.repartition(7)).count() == 0


@pytest.mark.parametrize("ms, short, long", [
    (0, "0ms", "0s"), (800, "800ms", "0s"), (1500, "1.5s", "1s"), (60000, "1m", "1m 0s"), (150000, "2m 30s", "2m 30s"),
    (3725000, "62m 5s", "1h 2m"), (97200000, "1620m", "1d 3h"), (12000, "12.0s", "12s")])
def test_durations(spark, ms, short, long):
    c = F.lit(ms).cast("bigint")
    assert one(spark, texts.delay_text(c), texts.long_duration_text(c)) == (short, long)


def test_masks(spark):
    got = one(
        spark, texts.mask_key(F.lit("1234567890123456")), texts.mask_key(F.lit("12345678abc87654321")),
        texts.mask_token(F.lit("short")), texts.mask_token(F.lit("abcdefghijkl")),
        texts.mask_url(F.lit("https://u:p@Host.org:99/a/b?q=1#f")), texts.mask_url(F.lit("http://h.org")),
        texts.mask_url(F.lit("no url")))
    assert got == ("1234567890123456", "12345678...87654321", "***", "abcdef...ijkl", "https://host.org:99/a/b",
                   "http://h.org/", "no url")


def test_percentages(spark):
    n = [F.lit(x).cast("int") for x in (1, 3, 0)]
    assert one(spark, texts.percent(n[0], n[1]), texts.percent(n[0], n[2]), texts.percent_text(n[0], n[1]),
               texts.percent_text(n[1], n[2])) == (33.33, 0.0, "33.33", "0.00")


def test_status_filter():
    assert texts.status_filter("sent") == "SENT" and texts.status_filter(None) is None
    with pytest.raises(ValueError, match="must be one of"):
        texts.status_filter("gone")


def test_keys_equal_plain_hashes(spark):
    m, e = F.lit("m1"), F.lit("a@x.org")
    assert one(spark, keys.idempotency_key(m, e, F.lit(2)), keys.salted_key(m, e, F.lit("s"))) == (
        hashlib.sha256(b"m1:a@x.org:2").hexdigest(), hashlib.sha256(b"m1-a@x.org-s").hexdigest())


def test_tokens(spark):
    df = spark.range(5000).select(F.concat(F.lit("m"), (F.col("id") % 7).cast("string")).alias("m"),
                                  F.concat(F.col("id").cast("string"), F.lit("@x.org")).alias("e"))
    out = df.select(
        keys.hex_token("k", F.col("m"), F.col("e")).alias("h"), keys.hex_token("k", F.col("m"), F.col("e"), 100).alias("l"),
        keys.numeric_code("k", F.col("m"), F.col("e")).alias("n"),
        keys.alphanumeric_token("k", F.col("m"), F.col("e")).alias("a"),
        keys.hex_token("other", F.col("m"), F.col("e")).alias("o"))
    shape = out.agg(
        F.count_distinct("h"), F.count_distinct("a"), F.count_if(~F.col("h").rlike("^[0-9a-f]{32}$")),
        F.count_if(~F.col("l").rlike("^[0-9a-f]{100}$")), F.count_if(~F.col("n").rlike("^[1-9][0-9]{5}$")),
        F.count_if(~F.col("a").rlike("^[A-Z0-9]{8}$")), F.count_if(F.col("h") == F.col("o"))).first()
    assert tuple(shape) == (5000, 5000, 0, 0, 0, 0, 0)
    assert out.exceptAll(df.repartition(9).select(
        keys.hex_token("k", F.col("m"), F.col("e")).alias("h"), keys.hex_token("k", F.col("m"), F.col("e"), 100).alias("l"),
        keys.numeric_code("k", F.col("m"), F.col("e")).alias("n"),
        keys.alphanumeric_token("k", F.col("m"), F.col("e")).alias("a"),
        keys.hex_token("other", F.col("m"), F.col("e")).alias("o"))).count() == 0


def test_payloads(spark):
    at = F.lit(datetime.datetime(2024, 1, 2, 3, 4, 5)).cast("timestamp_ntz")
    first = payload.job_payload(F.lit("m"), F.lit("f.csv"), F.lit(None).cast("string"), at)
    text = one(spark, first)[0]
    assert json.loads(text) == {"mailingId": "m", "filename": "f.csv", "storageUrl": None, "attempt": 0,
                                "createdAt": "2024-01-02T03:04:05.000Z"}
    again, dead = one(spark, payload.retry_payload(F.lit(text), F.lit(1), F.lit("boom"), at),
                      payload.dead_payload(F.lit(text), F.lit("boom"), at, F.lit(3)))
    assert json.loads(again)["attempt"] == 1 and json.loads(again)["lastError"] == "boom"
    assert json.loads(dead) == {"mailingId": "m", "filename": "f.csv", "storageUrl": None, "attempt": 0, "createdAt": "2024-01-02T03:04:05.000Z",
                                "finalError": "boom", "movedToDLQAt": "2024-01-02T03:04:05.000Z", "totalAttempts": 3}


@pytest.mark.parametrize("body, ident, error", [
    ('{"message_id":"a","id":"b"}', "a", '{"message_id":"a","id":"b"}'), ('{"message_id":"","id":"b"}', "b", None),
    ('{"status":"queued"}', "status:queued", None), ('{"error":"quota"}', "status:undefined", "quota"),
    ('{"message":"m","error":"e"}', "status:undefined", "m"), ('not "json"', "status:undefined", '"not \\"json\\""'),
    ("", "status:undefined", "transport"), (None, "status:undefined", "transport")])
def test_responses(spark, body, ident, error):
    df = spark.createDataFrame([(body,)], "b string").withColumn("a", payload.response(F.col("b")))
    got = df.select(payload.message_id(F.col("a")), payload.error_text(F.col("a"), F.col("b"), F.lit("transport"))).first()
    assert got[0] == ident
    assert error is None or got[1] == error


def test_failure_reason_only_when_failed(spark):
    long = "x" * 80
    assert one(spark, texts.failure_reason(F.lit("FAILED"), F.lit(long)), texts.failure_reason(F.lit("SENT"), F.lit(long)),
               texts.failure_details(F.lit("FAILED"), F.lit("a")), texts.failure_details(F.lit("SENT"), F.lit("a")),
               texts.audit_text(F.lit(None).cast("int"), F.lit("down"))) == (
        "x" * 50, None, '{"error":"a"}', None, "[N/A] down")


def test_payload_updates_keep_unknown_keys_and_nulls(spark):

    from postmill.functions import payload

    text = '{"mailingId":"7","storageUrl":null,"extra":{"a":[1,2.5]},"attempt":0,"lastError":"old"}'
    row = spark.createDataFrame([(text, "why", None)], "p string, e string, none string").select(
        payload.retry_payload(F.col("p"), F.lit(2), F.col("e"), F.lit(None).cast("timestamp")).alias("a"),
        payload.dead_payload(F.col("p"), F.col("none"), F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit(3)).alias("b")).first()
    assert json.loads(row.a) == {"mailingId": "7", "storageUrl": None, "extra": {"a": [1, 2.5]}, "attempt": 2, "lastError": "why"}
    assert json.loads(row.b) == {"mailingId": "7", "storageUrl": None, "extra": {"a": [1, 2.5]}, "attempt": 0, "lastError": "old",
                                 "movedToDLQAt": "2024-01-01T00:00:00.000Z", "totalAttempts": 3}

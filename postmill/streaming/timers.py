"""Keyed jobs with event-time timers: delayed retry and in-flight time-out.

A key has one small state value. It is released `keep` seconds of event time after its last event when nothing is due any
more, so the state holds the open keys and those that were closed a short while ago; within that time repeated and late
rows are recognised. Spark's own time to live counts processing time and does not go with event-time timers, so the release
is a timer too.

Every call between a processor and its state store is a message to another process. Keys are therefore dealt into `buckets`
by their hash; a bucket's keys are read, written and timed together, so a micro-batch costs a few messages per bucket that it
touches, however many rows it has. More buckets suit states of many millions of open keys; a query keeps the number of its
first start.
"""

import datetime

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor

from postmill import constants as K
from postmill.streaming import runner

#: Seconds of event time for which a closed key is still known.
KEEP_SECONDS = 3600
#: Groups of keys whose state is kept together.
BUCKETS = 512


def _bucketed(rows, keys, buckets):
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets))).groupBy("bucket")


def _micros(moment):
    return round(moment.timestamp() * 1_000_000)


def _moment(micros):
    whole, part = divmod(micros, 1_000_000)
    return datetime.datetime.fromtimestamp(whole).replace(microsecond=part)


class _Bucket(StatefulProcessor):
    """The keys of one bucket, as rows of `fields` in one value, and one timer for the first of them that wants one.

    A subclass has `fields`; `read` and `rows`, from these rows to its keys by name and back; `deadline` of a key in
    milliseconds; `take(keys, rows)`, which yields output of new rows; `fire(keys, name, now)`, which yields output of a key whose
    deadline has come and drops the key or moves its deadline beyond now.
    """

    fields = {}

    def init(self, handle):
        self.handle = handle
        arrays = ", ".join(f"{name} array<{kind}>" for name, kind in self.fields.items())
        self.state = handle.getValueState("keys", f"{arrays}, timer bigint")

    def _load(self):
        old = self.state.get()
        return (self.read(zip(*old[:-1])), old[-1]) if old else ({}, None)

    def _store(self, keys, timer, now=None):
        """now: the time that has come, when called for a timer."""
        if not keys:
            self.state.clear()
            return
        first = min(map(self.deadline, keys.values()))
        if first != timer or now is not None:
            if timer is not None and now is None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
        self.state.update((*map(list, zip(*self.rows(keys))), first))

    def handleInputRows(self, key, rows, timerValues):
        rows = [row for row in rows if row.clock is None]
        if rows:
            keys, timer = self._load()
            yield from self.take(keys, rows)
            self._store(keys, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        keys, timer = self._load()
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        if timer is None or timer > now:
            return
        for name in [name for name, value in keys.items() if self.deadline(value) <= now]:
            yield from self.fire(keys, name, now)
        self._store(keys, timer, now)


class _Retry(_Bucket):
    """A key: the last event time, and by attempt counter handled when to redeliver it (None: not, or not any more)."""

    fields = {"mailing_id": "string", "last": "bigint", "attempt": "int", "due": "bigint"}

    def __init__(self, max_attempts, waits, keep):
        self.max_attempts, self.waits, self.keep = max_attempts, waits, 1000 * keep

    def read(self, rows):
        jobs = {}
        for mailing_id, last, attempt, due in rows:
            jobs.setdefault(mailing_id, (last, {}))[1][attempt] = due
        return jobs

    def rows(self, jobs):
        return ((name, last, *seen) for name, (last, tries) in jobs.items() for seen in tries.items())

    def deadline(self, job):
        last, tries = job
        return min((due for due in tries.values() if due is not None), default=last + self.keep)

    def take(self, jobs, rows):
        for row in rows:
            last, tries = jobs.get(row.mailing_id) or (0, {})
            if row.attempt in tries:
                continue
            at, due = _micros(row.ts) // 1000, None
            if row.attempt + 1 >= self.max_attempts:
                yield Row(mailing_id=row.mailing_id, outcome="dead_letter", attempts=self.max_attempts, at=row.ts)
            else:
                due = at + 1000 * self.waits[0 if row.attempt == 0 else 1]
            tries[row.attempt] = due
            jobs[row.mailing_id] = max(last, at), tries

    def fire(self, jobs, name, now):
        last, tries = jobs[name]
        for attempt, due in tries.items():
            if due is not None and due <= now:
                tries[attempt] = None
                yield Row(mailing_id=name, outcome="redelivered", attempts=attempt + 1, at=_moment(due * 1000))
        if self.deadline(jobs[name]) <= now:
            del jobs[name]


def delayed_retry(
    failures: DataFrame, delay="0 seconds", max_attempts=K.JOB_MAX_ATTEMPTS,
    waits=(K.RETRY_1_SECONDS, K.RETRY_2_SECONDS), keep=KEEP_SECONDS, buckets=BUCKETS,
) -> DataFrame:
    """Failed jobs (mailing_id, attempt, ts) -> redeliveries when their wait is over, or dead letters at once.

    A failure that arrives twice while its job is known counts once: while a wait of the job runs, and `keep` seconds after
    its last failure. `at` is the time of redelivery or of the last failure. A failure counts however late it arrives; a
    redelivery that is overdue by then is given the next time timers fire.
    """
    runner.with_rocksdb(failures.sparkSession)
    timed = failures.select("mailing_id", "attempt", F.col("ts").cast("timestamp").alias("ts"))
    once = runner.combine_last(timed, ["mailing_id", "attempt"], ["ts"], clock="clock").withWatermark("clock", delay)
    return _bucketed(once, ["mailing_id"], buckets).transformWithState(
        statefulProcessor=_Retry(max_attempts, tuple(waits), keep),
        outputStructType="mailing_id string, outcome string, attempts int, at timestamp",
        outputMode="append", timeMode="eventTime")


class _Timeout(_Bucket):
    """A key: its last status, the time and order number of it, and when its clock runs out (None: it does not run)."""

    fields = {"mailing_id": "string", "email": "string", "status": "string", "micros": "bigint", "seq": "bigint", "timer_at": "bigint"}

    def __init__(self, limits, keep):
        self.limits, self.keep = limits, 1000 * keep

    def read(self, rows):
        return {(mailing_id, email): value for mailing_id, email, *value in rows}

    def rows(self, keys):
        return ((*name, *value) for name, value in keys.items())

    def deadline(self, value):
        _, micros, _, timer = value
        return micros // 1000 + self.keep if timer is None else timer

    def take(self, keys, rows):
        for row in rows:
            name, micros = (row.mailing_id, row.email), _micros(row.ts)
            old = keys.get(name)
            if old and (micros, row.seq) <= (old[1], old[2]):
                continue
            timer = micros // 1000 + 1000 * self.limits[row.status] if row.status in self.limits else None
            keys[name] = [row.status, micros, row.seq, timer]
        return iter([])

    def fire(self, keys, name, now):
        status, micros, _, timer = keys[name]
        if timer is not None:
            yield Row(mailing_id=name[0], email=name[1], status=status, last_attempt=_moment(micros),
                      timed_out_at=_moment(timer * 1000))
            keys[name][3] = None
        if micros // 1000 + self.keep <= now:
            del keys[name]


def in_flight_timeout(events: DataFrame, delay="0 seconds", limits=None, keep=KEEP_SECONDS, buckets=BUCKETS) -> DataFrame:
    """Status events (mailing_id, email, status, ts, seq) -> keys whose last status stayed in flight too long.

    limits: seconds per status; other statuses stop the clock. A status counts however late it arrives, if it is the key's
    last by its time; one that is overdue by then is given the next time timers fire. `keep` seconds after its last event a
    key that is not in flight is forgotten; a status older than that is then taken as the first of a new key.
    """
    runner.with_rocksdb(events.sparkSession)
    limits = limits or {"SENDING": K.RECOVERY_STALE_SECONDS, "PROCESSING": K.CLAIM_STALE_SECONDS}
    timed = events.select("mailing_id", "email", "status", F.col("ts").cast("timestamp").alias("ts"), "seq")
    last = runner.combine_last(timed, ["mailing_id", "email"], ["ts", "seq"], clock="clock").withWatermark("clock", delay)
    return _bucketed(last, ["mailing_id", "email"], buckets).transformWithState(
        statefulProcessor=_Timeout(limits, keep),
        outputStructType="mailing_id string, email string, status string, last_attempt timestamp, "
                         "timed_out_at timestamp",
        outputMode="append", timeMode="eventTime")

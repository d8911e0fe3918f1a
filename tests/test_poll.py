"""The outbox poll over several files: answers that are missing, repeated, too late or arrive late, against the batch step."""

import datetime

from pyspark.sql import functions as F

from postmill import constants as K
from postmill.operators import outbox
from postmill.streaming import poll, runner

START = datetime.datetime(2024, 1, 1)
ANSWERS = "message_id string, attempt int, seq int, ok boolean, error string, answered_at timestamp"
OUTBOX = ("id string, mailing_id string, target_queue string, payload string, attempts int, published boolean, "
          "published_at timestamp_ntz, last_error string, created_at timestamp_ntz")


def sec(n):
    return START + datetime.timedelta(seconds=n)


def message(name, attempts=0, published=False):
    return (name, "m", "q", "{}", attempts, published, None, None, START)


def add(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def batch_outbox(spark, messages, answers, polls):
    """The same polls by the batch step: per poll, the answers to this attempt in time; none counts as a refusal."""
    box = spark.createDataFrame(messages, OUTBOX)
    gone = {}
    for at in polls:
        rows = box.collect()
        results = []
        for r in rows:
            mine = [a for a in answers if a[0] == r.id and a[1] == r.attempts and sec(at) <= a[5] <= sec(at + 30)]
            results += [(a[0], a[2], a[3], a[4]) for a in mine] or [(r.id, 0, False, K.NO_ANSWER_TEXT)]
        decided = outbox.publish_decision(
            box, spark.createDataFrame(results, "message_id string, seq int, ok boolean, error string"), sec(at))
        left, _ = outbox.split_published(decided, sec(at))
        gone.update({r.id: ("dead_letter", r.attempts, r.last_error)
                     for r in decided.where("outcome = 'dead_letter'").collect()})
        box = spark.createDataFrame(left.collect(), left.schema)
    final = {r.id: ("published" if r.published else "failed", r.attempts, r.last_error) for r in box.collect()}
    return {**final, **gone}


def test_polls_equal_the_batch_step(spark, tmp_path):
    path = str(tmp_path)
    early = [message("ok"), message("nack"), message("both"), message("missing"), message("slow"), message("tardy"),
             message("last", 4), message("spent", 5), message("done", 1, True)]
    later = [message("new"), message("newer", 3)]
    first = [("ok", 0, 1, True, None, sec(3)), ("ok", 0, 2, True, None, sec(4)), ("nack", 0, 1, False, "no", sec(2)),
             ("both", 0, 1, False, "no", sec(2)), ("slow", 0, 1, True, None, sec(31)), ("last", 4, 1, False, "full", sec(1)),
             ("nobody", 0, 1, True, None, sec(1))]
    # Of the first poll, but arriving after the clock has moved on.
    behind = [("both", 0, 2, True, None, sec(11)), ("tardy", 0, 1, True, None, sec(20))]
    second = [("nack", 1, 1, False, "still no", sec(62)), ("nack", 1, 2, False, "no again", sec(63)),
              ("missing", 0, 1, True, None, sec(61)), ("slow", 1, 1, True, None, sec(61)), ("new", 0, 1, True, None, sec(65)),
              ("newer", 3, 1, False, "no", sec(65))]
    third = [("nack", 2, 1, True, None, sec(125)), ("missing", 1, 1, True, None, sec(121)), ("newer", 4, 1, False, "no", sec(130))]

    def confirm(at):
        runner.finish(poll.confirm(runner.files(spark, f"{path}/answers", ANSWERS), path, sec(at)))

    def send(at):
        runner.finish(poll.send(runner.files(spark, f"{path}/outbox", OUTBOX), path, sec(at)))

    add(spark, f"{path}/outbox", early, OUTBOX)
    add(spark, f"{path}/answers", first, ANSWERS)
    send(0)
    confirm(30)  # the clock moves; nothing is closed
    assert spark.read.schema(poll.OUTCOMES).parquet(f"{path}/outcomes").count() == 0
    add(spark, f"{path}/answers", behind, ANSWERS)
    confirm(60)
    add(spark, f"{path}/outbox", later, OUTBOX)
    send(60)
    add(spark, f"{path}/answers", second, ANSWERS)
    confirm(120)
    send(120)
    add(spark, f"{path}/answers", third, ANSWERS)
    confirm(180)
    got = {r.id: (r.outcome, r.attempts, r.last_error) for r in poll.settled(spark, path).collect()}
    answers = first + behind + second + third
    want = batch_outbox(spark, early, answers, [0, 60, 120]) | batch_outbox(spark, later, answers, [60, 120])
    want.pop("done")
    assert want["tardy"] == ("published", 0, None) and want["slow"][:2] == ("published", 1)
    # A message whose attempts are used up leaves at the next poll; the batch step has seen one poll less.
    send(180)
    after = {r.id: (r.outcome, r.attempts, r.last_error) for r in poll.settled(spark, path).collect()}
    assert got == want
    assert {k for k, x in after.items() if x[0] == "dead_letter"} == {"last", "spent", "newer"}
    sent = spark.read.schema(poll.SENDS).parquet(f"{path}/sends")
    assert sent.groupBy("id", "attempts").count().where("count > 1").count() == 0


def test_streams_of_outcomes_equal_tables(spark, tmp_path, rows):
    sends = [(str(i), "m", "q", "{}", i % 3, None, sec(i), False) for i in range(100)]
    answers = [(str(i), i % 3 if i % 7 else 9, s, (i + s) % 3 == 0, f"e{s}", sec(i + 5 * (i % 9) + s))
               for i in range(100) for s in range(i % 4)]
    box = spark.createDataFrame(sends, f"{poll.MESSAGE}, sent_at timestamp, tick boolean")
    found = spark.createDataFrame(answers, ANSWERS)
    batch = poll.outcomes(box, found).select("id", "outcome", "attempts", "last_error")
    for i in range(4):
        box.where(F.col("id") % 4 == i).select(*poll.COLUMNS, F.lit("sent").alias("outcome"), "sent_at").coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "sends"))
        found.where(F.col("message_id") % 4 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "answers"))
    source = runner.files(spark, str(tmp_path / "answers"), ANSWERS)
    runner.finish(poll.confirm(source, str(tmp_path), sec(1000), late=500))
    assert rows(spark.read.parquet(str(tmp_path / "outcomes")), "id", "outcome", "attempts", "last_error") == rows(batch)


def test_closed_sends_leave_the_state(spark, tmp_path):
    path = str(tmp_path)
    add(spark, f"{path}/outbox", [message(str(i)) for i in range(50)], OUTBOX)
    add(spark, f"{path}/answers", [(str(i), 0, 1, True, None, sec(1)) for i in range(50)], ANSWERS)
    runner.finish(poll.send(runner.files(spark, f"{path}/outbox", OUTBOX), path, sec(0)))
    held = []
    for at in (10, 100):
        runner.finish(poll.confirm(runner.files(spark, f"{path}/answers", ANSWERS), path, sec(at)))
        states = [spark.read.format("statestore").option("path", f"{path}/checkpoint-confirm").option("operatorId", n)
                  for n in (0, 1)]
        sides = [states[1].option("joinSide", side).load().count() for side in ("left", "right")]
        held.append((states[0].load().count(), sides))
    # Fifty sends and answers and a tick wait; afterwards only the last tick does.
    assert sum(held[0][1]) >= 100 and sum(held[1][1]) <= 2 and held[1][0] <= 1

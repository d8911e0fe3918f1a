"""Stored tables that change folder by folder, commits of micro-batches, loads into pruned folders, and deep pages."""

import datetime
import re

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from postmill.operators import intake, lookups, outbox, recovery
from postmill.sources import tables
from postmill.streaming import jobs, runner

AS_OF = datetime.datetime(2024, 5, 1)


def entries(spark, mailings, per=3):
    rows = [(m, f"u{i}@x.org", True, None, None) for m in mailings for i in range(per)]
    cands = spark.createDataFrame(rows, "mailing_id string, email string, is_valid boolean, reason string, details string")
    return intake.as_entries(cands, AS_OF)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files(path):
    return {str(f.relative_to(path)) for f in path.rglob("*.parquet")}


def test_a_change_rewrites_only_the_folders_it_touches(spark, tmp_path, rows):
    path, name = str(tmp_path), "mailing_entries"
    tables.change(entries(spark, [f"m{i}" for i in range(40)]), path, name, lambda old, new: new, "load")
    before = files(tmp_path)
    mark = spark.createDataFrame([("m7",)], "mailing_id string")

    def sent(old, ids):
        return old.withColumn("status", F.when(F.col("mailing_id") == "m7", "SENT").otherwise(F.col("status")))

    assert len(tables.change(mark, path, name, sent, "second")) == 1
    added = files(tmp_path) - before
    assert files(tmp_path) >= before and {f.split("/")[1] for f in added} == {"run=second"}
    assert len({f.split("/")[2] for f in added}) == 1
    now = tables.current(spark, path, name)
    assert rows(now.groupBy("status").count()) == [("PENDING", 117), ("SENT", 3)] and now.count() == 120
    one = tables.current(spark, path, name, ["m7"])
    assert rows(one, "status") == [("SENT",)] * 3 and len(one.inputFiles()) < 5

    def broken(old, ids):
        return old.withColumn("attempts", F.raise_error(F.lit("lost")).cast("int"))

    with pytest.raises(Exception, match="lost"):
        tables.change(mark, path, name, broken, "third")
    with pytest.raises(ValueError, match="not asked for"):
        tables.change(mark, path, name, lambda old, ids: entries(spark, ["m1", "m2", "m3"]), "fourth")
    assert rows(tables.current(spark, path, name).groupBy("status").count()) == [("PENDING", 117), ("SENT", 3)]
    gone = spark.createDataFrame([("m7",), ("m8",), ("unknown",)], "mailing_id string")
    tables.change(gone, path, name, lambda old, ids: recovery.purge(ids, mailing_entries=old)["mailing_entries"], "fifth")
    left = tables.current(spark, path, name)
    assert left.count() == 114 and left.where("mailing_id IN ('m7', 'm8')").count() == 0
    assert tables.current(spark, path, name, ["m7"]).count() == 0 and tables.current(spark, path, "mailings").count() == 0


def test_an_overtaken_change_fails(spark, tmp_path):
    path, name = str(tmp_path), "mailing_entries"
    tables.change(entries(spark, ["a", "b"]), path, name, lambda old, new: new, "r1")
    mark = spark.createDataFrame([("a",)], "mailing_id string")

    def slow(old, ids):
        tables.change(mark, path, name, lambda rows, ids: rows.where("email <> 'u0@x.org'"), "r2")
        return old.where("email <> 'u1@x.org'")

    with pytest.raises(Exception, match="already exists"):
        tables.change(mark, path, name, slow, "r3")
    assert {r.email for r in tables.current(spark, path, name, ["a"]).collect()} == {"u1@x.org", "u2@x.org"}


def test_a_load_reads_only_its_folders_and_is_written_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    assert tables.append_new_entries(entries(spark, ["a", "b"]), path) == {"inserted": 6, "duplicates": 0}
    seen = []
    frame = type(spark.range(0))
    hint = frame.hint
    monkeypatch.setattr(frame, "hint", lambda df, *a: seen.append(plan(df)) or hint(df, *a))
    load = entries(spark, ["a"], 5).unionByName(entries(spark, ["a"], 4))
    assert tables.append_new_entries(load, path) == {"inserted": 2, "duplicates": 7}
    assert len(seen) == 1 and re.search(r"PartitionFilters: \[[^\]]*bucket", seen[0])
    assert tables.append_new_entries(entries(spark, []), path) == {"inserted": 0, "duplicates": 0}
    assert tables.read_table(spark, path, "mailing_entries").count() == 8


def test_a_killed_micro_batch_shows_all_or_nothing(spark, tmp_path, rows):
    schema = "id string, filename string, storage_url string, total_lines int"
    path, source = str(tmp_path / "store"), str(tmp_path / "in")
    for part in ([("a", "a.csv", "/a", 3), ("n", "n.txt", "/n", 1)], [("b", "b.csv", "/b", 4), ("c", "a.csv", "/c", 4)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    uploads = runner.files(spark, source, schema, per_trigger=1)

    def killed(batch, run):
        mailings, messages = outbox.register(intake.accepted_uploads(batch, mailings_of(run)), AS_OF)
        if run.endswith("-1"):
            messages = messages.withColumn("attempts", F.raise_error(F.lit("killed")).cast("int"))
        return {"mailings": mailings, "outbox_messages": messages}

    def mailings_of(run):
        return tables.read_committed(spark, path, "mailings").where(F.col("run") != run)

    with pytest.raises(StreamingQueryException):
        runner.finish(jobs.commit_batches(uploads, path, str(tmp_path / "c"), killed))
    assert tables.read_committed(spark, path, "mailings").count() == 1
    assert tables.read_committed(spark, path, "outbox_messages").count() == 1
    runner.finish(jobs.register_uploads(uploads, path, AS_OF, str(tmp_path / "c")))
    runner.finish(jobs.register_uploads(uploads, path, AS_OF, str(tmp_path / "lost")))
    got = rows(tables.read_committed(spark, path, "mailings"), "filename")
    assert got == [("a.csv",), ("b.csv",)]
    assert rows(tables.read_committed(spark, path, "outbox_messages"), "mailing_id") == rows(
        tables.read_committed(spark, path, "mailings"), "id")


@pytest.mark.parametrize("descending", [False, True])
def test_pages_at_any_depth(spark, descending):
    box = spark.range(230).select(F.col("id").cast("string").alias("id"), F.lit("m").alias("mailing_id"), F.expr(
        "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, CAST(id % 7 AS INT))").alias("created_at")).cache()
    want = [r.id for r in box.orderBy(*lookups._ordered(["created_at", "id"], descending)).collect()]
    for key in (None, "mailing_id"):
        marks = lookups.fences(box, key, every=20, descending=descending).cache()
        assert marks.count() == 12
        for offset, limit in ((0, 5), (19, 2), (100, 60), (225, 10), (230, 5), (500, 5)):
            page = lookups.page_by_fences(box, marks, limit, offset, descending=descending)
            assert [r.id for r in page.collect()] == want[offset:offset + limit]
        deep = plan(lookups.page_by_fences(box, marks, 5, 101, descending=descending))
        assert "created_at" in deep
    assert lookups.page_by_fences(box.limit(0), marks.limit(0), 5, 0).count() == 0


def test_a_page_of_stored_entries_opens_one_folder_and_one_interval(spark, tmp_path):
    path = str(tmp_path)
    tables.append(entries(spark, ["a", "b"], 400), path, "mailing_entries")
    stored = tables.read_table(spark, path, "mailing_entries")
    tables.write_fences(stored, path, every=50)
    marks = lookups.entries_of(tables.read_fences(spark, path), "a")
    page = lookups.page_by_fences(lookups.entries_of(stored, "a"), marks, 20, 310)
    want = [r.id for r in stored.where("mailing_id = 'a'").orderBy("created_at", "id").collect()][310:330]
    assert [r.id for r in page.collect()] == want
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan(page)) and re.search(r"Filter .*created_at#\d+ >= 2024", plan(page))


def test_a_list_of_domains_that_grows_counts_from_the_next_micro_batch(spark, tmp_path, rows):
    source, listed = tmp_path / "in", str(tmp_path / "listed")
    source.mkdir()

    def domains(*names):
        spark.createDataFrame([(n,) for n in names], "domain string").coalesce(1).write.mode("overwrite").parquet(listed)

    def run():
        runner.finish(jobs.watch(spark, str(source), ["email", "n"], str(tmp_path / "done"), str(tmp_path / "out"),
                                 str(tmp_path / "c"), lambda s: s.read.parquet(listed)))

    domains("bad.org")
    (source / "a.csv").write_text("email,n\na@bad.org,1\nb@new.org,2\nshort@x.org\n")
    run()
    domains("bad.org", "new.org")
    (source / "b.csv").write_text("email,n\nc@new.org,3\nlong@x.org,4,5\n")
    run()
    got = rows(runner.stored(spark, str(tmp_path / "out/checked")), "email", "reason")
    assert got == [("a@bad.org", "disposable"), ("b@new.org", None), ("c@new.org", "disposable"), ("long@x.org", None),
                   ("short@x.org", None)]
    assert rows(runner.stored(spark, str(tmp_path / "out/rejected")), "line") == [("long@x.org,4,5",), ("short@x.org",)]
    assert [f.name for f in (tmp_path / "done").rglob("*.csv")] == ["a.csv"] and not (source / "a.csv").exists()

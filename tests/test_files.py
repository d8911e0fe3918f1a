"""Recipient files: encodings, layouts, numbering, resume, storage."""

import datetime

import pytest
from pyspark.sql import functions as F

from postmill.operators import intake
from postmill.sources import csvfiles as C, messages, tables

AS_OF = datetime.datetime(2024, 5, 1)
LISTED = "domain string"
VALIDATION = ["valid@example.com", "another.valid@gmail.com", "user@tempmail.com", "not-an-email", "x@10minutemail.com",
              "@missing.com", "ok.one@mail.org", "ok.two@mail.org", "z@guerrillamail.com", "two@@signs.com",
              "fine@sub.mail.org"]
DUPLICATES = ["a@x.org", "b@x.org", "A@x.org", "c@x.org", "b@x.org ", "d@x.org"]


def put(path, data, encoding="utf-8"):
    path.write_bytes(data if isinstance(data, bytes) else data.encode(encoding))
    return str(path)


def cells(spark, path, options=C.CsvOptions()):
    rows = C.with_line_numbers(C.read_recipients(spark, path, "m", options))
    return [r.raw_email for r in rows.orderBy("line_no").collect()]


def disposable(spark):
    return spark.createDataFrame([("10minutemail.com",), ("tempmail.com",), ("guerrillamail.com",)], LISTED)


def test_plain_file_with_blank_short_long_and_quoted_rows(spark, tmp_path):
    text = 'name,email,city\nA, a@x.org ,P\n\nB\nC,c@x.org,P,extra\n"D, E","d""q@x.org",P\nF,,P\n'
    path = put(tmp_path / "a.csv", text)
    assert cells(spark, path) == ["a@x.org", None, "c@x.org", 'd"q@x.org', None]


def test_quoted_newline(spark, tmp_path):
    path = put(tmp_path / "a.csv", 'name,email\n"two\nlines",a@x.org\nB,b@x.org\n')
    assert cells(spark, path, C.CsvOptions(multi_line=True)) == ["a@x.org", "b@x.org"]


def test_byte_order_mark(spark, tmp_path):
    path = put(tmp_path / "a.csv", b"\xef\xbb\xbfemail\na@x.org\nb@x.org\n")
    assert cells(spark, path) == ["a@x.org", "b@x.org"]
    assert C.detect_encodings(spark, path).first()["encoding"] == "utf-8-bom"


def test_latin1(spark, tmp_path):
    path = put(tmp_path / "a.csv", "name,email\nZoë,zoë@x.org\n", "latin-1")
    assert cells(spark, path) == ["zoë@x.org"]
    assert C.detect_encodings(spark, path).first()["encoding"] == "iso-8859-1"


def test_no_header_and_other_delimiter(spark, tmp_path):
    path = put(tmp_path / "a.csv", "1;a@x.org\n2;b@x.org\n")
    assert cells(spark, path, C.CsvOptions(has_header=False, email_index=1, delimiter=";")) == ["a@x.org", "b@x.org"]
    assert cells(spark, path, C.CsvOptions(has_header=False, email_index=5, delimiter=";")) == [None, None]


def test_column_name_is_case_sensitive(spark, tmp_path):
    path = put(tmp_path / "a.csv", "Email,other\na@x.org,1\n")
    assert cells(spark, path) == [None]
    assert cells(spark, path, C.CsvOptions(email_column="Email")) == ["a@x.org"]


@pytest.mark.parametrize("shift", [0, 1, 2, 3])
@pytest.mark.parametrize("char", ["é", "€", "😀"])
def test_character_across_the_head_limit(spark, tmp_path, shift, char):
    body = b"email\n" + b"a" * (4096 - 6 - shift) + char.encode() + b"@x.org\n"
    assert C.detect_encodings(spark, put(tmp_path / "a.csv", body)).first()["encoding"] == "utf-8"


def test_invalid_bytes_before_the_head_limit(spark, tmp_path):
    body = b"email\n" + b"a" * 4000 + b"\xe9" + b"b" * 500 + b"@x.org\n"
    assert C.detect_encodings(spark, put(tmp_path / "a.csv", body)).first()["encoding"] == "iso-8859-1"


@pytest.mark.parametrize("size", [1 << 10, 17 << 20])
def test_files_of_any_size_are_looked_at_alike(spark, tmp_path, size):
    for name, start, encoding in (("a b%é.csv", b"", "latin-1"), ("b.csv", b"", "utf-8"), ("c.csv", b"\xef\xbb\xbf", "utf-8")):
        put(tmp_path / name, start + "name,email\n".encode() + "Zoë,zoë@x.org\n".encode(encoding) * (size // 14))
    found = [(r.length, r.encoding, r.header, r.place) for r in C.catalogue(spark, str(tmp_path)).collect()]
    assert {x[1:] for x in found} == {(e, "name,email", 1) for e in ("iso-8859-1", "utf-8", "utf-8-bom")}
    assert all(size / 2 < x[0] < 2 * size for x in found)
    got = C.read_recipients(spark, str(tmp_path), "m").groupBy("raw_email").count().collect()
    assert [tuple(r) for r in got] == [("zoë@x.org", 3 * (size // 14))]


def test_header_lines_of_any_length(spark, tmp_path, rows):
    wide = ",".join(f"column{i}" for i in range(15_000))
    put(tmp_path / "a.csv", f"\n  \r\n{wide},email\n" + "," * 15_000 + "a@x.org\n")
    assert rows(C.catalogue(spark, str(tmp_path)), "place") == [(15_000,)]
    put(tmp_path / "a.csv", "email")
    put(tmp_path / "b.csv", "")
    put(tmp_path / "c.csv", "\n" * 200_000 + "x,email\n1,c@x.org\n")
    assert rows(C.catalogue(spark, str(tmp_path)), "header", "place") == [("email", 0), ("x,email", 1)]
    assert rows(C.read_recipients(spark, str(tmp_path), "m"), "raw_email") == [("c@x.org",)]


def test_bytes_beyond_the_head_and_marks(spark, tmp_path, rows):
    put(tmp_path / "a.csv", b"email\n" + b"a@x.org\n" * 600 + b"z\xff@x.org\n")
    assert rows(C.read_recipients(spark, str(tmp_path), "m").where("raw_email <> 'a@x.org'"), "raw_email") == [("z\ufffd@x.org",)]
    put(tmp_path / "a.csv", b"\xef\xbb\xbfemail,n\n\"\xc3\xa9\n\xe2\x82\xac@x.org\",1\n")
    put(tmp_path / "b.csv", "n,email\n1,\"é\n€@y.org\"\n")
    got = C.read_recipients(spark, str(tmp_path), "m", C.CsvOptions(multi_line=True))
    assert rows(got, "raw_email") == [("é\n€@x.org",), ("é\n€@y.org",)]
    put(tmp_path / "a.csv", b"\xef\xbb\xbf\xc3\xa9@x.org\n")
    put(tmp_path / "b.csv", "y@x.org\n")
    for over_lines in (False, True):
        got = C.read_recipients(spark, str(tmp_path), "m", C.CsvOptions(has_header=False, multi_line=over_lines))
        assert rows(got, "raw_email") == [("y@x.org",), ("é@x.org",)]


def test_files_of_mixed_encoding_and_header(spark, tmp_path, rows):
    put(tmp_path / "a.csv", "email,name\na@x.org,A\n")
    put(tmp_path / "b.csv", "name,email\nB,b@x.org\n")
    put(tmp_path / "c.csv", "name,email\nZoë,zoë@x.org\n", "latin-1")
    put(tmp_path / "d.csv", b"\xef\xbb\xbfname,email\nD,d@x.org\n")
    owner = F.regexp_extract("source_file", r"(\w+)\.csv", 1)
    got = C.read_recipients(spark, str(tmp_path), owner)
    assert rows(got, "mailing_id", "raw_email") == [
        ("a", "a@x.org"), ("b", "b@x.org"), ("c", "zoë@x.org"), ("d", "d@x.org")]


def test_numbers_over_many_splits(spark, tmp_path):
    path = put(tmp_path / "a.csv", "email\n" + "".join(f"u{i}@x.org\n" for i in range(1, 5001)))
    put(tmp_path / "b.csv", "email\n" + "".join(f"u{i}@x.org\n" for i in range(1, 301)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        numbered = C.with_line_numbers(C.read_recipients(spark, str(tmp_path), "m"))
        assert numbered.select("split_start").distinct().count() > 10
        wrong = numbered.where(F.concat(F.lit("u"), F.col("line_no").cast("string"), F.lit("@x.org")) != F.col("raw_email"))
        assert wrong.count() == 0 and numbered.count() == 5300
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def load(spark, values, mailing="m"):
    return spark.createDataFrame([(i + 1, mailing, x) for i, x in enumerate(values)],
                                 "line_no bigint, mailing_id string, raw_email string")


@pytest.mark.parametrize("values, valid, invalid, skipped", [(VALIDATION, 5, 6, 0), (DUPLICATES, 4, 0, 2)])
def test_fixture_counts(spark, values, valid, invalid, skipped):
    r = intake.load_summary(load(spark, values), disposable=disposable(spark)).first()
    assert (r.total_rows, r.processed_rows, r.invalid_emails, r.duplicates_skipped, r.status) == (
        len(values), valid, invalid, skipped, "COMPLETED")


def test_stored_rows_and_second_load(spark, tmp_path, rows):
    path = str(tmp_path)
    empty = spark.createDataFrame([], "mailing_id string, email string")
    first = intake.new_entries(load(spark, DUPLICATES[:3] + ["bad", "", None]), empty, AS_OF, disposable(spark))
    tables.append(first, path, "mailing_entries")
    again = intake.as_entries(intake.storable(intake.candidates(load(spark, DUPLICATES), disposable(spark))), AS_OF)
    assert tables.append_new_entries(again, path, ["m"]) == {"inserted": 2, "duplicates": 2}
    assert tables.append_new_entries(again, path) == {"inserted": 0, "duplicates": 4}
    stored = tables.read_table(spark, path, "mailing_entries")
    assert rows(stored, "email", "status") == [
        ("a@x.org", "PENDING"), ("b@x.org", "PENDING"), ("bad", "INVALID"), ("c@x.org", "PENDING"),
        ("d@x.org", "PENDING")]
    assert stored.select("id").distinct().count() == stored.select("token").distinct().count() == 5
    new = intake.not_stored(intake.candidates(load(spark, ["a@x.org", "e@x.org"])), stored, ["m"])
    assert rows(new, "email") == [("e@x.org",)]


def test_snapshot_versions(spark, tmp_path):
    progress = spark.createDataFrame([("m", 1, 1, 1, "RUNNING")], "mailing_id string, total_rows int, "
                                     "processed_rows int, last_processed_line int, status string")
    tables.write_snapshot(progress, str(tmp_path), "mailing_progress", 1)
    with pytest.raises(Exception, match="already exists"):
        tables.write_snapshot(progress, str(tmp_path), "mailing_progress", 1)


def test_two_tables_are_visible_together(spark, tmp_path, rows):
    from postmill.operators import outbox

    path = str(tmp_path)
    uploads = spark.createDataFrame([("a", "a.csv", "/s/a", 3), ("b", "b.csv", "/s/b", 4)],
                                    "id string, filename string, storage_url string, total_lines int")
    first, second = uploads.where("id = 'a'"), uploads.where("id = 'b'")
    mailings, messages = outbox.register(first, AS_OF)
    tables.commit(path, "r1", mailings=mailings, outbox_messages=messages)
    mailings, messages = outbox.register(second, AS_OF)
    broken = messages.withColumn("attempts", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        tables.commit(path, "r2", mailings=mailings, outbox_messages=broken)
    assert rows(tables.read_committed(spark, path, "mailings"), "id") == [("a",)]
    tables.commit(path, "r2", mailings=mailings, outbox_messages=messages)
    assert rows(tables.read_committed(spark, path, "mailings"), "id") == [("a",), ("b",)]
    assert rows(tables.read_committed(spark, path, "outbox_messages"), "mailing_id", "attempts") == [("a", 0), ("b", 0)]


def test_resume_after_stop(spark, rows):
    """50 lines, stop after 20, go on: 50 entries, each once; a second resume is refused."""
    lines = load(spark, [f"u{i}@x.org" for i in range(50)])
    progress = "mailing_id string, last_processed_line int, status string"
    state = spark.createDataFrame([("m", 20, "RUNNING")], progress)
    left = intake.resume(lines, state, "m")
    assert left.count() == 30 and left.agg(F.min("line_no")).first()[0] == 21
    done = intake.candidates(lines.where("line_no <= 20").unionByName(left))
    assert done.count() == 50 and done.where("is_valid").select("email").distinct().count() == 50
    with pytest.raises(ValueError, match="already completed"):
        intake.resume(lines, spark.createDataFrame([("m", 50, "COMPLETED")], progress), "m")
    with pytest.raises(ValueError, match="No progress"):
        intake.resume(lines, state, "other")


def test_archive_keeps_every_row(spark, tmp_path):
    rows_in = load(spark, DUPLICATES).withColumn("source_file", F.lit("/in/x/list.csv"))
    tables.archive_raw(rows_in, str(tmp_path))
    kept = spark.read.parquet(str(tmp_path))
    assert kept.count() == 6 and kept.select("archived_as").distinct().first()[0] == "m_list.csv"


def test_event_log_schema_reads_other_events(spark, tmp_path):
    put(tmp_path / "log.json", '{"event":"csv.progress","mailingId":"m","processedRows":5,"totalRows":10,'
        '"percentage":"50.00"}\n{"event":"other"}\n{"event":"crash.recovery","staleJobs":3}\n')
    log = messages.known_events(messages.read_log(spark, str(tmp_path)))
    assert sorted((r.event, r.processedRows, r.staleJobs) for r in log.collect()) == [
        ("crash.recovery", None, 3), ("csv.progress", 5, None)]


def test_headers_that_differ_in_case_only(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Email,email,name\nX@no.org,u@x.org,n\n")
    (tmp_path / "b.csv").write_text("name, email \nn,v@x.org\n")
    (tmp_path / "c.csv").write_text("Email,name\nw@x.org,n\n")
    rows = C.read_recipients(spark, str(tmp_path), "m")
    assert sorted((r.raw_email or "") for r in rows.collect()) == ["", "u@x.org", "v@x.org"]

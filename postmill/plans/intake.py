"""Queries on loads: files, numbering, first occurrences, summaries and registration."""

from pyspark.sql import Window, functions as F

from postmill.functions import keys, payload
from postmill.operators import intake as I, outbox
from postmill.operators.spread import attach, first_per_key
from postmill.plans import views as v
from postmill.plans.registry import query
from postmill.plans.validation import rows_of
from postmill.plans.views import sql
from postmill.session import new_folder
from postmill.sources import csvfiles, tables


def stored_from(sf_dir, spark):
    """Entries that were stored before: the valid addresses of finished orders."""
    orders = v.table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F")
    return I.normalized(v.mail_rows_from(orders)).where(F.col("email").isNotNull()).select("mailing_id", "email")


STORED = """old_rows AS (SELECT DISTINCT c.mailing_id, c.email FROM checked c JOIN orders o ON o.o_orderkey = c.line_no
 WHERE o.o_orderstatus = 'F' AND c.email IS NOT NULL)"""

SUMMARY = """
SELECT mailing_id, CAST(sum(n) AS BIGINT) AS total_rows,
 count(*) FILTER (WHERE is_valid) AS processed_rows,
 CAST(coalesce(sum(n) FILTER (is_valid), 0) AS BIGINT) - count(*) FILTER (WHERE is_valid) AS duplicates_skipped,
 CAST(coalesce(sum(n) FILTER (NOT is_valid), 0) AS BIGINT) AS invalid_emails,
 CAST(coalesce(sum(n - 1) FILTER (NOT is_valid AND email <> ''), 0) AS BIGINT) AS invalid_duplicates,
 'COMPLETED' AS status
FROM (SELECT mailing_id, email, is_valid, count(*) AS n FROM checked GROUP BY ALL) GROUP BY mailing_id"""


@query("ingest_summary", "A04 W01 P01 P02 P03 J01", sql(v.CHECKED, body=SUMMARY))
def ingest_summary(spark, sf_dir):
    return I.load_summary(rows_of(spark, sf_dir), disposable=v.disposable(spark))


@query("batch_insert_counts", "A05 S08", sql(v.CHECKED, STORED, body="""
SELECT mailing_id, CAST(sum(n) FILTER (is_valid) AS BIGINT) AS valid_rows,
 count(*) FILTER (WHERE is_valid AND NOT old) AS inserted,
 CAST(sum(n) FILTER (is_valid) AS BIGINT) - count(*) FILTER (WHERE is_valid AND NOT old) AS duplicates
FROM (SELECT c.mailing_id, c.email, c.is_valid, count(*) AS n, bool_or(o.email IS NOT NULL) AS old
 FROM checked c LEFT JOIN old_rows o ON o.mailing_id = c.mailing_id AND o.email = c.email GROUP BY ALL)
GROUP BY mailing_id"""))
def batch_insert_counts(spark, sf_dir):
    out = I.load_summary(rows_of(spark, sf_dir), stored_from(sf_dir, spark), v.disposable(spark))
    return out.select(
        "mailing_id", (F.col("total_rows") - F.col("invalid_emails")).alias("valid_rows"),
        F.col("processed_rows").alias("inserted"), F.col("duplicates_skipped").alias("duplicates"))


@query("dedupe_first", "W01", sql(v.CHECKED, body="""
SELECT mailing_id, email, min(line_no) AS line_no, count(*) AS copies FROM checked WHERE email <> ''
GROUP BY mailing_id, email"""))
def dedupe_first(spark, sf_dir):
    return I.storable(I.distinct_addresses(rows_of(spark, sf_dir))).select("mailing_id", "email", "line_no", "copies")


@query("first_rows", "W01", sql(v.CHECKED, body="""
SELECT line_no, mailing_id, email, raw_email FROM
 (SELECT *, row_number() OVER (PARTITION BY mailing_id, email ORDER BY line_no) AS rn FROM checked WHERE email <> '')
WHERE rn = 1"""))
def first_rows(spark, sf_dir):
    rows = I.normalized(rows_of(spark, sf_dir)).where(F.col("email") != "")
    return first_per_key(rows, ["mailing_id", "email"], ["line_no"]).select("line_no", "mailing_id", "email", "raw_email")


@query("skip_existing", "J03", sql(v.CHECKED, STORED, body="""
SELECT mailing_id, email, min(line_no) AS line_no FROM checked c WHERE email <> '' AND is_valid
 AND NOT EXISTS (SELECT 1 FROM old_rows o WHERE o.mailing_id = c.mailing_id AND o.email = c.email)
GROUP BY mailing_id, email"""))
def skip_existing(spark, sf_dir):
    cands = I.storable(I.candidates(rows_of(spark, sf_dir), v.disposable(spark))).where("is_valid")
    return I.not_stored(cands, stored_from(sf_dir, spark)).select("mailing_id", "email", "line_no")


@query("split_valid_invalid", "U02 P06", sql(v.CHECKED, body=f"""
SELECT DISTINCT mailing_id, email, CASE WHEN is_valid THEN 'PENDING' ELSE 'INVALID' END AS status, 0 AS attempts,
 reason AS invalid_reason, details AS validation_details, {v.AS_OF_SQL} AS created_at FROM checked WHERE email <> ''"""))
def split_valid_invalid(spark, sf_dir):
    cands = I.storable(I.candidates(rows_of(spark, sf_dir), v.disposable(spark)))
    return I.as_entries(cands, v.AS_OF).select(
        "mailing_id", "email", "status", "attempts", "invalid_reason", "validation_details", "created_at")


@query("resume_skip", "F08", sql(v.CHECKED, body="""
SELECT line_no, mailing_id FROM checked c
WHERE line_no > coalesce((SELECT max(p_size) * 100 FROM part WHERE 'm' || CAST(p_partkey AS VARCHAR) = c.mailing_id), 0)
"""))
def resume_skip(spark, sf_dir):
    part = v.table(spark, sf_dir, "part")
    progress = v.progress_from(part).withColumn("last_processed_line", F.col("total_rows"))
    return I.after_checkpoint(rows_of(spark, sf_dir), progress).select("line_no", "mailing_id")


@query("registry_check", "S06 T01", sql(v.UPLOADS, v.MAILINGS, body="""
SELECT id, filename, storage_url, total_lines FROM
 (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY id) AS rn FROM uploads WHERE lower(filename) LIKE '%.csv')
WHERE rn = 1 AND filename NOT IN (SELECT filename FROM mailings)"""))
def registry_check(spark, sf_dir):
    uploads = v.uploads_from(v.table(spark, sf_dir, "customer"))
    return I.accepted_uploads(uploads, v.mailings_from(v.table(spark, sf_dir, "part"))).select(
        "id", "filename", "storage_url", "total_lines")


@query("known_filenames", "J09", sql(v.UPLOADS, v.MAILINGS, body="""
SELECT id, filename FROM uploads WHERE filename IN (SELECT filename FROM mailings)"""))
def known_filenames(spark, sf_dir):
    uploads = v.uploads_from(v.table(spark, sf_dir, "customer"))
    return I.known_filenames(uploads, v.mailings_from(v.table(spark, sf_dir, "part"))).select("id", "filename")


# --- files: the derived rows are written as CSV first, then read back through the file sources -----------------------


def _written_csv(spark, sf_dir, encoding="UTF-8"):
    """Recipient rows as CSV files with a second column, in several files."""
    folder = new_folder(spark, "csv")
    rows = rows_of(spark, sf_dir).select(
        F.col("raw_email").alias("email"), F.concat_ws(" ", F.lit("Zoë"), F.col("mailing_id")).alias("name"),
        F.col("line_no").cast("string").alias("line"))
    rows.write.option("header", True).option("encoding", encoding).csv(folder)
    return folder


CSV_CELLS = """
SELECT email, name, line, count(*) AS n FROM
 (SELECT CASE WHEN trim(raw_email) <> '' THEN trim(raw_email) END AS email, 'Zoë ' || mailing_id AS name,
  CAST(line_no AS VARCHAR) AS line FROM mail_rows) GROUP BY ALL"""


@query("csv_scan", "S01", sql(v.MAIL_ROWS, body=CSV_CELLS))
def csv_scan(spark, sf_dir):
    cells = csvfiles.read_csv(spark, _written_csv(spark, sf_dir))
    return cells.groupBy("email", "name", "line").agg(F.count("*").alias("n"))


@query("csv_latin1", "S02 S03", sql(v.MAIL_ROWS, body=CSV_CELLS))
def csv_latin1(spark, sf_dir):
    folder = _written_csv(spark, sf_dir, "ISO-8859-1")
    cells = csvfiles.read_csv(spark, folder, encoding="ISO-8859-1")
    return cells.groupBy("email", "name", "line").agg(F.count("*").alias("n"))


@query("csv_encodings", "S02", sql(body="""SELECT * FROM (VALUES ('utf-8'), ('iso-8859-1')) t(encoding)""").replace(
    "WITH \n", ""))
def csv_encodings(spark, sf_dir):
    """Encodings found among files of both kinds."""
    folders = [_written_csv(spark, sf_dir), _written_csv(spark, sf_dir, "ISO-8859-1")]
    return csvfiles.detect_encodings(spark, [f + "/*.csv" for f in folders]).select("encoding").distinct()


@query("csv_email_column", "S04 S02", sql(v.MAIL_ROWS, body="""
SELECT mailing_id, raw_email, count(*) AS n FROM (SELECT 'mail-1' AS mailing_id,
 CASE WHEN trim(raw_email) <> '' THEN trim(raw_email) END AS raw_email FROM mail_rows) GROUP BY ALL"""))
def csv_email_column(spark, sf_dir):
    rows = csvfiles.read_recipients(spark, [_written_csv(spark, sf_dir) + "/*.csv"], "mail-1")
    return rows.groupBy("mailing_id", "raw_email").agg(F.count("*").alias("n"))


@query("csv_mixed_files", "S02 S04", sql(v.MAIL_ROWS, body="""
SELECT encoding, CASE WHEN trim(raw_email) <> '' THEN trim(raw_email) END AS raw_email, count(*) AS n
FROM mail_rows, (VALUES ('utf-8'), ('utf-8'), ('iso-8859-1')) t(encoding) GROUP BY ALL"""))
def csv_mixed_files(spark, sf_dir):
    """One load of files in two encodings and with two orders of columns, counted by the encoding found for their file."""
    swapped = new_folder(spark, "csv")
    csvfiles.read_csv(spark, _written_csv(spark, sf_dir)).select("line", "name", "email").write.option("header", True).csv(swapped)
    paths = [f + "/*.csv" for f in (_written_csv(spark, sf_dir), _written_csv(spark, sf_dir, "ISO-8859-1"), swapped)]
    files = csvfiles.detect_encodings(spark, paths).select(F.col("path").alias("source_file"), "encoding")
    rows = attach(csvfiles.read_recipients(spark, paths, "mail-1"), files, ["source_file"])
    return rows.groupBy("encoding", "raw_email").agg(F.count("*").alias("n"))


@query("csv_line_numbers", "S05", sql(v.MAIL_ROWS, body="SELECT line_no AS line, true AS in_order FROM mail_rows"))
def csv_line_numbers(spark, sf_dir):
    """Every row of one file gets the number of its line; rows are written in order, so numbers must follow them."""
    folder = new_folder(spark, "lines")
    ordered = rows_of(spark, sf_dir).select("line_no", "raw_email").orderBy("line_no")
    ordered.write.option("header", True).csv(folder)
    cells = csvfiles.read_csv(spark, folder, schema="line_no bigint, raw_email string").select(
        "line_no", F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("split_start"), F.monotonically_increasing_id().alias("row_key"))
    numbered = csvfiles.with_line_numbers(cells.withColumnRenamed("line_no", "line"))
    # Every file holds lines of the table in ascending order, so the n-th line of a file must have number n.
    place = F.row_number().over(Window.partitionBy("source_file").orderBy("line"))
    return numbered.select("line", (F.col("line_no") == place).alias("in_order"))


@query("skip_existing_append", "S08 S07 J03", sql(v.CHECKED, body="""
SELECT mailing_id, CASE WHEN is_valid THEN 'PENDING' ELSE 'INVALID' END AS status, count(DISTINCT email) AS entries
FROM checked WHERE email <> '' GROUP BY 1, 2"""))
def skip_existing_append(spark, sf_dir):
    """Two overlapping loads into a stored table: every key is there once."""
    path = new_folder(spark, "store")
    disposable = v.disposable(spark)
    orders = v.table(spark, sf_dir, "orders")
    early = v.mail_rows_from(orders.where(F.col("o_orderstatus") != "O"))
    tables.append(I.as_entries(I.storable(I.candidates(early, disposable)), v.AS_OF), path, "mailing_entries")
    everything = I.as_entries(I.storable(I.candidates(v.mail_rows_from(orders), disposable)), v.AS_OF)
    tables.append_new_entries(everything, path)
    stored = tables.read_table(spark, path, "mailing_entries")
    return stored.groupBy("mailing_id", "status").agg(F.count("*").alias("entries"))


@query("archive_upload", "S09", sql(v.MAIL_ROWS, body="""
SELECT mailing_id, mailing_id || '_list.csv' AS archived_as, count(*) AS rows FROM mail_rows GROUP BY ALL"""))
def archive_upload(spark, sf_dir):
    path = new_folder(spark, "archive")
    rows = rows_of(spark, sf_dir).withColumn("source_file", F.lit("/in/list.csv"))
    tables.archive_raw(rows, path)
    kept = spark.read.schema("line_no bigint, raw_email string, source_file string, archived_as string, mailing_id string")
    return kept.parquet(path).groupBy("mailing_id", "archived_as").agg(F.count("*").alias("rows"))


@query("entry_tokens", "P09", sql(v.CHECKED, body="""
SELECT mailing_id, email, substr(h, 1, 32) AS token,
 CAST(('0x' || substr(h, 1, 15))::BIGINT % 900000 + 100000 AS VARCHAR) AS code,
 list_aggregate(list_transform(range(0, 8), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789',
  CAST(('0x' || substr(h, CAST(2 * i + 1 AS INT), 2))::INT % 36 + 1 AS INT), 1)), 'string_agg', '') AS short_token
FROM (SELECT DISTINCT mailing_id, email, sha256('postmill|' || mailing_id || '|' || email || '|0') AS h
 FROM checked WHERE email <> '')"""))
def entry_tokens(spark, sf_dir):
    rows = I.storable(I.distinct_addresses(rows_of(spark, sf_dir)))
    m, e = F.col("mailing_id"), F.col("email")
    return rows.select(
        m, e, keys.hex_token("postmill", m, e).alias("token"), keys.numeric_code("postmill", m, e).alias("code"),
        keys.alphanumeric_token("postmill", m, e).alias("short_token"))


REGISTERED = sql(v.UPLOADS, v.MAILINGS, body="""
SELECT u.id, u.filename, 'PENDING' AS status, 0 AS processed_lines, u.total_lines,
 'mailing.jobs.process' AS target_queue, false AS published, u.id AS payload_mailing_id,
 u.filename AS payload_filename, u.storage_url AS payload_url, 0 AS payload_attempt,
 '2024-01-02T00:00:00.000Z' AS payload_created FROM
 (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY id) AS rn FROM uploads WHERE lower(filename) LIKE '%.csv') u
WHERE u.rn = 1 AND u.filename NOT IN (SELECT filename FROM mailings)""")


def registered(rows, messages):
    """Mailings beside their first messages."""
    sent = messages.select(
        F.col("mailing_id").alias("id"), "target_queue", "published",
        *[payload.field(F.col("payload"), name).alias(alias) for name, alias in (
            ("mailingId", "payload_mailing_id"), ("filename", "payload_filename"), ("storageUrl", "payload_url"),
            ("createdAt", "payload_created"))],
        payload.field(F.col("payload"), "attempt").cast("int").alias("payload_attempt"))
    return rows.select("id", "filename", "status", "processed_lines", "total_lines").join(sent, "id")


@query("register_mailings", "T01 P11", REGISTERED)
def register_mailings(spark, sf_dir):
    """Both tables of a registration in one commit, read back through it."""
    path = new_folder(spark, "registered")
    uploads = v.uploads_from(v.table(spark, sf_dir, "customer"))
    accepted = I.accepted_uploads(uploads, v.mailings_from(v.table(spark, sf_dir, "part")))
    rows, messages = outbox.register(accepted, v.AS_OF_2024)
    tables.commit(path, "load", mailings=rows, outbox_messages=messages)
    return registered(tables.read_committed(spark, path, "mailings"), tables.read_committed(spark, path, "outbox_messages"))

"""WARC archives: a writer with revisit records, and a reader that salvages damaged archives.

Every record is one gzip member (`.warc.gz`) or plain bytes (`.warc`). A member or record that fails a check (inflation,
version line, header, length, closing blank lines, payload digest) does not end the archive: the reader searches for the
next gzip member or version line that passes, goes on there, and reports the bytes it left out as a gap.

Defined cases: a null html is an empty payload; a null url writes no target URI and reads back as null; control
characters and line breaks in a url are percent-encoded; a row without page_id reads back without one and counts as
larger than every page_id; rows that repeat the smallest page_id of a group of equal payloads are all responses, and a
fully repeated row keeps its record id; an empty table writes no archive and reads as no rows; other columns of the input
are not archived. Payloads of any length are whole; one record must fit in a task's memory.
"""

import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from postmill.llm.registry import query, table
from postmill.session import new_folder

#: An archive is closed once it holds this many bytes.
ARCHIVE_BYTES = 64 << 20
#: Smaller payloads are never written as revisits.
REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
READ_BYTES = 1 << 20
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
#: A header block is of any length; at such a line another record starts.
NEXT = re.compile(rb"\r\nWARC/1\.[01]\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "archive string, records long, bytes long"
CONTENT = ("archive string, start long, end long, problem string, record_type string, record_id string, target_uri string, "
           "page_id long, payload_bytes long, payload_digest string, refers_to long, payload binary")


def with_record_types(pages: DataFrame, least=REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest, and `first`: the page_id of the response that a revisit points to, else null.

    Digests are counted with map-side minima; only digests that occur twice go into the join, which splits hot ones.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    groups = (
        rows.where(F.octet_length("payload") >= least)
        .groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first")
    )
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))
    return rows.join(groups, "digest", "left").withColumn("first", F.when(later, F.col("first")))


def _record_id(page, digest):
    return f"<urn:x-page:{'' if page is None else page}:{digest}>"


def _record(page, url, payload, digest, first):
    """One record as bytes: an HTTP response, or its header alone for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first is None else http
    fields = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", _record_id(page, digest)),
              ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"),
              ("WARC-Payload-Digest", f"sha256:{digest}"),
              ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url)))
    if page is not None:
        fields.append(("X-Page-Id", str(page)))
    if first is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(first, digest))]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _member(record):
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def write(rows: DataFrame, folder, compressed=True, archive_bytes=ARCHIVE_BYTES) -> DataFrame:
    """Write the rows of `with_record_types` as archives into `folder`; returns one row per archive.

    A task writes to a name of its own and renames when the archive is whole. Names and contents follow from the
    partition, so a task that runs again after a loss replaces the same files.
    """
    suffix = ".warc.gz" if compressed else ".warc"

    def write_part(batches):
        store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (
            fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        part, number, out, done = TaskContext.get().partitionId(), 0, None, []
        count = size = 0

        def close():
            nonlocal out
            out.close()
            name = f"{root}/part-{part:05d}-{number:04d}{suffix}"
            store.move(work, name)
            done.append((f"{folder}/part-{part:05d}-{number:04d}{suffix}", count, size))
            out = None

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "first"))):
                if out is None:
                    work = f"{root}/{uuid.uuid4().hex}.open"
                    out, count, size, number = store.open_output_stream(work), 0, 0, number + bool(done)
                record = _record(row[0], row[1], row[2].encode(), row[3], row[4])
                record = _member(record) if compressed else record
                out.write(record)
                count, size = count + 1, size + len(record)
                if size >= archive_bytes:
                    close()
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["archive", "records", "bytes"])

    # The order inside an archive must not depend on how the shuffle delivered its rows.
    ordered = rows.select("page_id", "url", "payload", "digest", "first").sortWithinPartitions("page_id", "digest", "url")
    path = new_folder(rows.sparkSession, "warc-manifest")
    ordered.mapInArrow(write_part, MANIFEST).write.parquet(path)
    return rows.sparkSession.read.schema(MANIFEST).parquet(path)


class _Window:
    """Bytes of an open file by absolute place, read forward in pieces; keeps only what is asked for."""

    def __init__(self, file):
        self.file, self.size, self.base, self.data = file, file.size(), 0, b""

    def take(self, start, length):
        end = min(start + length, self.size)
        if start < self.base or end > self.base + len(self.data):
            more = max(length, READ_BYTES)
            self.data, self.base = self.file.read_at(min(more, self.size - start), start), start
        return self.data[start - self.base: end - self.base]

    def search(self, wanted, start):
        """Place of the first match of a pattern at or after start, else the size."""
        while start < self.size:
            piece = self.take(start, READ_BYTES)
            if found := wanted.search(piece):
                return start + found.start()
            if start + len(piece) >= self.size:
                break
            start += max(1, len(piece) - 16)
        return self.size


def _inflate(window, start):
    """The content of the gzip member at start and its end, or a problem."""
    unpack, at, out = zlib.decompressobj(31), start, []
    if window.take(start, 3) != MAGIC:
        return None, "no gzip member"
    try:
        while not unpack.eof and at < window.size:
            piece = window.take(at, READ_BYTES)
            out.append(unpack.decompress(piece))
            at += len(piece)
    except zlib.error:
        return None, "gzip member does not inflate"
    if not unpack.eof:
        return None, "gzip member is cut off"
    return b"".join(out), at - len(unpack.unused_data)


def _parsed(header):
    """Fields of a header, folded lines joined to the one before; None if a line is no field."""
    fields, name = {}, None
    for line in header.split(b"\r\n")[1:]:
        if name is not None and line[:1] in (b" ", b"\t"):
            fields[name] = f"{fields[name]} {line.strip().decode('utf-8', 'replace')}".strip()
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        name = name.strip().lower().decode("latin-1")
        fields[name] = value.strip().decode("utf-8", "replace")
    return fields


def _number(text):
    """The integer that a field holds, or None."""
    return int(text) if re.fullmatch(r"-?[0-9]{1,18}", text or "") else None


def _checked(take, start, size, with_payload):
    """The record at start as a dict, or a problem; `take(start, length)` gives bytes.

    A record of the right shape with a wrong digest is a dict with `problem`: its own bytes are left out as a whole, so
    that a record quoted in its payload is not taken for one of the archive's.
    """
    head = take(start, 4096)
    if not VERSION.match(head):
        return "no version line"
    cut = head.find(b"\r\n\r\n")
    while cut < 0 and len(head) < size - start and not NEXT.search(head):
        head = take(start, 2 * len(head))
        cut = head.find(b"\r\n\r\n")
    fields = _parsed(head[:cut]) if cut >= 0 else None
    length, body = _number((fields or {}).get("content-length")), start + cut + 4
    if length is None or length < 0 or "warc-type" not in fields:
        return "damaged header"
    if body + length + 4 > size:
        return "record is cut off"
    block = take(body, length + 4)
    if block[length:] != b"\r\n\r\n":
        return "wrong length"
    block, kind = block[:length], fields["warc-type"]
    said = fields.get("warc-block-digest", "")
    if said.startswith("sha256:") and hashlib.sha256(block).hexdigest() != said[7:]:
        return {"end": body + length + 4, "problem": "wrong block digest"}
    http, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    digest, length = fields.get("warc-payload-digest", "").removeprefix("sha256:"), len(payload)
    if kind == "response":
        own = hashlib.sha256(payload).hexdigest()
        if digest and own != digest:
            return {"end": body + len(block) + 4, "problem": "wrong payload digest"}
        digest = own
    elif kind == "revisit":
        said = (_parsed(http) or {}).get("content-length", str(length))
        length = _number(said)
        if length is None:
            return {"end": body + len(block) + 4, "problem": "damaged HTTP header"}
    page = _number(fields.get("x-page-id"))
    if page is None and fields.get("x-page-id"):
        return {"end": body + len(block) + 4, "problem": "damaged page id"}
    refers = re.match(r"<urn:x-page:(-?[0-9]{1,18}):", fields.get("warc-refers-to", ""))
    return {"end": body + len(block) + 4, "record_type": kind, "record_id": fields.get("warc-record-id"),
            "target_uri": fields.get("warc-target-uri"), "page_id": page, "payload_bytes": length,
            "payload_digest": digest, "refers_to": int(refers[1]) if refers else None,
            "payload": payload if with_payload and kind == "response" else None}


def _plain(take, search, size, with_payload):
    """Records and gaps of plain WARC bytes, in order."""
    at = 0
    while at < size:
        got = _checked(take, at, size, with_payload)
        if isinstance(got, dict):
            yield {"start": at, **got}
            at = got["end"]
            continue
        after = at + 1
        while (after := search(after)) < size and isinstance(_checked(take, after, size, False), str):
            after += 1
        yield {"start": at, "end": after, "problem": got}
        at = after


def salvage(file, compressed, with_payload):
    """Records and gaps of one open archive, in order, as dicts; gaps carry `problem`."""
    window = _Window(file)
    if not compressed:
        yield from _plain(window.take, lambda at: window.search(VERSION, at), window.size, with_payload)
        return
    at, magic = 0, re.compile(re.escape(MAGIC))
    while at < window.size:
        content, end = _inflate(window, at)
        if content is None:
            problem, after = end, at + 1
            while (after := window.search(magic, after)) < window.size and _inflate(window, after)[0] is None:
                after += 1
            yield {"start": at, "end": after, "problem": problem}
            at = after
            continue

        def search(start, data=content):
            found = VERSION.search(data, start)
            return found.start() if found else len(data)

        for got in _plain(lambda s, n, data=content: data[s: s + n], search, len(content), with_payload):
            yield got | {"start": at, "end": end}  # places are those of the member in the file
        at = end


def read(archives: DataFrame, with_payload=True) -> DataFrame:
    """All records and gaps of the archives named in column `archive`; a row with `problem` is a quarantined gap.

    One task reads an archive as a stream, so memory holds a window and one record. Records of other types (warcinfo,
    request, ...) come back too, without a page.
    """

    def read_part(batches):
        names = [x.strip().split()[0] for x in CONTENT.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in CONTENT.split(", ")])
        rows, held = [], 0
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                store, path = fs.FileSystem.from_uri(name) if "://" in name or name.startswith("file:") else (
                    fs.LocalFileSystem(), name)
                with store.open_input_file(path) as file:
                    for got in salvage(file, name.endswith(".gz"), with_payload):
                        rows.append({"archive": name} | got)
                        held += len(got.get("payload") or b"")
                        if len(rows) >= 5000 or held > 16 << 20:
                            yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in names} for r in rows], schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in names} for r in rows], schema)

    # One row per archive: a count of files, not of data. An explicit number keeps tiny rows from sharing a task.
    tasks = max(1, min(archives.count(), 20_000))
    return archives.select("archive").repartition(tasks).mapInArrow(read_part, CONTENT)


def records(content: DataFrame) -> DataFrame:
    return content.where("problem IS NULL").drop("problem")


def gaps(content: DataFrame) -> DataFrame:
    return content.where("problem IS NOT NULL").select("archive", "start", "end", "problem")


SQL = """
SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
       sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id > first THEN first END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
"""


@query("op5_warc", SQL)
def op5(spark, sf_dir):
    """Archives every page and returns what the archives hold."""
    archives = write(with_record_types(table(spark, sf_dir, "pages")), new_folder(spark, "warc"))
    return records(read(archives, with_payload=False)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

import gzip
import io

import pytest
from pyspark.sql import Row

from postmill.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, first long"


def bytes_of(*pages):
    return [warc._record(i, f"http://a.b/{i}", p, warc.hashlib.sha256(p).hexdigest(), None) for i, p in enumerate(pages)]


class Opened(io.BytesIO):
    def size(self):
        return len(self.getvalue())

    def read_at(self, n, at):
        return self.getvalue()[at: at + n]


def read(data, compressed):
    return list(warc.salvage(Opened(data), compressed, True))


PAGES = [b"<p>one</p>" * 30, b"", b"<p>WARC/1.1\r\n\r\n\r\nWARC/1.1\r\n</p>" * 20, b"x" * 3_000_000, b"last" * 50]


@pytest.mark.parametrize("compressed", [False, True])
def test_round_trip(compressed):
    parts = [gzip.compress(x) if compressed else x for x in bytes_of(*PAGES)]
    got = read(b"".join(parts), compressed)
    assert [x["payload"] for x in got] == PAGES
    assert [x["start"] for x in got] == [sum(map(len, parts[:i])) for i in range(5)]


@pytest.mark.parametrize("compressed", [False, True])
def test_urls_of_any_length(compressed):
    urls = ["http://a.b/1", "http://a.b/" + "x" * 3_000_000, "http://a.b/3"]
    parts = [warc._record(i, url, b"<p>page</p>", warc.hashlib.sha256(b"<p>page</p>").hexdigest(), None) for i, url in enumerate(urls)]
    got = read(b"".join(gzip.compress(x) if compressed else x for x in parts), compressed)
    assert [(x["target_uri"], x["payload"]) for x in got] == [(url, b"<p>page</p>") for url in urls]
    # A header block without an end costs its own record only.
    broken = parts[0].replace(b"\r\n\r\n", b"\r\n--", 2).replace(b"\r\n\r\n", b"\r\n")
    assert [x.get("target_uri") for x in read(broken + parts[1] + parts[2], False)] == [None, *urls[1:]]


@pytest.mark.parametrize("compressed", [False, True])
@pytest.mark.parametrize("damage", ["flip", "cut", "junk", "zero"])
@pytest.mark.parametrize("which", [0, 2, 4])
def test_damage_costs_one_record(compressed, damage, which):
    parts = [gzip.compress(x) if compressed else x for x in bytes_of(*PAGES)]
    whole, middle = parts[which], len(parts[which]) - 60  # inside the payload
    parts[which] = {"flip": whole[:middle] + bytes([whole[middle] ^ 85]) + whole[middle + 1:], "cut": whole[:middle],
                    "junk": b"\x1f\x8b\x08junk" + whole[9:], "zero": b"\0" * len(whole)}[damage]
    data = b"".join(parts)
    got = read(data, compressed)
    assert [x["payload"] for x in got if "problem" not in x] == [p for i, p in enumerate(PAGES) if i != which]
    lost = [x for x in got if "problem" in x]
    assert lost and min(x["start"] for x in lost) == sum(map(len, parts[:which]))
    places = sorted((x["start"], x["end"]) for x in got)
    assert places[0][0] == 0 and places[-1][1] == len(data)  # records and gaps cover the archive
    assert all(a[1] == b[0] for a, b in zip(places, places[1:]))


def test_one_member_with_many_records():
    parts = bytes_of(*PAGES)
    parts[1] = parts[1].replace(b"Content-Length: ", b"Content-Length: 9")
    got = read(gzip.compress(b"".join(parts)), True)
    assert [x["payload"] for x in got if "problem" not in x] == [PAGES[i] for i in (0, 2, 3, 4)]


def test_empty_archive():
    assert read(b"", True) == read(b"", False) == []


def archived(spark, tmp_path, rows, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int, first string, payload int")
    folder = str(tmp_path / "archives")
    manifest = warc.write(warc.with_record_types(pages), folder, **options)
    return manifest, warc.read(manifest)


@pytest.mark.parametrize("compressed", [False, True])
def test_table_with_odd_rows(spark, tmp_path, compressed):
    long, same = "é" * 200_000, "same text " * 20
    rows = [(1, None, None, 1, "x", 1), (2, "http://a.b/ c\r\nd", "short", 1, None, None), (3, "u", "short", None, "", 0),
            (7, "u", same, 1, "a", 1), (5, "v", same, 1, "a", 1), (None, "w", same, 1, "a", 1), (5, "v", same, 1, "a", 1),
            (8, "u", long, 0, "", 0), (None, None, None, None, None, None)]
    manifest, content = archived(spark, tmp_path, rows, compressed=compressed, archive_bytes=300)
    assert manifest.count() > 1 and warc.gaps(content).count() == 0
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes): r for r in warc.records(content).collect()}
    assert set(got) == {(1, "response", None, 0), (2, "response", None, 5), (3, "response", None, 5),
                        (7, "revisit", 5, 200), (5, "response", None, 200), (None, "revisit", 5, 200),
                        (8, "response", None, 400_000), (None, "response", None, 0)}
    assert warc.records(content).count() == 9
    assert got[(8, "response", None, 400_000)].payload.decode() == long
    assert got[(2, "response", None, 5)].target_uri == "http://a.b/%20c%0D%0Ad"
    assert got[(1, "response", None, 0)].target_uri is None


def test_empty_table(spark, tmp_path):
    manifest, content = archived(spark, tmp_path, [])
    assert manifest.count() == 0 and content.count() == 0


def test_damaged_file_through_spark(spark, tmp_path):
    parts = [gzip.compress(x) for x in bytes_of(*PAGES)]
    parts[1] = parts[1][:20]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts))
    content = warc.read(spark.createDataFrame([Row(archive=str(tmp_path / "a.warc.gz"))]))
    assert warc.records(content).count() == 4
    lost = warc.gaps(content).collect()
    assert [(r.start, r.end) for r in lost] == [(len(parts[0]), len(parts[0]) + 20)]

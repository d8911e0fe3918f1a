"""Inputs that once gave wrong or lost results, crashed or took long, by module."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.llm import decon, linedup, mainhtml, ring, toxic, warc


def texts(page):
    return [text for _, text, _ in mainhtml.blocks(page)]


def test_unclosed_elements_end_at_the_next_block():
    assert texts("<p>one</p><svg width=1><path d='M0'><p>two</p><p>three</p>") == ["one", "two", "three"]
    assert texts("<p>a<svg><title>t</title></svg>b<math><mi>x</mi></math>c</p>") == ["abc"]
    assert texts("<p>one</p><template><i>x<p>two</p>") == ["one", "two"] == texts("<p>one</p><object><i>x<p>two</p>")
    assert texts("<p>one</p><template><p>x</p></template><p>two</p>") == ["one", "two"]
    assert texts("<p>a <b <c d <!-- gone") == ["a <b <c d"] and texts("x<!-- a --> y <!b> z<!") == ["x y z"]


@pytest.mark.parametrize("page", [
    "<a " * 350_000, "<b>" * 50_000 + "</i>" * 50_000, "<div>x" * 20_000, "<svg>" * 50_000, "<template>" * 50_000 + "x",
    "<p>x<!--" * 50_000, "<a '" * 100_000 + ">", "<i><body>" + "<b>" * 30_000 + "</i>" * 30_000])
def test_long_broken_pages_take_little_time(page):
    start = time.process_time()
    mainhtml._chain(page)
    assert time.process_time() - start < 6


def test_all_regions_of_a_band(spark):
    item = "abcdefgh"
    near = spark.createDataFrame([(1, "abcdefgh abcdefgh"), (2, "abcdefgh" + "-" * 100 + "abcdefgh"), (3, "abcdefgh" * 3)],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = sorted((r.doc_id, r.start, r.end, r.edits) for r in decon.contamination(near, bench).collect())
    assert got == [(1, 0, 8, 0), (1, 9, 17, 0), (2, 0, 8, 0), (2, 108, 116, 0), (3, 0, 8, 0), (3, 8, 16, 0), (3, 16, 24, 0)]
    wanted = b"the quick brown fox jumps over it"
    text = b"the quick brown fix jumps over it, and the quick brwn fox jumps over it; the quick brown fox jumps over it"
    assert sorted(decon.regions_of(wanted, text, 3)) == [(0, 73, 106), (1, 0, 33), (1, 39, 71)]


def test_lines_are_compared_by_characters(spark):
    pairs = [("привет мир", "привет мир!"), ("мама мыла раму", "мама мыла рамы"), ("你好世界你好世界一", "你好世界你好世界二")]
    rows = [(i, line) for i, pair in enumerate(pairs) for line in pair]
    out = linedup.duplicate_lines(spark.createDataFrame([(n, x) for n, (_, x) in enumerate(rows)], "doc_id long, text string"))
    assert all(r.kept for r in out.collect())
    for line in ("plain ascii line", "short", "zoë and more of it", "", "aé" * 30):
        for other in ("plain ascii line", "naïve"):
            values, counts = linedup._shingles([line.encode(), other.encode()])
            for text, own in zip((line, other), np.split(values, np.cumsum(counts)[:-1])):
                padded = text.ljust(8, "\0")
                want = {padded[i:i + 8] for i in range(len(padded) - 7)}
                assert len(set(own.tolist())) == len(want) and len(own) == len(padded) - 7
    wide, narrow = linedup._wide_shingles([b"plain ascii line"])[0], linedup._ascii_shingles([b"plain ascii line"])[0]
    assert wide.tolist() == narrow.tolist()


def test_documents_may_have_columns_of_any_name(spark):
    line = "a line that is long enough to be one"
    rows = [(1, f"{line}\nother words here", 5, 6, 7, 8, 9), (2, f"{line}\nmore of the second", 5, 6, 7, 8, 9), (3, line, 5, 6, 7, 8, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, id int, _left int, _dropped int, _ownrow int")
    out = linedup.without_duplicates(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text, r._left) for r in out.collect()) == [
        (1, f"{line}\nother words here", 7), (2, "more of the second", 7)]


@pytest.mark.parametrize("old, new, kind", [
    (b"Content-Length: 5\r\n\r\n", b"Content-Length: abc\r\n\r\n", "damaged HTTP header"),
    (b"Content-Length: 5\r\n\r\n", b"Content-Length: 12, 12\r\n\r\n", "damaged HTTP header"),
    (b"X-Page-Id: 3", b"X-Page-Id: p7", "damaged page id"), (b"WARC-Type: revisit", b"WARC-Type:\r\n  revisit", None)])
def test_odd_headers_are_set_aside(old, new, kind):
    http = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\n"
    block = http.replace(old, new) if old in http else http
    head = (b"WARC/1.1\r\nWARC-Type: revisit\r\nX-Page-Id: 3\r\nWARC-Refers-To: <urn:x-page:1:a>\r\nContent-Length: "
            + str(len(block)).encode() + b"\r\n\r\n")
    record = (head if old in http else head.replace(old, new)) + block + b"\r\n\r\n"
    got = warc._checked(lambda start, length: record[start:start + length], 0, len(record), False)
    assert got.get("problem") == kind
    if kind is None:
        assert (got["record_type"], got["page_id"], got["payload_bytes"], got["refers_to"]) == ("revisit", 3, 5, 1)


def test_places_do_not_depend_on_partitions(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 9).alias("text"))
    df = df.unionByName(df.where("doc_id % 3 = 0").select(F.lit(5).cast("long").alias("doc_id"), "text"))
    one, many = (sorted(map(tuple, ring.assign(df.repartition(n)).collect())) for n in (1, 11))
    assert one == many


def test_the_sample_does_not_depend_on_the_order_of_rows(spark):
    rows = [(i, f"{w} text {i}") for i in range(200) for w in ("alpha", "beta")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    samples = [toxic.training_sample(spark.createDataFrame(r, "doc_id long, text string").coalesce(1), labels)
               for r in (rows, rows[::-1])]
    assert samples[0] == samples[1] and len(samples[0]) > 100

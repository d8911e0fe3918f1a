import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from postmill.functions import address
from postmill.operators import validate as V

PATTERN = re.compile(
    r"^[a-z0-9!#$%&'*+/=?^_`{|}~-]+([.][a-z0-9!#$%&'*+/=?^_`{|}~-]+)*"
    r"@([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?[.])+[a-z]{2,63}\Z")
ACCEPTED = ["a@b.co", "first.last+tag@sub.example.co.uk", "o'brien@x.org", "a" * 64 + "@x.org",
            "a@" + "b" * 63 + ".com", "a@1-2.co", "x@a.b.c.d.museum"]
REJECTED = ["a@b", "@x.com", "a@@b.com", "a..b@x.com", ".a@x.com", "a.@x.com", "a@-x.com", "a@x-.com", "a b@x.com",
            "a@x.c", "a@x.com.", "a@.x.com", "a@x..com", "a@" + "b" * 64 + ".com", "a@x.c0m", "a@x.com\n", "a\n@x.com",
            "plain", "a@b.co@c.co", "ü@x.org", "a@x.com,b@x.com"]


def frame(spark, values):
    return spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, email string")


def test_pattern_cases(spark):
    cases = ACCEPTED + REJECTED
    out = frame(spark, cases).select("i", address.looks_like_address(F.col("email"))).collect()
    got = [cases[r[0]] for r in out if r[1]]
    assert sorted(got) == sorted(ACCEPTED)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab1@.-_+!é \n", max_size=14), min_size=200, max_size=200))
def test_same_verdict_as_one_pattern(spark, values):
    out = frame(spark, values).select("i", address.looks_like_address(F.col("email")).alias("ok")).collect()
    assert {r.i: r.ok for r in out} == {i: bool(PATTERN.match(x)) for i, x in enumerate(values)}


def test_long_junk_does_not_break_the_matcher(spark):
    junk = ["a." * 200_000 + "a@x.com", "a@" + "x." * 200_000 + "com", "@" * 300_000, "a" * 1_000_000]
    out = frame(spark, junk).select(address.syntax_detail(F.col("email")).alias("d")).collect()
    assert [r.d for r in out] == ["Local part exceeds 64 characters", "Domain exceeds 255 characters",
                                  "Invalid email syntax", "Invalid email syntax"]


@pytest.mark.parametrize("raw, wanted", [
    ("\tUser@X.Org \n", "user@x.org"), (" a@b.co﻿", "a@b.co"), ("   ", ""), ("A B@c.de", "a b@c.de")])
def test_normalize(spark, raw, wanted):
    assert frame(spark, [raw]).select(address.normalize_email(F.col("email"))).first()[0] == wanted


def test_detail_of_missing_blank_and_long(spark):
    raws = [None, "", "  ", "a" * 65 + "@x.org", "a@" + ".".join(["b" * 60] * 5) + ".com"]
    df = frame(spark, raws).withColumn("raw", F.col("email")).withColumn(
        "email", F.when(F.col("raw") != "", address.normalize_email(F.col("raw"))))
    out = V.validate(df, raw="raw").orderBy("i").collect()
    assert [r.details for r in out] == [
        "Email is empty or not a string", "Email is empty or not a string", "Email is empty",
        "Local part exceeds 64 characters", "Domain exceeds 255 characters"]
    assert not any(r.is_valid for r in out) and {r.reason for r in out} == {"syntax"}


def test_layers_in_order_and_repeated_list_rows(spark):
    disposable = spark.createDataFrame([("tempmail.com",), ("TempMail.com",)], "domain string")
    mx = spark.createDataFrame([("x.org", True, None), ("y.org", False, None), ("z.org", False, "ETIMEOUT")],
                               "domain string, has_mx boolean, error string")
    df = frame(spark, ["a@tempmail.com", "a@x.org", "a@y.org", "a@z.org", "a@nowhere.org", "bad"])
    out = {r.email: (r.is_valid, r.reason, r.details) for r in V.validate(df, disposable, mx).collect()}
    assert out == {
        "a@tempmail.com": (False, "disposable", "Disposable email domain: tempmail.com"),
        "a@x.org": (True, None, None),
        "a@y.org": (False, "mx-fail", "No MX records found for domain: y.org"),
        "a@z.org": (False, "mx-fail", "MX lookup failed for domain z.org: ETIMEOUT"),
        "a@nowhere.org": (False, "mx-fail", "MX lookup failed for domain nowhere.org: ENOTFOUND"),
        "bad": (False, "syntax", "Invalid email syntax"),
    }
    assert V.validate(df, disposable).count() == 6

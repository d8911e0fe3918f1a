"""Queries on addresses: normalisation, the verdict layers, bulk validation."""

from pyspark.sql import functions as F

from postmill.functions import address
from postmill.operators import intake, validate as V
from postmill.plans import views as v
from postmill.plans.registry import query
from postmill.plans.views import sql


def rows_of(spark, sf_dir):
    return v.mail_rows_from(v.table(spark, sf_dir, "orders"))


@query("normalize_email", "P01", sql(v.CHECKED, body="SELECT line_no, email FROM checked"))
def normalize_email(spark, sf_dir):
    return intake.normalized(rows_of(spark, sf_dir)).select("line_no", "email")


@query("syntax_verdict", "P02", sql(v.CHECKED, body="SELECT line_no, syntax_detail FROM checked"))
def syntax_verdict(spark, sf_dir):
    rows = intake.normalized(rows_of(spark, sf_dir))
    return rows.select(
        "line_no", address.raw_syntax_detail(F.col("raw_email"), F.col("email")).alias("syntax_detail"))


@query("email_domain", "P03", sql(v.CHECKED, body="""
SELECT domain, count(*) AS rows FROM checked WHERE email IS NOT NULL GROUP BY domain"""))
def email_domain(spark, sf_dir):
    rows = intake.normalized(rows_of(spark, sf_dir)).where(F.col("email").isNotNull())
    return rows.groupBy(address.email_domain(F.col("email")).alias("domain")).agg(F.count("*").alias("rows"))


@query("layered_verdict", "P04 J01", sql(v.CHECKED, body="SELECT line_no, email, is_valid, reason, details FROM checked"))
def layered_verdict(spark, sf_dir):
    rows = intake.normalized(rows_of(spark, sf_dir))
    out = V.validate(rows, v.disposable(spark), raw="raw_email")
    return out.select("line_no", "email", "is_valid", "reason", "details")


@query("disposable_domains", "J01", sql(v.CHECKED, body="""
SELECT domain, domain IN ('10minutemail.com','tempmail.com','guerrillamail.com') AS is_disposable, count(*) AS rows
FROM checked WHERE syntax_detail IS NULL GROUP BY 1, 2"""))
def disposable_domains(spark, sf_dir):
    rows = intake.normalized(rows_of(spark, sf_dir))
    good = V.validate(rows, raw="raw_email").where("is_valid").withColumn("domain", address.email_domain(F.col("email")))
    flagged = V.with_disposable(good, v.disposable(spark))
    return flagged.groupBy("domain", "is_disposable").agg(F.count("*").alias("rows"))


MX = """
SELECT line_no, email, is_valid AND (d.domain IS NOT NULL AND d.has_mx) AS is_valid,
 CASE WHEN reason IS NOT NULL THEN reason WHEN d.domain IS NULL OR NOT d.has_mx THEN 'mx-fail' END AS reason,
 CASE WHEN reason IS NOT NULL THEN details
  WHEN d.domain IS NULL THEN 'MX lookup failed for domain ' || c.domain || ': ENOTFOUND'
  WHEN NOT d.has_mx THEN 'No MX records found for domain: ' || c.domain END AS details
FROM checked c LEFT JOIN (SELECT 'mail' || CAST(i AS VARCHAR) || '.example.com' AS domain, i % 3 <> 0 AS has_mx
 FROM range(6) t(i)) d ON c.domain = d.domain"""


@query("mx_verdict", "P04 J02", sql(v.CHECKED, body=MX))
def mx_verdict(spark, sf_dir):
    rows = intake.normalized(rows_of(spark, sf_dir))
    out = V.validate(rows, v.disposable(spark), v.domain_mx(spark), raw="raw_email")
    return out.select("line_no", "email", "is_valid", "reason", "details")


@query("bulk_validate", "P05", sql(v.CHECKED, body="""
SELECT DISTINCT email, is_valid, reason, details FROM checked WHERE email IS NOT NULL"""))
def bulk_validate(spark, sf_dir):
    rows = intake.normalized(rows_of(spark, sf_dir)).where(F.col("email").isNotNull())
    return V.validate_each_once(rows, v.disposable(spark)).select("email", "is_valid", "reason", "details")


@query("invalid_by_reason", "A06", sql(v.CHECKED, body="""
SELECT reason AS invalid_reason, CAST(sum(n) AS BIGINT) AS rows, count(email) AS addresses
FROM (SELECT mailing_id, email, reason, count(*) AS n FROM checked WHERE NOT is_valid GROUP BY ALL) GROUP BY reason"""))
def invalid_by_reason(spark, sf_dir):
    return intake.invalid_breakdown(rows_of(spark, sf_dir), v.disposable(spark))


@query("audit_rows", "F12", sql(v.CHECKED, body="""
SELECT line_no, email, reason FROM checked WHERE NOT is_valid AND email IS NOT NULL AND email <> ''"""))
def audit_rows(spark, sf_dir):
    out = V.validate(intake.normalized(rows_of(spark, sf_dir)), v.disposable(spark), raw="raw_email")
    return intake.storable(out.where(~F.col("is_valid"))).select("line_no", "email", "reason")

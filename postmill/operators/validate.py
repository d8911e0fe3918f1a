"""Layered address validation: syntax, then disposable domain, then mail exchanger; the first failure wins."""

from pyspark.sql import DataFrame, functions as F

from postmill import constants as K
from postmill.functions import address
from postmill.operators.spread import attach


def with_disposable(df: DataFrame, disposable: DataFrame, domain="domain", name="is_disposable") -> DataFrame:
    """Flag rows whose domain is on the list. disposable: column domain."""
    listed = disposable.select(F.lower("domain").alias(domain)).distinct().withColumn(name, F.lit(True))
    return attach(df, listed, [domain]).withColumn(name, F.coalesce(name, F.lit(False)))


def with_mx(df: DataFrame, domain_mx: DataFrame, domain="domain") -> DataFrame:
    """Add mx_known, mx_ok and mx_error per domain. domain_mx: columns domain, has_mx and optionally error."""
    error = F.max("error") if "error" in domain_mx.columns else F.lit(None).cast("string")
    table = (
        domain_mx.groupBy(F.lower("domain").alias(domain))
        .agg(F.max("has_mx").alias("mx_ok"), error.alias("mx_error"))
        .withColumn("mx_known", F.col("mx_error").isNull() & F.col("mx_ok").isNotNull())
    )
    return (
        attach(df, table, [domain])
        .withColumn("mx_known", F.coalesce("mx_known", F.lit(False)))
        .withColumn("mx_ok", F.col("mx_known") & F.coalesce("mx_ok", F.lit(False)))
    )


def validate(df: DataFrame, disposable=None, domain_mx=None, raw=None, email="email") -> DataFrame:
    """Add is_valid, reason and details to normalised addresses.

    A layer runs when its table is given. raw names the untouched cell when missing cells must be told from blank ones.
    """
    c = F.col(email)
    cell = F.col(raw) if raw else c
    out = df.withColumns({"domain": address.email_domain(c), "_syntax": address.raw_syntax_detail(cell, c)})
    reason = F.when(F.col("_syntax").isNotNull(), K.REASON_SYNTAX)
    details = F.when(F.col("_syntax").isNotNull(), F.col("_syntax"))
    if disposable is not None:
        out = with_disposable(out, disposable, name="_disposable")
        reason = reason.when(F.col("_disposable"), K.REASON_DISPOSABLE)
        details = details.when(F.col("_disposable"), address.disposable_detail(F.col("domain")))
    if domain_mx is not None:
        out = with_mx(out, domain_mx)
        reason = reason.when(~F.col("mx_ok"), K.REASON_MX)
        details = details.when(
            ~F.col("mx_ok"), address.mx_detail(F.col("domain"), F.col("mx_known"), F.col("mx_error"))
        )
    out = out.withColumn("reason", reason).withColumn("details", details)
    return (
        out.withColumn("is_valid", F.col("reason").isNull())
        .drop("_syntax", "_disposable", "domain", "mx_ok", "mx_known", "mx_error")
    )


def validate_each_once(df: DataFrame, disposable=None, domain_mx=None, email="email") -> DataFrame:
    """Address -> result for every distinct address: the two-column form of bulk validation plus its texts."""
    return validate(df.select(email).distinct(), disposable, domain_mx, email=email)

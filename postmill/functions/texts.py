"""Report texts: percentages, durations, masks, messages and audit lines."""

from pyspark.sql import Column, functions as F

from postmill import constants as K


def percent(part: Column, whole: Column, digits=2) -> Column:
    """100*part/whole rounded half up; 0 when whole is 0 or missing."""
    return F.when(whole > 0, F.round(F.lit(100.0) * part / whole, digits)).otherwise(F.lit(0.0))


def percent_text(part: Column, whole: Column, digits=2) -> Column:
    return F.format_string(f"%.{digits}f", percent(part, whole, digits))


def _whole(c: Column) -> Column:
    return F.floor(c).cast("bigint").cast("string")


def delay_text(ms: Column) -> Column:
    """800ms, 1.5s, 2m 30s or 1m; tenths are rounded half up."""
    tenths = F.floor((ms + F.lit(50)) / 100)
    minutes, seconds = F.floor(ms / 60000), F.floor((ms % 60000) / 1000)
    return (
        F.when(ms < 1000, F.concat(ms.cast("bigint").cast("string"), F.lit("ms")))
        .when(ms < 60000, F.concat(_whole(tenths / 10), F.lit("."), _whole(tenths % 10), F.lit("s")))
        .when(seconds > 0, F.concat(_whole(minutes), F.lit("m "), _whole(seconds), F.lit("s")))
        .otherwise(F.concat(_whole(minutes), F.lit("m")))
    )


def long_duration_text(ms: Column) -> Column:
    """The two largest units of a long duration: 1d 3h, 2h 5m, 4m 10s or 9s."""
    seconds = F.floor(ms / 1000)
    minutes, hours, days = F.floor(ms / 60000), F.floor(ms / 3600000), F.floor(ms / 86400000)
    return (
        F.when(days > 0, F.concat(_whole(days), F.lit("d "), _whole(hours % 24), F.lit("h")))
        .when(hours > 0, F.concat(_whole(hours), F.lit("h "), _whole(minutes % 60), F.lit("m")))
        .when(minutes > 0, F.concat(_whole(minutes), F.lit("m "), _whole(seconds % 60), F.lit("s")))
        .otherwise(F.concat(_whole(seconds), F.lit("s")))
    )


def mask_key(c: Column) -> Column:
    shown = F.concat(F.substring(c, 1, 8), F.lit("..."), F.right(c, F.lit(8)))
    return F.when(F.length(c) <= 16, c).otherwise(shown)


def mask_token(c: Column) -> Column:
    shown = F.concat(F.substring(c, 1, 6), F.lit("..."), F.right(c, F.lit(4)))
    return F.when(F.length(c) <= 10, F.lit("***")).otherwise(shown)


URL_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#@]*@)?([^/?#@]+)([^?#]*)"


def mask_url(c: Column) -> Column:
    """Scheme, host and path only; a text that is no URL stays as it is."""
    scheme, host, path = (F.regexp_extract(c, URL_PARTS, i) for i in (1, 3, 4))
    shown = F.concat(F.lower(scheme), F.lit("://"), F.lower(host), F.when(path == "", "/").otherwise(path))
    return F.when(scheme == "", c).otherwise(shown)


def message_subject() -> Column:
    return F.lit(K.SUBJECT)


def message_body(token: Column) -> Column:
    return F.format_string(K.BODY, token)


def pool_body(token: Column) -> Column:
    return F.format_string(K.POOL_BODY, token)


def audit_text(http_status: Column, error: Column) -> Column:
    return F.concat(F.lit("["), F.coalesce(http_status.cast("string"), F.lit("N/A")), F.lit("] "), error)


def failure_reason(status: Column, reason: Column) -> Column:
    """Reason cut to the stored width, kept only for failed rows."""
    return F.when(status == "FAILED", F.substring(reason, 1, K.REASON_CHARS))


def failure_details(status: Column, reason: Column) -> Column:
    kept = (status == "FAILED") & (reason != "")
    return F.when(kept, F.to_json(F.struct(reason.alias("error"))))


def status_filter(value):
    """Upper-cased entry status, or None for no filter; refuses an unknown one before any job runs."""
    from postmill.constants import ENTRY_STATUSES

    if not value:
        return None
    if value.upper() not in ENTRY_STATUSES:
        raise ValueError("Status must be one of: " + ", ".join(ENTRY_STATUSES))
    return value.upper()

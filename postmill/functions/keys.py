"""Stable keys and tokens: functions of the row, so a repeated task gives the same value."""

from pyspark.sql import Column, functions as F

from postmill import constants as K


def idempotency_key(mailing_id, email, attempt) -> Column:
    return F.sha2(F.concat_ws(":", mailing_id, email, attempt.cast("string")), 256)


def salted_key(mailing_id, email, salt) -> Column:
    return F.sha2(F.concat_ws("-", mailing_id, email, salt), 256)


def row_id(*parts) -> Column:
    """Identifier text in uuid form, derived from the row's natural key."""
    h = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(h, start, size) for start, size in cuts])


def bucket(mailing_id) -> Column:
    """Folder of a mailing: readers of one mailing prune to one folder."""
    return F.pmod(F.xxhash64(mailing_id), F.lit(K.BUCKETS)).cast("int")


def _digest(secret, mailing_id, email, part=0) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(secret), mailing_id, email, F.lit(str(part))), 256)


def _digits(secret, mailing_id, email, hex_chars) -> Column:
    """At least hex_chars hexadecimal digits of keyed digest."""
    blocks = -(-hex_chars // 64)
    return F.concat(*[_digest(secret, mailing_id, email, i) for i in range(blocks)])


def hex_token(secret, mailing_id, email, length=32) -> Column:
    return F.substring(_digits(secret, mailing_id, email, length), 1, length)


def numeric_code(secret, mailing_id, email, length=6) -> Column:
    """A number of exactly `length` digits (up to 15), as text."""
    low = 10 ** (length - 1)
    drawn = F.conv(F.substring(_digest(secret, mailing_id, email), 1, 15), 16, 10).cast("long")
    return (drawn % F.lit(9 * low) + F.lit(low)).cast("string")


def alphanumeric_token(secret, mailing_id, email, length=8) -> Column:
    digits = _digits(secret, mailing_id, email, 2 * length)
    alphabet = F.lit(K.TOKEN_ALPHABET)

    def pick(i):
        byte = F.conv(F.substring(digits, 2 * i + 1, 2), 16, 10).cast("int")
        return F.substr(alphabet, byte % F.lit(len(K.TOKEN_ALPHABET)) + F.lit(1), F.lit(1))

    return F.concat(*[pick(i) for i in range(length)])

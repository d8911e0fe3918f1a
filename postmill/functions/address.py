"""Recipient address rules."""

from pyspark.sql import Column, functions as F

from postmill import constants as K

# Fixed value: the characters that a text trim removes at both ends.
BLANKS = (
    " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# Dot-atom local part at a host name with an alphabetic top label. No group is repeated: Java's matcher recurses once per
# repetition of a group and could overflow the stack on a long junk cell, while single-character loops do not recurse.
ADDRESS = (
    r"^(?![.])(?!.*[.][.])[a-z0-9!#$%&'*+/=?^_`{|}~.-]++(?<![.])"
    r"@(?!.*(?:-[.]|[.]-))(?!.*[a-z0-9-]{64})[a-z0-9][a-z0-9.-]*[.][a-z]{2,63}\z"
)


def trim_blanks(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def normalize_email(c: Column) -> Column:
    return F.lower(trim_blanks(c))


def email_domain(c: Column) -> Column:
    """Lower-cased text between the first and the second '@'."""
    return F.lower(F.split_part(c, F.lit("@"), F.lit(2)))


def looks_like_address(c: Column) -> Column:
    """Whether a normalised text has the form of an address."""
    return c.rlike(ADDRESS)


def syntax_detail(c: Column) -> Column:
    """Why a normalised address fails the syntax layer; null when it passes. First failing rule wins."""
    return (
        F.when(c == "", K.DETAIL_EMPTY)
        .when(~looks_like_address(c), K.DETAIL_SYNTAX)
        .when(~c.rlike(r"^[^@]*@[^@]*\z"), K.DETAIL_FORMAT)
        .when(c.rlike(r"^[^@]{%d}" % (K.LOCAL_PART_MAX + 1)), K.DETAIL_LOCAL)
        .when(c.rlike(r"@[^@]{%d}" % (K.DOMAIN_MAX + 1)), K.DETAIL_DOMAIN)
        .when(~c.rlike(r"@[^@]*[.]"), K.DETAIL_DOT)
    )


def raw_syntax_detail(raw: Column, normalized: Column) -> Column:
    """Syntax detail for a raw cell, where a missing or empty cell has its own text."""
    return F.when(F.coalesce(raw, F.lit("")) == "", K.DETAIL_MISSING).otherwise(syntax_detail(normalized))


def disposable_detail(domain: Column) -> Column:
    return F.concat(F.lit("Disposable email domain: "), domain)


def mx_detail(domain: Column, known: Column, error: Column) -> Column:
    """Text for a domain without mail exchanger (known) or whose lookup failed (not known)."""
    return F.when(known, F.concat(F.lit("No MX records found for domain: "), domain)).otherwise(
        F.concat(F.lit("MX lookup failed for domain "), domain, F.lit(": "), F.coalesce(error, F.lit("ENOTFOUND")))
    )

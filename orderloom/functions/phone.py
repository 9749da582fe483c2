"""Phone operators as native Column functions (ids P1-P7)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderloom.functions.text import begins, let

# What a number looks like, what blocks it when directly before it, and its labels.
NUMBER = r"(?<!\d)\(?(?:\+?84|0)(?:[\s.\-()]*\d){9}\)?(?!\d)"
CONTEXT = r"(?:mã\s*đơn|ma\s*don|nhà\s*số|nha\s*so|số\s*nhà|so\s*nha)\s*[:#-]?\s*"
LABEL = r"(?:sđt|sdt|đt|dt|phone|tel|điện\s*thoại|dien\s*thoai)\s*[:：#-]?\s*(?=\[PHONE\])"
MOBILE = r"^(?:84|0)([35789]\d{8})$"
#: Led by a look at the one or two signs that a context or a number can begin with.
FOUND = rf"(?iU){begins('(+80', 'm ãa', 'n h', 's ốo')}(?:{CONTEXT})?{NUMBER}"
#: What lies before the next number, or before the end.
BEFORE = rf"(?s)(.*?)(?:{FOUND}|\z)"
#: The core of every number, which most texts lack; found without going back.
DIGITS = r"(?U)\d(?:[\s.\-()]*+\d){9}"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\D", "")


def normalize_phone(c: Column) -> Column:
    """Ten digits of a mobile number (84 becomes 0), else null."""
    return F.concat(F.lit("0"), F.nullif(F.regexp_extract(_digits(c), MOBILE, 1), F.lit("")))


def phone_blocked(match: Column) -> Column:
    """Whether a match begins with a context that blocks it (order code, house number)."""
    return match.rlike(rf"(?iU)^{CONTEXT}")


def all_phones(c: Column) -> Column:
    """Every valid, unblocked number in order; an empty array for none or null."""
    none = F.array().cast("array<string>")
    found = let(F.coalesce(c, F.lit("")), lambda t: F.when(t.rlike(DIGITS), F.regexp_extract_all(t, F.lit(FOUND), F.lit(0))).otherwise(none))
    valid = F.transform(F.filter(found, lambda m: ~phone_blocked(m)), normalize_phone)
    return F.filter(valid, lambda p: p.isNotNull())


def extract_phone(c: Column) -> Column:
    """The first valid, unblocked number, else null."""
    return F.get(all_phones(c), F.lit(0))


def _replaced(c: Column, token: str) -> Column:
    def good(m: Column) -> Column:
        return ~phone_blocked(m) & _digits(m).rlike(MOBILE)

    def some(t: Column, found: Column) -> Column:
        # what lies between matches, up to the end, and the matches; a split would compile its pattern for each text
        between, done = F.regexp_extract_all(t, F.lit(BEFORE), F.lit(1)), F.transform(found, lambda m: F.when(good(m), F.lit(token)).otherwise(m))
        return F.array_join(F.zip_with(between, done, lambda b, d: F.concat(b, F.coalesce(d, F.lit("")))), "")

    def body(s: Column) -> Column:
        # most texts have no number, or one, which stands there once; only others need a look at what lies between
        t, found = s["t"], s["found"]
        one = found[0]
        once = (F.size(found) == 1) & (F.length(F.replace(t, one, F.lit(""))) + F.length(one) == F.length(t))
        return F.when(F.size(F.filter(found, good)) <= 0, t).when(once, F.replace(t, one, F.lit(token))).otherwise(some(t, found))

    t = F.coalesce(c, F.lit(""))
    none = F.array().cast("array<string>")
    found = F.when(t.rlike(DIGITS), F.regexp_extract_all(t, F.lit(FOUND), F.lit(0))).otherwise(none)
    return let(F.struct(t.alias("t"), found.alias("found")), body)


def drop_phone_label(c: Column) -> Column:
    """P5: labels directly before [PHONE] removed."""
    return F.regexp_replace(c, f"(?iU){begins('s đd', 'đd ti', 'p h', 't e')}{LABEL}", "")


def mask_phone(c: Column, token: str = "[PHONE]") -> Column:
    """Valid, unblocked numbers become ``token``, labels before it go."""
    return drop_phone_label(_replaced(c, token))


def remove_phone(c: Column) -> Column:
    """Valid, unblocked numbers become a space."""
    return _replaced(c, " ")

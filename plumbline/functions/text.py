"""Text predicates and transforms as Column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text classes that profiles and checks agree on.
NON_PRINTING = r"[\x01-\x08\x0B\x0C\x0E-\x1F\x7F\u00A0\u200B\uFEFF]"
NUMERIC_LIKE = r"\s*[-+]?([0-9]+([.,][0-9]+)?|[.,][0-9]+)([eE][-+]?[0-9]+)?\s*"
DATE_LIKE = (
    r"\s*([0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?"
    r"(Z|[+-][0-9]{2}:?[0-9]{2})?)?|[0-9]{1,2}[./][0-9]{1,2}[./]([0-9]{4}|[0-9]{2}))\s*"
)
LEADING_ZERO = r"0[0-9]+"
BLANK_TOKENS = ("n/a", "na", "null", "none", "nil", "-", "--", "?", "unknown", "undefined", "#n/a")

# Every character Unicode counts as white space, for the checks that strip before they compare.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)
BULLET = "•"


def full_match(c: Column, pattern: str) -> Column:
    """Whole-string match. `$` would also match before a final line feed, so it is not used."""
    return c.rlike(rf"\A(?:{pattern})\z")


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind (SQL `trim` removes spaces only)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def is_blank(c: Column) -> Column:
    trimmed = F.trim(c)
    token = (F.char_length(trimmed) <= max(map(len, BLANK_TOKENS))) & F.lower(trimmed).isin(*BLANK_TOKENS)
    return full_match(c, r"\s*") | token


def has_outer_spaces(c: Column) -> Column:
    return c != F.trim(c)


def has_non_printing(c: Column) -> Column:
    return c.rlike(NON_PRINTING)


def is_numeric_like(c: Column) -> Column:
    return full_match(c, NUMERIC_LIKE)


def is_date_like(c: Column) -> Column:
    return full_match(c, DATE_LIKE)


def is_leading_zero_number(c: Column) -> Column:
    return full_match(c, LEADING_ZERO)


def pattern_class(c: Column) -> Column:
    """The shape of a value: letters as A, digits as 9, runs of five or more as `A{5+}` / `9{5+}`."""
    # ASCII goes through a character map; only the remaining letters need the regular expression.
    letters = string.ascii_letters.replace("A", "")
    ascii_done = F.translate(c, letters + "012345678", "A" * len(letters) + "9" * 9)
    shape = F.regexp_replace(ascii_done, r"[\p{L}&&[^A]]", "A")
    return F.regexp_replace(F.regexp_replace(shape, "A{5,}", "A{5+}"), "9{5,}", "9{5+}")


def mask(c: Column) -> Column:
    """Keep the first and last two characters; values of up to four characters vanish entirely."""
    n = F.char_length(c)
    middle = F.concat(F.substring(c, 1, 2), F.repeat(F.lit(BULLET), n - 4), F.substring(c, -2, 2))
    return F.when(n <= 4, F.repeat(F.lit(BULLET), n)).otherwise(middle)


def folded(c: Column) -> Column:
    """The form spelling variants of one value share."""
    return F.lower(strip(c))


def percentage(k: Column, n: Column) -> Column:
    """`k` of `n` as text: two decimals below one percent, one above."""
    v = F.lit(100.0) * k / n
    return (
        F.when(n == 0, F.lit("0 %"))
        .when(v < 1, F.format_string("%.2f %%", v))
        .otherwise(F.format_string("%.1f %%", v))
    )


def escape_like(text: str) -> str:
    """User text inside a LIKE pattern, with its wildcards taken literally."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")

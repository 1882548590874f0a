"""Scalar text functions as Column expressions (STRF1-6, STRF13-14, SRT3, UD1, UD3).

Everything here is a built-in Spark expression, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The export placeholder that is removed, the character classes kept by the
# cleaner (Latin and Cyrillic letters, optionally the colon, and the plain space), the token
# rule (runs of two or more letters after lower-casing) and Python's str.split() whitespace.
FILE_PLACEHOLDER = "(File not included. Change data exporting settings to download.)"
KEPT_WITH_COLON = "A-Za-zА-Яа-яЁё: "
KEPT_NO_COLON = "A-Za-zА-Яа-яЁё "
CLEAN_KEEP_COLON = f"[^{KEPT_WITH_COLON}]"
CLEAN_NO_COLON = f"[^{KEPT_NO_COLON}]"
TOKEN_RULE = "[a-zа-яё]{2,}"
PY_WHITESPACE = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                 r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+")
# The same whitespace set as characters (for btrim): tab, newline, vertical tab, form feed,
# carriage return, U+001C-U+001F, space, U+0085, U+00A0, U+1680, U+2000-U+200A, U+2028, U+2029,
# U+202F, U+205F, U+3000.
PY_WHITESPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                       "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                       "\u2028\u2029\u202f\u205f\u3000")


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def remove_placeholder(c) -> Column:
    """STRF1: drop the 'file not included' placeholder text."""
    return F.replace(col_(c), F.lit(FILE_PLACEHOLDER), F.lit(""))


def clean_text(c, keep_colon: bool = True) -> Column:
    """UD1 / STRF2-3: remove the placeholder, then delete every character outside the kept class.

    Characters are deleted, not replaced by spaces, so ``re-use`` becomes ``reuse``.
    """
    # Same string as deleting every character outside the class, but written as "keep the
    # runs inside the class": the negated-class replace is several times slower in the JVM.
    kept = KEPT_WITH_COLON if keep_colon else KEPT_NO_COLON
    return F.array_join(F.regexp_extract_all(remove_placeholder(c), F.lit(f"[{kept}]+"), 0), "")


def tokenize(c) -> Column:
    """STRF4: lower-case, then every run of two or more letters is a token (array<string>)."""
    return F.regexp_extract_all(F.lower(col_(c)), F.lit(TOKEN_RULE), 0)


def terms(c, keep_colon: bool = True) -> Column:
    """UD1 + STRF1-4 in one expression: the tokens of the cleaned, lower-cased text.

    Equal to ``tokenize(clean_text(c, keep_colon))``: after cleaning only letters, the space and
    (optionally) the colon remain, so the tokens are the pieces between spaces and colons with
    two or more letters. Splitting is cheaper than a second regex scan for letter runs.
    """
    return F.filter(F.split(F.lower(clean_text(c, keep_colon)), "[ :]+"), lambda x: F.length(x) >= 2)


def split_words(c) -> Column:
    """Whitespace split like Python's ``str.split()`` (no empty pieces)."""
    return F.filter(F.split(col_(c), PY_WHITESPACE), lambda x: x != "")


def words_count(c) -> Column:
    """UD3 / STRF5: number of whitespace-separated words; null text counts 0."""
    return F.coalesce(F.size(split_words(c)), F.lit(0)).cast("bigint")


def sorted_words(c) -> Column:
    """SRT3: words of a text sorted by code point and joined by one space."""
    return F.array_join(F.array_sort(split_words(c)), " ")


def newline_to_space(c) -> Column:
    """STRF6: every newline becomes a space."""
    return F.translate(col_(c), "\n", " ")


def preview(c, n: int = 20) -> Column:
    """STRF13: the first ``n`` characters."""
    return F.substring(col_(c), 1, n)


def name_or_default(c, default: str = "there") -> Column:
    """STRF14: a missing or empty name becomes ``default``."""
    return F.coalesce(F.nullif(col_(c), F.lit("")), F.lit(default))


#: Fixed form: the ISO date-times read by ``iso_datetime`` (date with or without hyphens; any sign between date and time; hours, or hours and
#: minutes, or seconds with a fraction; an offset). Longer fractions are cut to microseconds.
ISO_FORM = (r"^(\d{4})(?:-(\d{2})-(\d{2})|(\d{2})(\d{2}))"
            r"(?:[^\n](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,6})\d*)?)?)?(Z|z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)?)?\z")


def iso_datetime(c) -> Column:
    """DTF2: struct(at timestamp without zone, offset seconds or null) of an ISO date-time, null where the text is none or names no real time."""
    part = lambda k: F.regexp_extract(col_(c), ISO_FORM, k)
    number = lambda k: F.coalesce(F.nullif(part(k), F.lit("")).cast("int"), F.lit(0))
    month, day = (F.greatest(number(a), number(b)) for a, b in ((2, 4), (3, 5)))
    micros = F.rpad(part(9), 6, "0").cast("decimal(6,0)") / F.lit(1_000_000).cast("decimal(7,0)")
    seconds = (number(8) + F.coalesce(F.when(part(9) != "", micros), F.lit(0))).cast("decimal(16,6)")
    at = F.try_make_timestamp_ntz(F.nullif(part(1), F.lit("")).cast("int"), month, day, number(6), number(7), F.when(number(8) < 60, seconds))
    zone = F.regexp_replace(part(10), ":", "")
    piece = lambda k: F.coalesce(F.nullif(F.substring(zone, k, 2), F.lit("")).cast("int"), F.lit(0))
    offset = F.when(F.lower(part(10)) == "z", 0).when(part(10) != "", F.when(zone.startswith("-"), -1).otherwise(1) * (piece(2) * 3600 + piece(4) * 60 + piece(6)))
    return F.when(at.isNotNull() & (F.abs(F.coalesce(offset, F.lit(0))) < 86400), F.struct(at.alias("at"), offset.alias("offset")))

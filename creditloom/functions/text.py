"""String helpers: in-place edits, name keys, numbers in output lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a date, a version and a number in an output line.
DATE_PATTERN = r"\b20\d{6}(?:-\d{6})?\b"
VERSION_PATTERN = r"(?i)\bv\d+\.\d+\b"
NUMBER_PATTERN = r"(?<![A-Za-z_\d])-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?%?(?![A-Za-z_\d])"
DATE_MARK, VERSION_MARK, NUMBER_MARK = "__DATE__", "__VER__", "__NUM__"

LOWER = "abcdefghijklmnopqrstuvwxyz"


def inspect_replace(s: Column, old: str, new: str) -> Column:
    """Replace every occurrence of ``old``."""
    if len(old) == len(new) == 1:
        return F.translate(s, old, new)
    return F.replace(s, F.lit(old), F.lit(new))


def inspect_convert(s: Column, old: str, new: str) -> Column:
    """Map characters one to one."""
    return F.translate(s, old, new)


def inspect_tally(s: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a non-empty ``part``."""
    gone = F.length(s) - F.length(F.replace(s, part, F.lit("")))
    return F.call_function("div", gone, F.length(part)).cast("bigint")


def string_concat(width: int, *parts: Column) -> Column:
    """Concatenate and cut to the target width."""
    return F.substring(F.concat(*parts), 1, width)


def refmod(s: Column, start: int, length: int) -> Column:
    """``length`` characters from the 1-based ``start`` of a padded field."""
    return F.substring(F.rpad(s, start + length, " "), start, length)


def normalize_name(s: Column) -> Column:
    """Upper case; dots, commas and hyphens become spaces."""
    return F.translate(s, LOWER + ".,-", LOWER.upper() + "   ")


def strip(s: Column) -> Column:
    """Trim every kind of white space on both sides."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def mask_labels(line: Column) -> Column:
    """Hide dates and version labels, which are not values."""
    return F.regexp_replace(F.regexp_replace(line, DATE_PATTERN, DATE_MARK), VERSION_PATTERN, VERSION_MARK)


def extract_numbers(line: Column) -> Column:
    """Numbers of a line in plain notation, without dates and versions, exact at any size and scale.

    Leading zeros, zeros that end a fraction, grouping commas, percent signs and the sign of zero are taken off, so
    equal numbers are equal texts.
    """
    found = F.regexp_extract_all(mask_labels(line), F.lit(NUMBER_PATTERN), F.lit(0))
    bare = lambda t: F.regexp_replace(F.translate(t, ",%", ""), r"^(-?)0+(?=\d)", "$1")
    short = lambda t: F.regexp_replace(F.regexp_replace(bare(t), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.transform(found, lambda t: F.regexp_replace(short(t), r"^-0$", "0"))


def line_skeleton(line: Column) -> Column:
    """The line with dates, versions and numbers replaced by placeholders."""
    return strip(F.regexp_replace(mask_labels(line), NUMBER_PATTERN, NUMBER_MARK))


def without_dates(line: Column) -> Column:
    return strip(F.regexp_replace(line, DATE_PATTERN, DATE_MARK))


def cosmetic(line: Column) -> Column:
    """Collapse white space and upper-case version labels."""
    s = F.regexp_replace(strip(line), r"\s+", " ")
    return F.regexp_replace(s, r"\bv(\d+\.\d+)\b", "V$1")


def within_tolerance(a: Column, b: Column, pct: Column) -> Column:
    """Same count, and each pair of ``extract_numbers`` differs by at most ``pct`` of the larger one.

    Equality is exact at any size.  Shares are exact for numbers of up to 18 digits before and 9 behind the point, and
    of double precision beyond.
    """
    exact = lambda x: F.when(F.regexp_like(x, F.lit(r"^-?\d{1,18}(\.\d{1,9})?$")), x.try_cast("decimal(27,9)"))
    share = pct.try_cast("decimal(9,8)")
    share = F.when(share.cast("double") == pct, share)

    def close(x: Column, y: Column) -> Column:
        p, q = exact(x), exact(y)
        whole = F.abs(p - q) <= share * F.greatest(F.abs(p), F.abs(q), F.lit("0.000000001").cast("decimal(27,9)"))
        u, v = x.cast("double"), y.cast("double")
        rough = F.abs(u - v) <= pct * F.greatest(F.abs(u), F.abs(v), F.lit(1e-9))
        return F.when(p.isNotNull() & q.isNotNull() & share.isNotNull(), whole).otherwise(rough)

    near = F.zip_with(a, b, lambda x, y: (x == y) | ((pct > 0) & close(x, y)))
    return (F.size(a) == F.size(b)) & F.forall(near, lambda ok: F.coalesce(ok, F.lit(False)))


def source_hash(s: Column) -> Column:
    """First 16 hex digits of the sha-256."""
    return F.substring(F.sha2(s, 256), 1, 16)


def apply_replacing(s: Column, pairs: list[tuple[str, str]]) -> Column:
    """Word-boundary substitution of fixed pairs, case-insensitive."""
    for old, new in pairs:
        s = F.regexp_replace(s, replacing_pattern(F.lit(old)), F.lit(new))
    return s


def replacing_pattern(old: Column) -> Column:
    """The regular expression for one replaced word; prefixes end in a hyphen."""
    quoted = F.concat(F.lit("\\Q"), old, F.lit("\\E"))
    return F.when(
        old.endswith("-"), F.concat(F.lit("(?i)(?<![A-Z0-9-])"), quoted, F.lit("(?![A-Z0-9-])"))
    ).otherwise(F.concat(F.lit(r"(?i)\b"), quoted, F.lit(r"\b")))


def condition_threshold(condition: Column) -> Column:
    """First number after a comparison sign, else the first number."""
    tries = [r">\s*(\d+)", r">=\s*(\d+)", r"<\s*(\d+)", r"<=\s*(\d+)", r"=\s*(\d+)", r"\b(\d+)\b"]
    return F.coalesce(*[F.regexp_extract(condition, p, 1).try_cast("bigint") for p in tries])


def boundary_rule(rule: Column) -> tuple[Column, Column, Column]:
    """(kind, threshold, values as text) of a rule sentence."""
    low = F.lower(rule)

    def first(pattern: str, text: Column) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("bigint")

    any_num = first(r"\b(\d+)\b", rule)
    cap = first(r"(?:capacity|limited\s+to|limit\s+of)\s*(\d+)", low)
    below = first(r"(?:<\s*|under\s+|below\s+)(\d+)", low)
    above = first(r"(?:>\s*|exceeds\s+|above\s+)(\d+)", low)
    overtime = low.contains("overtime") | low.rlike(r"\b1\.5\s*x\b|1\.5x|1,5\s*x")
    confirm = low.rlike(r"confirmation|requires?\s+y|confirm.*\by\b")
    is_cap = cap.isNotNull() | (low.contains("capacity") & any_num.isNotNull())
    is_below = below.isNotNull() | (rule.contains("<") & any_num.isNotNull())
    is_above = above.isNotNull() | (rule.contains(">") & any_num.isNotNull())
    kind = (
        F.when(overtime, "overtime").when(confirm, "confirmation").when(is_cap, "capacity")
        .when(is_below, "threshold_below").when(is_above, "threshold_above")
        .when(any_num.isNotNull(), "generic_numeric").otherwise("generic")
    )
    n = (
        F.when(overtime, F.lit(40)).when(confirm, F.lit(None).cast("bigint")).when(is_cap, F.coalesce(cap, any_num))
        .when(is_below, F.coalesce(below, any_num)).when(is_above, F.coalesce(above, any_num)).otherwise(any_num)
    ).cast("bigint")
    values = (
        F.when(overtime, "40,41").when(confirm, "Y,N,X").when(n.isNull(), "0,1")
        .otherwise(F.concat_ws(",", (n - 1).cast("string"), n.cast("string"), (n + 1).cast("string")))
    )
    return kind, n, values


def reliability_badge(score: Column) -> Column:
    s = F.round(score)
    return (
        F.when(score.isNull() | F.isnan(score.cast("double")) | (s <= 0), "Not Run")
        .when(s >= 85, "Passed").when(s >= 55, "Needs Review").otherwise("Failed")
    )


def tokens_of(text: Column) -> Column:
    """Model tokens estimated as a quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / F.lit(4)).cast("bigint")

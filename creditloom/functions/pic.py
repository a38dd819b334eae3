"""Fixed-point storage rules as Catalyst expressions.

Money and rates travel as BIGINT minor units.  A value "at scale s" is the
number times ten to the power s.  Nothing here leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LITERAL = "literal"
CLEAN = "clean"
_LONG_MAX = 2**63 - 1


def check_mode(mode: str) -> str:
    if mode not in (LITERAL, CLEAN):
        raise ValueError(f"mode must be '{LITERAL}' or '{CLEAN}', not {mode!r}")
    return mode


def idiv(a: Column, b: Column | int) -> Column:
    """Integer division, truncating toward zero, BIGINT result."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a, b).cast("bigint")


def rescale(x: Column, from_scale: int, to_scale: int, rounded: bool = False) -> Column:
    """Move between scales; dropping digits truncates unless ``rounded``."""
    if to_scale >= from_scale:
        return (x * F.lit(10 ** (to_scale - from_scale))).cast("bigint")
    step = 10 ** (from_scale - to_scale)
    if not rounded:
        return idiv(x, step)
    return (F.signum(x).cast("bigint") * idiv(F.abs(x) + F.lit(step // 2), step)).cast("bigint")


def store(
    x: Column, from_scale: int, digits: int, scale: int, rounded: bool = False, signed: bool = False
) -> Column:
    """Store into a field of ``digits`` integer and ``scale`` decimal digits.

    Low-order digits are truncated (or rounded half away from zero), high-order
    digits are dropped, and an unsigned field loses the sign.
    """
    v = rescale(x, from_scale, scale, rounded) % F.lit(10 ** (digits + scale))
    return v.cast("bigint") if signed else F.abs(v).cast("bigint")


def ratio(a: Column, b: Column, k: int) -> Column:
    """``round_half_up(a / b, k)`` at scale k for a >= 0 and b > 0.

    Plain BIGINT arithmetic while the numerator fits, DECIMAL(38,0) above that.
    """
    limit = _LONG_MAX // (4 * 10**k)
    narrow = idiv(F.lit(2 * 10**k) * a + b, F.lit(2) * b)
    wide = F.call_function(
        "div",
        a.cast("decimal(24,0)") * F.lit(2 * 10**k).cast("decimal(12,0)") + b.cast("decimal(24,0)"),
        b.cast("decimal(24,0)") * F.lit(2).cast("decimal(2,0)"),
    ).cast("bigint")
    return F.when((a < F.lit(limit)) & (b < F.lit(limit)), narrow).otherwise(wide)


def percent_of(amount: Column, rate: Column | int, rate_scale: int) -> Column:
    """``amount * rate / 100`` rounded half up; rate is a percentage at ``rate_scale``."""
    rate = F.lit(rate) if isinstance(rate, int) else rate
    step = 10 ** (rate_scale + 2)
    return idiv(F.lit(2) * amount * rate + F.lit(step), 2 * step)


def band(x: Column, steps: list[tuple[int, object]], other: object, op: str = ">=") -> Column:
    """First matching step wins: the points of an ordered threshold list."""
    out = None
    for edge, points in steps:
        test = x >= F.lit(edge) if op == ">=" else x <= F.lit(edge)
        out = F.when(test, F.lit(points)) if out is None else out.when(test, F.lit(points))
    return out.otherwise(F.lit(other))


def clamp(x: Column, low: int | None = None, high: int | None = None) -> Column:
    """Bound x; a missing bound is open, NULL stays NULL."""
    out = None
    if low is not None:
        out = F.when(x < low, F.lit(low).cast("bigint"))
    if high is not None:
        top = F.lit(high).cast("bigint")
        out = F.when(x > high, top) if out is None else out.when(x > high, top)
    return x if out is None else out.otherwise(x)


def implied_decimal(text: Column) -> Column:
    """Digits of a display field as minor units; blanks count as zero."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")).cast("bigint"), F.lit(0).cast("bigint"))


def as_decimal(minor: Column, digits: int, scale: int) -> Column:
    """Minor units to DECIMAL for callers outside the jobs."""
    return (minor.cast(f"decimal({digits + scale},0)") / F.lit(10**scale)).cast(f"decimal({digits + scale},{scale})")


def zoned(x: Column, width: int) -> Column:
    """Zero-padded unsigned digits, high-order digits dropped."""
    return F.lpad((F.abs(x) % F.lit(10**width)).cast("string"), width, "0")


def unpack_comp3(raw: Column, signed: bool = True) -> Column:
    """Packed decimal bytes to BIGINT minor units."""
    h = F.hex(raw)
    digits = F.substring(h, F.lit(1), F.length(h) - 1)
    value = digits.cast("bigint")
    sign = F.substring(h, F.length(h), F.lit(1))
    return F.when(sign.isin("D", "B"), -value).otherwise(value) if signed else value


def pack_comp3(x: Column, digits: int) -> Column:
    """BIGINT minor units to packed decimal bytes of ``digits // 2 + 1``."""
    width = digits if digits % 2 == 1 else digits + 1
    return F.unhex(F.concat(zoned(x, width), F.when(x < 0, F.lit("D")).otherwise(F.lit("C"))))


def group_thousands(digits: Column, sep: str = ",") -> Column:
    """``1234567`` to ``1,234,567``."""
    return F.regexp_replace(digits, r"(?<=\d)(?=(\d{3})+$)", sep)


def edited(
    x: Column, scale: int, int_width: int, dec_width: int = 0, point: str = ".", grouped: bool = False,
    min_int: int = 1,
) -> Column:
    """Zero-suppressed numeric-edit text.

    ``int_width`` counts the printed integer positions (separators included
    when ``grouped``); ``min_int`` digits are always printed.
    """
    v = F.abs(rescale(x, scale, dec_width))
    text = v.cast("string")
    whole_digits = idiv(v, 10**dec_width)
    whole = whole_digits.cast("string")
    if min_int == 0:
        whole = F.when(whole_digits == 0, F.lit("")).otherwise(whole)
    elif min_int > 1:
        whole = F.lpad(whole, F.greatest(F.length(whole), F.lit(min_int)), F.lit("0"))
    if grouped:
        whole = group_thousands(whole)
    # Digits beyond the field are dropped first; zeros that then lead are suppressed as any others.
    kept = F.regexp_replace(F.right(whole, F.lit(int_width)), rf"^[0,]+(?=(?:\d,?){{{min_int}}})", "")
    whole = F.lpad(F.when(F.length(whole) > int_width, kept).otherwise(whole), int_width, " ")
    if dec_width == 0:
        return whole
    return F.concat(whole, F.lit(point), F.right(F.lpad(text, F.greatest(F.length(text), F.lit(dec_width)), F.lit("0")), F.lit(dec_width)))


def years_between_yyyymmdd(later: Column, earlier: Column) -> Column:
    """Whole years from two YYYYMMDD numbers by plain subtraction."""
    return idiv(later - earlier, 10000)


def add_days(day: Column, n: Column | int, mode: str = LITERAL) -> Column:
    """Literal: add n to the YYYYMMDD number.  Clean: real calendar addition."""
    n = F.lit(n) if isinstance(n, int) else n
    if check_mode(mode) == LITERAL:
        return (day + n).cast("bigint")
    moved = F.date_add(F.to_date(day.cast("string"), "yyyyMMdd"), n.cast("int"))
    return F.date_format(moved, "yyyyMMdd").cast("bigint")


def celsius_to_fahrenheit(centi: Column) -> Column:
    """Hundredths of a degree C to hundredths of a degree F, truncated."""
    return (idiv(centi * F.lit(9), 5) + F.lit(3200)).cast("bigint")

"""Column expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def fixed(col: Column | str, digits: int = 6) -> Column:
    """Round to ``digits`` places for comparing results across engines.

    The offset sits slightly off one half, so that values lying exactly on a
    decimal tie do not flip with the order in which a sum was taken.
    """
    scale = float(10**digits)
    return F.floor(_c(col) * F.lit(scale) + F.lit(0.500123)) / F.lit(scale)


def finite(col: Column | str) -> Column:
    """True for a value that is neither NULL, NaN nor infinite."""
    c = _c(col)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def nan_to_null(col: Column | str) -> Column:
    """NaN and infinities become NULL, so that aggregates skip them."""
    return F.when(finite(col), _c(col))


def safe_div(num: Column | str, den: Column | str) -> Column:
    """Division that gives NULL for a zero denominator."""
    d = _c(den).cast("double")
    return _c(num).cast("double") / F.when(d != 0, d)


def clean_name(col: Column | str) -> Column:
    """Trimmed upper-case feature name; blanks and the text NAN become NULL."""
    name = F.upper(F.trim(_c(col)))
    return F.when(~name.isin("", "NAN"), name)


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation as an aggregate; NULL when a side does not vary (``corr`` fails there in ANSI mode)."""
    a, b = _c(x), _c(y)
    return F.covar_pop(a, b) / F.nullif(F.sqrt(F.var_pop(a) * F.var_pop(b)), F.lit(0.0))


def strip_copy_suffix(col: Column | str) -> Column:
    """Key for id matching: drop a trailing ``-digits``, fold case, squash other marks to ``_``."""
    base = F.lower(F.regexp_replace(F.trim(_c(col)), r"-[0-9]+$", ""))
    return F.regexp_replace(base, r"[^a-z0-9]+", "_")


def draw_key(seed: int | str, *keys: Column | str) -> Column:
    """Hex text that orders rows in a repeatable pseudo-random way."""
    parts = [F.lit(str(seed))] + [_c(k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts))


def draw_unit(hex_text: Column) -> Column:
    """First 52 bits of a hex digest as a double in [0, 1)."""
    return F.conv(F.substring(hex_text, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def sort_prefix(col: Column | str) -> Column:
    """Number that never decreases in the byte order of a text; used to bucket text keys."""
    digits = F.rpad(F.substring(F.hex(F.encode(_c(col), "UTF-8")), 1, 12), 12, "0")
    return F.conv(digits, 16, 10).cast("double")

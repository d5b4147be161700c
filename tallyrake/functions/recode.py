"""Column expressions for cleaning, recoding and calendar bucketing.

Everything here is a built-in Catalyst expression (no UDF), so it stays inside
whole-stage codegen and is pushed/pruned like any other projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyrake.sources.census import GBA_MUNICIPALITIES

# Education prefixes in match order, and the exact-value replacement.
EDUCATION_PREFIXES = ["prim", "sec", "terc", "univ", "pos"]
EDUCATION_REPLACE = {"sin estudios": "prim"}
# Accepted sex labels (matched exactly, before trim/lower).
SEX_WHITELIST = ["femenino", "masculino"]
# Right-closed age bins (15,29] (29,44] (44,59] (59,120] and labels.
AGE_BINS = [(15.0, 29.0, "16-29"), (29.0, 44.0, "30-44"), (44.0, 59.0, "45-59"), (59.0, 120.0, "60+")]
# Fixed value: level used for a missing calibration value once cast to text.
MISSING_LEVEL = "nan"
# Fixed value: fill for a missing household size.
UNKNOWN_HOUSEHOLD = "Desconocido"


def clean_header(name: str) -> str:
    """Strip, lower, spaces to underscores (only the space character)."""
    return name.strip().lower().replace(" ", "_")


# White space of any kind, as a text's strip removes it at both ends.
_SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                            0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip_text(c: Column) -> Column:
    """Without white space at both ends (tabs, line ends, no-break spaces too).  A text that begins
    and ends with a visible ASCII character is left as it is; a pattern, tried at every position of
    every text, or a search of the list for every text took most of a pass's time."""
    whole = F.ascii(c).between(33, 126) & F.ascii(F.substring(c, -1, 1)).between(33, 126)
    return F.when(whole, c).otherwise(F.btrim(c, F.lit(_SPACES)))


def norm_text(c: Column | str) -> Column:
    """Stripped and lower-cased; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(strip_text(c))


def education_level(c: Column | str) -> Column:
    """trim+lower, exact ``sin estudios`` -> ``prim``, first matching prefix."""
    return education_of_normed(norm_text(F.col(c) if isinstance(c, str) else c))


def education_of_normed(x: Column) -> Column:
    """F6, F7 of a text that is stripped and lower-cased already (it is read once per prefix)."""
    for src, dst in EDUCATION_REPLACE.items():
        x = F.when(x == F.lit(src), F.lit(dst)).otherwise(x)
    out = None
    for p in EDUCATION_PREFIXES:
        cond = x.startswith(p)
        out = F.when(cond, F.lit(p)) if out is None else out.when(cond, F.lit(p))
    return out.otherwise(x)


def age_bin(c: Column | str) -> Column:
    """right-closed bins; outside (15, 120] or null -> null."""
    x = F.col(c) if isinstance(c, str) else c
    out = None
    for lo, hi, label in AGE_BINS:
        cond = (x > F.lit(lo)) & (x <= F.lit(hi))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def sex_whitelisted(c: Column | str) -> Column:
    """keep the value only if it is exactly one of the whitelist, else null."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x.isin(SEX_WHITELIST), x)


def is_gba_municipality(c: Column | str) -> Column:
    """J2 as an expression: membership in the fixed 39-name set (an ``In`` set)."""
    x = F.col(c) if isinstance(c, str) else c
    return norm_text(x).isin(GBA_MUNICIPALITIES)


def gba_zone(c: Column | str) -> Column:
    """``gba`` for a GBA municipality, else ``interior`` (null too)."""
    return F.when(is_gba_municipality(c), F.lit("gba")).otherwise(F.lit("interior"))


def as_level(c: Column | str) -> Column:
    """calibration variable as text, null -> ``'nan'``."""
    x = F.col(c) if isinstance(c, str) else c
    return F.coalesce(x.cast("string"), F.lit(MISSING_LEVEL))


def window_start(ts: Column | str, unit: str) -> Column:
    """Bucket start as a date. ``unit`` in day / week (Monday) / month."""
    x = F.col(ts) if isinstance(ts, str) else ts
    unit = {"d": "day", "s": "week", "w": "week", "m": "month"}.get(unit, unit)
    if unit not in ("day", "week", "month"):
        raise ValueError(f"unknown window unit {unit!r}")
    return F.date_trunc(unit, x).cast("date")


def window_label(start: Column | str, unit: str) -> Column:
    """Text label: ``2024-01-01`` (day), ``2024-01-01/2024-01-07`` (week), ``2024-01`` (month)."""
    s = F.col(start) if isinstance(start, str) else start
    unit = {"d": "day", "s": "week", "w": "week", "m": "month"}.get(unit, unit)
    if unit == "day":
        return F.date_format(s, "yyyy-MM-dd")
    if unit == "week":
        return F.concat_ws("/", F.date_format(s, "yyyy-MM-dd"), F.date_format(F.date_add(s, 6), "yyyy-MM-dd"))
    if unit == "month":
        return F.date_format(s, "yyyy-MM")
    raise ValueError(f"unknown window unit {unit!r}")


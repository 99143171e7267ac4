"""Scalar helpers: GUID codec, durations, natural order, unit scales, geodesy and angles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the alphabet of the 22-character GUID.
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_$"


def expand_text(g: str | None) -> str | None:
    """32 hex digits of a 22-character GUID; null if it is none."""
    if g is None or len(g) != 22 or any(c not in ALPHABET for c in g) or ALPHABET.index(g[0]) > 3:
        return None
    n = 0
    for c in g:
        n = n * 64 + ALPHABET.index(c)
    return f"{n:032x}"


def compress_text(h: str | None) -> str | None:
    """22 characters of 32 hex digits (dashes allowed); null if it is none."""
    try:
        n = int((h or "").replace("-", ""), 16)
    except ValueError:
        return None
    if len((h or "").replace("-", "")) != 32:
        return None
    out = ""
    for _ in range(22):
        n, k = divmod(n, 64)
        out = ALPHABET[k] + out
    return out


def guid_expand(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(expand_text)

    return run(c)


def guid_compress(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(compress_text)

    return run(c)


def is_guid(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-3][0-9A-Za-z_$]{21}$"), F.lit(False))


def parse_duration(c: Column) -> Column:
    """struct(months, days, seconds) of an ISO 8601 duration; null if it is none."""
    p = "^P(?:(\\d+)Y)?(?:(\\d+)M)?(?:(\\d+)W)?(?:(\\d+)D)?(?:T(?:(\\d+)H)?(?:(\\d+)M)?(?:(\\d+(?:\\.\\d+)?)S)?)?$"
    part = lambda i: F.coalesce(F.regexp_extract(c, p, i).try_cast("double"), F.lit(0.0))
    return F.when(
        c.rlike(p) & (F.length(c) > 1),
        F.struct((part(1) * 12 + part(2)).cast("int").alias("months"), (part(3) * 7 + part(4)).cast("int").alias("days"), (part(5) * 3600 + part(6) * 60 + part(7)).alias("seconds")),
    )


def natural_key(c: Column) -> Column:
    """Sort key in natural order: digit runs as numbers, text without case."""
    runs = F.regexp_extract_all(F.lower(c), F.lit("(\\d+|\\D+)"), F.lit(1))
    return F.transform(runs, lambda r: F.when(r.rlike("^\\d"), F.concat(F.lit("0"), F.lpad(r, 24, "0"))).otherwise(F.concat(F.lit("1"), r)))


#: Prefixes and base units.
PREFIXES = {"": 1.0, "MILLI": 1e-3, "CENTI": 1e-2, "DECI": 1e-1, "KILO": 1e3, "MEGA": 1e6, "GIGA": 1e9, "MICRO": 1e-6}
CONVERSIONS = {"inch": 0.0254, "foot": 0.3048, "yard": 0.9144, "mile": 1609.344, "square inch": 0.0254**2, "square foot": 0.3048**2, "cubic foot": 0.3048**3, "pound": 0.45359237}


def unit_scale(prefix: str, name: str, exponent: int = 1) -> float:
    """Factor to the SI unit; a prefix is raised to the length exponent of square and cubic metres."""
    if name.lower() in CONVERSIONS:
        return CONVERSIONS[name.lower()]
    power = {"SQUARE_METRE": 2, "CUBIC_METRE": 3}.get(name.upper(), exponent)
    return PREFIXES[prefix.upper()] ** power


def convert(c: Column, from_scale: float, to_scale: float) -> Column:
    return c * F.lit(from_scale) / F.lit(to_scale)


def xyz2enh(x: Column, y: Column, z: Column, eastings: float, northings: float, height: float, abscissa: float, ordinate: float, scale: float = 1.0) -> tuple[Column, Column, Column]:
    """Local to map coordinates: rotation by the map's x axis, scale, shift."""
    n = (abscissa**2 + ordinate**2) ** 0.5
    cos, sin = abscissa / n, ordinate / n
    return (
        scale * (x * cos - y * sin) + eastings,
        scale * (x * sin + y * cos) + northings,
        scale * z + height,
    )


def enh2xyz(e: Column, n: Column, h: Column, eastings: float, northings: float, height: float, abscissa: float, ordinate: float, scale: float = 1.0) -> tuple[Column, Column, Column]:
    norm = (abscissa**2 + ordinate**2) ** 0.5
    cos, sin = abscissa / norm, ordinate / norm
    dx, dy = (e - eastings) / scale, (n - northings) / scale
    return dx * cos + dy * sin, -dx * sin + dy * cos, (h - height) / scale


def dd2dms(c: Column) -> Column:
    """struct(degrees, minutes, seconds, millionths) with one sign for all parts."""
    sign = F.when(c < 0, -1).otherwise(1)
    micro = F.round(F.abs(c) * 3600 * 1_000_000).cast("bigint")
    total = F.floor(micro / 1_000_000)
    return F.struct(
        (sign * F.floor(total / 3600)).cast("int").alias("d"), (sign * F.floor((total % 3600) / 60)).cast("int").alias("m"),
        (sign * (total % 60)).cast("int").alias("s"), (sign * (micro % 1_000_000)).cast("int").alias("u"),
    )


def dms2dd(d: Column, m: Column, s: Column, u: Column) -> Column:
    return d + m / 60 + s / 3600 + u / 3_600_000_000


def angle2xaxis(degrees: Column) -> tuple[Column, Column]:
    return F.cos(F.radians(degrees)), F.sin(F.radians(degrees))


def xaxis2angle(x: Column, y: Column) -> Column:
    return F.degrees(F.atan2(y, x))


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees from north, clockwise, from 0 to below 360."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def station_text(c: Column) -> Column:
    """Distance along a line as ``km+metres`` text, such as ``1+234.500``."""
    whole = F.floor(c / 1000)
    return F.concat(whole.cast("string"), F.lit("+"), F.format_string("%07.3f", c - whole * 1000))

"""The format language: ``upper(concat(...))``, ``round(x, 5)``, arithmetic and ``{{path}}``, compiled to Columns.

A format text is parsed on the driver into an expression over columns; nothing is evaluated row by row in Python except
``imperial_length``, which goes through Arrow.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def to_double(c: Column) -> Column:
    return c.try_cast("double")


def as_text(c: Column) -> Column:
    """Text of a value as in a report: whole numbers without decimals, null as ``None``."""
    return F.coalesce(F.regexp_replace(c.cast("string"), "^(-?\\d+)\\.0$", "$1"), F.lit("None"))


def fmt_add(a: Column, b: Column) -> Column:
    """Sum if both are numbers (``None`` counts as 0), else the texts joined; whole sums print without decimals."""
    zero = lambda c: F.when(c.isNull() | (c.cast("string") == "None"), 0.0).otherwise(to_double(c.cast("string")))
    total = zero(a) + zero(b)
    return F.coalesce(F.when(total.isNotNull(), as_text(total)), F.concat(as_text(a), as_text(b)))


def fmt_sub(a: Column, b: Column) -> Column:
    return as_text(to_double(a.cast("string")) - to_double(b.cast("string")))


def fmt_mul(a: Column, b: Column) -> Column:
    return as_text(to_double(a.cast("string")) * to_double(b.cast("string")))


def fmt_div(a: Column, b: Column) -> Column:
    """Division by zero gives the text ``inf``; a missing divisor counts as 1."""
    d = F.coalesce(to_double(b.cast("string")), F.lit(1.0))
    return F.when(d == 0, "inf").otherwise(as_text(F.try_divide(to_double(a.cast("string")), d)))


def fmt_round(c: Column, nearest: float) -> Column:
    """To the nearest multiple, halves to even; text that is no number passes through."""
    n = to_double(c.cast("string"))
    scaled = F.bround(n.cast("decimal(38,12)") / F.lit(str(nearest)).cast("decimal(18,9)"), 0) * F.lit(str(nearest)).cast("decimal(18,9)")
    return F.when(n.isNotNull(), as_text(scaled.cast("double"))).otherwise(c.cast("string"))


def fmt_number(c: Column, decimal: str = "", thousands: str = "") -> Column:
    """All decimals the value has; grouped by commas, or by ``thousands``; with a ``decimal`` sign alone there are no groups.

    Text that is no number gives null.
    """
    t = F.trim(c.cast("string"))
    n = to_double(t)
    real = n.cast("string")
    real = F.when(real.contains("E"), F.regexp_replace(F.coalesce(n.try_cast("decimal(38,12)").cast("string"), real), "(\\.\\d+?)0+$", "$1")).otherwise(real)
    plain = F.when(n.isNull(), None).when(t.rlike("[.eE]"), real).otherwise(t)
    if decimal and not thousands:
        return F.replace(plain, F.lit("."), F.lit(decimal))
    whole, rest = F.regexp_extract(plain, "^([^.]*)", 1), F.regexp_extract(plain, "(\\..*)$", 1)
    groups = F.regexp_replace(whole, "(\\d)(?=(?:\\d{3})+$)", "$1\x01")
    return F.concat(F.replace(groups, F.lit("\x01"), F.lit(thousands or ",")), F.replace(rest, F.lit("."), F.lit(decimal or ".")))


def fmt_int(c: Column) -> Column:
    return F.coalesce(to_double(c.cast("string")), F.lit(0.0)).cast("bigint")


def fmt_metric_length(c: Column, precision: float, places: int) -> Column:
    """Snapped to the precision, with a fixed number of decimals."""
    n = to_double(c.cast("string"))
    return F.format_string(f"%.{places}f", F.bround(n / precision, 0) * precision)


def imperial_text(value: float | None, precision: int = 1, input_unit: str = "foot", output_unit: str = "foot", suppress_zero_inches: bool = True) -> str | None:
    """Feet, inches and a fraction of 1/precision inch, such as ``5' - 3 1/2"``."""
    if value is None or value != value:
        return None
    inches = Fraction(round(Fraction(value) * (12 if input_unit == "foot" else 1) * precision), precision)
    sign = "-" if inches < 0 else ""
    feet, rest = divmod(abs(inches), 12) if output_unit == "foot" else (0, abs(inches))
    whole, part = divmod(rest, 1)
    text = f"{whole} {part.numerator}/{part.denominator}" if part else f"{whole}"
    if output_unit != "foot":
        return f'{sign}{text}"'
    if suppress_zero_inches and not rest:
        return f"{sign}{feet}'"
    return f'{sign}{feet}\' - {text}"'


def fmt_imperial_length(c: Column, precision: int = 1, input_unit: str = "foot", output_unit: str = "foot", suppress_zero_inches: bool = True) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: imperial_text(v, precision, input_unit, output_unit, suppress_zero_inches))

    return run(to_double(c.cast("string")))


def fmt_lower(c: Column) -> Column:
    return F.lower(as_text(c))


def fmt_upper(c: Column) -> Column:
    return F.upper(as_text(c))


def fmt_title(c: Column) -> Column:
    """Every run of letters starts with a capital, also after digits and signs."""
    parts = F.regexp_extract_all(F.lower(as_text(c)), F.lit("([\\p{L}]+|[^\\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "")


def fmt_concat(*cs: Column) -> Column:
    return F.concat(*[as_text(c) for c in cs])


def fmt_substr(c: Column, start: int, end: int | None = None) -> Column:
    """Slice from ``start`` to before ``end``; negative numbers count from the end."""
    t = as_text(c)
    n = F.length(t)
    a = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    b = n if end is None else F.lit(end) if end >= 0 else n + end
    return F.when(b > a, F.substr(t, a + 1, b - a)).otherwise("")


def fmt_sort(c: Column) -> Column:
    return F.array_sort(c)


def fmt_reverse(c: Column) -> Column:
    return F.reverse(c)


def fmt_join(separator: str, c: Column) -> Column:
    return F.array_join(F.transform(c, as_text), separator)


_LEX = re.compile(r"""\s*(?:(\{\{.*?\}\})|("(?:\\.|[^"\\])*")|(\d+(?:\.\d+)?)|([A-Za-z_]\w*)|(.))""", re.S)
_FUNCTIONS: dict[str, Callable] = {
    "lower": fmt_lower, "upper": fmt_upper, "title": fmt_title, "concat": fmt_concat, "round": fmt_round, "number": fmt_number,
    "int": fmt_int, "metric_length": fmt_metric_length, "imperial_length": fmt_imperial_length, "substr": fmt_substr,
    "sort": fmt_sort, "reverse": fmt_reverse, "join": fmt_join,
}
_RAW = {"round": {1}, "number": {1, 2}, "metric_length": {1, 2}, "imperial_length": {1, 2, 3, 4}, "substr": {1, 2}, "join": {0}}


def compile_format(text: str, resolve: Callable[[str], Column]) -> Column:
    """Column of a format text; ``resolve`` gives the column of a ``{{path}}``."""
    tokens = [next((k, g) for k, g in enumerate(m.groups()) if g is not None) for m in _LEX.finditer(text.strip())]
    at = 0

    def peek() -> tuple[int, str]:
        return tokens[at] if at < len(tokens) else (-1, "")

    def take(expected: str | None = None) -> tuple[int, str]:
        nonlocal at
        k = peek()
        if expected is not None and k[1] != expected:
            raise ValueError(f"expected {expected!r} in the format {text!r}")
        at += 1
        return k

    def atom(raw: bool = False):
        kind, t = take()
        if kind == 4 and t == "-" and peek()[0] == 2:
            kind, t = 2, "-" + take()[1]
        if kind == 0:
            return resolve(t[2:-2].strip())
        if kind == 1:
            value = re.sub(r"\\(.)", r"\1", t[1:-1])
            return value if raw else F.lit(value)
        if kind == 2:
            value = float(t) if "." in t else int(t)
            return value if raw else F.lit(value)
        if kind == 3 and t.lower() in ("true", "false"):
            return t.lower() == "true" if raw else F.lit(t.lower() == "true")
        if kind == 3 and t in _FUNCTIONS:
            take("(")
            args = []
            while peek()[1] != ")":
                is_raw = len(args) in _RAW.get(t, ())
                args.append(atom(True) if is_raw else expression())
                if peek()[1] == ",":
                    take()
            take(")")
            return _FUNCTIONS[t](*args)
        if t == "(":
            e = expression()
            take(")")
            return e
        raise ValueError(f"unexpected {t!r} in the format {text!r}")

    def product():
        e = atom()
        while peek()[1] in ("*", "/"):
            e = (fmt_mul if take()[1] == "*" else fmt_div)(e, atom())
        return e

    def expression():
        e = product()
        while peek()[1] in ("+", "-"):
            e = (fmt_add if take()[1] == "+" else fmt_sub)(e, product())
        return e

    result = expression()
    if at != len(tokens):
        raise ValueError(f"text after the end of the format {text!r}")
    return result

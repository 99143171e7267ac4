"""Shared readers of dirty text values, as Catalyst expressions (no Python in the row path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks that exports use besides the plain one.
BLANKS = "[\\u00a0\\u2007\\u2009\\u202f\\u200b\\ufeff\\s]"

#: Words and signs that say no value is given (compared in lower case, after trimming).
EMPTY_MARKERS = [
    "", "-", "--", "---", "–", "—", "$", "*", "?", ".", "/", "null", "none", "nil", "nan", "n/a", "na", "n.a.", "n.a",
    "k.a.", "k.a", "ka", "keine angabe", "o.a.", "unset", "not set", "notset", "undefined", "notdefined", "not defined",
    "not_defined", "unknown", "notknown", "not known", "not given", "unbekannt", "nicht definiert", "non défini",
    "inconnu", "s/o", "sans objet", "tbd", "tbc", "empty", "leer", "void", "#n/a", "(null)", "<null>",
]

#: A number at the start of a text: blank or apostrophe groups, mixed separators, plain, and an exponent.
NUMBER = (
    "[+-]?(?:"
    "\\d{1,3}(?:[ '’]\\d{3})+(?!\\d)(?:[.,]\\d+)?"
    "|\\d{1,3}(?:,\\d{3})+\\.\\d+|\\d{1,3}(?:\\.\\d{3})+,\\d+"
    "|\\d{1,3}(?:,\\d{3}){2,}(?!\\d)|\\d{1,3}(?:\\.\\d{3}){2,}(?!\\d)"
    "|\\d+(?:[.,]\\d+)?|[.,]\\d+"
    ")(?:[eE][+-]?\\d+)?"
)


def squeeze(c: Column) -> Column:
    """All kinds of blanks as single plain blanks, none outside."""
    return F.trim(F.regexp_replace(c, BLANKS + "+", " "))


def strip(c: Column) -> Column:
    """No blanks outside; inner ones as they are."""
    return F.regexp_replace(c, f"^{BLANKS}+|{BLANKS}+$", "")


PLAIN_NUMBER = "^[+-]?\\d+(?:\\.\\d+)?$"


def ungroup(t: Column) -> Column:
    """Plain spelling (digits, at most one full stop, an exponent) of a text that matches NUMBER.

    The last separator is the decimal sign when both occur; repeated separators are groups; a single comma is decimal.
    Each step uses the one before it once, so the expression stays small; texts that are plain already skip the steps.
    """
    plain = t
    t = F.regexp_replace(t, "[ '’]", "")
    t = F.regexp_replace(t, "\\.(?=[\\d.]*,)", "")
    t = F.regexp_replace(t, ",(?=[\\d,]*\\.)", "")
    t = F.regexp_replace(t, ",(?=\\d{3}(?:,\\d{3})+(?!\\d))|(?<=,\\d{3}),(?=\\d{3})", "")
    t = F.regexp_replace(t, "\\.(?=\\d{3}(?:\\.\\d{3})+(?!\\d))|(?<=\\.\\d{3})\\.(?=\\d{3})", "")
    return F.when(plain.rlike(PLAIN_NUMBER), plain).otherwise(F.translate(t, ",", "."))


def number_text(c: Column) -> Column:
    """Plain spelling of a text that matches NUMBER wholly; '' otherwise."""
    return ungroup(F.regexp_extract(c, f"^({NUMBER})$", 1))


def number(c: Column) -> Column:
    """Double of a text that matches NUMBER wholly; null otherwise."""
    return number_text(c).try_cast("double")


def unwrap(c: Column) -> Column:
    """Text without outer blanks, quotes and a type wrapper such as ``IfcLabel('x')``."""
    plain = c.rlike("^[\\p{L}\\p{N}+-](?:.*[\\p{L}\\p{N}%.)-])?$") & ~F.lower(F.left(c, F.lit(3))).eqNullSafe("ifc")
    t = strip(c)
    for _ in range(2):
        t = strip(F.regexp_replace(t, "(?is)^ifc[a-z0-9_]*\\s*\\((.*)\\)$", "$1"))
        t = strip(F.regexp_replace(t, "(?s)^(['\"])(.*)\\1$", "$2"))
        t = strip(F.regexp_replace(t, "(?s)^[“„‘‚«](.*)[”“’‘»]$", "$1"))
    return F.when(plain, c).otherwise(t)  # most texts need none of the steps


def is_empty(c: Column) -> Column:
    """The text says that no value is given."""
    return c.isNull() | F.lower(F.trim(c)).isin(EMPTY_MARKERS)


def name_key(c: Column) -> Column:
    """Name without regard to case, blanks and punctuation."""
    return F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]", "")


def guid_key(c: Column) -> Column:
    """The 32 hex digits of a GUID in any spelling (urn, braces, no dashes, blanks); null if there are not 32."""
    t = F.replace(F.lower(c), F.lit("urn:uuid:"), F.lit(""))
    t = F.translate(t, "-{}() \t\r\n\u00a0", "")
    return F.when(t.rlike("^[0-9a-f]{32}$"), t)

"""Attribute-value rows into one typed row per entity.

The latest readable value of each cell is aggregated first (at most one row per entity and attribute survives, however hot
an entity is), the entity-by-attribute grid is completed inside each row, the values are collected in attribute order, and
fixed positions are projected through type-specific tries to read them.

Defined results: rows with a null entity are left out; an entity whose cells are all unreadable keeps a row of nulls; equal
times are decided by load time, then row id, then value; names match without case, blanks and punctuation; attribute names
not in the definitions are ignored; definitions repeated under one key count once. An integer beyond 64 bits and a real
beyond the range of a double are unreadable as such; reals keep their full precision in the wide table and are rounded to
thousandths only where cells are listed as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trussflow.functions.text import is_empty, name_key, number_text, squeeze, unwrap

#: Spellings of truth values.
TRUE = ["true", "t", ".t.", ".true.", "1", "yes", "y", "ja", "j", "oui", "o", "wahr", "vrai", "on"]
FALSE = ["false", "f", ".f.", ".false.", "0", "no", "n", "nein", "non", "falsch", "faux", "off"]

#: First letters of month names in en, de and fr.
MONTHS = [
    (1, "jan"), (2, "feb|fév|fev"), (3, "mar|mär|mrz"), (4, "apr|avr"), (5, "may|mai"), (6, "jun|juin"),
    (7, "jul|juil"), (8, "aug|aou|aoû"), (9, "sep"), (10, "oct|okt"), (11, "nov"), (12, "dec|dez|déc"),
]


def _month(c: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(c).rlike(f"^(?:{p})"), F.lit(m)) for m, p in MONTHS])


def read_date(t: Column) -> Column:
    """ISO text of a date in any of the usual spellings, day before month; null if there is no such day."""
    iso = "^(\\d{4})([-/.]?)(\\d{1,2})\\2(\\d{1,2})(?:[T ].*)?$"
    dmy = "^(\\d{1,2})[./-](\\d{1,2})[./-](\\d{4})(?:[T ].*)?$"
    dmon = "^(\\d{1,2})\\.? ?(\\p{L}{3,})\\.?,? ?(\\d{4})$"
    mond = "^(\\p{L}{3,})\\.? ?(\\d{1,2}),? ?(\\d{4})$"

    def pick(pattern: str, y: int, m: int, d: int, words: bool = False) -> Column:
        month = _month(F.regexp_extract(t, pattern, m)).cast("string") if words else F.regexp_extract(t, pattern, m)
        text = F.concat_ws("-", F.regexp_extract(t, pattern, y), F.lpad(month, 2, "0"), F.lpad(F.regexp_extract(t, pattern, d), 2, "0"))
        return F.when(t.rlike(pattern), text.try_cast("date"))

    return F.coalesce(pick(iso, 1, 3, 4), pick(dmy, 3, 2, 1), pick(dmon, 3, 2, 1, True), pick(mond, 3, 1, 2, True)).cast("string")


def read_values(df: DataFrame, raw: str, vtype: str) -> DataFrame:
    """Adds ``val``: canonical text of ``raw`` if it is readable as ``vtype``; null if it is empty or unreadable.

    Steps are columns of their own, so that no regular expression is repeated inside another.
    """
    v = F.col(vtype)
    df = df.withColumn("_t", F.when(v.isNotNull(), unwrap(F.col(raw))))
    df = df.withColumn("_t", F.when(~is_empty(F.col("_t")), F.col("_t")))
    df = df.withColumn("_low", F.lower("_t")).withColumn("_n", F.when(v.isin("integer", "real"), number_text(squeeze(F.col("_t"))))).withColumn("_d", F.when(v == "date", squeeze(F.col("_t"))))
    low, n = F.col("_low"), F.col("_n")
    boolean = F.when(low.isin(TRUE), "true").when(low.isin(FALSE), "false")
    exact = n.try_cast("decimal(38,9)")  # integers are read exactly, not through a double
    integer = F.when(exact == F.floor(exact), exact.try_cast("bigint").cast("string"))
    real = n.try_cast("double")
    real = F.when(F.abs(real) < float("inf"), real.cast("string"))
    value = F.when(v == "boolean", boolean).when(v == "integer", integer).when(v == "real", real).when(v == "date", read_date(F.col("_d"))).when(v == "label", F.col("_t"))
    return df.withColumn("val", value).drop("_t", "_low", "_n", "_d")


def definitions(defs: DataFrame) -> list[tuple[str, str, str]]:
    """(key, name, vtype) in order of name. The wanted columns are a schema: one column each, so they fit the driver."""
    rows = defs.where("name is not null").select(name_key(F.col("name")).alias("k"), "name", F.lower("vtype").alias("vtype")).groupBy("k").agg(F.min("name").alias("name"), F.min_by("vtype", "name").alias("vtype")).orderBy("name").limit(20_001).collect()
    if len(rows) > 20_000:
        raise ValueError("more than 20000 wanted columns: a table cannot be that wide")
    return [(r.k, r.name, r.vtype) for r in rows]


def grid(psets: DataFrame, defs: list[tuple[str, str, str]], entity: str = "ifc_id") -> DataFrame:
    """entity, cells: the array of canonical values in the order of ``defs``, complete with nulls."""
    src = psets.where(F.col(entity).isNotNull()).select(F.col(entity).alias("_e"), "name", "value", "recorded_at", "loaded_at", "prop_id")
    if not defs:
        return src.select(F.col("_e").alias(entity), F.array().cast("array<string>").alias("cells")).distinct()
    where = F.create_map(*[F.lit(x) for i, (k, _, _) in enumerate(defs) for x in (k, i)])
    kinds = F.array(*[F.lit(v) for _, _, v in defs])
    cells = src.withColumn("pos", F.try_element_at(where, F.coalesce(name_key(F.col("name")), F.lit(""))))
    cells = read_values(cells.withColumn("_kind", F.get(kinds, F.col("pos"))), "value", "_kind")
    # Unreadable cells stay as one row per entity, so that every entity counts.
    cells = cells.withColumn("pos", F.when(F.col("val").isNotNull(), F.col("pos")).otherwise(-1))
    latest = cells.groupBy("_e", "pos").agg(F.max(F.struct("recorded_at", "loaded_at", "prop_id", "val"))["val"].alias("val"))
    rows = latest.groupBy("_e").agg(F.map_from_entries(F.collect_list(F.struct("pos", "val"))).alias("have"))
    full = F.transform(F.sequence(F.lit(0), F.lit(len(defs) - 1)), lambda i: F.try_element_at(F.col("have"), i))
    return rows.select(F.col("_e").alias(entity), full.alias("cells"))


def wide_table(psets: DataFrame, defs: DataFrame, entity: str = "ifc_id") -> DataFrame:
    """One row per entity with a typed column for each definition."""
    wanted = definitions(defs)
    g = grid(psets, wanted, entity)

    def project(i: int, vtype: str) -> Column:
        c = F.get(F.col("cells"), F.lit(i))
        return {"boolean": c.try_cast("boolean"), "integer": c.try_cast("bigint"), "real": c.try_cast("double"), "date": c.try_cast("date")}.get(vtype, c)

    return g.select(entity, *[project(i, v).alias(name) for i, (_, name, v) in enumerate(wanted)])


def _thousandths(c: Column) -> Column:
    """Whole thousandths of a double as digits; beyond 2**53 those of its exact decimal value."""
    x = F.round(c * 1000)
    return F.when(F.abs(x) < 9e15, x.try_cast("bigint").cast("string")).otherwise(F.coalesce(x.try_cast("decimal(38,0)").cast("string"), x.cast("string")))


def cells_of(wide: DataFrame, defs: DataFrame, entity: str = "ifc_id") -> DataFrame:
    """entity, name, val: the non-null cells of a wide table as canonical text."""
    parts = []
    for _, name, v in definitions(defs):
        c = F.col(f"`{name}`")
        text = _thousandths(c) if v == "real" else c.cast("string")
        parts.append(F.struct(F.lit(name).alias("name"), text.alias("val")))
    if not parts:
        return wide.select(entity, F.lit("").alias("name"), F.lit("").alias("val")).where("false")
    return wide.select(entity, F.inline(F.array(*parts))).where("val is not null")

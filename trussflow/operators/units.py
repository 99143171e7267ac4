"""Quantities recorded in different units, converted to common units.

The number and the unit are read from the text; the unit is then sought in the text, the unit column, the row's scale and
the units the file declares, in that order. Physical identities among the quantities of one element then choose: of all
combinations of the units possible for its values (the declared ones; every known one where none is declared) the one with
the least logarithmic residual is taken. Units of a row that do equally well are flagged as ambiguous, and a declared unit
that no combination agrees with is flagged as contradicted, but stays.

Identity used: Young's modulus = 2 * shear modulus * (1 + Poisson's ratio), the one that the material values obey.

Defined results: null, empty and unreadable texts have no number; a text with an unknown unit, or one of another kind than
the quantity's, has no unit and is not converted; exact repeats give equal rows; values of a null element or file enter no
identity; zero and negative values enter no identity; a name that is not in QUANTITIES is passed over.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trussflow.functions.text import NUMBER, PLAIN_NUMBER, squeeze, ungroup
from trussflow.session import lookup_join, materialize

POUND, INCH, FOOT, GRAVITY = 0.45359237, 0.0254, 0.3048, 9.80665
_PSI = POUND * GRAVITY / INCH**2

#: Spellings (lower case, without blanks, dots, underscores and carets) and factors to the common unit.
UNITS = {
    "length": {
        1.0: ["m", "metre", "metres", "meter", "meters", "mtr"],
        0.01: ["cm", "centimetre", "centimetres", "centimeter", "centimeters"],
        0.001: ["mm", "millimetre", "millimetres", "millimeter", "millimeters"],
        1000.0: ["km", "kilometre", "kilometres", "kilometer", "kilometers"],
        0.1: ["dm", "decimetre", "decimetres", "decimeter", "decimeters"],
        1e-6: ["µm", "μm", "um", "micrometre", "micrometer"],
        INCH: ["in", "inch", "inches", '"', "″", "''"],
        FOOT: ["ft", "foot", "feet", "'", "′"],
        3 * FOOT: ["yd", "yard", "yards"],
    },
    "area": {
        1.0: ["m2", "sqm", "squaremetre", "squaremetres", "squaremeter", "squaremeters", "qm"],
        1e-4: ["cm2", "sqcm", "squarecentimetre", "squarecentimetres", "squarecentimeter"],
        1e-6: ["mm2", "sqmm", "squaremillimetre", "squaremillimetres", "squaremillimeter"],
        1e-2: ["dm2", "squaredecimetre"],
        INCH**2: ["in2", "sqin", "squareinch", "squareinches"],
        FOOT**2: ["ft2", "sqft", "squarefoot", "squarefeet"],
    },
    "density": {
        1.0: ["kg/m3", "kgm-3", "kgperm3", "kg/cum", "kilogrampercubicmetre", "kilogramspercubicmetre", "g/l"],
        1000.0: ["g/cm3", "g/cc", "gcm-3", "t/m3", "tonne/m3", "tonnes/m3", "kg/l", "kg/dm3"],
        POUND / FOOT**3: ["lb/ft3", "lb/cuft", "pcf", "lbs/ft3", "lbft-3"],
        POUND / INCH**3: ["lb/in3", "lb/cuin", "pci"],
    },
    "pressure": {
        1.0: ["pa", "pascal", "n/m2", "nm-2"],
        1e3: ["kpa", "kilopascal", "kn/m2"],
        1e6: ["mpa", "megapascal", "n/mm2"],
        1e9: ["gpa", "gigapascal", "kn/mm2"],
        1e5: ["bar"],
        _PSI: ["psi", "lbf/in2", "lb/in2"],
        1000 * _PSI: ["ksi", "kip/in2", "kips/in2"],
    },
    "ratio": {
        1.0: ["1", "-", "–", "ratio", "m/m", "mm/mm", "none"],
        0.01: ["%", "pct", "percent", "prozent", "pc", "pourcent"],
        0.001: ["‰", "permille", "permil"],
    },
}

#: Quantity -> (kind, unit type a file declares it by, factor from the common unit to that of ``canon``).
QUANTITIES = {
    **{n: ("length", "LENGTHUNIT", 1e3) for n in ("Depth", "Width", "Height", "Thickness")},
    "CrossSectionArea": ("area", "AREAUNIT", 1e4),
    "MassDensity": ("density", "MASSDENSITYUNIT", 1.0),
    "YoungModulus": ("pressure", "PRESSUREUNIT", 1e-6),
    "ShearModulus": ("pressure", "PRESSUREUNIT", 1e-6),
    "PoissonRatio": ("ratio", "RATIOUNIT", 1e3),
}

#: Units tried by the identity for values without unit.
CANDIDATES = {"pressure": [1.0, 1e3, 1e6, 1e9, _PSI, 1000 * _PSI], "ratio": [1.0, 0.01]}

PREFIX = "(?i)^(?:(?:(?:max|min|approx|ca|circa|about|env|etwa|rund|nom|typ)\\.?|[~≈≤≥<>±=])\\s*)+"
#: Feet, inches and a fraction of an inch; the inches may be the fraction alone.
FEET_INCHES = "^(\\d+)\\s*(?:'|′|ft\\.?|feet|foot)\\s*-?\\s*(?:(?!\\d+/)(\\d+(?:\\.\\d+)?))?(?:\\s*(\\d+)/(\\d+))?(?<=\\d)\\s*(?:\"|″|in\\.?|inch|inches)$"


def unit_key(c: Column) -> Column:
    t = F.translate(F.lower(c), "²³⁻", "23-")
    return F.regexp_replace(t, "[\\s\\u00a0._^]", "")


def _factors() -> Column:
    return F.create_map(*[F.lit(x) for kind, units in UNITS.items() for f, keys in units.items() for k in keys for x in (f"{kind}:{k}", f)])


def _lookup(table: Column, key: Column) -> Column:
    return F.try_element_at(table, F.coalesce(key, F.lit("")))


def read_quantities(quantities: DataFrame) -> DataFrame:
    """Adds kind, number, text_unit (key of the unit in the text, '' if none), unit_text and the factors of both.

    Texts that are a plain number, most of all, skip the patterns.
    """
    table = _factors()
    kinds = F.create_map(*[F.lit(x) for n, (k, _, _) in QUANTITIES.items() for x in (n, k)])
    q = quantities.withColumn("kind", _lookup(kinds, F.col("name"))).where("kind is not null")
    plain = F.col("value").rlike(PLAIN_NUMBER)
    q = q.withColumn("_t", F.when(plain, F.col("value")).otherwise(F.regexp_replace(squeeze(F.col("value")), PREFIX, "")))
    t = F.col("_t")
    q = q.withColumn("_num", F.when(F.col("value").rlike(PLAIN_NUMBER), t).otherwise(F.regexp_extract(t, f"^({NUMBER})", 1)))
    # feet and inches are rare: the pattern is tried only on texts that have a mark of each
    feet = (F.col("kind") == "length") & (F.length("_num") < F.length(t)) & t.rlike("^\\d") & t.rlike("(?:\"|″|in\\.?|inch|inches)$") & t.rlike(FEET_INCHES)
    q = q.withColumn("_feet", feet)

    def part(i: int) -> Column:
        return F.coalesce(F.regexp_extract(t, FEET_INCHES, i).try_cast("double"), F.lit(0.0))

    inches = part(1) * 12 + part(2) + F.coalesce(F.try_divide(part(3), part(4)), F.lit(0.0))
    rest = F.substr(t, F.length("_num") + 1)
    q = q.withColumns({
        "number": F.when(F.col("_feet"), inches).otherwise(ungroup(F.col("_num")).try_cast("double")),
        "text_unit": F.when(F.col("_feet"), "in").when(rest == "", "").otherwise(unit_key(rest)),
        "unit_text": unit_key(F.col("unit")),
    })
    of = lambda c: F.when(F.col(c) != "", _lookup(table, F.concat(F.col("kind"), F.lit(":"), F.col(c))))
    return q.withColumns({"text_factor": of("text_unit"), "column_factor": of("unit_text")}).drop("_t", "_num", "_feet")


def declared_units(file_units: DataFrame) -> DataFrame:
    """file_id, kind, file_factor, file_factors: the unit a file declares for each kind; repeats count once.

    A known name counts before the scale. If a file declares one type with several factors, all are kept for the identity to
    choose from, the largest first; it is taken where no identity holds.
    """
    kinds = F.create_map(*[F.lit(x) for t, k in {(t, k) for k, t, _ in QUANTITIES.values()} for x in (t, k)])
    u = file_units.withColumn("kind", _lookup(kinds, F.upper(F.trim("unit_type")))).where("kind is not null and file_id is not null")
    named = _lookup(_factors(), F.concat(F.col("kind"), F.lit(":"), unit_key(F.col("unit_name"))))
    u = u.select("file_id", "kind", F.coalesce(named, F.when(F.col("unit_name").isNull(), F.col("unit_scale"))).alias("f")).distinct()
    return u.groupBy("file_id", "kind").agg(F.sort_array(F.collect_list("f"), False).alias("file_factors")).withColumn("file_factor", F.get("file_factors", F.lit(0)))


def resolve(quantities: DataFrame, file_units: DataFrame) -> DataFrame:
    """One row per quantity row: number, unit_source (text, column, scale, file, plain, or null) and factor."""
    q = read_quantities(quantities.select("qty_id", "file_id", "ifc_id", "name", "value", "unit", "unit_scale"))
    # Texts are read once, whatever is asked of the result.
    q = materialize(q.select("qty_id", "file_id", "ifc_id", "name", "kind", "number", "text_unit", "unit_text", "text_factor", "column_factor", "unit_scale"), "quantities")
    q = lookup_join(q, declared_units(file_units), ["file_id", "kind"])
    has_text = F.col("text_unit") != ""
    has_column = F.coalesce(F.col("unit_text") != "", F.lit(False))
    by_scale = (F.col("kind") == "length") & F.col("unit_scale").isNotNull()
    source = (
        F.when(F.col("number").isNull(), None)
        .when(has_text, F.when(F.col("text_factor").isNotNull(), "text"))
        .when(has_column, F.when(F.col("column_factor").isNotNull(), "column"))
        .when(by_scale, "scale")
        .when(F.col("file_factor").isNotNull(), "file")
        .when(F.col("kind") == "ratio", "plain")
    )
    q = q.withColumn("unit_source", source)
    s = F.col("unit_source")
    factor = F.when(s == "text", F.col("text_factor")).when(s == "column", F.col("column_factor")).when(s == "scale", F.col("unit_scale")).when(s == "file", F.col("file_factor")).when(s == "plain", 1.0)
    open_ = F.col("number").isNotNull() & s.isNull() & ~has_text & ~has_column
    factors = F.when(s == "file", F.col("file_factors")).when(factor.isNotNull(), F.array(factor))
    return q.select("qty_id", "file_id", "ifc_id", "name", "kind", "number", "unit_source", factor.alias("factor"), factors.alias("factors"), open_.alias("unit_open"))


#: The quantities of the identity, in its order.
IDENTITY = ("YoungModulus", "ShearModulus", "PoissonRatio")


def identity_partners(resolved: DataFrame) -> DataFrame:
    """file_id, ifc_id and, for each quantity of the identity, the number and declared factors (null if open) its partners take.

    One value per quantity and element, aggregated before the shuffle: a declared one before an open one. Elements without
    one of the quantities are left out.
    """
    ok = resolved.where(F.col("name").isin(*IDENTITY) & (F.col("number") > 0) & F.col("file_id").isNotNull() & F.col("ifc_id").isNotNull() & (F.col("factor").isNotNull() | F.col("unit_open")))
    best = [F.max(F.when(F.col("name") == n, F.struct(F.col("factor").isNotNull().alias("declared"), "qty_id", "number", "factors"))).alias(n) for n in IDENTITY]
    per = ok.groupBy("file_id", "ifc_id").agg(*best).where(" and ".join(f"{n} is not null" for n in IDENTITY))
    return per.select("file_id", "ifc_id", *[F.struct(f"{n}.number", f"{n}.factors").alias(n) for n in IDENTITY])


def identity_factor(joined: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Adds solved_factor, residual, ambiguous and contradicts to the rows that carry their element's ``identity_partners``.

    Each row is solved by itself, with its own number and the partners of the two other quantities, so several rows of one
    quantity may have different units. A declared value may take its declared factors only, an open one every known unit: a
    row tries at most 6 * 6 * 2 combinations, and the least residual decides. A solution is ambiguous if another unit of the
    row's own does as well within ``tolerance``; one whose residual exceeds ``tolerance`` is not taken, which contradicts the
    declared unit if the row has one.
    """

    def options(n: str) -> Column:
        tried = F.array(*[F.lit(x) for x in CANDIDATES[QUANTITIES[n][0]]])
        declared = F.when(F.col("name") == n, F.col("factors")).otherwise(F.col(f"{n}.factors"))
        return F.coalesce(declared, tried)

    e, g, nu = (F.when(F.col("name") == n, F.col("number")).otherwise(F.col(f"{n}.number")) for n in IDENTITY)

    def own(a: Column, b: Column, c: Column) -> Column:
        return F.when(F.col("name") == IDENTITY[0], a).when(F.col("name") == IDENTITY[1], b).otherwise(c)

    combos = F.flatten(F.transform(options(IDENTITY[0]), lambda a: F.flatten(F.transform(options(IDENTITY[1]), lambda b: F.transform(options(IDENTITY[2]), lambda c: F.struct(
        F.abs(F.log(e * a) - F.log(g * b) - F.log(1 + nu * c) - F.lit(math.log(2))).alias("residual"), own(a, b, c).alias("factor"))
    )))))
    ranked = joined.withColumn("_r", F.when(F.col(IDENTITY[0]).isNotNull(), combos))
    ranked = ranked.withColumn("_best", F.array_min("_r"))
    taken = F.col("_best.residual") <= tolerance
    rivals = F.exists("_r", lambda x: (x["residual"] - F.col("_best.residual") <= tolerance) & (x["factor"] != F.col("_best.factor")))
    return ranked.withColumns({
        "solved_factor": F.when(taken, F.col("_best.factor")), "residual": F.col("_best.residual"),
        "ambiguous": F.when(taken, rivals), "contradicts": F.when(F.col("factor").isNotNull() & F.col("_best").isNotNull(), ~taken),
    }).drop("_r", "_best", *IDENTITY)


def common_units(quantities: DataFrame, file_units: DataFrame) -> DataFrame:
    """qty_id, name, number, unit_source, factor, common (value in the common unit), canon, residual, ambiguous, contradicts.

    Every value of the identity's quantities passes its search, which chooses among the factors declared for it; where none
    fits, the first declared one stays and ``contradicts`` is true. ``unit_source`` is ``identity`` where the identity alone
    settled the unit. Values left without unit have nulls.
    """
    r = resolve(quantities, file_units)
    asks = (F.col("factor").isNotNull() | F.col("unit_open")) & F.col("name").isin(*IDENTITY) & (F.col("number") > 0)
    r = lookup_join(r.withColumn("_asks", F.when(asks, F.col("ifc_id"))), identity_partners(r).withColumnRenamed("ifc_id", "_asks"), ["file_id", "_asks"])
    r = identity_factor(r)
    factor = F.coalesce("solved_factor", "factor")
    source = F.coalesce("unit_source", F.when(F.col("unit_open") & F.col("solved_factor").isNotNull(), F.lit("identity")))
    canon = F.create_map(*[F.lit(x) for n, (_, _, c) in QUANTITIES.items() for x in (n, c)])
    common = F.col("number") * factor
    scaled = common * F.try_element_at(canon, F.col("name"))
    return r.select(
        "qty_id", "name", "number", source.alias("unit_source"), factor.alias("factor"), common.alias("common"),
        F.when(F.abs(scaled) < 9e18, F.round(scaled)).cast("bigint").alias("canon"), "residual", "ambiguous", "contradicts",
    )

"""Declarative audits: facets and restrictions compiled to predicates, specifications with cardinalities, result tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Restriction:
    """Enumeration, full-match pattern, length and bounds; every given part must hold."""

    enumeration: tuple = ()
    pattern: str | None = None
    length: int | None = None
    min_length: int | None = None
    max_length: int | None = None
    min_inclusive: float | None = None
    max_inclusive: float | None = None
    min_exclusive: float | None = None
    max_exclusive: float | None = None

    def test(self, c: Column) -> Column:
        n, t = c.try_cast("double"), c.cast("string")
        parts = []
        if self.enumeration:
            parts.append(t.isin([str(x) for x in self.enumeration]))
        if self.pattern is not None:
            parts.append(t.rlike(f"^(?:{self.pattern})$"))
        for bound, test in (
            (self.length, lambda v: F.length(t) == v), (self.min_length, lambda v: F.length(t) >= v), (self.max_length, lambda v: F.length(t) <= v),
            (self.min_inclusive, lambda v: n >= v), (self.max_inclusive, lambda v: n <= v), (self.min_exclusive, lambda v: n > v), (self.max_exclusive, lambda v: n < v),
        ):
            if bound is not None:
                parts.append(test(bound))
        return F.coalesce(reduce(lambda a, b: a & b, parts, F.lit(True)), F.lit(False))


def equals(c: Column, value, tolerance: float = 1e-6) -> Column:
    """Equal to a value; numbers within a relative tolerance."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return F.coalesce(F.abs(c.try_cast("double") - value) <= tolerance * abs(value), F.lit(False))
    return F.coalesce(c.cast("string") == str(value), F.lit(False))


@dataclass(frozen=True)
class AttributeFacet:
    """A non-empty attribute, of the given value or restriction if there is one."""

    column: str
    value: object = None
    cardinality: str = "required"

    def passes(self) -> Column:
        c = F.col(self.column)
        given = c.isNotNull() & (F.trim(c.cast("string")) != "")
        fits = F.lit(True) if self.value is None else self.value.test(c) if isinstance(self.value, Restriction) else equals(c, self.value)
        if self.cardinality == "prohibited":
            return ~(given & fits)
        return ~given | fits if self.cardinality == "optional" else given & fits

    def reason(self) -> Column:
        given = F.col(self.column).isNotNull()
        what = F.when(~given, f"The attribute {self.column} is missing").otherwise(f"The attribute {self.column} does not fit")
        return F.lit(f"The attribute {self.column} should not be given") if self.cardinality == "prohibited" else what


@dataclass(frozen=True)
class Specification:
    """Elements that satisfy ``applies`` must pass every requirement; ``min_occurs`` and ``max_occurs`` bound their number."""

    name: str
    applies: Column
    requirements: tuple = ()
    min_occurs: int = 0
    max_occurs: int | None = None
    keep: tuple = field(default=())


def results(df: DataFrame, key: str, specs: list[Specification]) -> DataFrame:
    """specification, requirement, entity, passed, reason: one row per applicable element and requirement, in one pass."""
    cells = [
        F.struct(F.lit(s.name).alias("specification"), F.lit(k).alias("requirement"), F.coalesce(s.applies, F.lit(False)).alias("applicable"), r.passes().alias("passed"), r.reason().alias("reason"))
        for s in specs for k, r in enumerate(s.requirements)
    ]
    rows = df.select(F.col(key).alias("entity"), F.inline(F.array(*cells))).where("applicable")
    return rows.select("specification", "requirement", "entity", "passed", F.when(~F.col("passed"), F.col("reason")).alias("reason"))


def statuses(df: DataFrame, specs: list[Specification]) -> DataFrame:
    """specification, applicable, failed, status of every specification, by one aggregation of the table."""
    aggs = []
    for k, s in enumerate(specs):
        on = F.coalesce(s.applies, F.lit(False))
        ok = reduce(lambda a, b: a & b, [r.passes() for r in s.requirements], F.lit(True))
        aggs += [F.count_if(on).alias(f"n{k}"), F.count_if(on & ~ok).alias(f"f{k}")]
    one = df.agg(*aggs)
    rows = []
    for k, s in enumerate(specs):
        n, f = F.col(f"n{k}"), F.col(f"f{k}")
        fits = (n >= s.min_occurs) & (F.lit(True) if s.max_occurs is None else n <= s.max_occurs if s.max_occurs or not s.requirements else F.lit(True))
        rows.append(F.struct(F.lit(s.name).alias("specification"), n.alias("applicable"), f.alias("failed"), F.when((f == 0) & fits, "pass").otherwise("fail").alias("status")))
    return one.select(F.inline(F.array(*rows)))


def totals(result: DataFrame) -> DataFrame:
    """specification, requirement, checks, passes, percent."""
    r = result.groupBy("specification", "requirement").agg(F.count("*").alias("checks"), F.count_if("passed").alias("passes"))
    return r.withColumn("percent", F.floor(F.col("passes") * 100 / F.col("checks")).cast("int"))


def passed_view(result: DataFrame) -> DataFrame:
    """specification, entity: applicable elements without any failure (anti join)."""
    failed = result.where("not passed").select("specification", "entity")
    return result.select("specification", "entity").distinct().join(failed, ["specification", "entity"], "left_anti")


# ---------------------------------------------------------------- facets over a store of elements, relations and properties


@dataclass(frozen=True)
class EntityFacet:
    """Class name in upper case, exactly and without subtypes, and the predefined type if one is given."""

    name: str
    predefined_type: object = None

    def ids(self, store) -> DataFrame:
        e = store.elements.join(store.get_predefined_type().withColumnRenamed("predefined_type", "_pt"), "id")
        ok = F.upper("class") == self.name.upper()
        if self.predefined_type is not None:
            ok = ok & (self.predefined_type.test(F.col("_pt")) if isinstance(self.predefined_type, Restriction) else F.col("_pt") == self.predefined_type)
        return e.where(ok).select("id")


def _fits(value, c: Column) -> Column:
    return F.lit(True) if value is None else value.test(c) if isinstance(value, Restriction) else equals(c, value)


@dataclass(frozen=True)
class PropertyFacet:
    """A property of a set, own or inherited from the type; every matching one must be given and fit."""

    pset: object
    name: object
    value: object = None

    def ids(self, store) -> DataFrame:
        p = store.get_psets().where(_fits(self.pset, F.col("pset_name")) & _fits(self.name, F.col("name")))
        ok = F.col("value").isNotNull() & (F.trim("value") != "") & _fits(self.value, F.col("value"))
        return p.groupBy("id").agg(F.bool_and(ok).alias("ok")).where("ok").select("id")


@dataclass(frozen=True)
class RelatedFacet:
    """Elements related by ``kind`` (classification, material, group) to one whose name or id fits; types pass it on."""

    kind: str
    value: object = None

    def ids(self, store) -> DataFrame:
        r = store.related(self.kind).join(store.elements.select(F.col("id").alias("other"), "name"), "other", "left")
        hit = r.where(_fits(self.value, F.col("name")) | _fits(self.value, F.col("other").cast("string"))).select("id").distinct()
        through = store.related("type").join(hit.withColumnRenamed("id", "other"), "other", "left_semi").select("id")
        return hit.union(through).distinct()


@dataclass(frozen=True)
class PartOfFacet:
    """Elements that lie, at any depth, in an element of a class, through one relation or any part-of relation."""

    name: str
    relation: str | None = None

    def ids(self, store) -> DataFrame:
        from trussflow.operators.graph import reach
        from trussflow.operators.store import PART_OF

        kinds = [self.relation] if self.relation else list(PART_OF)
        down = store.rels.where(F.col("kind").isin(kinds)).select(F.col("relating").alias("src"), F.col("related").alias("dst"))
        tops = store.elements.where(F.upper("class") == self.name.upper()).select("id")
        below = reach(down, tops)  # a top may lie in another top, so members are found by their parents
        return down.join(below.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()


def store_audit(store, name: str, applicability: list, requirements: list[tuple[object, str]]) -> DataFrame:
    """specification, requirement, entity, passed for facets over a store; each requirement has its cardinality.

    ``required``: the facet must hold; ``prohibited``: it must not; ``optional`` is for facets whose absence is no failure:
    elements that lack the property or relation altogether pass.
    """
    chosen = store.elements.select("id")
    for f in applicability:
        chosen = chosen.join(f.ids(store), "id", "left_semi")
    out = None
    for k, (f, cardinality) in enumerate(requirements):
        hit = f.ids(store).withColumn("_hit", F.lit(True))
        rows = chosen.join(hit, "id", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
        if cardinality == "optional":
            bare = PropertyFacet(f.pset, f.name) if isinstance(f, PropertyFacet) else RelatedFacet(f.kind) if isinstance(f, RelatedFacet) else f
            rows = rows.join(bare.ids(store).withColumn("_any", F.lit(True)), "id", "left").withColumn("_hit", F.col("_hit") | F.col("_any").isNull())
        passed = ~F.col("_hit") if cardinality == "prohibited" else F.col("_hit")
        part = rows.select(F.lit(name).alias("specification"), F.lit(k).alias("requirement"), F.col("id").alias("entity"), passed.alias("passed"))
        out = part if out is None else out.unionByName(part)
    return out

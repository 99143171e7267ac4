"""Row rewrites on the canonical tables, with a change log, undo and redo, and the navigation helpers.

A store is a set of tables (elements, rels, psets). A change is a pair of row sets for one table, removed and added; it is
applied as a multiset difference and a union, so it can be undone and redone exactly and shown as a log. Nothing is updated in
place: every state is a plan over the tables it started from; ``checkpoint`` writes the state out when a chain grows long.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trussflow.operators.graph import reach
from trussflow.session import materialize

#: Relation kinds of which an element has one at most, and those that make it part of a whole.
SINGLE = ("aggregates", "nests", "contained", "type", "voids", "fills")
PART_OF = ("aggregates", "nests", "contained", "voids", "fills")

#: Module of the mutation interface -> relation kind its assign and unassign functions write.
MODULE_KINDS = {
    "aggregate": "aggregates", "nest": "nests", "spatial": "contained", "type": "type", "group": "group", "system": "system", "material": "material", "classification": "classification",
    "document": "document", "library": "library", "constraint": "constraint", "control": "control", "layer": "layer", "style": "style", "profile": "profile", "resource": "resource",
    "sequence": "sequence", "cost": "cost", "structural": "structural", "feature": "voids", "boundary": "boundary", "owner": "owner", "unit": "unit", "pset": "pset", "pset_template": "pset_template", "project": "declares", "drawing": "drawing",
}


@dataclass
class Change:
    op: str
    table: str
    removed: DataFrame
    added: DataFrame


@dataclass
class Store:
    """elements(id, class, name, predefined_type, ...), rels(kind, relating, related), psets(id, pset_name, name, value)."""

    tables: dict[str, DataFrame]
    done: list[Change] = field(default_factory=list)
    undone: list[Change] = field(default_factory=list)

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("elements", "rels", "psets"):
            return self.tables[name]
        raise AttributeError(name)

    # ------------------------------------------------------------ changes

    def _apply(self, c: Change) -> None:
        t = self.tables[c.table]
        self.tables[c.table] = t.exceptAll(c.removed.select(*t.columns)).unionAll(c.added.select(*t.columns))

    def change(self, op: str, table: str, removed: DataFrame | None, added: DataFrame | None) -> Store:
        none = self.tables[table].where("false")
        c = Change(op, table, none if removed is None else removed, none if added is None else added)
        self._apply(c)
        self.done.append(c)
        self.undone.clear()
        return self

    def undo(self) -> Store:
        c = self.done.pop()
        self._apply(Change(c.op, c.table, c.added, c.removed))
        self.undone.append(c)
        return self

    def redo(self) -> Store:
        c = self.undone.pop()
        self._apply(c)
        self.done.append(c)
        return self

    def log(self) -> DataFrame:
        """txn, op, table, side (removed, added), row (JSON): every row any change touched."""
        out = None
        for k, c in enumerate(self.done):
            for side, df in (("removed", c.removed), ("added", c.added)):
                part = df.select(F.lit(k).alias("txn"), F.lit(c.op).alias("op"), F.lit(c.table).alias("table"), F.lit(side).alias("side"), F.to_json(F.struct(*self.tables[c.table].columns)).alias("row"))
                out = part if out is None else out.unionByName(part)
        return out

    def checkpoint(self) -> Store:
        """Writes the state out; changes made before can no longer be undone."""
        self.tables = {n: materialize(t, n) for n, t in self.tables.items()}
        self.done, self.undone = [], []
        return self

    # ------------------------------------------------------------ rewrites

    def assign(self, kind: str, related: DataFrame, relating: Column | int, op: str = "assign") -> Store:
        """Relates ``related(id)`` to one element; a single-valued relation replaces the one before."""
        ids = related.select("id").distinct()
        new = ids.select(F.lit(kind).alias("kind"), (relating if isinstance(relating, Column) else F.lit(relating)).cast("bigint").alias("relating"), F.col("id").alias("related"))
        old = self.rels.where(F.col("kind") == kind).join(ids.withColumnRenamed("id", "related"), "related", "left_semi").select(*self.rels.columns)
        if kind not in SINGLE:  # only what is not related so yet
            new, old = new.join(self.rels, ["kind", "relating", "related"], "left_anti"), None
        return self.change(op, "rels", old, new)

    def unassign(self, kind: str, related: DataFrame, relating: int | None = None, op: str = "unassign") -> Store:
        old = self.rels.where(F.col("kind") == kind).join(related.select(F.col("id").alias("related")), "related", "left_semi").select(*self.rels.columns)
        return self.change(op, "rels", old if relating is None else old.where(F.col("relating") == relating), None)

    def edit(self, which: DataFrame, values: dict[str, Column], op: str = "edit") -> Store:
        """Sets columns of the elements in ``which(id)``."""
        old = self.elements.join(which.select("id").distinct(), "id", "left_semi").select(*self.elements.columns)
        return self.change(op, "elements", old, old.withColumns(values))

    def reassign_class(self, which: DataFrame, name: str) -> Store:
        return self.edit(which, {"class": F.lit(name)}, "reassign_class")

    def add(self, rows: DataFrame, table: str = "elements", op: str = "add") -> Store:
        return self.change(op, table, None, rows)

    def remove(self, which: DataFrame, deep: bool = False, op: str = "remove") -> Store:
        """Removes elements with their relations and properties; ``deep``: with all their parts too."""
        ids = which.select("id").distinct()
        if deep:
            edges = self.rels.where(F.col("kind").isin(*PART_OF)).select(F.col("relating").alias("src"), F.col("related").alias("dst"))
            ids = reach(edges, ids).select("id")
        semi = lambda t, key: t.join(ids.withColumnRenamed("id", key), key, "left_semi").select(*t.columns)
        rels = self.rels.withColumn("_r", F.col("related"))
        rels = rels.join(ids.select(F.col("id").alias("_r"), F.lit(1).alias("_a")), "_r", "left").withColumn("_l", F.col("relating")).join(ids.select(F.col("id").alias("_l"), F.lit(1).alias("_b")), "_l", "left")
        self.change(op, "rels", rels.where("_a is not null or _b is not null").select(*self.rels.columns), None)
        self.change(op, "psets", semi(self.psets, "id"), None)
        return self.change(op, "elements", semi(self.elements, "id"), None)

    def copy(self, which: DataFrame, offset: int, op: str = "copy") -> Store:
        """Copies elements with properties and types; new id = id + offset."""
        ids = which.select("id").distinct()
        shift = lambda t: t.join(ids, "id", "left_semi").select(*t.columns).withColumn("id", F.col("id") + offset)
        types = self.rels.where("kind = 'type'").join(ids.withColumnRenamed("id", "related"), "related", "left_semi").select(*self.rels.columns).withColumn("related", F.col("related") + offset)
        self.change(op, "psets", None, shift(self.psets))
        self.change(op, "rels", None, types)
        return self.change(op, "elements", None, shift(self.elements))

    def edit_pset(self, which: DataFrame, pset: str, properties: dict[str, str | None], op: str = "edit_pset") -> Store:
        """Sets properties of a set, creating what is not there; None removes one."""
        ids = which.select("id").distinct()
        names = list(properties)
        old = self.psets.where((F.col("pset_name") == pset) & F.col("name").isin(names)).join(ids, "id", "left_semi").select(*self.psets.columns)
        cells = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).cast("string").alias("value")) for k, v in properties.items()])
        new = ids.select("id", F.lit(pset).alias("pset_name"), F.inline(cells)).where("value is not null")
        return self.change(op, "psets", old, new)

    def remove_pset(self, which: DataFrame, pset: str) -> Store:
        old = self.psets.where(F.col("pset_name") == pset).join(which.select("id").distinct(), "id", "left_semi").select(*self.psets.columns)
        return self.change("remove_pset", "psets", old, None)

    def set_value(self, which: DataFrame, path: str, value: str | None) -> Store:
        """Sets what a path addresses: ``class``, a column of the elements, or ``Set.Property`` (created if not there)."""
        if path == "class":
            return self.reassign_class(which, value)
        if path in self.elements.columns and path != "id":
            kind = dict(self.elements.dtypes)[path]
            return self.edit(which, {path: F.lit(value).try_cast(kind)}, "set_value")
        if "." in path:
            pset, prop = path.split(".", 1)
            return self.edit_pset(which, pset, {prop: value}, "set_value")
        raise ValueError(f"no such path: {path}")

    def call(self, function: str, **settings) -> Store:
        """A function of the mutation interface by name (``module.verb_object``), resolved by its verb and module.

        assign, reference and append relate ``products`` to ``relating``; unassign, dereference and detach undo that; edit
        sets ``attributes`` of ``products`` (of psets: ``pset`` and ``properties``); add, create and append_asset add
        ``rows``; remove removes ``products``; copy copies them by ``offset``; reassign sets ``ifc_class``.
        """
        module, name = function.split(".", 1)
        verb = name.split("_", 1)[0]
        kind = settings.get("kind") or MODULE_KINDS.get(module, module)
        products = settings.get("products")
        if verb in ("assign", "reference") or verb == "append" and products is not None:
            return self.assign(kind, products, settings["relating"], function)
        if verb in ("unassign", "dereference", "detach", "unshare") and module != "pset":
            return self.unassign(kind, products, settings.get("relating"), function)
        if module == "pset" and verb in ("edit", "add"):
            return self.edit_pset(products, settings["pset"], settings.get("properties", {}), function)
        if module == "pset" and verb == "remove":
            return self.remove_pset(products, settings["pset"])
        if verb in ("edit", "set", "update", "calculate"):
            return self.edit(products, settings["attributes"], function)
        if verb in ("add", "create", "append"):
            return self.add(settings["rows"], op=function)
        if verb == "remove":
            return self.remove(products, settings.get("deep", False), function)
        if verb == "copy":
            return self.copy(products, settings["offset"], function)
        if verb == "reassign":
            return self.reassign_class(products, settings["ifc_class"])
        raise ValueError(f"no rewrite for {function}")

    # ------------------------------------------------------------ navigation

    def related(self, kind: str, up: bool = True) -> DataFrame:
        """id, other: the relating element of each related one, or the other way round."""
        a, b = ("related", "relating") if up else ("relating", "related")
        return self.rels.where(F.col("kind") == kind).select(F.col(a).alias("id"), F.col(b).alias("other"))

    def get_type(self) -> DataFrame:
        """id, type_id: of occurrences; a type gives itself."""
        t = self.related("type")
        own = t.select(F.col("other").alias("id")).distinct().select("id", F.col("id").alias("other"))
        return t.unionByName(own.join(t, "id", "left_anti")).withColumnRenamed("other", "type_id")

    def get_parent(self) -> DataFrame:
        """id, parent: the whole an element is part of, by the first of the part-of relations it has."""
        order = F.array(*[F.lit(k) for k in PART_OF])
        return self.rels.where(F.col("kind").isin(*PART_OF)).groupBy(F.col("related").alias("id")).agg(F.min_by("relating", F.array_position(order, F.col("kind"))).alias("parent"))

    def get_decomposition(self, which: DataFrame) -> DataFrame:
        """id of all parts below elements."""
        edges = self.rels.where(F.col("kind").isin(*PART_OF)).select(F.col("relating").alias("src"), F.col("related").alias("dst"))
        return reach(edges, which).where("level > 0").select("id")

    def get_psets(self, inherit: bool = True) -> DataFrame:
        """id, pset_name, name, value: an occurrence's own values before those of its type."""
        own = self.psets.withColumn("_rank", F.lit(0))
        if inherit:
            t = self.related("type").withColumnRenamed("id", "_occ").withColumnRenamed("other", "id")
            own = own.unionByName(self.psets.join(t, "id").select(F.col("_occ").alias("id"), "pset_name", "name", "value", F.lit(1).alias("_rank")))
        return own.groupBy("id", "pset_name", "name").agg(F.min_by("value", "_rank").alias("value"))

    def get_predefined_type(self) -> DataFrame:
        """id, predefined_type: own, or the type's where it is not given or NOTDEFINED."""
        e = self.elements.select("id", F.nullif(F.col("predefined_type"), F.lit("NOTDEFINED")).alias("p"))
        t = self.related("type").join(e.select(F.col("id").alias("other"), F.col("p").alias("tp")), "other").select("id", "tp")
        return e.join(t, "id", "left").select("id", F.coalesce("p", "tp").alias("predefined_type"))


# ---------------------------------------------------------------- recipes

RECIPES: dict[str, Callable[..., Store]] = {}


def recipe(f: Callable[..., Store]) -> Callable[..., Store]:
    """Registers a rewrite of a store under its name."""
    RECIPES[f.__name__] = f
    return f


@recipe
def convert_nest_to_aggregate(s: Store) -> Store:
    old = s.rels.where("kind = 'nests'")
    return s.change("convert_nest_to_aggregate", "rels", old, old.withColumn("kind", F.lit("aggregates")))


@recipe
def convert_properties_to_quantities(s: Store, property_name: str, quantity_name: str) -> Store:
    old = s.psets.where(F.col("name") == property_name)
    new = old.where(F.col("value").try_cast("double").isNotNull()).withColumns({"pset_name": F.lit("Qto_Quantities"), "name": F.lit(quantity_name)})
    return s.change("convert_properties_to_quantities", "psets", old.where(F.col("value").try_cast("double").isNotNull()), new)


@recipe
def merge_duplicate_types(s: Store, attribute: str = "name", merge_null: bool = False) -> Store:
    """Types equal in an attribute fold to the least id; their occurrences follow."""
    types = s.related("type", up=False).select("id").distinct()
    t = s.elements.join(types, "id", "left_semi").select("id", "class", F.col(attribute).alias("_k"))
    t = t if merge_null else t.where("_k is not null")
    keep = t.withColumn("keep", F.min("id").over(Window.partitionBy("class", "_k"))).where("id <> keep").select("id", "keep")
    old = s.rels.where("kind = 'type'").join(keep.withColumnRenamed("id", "relating"), "relating")
    s.change("merge_duplicate_types", "rels", old.select(*s.rels.columns), old.select("kind", F.col("keep").alias("relating"), "related"))
    return s.remove(keep, op="merge_duplicate_types")


@recipe
def purge_data(s: Store, keep_kinds: list[str] | None = None) -> Store:
    """Drops all properties and every relation but those given."""
    s.change("purge_data", "psets", s.psets, None)
    return s.change("purge_data", "rels", s.rels.where(~F.col("kind").isin(keep_kinds or [])), None)


@recipe
def remove_classification(s: Store, system: int) -> Store:
    return s.change("remove_classification", "rels", s.rels.where((F.col("kind") == "classification") & (F.col("relating") == system)), None)


@recipe
def classification_to_types(s: Store) -> Store:
    """Moves classifications of occurrences to their types."""
    c = s.rels.where("kind = 'classification'").join(s.related("type").withColumnRenamed("id", "related"), "related")
    new = c.select("kind", "relating", F.col("other").alias("related")).distinct()
    return s.change("classification_to_types", "rels", c.select(*s.rels.columns), new)


@recipe
def offset_elevations(s: Store, z: float, cls: str, column: str = "z") -> Store:
    return s.edit(s.elements.where(F.col("class") == cls), {column: F.col(column) + z}, "offset_elevations")


@recipe
def reset_absolute_coordinates(s: Store, columns: tuple[str, ...] = ("x", "y", "z"), threshold: float = 1e6) -> Store:
    """Shifts all elements by the first large coordinates, if any coordinate lies beyond the threshold."""
    far = s.elements.where(" or ".join(f"abs({c}) > {threshold}" for c in columns))
    first = far.agg(*[F.min_by(c, "id").alias(c) for c in columns]).first()
    if first is None or first[0] is None:
        return s
    return s.edit(s.elements, {c: F.col(c) - float(first[c]) for c in columns}, "reset_absolute_coordinates")


@recipe
def convert_length_unit(s: Store, columns: list[str], factor: float) -> Store:
    return s.edit(s.elements, {c: F.col(c) * factor for c in columns}, "convert_length_unit")


@recipe
def migrate(s: Store, classes: dict[str, str]) -> Store:
    """Renames classes by a map from one schema version to another; others stay."""
    m = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
    return s.edit(s.elements.where(F.col("class").isin(list(classes))), {"class": F.element_at(m, F.col("class"))}, "migrate")


@recipe
def regenerate_ids(s: Store, column: str = "global_id", only_duplicates: bool = True) -> Store:
    """New ids from a hash of the step id for elements whose id another element has before them (or for all)."""
    w = Window.partitionBy(column).orderBy("id")
    old = s.elements.withColumn("_n", F.row_number().over(w)).where("_n > 1" if only_duplicates else "true").drop("_n")
    return s.change("regenerate_ids", "elements", old, old.withColumn(column, F.substring(F.sha2(F.concat_ws("|", column, F.col("id").cast("string")), 256), 1, 22)))


@recipe
def unshare_psets(s: Store, which: DataFrame) -> Store:
    """Gives elements their own copy of the values they inherit from their type."""
    mine = s.get_psets().join(which.select("id").distinct(), "id", "left_semi")
    return s.change("unshare_psets", "psets", None, mine.join(s.psets, ["id", "pset_name", "name"], "left_anti"))


@recipe
def assign_fractions(s: Store, pset: str, name: str, weight: str) -> Store:
    """Each constituent's share of the total weight of its whole, as a property."""
    w = s.psets.where(F.col("name") == weight).select(F.col("id").alias("related"), F.col("value").try_cast("double").alias("w"))
    parts = s.rels.where("kind = 'material'").join(w, "related")
    share = F.try_divide(F.col("w"), F.sum("w").over(Window.partitionBy("relating")))
    new = parts.select(F.col("related").alias("id"), F.lit(pset).alias("pset_name"), F.lit(name).alias("name"), F.round(share, 6).cast("string").alias("value"))
    return s.change("assign_fractions", "psets", None, new)


@recipe
def extract_elements(s: Store, which: DataFrame) -> Store:
    """A new store with the elements, everything they are part of, and their types."""
    up = s.rels.where(F.col("kind").isin(*PART_OF, "type")).select(F.col("related").alias("src"), F.col("relating").alias("dst"))
    ids = materialize(reach(up, which).select("id"), "extract")
    semi = lambda t, key: t.join(ids.withColumnRenamed("id", key), key, "left_semi").select(*t.columns)
    return Store({"elements": semi(s.elements, "id"), "psets": semi(s.psets, "id"), "rels": semi(semi(s.rels, "related"), "relating")})

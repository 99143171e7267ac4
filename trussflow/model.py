"""The entity-graph model: classes bound to tables, a class taxonomy, and the relations that navigation follows.

A class is one table with a key; a reference is a foreign-key column; relations of many to many are link tables. Nothing is
copied: every navigation is a join that Catalyst plans, and class scans keep their own filters and columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trussflow.session import table


@dataclass(frozen=True)
class EntityClass:
    """``key`` and ``name`` are SQL expressions over the table; ``attrs`` maps CamelCase attribute names to columns."""

    table: str
    key: str
    name: str = "cast(null as string)"
    attrs: dict[str, str] = field(default_factory=dict)
    parent: tuple[str, str] | None = None  # (class, column): containment
    type: tuple[str, str] | None = None  # (class, column): occurrence -> type
    refs: dict[str, tuple[str, str]] = field(default_factory=dict)  # attribute -> (class, column)
    classification: tuple[str, ...] = ()  # columns from leaf to root of the reference system
    psets: dict[str, dict[str, str]] = field(default_factory=dict)  # set -> property -> SQL expression


@dataclass(frozen=True)
class Link:
    """A many-to-many relation ``kind`` from one class to another through a table."""

    kind: str
    source: str
    target: str
    table: str
    source_key: str
    target_key: str


class Model:
    def __init__(self, spark: SparkSession, path: str, classes: dict[str, EntityClass], taxonomy: dict[str, list[str]], links: list[Link] = (), loader: Callable[[str], DataFrame] | None = None):
        self.spark, self.path, self.classes, self.taxonomy, self.links = spark, path, classes, taxonomy, list(links)
        self._load = loader or (lambda name: table(spark, path, name))

    def rows(self, cls: str) -> DataFrame:
        """The class's table with ``id`` (bigint) and ``name`` in front."""
        c = self.classes[cls]
        return self._load(c.table).select(F.expr(c.key).cast("bigint").alias("id"), F.expr(c.name).alias("name"), "*")

    def subtypes(self, name: str, include: bool = True) -> list[str]:
        """Concrete classes of a name, subtypes included; unknown names raise."""
        if name in self.classes:
            return [name]
        if name not in self.taxonomy:
            raise ValueError(f"unknown class {name}")
        return [c for n in self.taxonomy[name] for c in self.subtypes(n)] if include else []

    def ancestors(self, cls: str) -> list[str]:
        """The class and its supertypes, nearest first."""
        out, found = [cls], True
        while found:
            found = False
            for sup, subs in self.taxonomy.items():
                if out[-1] in subs and sup not in out:
                    out.append(sup)
                    found = True
                    break
        return out

    def taxonomy_table(self) -> DataFrame:
        """class, ancestor, depth closure."""
        rows = [(c, a, d) for c in self.classes for d, a in enumerate(self.ancestors(c))]
        return self.spark.createDataFrame(rows, "class string, ancestor string, depth int")

    def by_type(self, name: str, include_subtypes: bool = True) -> DataFrame:
        """class, id, name of every instance."""
        parts = [self.rows(c).select(F.lit(c).alias("class"), "id", "name") for c in self.subtypes(name, include_subtypes)]
        if not parts:
            return self.spark.createDataFrame([], "class string, id bigint, name string")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def by_id(self, cls: str, key: int) -> DataFrame:
        return self.rows(cls).where(F.col("id") == key)

    def references(self, cls: str) -> dict[str, tuple[str, str]]:
        """All reference attributes of a class: attribute -> (target class, column)."""
        c = self.classes[cls]
        out = dict(c.refs)
        if c.parent:
            out.setdefault("parent", c.parent)
        if c.type:
            out.setdefault("type", c.type)
        return out

    def edges(self, classes: list[str] | None = None) -> DataFrame:
        """src_class, src, attr, dst_class, dst of every forward reference."""
        out = None
        for cls in classes or list(self.classes):
            for attr, (target, column) in self.references(cls).items():
                e = self.rows(cls).select(F.lit(cls).alias("src_class"), F.col("id").alias("src"), F.lit(attr).alias("attr"), F.lit(target).alias("dst_class"), F.col(column).cast("bigint").alias("dst")).where("dst is not null")
                out = e if out is None else out.unionByName(e)
        return out if out is not None else self.spark.createDataFrame([], "src_class string, src bigint, attr string, dst_class string, dst bigint")

    def children(self, cls: str) -> list[tuple[str, str]]:
        """Classes contained in ``cls`` and their column."""
        return [(n, c.parent[1]) for n, c in self.classes.items() if c.parent and c.parent[0] == cls]

    def get_inverse(self, cls: str, key: Column | int, with_attribute: bool = False, allow_duplicate: bool = False) -> DataFrame:
        """Instances that refer to one instance."""
        e = self.edges([c for c in self.classes if any(t == cls for t, _ in self.references(c).values())])
        e = e.where((F.col("dst_class") == cls) & (F.col("dst") == key))
        e = e.select("src_class", "src", "attr") if with_attribute else e.select("src_class", "src")
        return e if allow_duplicate else e.distinct()

    def total_inverses(self, cls: str) -> DataFrame:
        """id, n of every referenced instance of ``cls``; counts are aggregated before the shuffle."""
        e = self.edges([c for c in self.classes if any(t == cls for t, _ in self.references(c).values())])
        return e.where(F.col("dst_class") == cls).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))

    def traverse(self, cls: str, key: int, max_levels: int | None = None) -> DataFrame:
        """class, id, level of everything reachable by forward references from one instance.

        The class graph is walked on the driver (it is schema-sized); every level is one join per reference.
        """
        level = self.by_id(cls, key).select(F.lit(cls).alias("class"), "id", F.lit(0).alias("level"))
        out, frontier, depth = level, {cls: level}, 0
        while frontier and (max_levels is None or depth < max_levels):
            depth += 1
            if max_levels is None and depth > len(self.classes):
                raise ValueError("references of classes form a loop: give max_levels, or walk the instances with graph.reach")
            nxt: dict[str, DataFrame] = {}
            for c, rows in frontier.items():
                for _, (target, column) in self.references(c).items():
                    step = self.rows(c).join(rows.select("id").distinct(), "id", "left_semi").select(F.lit(target).alias("class"), F.col(column).cast("bigint").alias("id"), F.lit(depth).alias("level")).where("id is not null").distinct()
                    nxt[target] = nxt[target].unionByName(step).distinct() if target in nxt else step
            for step in nxt.values():
                out = out.unionByName(step)
            frontier = nxt
        return out.groupBy("class", "id").agg(F.min("level").alias("level"))

    def ancestor_join(self, df: DataFrame, cls: str, upto: str | None = None) -> tuple[DataFrame, list[tuple[str, str, str]]]:
        """``df`` with the key and name of every container: [(class, key column, name column)]. Joins are left joins on keys."""
        found, here, column = [], cls, None
        current = df
        while self.classes[here].parent:
            parent, fk = self.classes[here].parent
            fk = fk if column is None else column
            p = self.rows(parent)
            nxt = self.classes[parent].parent
            cols = [F.col("id").alias(f"_{parent}_id"), F.col("name").alias(f"_{parent}_name")]
            if nxt:
                cols.append(F.col(nxt[1]).alias(f"_{parent}_up"))
            current = current.join(p.select(*cols), F.col(fk).cast("bigint") == F.col(f"_{parent}_id"), "left")
            found.append((parent, f"_{parent}_id", f"_{parent}_name"))
            if parent == upto:
                break
            here, column = parent, f"_{parent}_up"
        return current, found


def test_model(spark: SparkSession, path: str) -> Model:
    """The graph over the star-schema tables (see the README for the binding)."""
    classes = {
        "Region": EntityClass("region", "r_regionkey", "r_name", {"Name": "r_name"}),
        "Nation": EntityClass("nation", "n_nationkey", "n_name", {"Name": "n_name"}, parent=("Region", "n_regionkey"), refs={"region": ("Region", "n_regionkey")}),
        "Customer": EntityClass("customer", "c_custkey", "c_name", {"Name": "c_name", "AcctBal": "c_acctbal", "MktSegment": "c_mktsegment"}, parent=("Nation", "c_nationkey"), refs={"nation": ("Nation", "c_nationkey")}),
        "Supplier": EntityClass("supplier", "s_suppkey", "s_name", {"Name": "s_name", "AcctBal": "s_acctbal"}, parent=("Nation", "s_nationkey"), refs={"nation": ("Nation", "s_nationkey")}),
        "Part": EntityClass("part", "p_partkey", "p_name", {"Name": "p_name", "Brand": "p_brand", "Type": "p_type", "Size": "p_size", "RetailPrice": "p_retailprice"}, classification=("p_brand", "p_type"),
                            psets={"Pset_Part": {"Size": "p_size", "Brand": "p_brand", "RetailPrice": "p_retailprice"}}),
        "Order": EntityClass("orders", "o_orderkey", attrs={"Status": "o_orderstatus", "TotalPrice": "o_totalprice", "OrderDate": "o_orderdate", "Priority": "o_orderpriority"}, parent=("Customer", "o_custkey"), refs={"customer": ("Customer", "o_custkey")}),
        "Lineitem": EntityClass("lineitem", "l_orderkey * 16 + l_linenumber", attrs={"Quantity": "l_quantity", "ExtendedPrice": "l_extendedprice", "Discount": "l_discount", "Tax": "l_tax", "ReturnFlag": "l_returnflag", "ShipDate": "l_shipdate"},
                                parent=("Order", "l_orderkey"), type=("Part", "l_partkey"), refs={"order": ("Order", "l_orderkey"), "part": ("Part", "l_partkey"), "supplier": ("Supplier", "l_suppkey")}),
        "Document": EntityClass("documents", "doc_id", "source", {"Lang": "lang", "Source": "source", "NChars": "n_chars", "ModelKey": "model_key"}),
        "Event": EntityClass("events", "event_id", "event_type", {"EventType": "event_type", "UserId": "user_id", "Value": "value"}, psets={"Props": {"k": "cast(get_json_object(props, '$.k') as double)"}}),
    }
    taxonomy = {"Thing": ["Party", "Place", "Item", "Order", "Doc"], "Party": ["Customer", "Supplier"], "Place": ["Region", "Nation"], "Item": ["Part", "Lineitem"], "Doc": ["Document", "Event"]}
    links = [Link("material", "Part", "Supplier", "lineitem", "l_partkey", "l_suppkey"), Link("group", "Supplier", "Order", "lineitem", "l_suppkey", "l_orderkey")]
    return Model(spark, path, classes, taxonomy, links)


test_model.__test__ = False

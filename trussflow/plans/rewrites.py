"""Queries of the row rewrites, recipes, navigation helpers and trees, bound to the test tables, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trussflow.operators import audit, hierarchy, planning, report
from trussflow.operators.store import RECIPES, Store
from trussflow.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

_STORE = """WITH elements AS (
SELECT CAST(n_nationkey + 1000 AS BIGINT) AS id, 'Storey' AS class, n_name AS name, CAST(NULL AS VARCHAR) AS predefined_type, CAST(n_nationkey AS DOUBLE) AS z FROM nation
UNION ALL SELECT c_custkey + 100000, 'Space', c_name, c_mktsegment, c_acctbal FROM customer
UNION ALL SELECT p_partkey + 10000000, 'ElementType', p_brand, p_type, CAST(p_size AS DOUBLE) FROM part
UNION ALL SELECT s_suppkey + 20000000, 'Element', s_name, CASE WHEN s_suppkey % 3 = 0 THEN 'NOTDEFINED' WHEN s_suppkey % 3 = 1 THEN 'OWN' END, s_acctbal FROM supplier),
rels AS (
SELECT 'aggregates' AS kind, CAST(c_nationkey + 1000 AS BIGINT) AS relating, c_custkey + 100000 AS related FROM customer
UNION ALL SELECT 'contained', s_suppkey % 90 + 100001, s_suppkey + 20000000 FROM supplier
UNION ALL SELECT 'type', s_suppkey % 90 + 10000001, s_suppkey + 20000000 FROM supplier
UNION ALL SELECT 'nests', s_suppkey + 20000000, 29999999 FROM supplier WHERE s_suppkey = 5
UNION ALL SELECT 'classification', CAST(7 AS BIGINT), s_suppkey + 20000000 FROM supplier WHERE s_suppkey % 4 = 0
UNION ALL SELECT 'material', CAST(s_suppkey % 5 AS BIGINT), s_suppkey + 20000000 FROM supplier),
psets AS (
SELECT p_partkey + 10000000 AS id, 'Pset_Part' AS pset_name, 'Size' AS name, CAST(p_size AS VARCHAR) AS value FROM part
UNION ALL SELECT p_partkey + 10000000, 'Pset_Part', 'Brand', p_brand FROM part
UNION ALL SELECT s_suppkey + 20000000, 'Pset_Part', 'Size', '7' FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT s_suppkey + 20000000, 'Pset_Own', 'Weight', CAST(s_suppkey % 10 + 1 AS VARCHAR) FROM supplier)
"""


def test_store(spark, d) -> Store:
    """A store over the star-schema tables: storeys, spaces, types and elements."""
    n, c, p, s = (table(spark, d, t) for t in ("nation", "customer", "part", "supplier"))
    k = F.col("s_suppkey")
    union = lambda *parts: reduce(DataFrame.unionAll, parts)
    el = lambda df, i, cls, name, kind, z: df.select(i.cast("bigint").alias("id"), F.lit(cls).alias("class"), name.alias("name"), kind.cast("string").alias("predefined_type"), z.cast("double").alias("z"))
    rel = lambda df, kind, a, b: df.select(F.lit(kind).alias("kind"), a.cast("bigint").alias("relating"), b.cast("bigint").alias("related"))
    ps = lambda df, i, pset, name, v: df.select(i.cast("bigint").alias("id"), F.lit(pset).alias("pset_name"), F.lit(name).alias("name"), v.cast("string").alias("value"))
    space, kind, element = F.col("c_custkey") + 100_000, F.col("p_partkey") + 10_000_000, k + 20_000_000
    elements = union(
        el(n, F.col("n_nationkey") + 1000, "Storey", F.col("n_name"), F.lit(None), F.col("n_nationkey")), el(c, space, "Space", F.col("c_name"), F.col("c_mktsegment"), F.col("c_acctbal")),
        el(p, kind, "ElementType", F.col("p_brand"), F.col("p_type"), F.col("p_size")), el(s, element, "Element", F.col("s_name"), F.when(k % 3 == 0, "NOTDEFINED").when(k % 3 == 1, "OWN"), F.col("s_acctbal")),
    )
    rels = union(
        rel(c, "aggregates", F.col("c_nationkey") + 1000, space), rel(s, "contained", k % 90 + 100_001, element), rel(s, "type", k % 90 + 10_000_001, element), rel(s.where("s_suppkey = 5"), "nests", element, F.lit(29_999_999)),
        rel(s.where("s_suppkey % 4 = 0"), "classification", F.lit(7), element), rel(s, "material", k % 5, element),
    )
    psets = union(ps(p, kind, "Pset_Part", "Size", F.col("p_size")), ps(p, kind, "Pset_Part", "Brand", F.col("p_brand")), ps(s.where("s_suppkey % 2 = 0"), element, "Pset_Part", "Size", F.lit("7")), ps(s, element, "Pset_Own", "Weight", k % 10 + 1))
    return Store({"elements": elements, "rels": rels, "psets": psets})


test_store.__test__ = False


def query(sql: str | None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, d: f(test_store(spark, d))
        if sql:
            SQL[key] = _STORE + sql
        return f

    return add


_odd = lambda s: s.elements.where("class = 'Element' and id % 2 = 1")
_ODD = "(SELECT id FROM elements WHERE class = 'Element' AND id % 2 = 1)"

# ---------------------------------------------------------------- rewrites


@query(f"SELECT kind, relating, related FROM rels WHERE NOT (kind = 'contained' AND related IN {_ODD}) UNION ALL SELECT 'contained', 100007, id FROM {_ODD}")
def mutate_assign(s):
    return s.call("spatial.assign_container", products=_odd(s), relating=100_007).rels


@query(f"SELECT * FROM rels UNION ALL SELECT 'material', 3, id FROM {_ODD} WHERE id NOT IN (SELECT related FROM rels WHERE kind = 'material' AND relating = 3)")
def mutate_assign_many(s):
    return s.call("material.assign_material", products=_odd(s), relating=3).rels


@query(f"SELECT * FROM rels WHERE NOT (kind = 'type' AND related IN {_ODD})")
def mutate_unassign(s):
    return s.call("type.unassign_type", products=_odd(s)).rels


@query(f"SELECT id, class, CASE WHEN id IN {_ODD} THEN upper(name) ELSE name END AS name, predefined_type, z FROM elements")
def mutate_edit(s):
    return s.call("attribute.edit_attributes", products=_odd(s), attributes={"name": F.upper("name")}).elements


@query(f"SELECT id, CASE WHEN id IN {_ODD} THEN 'Proxy' ELSE class END AS class FROM elements")
def mutate_reassign_class(s):
    return s.call("root.reassign_class", products=_odd(s), ifc_class="Proxy").elements.select("id", "class")


@query("SELECT id FROM elements WHERE id <> 1003 AND id NOT IN (SELECT related FROM rels WHERE kind = 'aggregates' AND relating = 1003) AND id NOT IN (SELECT related FROM rels WHERE kind = 'contained' AND relating IN (SELECT related FROM rels WHERE kind = 'aggregates' AND relating = 1003))")
def mutate_remove_deep(s):
    return s.call("root.remove_product", products=s.elements.where("id = 1003"), deep=True).elements.select("id")


@query(f"SELECT id, pset_name, name, value FROM psets WHERE id IN {_ODD} OR id IN (SELECT id + 5000000 FROM {_ODD}) UNION ALL SELECT id + 5000000, pset_name, name, value FROM psets WHERE id IN {_ODD}")
def mutate_copy(s):
    odd = _odd(s).select("id")
    both = odd.union(odd.select(F.col("id") + 5_000_000))
    return s.call("root.copy_class", products=odd, offset=5_000_000).psets.join(both, "id", "left_semi")


@query(f"SELECT * FROM psets WHERE NOT (pset_name = 'Pset_Own' AND name = 'Weight' AND id IN {_ODD}) UNION ALL SELECT id, 'Pset_Own', 'Note', 'x' FROM {_ODD}")
def mutate_edit_pset(s):
    return s.call("pset.edit_pset", products=_odd(s), pset="Pset_Own", properties={"Weight": None, "Note": "x"}).psets


@query(f"SELECT id, 'Pset_Own' AS pset_name, 'Note' AS name, 'n' AS value FROM {_ODD}")
def set_value(s):
    return s.set_value(_odd(s), "Pset_Own.Note", "n").set_value(_odd(s), "z", "1.5").psets.where("name = 'Note'")


@query("SELECT id, class, name, predefined_type, z FROM elements")
def mutate_undo_redo(s):
    s.edit(_odd(s), {"name": F.lit("x")}).remove(_odd(s))
    for _ in range(4):
        s.undo()
    s.redo().undo()
    return s.elements


@query(f"SELECT 0 AS txn, 'attribute.edit_attributes' AS op, side, count(*) AS n FROM {_ODD}, (VALUES ('removed'), ('added')) t(side) GROUP BY side")
def mutate_log(s):
    s.call("attribute.edit_attributes", products=_odd(s), attributes={"z": F.col("z") + 1})
    return s.log().groupBy("txn", "op", "side").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- navigation helpers


@query("SELECT related AS id, relating AS type_id FROM rels WHERE kind = 'type' UNION ALL SELECT DISTINCT relating, relating FROM rels WHERE kind = 'type'")
def get_type(s):
    return s.get_type()


@query("SELECT relating AS id, related AS other FROM rels WHERE kind = 'type'")
def get_types(s):
    return s.related("type", up=False)


@query("SELECT related AS id, relating AS parent FROM rels WHERE kind IN ('aggregates', 'contained', 'nests')")
def get_parent(s):
    return s.get_parent()


@query("SELECT related AS id FROM rels WHERE kind = 'aggregates' AND relating = 1003 UNION SELECT related FROM rels WHERE kind = 'contained' AND relating IN (SELECT related FROM rels WHERE kind = 'aggregates' AND relating = 1003)")
def get_decomposition(s):
    return s.get_decomposition(s.elements.where("id = 1003"))


@query("SELECT id, pset_name, name, value FROM psets UNION ALL SELECT r.related, p.pset_name, p.name, p.value FROM rels r JOIN psets p ON p.id = r.relating WHERE r.kind = 'type' AND NOT EXISTS (SELECT 1 FROM psets o WHERE o.id = r.related AND o.pset_name = p.pset_name AND o.name = p.name)")
def get_psets(s):
    return s.get_psets()


@query("SELECT e.id, coalesce(nullif(e.predefined_type, 'NOTDEFINED'), nullif(t.predefined_type, 'NOTDEFINED')) AS predefined_type FROM elements e LEFT JOIN rels r ON r.kind = 'type' AND r.related = e.id LEFT JOIN elements t ON t.id = r.relating")
def get_predefined_type(s):
    return s.get_predefined_type()


@query("SELECT relating AS material, count(*) AS members FROM rels WHERE kind = 'material' GROUP BY 1")
def q_materials(s):
    return s.related("material", up=False).groupBy(F.col("id").alias("material")).agg(F.count("*").alias("members"))


# ---------------------------------------------------------------- audit facets over the store

_OWN = "(SELECT id, pset_name, name, value FROM psets UNION ALL SELECT r.related, p.pset_name, p.name, p.value FROM rels r JOIN psets p ON p.id = r.relating WHERE r.kind = 'type' AND NOT EXISTS (SELECT 1 FROM psets o WHERE o.id = r.related AND o.pset_name = p.pset_name AND o.name = p.name))"
_PTYPE = "(SELECT e.id, coalesce(nullif(e.predefined_type, 'NOTDEFINED'), nullif(t.predefined_type, 'NOTDEFINED')) AS p FROM elements e LEFT JOIN rels r ON r.kind = 'type' AND r.related = e.id LEFT JOIN elements t ON t.id = r.relating)"


@query(f"SELECT e.id FROM elements e JOIN {_PTYPE} q ON q.id = e.id WHERE e.class = 'Element' AND q.p = 'OWN'")
def ids_entity(s):
    return audit.EntityFacet("ELEMENT", "OWN").ids(s)


@query(f"SELECT id FROM {_OWN} WHERE pset_name = 'Pset_Part' AND name = 'Size' GROUP BY id HAVING bool_and(CAST(value AS DOUBLE) >= 5 AND CAST(value AS DOUBLE) < 20)")
def ids_property(s):
    return audit.PropertyFacet("Pset_Part", "Size", audit.Restriction(min_inclusive=5, max_exclusive=20)).ids(s)


@query("SELECT DISTINCT related AS id FROM rels WHERE kind = 'classification' AND relating = 7")
def ids_classification(s):
    return audit.RelatedFacet("classification", "7").ids(s)


@query("SELECT DISTINCT related AS id FROM rels WHERE kind = 'material' AND relating IN (1, 3)")
def ids_material(s):
    return audit.RelatedFacet("material", audit.Restriction(enumeration=("1", "3"))).ids(s)


@query("SELECT related AS id FROM rels WHERE kind = 'aggregates' UNION SELECT related FROM rels WHERE kind = 'contained' AND relating IN (SELECT related FROM rels WHERE kind = 'aggregates') UNION SELECT related FROM rels WHERE kind = 'nests'")
def ids_partof(s):
    return audit.PartOfFacet("Storey").ids(s)


@query(f"""SELECT 'parts' AS specification, k AS requirement, e.id AS entity, CASE k WHEN 0 THEN coalesce(o.value IN ('7', '9'), false) WHEN 1 THEN NOT coalesce(c.relating = 7, false) ELSE coalesce(o.value = '7', true) END AS passed
FROM (SELECT id FROM elements WHERE class = 'Element') e CROSS JOIN (VALUES (0), (1), (2)) t(k) LEFT JOIN {_OWN} o ON o.id = e.id AND o.pset_name = 'Pset_Part' AND o.name = 'Size' LEFT JOIN rels c ON c.kind = 'classification' AND c.related = e.id""")
def ids_store_audit(s):
    size = lambda v: audit.PropertyFacet("Pset_Part", "Size", v)
    return audit.store_audit(s, "parts", [audit.EntityFacet("Element")], [(size(audit.Restriction(enumeration=("7", "9"))), "required"), (audit.RelatedFacet("classification", "7"), "prohibited"), (size("7"), "optional")])


# ---------------------------------------------------------------- recipes

_recipe = lambda name, *a, **k: lambda s: RECIPES[name](s, *a, **k)


def _add(key: str, sql: str, run, pick) -> None:
    query(sql, key)(lambda s: pick(run(s)))


_add("recipe_nest_to_aggregate", "SELECT CASE WHEN kind = 'nests' THEN 'aggregates' ELSE kind END AS kind, relating, related FROM rels", _recipe("convert_nest_to_aggregate"), lambda s: s.rels)
_add("recipe_properties_to_quantities", "SELECT id, CASE WHEN name = 'Size' THEN 'Qto_Quantities' ELSE pset_name END AS pset_name, CASE WHEN name = 'Size' THEN 'Length' ELSE name END AS name, value FROM psets", _recipe("convert_properties_to_quantities", "Size", "Length"), lambda s: s.psets)
_add("recipe_merge_types", "SELECT r.related AS id, CAST(k.keep AS BIGINT) AS type_id FROM rels r JOIN (SELECT id, min(id) OVER (PARTITION BY name) AS keep FROM elements WHERE id IN (SELECT relating FROM rels WHERE kind = 'type')) k ON k.id = r.relating WHERE r.kind = 'type'", _recipe("merge_duplicate_types"), lambda s: s.related("type").withColumnRenamed("other", "type_id"))
_add("recipe_purge", "SELECT * FROM rels WHERE kind = 'type'", _recipe("purge_data", ["type"]), lambda s: s.rels)
_add("recipe_remove_classification", "SELECT * FROM rels WHERE NOT (kind = 'classification' AND relating = 7)", _recipe("remove_classification", 7), lambda s: s.rels)
_add("recipe_classification_to_types", "SELECT DISTINCT CAST(7 AS BIGINT) AS system, t.relating AS id FROM rels c JOIN rels t ON t.kind = 'type' AND t.related = c.related WHERE c.kind = 'classification'", _recipe("classification_to_types"), lambda s: s.rels.where("kind = 'classification'").select(F.col("relating").alias("system"), F.col("related").alias("id")))
_add("recipe_offset_elevations", "SELECT id, CASE WHEN class = 'Storey' THEN z + 2.5 ELSE z END AS z FROM elements", _recipe("offset_elevations", 2.5, "Storey"), lambda s: s.elements.select("id", "z"))
_add("recipe_reset_coordinates", "SELECT id, z - (SELECT min_by(z, id) FROM elements WHERE abs(z) > 9000) AS z FROM elements", _recipe("reset_absolute_coordinates", ("z",), 9000), lambda s: s.elements.select("id", "z"))
_add("recipe_convert_unit", "SELECT id, z * 0.5 AS z FROM elements", _recipe("convert_length_unit", ["z"], 0.5), lambda s: s.elements.select("id", "z"))
_add("recipe_migrate", "SELECT id, CASE class WHEN 'Storey' THEN 'BuildingStorey' WHEN 'Element' THEN 'BuiltElement' ELSE class END AS class FROM elements", _recipe("migrate", {"Storey": "BuildingStorey", "Element": "BuiltElement"}), lambda s: s.elements.select("id", "class"))
_add("recipe_regenerate_ids", "SELECT id, CASE WHEN row_number() OVER (PARTITION BY name ORDER BY id) > 1 THEN left(sha256(name || '|' || id), 22) ELSE name END AS name FROM elements WHERE name IS NOT NULL", _recipe("regenerate_ids", "name"), lambda s: s.elements.select("id", "name").where("name is not null"))
query("SELECT r.related AS id, p.pset_name, p.name, p.value FROM rels r JOIN psets p ON p.id = r.relating WHERE r.kind = 'type' AND NOT EXISTS (SELECT 1 FROM psets o WHERE o.id = r.related AND o.pset_name = p.pset_name AND o.name = p.name) UNION ALL SELECT id, pset_name, name, value FROM psets WHERE id >= 20000000", "recipe_unshare_psets")(lambda s: RECIPES["unshare_psets"](s, s.elements.where("class = 'Element'")).psets.where("id >= 20000000"))
_add("recipe_fractions", "SELECT r.related AS id, CAST(round(CAST(p.value AS DOUBLE) / sum(CAST(p.value AS DOUBLE)) OVER (PARTITION BY r.relating), 6) AS VARCHAR) AS value FROM rels r JOIN psets p ON p.id = r.related AND p.name = 'Weight' WHERE r.kind = 'material'", _recipe("assign_fractions", "Pset_Share", "Share", "Weight"), lambda s: s.psets.where("name = 'Share'").select("id", "value"))
query("WITH RECURSIVE up AS (SELECT id FROM elements WHERE id = 20000009 UNION SELECT r.relating FROM rels r JOIN up ON up.id = r.related WHERE r.kind IN ('aggregates', 'contained', 'nests', 'type')) SELECT e.id, e.class FROM elements e JOIN up ON up.id = e.id".replace("WITH RECURSIVE up", ", up"), "recipe_extract")(lambda s: RECIPES["extract_elements"](s, s.elements.where("id = 20000009")).elements.select("id", "class"))
SQL["recipe_extract"] = SQL["recipe_extract"].replace("WITH elements", "WITH RECURSIVE elements", 1)


# ---------------------------------------------------------------- trees of schedules and costs


def _tree(spark, d):
    """Schedules as trees: customers over their orders; ids of orders shifted."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("code"), F.lit(None).cast("bigint").alias("parent"))
    o = table(spark, d, "orders").select((F.col("o_orderkey") + 10_000_000).alias("id"), F.col("o_orderkey").cast("string").alias("code"), F.col("o_custkey").alias("parent"))
    return c.unionByName(o)


def q_schedule(spark, d):
    return hierarchy.full_hierarchy(_tree(spark, d), "/", doublings=1).where("depth <= 1")


def agg_date_rollup(spark, d):
    """First and last date of every node and all below it."""
    pairs = hierarchy.ancestor_pairs(_tree(spark, d))
    dates = table(spark, d, "orders").select((F.col("o_orderkey") + 10_000_000).alias("descendant"), F.to_date("o_orderdate").alias("day"))
    return pairs.join(dates, "descendant").groupBy(F.col("ancestor").alias("id")).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def q_cost(spark, d):
    """Own and total cost of every node of the schedule tree."""
    v = table(spark, d, "orders").select((F.col("o_orderkey") + 10_000_000).alias("id"), F.col("o_totalprice").alias("value"))
    return planning.rollup(v, hierarchy.ancestor_pairs(_tree(spark, d))).select("id", "total")


def scan_csv_cost(spark, d):
    """Parents of an indented list: nations under their regions, in one order."""
    n = table(spark, d, "nation").select((F.col("n_regionkey") * 100 + F.col("n_nationkey") + 1).cast("bigint").alias("row"), F.lit(1).alias("level"))
    r = table(spark, d, "region").select((F.col("r_regionkey") * 100).cast("bigint").alias("row"), F.lit(0).alias("level"))
    return planning.parse_csv_hierarchy(r.unionByName(n), "level", "row")


def agg_productivity(spark, d):
    """Output per unit of resource and the work still needed, per supplier."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("resource")).agg(report.exact_sum(F.col("l_quantity")).alias("output"), report.exact_sum(F.col("l_discount")).alias("usage"))
    return g.select("resource", F.round(F.try_divide("output", "usage"), 6).alias("productivity"))


def agg_resource_cost(spark, d):
    """Resource costs summed into the cost item they are assigned to."""
    li, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    use = li.groupBy("l_orderkey", "l_suppkey").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("q"))
    cost = use.join(s, use.l_suppkey == s.s_suppkey).groupBy(F.col("l_orderkey").alias("item")).agg(F.sum((F.col("q") * F.col("s_acctbal").cast("decimal(18,2)")).cast("decimal(28,4)")).cast("double").alias("cost"))
    return cost


def geom_filters(spark, d):
    """Wildcard attribute filter: * and ? over the whole value."""
    pattern = "^" + "*#0*?5".replace("*", ".*").replace("?", ".") + "$"
    return table(spark, d, "supplier").where(F.col("s_name").rlike(pattern)).select(F.col("s_suppkey").alias("id"))


def as_of(spark, d):
    """Last purchase of the same user before each error (extension): one window over both kinds, no range join."""
    from pyspark.sql import Window

    e = table(spark, d, "events").where("event_type in ('error', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("purchase", last).where("event_type = 'error'").select("event_id", "purchase")


_PAIRS = "SELECT c_custkey AS ancestor, c_custkey AS d FROM customer UNION ALL SELECT o_orderkey + 10000000, o_orderkey + 10000000 FROM orders UNION ALL SELECT o_custkey, o_orderkey + 10000000 FROM orders JOIN customer ON c_custkey = o_custkey"
for _f, _sql in (
    (q_schedule, "SELECT c_custkey AS id, c_custkey AS root_id, CAST(0 AS BIGINT) AS depth, c_name AS code_path FROM customer UNION ALL SELECT o_orderkey + 10000000, CASE WHEN c_custkey IS NULL THEN o_orderkey + 10000000 ELSE c_custkey END, CASE WHEN c_custkey IS NULL THEN 0 ELSE 1 END, coalesce(c_name || '/', '') || o_orderkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey"),
    (agg_date_rollup, f"SELECT p.ancestor AS id, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day FROM ({_PAIRS}) p JOIN orders ON o_orderkey + 10000000 = p.d GROUP BY 1"),
    (q_cost, f"SELECT p.ancestor AS id, CAST(sum(CAST(o_totalprice AS DECIMAL(28,6))) AS DOUBLE) AS total FROM ({_PAIRS}) p JOIN orders ON o_orderkey + 10000000 = p.d GROUP BY 1"),
    (scan_csv_cost, "SELECT CAST(n_regionkey * 100 + n_nationkey + 1 AS BIGINT) AS row, 1 AS level, CAST(n_regionkey * 100 AS BIGINT) AS parent FROM nation UNION ALL SELECT r_regionkey * 100, 0, NULL FROM region"),
    (agg_productivity, "SELECT l_suppkey AS resource, round(CAST(sum(CAST(l_quantity AS DECIMAL(28,6))) AS DOUBLE) / CAST(sum(CAST(l_discount AS DECIMAL(28,6))) AS DOUBLE), 6) AS productivity FROM lineitem GROUP BY 1"),
    (agg_resource_cost, "SELECT l_orderkey AS item, CAST(sum(CAST(CAST(l_quantity AS DECIMAL(18,2)) * CAST(s_acctbal AS DECIMAL(18,2)) AS DECIMAL(28,4))) AS DOUBLE) AS cost FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1"),
    (geom_filters, "SELECT s_suppkey AS id FROM supplier WHERE regexp_matches(s_name, '^.*#0.*.5$')"),
    (as_of, "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS purchase, event_type FROM events WHERE event_type IN ('error', 'purchase')"),
):
    QUERIES[_f.__name__] = _f
    SQL[_f.__name__] = _sql
SQL["as_of"] = f"SELECT event_id, purchase FROM ({SQL['as_of']}) WHERE event_type = 'error'"

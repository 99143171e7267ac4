"""Every operator as a query on the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trussflow.functions import formatting as fmt
from trussflow.functions import scalar as sc
from trussflow.model import test_model
from trussflow.operators import audit, compare, hierarchy, planning, report, rules, spatial
from trussflow.plans import express
from trussflow.plans.selector import Selector
from trussflow.session import global_rank, shared_dir, table
from trussflow.sources import spf
from trussflow.streaming import stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its name, with its SQL if SQL can state it."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def _select(key: str, text: str, sql: str) -> None:
    QUERIES[key] = lambda spark, d: Selector(test_model(spark, d)).select(text)
    SQL[key] = sql


# ---------------------------------------------------------------- facet filters

_C = "SELECT 'Customer' AS class, c_custkey AS id, c_name AS name FROM customer"
_S = "SELECT 'Supplier' AS class, s_suppkey AS id, s_name AS name FROM supplier"
_P = "SELECT 'Part' AS class, p_partkey AS id, p_name AS name FROM part"
_L = "SELECT 'Lineitem' AS class, l_orderkey * 16 + l_linenumber AS id, CAST(NULL AS VARCHAR) AS name FROM lineitem"
_O = "SELECT 'Order' AS class, o_orderkey AS id, CAST(NULL AS VARCHAR) AS name FROM orders"
_E = "SELECT 'Event' AS class, event_id AS id, event_type AS name FROM events"
_D = "SELECT 'Document' AS class, doc_id AS id, source AS name FROM documents"

_select("facet_entity", "Party", f"{_C} UNION ALL {_S}")
_select("facet_entity_subtract", "Party, ! Supplier", _C)
_select("facet_entity_lead_subtract", "! Supplier", f"{_S} WHERE false")
_select("facet_instance", "#7 + #12", " UNION ".join(f"{q} WHERE {k} IN (7, 12)" for q, k in ((_C, "c_custkey"), (_S, "s_suppkey"), (_P, "p_partkey"), (_O, "o_orderkey"), (_E, "event_id"), (_D, "doc_id"), (_L, "l_orderkey * 16 + l_linenumber"), ("SELECT 'Nation', n_nationkey, n_name FROM nation", "n_nationkey"), ("SELECT 'Region', r_regionkey, r_name FROM region", "r_regionkey"))))
_select("facet_attribute_eq", "Customer, MktSegment=BUILDING", f"{_C} WHERE c_mktsegment = 'BUILDING'")
_select("facet_attribute_neq", "Customer, MktSegment!=BUILDING", f"{_C} WHERE NOT coalesce(c_mktsegment = 'BUILDING', false)")
_select("facet_cmp_numeric", "Lineitem, Quantity>=45", f"{_L} WHERE l_quantity >= 45")
_select("facet_cmp_chain", "Lineitem, Quantity>=10, Quantity<12, Discount>0.05", f"{_L} WHERE l_quantity >= 10 AND l_quantity < 12 AND l_discount > 0.05")
_select("facet_cmp_text_order", "Part, Brand>X", f"{_P} WHERE p_brand = 'X'")
_select("facet_int_coercion", "Part, Size=1.5", f"{_P} WHERE false")
_select("facet_contains", 'Part, Name*="red"', f"{_P} WHERE contains(p_name, 'red')")
_select("facet_not_contains", 'Part, Name!*="red"', f"{_P} WHERE NOT coalesce(contains(p_name, 'red'), false)")
_select("facet_regex_prefix", "Part, Brand=/Brand#1/", f"{_P} WHERE regexp_matches(p_brand, '^(?:Brand#1)')")
_select("facet_null", "Document, Lang=NULL", f"{_D} WHERE lang IS NULL")
_select("facet_not_null", "Document, Lang!=NULL", f"{_D} WHERE lang IS NOT NULL")
_select("facet_bool_identity", "Customer, MktSegment=TRUE", f"{_C} WHERE false")
_select("facet_unknown_attribute", "Customer, Missing!=x", _C)
_select("facet_union_groups", "Customer, AcctBal>9000 + Supplier, AcctBal>9000", f"{_C} WHERE c_acctbal > 9000 UNION {_S} WHERE s_acctbal > 9000")
_select("facet_comment", "Customer /* all */, AcctBal<0 +", f"{_C} WHERE c_acctbal < 0")
_select("facet_type", "Lineitem, type=/.*widget/", f"{_L} JOIN part ON p_partkey = l_partkey WHERE regexp_matches(p_name, '^(?:.*widget)')")
_select("facet_type_neq", "Lineitem, type!=/.*ring/", f"{_L} WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND regexp_matches(p_name, '^(?:.*ring)'))")
_select("facet_material", "Part, material=7", f"{_P} WHERE EXISTS (SELECT 1 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey = p_partkey AND (s_suppkey = 7 OR s_name = '7'))")
_select("facet_material_neq", "Part, material!=7", f"{_P} WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_suppkey = 7)")
_select("facet_group", "Supplier, group=33", f"{_S} WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_orderkey = 33)")
_select("facet_property_literal", "Event, Props.k>50", f"{_E} WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50")
_select("facet_property_regex", "Event, /Pro.*/./k/=7", f"{_E} WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) = 7")
_select("facet_property_missing", "Event, Other.k!=7", _E)
_select("facet_classification", "Part, classification=/.*#2.*/", f"{_P} WHERE regexp_matches(p_brand, '^(?:.*#2.*)') OR regexp_matches(p_type, '^(?:.*#2.*)')")
_select("facet_location", "Customer, location=ASIA", f"{_C} JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' OR n_name = 'ASIA'")
_select("facet_location_deep", "Lineitem, location=NATION_3", f"{_L} JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_name = 'NATION_3'")
_select("facet_parent", "Order, parent=NATION_3", f"{_O} JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_name = 'NATION_3'")
_select("facet_parent_neq", "Order, parent!=NATION_3", f"{_O} JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_name <> 'NATION_3'")
_select("facet_parent_self", "Place, parent=NATION_3", "SELECT 'Nation' AS class, n_nationkey AS id, n_name AS name FROM nation WHERE n_name = 'NATION_3' AND (EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey) OR EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey))")
_select("facet_query_path", 'Customer, query:"nation.region.Name"=ASIA', f"{_C} JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'")
_select("facet_query_count", 'Order, query:"lines.count">6', f"{_O} WHERE (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) > 6")
_select("facet_query_list", 'Order, query:"lines.part.Brand"=/.*#17/', f"{_O} WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = o_orderkey AND regexp_matches(p_brand, '^(?:.*#17)'))")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Customers of a region with a positive balance, counted per nation: a selection joined with a path."""
    s = Selector(test_model(spark, d))
    chosen = s.select("Customer, location=ASIA, AcctBal>0")
    return chosen.join(s.path("Customer", "nation.Name"), "id").groupBy(F.col("value").alias("nation")).agg(F.count("*").alias("customers"))


QUERIES["q_select"] = flagship
SQL["q_select"] = "SELECT n_name AS nation, count(*) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' AND c_acctbal > 0 GROUP BY 1"


# ---------------------------------------------------------------- navigation


@query("SELECT 'Customer' AS class, c_custkey AS id, c_name AS name FROM customer WHERE c_custkey = 42")
def by_id(spark, d):
    return test_model(spark, d).by_id("Customer", 42).select(F.lit("Customer").alias("class"), "id", "name")


@query("SELECT doc_id AS id, text FROM documents WHERE md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents))")
def by_guid(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.md5("text").alias("guid"))
    first = docs.agg(F.min_by("guid", "id").alias("guid"))
    return docs.join(first, "guid", "left_semi").select("id", "text")


@query(f"{_P} UNION ALL {_L}")
def by_type(spark, d):
    return test_model(spark, d).by_type("Item")


@query("SELECT * FROM (VALUES ('Customer'), ('Supplier'), ('Part'), ('Lineitem'), ('Order'), ('Document'), ('Event'), ('Nation'), ('Region')) t(class)")
def types_present(spark, d):
    return test_model(spark, d).by_type("Thing").select("class").distinct()


@query("SELECT * FROM (VALUES ('Customer', 'Customer', 0), ('Customer', 'Party', 1), ('Customer', 'Thing', 2), ('Lineitem', 'Lineitem', 0), ('Lineitem', 'Item', 1), ('Lineitem', 'Thing', 2)) t(class, ancestor, depth)")
def is_a(spark, d):
    return test_model(spark, d).taxonomy_table().where(F.col("class").isin("Customer", "Lineitem"))


@query("SELECT l_orderkey * 16 + l_linenumber AS id, p_name AS value FROM lineitem JOIN part ON p_partkey = l_partkey")
def path_attr(spark, d):
    return Selector(test_model(spark, d)).path("Lineitem", "type.Name")


@query("SELECT o_orderkey AS id, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS value FROM orders")
def path_count(spark, d):
    return Selector(test_model(spark, d)).path("Order", "lines.count")


@query("""WITH n AS (SELECT p_partkey AS id, CAST(round_even(p_size * 8 / 7.0, 0) AS BIGINT) AS e FROM part), p AS (SELECT id, e // 96 AS feet, (e % 96) // 8 AS whole, e % 8 AS r, gcd(e % 8, 8) AS g FROM n)
SELECT id, feet || chr(39) || CASE WHEN whole = 0 AND r = 0 THEN '' ELSE ' - ' || whole || CASE WHEN r = 0 THEN '' ELSE ' ' || (r // g) || '/' || (8 // g) END || chr(34) END AS text FROM p""")
def fmt_imperial_eighths(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), fmt.fmt_imperial_length(F.col("p_size") / 84, 8).alias("text"))


@query("SELECT o_orderkey AS id, string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS brands FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1")
def path_list_flatten(spark, d):
    return Selector(test_model(spark, d)).path("Order", "lines.part.Brand").select("id", F.array_join("value", ", ").alias("brands"))


@query("SELECT 'Order' AS src_class, o_orderkey AS src, attr FROM orders, (VALUES ('customer'), ('parent')) t(attr) WHERE o_custkey = 10")
def get_inverse(spark, d):
    return test_model(spark, d).get_inverse("Customer", 10, with_attribute=True)


@query("SELECT o_custkey AS id, 2 * count(*) AS n FROM orders GROUP BY 1")
def total_inverses(spark, d):
    return test_model(spark, d).total_inverses("Customer")


@query("SELECT l_partkey AS id, count(*) AS n FROM lineitem GROUP BY 1")
def inverse_attr(spark, d):
    m = test_model(spark, d)
    return m.edges(["Lineitem"]).where("attr = 'type'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT * FROM orders WHERE o_orderkey = 33), c AS (SELECT DISTINCT c.* FROM customer c JOIN o ON c_custkey = o_custkey), n AS (SELECT DISTINCT n.* FROM nation n JOIN c ON n_nationkey = c_nationkey)
SELECT 'Order' AS class, o_orderkey AS id, 0 AS level FROM o UNION ALL SELECT 'Customer', c_custkey, 1 FROM c UNION ALL SELECT 'Nation', n_nationkey, 2 FROM n UNION ALL SELECT DISTINCT 'Region', n_regionkey, 3 FROM n""")
def traverse_levels(spark, d):
    return test_model(spark, d).traverse("Order", 33)


@query("SELECT 'Order' AS class, o_orderkey AS id, 0 AS level FROM orders WHERE o_orderkey = 33 UNION ALL SELECT 'Customer', o_custkey, 1 FROM orders WHERE o_orderkey = 33")
def traverse_bounded(spark, d):
    return test_model(spark, d).traverse("Order", 33, 1)


def _places(spark, d):
    """Nodes of region <- nation <- customer with ids made unique."""
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 1000).cast("bigint").alias("id"), F.col("n_name").alias("code"), F.col("n_regionkey").cast("bigint").alias("parent"))
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("code"), F.lit(None).cast("bigint").alias("parent"))
    c = table(spark, d, "customer").select((F.col("c_custkey") + 100000).alias("id"), F.col("c_name").alias("code"), (F.col("c_nationkey") + 1000).cast("bigint").alias("parent"))
    return r.unionByName(n).unionByName(c)


@query("""SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(r_regionkey AS BIGINT) AS root_id, CAST(0 AS BIGINT) AS depth, r_name AS code_path FROM region
UNION ALL SELECT n_nationkey + 1000, n_regionkey, 1, r_name || '/' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT c_custkey + 100000, n_regionkey, 2, r_name || '/' || n_name || '/' || c_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def q_tree(spark, d):
    return hierarchy.full_hierarchy(_places(spark, d), "/", doublings=1)


@query("""SELECT CAST(n_nationkey + 1000 AS BIGINT) AS id, CAST(sum(CAST(c_acctbal AS DECIMAL(28,6))) AS DOUBLE) AS total FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1
UNION ALL SELECT n_regionkey, CAST(sum(CAST(c_acctbal AS DECIMAL(28,6))) AS DOUBLE) FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1
UNION ALL SELECT c_custkey + 100000, c_acctbal FROM customer""")
def tree_rollup(spark, d):
    values = table(spark, d, "customer").select((F.col("c_custkey") + 100000).alias("id"), F.col("c_acctbal").alias("value"))
    return planning.rollup(values, hierarchy.ancestor_pairs(_places(spark, d))).select("id", "total")


@query("SELECT 'Customer' AS class, count(*) AS n FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Lineitem', count(*) FROM lineitem UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Document', count(*) FROM documents UNION ALL SELECT 'Event', count(*) FROM events UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Region', count(*) FROM region")
def q_summary(spark, d):
    return report.type_counts(test_model(spark, d).by_type("Thing"))


@query("SELECT attr AS relation, dst_class, n FROM (SELECT 'order' AS attr, 'Order' AS dst_class, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_partkey = 7 UNION ALL SELECT 'supplier', 'Supplier', count(DISTINCT l_suppkey) FROM lineitem WHERE l_partkey = 7)")
def q_relations(spark, d):
    m = test_model(spark, d)
    refs = {a: r for a, r in m.references("Lineitem").items() if a in ("order", "supplier")}
    cells = F.array(*[F.struct(F.lit(a).alias("relation"), F.lit(t).alias("dst_class"), F.col(c).alias("dst")) for a, (t, c) in refs.items()])
    e = m.rows("Lineitem").where("l_partkey = 7").select(F.inline(cells))
    return e.groupBy("relation", "dst_class").agg(F.count_distinct("dst").alias("n"))


@query("SELECT c_custkey AS id, c_name AS name, n_name AS nation, r_name AS region, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_custkey = 42")
def q_info(spark, d):
    m = test_model(spark, d)
    j, up = m.ancestor_join(m.by_id("Customer", 42), "Customer")
    n = table(spark, d, "orders").where("o_custkey = 42").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("orders"))
    return j.join(n, "id", "left").select("id", "name", F.col("_Nation_name").alias("nation"), F.col("_Region_name").alias("region"), F.coalesce("orders", F.lit(0)).alias("orders"))


@query("SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1")
def gui_colour_by(spark, d):
    return Selector(test_model(spark, d)).path("Customer", "MktSegment").groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT p_type AS value FROM part")
def gui_suggest(spark, d):
    return Selector(test_model(spark, d)).path("Part", "Type").select("value").distinct()


@query("SELECT p_partkey AS id FROM part WHERE p_brand = (SELECT p_brand FROM part WHERE p_partkey = 1)")
def gui_similar(spark, d):
    p = Selector(test_model(spark, d)).path("Part", "Brand")
    return p.join(p.where("id = 1").select("value"), "value", "left_semi").select("id")


# ---------------------------------------------------------------- joins


@query("SELECT l_orderkey * 16 + l_linenumber AS id, p_type AS type, l_quantity AS quantity FROM lineitem JOIN part ON p_partkey = l_partkey")
def join_equi_fk(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    return li.join(p, li.l_partkey == p.p_partkey).select((F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("id"), F.col("p_type").alias("type"), F.col("l_quantity").alias("quantity"))


@query("SELECT c_custkey AS id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def join_inverse(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))  # aggregated before the join
    c = table(spark, d, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select(F.col("c_custkey").alias("id"), F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT p_partkey AS id, l_quantity AS x FROM part LEFT JOIN lineitem ON l_partkey = p_partkey")
def join_shape_geometry(spark, d):
    p = table(spark, d, "part")
    g = table(spark, d, "lineitem").select("l_partkey", F.col("l_quantity").alias("x"))
    return p.join(g, p.p_partkey == g.l_partkey, "left").select(F.col("p_partkey").alias("id"), "x")


@query("SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_semi(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_semi").select(F.col("c_custkey").alias("id"))


@query("SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select(F.col("c_custkey").alias("id"))


@query("SELECT coalesce(a.k, b.k) AS nation, coalesce(a.v, b.v) AS balance, a.v IS NULL AS inherited FROM (SELECT s_nationkey AS k, max(s_acctbal) AS v FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, max(c_acctbal) AS v FROM customer GROUP BY 1) b ON a.k = b.k")
def join_type_inherit(spark, d):
    own = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.max("s_acctbal").alias("own"))
    base = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.max("c_acctbal").alias("base"))
    return own.join(base, "nation", "full_outer").select("nation", F.coalesce("own", "base").alias("balance"), F.col("own").isNull().alias("inherited"))


_OLD = "(SELECT * FROM orders WHERE o_orderkey % 7 <> 0)"
_NEW = "(SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 ELSE o_totalprice + 0.0000001 END AS o_totalprice FROM orders WHERE o_orderkey % 5 <> 0)"


@query(f"""SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey,
CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'deleted' ELSE 'changed' END AS status,
CASE WHEN o.o_orderkey IS NULL OR n.o_orderkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN o.o_orderstatus <> n.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN abs(o.o_totalprice - n.o_totalprice) > 0.000001 THEN 'o_totalprice' END) END AS changed
FROM {_OLD} o FULL JOIN {_NEW} n ON o.o_orderkey = n.o_orderkey
WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR o.o_orderstatus <> n.o_orderstatus OR abs(o.o_totalprice - n.o_totalprice) > 0.000001""")
def join_diff_full(spark, d):
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    new = o.where(key % 5 != 0).select("o_orderkey", F.when(key % 11 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(key % 13 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice") + 1e-7).alias("o_totalprice"))
    return compare.diff(o.where(key % 7 != 0), new, "o_orderkey", 1e-6).withColumn("changed", F.concat_ws(",", "changed"))


@query("SELECT status, n FROM (SELECT CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'deleted' ELSE 'changed' END AS status, count(*) AS n FROM (SELECT l_partkey AS k, list_sort(list(DISTINCT l_suppkey)) AS s FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1) a FULL JOIN (SELECT l_partkey AS k, list_sort(list(DISTINCT l_suppkey)) AS s FROM lineitem WHERE l_linenumber >= 3 GROUP BY 1) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.s <> b.s GROUP BY 1)")
def join_diff_rel(spark, d):
    li = table(spark, d, "lineitem")
    rel = lambda df: df.groupBy(F.col("l_partkey").alias("id")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("suppliers"))
    return compare.diff(rel(li.where("l_linenumber <= 3")), rel(li.where("l_linenumber >= 3")), "id").groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey * 16 + l_linenumber AS id, CASE WHEN l_linenumber % 2 = 0 THEN p_retailprice ELSE l_extendedprice / l_quantity END AS rate FROM lineitem JOIN part ON p_partkey = l_partkey")
def join_cost_rate(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    assigned = F.when(F.col("l_linenumber") % 2 == 0, F.col("p_retailprice"))
    return li.join(p, li.l_partkey == p.p_partkey, "left").select((F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("id"), F.coalesce(assigned, F.col("l_extendedprice") / F.col("l_quantity")).alias("rate"))


@query("SELECT CAST(ancestor AS BIGINT) AS ancestor, count(*) AS n FROM (SELECT r_regionkey AS ancestor FROM region UNION ALL SELECT n_nationkey + 1000 FROM nation UNION ALL SELECT n_regionkey FROM nation UNION ALL SELECT c_custkey + 100000 FROM customer UNION ALL SELECT c_nationkey + 1000 FROM customer UNION ALL SELECT n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey) GROUP BY 1")
def join_recursive(spark, d):
    return hierarchy.ancestor_pairs(_places(spark, d)).groupBy("ancestor").agg(F.count("*").alias("n"))


@query("SELECT 2 * c_custkey AS id, c_name AS name, 0 AS model FROM customer UNION ALL SELECT 2 * s_suppkey + 1, s_name, 1 FROM supplier")
def join_merge_models(spark, d):
    m = test_model(spark, d)
    none = spark.createDataFrame([], "src bigint, dst bigint")
    models = [(m.rows(c).select("id", "name"), none) for c in ("Customer", "Supplier")]
    return compare.merge_models(models)[0]


# ---------------------------------------------------------------- boxes


def _boxes(spark, d, kind: str) -> DataFrame:
    """Boxes from line items: x from the part, y from the supplier, z from the quantity."""
    li = table(spark, d, "lineitem").where(f"l_returnflag = '{kind}'")
    x, y, z = F.col("l_partkey").cast("double"), F.col("l_suppkey").cast("double"), F.col("l_quantity")
    return li.select((F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("id"), x.alias("minx"), (x + 3).alias("maxx"), y.alias("miny"), (y + 2).alias("maxy"), z.alias("minz"), (z + 2).alias("maxz"))


def _box_sql(kind: str) -> str:
    return f"(SELECT l_orderkey * 16 + l_linenumber AS id, CAST(l_partkey AS DOUBLE) AS minx, l_partkey + 3.0 AS maxx, CAST(l_suppkey AS DOUBLE) AS miny, l_suppkey + 2.0 AS maxy, l_quantity AS minz, l_quantity + 2 AS maxz FROM lineitem WHERE l_returnflag = '{kind}')"


_MEET = " AND ".join(f"a.min{x} <= b.max{x} + {{0}} AND b.min{x} <= a.max{x} + {{0}}" for x in "xyz")
_DEPTH = "least(" + ", ".join(f"least(a.max{x}, b.max{x}) - greatest(a.min{x}, b.min{x})" for x in "xyz") + ")"
_GAP = "sqrt(" + " + ".join(f"pow(greatest(greatest(a.min{x}, b.min{x}) - least(a.max{x}, b.max{x}), 0), 2)" for x in "xyz") + ")"
_SIZE = (6.0, 4.0, 4.0)


@query(f"SELECT a.id AS a_id, b.id AS b_id FROM {_box_sql('R')} a JOIN {_box_sql('A')} b ON {_MEET.format(0)}")
def join_spatial_box(spark, d):
    return spatial.box_pairs(_boxes(spark, d, "R"), _boxes(spark, d, "A"), _SIZE).select("a_id", "b_id")


@query(f"SELECT a.id AS a_id, b.id AS b_id, 'protrusion' AS type, round(-{_DEPTH}, 6) AS distance FROM {_box_sql('R')} a JOIN {_box_sql('R')} b ON a.id < b.id AND {_MEET.format(0)} AND {_DEPTH} > 0.002")
def join_clash_intersection(spark, d):
    a = _boxes(spark, d, "R")
    return spatial.clash(a, a, "intersection", _SIZE, same=True).withColumn("distance", F.round("distance", 6))


@query(f"SELECT a.id AS a_id, b.id AS b_id, 'collision' AS type, round(-{_DEPTH}, 6) AS distance FROM {_box_sql('R')} a JOIN {_box_sql('A')} b ON {_MEET.format(0)} AND {_DEPTH} >= 0")
def join_clash_collision(spark, d):
    return spatial.clash(_boxes(spark, d, "R"), _boxes(spark, d, "A"), "collision", _SIZE).withColumn("distance", F.round("distance", 6))


@query(f"SELECT a.id AS a_id, b.id AS b_id, 'clearance' AS type, round({_GAP}, 6) AS distance FROM {_box_sql('R')} a JOIN {_box_sql('A')} b ON {_MEET.format(1.5)} WHERE {_GAP} < 1.5")
def join_clash_clearance(spark, d):
    return spatial.clash(_boxes(spark, d, "R"), _boxes(spark, d, "A"), "clearance", _SIZE, clearance=1.5).withColumn("distance", F.round("distance", 6))


@query(f"SELECT id FROM {_box_sql('R')} WHERE minx <= 60 AND maxx >= 20 AND miny <= 8 AND maxy >= 1 AND minz <= 25 AND maxz >= 5")
def select_box(spark, d):
    return spatial.select_box(_boxes(spark, d, "R"), {"minx": 20, "maxx": 60, "miny": 1, "maxy": 8, "minz": 5, "maxz": 25}).select("id")


@query(f"SELECT id, greatest(0, minx) AS distance FROM {_box_sql('R')} WHERE miny <= 5 AND maxy >= 5 AND minz <= 10 AND maxz >= 10 AND minx <= 1000 AND maxx >= 0")
def join_ray(spark, d):
    return spatial.select_ray(_boxes(spark, d, "R"), (0, 5, 10), (1, 0, 0), 1000).select("id", "distance")


@query()
def agg_clusters(spark, d):
    p = _boxes(spark, d, "R").select("id", F.col("minx").alias("x"), F.col("miny").alias("y"), F.col("minz").alias("z"))
    return spatial.clusters(p, 3.0)


@query(f"SELECT id, CAST(12 AS DOUBLE) AS volume, CAST(32 AS DOUBLE) AS area FROM {_box_sql('R')}")
def agg_qto(spark, d):
    q = spatial.mesh_quantities(spatial.box_mesh(_boxes(spark, d, "R")))
    return q.select("id", F.round("volume", 6).alias("volume"), F.round("area", 6).alias("area"))


@query(f"SELECT id, 6.0::DOUBLE AS top_area, 20.0::DOUBLE AS side_area, 6.0::DOUBLE AS footprint_area FROM {_box_sql('R')}")
def agg_footprint(spark, d):
    a = spatial.mesh_areas(spatial.box_mesh(_boxes(spark, d, "R")))
    return a.select("id", *[F.round(c, 6).alias(c) for c in ("top_area", "side_area", "footprint_area")])


@query(f"SELECT DISTINCT id, 'changed' AS status FROM {_box_sql('R')} WHERE id % 3 = 0")
def join_diff_shape(spark, d):
    old = _boxes(spark, d, "R").groupBy("id").agg(*[F.min(c).alias(c) for c in spatial.BOX])
    new = old.withColumn("maxz", F.when(F.col("id") % 3 == 0, F.col("maxz") + 1).otherwise(F.col("maxz") + 1e-9))
    summary = lambda b: spatial.shape_summary(spatial.box_mesh(b))
    return compare.diff(summary(old), summary(new), "id", 1e-6).select("id", "status")


# ---------------------------------------------------------------- reports and aggregates

_DEC = "CAST(sum(CAST({0} AS DECIMAL(28,6))) AS DOUBLE)"


def _report(key: str, kind: str, sql: str) -> None:
    QUERIES[key] = lambda spark, d: report.group_report(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], {"result": (kind, "l_quantity")})
    SQL[key] = f"SELECT l_returnflag, l_linestatus, {sql} AS result FROM lineitem GROUP BY 1, 2"


_report("csv_group_sum", "SUM", _DEC.format("l_quantity"))
_report("csv_group_avg", "AVERAGE", _DEC.format("l_quantity") + " / count(l_quantity)")
_report("csv_group_min", "MIN", "min(l_quantity)")
_report("csv_group_max", "MAX", "max(l_quantity)")
_report("csv_group_varies", "VARIES", "'Varies'")


@query("SELECT p_type, string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS brands FROM part GROUP BY 1")
def csv_group_concat(spark, d):
    return report.group_report(table(spark, d, "part"), ["p_type"], {"brands": ("CONCAT", "p_brand")})


@query("SELECT c_mktsegment, max_by(c_name, c_custkey) AS last_name FROM customer GROUP BY 1")
def csv_group_last(spark, d):
    return report.group_report(table(spark, d, "customer"), ["c_mktsegment"], {}, {"last_name": ("c_name", "c_custkey")})


@query(f"SELECT c_mktsegment AS segment, {_DEC.format('c_acctbal')} AS total FROM customer GROUP BY 1 UNION ALL SELECT 'Total', {_DEC.format('c_acctbal')} FROM customer")
def csv_summary(spark, d):
    g = report.group_report(table(spark, d, "customer"), ["c_mktsegment"], {"total": ("SUM", "c_acctbal")}).withColumnRenamed("c_mktsegment", "segment")
    return report.with_footer(g, "Total", {"total": "SUM"})


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def type_count(spark, d):
    return report.type_counts(table(spark, d, "events"), "event_type")


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def topk_types(spark, d):
    return report.type_counts(table(spark, d, "part"), "p_brand").limit(5)


@query("SELECT n_name AS name, row_number() OVER (ORDER BY CAST(regexp_extract(n_name, '([0-9]+)', 1) AS INT)) AS rank FROM nation")
def natural_sort_rank(spark, d):
    names = table(spark, d, "nation").select(F.col("n_name").alias("name"))
    return global_rank(names, [sc.natural_key(F.col("name"))])


@query("SELECT c_mktsegment AS segment, c_custkey AS id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 3")
def limit_entities(spark, d):
    t = report.limit_per_group(table(spark, d, "customer"), "c_mktsegment", [F.desc("c_acctbal"), F.asc("c_custkey")], 3)
    return t.select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("id"), F.col("rank").cast("bigint").alias("rank"))


@query("SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 0 END AS place FROM orders")
def sort_context_priority(spark, d):
    wanted = F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array_position(wanted, F.col("o_orderpriority")).cast("int").alias("place"))


@query(f"SELECT l_orderkey AS id, {_DEC.format('l_quantity')} AS quantity FROM lineitem GROUP BY 1")
def agg_total_quantity(spark, d):
    return planning.total_quantity(table(spark, d, "lineitem"), "l_orderkey", "l_quantity").withColumnRenamed("l_orderkey", "id")


@query("SELECT min(doc_id) AS keep, count(*) AS copies FROM documents GROUP BY text")
def dedup_first_wins(spark, d):
    return table(spark, d, "documents").groupBy("text").agg(F.min("doc_id").alias("keep"), F.count("*").alias("copies")).select("keep", "copies")


@query("SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_type, p_size) AS keep FROM part")
def fold_identical(spark, d):
    return compare.fold(table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size"), "p_partkey", ["p_brand", "p_type", "p_size"])


@query("WITH n AS (SELECT c_custkey AS id, 'c' || c_mktsegment || c_nationkey AS body FROM customer), c AS (SELECT id, min(id) OVER (PARTITION BY body) AS keep FROM n) SELECT o_orderkey + 1000000000 AS id, min(o_orderkey + 1000000000) OVER (PARTITION BY o_orderstatus, o_orderpriority, keep) AS keep FROM orders JOIN c ON c.id = o_custkey UNION ALL SELECT id, keep FROM c")
def fold_graph(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("c"), "c_mktsegment", F.col("c_nationkey").cast("string")).alias("body"), F.array().cast("array<bigint>").alias("refs"))
    o = table(spark, d, "orders").select((F.col("o_orderkey") + 1_000_000_000).alias("id"), F.concat("o_orderstatus", "o_orderpriority").alias("body"), F.array("o_custkey").alias("refs"))
    return compare.fold_graph(c.unionByName(o))


@query("SELECT doc_id AS id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS first FROM documents) WHERE doc_id <> first")
def agg_dup_guid(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("guid"))
    return compare.duplicate_ids(docs, "id", "guid").select("id")


@query("SELECT user_id AS key, arg_min(event_type, event_id) AS first_type FROM events GROUP BY 1")
def agg_fm(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.min_by("event_type", "event_id").alias("first_type"))


@query("SELECT id, name, origin FROM (SELECT c_nationkey AS id, min(c_name) AS name, 'a' AS origin FROM customer WHERE c_acctbal > 9500 GROUP BY 1 UNION ALL SELECT s_nationkey, min(s_name), 'b' FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9500) GROUP BY 1)")
def scan_fm_federate(spark, d):
    a = table(spark, d, "customer").where("c_acctbal > 9500").groupBy(F.col("c_nationkey").alias("id")).agg(F.min("c_name").alias("name")).withColumn("origin", F.lit("a"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("id")).agg(F.min("s_name").alias("name")).withColumn("origin", F.lit("b"))
    return compare.federate([a, b], "id")


@query("SELECT o_custkey AS id, CAST(sum(CAST(l_quantity * l_extendedprice * (1 - l_discount) AS DECIMAL(28,4))) AS DOUBLE) AS total FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def cost_rollup(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    value = (F.col("l_quantity") * F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(28,4)")
    per = li.groupBy("l_orderkey").agg(F.sum(value).alias("v"))  # per order first: the join carries one row each
    return per.join(o, per.l_orderkey == o.o_orderkey).groupBy(F.col("o_custkey").alias("id")).agg(F.sum("v").cast("double").alias("total"))


@query("SELECT o_orderkey AS item, CASE o_orderkey % 4 WHEN 0 THEN o_totalprice + (o_custkey + 1) + o_orderkey % 5 WHEN 1 THEN o_totalprice - (o_custkey + 1) - o_orderkey % 5 WHEN 2 THEN o_totalprice * (o_custkey + 1) * (o_orderkey % 5) ELSE CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice / (o_custkey + 1) ELSE o_totalprice / (o_custkey + 1) / (o_orderkey % 5) END END AS amount FROM orders")
def agg_cost_value(spark, d):
    key = F.col("o_orderkey")
    op = F.element_at(F.array(*[F.lit(x) for x in ("ADD", "SUBTRACT", "MULTIPLY", "DIVIDE")]), (key % 4 + 1).cast("int"))
    values = F.array("o_totalprice", (F.col("o_custkey") + 1).cast("double"), (key % 5).cast("double"))
    parts = table(spark, d, "orders").select(key.alias("item"), op.alias("op"), F.posexplode(values).alias("pos", "v"))
    return planning.cost_values(parts, "item", "op", "v")


# ---------------------------------------------------------------- sets


@query(f"{_C} WHERE c_acctbal > 5000 UNION {_C} WHERE c_mktsegment = 'BUILDING'")
def set_union(spark, d):
    return Selector(test_model(spark, d)).select("Customer, AcctBal>5000 + Customer, MktSegment=BUILDING")


@query(f"{_C} WHERE c_acctbal > 5000 AND coalesce(c_mktsegment, '') <> 'BUILDING'")
def set_diff(spark, d):
    s = Selector(test_model(spark, d))
    return s.select("Customer, AcctBal>5000").subtract(s.select("Customer, MktSegment=BUILDING"))


@query(f"{_C} WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
def set_intersect(spark, d):
    s = Selector(test_model(spark, d))
    return s.select("Customer, AcctBal>5000").intersect(s.select("Customer, MktSegment=BUILDING"))


@query("SELECT 'Order' AS class, o_orderkey AS id FROM orders WHERE o_totalprice > 400000 UNION SELECT 'Customer', o_custkey FROM orders WHERE o_totalprice > 400000 UNION SELECT 'Nation', c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 400000 UNION SELECT 'Region', n_regionkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_totalprice > 400000")
def extract_closure(spark, d):
    m = test_model(spark, d)
    chosen = m.rows("Order").where("o_totalprice > 400000")
    j, up = m.ancestor_join(chosen, "Order")
    cells = [F.struct(F.lit("Order").alias("class"), F.col("id").alias("id"))] + [F.struct(F.lit(c).alias("class"), F.col(k).alias("id")) for c, k, _ in up]
    return j.select(F.inline(F.array(*cells))).where("id is not null").distinct()


@query("SELECT region, count(*) AS n FROM (SELECT r_name AS region FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey) GROUP BY 1")
def set_split(spark, d):
    m = test_model(spark, d)
    j, _ = m.ancestor_join(m.rows("Customer"), "Customer")
    return j.groupBy(F.col("_Region_name").alias("region")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS element_id, set_name, name, value FROM (SELECT p_partkey, 'Pset_Part' AS set_name, 'Size' AS name, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT p_partkey, 'Pset_Part', 'Brand', p_brand FROM part) WHERE value IS NOT NULL")
def sql_projection_star(spark, d):
    return report.star(table(spark, d, "part"), "p_partkey", {"Pset_Part": {"Size": "p_size", "Brand": "p_brand"}})


@query("SELECT o_orderkey AS id, a AS day, b AS flag FROM orders, (SELECT unnest([1, 2, 3]) AS a), (SELECT unnest(['x', 'y']) AS b)")
def sink_sql_expand(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("day"), F.array(F.lit("x"), F.lit("y")).alias("flag"))
    return report.expand_lists(o, ["day", "flag"])


# ---------------------------------------------------------------- format language


def _format(key: str, tab: str, ident: str, text: str, sql: str) -> None:
    QUERIES[key] = lambda spark, d: table(spark, d, tab).select(F.col(ident).alias("id"), fmt.compile_format(text, F.col).alias("text"))
    SQL[key] = f"SELECT {ident} AS id, {sql} AS text FROM {tab}"


_format("fmt_lower", "customer", "c_custkey", "lower({{c_name}})", "lower(coalesce(c_name, 'None'))")
_format("fmt_upper", "documents", "doc_id", "upper({{lang}})", "upper(coalesce(lang, 'None'))")
_format("fmt_concat", "customer", "c_custkey", 'concat({{c_name}}, "-", upper({{c_mktsegment}}))', "c_name || '-' || upper(c_mktsegment)")
_format("fmt_add", "part", "p_partkey", "{{p_size}} + 2", "CAST(p_size + 2 AS VARCHAR)")
_format("fmt_add_text", "part", "p_partkey", "{{p_brand}} + 2", "p_brand || '2'")
_format("fmt_sub_mul", "part", "p_partkey", "{{p_size}} * 3 - 1", "CAST(p_size * 3 - 1 AS VARCHAR)")
_format("fmt_div_zero", "part", "p_partkey", "{{p_size}} / 0", "'inf'")
_format("fmt_div", "part", "p_partkey", "{{p_size}} / 4", "regexp_replace(CAST(p_size / 4 AS VARCHAR), '\\.0$', '')")
_format("fmt_int", "customer", "c_custkey", "int({{c_acctbal}})", "CAST(trunc(c_acctbal) AS BIGINT)")
_format("fmt_round", "part", "p_partkey", "round({{p_size}}, 5)", "CAST(CAST(round_even(p_size / 5.0, 0) * 5 AS INT) AS VARCHAR)")
_format("fmt_number", "orders", "o_orderkey", 'number({{o_custkey}}, ",", ".")', "replace(format('{:,}', o_custkey), ',', '.')")
_format("fmt_number_decimals", "customer", "c_custkey", "number({{c_acctbal}})", "CASE WHEN c_acctbal < 0 AND c_acctbal > -1 THEN '-' ELSE '' END || format('{:,}', CAST(trunc(c_acctbal) AS BIGINT)) || regexp_extract(CAST(c_acctbal AS VARCHAR), '\\.\\d+$')")
_format("fmt_number_comma", "customer", "c_custkey", 'number({{c_acctbal}}, ",")', "replace(CAST(c_acctbal AS VARCHAR), '.', ',')")
_format("fmt_substr", "customer", "c_custkey", "substr({{c_name}}, 2, -1)", "substring(c_name, 3, length(c_name) - 3)")
_format("fmt_title", "customer", "c_custkey", "title({{c_mktsegment}})", "upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2))")
_format("fmt_metric", "part", "p_partkey", "metric_length({{p_size}}, 5, 2)", "format('{:.2f}', round_even(p_size / 5.0, 0) * 5)")


@query("SELECT p_partkey AS id, CASE WHEN p_size % 12 = 0 THEN (p_size // 12) || '''' ELSE (p_size // 12) || ''' - ' || (p_size % 12) || '\"' END AS text FROM part")
def fmt_imperial(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), fmt.fmt_imperial_length(F.col("p_size") / 12, 1).alias("text"))


@query("SELECT o_orderkey AS id, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), '/' ORDER BY CAST(l_suppkey AS VARCHAR)) AS text FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def fmt_sort_join(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("s"))
    return g.select("id", fmt.fmt_join("/", fmt.fmt_sort(F.col("s"))).alias("text"))


# ---------------------------------------------------------------- dates, units, places, ids


@query("""WITH s AS (SELECT o_orderkey AS id, isodow(o_orderdate) AS dow, o_orderkey % 40 + 1 AS n FROM orders)
SELECT id, CAST(n // 7 * 5 + len(list_filter(range(CAST(n % 7 AS BIGINT)), lambda i: (dow - 1 + i) % 7 < 5)) AS INT) AS days FROM s""")
def working_days(spark, d):
    start = F.to_date("o_orderdate")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), planning.working_days(start, F.date_add(start, (F.col("o_orderkey") % 40).cast("int"))).alias("days"))


@query("""WITH cal AS (SELECT CAST(x AS DATE) AS day, isodow(x) <= 5 AS w FROM generate_series(DATE '1991-01-01', DATE '2003-12-31', INTERVAL 1 DAY) t(x)), idx AS (SELECT *, sum(CASE WHEN w THEN 1 ELSE 0 END) OVER (ORDER BY day) AS i FROM cal)
SELECT o_orderkey AS id, b.day AS finish FROM orders LEFT JOIN idx a ON a.day = CAST(o_orderdate AS DATE) LEFT JOIN (SELECT * FROM idx WHERE w) b ON b.i = a.i + CASE WHEN a.w THEN 0 ELSE 1 END + o_orderkey % 10""")
def offset_date(spark, d):
    cal = planning.calendar(table(spark, d, "orders"), "1991-01-01", "2003-12-31")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day0"), (F.col("o_orderkey") % 10).alias("n"))
    return planning.offset_working_days(o, "day0", "n", cal, "finish").select("id", "finish")


@query("SELECT o_orderkey AS id, CAST(sum(1 + o_orderkey % 9) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS early_finish FROM orders")
def cpm_early_dates(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderdate", (1 + F.col("o_orderkey") % 9).alias("days"))
    return planning.chain_dates(o, "o_custkey", ["o_orderdate", "id"], "days").select("id", "early_finish")


@query("""WITH t AS (SELECT n_nationkey AS id, n_regionkey AS chain, CAST(1 + n_nationkey % 7 AS DOUBLE) AS d FROM nation), s AS (SELECT *, sum(d) OVER (PARTITION BY chain ORDER BY id) AS ef, sum(d) OVER (PARTITION BY chain) AS total FROM t), m AS (SELECT max(total) AS span FROM s)
SELECT CAST(id AS BIGINT) AS id, ef - d AS early_start, ef AS early_finish, span - total + ef - d AS late_start, span - total + ef AS late_finish, span - total AS total_float, span = total AS is_critical FROM s, m""")
def critical_path(spark, d):
    n = table(spark, d, "nation")
    tasks = n.select(F.col("n_nationkey").cast("bigint").alias("id"), (1 + F.col("n_nationkey") % 7).cast("double").alias("duration"))
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    links = n.select(F.lag("n_nationkey").over(w).cast("bigint").alias("pred"), F.col("n_nationkey").cast("bigint").alias("succ"), F.lit("FS").alias("type"), F.lit(0.0).alias("lag")).where("pred is not null")
    return planning.critical_path(tasks, links)


@query("SELECT n_nationkey AS id, n_nationkey % 3 AS months, 7 * (n_nationkey % 2) + n_nationkey AS days, CAST(3600 * n_nationkey AS DOUBLE) AS seconds FROM nation")
def parse_duration(spark, d):
    k = F.col("n_nationkey")
    text = F.concat(F.lit("P"), (k % 3).cast("string"), F.lit("M"), (k % 2).cast("string"), F.lit("W"), k.cast("string"), F.lit("DT"), k.cast("string"), F.lit("H"))
    return table(spark, d, "nation").select(k.alias("id"), sc.parse_duration(text).alias("p")).select("id", "p.months", "p.days", "p.seconds")


@query("SELECT p_partkey AS id, round(p_size * 0.3048 / 0.001, 6) AS mm FROM part")
def unit_convert(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(sc.convert(F.col("p_size"), sc.unit_scale("", "foot"), sc.unit_scale("MILLI", "METRE")), 6).alias("mm"))


@query("SELECT p_partkey AS id, round(CAST(0.6 AS DOUBLE) * p_size - CAST(0.8 AS DOUBLE) * p_partkey + 1000, 6) AS e, round(CAST(0.8 AS DOUBLE) * p_size + CAST(0.6 AS DOUBLE) * p_partkey + 2000, 6) AS n, round(p_retailprice + 5.0, 6) AS h FROM part")
def xyz2enh(spark, d):
    p = table(spark, d, "part")
    e, n, h = sc.xyz2enh(F.col("p_size"), F.col("p_partkey"), F.col("p_retailprice"), 1000, 2000, 5, 3, 4)
    return p.select(F.col("p_partkey").alias("id"), F.round(e, 6).alias("e"), F.round(n, 6).alias("n"), F.round(h, 6).alias("h"))


@query("SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, CAST(p_partkey AS DOUBLE) AS y FROM part")
def enh2xyz_round_trip(spark, d):
    p = table(spark, d, "part")
    e, n, h = sc.xyz2enh(F.col("p_size"), F.col("p_partkey"), F.lit(1.0), 1000, 2000, 5, 3, 4)
    x, y, _ = sc.enh2xyz(e, n, h, 1000, 2000, 5, 3, 4)
    return p.select(F.col("p_partkey").alias("id"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("SELECT c_custkey AS id, round(c_acctbal / 100, 6) AS degrees FROM customer")
def dms_round_trip(spark, d):
    c = table(spark, d, "customer").withColumn("p", sc.dd2dms(F.col("c_acctbal") / 100))
    return c.select(F.col("c_custkey").alias("id"), F.round(sc.dms2dd(F.col("p.d"), F.col("p.m"), F.col("p.s"), F.col("p.u")), 6).alias("degrees"))


@query("SELECT p_partkey AS id, round(degrees(atan2(p_size, p_retailprice)), 6) AS angle FROM part")
def bearing(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(sc.bearing(F.col("p_size"), F.col("p_retailprice")), 6).alias("angle"))


@query("SELECT doc_id AS id, substr(md5(text), 1, 32) AS hex FROM documents")
def guid_round_trip(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("h"))
    return docs.select("id", sc.guid_expand(sc.guid_compress(F.col("h"))).alias("hex"))


@query("SELECT file_id, rec_no, coalesce(regexp_matches(global_id, '^[0-3][0-9A-Za-z_$]{21}$'), false) AS ok FROM id_map_exports")
def validate_guid(spark, d):
    return table(spark, d, "id_map_exports").select("file_id", "rec_no", sc.is_guid(F.col("global_id")).alias("ok"))


# ---------------------------------------------------------------- audits and rules


def _specs() -> list[audit.Specification]:
    f, r = audit.AttributeFacet, audit.Restriction
    big = F.col("o_totalprice") > 200000
    return [
        audit.Specification("required", big, (f("o_orderstatus", r(enumeration=("O", "F"))),), 1),
        audit.Specification("optional", big, (f("o_orderpriority", r(pattern="[1-3]-.*"), "optional"),)),
        audit.Specification("prohibited", big, (f("o_orderstatus", "P", "prohibited"),)),
        audit.Specification("bounds", F.lit(True), (f("o_totalprice", r(min_inclusive=1000, max_exclusive=400000)), f("o_orderpriority", r(min_length=5, max_length=10)))),
    ]


_SPEC_SQL = """SELECT 'required' AS specification, 0 AS requirement, o_orderkey AS entity, o_orderstatus IN ('O', 'F') AS passed FROM orders WHERE o_totalprice > 200000
UNION ALL SELECT 'optional', 0, o_orderkey, regexp_matches(o_orderpriority, '^(?:[1-3]-.*)$') FROM orders WHERE o_totalprice > 200000
UNION ALL SELECT 'prohibited', 0, o_orderkey, o_orderstatus <> 'P' FROM orders WHERE o_totalprice > 200000
UNION ALL SELECT 'bounds', 0, o_orderkey, o_totalprice >= 1000 AND o_totalprice < 400000 FROM orders
UNION ALL SELECT 'bounds', 1, o_orderkey, length(o_orderpriority) BETWEEN 5 AND 10 FROM orders"""


@query(_SPEC_SQL)
def ids_results(spark, d):
    return audit.results(table(spark, d, "orders"), "o_orderkey", _specs()).select("specification", "requirement", "entity", "passed")


@query(f"SELECT specification, requirement, count(*) AS checks, CAST(count_if(passed) AS BIGINT) AS passes, CAST(floor(count_if(passed) * 100 / count(*)) AS INT) AS percent FROM ({_SPEC_SQL}) GROUP BY 1, 2")
def audit_totals(spark, d):
    return audit.totals(audit.results(table(spark, d, "orders"), "o_orderkey", _specs()))


@query(f"SELECT specification, entity FROM ({_SPEC_SQL}) GROUP BY 1, 2 HAVING bool_and(passed)")
def audit_passed_view(spark, d):
    return audit.passed_view(audit.results(table(spark, d, "orders"), "o_orderkey", _specs()))


@query(f"SELECT specification, count(*) AS applicable, CAST(count_if(NOT ok) AS BIGINT) AS failed, CASE WHEN count_if(NOT ok) = 0 THEN 'pass' ELSE 'fail' END AS status FROM (SELECT specification, entity, bool_and(passed) AS ok FROM ({_SPEC_SQL}) GROUP BY 1, 2) GROUP BY 1")
def ids_status(spark, d):
    return audit.statuses(table(spark, d, "orders"), _specs())


def _restriction(key: str, column: str, restriction: audit.Restriction, sql: str) -> None:
    QUERIES[key] = lambda spark, d: table(spark, d, "part").where(restriction.test(F.col(column))).select(F.col("p_partkey").alias("id"))
    SQL[key] = f"SELECT p_partkey AS id FROM part WHERE {sql}"


_restriction("ids_restriction_enum", "p_size", audit.Restriction(enumeration=(1, 2, 3)), "p_size IN (1, 2, 3)")
_restriction("ids_restriction_pattern", "p_brand", audit.Restriction(pattern="Brand#[1-2][0-9]*"), "regexp_full_match(p_brand, 'Brand#[1-2][0-9]*')")
_restriction("ids_restriction_bounds", "p_size", audit.Restriction(min_exclusive=10, max_inclusive=20), "p_size > 10 AND p_size <= 20")
_restriction("ids_restriction_length", "p_name", audit.Restriction(min_length=6, max_length=7), "length(p_name) BETWEEN 6 AND 7")


@query("SELECT p_partkey AS id FROM part WHERE abs(p_size - 7.000001) <= 0.000001 * 7.000001")
def ids_attribute_tolerance(spark, d):
    return table(spark, d, "part").where(audit.equals(F.col("p_size"), 7.000001)).select(F.col("p_partkey").alias("id"))


@query("SELECT rule, id FROM (SELECT 'positive' AS rule, c_custkey AS id FROM customer WHERE NOT coalesce(c_acctbal >= 0, false) UNION ALL SELECT 'segment', c_custkey FROM customer WHERE NOT coalesce(c_mktsegment <> 'BUILDING', false))")
def rule_violations(spark, d):
    return rules.violations(table(spark, d, "customer"), "c_custkey", {"positive": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment") != "BUILDING"})


@query("SELECT 'unique' AS rule, doc_id AS id FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents WHERE text IS NOT NULL) WHERE n > 1")
def rule_unique(spark, d):
    return rules.unique_violations(table(spark, d, "documents"), "doc_id", ["text"], "unique")


@query("SELECT 'orders' AS rule, c_custkey AS id FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) < 5 OR count(o_orderkey) > 15")
def rule_inverse_cardinality(spark, d):
    m = test_model(spark, d)
    return rules.inverse_cardinality(m.rows("Customer"), m.edges(["Order"]).where("attr = 'customer'"), 5, 15, "orders")


@query("SELECT rule, id FROM (SELECT 'WR1' AS rule, o_orderkey AS id FROM orders WHERE NOT coalesce(o_totalprice > 1000 AND o_orderstatus IN ('O', 'F'), false) UNION ALL SELECT 'WR2', o_orderkey FROM orders WHERE NOT coalesce(o_orderpriority LIKE '_-%' AND o_totalprice BETWEEN 5000 AND 300000, false))")
def express_rules(spark, d):
    texts = {"WR1": "(TotalPrice > 1000.) AND (Status IN ['O', 'F'])", "WR2": "(Priority LIKE '#-&') AND {5000. <= TotalPrice <= 300000.}"}
    return express.check_rules(table(spark, d, "orders"), "o_orderkey", texts, {"TotalPrice": "o_totalprice", "Status": "o_orderstatus", "Priority": "o_orderpriority"})


@query("SELECT l_orderkey AS id, CAST(count_if(l_quantity > 40) AS INT) AS n FROM lineitem GROUP BY 1")
def express_query_sizeof(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_quantity").alias("q"))
    return g.select("id", rules.sizeof(rules.query(F.col("q"), lambda x: x > 40)).alias("n"))


@query("SELECT o_custkey AS id, count(*) AS users FROM orders GROUP BY 1")
def express_usedin(spark, d):
    return rules.used_in(test_model(spark, d).edges(["Order"]), "customer")


@query("SELECT class, CASE class WHEN 'Part' THEN 'Part,Item,Thing' ELSE 'Lineitem,Item,Thing' END AS types, count(*) AS n FROM (SELECT 'Part' AS class FROM part UNION ALL SELECT 'Lineitem' FROM lineitem) GROUP BY 1")
def express_typeof(spark, d):
    m = test_model(spark, d)
    counts = m.by_type("Item").groupBy("class").agg(F.count("*").alias("n"))
    return rules.type_of(counts, m.taxonomy_table()).select("class", F.concat_ws(",", "types").alias("types"), "n")


@query("SELECT attribute, id, problem FROM (SELECT 'lang' AS attribute, doc_id AS id, CASE WHEN lang IS NULL THEN 'not given' WHEN lang NOT IN ('en', 'de', 'fr') THEN 'not an item of the enumeration' END AS problem FROM documents) WHERE problem IS NOT NULL")
def q_validate(spark, d):
    return rules.schema_check(table(spark, d, "documents"), "doc_id", {"lang": {"enum": ["en", "de", "fr"]}, "model_key": {"optional": True, "pattern": "M-\\d{4}"}})


# ---------------------------------------------------------------- files and streams


def _records(spark, d) -> DataFrame:
    """Instance records of customers that refer to their nations."""
    c = table(spark, d, "customer").select((F.col("c_custkey") + 1000).alias("id"), F.lit("IFCCUSTOMER").alias("class"), F.array(F.concat(F.lit("'"), "c_name", F.lit("'")), F.concat(F.lit("#"), (F.col("c_nationkey") + 1).cast("string")), F.lit("$"), F.concat(F.lit("."), "c_mktsegment", F.lit("."))).alias("args"))
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 1).cast("bigint").alias("id"), F.lit("IFCNATION").alias("class"), F.array(F.concat(F.lit("'"), "n_name", F.lit("'"))).alias("args"))
    return c.unionByName(n)


@query("SELECT c_custkey + 1000 AS id, c_name AS name, CAST(c_nationkey + 1 AS BIGINT) AS nation, c_mktsegment AS segment FROM customer")
def scan_spf(spark, d):
    """A file is written and read back."""
    t = _spf_file(spark, d).where("class = 'IFCCUSTOMER'")
    return t.select("id", spf.argument(0).alias("name"), F.get("refs", F.lit(0)).alias("nation"), spf.argument(3).alias("segment"))


def _spf_file(spark, d, bypass=()):
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    spf.write_spf(_records(spark, d), path)
    return spf.read_spf(spark, path, bypass)


@query("SELECT c_custkey + 1000 AS id, 'IFCCUSTOMER' AS class FROM customer")
def scan_bypass(spark, d):
    return _spf_file(spark, d, ["IfcNation"]).select("id", "class")


@query("SELECT c_custkey + 1000 AS src, CAST(c_nationkey + 1 AS BIGINT) AS dst FROM customer")
def scan_stream_offsets(spark, d):
    return spf.edges(_spf_file(spark, d)).select("src", "dst")


@query("SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, '#' || (n_nationkey + 1) || '=IFCNATION(''' || n_name || ''');' AS value FROM nation")
def sink_spf(spark, d):
    r = _records(spark, d).where("class = 'IFCNATION'")
    return spf.record_text(r).select(F.regexp_extract("value", "^#(\\d+)", 1).cast("bigint").alias("id"), "value")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def stream_window_tumbling(spark, d):
    return stream.drain(stream.windowed(stream.read_table(spark, f"{d}/events.parquet"), "ts", "1 day", by=["event_type"], late="60 days"), "complete")


@query("SELECT start, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE) AS total FROM (SELECT value, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS start FROM events) GROUP BY 1")
def stream_window_sliding(spark, d):
    return stream.drain(stream.windowed(stream.read_table(spark, f"{d}/events.parquet"), "ts", "1 day", "12 hours", late="60 days"), "complete")


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS finish, count(*) AS n FROM s GROUP BY user_id, k")
def stream_window_session(spark, d):
    return stream.drain(stream.sessions(stream.read_table(spark, f"{d}/events.parquet"), "ts", "6 hours", ["user_id"], late="60 days"), "complete")


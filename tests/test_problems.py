"""The general data problems on small fixtures: nulls, empties, ties, repeats, empty tables, clashing extra columns."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from trussflow.operators import drift, graph, hierarchy, nested, orphans, pivot, units

T = dt.datetime


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---------------------------------------------------------------- schemas that drift

EXPORTS = "file_id long, rec_no int, global_id string, payload string"
META = "file_id long, series_id long, schema string, exported_at timestamp_ntz"


def _meta(spark, *files):
    return spark.createDataFrame([(f, 1, s, T(2024, 1, k + 1)) for k, (f, s) in enumerate(files)], META)


def test_drift_kinds(spark):
    e = [
        (1, 1, "a", '{"x": 1, "n": "p", "gone": 5, "t": 1}'), (1, 2, "b", '{"x": 2, "n": "q", "t": 2}'), (1, 2, "b", '{"x": 2, "n": "q", "t": 2}'),
        (2, 1, "a", '{"y": 1, "n": "p", "new": [1], "t": "1"}'), (2, 2, "b", '{"y": 2, "n": "q", "t": null}'), (2, 3, None, '{"y": 9}'), (2, 4, "c", '{"y": '), (2, 5, "d", None), (2, 6, "e", "[1]"), (2, 7, "f", ""),
    ]
    got = drift.changes(spark.createDataFrame(e, EXPORTS), _meta(spark, (1, "ifc 4"), (2, "IFC-4x3"), (2, "IFC-4x3"))).select("file_id", "change_kind", "old_name", "new_name")
    assert rows(got.distinct()) == sorted([(2, "renamed", "x", "y"), (2, "removed", "gone", ""), (2, "added", "", "new"), (2, "retyped", "t", "t"), (2, "schema", "IFC4", "IFC4X3")], key=repr)


def test_drift_without_shared_records_is_no_renaming(spark):
    e = [(1, 1, "a", '{"x": 1}'), (2, 1, "z", '{"y": 1}')]
    got = drift.changes(spark.createDataFrame(e, EXPORTS), _meta(spark, (1, "A"), (2, "A")))
    assert rows(got.select("change_kind", "old_name", "new_name")) == [("added", "", "y"), ("removed", "x", "")]


def test_drift_empty_tables(spark):
    assert drift.changes(spark.createDataFrame([], EXPORTS), spark.createDataFrame([], META)).count() == 0
    assert drift.consistent_table(spark.createDataFrame([], EXPORTS), spark.createDataFrame([], META)).count() == 0


def test_consistent_table_reports_failed_casts(spark):
    e = [(1, k, f"g{k}", json.dumps({"ifc_id": k, "volume": 1.5, "layer": "a"})) for k in range(4)] + [(2, k, f"g{k}", json.dumps({"step": k, "volume": "much" if k else {"value": 2.5}, "Extra": 1, "coat": "a"})) for k in range(4)]
    e += [(2, 9, None, '{"Extra": [1, 2], "volume": {"unit": "m3"}}')]
    t = drift.consistent_table(spark.createDataFrame([*e, e[0]], EXPORTS), _meta(spark, (1, "A"), (2, "A")))
    got = {(r.file_id, r.rec_no): r for r in t.collect()}
    assert len(got) == t.count() == 9 and got[2, 3].ifc_id == 3 and got[2, 0].volume == 2.5
    assert [tuple(x) for x in got[2, 1].failed] == [("volume", '"much"')] and got[1, 1].failed == [] and got[2, 1].Extra == 1.0
    assert {tuple(x) for x in got[2, 9].failed} == {("volume", '{"unit":"m3"}'), ("Extra", "[1,2]")}
    assert got[1, 1].layer == got[2, 1].layer == "a" and "coat" not in t.columns
    assert rows(drift.failed_casts(t)) == [(2, "Extra", 1), (2, "volume", 4)]


def test_names_that_differ_in_case_only_can_be_written(spark, tmp_path):
    """Materials in one file and materials in another are one field; X and x of one file are two columns."""
    e = [(1, 1, "a", '{"Materials": "oak", "NAME": "p", "X": 1, "x": 2, "failed": "f", "Failed_Field": "g"}'), (2, 1, "b", '{"materials": "elm", "name": "q", "X": 3}'), (3, 1, "c", '{"MATERIALS": "ash", "": "none", "a.b": true}')]
    t = drift.consistent_table(spark.createDataFrame(e, EXPORTS), _meta(spark, (1, "A"), (2, "A"), (3, "A")))
    assert len({c.lower() for c in t.columns}) == len(t.columns) and [c.lower() for c in t.columns].count("materials") == 1
    t.write.parquet(str(tmp_path / "t"))
    got = {r["file_id"]: {k.lower(): v for k, v in r.asDict().items()} for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert [got[k]["materials"] for k in (1, 2, 3)] == ["oak", "elm", "ash"] and [got[k]["name"] for k in (1, 2, 3)] == ["p", "q", None]
    assert {got[1]["x"], got[1]["x_2"]} == {1.0, 2.0} and 3.0 in (got[2]["x"], got[2]["x_2"]) and got[3]["a.b"] is True and got[3]["_field"] == "none"
    assert {got[1][c] for c in got[1] if c.startswith("failed_field")} == {"f", "g"} and all(not r["failed"] for r in got.values())


def test_one_shared_record_is_enough_for_a_renaming(spark):
    e = [(1, 1, "a", '{"x": 1}'), (1, 2, "b", '{"x": 1}'), (2, 1, "a", '{"y": 1, "z": 1}'), (2, 2, "b", '{"z": 2}')]
    ex, m = spark.createDataFrame(e, EXPORTS), _meta(spark, (1, "A"), (2, "A"))
    assert rows(drift.changes(ex, m).select("change_kind", "old_name", "new_name")) == [("added", "", "z"), ("renamed", "x", "y")]
    t = drift.consistent_table(ex, m)
    assert {r.x if "x" in t.columns else r.y for r in t.where("file_id = 1 or rec_no = 1").collect()} == {1.0}


def test_components_match_brute_force(spark):
    r = random.Random(3)
    e = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)]
    want = {x: x for p in e for x in p}
    for _ in range(len(want)):
        for a, b in e:
            want[a] = want[b] = min(want[a], want[b])
    got = graph.components(spark.createDataFrame([*e, (None, 3)], "a long, b long"))
    assert {x.node: x.component for x in got.collect()} == want


def test_reach_ends_on_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 1)], "src long, dst long")
    start = spark.createDataFrame([(1,), (None,)], "id long")
    assert rows(graph.reach(e, start)) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert rows(graph.reach(e, start, 1)) == [(1, 0), (2, 1)]


# ---------------------------------------------------------------- nested records


def test_nested_layouts_give_the_same_links(spark):
    old = {"Markups": [{"Header": {"File": {"@IfcProject": "P"}}, "Topic": {"@Guid": "t1", "DocumentReference": [{"@Guid": "r"}]}, "Comment": [None, {"@Guid": "c", "Viewpoint": {"@Guid": "v"}}], "Viewpoints": {"@Guid": "v"}}]}
    new = {"topics": [{"topic": {"guid": "t1", "header": {"files": {"file": [{"ifc_project": "P"}]}}, "document_references": {"document_reference": {"guid": "r"}}, "comments": {"comment": [None, {"guid": "c", "viewpoint": {"guid": "v"}}]}, "viewpoints": {"view_point": [{"guid": "v"}]}}}]}
    text = {"Markups": json.dumps(old["Markups"])}
    for doc in (old, new, text):
        df = spark.createDataFrame([(1, "A", json.dumps(doc)), (2, "A", json.dumps(doc)), (3, "A", '{"x": '), (4, "A", None), (5, "A", "")], "raw_id long, archive_guid string, payload string")
        want = [("comment", "t1", "c", 2), ("comment_viewpoint", "c", "v", 1), ("document_reference", "t1", "r", 1), ("header_file", "t1", "P", 1), ("topic", "A", "t1", 1), ("viewpoint", "t1", "v", 1)]
        assert rows(nested.bcf_links(df)) == want


def test_nested_tables_and_schema(spark):
    doc = {"topics": {"topic": {"guid": "t", "title": "x", "header": {"files": {"file": {"filename": "f", "ifc_project": None}}}}}}
    df = spark.createDataFrame([(1, "A", json.dumps(doc), "clash")], "raw_id long, archive_guid string, payload string, name string")
    t = nested.bcf_tables(df)
    assert [(r.title, r.parent_key) for r in t["topics"].collect()] == [("x", "A")] and [(r.filename, r.ifcproject) for r in t["files"].collect()] == [("f", None)]
    s = nested.merged_schema(nested.shred(df, "raw_id", "archive_guid", "payload"))
    assert ("root.topics.topic.header.files.file", "ifcproject", 1, 0) in rows(s.select("path", "field", "n", "filled"))
    assert nested.bcf_links(df.where("false")).count() == 0


def test_nested_plain_entries_and_outer_fields_are_kept(spark):
    doc = {"topics": [{"guid": "t1", "labels": ["x", None, "y", 7], "note": "n"}], "owners": ["a", "b"], "Markups": [{"Topic": {"Guid": "t2", "Comment": [{"guid": "c1"}]}, "Status": "open", "Comment": [{"guid": "c2"}, {"guid": "c3", "extra": {"deep": {"list": [[1, 2], [3]]}}}]}]}
    df = spark.createDataFrame([(1, "A", json.dumps(doc))], "raw_id long, archive_guid string, payload string")
    n = nested.shred(df, "raw_id", "archive_guid", "payload")
    got = {(r.name, r.parent_key, r.ord, r.v) for r in n.withColumn("v", F.expr("cast(attrs['value'] as string)")).collect()}
    assert {("labels", "t1", 1, "x"), ("labels", "t1", 3, "y"), ("labels", "t1", 4, "7"), ("owners", "A", 1, "a"), ("owners", "A", 2, "b"), ("list", "c3", 3, "3")} <= got
    assert {("comment", "t2", 1), ("comment", "t2", 2), ("comment", "t2", 3)} <= {g[:3] for g in got}
    t = nested.bcf_tables(df)
    assert [r.outerstatus for r in t["topics"].collect() if r.node_key == "t2"] == ["open"]
    assert n.select("row_id", "node_no").distinct().count() == n.count() and n.alias("a").join(n.alias("b"), F.expr("a.parent_no = b.node_no")).count() == n.count() - 1


def test_nested_columns_follow_the_merged_schema(spark):
    docs = [{"topics": [{"guid": "t1", "title": "a", "prio": 1, "due": "x"}]}, {"Topics": [{"@Guid": "t2", "Prio": 2.5, "due": 3, "Ord": True, "Guid_": None}]}]
    df = spark.createDataFrame([(k, "A", json.dumps(d)) for k, d in enumerate(docs)], "raw_id long, archive_guid string, payload string")
    n = nested.shred(df, "raw_id", "archive_guid", "payload")
    t = nested.child_table(n, nested.merged_schema(n).collect(), ["topics"], ["root"])
    assert dict(t.dtypes)["prio"] == "double" and dict(t.dtypes)["ord_field"] == "boolean" and dict(t.dtypes)["due"] == "string"
    assert rows(t.select("title", "prio", "due", "ord_field")) == [("a", 1.0, '"x"', None), (None, 2.5, "3", True)]


def test_very_deep_payload_is_unreadable_not_a_crash(spark):
    deep = '{"a":' * 50_000 + "1" + "}" * 50_000
    df = spark.createDataFrame([(1, "A", deep)], "raw_id long, archive_guid string, payload string")
    assert nested.bcf_links(df).count() == 0


# ---------------------------------------------------------------- units

QTY = "qty_id long, file_id long, ifc_id long, name string, value string, unit string, unit_scale double"


def _canon(spark, q, fu=()):
    f = spark.createDataFrame(list(fu), "file_id long, unit_type string, unit_name string, unit_scale double")
    return {r.qty_id: (r.unit_source, r.canon) for r in units.common_units(spark.createDataFrame(q, QTY), f).collect()}


def test_units_are_sought_in_order(spark):
    fu = [(1, "LENGTHUNIT", "mm", None), (1, "LENGTHUNIT", "mm", None), (1, "PRESSUREUNIT", None, 1000.0)]
    q = [
        (1, 1, 1, "Width", "12 cm", "m", 0.001), (2, 1, 1, "Width", "12", "ft.", 0.001), (3, 1, 1, "Width", "1'200", None, 0.01), (4, 1, 1, "Width", "12", None, None), (5, 2, 1, "Width", "12", None, None),
        (6, 1, None, "YoungModulus", "30 000", None, None), (7, 1, 1, "PoissonRatio", "0,25", None, None), (8, 1, 1, "PoissonRatio", "25 %", None, None), (9, 1, 1, "Width", "5' 3 1/2\"", None, None), (10, 1, 1, "Width", "max. 1,744.4 mm", None, None),
        (11, 1, 1, "Width", "tbc", "m", None), (12, 1, 1, "Width", None, "m", None), (13, 1, 1, "Width", "3 kg", None, None), (14, 1, 1, "MassDensity", "76.1 lb/cu ft", None, None), (15, 1, 1, "CrossSectionArea", "2 in²", None, None), (16, 1, 1, "Nonsense", "2", "m", None),
    ]
    got = _canon(spark, q, fu)
    assert got[1] == ("text", 120) and got[2] == ("column", 3658) and got[3] == ("scale", 12000) and got[4] == ("file", 12) and got[5] == (None, None)
    assert got[6] == ("file", 30) and got[7] == ("plain", 250) and got[8] == ("text", 250) and got[9] == ("text", 1613) and got[10] == ("text", 1744)
    assert got[11] == got[12] == got[13] == (None, None) and got[14] == ("text", 1219) and got[15] == ("text", 13) and 16 not in got


def test_identity_settles_open_units(spark):
    q = [(1, 1, 7, "YoungModulus", "210", "GPa", None), (2, 1, 7, "ShearModulus", "80.77", None, None), (3, 1, 7, "PoissonRatio", "0.3", None, None), (4, 2, 7, "ShearModulus", "80.77", None, None), (5, 1, 8, "YoungModulus", "-1", None, None)]
    f = spark.createDataFrame([], "file_id long, unit_type string, unit_name string, unit_scale double")
    got = {r.qty_id: r for r in units.common_units(spark.createDataFrame(q, QTY), f).collect()}
    assert got[2].unit_source == "identity" and got[2].canon == 80770 and got[2].ambiguous is False
    assert got[4].unit_source is None and got[5].canon is None


def test_identity_chooses_and_contradicts(spark):
    fu = [(1, "PRESSUREUNIT", "MPa", None), (1, "PRESSUREUNIT", "GPa", None), (2, "PRESSUREUNIT", "GPa", None)]
    q = [(1, 1, 7, "YoungModulus", "210000", None, None), (2, 1, 7, "ShearModulus", "80.77", "GPa", None), (3, 1, 7, "PoissonRatio", "0.3", None, None), (4, 2, 7, "YoungModulus", "210000", None, None), (5, 2, 7, "ShearModulus", "80.77", "GPa", None), (6, 2, 7, "PoissonRatio", "0.3", None, None)]
    f = spark.createDataFrame(fu, "file_id long, unit_type string, unit_name string, unit_scale double")
    got = {r.qty_id: r for r in units.common_units(spark.createDataFrame(q, QTY), f).collect()}
    assert (got[1].unit_source, got[1].canon, got[1].contradicts) == ("file", 210000, False)  # MPa, not the larger GPa
    assert (got[4].unit_source, got[4].canon, got[4].contradicts) == ("file", 210000000, True) and got[4].residual > 1


def test_identity_settles_each_open_row_by_itself(spark):
    q = [
        (1, 1, 7, "YoungModulus", "210", "GPa", None), (2, 1, 7, "ShearModulus", "80.77", None, None), (3, 1, 7, "ShearModulus", "80770", None, None), (3, 1, 7, "ShearModulus", "80770", None, None), (4, 1, 7, "PoissonRatio", "0.3", None, None),
        (5, 1, 8, "YoungModulus", "210", "GPa", None), (6, 1, 8, "YoungModulus", "210000", None, None), (7, 1, 8, "ShearModulus", "80.77", "GPa", None), (8, 1, 8, "PoissonRatio", "0.3", None, None),
        (9, 1, 9, "YoungModulus", "210000", None, None), (10, 1, 9, "PoissonRatio", "0.3", None, None), (None, 1, 8, "ShearModulus", "80770", None, None),
    ]
    f = spark.createDataFrame([], "file_id long, unit_type string, unit_name string, unit_scale double")
    got = units.common_units(spark.createDataFrame(q, QTY), f).where("name <> 'PoissonRatio'").collect()
    assert len(got) == 9
    assert {(r.qty_id, r.unit_source, r.canon) for r in got} == {
        (1, "column", 210000), (2, "identity", 80770), (3, "identity", 80770), (5, "column", 210000), (6, "identity", 210000), (7, "column", 80770), (9, None, None), (None, "identity", 80770),
    }


def test_units_empty(spark):
    assert _canon(spark, []) == {}


# ---------------------------------------------------------------- attribute rows to a wide table

PSETS = "prop_id long, ifc_id long, name string, value string, recorded_at timestamp_ntz, loaded_at timestamp_ntz"


def test_pivot_latest_readable_value(spark):
    a, b = T(2024, 1, 1), T(2024, 1, 2)
    p = [
        (1, 1, "Fire-Rating", "IfcLabel('R 30')", a, a), (2, 1, "firerating", "n/a", b, b), (3, 1, "FireRating ", '"R 60"', a, b), (4, 1, "COUNT", "12.0", a, a), (5, 1, "count", "12-14", b, b), (6, 1, "IsExternal", ".T.", a, a), (7, 1, "U_Value", ".245", None, None),
        (8, 1, "When", "4.8.2022", a, a), (9, 1, "Other", "x", a, a), (10, 2, "When", "2021-13-45", a, a), (11, None, "Count", "1", a, a), (12, 3, None, None, a, a), (13, 1, "IsExternal", "maybe", b, b), (3, 1, "FireRating ", '"R 60"', a, b),
    ]
    d = spark.createDataFrame([("FireRating", "label"), ("Count", "integer"), ("IsExternal", "boolean"), ("UValue", "real"), ("When", "date")], "name string, vtype string")
    w = pivot.wide_table(spark.createDataFrame(p, PSETS), d)
    assert w.columns == ["ifc_id", "Count", "FireRating", "IsExternal", "UValue", "When"]
    assert rows(w) == sorted([(1, 12, "R 60", True, 0.245, dt.date(2022, 8, 4)), (2, *[None] * 5), (3, *[None] * 5)], key=repr)
    assert rows(pivot.cells_of(w, d)) == [(1, "Count", "12"), (1, "FireRating", "R 60"), (1, "IsExternal", "true"), (1, "UValue", "245"), (1, "When", "2022-08-04")]


def test_pivot_keeps_precision(spark):
    a = T(2024, 1, 1)
    p = [(1, 1, "u", "0.0004", a, a), (2, 1, "n", "9007199254740993", a, a), (3, 2, "u", "123456789012345678", a, a), (4, 2, "n", "-9223372036854775808", a, a), (5, 3, "n", "1e3", a, a), (6, 3, "u", "1e400", a, a), (7, 4, "n", "99999999999999999999", a, a)]
    d = spark.createDataFrame([("u", "real"), ("n", "integer")], "name string, vtype string")
    w = pivot.wide_table(spark.createDataFrame(p, PSETS), d)
    assert rows(w.select("ifc_id", "u", "n")) == [(1, 0.0004, 9007199254740993), (2, 123456789012345680.0, -9223372036854775808), (3, None, 1000), (4, None, None)]
    assert rows(pivot.cells_of(w, d)) == [(1, "n", "9007199254740993"), (1, "u", "0"), (2, "n", "-9223372036854775808"), (2, "u", "123456789012345680000"), (3, "n", "1000")]


def test_pivot_empty(spark):
    d = spark.createDataFrame([("A", "label")], "name string, vtype string")
    assert pivot.wide_table(spark.createDataFrame([], PSETS), d).count() == 0
    assert pivot.cells_of(pivot.wide_table(spark.createDataFrame([(1, 1, "a", "b", None, None)], PSETS), d.where("false")), d.where("false")).count() == 0


# ---------------------------------------------------------------- hierarchies

WBS = "object_id long, code string, name string, parent_object_id string, sequence_number int, model_key string, updated_at timestamp_ntz"


def _wbs(spark, entries):
    return spark.createDataFrame([(i, c, None, p, None, None, t) for i, c, p, t in entries], WBS)


def test_hierarchy_edge_cases(spark):
    a, b = T(2024, 1, 1), T(2024, 1, 2)
    e = [(1, " R\t", None, a), (2, "x", " 1", a), (3, "y", "2.0", a), (4, None, "+3", a), (5, "z", "99", a), (6, "l", "7", a), (7, "l", "6", a), (8, "m", "7", a), (9, "s", "9", a), (2, "old", "6", T(2023, 1, 1)), (2, "x", " 1", a), (None, "n", "1", b), (10, "w", "", None)]
    got = rows(hierarchy.wbs_hierarchy(_wbs(spark, e)))
    assert got == sorted([(1, 1, 0, "R"), (2, 1, 1, "R.x"), (3, 1, 2, "R.x.y"), (4, 1, 3, "R.x.y."), (5, 5, 0, "z"), (6, 6, -1, ""), (7, 6, -1, ""), (8, 6, -1, ""), (9, 9, -1, ""), (10, 10, 0, "w")], key=repr)
    assert hierarchy.wbs_hierarchy(_wbs(spark, [])).count() == 0


@pytest.mark.parametrize("doublings", [0, 2])
def test_hierarchy_matches_brute_force(spark, doublings):
    r = random.Random(5)
    n = 150
    parent = {i: (None if r.random() < 0.04 else r.randint(max(0, i - 6), i - 1) if i and r.random() < 0.9 else r.randint(0, n + 20)) for i in range(n)}
    parent |= {i: i - 1 for i in range(200, 240)} | {200: None}
    nodes = spark.createDataFrame([(i, f"c{i}", p) for i, p in parent.items()], "id long, code string, parent long")
    want = {}
    for i in parent:
        path, x = [], i
        while x is not None and x in parent and x not in path:
            path.append(x)
            x = parent[x]
        if x in path:
            want[i] = (min(path[path.index(x) :]), -1, "")
        else:
            want[i] = (path[-1], len(path) - 1, ".".join(f"c{k}" for k in reversed(path)))
    assert {k.id: (k.root_id, k.depth, k.code_path) for k in hierarchy.full_hierarchy(nodes, doublings=doublings).collect()} == want


def test_descendants(spark):
    e = [(1, "a", None, None), (2, "b", "1", None), (3, "c", "2", None), (4, "d", "1", None)]
    assert rows(hierarchy.descendants(_wbs(spark, e))) == [(1, 3, 2), (2, 1, 1), (3, 0, 0), (4, 0, 0)]


def test_descendant_pairs(spark):
    e = [(1, "a", None, None), (2, "b", "1", None), (3, "c", "2", None), (4, "d", "1", None)]
    assert rows(hierarchy.descendant_pairs(_wbs(spark, e + [(5, "l", "5", None), (1, "a", None, None)]))) == [(1, 2, 1), (1, 3, 2), (1, 4, 1), (2, 3, 1)]


# ---------------------------------------------------------------- orphans


def test_orphans(spark):
    t = lambda m, d=1: T(2024, m, d)
    refs = spark.createDataFrame([("a", 1, 10, t(1)), ("a", 2, 11, t(1)), ("a", 3, 12, t(3)), ("a", 4, 13, t(3, 5)), ("a", 5, 13, t(3, 15)), ("a", 6, 14, t(5)), ("a", 6, 14, t(5)), ("b", 7, 10**12, t(2)), ("b", 8, -5, t(2)), ("b", 9, None, t(2)), ("b", 10, 11, None), ("b", 11, 77, None), ("b", 12, 12, None)], "tab string, ref_id long, code long, at timestamp_ntz")
    parents = spark.createDataFrame([(10, t(1), None), (11, t(1), t(2)), (11, t(2), t(3)), (12, t(5), None), (12, t(2), t(3)), (13, t(3, 10), None), (14, None, None), (None, t(1), None)], "code long, added_at timestamp_ntz, deleted_at timestamp_ntz")
    got = rows(orphans.orphans(refs, parents))
    want = [("a", 2, "deleted", "2024-01"), ("a", 4, "late", "2024-03"), ("b", 7, "missing", "2024-02"), ("b", 8, "missing", "2024-02"), ("b", 10, "deleted", ""), ("b", 11, "missing", "")]
    assert got == sorted(want, key=repr)
    assert orphans.orphans(refs.where("false"), parents).count() == 0
    assert orphans.orphans(refs, parents.where("false")).count() == 11


def test_guid_spellings(spark):
    g = "0185e1f2-e904-e289-1feb-945ec6e1fad8"
    df = spark.createDataFrame([(x,) for x in (g, g.upper(), "{" + g + "}", "urn:uuid:" + g, g.replace("-", ""), f" {g}\n", "share/a.pdf", "", None, "odd")], "g string")
    keys = [r[0] for r in df.select(orphans.reference_guid(F.col("g"))).collect()]
    assert set(keys[:6]) == {g.replace("-", "")} and keys[6:9] == [None] * 3 and keys[9] == "text:odd"

"""Operators against brute force or exact round trips on small fixtures."""

import itertools
import json
import os
import random
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from trussflow.operators import audit, compare, planning, plugins, rules, spatial
from trussflow.sources import readers, schemas, spf
from trussflow.streaming import stream


def boxes(spark, n, seed, span=20.0):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        lo = [r.uniform(-span, span) for _ in range(3)]
        rows.append((k, *[x for a in lo for x in (a, a + r.choice([0.0, 1.0, 5.0, r.uniform(0, 8)]))]))
    rows += [(n, 0.0, 4.0, 0.0, 4.0, 0.0, 4.0), (n + 1, 4.0, 8.0, 0.0, 4.0, 0.0, 4.0), (n + 2, None, 1.0, 0.0, 1.0, 0.0, 1.0)]
    return spark.createDataFrame(rows, "id long, minx double, maxx double, miny double, maxy double, minz double, maxz double"), [x for x in rows if None not in x]


@pytest.mark.parametrize("grow", [0.0, 2.5])
def test_box_pairs_match_brute_force(spark, grow):
    a, ra = boxes(spark, 60, 1)
    b, rb = boxes(spark, 60, 2)
    want = sorted((x[0], y[0]) for x in ra for y in rb if all(x[i] - grow <= y[i + 1] and y[i] <= x[i + 1] + grow for i in (1, 3, 5)))
    assert sorted(map(tuple, spatial.box_pairs(a, b, (3.0, 4.0, 5.0), grow).select("a_id", "b_id").collect())) == want


def test_touching_boxes(spark):
    a, _ = boxes(spark, 0, 1)
    ids = lambda mode, **k: sorted((r.a_id, r.b_id) for r in spatial.clash(a, a, mode, (3.0, 3.0, 3.0), same=True, **k).collect())
    assert ids("collision") == [(0, 1)] and ids("collision", allow_touching=True) == [] and ids("intersection") == [] and ids("clearance", clearance=0.1) == [(0, 1)]


def test_clusters_match_brute_force(spark):
    r = random.Random(4)
    pts = [(k, r.uniform(0, 20), r.uniform(0, 20), r.uniform(0, 3)) for k in range(70)]
    label = {p[0]: p[0] for p in pts}
    for _ in pts:
        for p, q in itertools.combinations(pts, 2):
            if sum((a - b) ** 2 for a, b in zip(p[1:], q[1:])) <= 4:
                label[p[0]] = label[q[0]] = min(label[p[0]], label[q[0]])
    got = spatial.clusters(spark.createDataFrame(pts, "id long, x double, y double, z double"), 2.0)
    assert {x.id: x.cluster for x in got.collect()} == label


def test_ray_and_mesh(spark):
    a, _ = boxes(spark, 0, 1)
    assert [(r.id, r.distance) for r in spatial.select_ray(a, (-2, 1, 1), (2, 0, 0), 6.5).orderBy("distance").collect()] == [(0, 2.0), (1, 6.0)]
    m = spatial.mesh_quantities(spatial.box_mesh(a.where("id = 0"))).first()
    assert abs(m.volume - 64) < 1e-9 and abs(m.area - 96) < 1e-9
    none = spark.createDataFrame([(1, None, None)], "id long, verts array<double>, faces array<int>")
    assert spatial.mesh_quantities(none).first().volume is None


def test_placement_is_the_product_of_matrices(spark):
    shift = lambda x, y: [float(v) for v in (1, 0, 0, x, 0, 1, 0, y, 0, 0, 1, 0, 0, 0, 0, 1)]
    turn = [0.0, -1, 0, 0, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]
    df = spark.createDataFrame([(1, 0, shift(1.0, 2.0)), (1, 1, [float(x) for x in turn]), (1, 2, shift(3.0, 0.0))], "id long, step int, m array<double>")
    m = spatial.placement(df).first().matrix
    assert (m[3], m[7]) == (1.0, 5.0)


def test_critical_path_matches_brute_force(spark):
    r = random.Random(6)
    dur = {k: float(r.randint(0, 9)) for k in range(25)}
    links = sorted({(a, b) for a, b in ((r.randint(0, 24), r.randint(0, 24)) for _ in range(45)) if a < b})
    edges = [(a, b, r.choice(["FS", "SS", "FF", "SF"]), float(r.randint(0, 3))) for a, b in links]
    gap = lambda a, b, t, lag: {"FS": dur[a] + lag, "SS": lag, "FF": dur[a] + lag - dur[b], "SF": lag - dur[b]}[t]
    early = dict.fromkeys(dur, 0.0)
    for _ in dur:
        for e in edges:
            early[e[1]] = max(early[e[1]], early[e[0]] + gap(*e))
    end = max(early[k] + dur[k] for k in dur)
    late = {k: end - dur[k] for k in dur}
    for _ in dur:
        for e in edges:
            late[e[0]] = min(late[e[0]], late[e[1]] - gap(*e))
    got = planning.critical_path(spark.createDataFrame(list(dur.items()), "id long, duration double"), spark.createDataFrame(edges, "pred long, succ long, type string, lag double"))
    for x in got.collect():
        assert (x.early_start, x.late_start, x.is_critical) == (early[x.id], late[x.id], abs(late[x.id] - early[x.id]) < 1e-9)


def test_task_loop_raises(spark):
    with pytest.raises(ValueError):
        planning.critical_path(spark.createDataFrame([(1, 1.0), (2, 1.0)], "id long, duration double"), spark.createDataFrame([(1, 2, "FS", 0.0), (2, 1, "FS", 0.0)], "pred long, succ long, type string, lag double"), max_rounds=5)


def test_diff_with_nulls_lists_and_tolerance(spark):
    old = spark.createDataFrame([(1, 1.0, ["a", "b"], None), (2, 1.0, None, "x"), (3, None, None, None)], "k long, v double, l array<string>, t string")
    new = spark.createDataFrame([(1, 1.0 + 1e-9, ["b", "a"], None), (2, 2.0, ["a"], None), (4, None, None, None)], "k long, v double, l array<string>, t string")
    got = sorted((r.k, r.status, tuple(r.changed)) for r in compare.diff(old, new, "k").collect())
    assert got == [(2, "changed", ("v", "l", "t")), (3, "deleted", ()), (4, "added", ())]


def test_rules(spark):
    df = spark.createDataFrame([(1, [1, 5, None]), (2, None)], "id long, a array<int>")
    got = {r.id: (r.n, r.x) for r in df.select("id", rules.sizeof(rules.query(F.col("a"), lambda x: x > 2)).alias("n"), rules.item(F.col("a"), 2).alias("x")).collect()}
    assert got == {1: (1, 5), 2: (0, None)}
    bad = rules.schema_check(df, "id", {"a": {"max_size": 2}}).collect()
    assert sorted((r.id, r.problem) for r in bad) == [(1, "too many members"), (2, "not given")]


STEP = "ISO-10303-21;\nHEADER;\nFILE_DESCRIPTION(('View'),'2;1');\nFILE_NAME('a.ifc','',(''),(''),'','','');\nFILE_SCHEMA(('IFC4'));\nENDSEC;\nDATA;\n#1=IFCORGANIZATION($,'O''Hara; #9',$,$,$);\n#2=IFCWALL('g',#1,\n 'n\\X2\\00E9\\X0\\',*,.SOLID.,(#1,#3),IFCLABEL('x,y'));\nENDSEC;\nEND-ISO-10303-21;\n"


def test_spf_file_round_trip(spark, tmp_path):
    p = tmp_path / "a.ifc"
    p.write_text(STEP)
    t = readers.open_model(spark, str(p))
    got = {r.id: r for r in t.collect()}
    assert set(got) == {1, 2} and got[2].refs == [1, 1, 3] and got[1].refs == [] and got[2].args[6] == "IFCLABEL('x,y')"
    assert t.where("id = 1").select(spf.argument(1)).first()[0] == "O'Hara; #9" and spf.decode_string("n\\X2\\00E9\\X0\\") == "né" and spf.decode_string(spf.encode_string("a'é\\😀")) == "a'é\\😀"
    assert spf.read_header(spark, str(p)).first().schema == "IFC4"
    assert spf.read_spf(spark, str(p), ["IfcWall"]).count() == 1
    spf.write_spf(t, str(tmp_path / "out"))
    assert sorted(map(tuple, readers.open_model(spark, str(tmp_path / "out"), "spf").select("id", "class").collect())) == [(1, "IFCORGANIZATION"), (2, "IFCWALL")]
    with zipfile.ZipFile(tmp_path / "a.ifczip", "w") as z:
        z.writestr("a.ifc", STEP)
    assert readers.open_model(spark, str(tmp_path / "a.ifczip")).count() == 2


def test_spf_line_ends_shared_lines_escapes_and_splits(spark, tmp_path):
    head = "ISO-10303-21;\r\nHEADER;\r\nFILE_DESCRIPTION(('a;b'),'2;1');FILE_NAME('n','',(''),(''),'','','');\r\nFILE_SCHEMA(('IFC4X3'));\r\nENDSEC;\r\nDATA;\r\n"
    body = "".join(f"#{k}=IFCWALL('it''s; {k}\r\n;#9{k}=IFCFAKE(',$,\n #1);#{k + 1000}=IFCSLAB('n\\X2\\00E9\\X0\\\\X\\E9\\S\\i',#{k});\r\n" for k in range(1, 200))
    p = tmp_path / "m.ifc"
    p.write_text(head + body + "ENDSEC;\r\nEND-ISO-10303-21;\r\n", newline="")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in ("997", size):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            t = spf.read_spf(spark, str(p)).select("id", "class", "refs", spf.argument(0).alias("name"))
            got = {r.id: (r["class"], r.refs, r.name) for r in t.collect()}
            assert len(got) == t.count() == 398
            assert all(got[k] == ("IFCWALL", [1], f"it's; {k}\r\n;#9{k}=IFCFAKE(") and got[k + 1000] == ("IFCSLAB", [k], "nééé") for k in range(1, 200))
        assert spf.read_header(spark, str(p)).first().schema == "IFC4X3"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_spf_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.ifc").write_text(STEP)
    assert sorted(r.id for r in stream.drain(stream.read_instances(spark, str(src))).collect()) == [1, 2]
    stream.upsert_index(stream.read_instances(spark, str(src)), str(tmp_path / "index"))
    assert {r["class"] for r in spark.read.parquet(str(tmp_path / "index")).collect()} == {"IFCORGANIZATION", "IFCWALL"}


def test_stream_resolves_late_references(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.ifc").write_text("#1=IFCA(#2,#7);\n")
    (src / "b.ifc").write_text("#2=IFCB($);\n")
    got = stream.resolve_references(stream.read_instances(spark, str(src), files_per_trigger=1), str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == [(1, 2, True), (1, 7, False)]


def test_plugins(spark):
    reg, seen = plugins.Registry(), []
    reg.register("double")(lambda df, by=2: df.withColumn("v", F.col("v") * by))
    reg.on("*", lambda name, df, settings: seen.append((name, settings)))
    reg.on("double", lambda name, df, settings: df.where("v > 2"), after=True)
    df = spark.createDataFrame([(1, 1), (2, 0), (3, None)], "k int, v int")
    assert [tuple(r) for r in reg.run("double", df, by=3).collect()] == [(1, 3)] and seen == [("double", {"by": 3})]
    with pytest.raises(ValueError):
        reg.run("none", df)
    got = sorted(map(tuple, plugins.foreach(df.na.fill(0), "k", lambda row: 6 // row["v"]).collect()))
    assert got == [(1, "6", None), (2, None, "ZeroDivisionError: integer division or modulo by zero"), (3, None, "ZeroDivisionError: integer division or modulo by zero")]


def test_presets(spark, data):
    from trussflow.model import test_model as graph
    from trussflow.plans.selector import Selector

    s = Selector(graph(spark, data))
    t = plugins.presets(s.select, s.path, {"Customers": ("Customer", "Customer, AcctBal>0", {"Region": "nation.region.Name", "Orders": "orders.count"})})
    assert t["Customers"].columns == ["id", "name", "Region", "Orders"] and t["Customers"].where("Region is null").count() == 0


def test_other_sources(spark, tmp_path):
    assert [readers.guess_format(x) for x in ("a.IFC", "b.ifczip", "c.xer", "dir")] == ["spf", "zip", "xer", "parquet"]
    (tmp_path / "p.xer").write_text("ERMHDR\n%T\tTASK\n%F\tid\tname\n%R\t1\tDig\n%R\t2\tPour\n%E\n")
    rows = planning.p6_tables(readers.open_model(spark, str(tmp_path / "p.xer"))).collect()
    assert [(r.table, r.row["name"]) for r in rows] == [("TASK", "Dig"), ("TASK", "Pour")]
    (tmp_path / "m.xml").write_text("<Project><Tasks><Task><UID>1</UID><Name>Dig</Name></Task><Task><UID>2</UID><Name>Pour</Name></Task></Tasks></Project>")
    assert sorted(r.Name for r in readers.open_model(spark, str(tmp_path / "m.xml")).collect()) == ["Dig", "Pour"]
    doc = spark.createDataFrame([(json.dumps({"CityObjects": {"b": {"type": "Building"}, "p": {"type": "BuildingPart", "parents": ["b"]}}}),)], "value string")
    assert sorted((r.id, r.type, tuple(r.parents)) for r in readers.city_objects(doc).collect()) == [("b", "Building", ()), ("p", "BuildingPart", ("b",))]
    readers.write_tables({"t": spark.createDataFrame([(1, "x"), (2, "y")], "id int, class string")}, str(tmp_path / "w"), partition={"t": "class"})
    assert os.path.isdir(tmp_path / "w" / "t" / "class=x")
    with sqlite3.connect(tmp_path / "s.db") as con:
        con.execute("CREATE TABLE psets (ifc_id INTEGER, name TEXT, value REAL)")
        con.executemany("INSERT INTO psets VALUES (?, ?, ?)", [(k, f"n{k}", k / 2 if k else None) for k in range(20)])
    t = schemas.read_sqlite(spark, str(tmp_path / "s.db"), "psets")
    assert t.count() == 20 and t.agg(F.sum("value")).first()[0] == 95.0 and dict(t.dtypes) == {"ifc_id": "bigint", "name": "string", "value": "double"}


def test_express_schema():
    s = schemas.read_express("SCHEMA X; (* c *) ENTITY root ABSTRACT SUPERTYPE; id : STRING; note : OPTIONAL STRING; UNIQUE UR1 : id; END_ENTITY; ENTITY wall SUBTYPE OF (root); h : REAL; WHERE WR1 : h > 0.; END_ENTITY; END_SCHEMA;")
    assert s["root"]["attributes"] == {"id": ("STRING", False), "note": ("STRING", True)} and s["wall"]["rules"] == {"WR1": "h > 0."} and s["root"]["unique"] == {"UR1": ["id"]}
    assert schemas.taxonomy_rows(s) == [("root", "root", 0), ("wall", "wall", 0), ("wall", "root", 1)]


IDS = """<ids xmlns="http://standards.buildingsmart.org/IDS" xmlns:xs="http://www.w3.org/2001/XMLSchema"><specifications>
<specification name="walls"><applicability minOccurs="1" maxOccurs="unbounded"><entity><name><simpleValue>IFCWALL</simpleValue></name></entity></applicability>
<requirements><attribute><name><simpleValue>Name</simpleValue></name><value><xs:restriction base="xs:string"><xs:pattern value="W[0-9]+"/></xs:restriction></value></attribute></requirements></specification>
<specification name="no doors"><applicability minOccurs="0" maxOccurs="0"><entity><name><simpleValue>IFCDOOR</simpleValue></name></entity></applicability></specification>
</specifications></ids>"""


def test_ids_document(spark):
    df = spark.createDataFrame([(1, "IfcWall", "W1"), (2, "IfcWall", "X"), (3, "IfcWall", None), (4, "IfcDoor", "D")], "id long, class string, name string")
    specs = schemas.read_ids(IDS, columns={"Name": "name"})
    assert sorted(map(tuple, audit.statuses(df, specs).collect())) == [("no doors", 1, 0, "fail"), ("walls", 3, 2, "fail")]
    failed = audit.results(df, "id", specs[:1]).where("not passed")
    assert sorted((r.entity, r.reason) for r in failed.collect()) == [(2, "The attribute name does not fit"), (3, "The attribute name is missing")]

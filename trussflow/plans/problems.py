"""Queries of the general data problems, bound to the test tables, with their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trussflow.operators import drift, hierarchy, nested, orphans, pivot, units
from trussflow.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = drift.changes(table(spark, d, "id_map_exports"), table(spark, d, "metadata"))
    return rows.select("file_id", "change_kind", "old_name", "new_name").distinct()


def p1_id_map(spark: SparkSession, d: str) -> DataFrame:
    t = drift.consistent_table(table(spark, d, "id_map_exports"), table(spark, d, "metadata"))
    return t.withColumn("failed", F.to_json("failed"))


def p1_failed_casts(spark: SparkSession, d: str) -> DataFrame:
    return drift.failed_casts(drift.consistent_table(table(spark, d, "id_map_exports"), table(spark, d, "metadata")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.bcf_links(table(spark, d, "bcf_archives"))


def _p2(name: str):
    return lambda spark, d: nested.bcf_tables(table(spark, d, "bcf_archives"))[name]


def p2_schema(spark: SparkSession, d: str) -> DataFrame:
    return nested.merged_schema(nested.shred(table(spark, d, "bcf_archives"), "raw_id", "archive_guid", "payload"))


def p3_units(spark: SparkSession, d: str) -> DataFrame:
    return units.common_units(table(spark, d, "quantities"), table(spark, d, "file_units")).distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    u = units.common_units(table(spark, d, "quantities"), table(spark, d, "file_units"))
    declared = F.col("unit_source").isin("text", "column", "scale", "file")
    return u.where(declared & F.col("canon").isNotNull() & (F.abs(F.col("factor") - 1) > 1e-12)).select("qty_id", "canon").distinct()


def p4_wide(spark: SparkSession, d: str) -> DataFrame:
    return pivot.wide_table(table(spark, d, "psets"), table(spark, d, "property_defs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pivot.cells_of(p4_wide(spark, d), table(spark, d, "property_defs"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.wbs_hierarchy(table(spark, d, "wbs"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(table(spark, d, "wbs"))


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendant_pairs(table(spark, d, "wbs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.model_orphans(*(table(spark, d, t) for t in ("psets", "quantities", "bcf_references", "id_map", "bcf_documents")))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(p6_found(spark, d))


QUERIES = {
    "p1_found": p1_found, "p1_id_map": p1_id_map, "p1_failed_casts": p1_failed_casts,
    "p2_found": p2_found, "p2_schema": p2_schema,
    **{f"p2_{n}": _p2(n) for n in nested.BCF_TABLES},
    "p3_found": p3_found, "p3_units": p3_units,
    "p4_found": p4_found, "p4_wide": p4_wide,
    "p5_found": p5_found, "p5_descendants": p5_descendants, "p5_pairs": p5_pairs,
    "p6_found": p6_found, "p6_report": p6_report,
}

SQL: dict[str, str] = {}


_GUID = "regexp_replace(replace(lower({0}), 'urn:uuid:', ''), '[^0-9a-f]', '', 'g')"

SQL["p1_found"] = """
WITH p AS (SELECT DISTINCT file_id, global_id, payload FROM id_map_exports WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
e AS (SELECT file_id, global_id, payload, unnest(json_keys(payload)) AS path FROM p),
r AS (SELECT file_id, global_id, path, json_extract(payload, '$."' || path || '"') AS raw FROM e),
rows_ AS (SELECT file_id, global_id, path, CAST(raw AS VARCHAR) AS raw,
    CASE json_type(raw) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS kind
    FROM r WHERE raw IS NOT NULL AND json_type(raw) <> 'NULL'),
stats AS (SELECT file_id, path, max(kind) AS kind FROM rows_ GROUP BY ALL),
m AS (SELECT DISTINCT file_id, series_id, exported_at, regexp_replace(upper(coalesce(schema, '')), '[^A-Z0-9]', '', 'g') AS sk FROM metadata),
pairs AS (SELECT * FROM (SELECT file_id, sk, lag(file_id) OVER w AS prev_id, lag(sk) OVER w AS prev_sk FROM m WINDOW w AS (PARTITION BY series_id ORDER BY exported_at, file_id)) WHERE prev_id IS NOT NULL),
began AS (SELECT q.file_id, q.prev_id, s.path FROM pairs q JOIN stats s USING (file_id) WHERE NOT EXISTS (SELECT 1 FROM stats t WHERE t.file_id = q.prev_id AND t.path = s.path)),
ended AS (SELECT q.file_id, q.prev_id, s.path FROM pairs q JOIN stats s ON s.file_id = q.prev_id WHERE NOT EXISTS (SELECT 1 FROM stats t WHERE t.file_id = q.file_id AND t.path = s.path)),
ren AS (SELECT b.file_id, x.path AS old_name, b.path AS new_name FROM began b JOIN ended x ON x.file_id = b.file_id
    JOIN rows_ n ON n.file_id = b.file_id AND n.path = b.path JOIN rows_ o ON o.file_id = b.prev_id AND o.path = x.path AND o.global_id = n.global_id
    GROUP BY ALL HAVING bool_and(n.raw = o.raw))
SELECT file_id, 'renamed' AS change_kind, old_name, new_name FROM ren
UNION SELECT file_id, 'added', '', path FROM began b WHERE NOT EXISTS (SELECT 1 FROM ren WHERE ren.file_id = b.file_id AND ren.new_name = b.path)
UNION SELECT file_id, 'removed', path, '' FROM ended b WHERE NOT EXISTS (SELECT 1 FROM ren WHERE ren.file_id = b.file_id AND ren.old_name = b.path)
UNION SELECT q.file_id, 'retyped', s.path, s.path FROM pairs q JOIN stats s USING (file_id) JOIN stats t ON t.file_id = q.prev_id AND t.path = s.path WHERE s.kind <> t.kind
UNION SELECT file_id, 'schema', prev_sk, sk FROM pairs WHERE sk <> prev_sk
"""

SQL["p4_found"] = """
WITH d AS (SELECT name, vtype, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS k FROM property_defs),
c0 AS (SELECT p.ifc_id, d.name, d.vtype, p.recorded_at, p.loaded_at, p.prop_id, trim(replace(p.value, chr(160), ' '), ' ' || chr(9) || chr(10)) AS t
    FROM psets p JOIN d ON regexp_replace(lower(p.name), '[^a-z0-9]', '', 'g') = d.k WHERE p.ifc_id IS NOT NULL AND p.value IS NOT NULL),
c1 AS (SELECT * REPLACE (trim(regexp_replace(t, '^[Ii][Ff][Cc][A-Za-z0-9_]*\\((.*)\\)$', '\\1')) AS t) FROM c0),
c AS (SELECT * REPLACE (trim(regexp_replace(regexp_replace(t, '^''(.*)''$', '\\1'), '^"(.*)"$', '\\1')) AS t) FROM c1),
n AS (SELECT *, lower(t) AS low, TRY_CAST(replace(CASE WHEN regexp_matches(t, '^[+-]?\\d{1,3}([ '']\\d{3})+$') THEN regexp_replace(t, '[ '']', '', 'g') ELSE t END, ',', '.') AS DOUBLE) AS x FROM c
    WHERE lower(t) NOT IN ('', '-', '$', 'null', 'n/a', 'k.a.', 'unset', 'notdefined', 'tbd')),
v AS (SELECT ifc_id, name, recorded_at, loaded_at, prop_id, CASE vtype
    WHEN 'boolean' THEN CASE WHEN low IN ('true', '.t.', '1', 'yes', 'y', 'ja') THEN 'true' WHEN low IN ('false', '.f.', '0', 'no', 'n', 'nein') THEN 'false' END
    WHEN 'integer' THEN CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) END
    WHEN 'real' THEN CAST(CAST(round(x * 1000) AS BIGINT) AS VARCHAR)
    WHEN 'date' THEN CAST(CAST(coalesce(try_strptime(left(t, 10), '%Y-%m-%d'), try_strptime(t, '%d.%m.%Y'), try_strptime(t, '%Y/%m/%d'), CASE WHEN length(t) = 8 THEN try_strptime(t, '%Y%m%d') END, try_strptime(t, '%d %b %Y'), try_strptime(t, '%b %d, %Y')) AS DATE) AS VARCHAR)
    ELSE t END AS val FROM n)
SELECT ifc_id, name, max_by(val, row(recorded_at, loaded_at, prop_id)) AS val FROM v WHERE val IS NOT NULL GROUP BY ifc_id, name
"""

#: The wanted columns of the test data by type.
_WANTED = {
    "BOOLEAN": "IsExternal LoadBearing ExtendToStructure Combustible SelfClosing SmokeStop HandicapAccessible PubliclyAccessible FireExit IsExtendedWarranty",
    "BIGINT": "OccupancyNumber NumberOfRiser NumberOfTreads ServiceLifeYears MeanTimeBetweenFailure CrewCount",
    "DOUBLE": "ThermalTransmittance GlazingAreaFraction PitchAngle GrossPlannedArea RiserHeight RequiredSlope PercentDone",
    "DATE": "WarrantyStartDate WarrantyEndDate AcquisitionDate LastInspection",
    "VARCHAR": "Reference Status FireRating AcousticRating SecurityRating FloorCovering OccupancyType WarrantyIdentifier BarCode SerialNumber AssemblyPlace Phase",
}

SQL["p4_wide"] = f"""
WITH cells AS ({SQL["p4_found"].replace("CAST(CAST(round(x * 1000) AS BIGINT) AS VARCHAR)", "CAST(x AS VARCHAR)")})
SELECT e.ifc_id, {", ".join(f"CAST(max(CASE WHEN name = '{n}' THEN val END) AS {t}) AS {n}" for t, names in _WANTED.items() for n in names.split())}
FROM (SELECT DISTINCT ifc_id FROM psets WHERE ifc_id IS NOT NULL) e LEFT JOIN cells c ON c.ifc_id = e.ifc_id GROUP BY e.ifc_id
"""

_WBS = """
WITH RECURSIVE last_ AS (SELECT object_id AS id, trim(coalesce(code, ''), ' ' || chr(9)) AS code,
        CAST(TRY_CAST(trim(parent_object_id, ' +' || chr(9)) AS DOUBLE) AS BIGINT) AS p
    FROM wbs QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY updated_at DESC) = 1),
nodes AS (SELECT id, code, CASE WHEN p IN (SELECT id FROM last_) THEN p END AS parent FROM last_),
walk AS (SELECT id, id AS root_id, CAST(0 AS BIGINT) AS depth, code AS code_path, [id] AS ids FROM nodes WHERE parent IS NULL
    UNION ALL SELECT n.id, w.root_id, w.depth + 1, w.code_path || '.' || n.code, list_append(w.ids, n.id) FROM walk w JOIN nodes n ON n.parent = w.id),
"""

SQL["p5_found"] = _WBS + """
rest AS (SELECT id, parent FROM nodes WHERE id NOT IN (SELECT id FROM walk)),
chase AS (SELECT id AS start, [id] AS seen, parent AS cur FROM rest
    UNION ALL SELECT c.start, list_append(c.seen, c.cur), r.parent FROM chase c JOIN rest r ON r.id = c.cur WHERE NOT list_contains(c.seen, c.cur))
SELECT id AS object_id, root_id, depth, code_path FROM walk
UNION ALL SELECT start, list_min(list_slice(seen, list_position(seen, cur), length(seen))), CAST(-1 AS BIGINT), '' FROM chase WHERE list_contains(seen, cur)
"""

SQL["p5_descendants"] = _WBS + """
pairs AS (SELECT id, depth, unnest(ids) AS ancestor, unnest(range(length(ids))) AS pos FROM walk)
SELECT ancestor AS object_id, count(*) - 1 AS n_descendants, CAST(max(depth - pos) AS BIGINT) AS max_steps FROM pairs GROUP BY ancestor
"""

SQL["p5_pairs"] = _WBS + """
pairs AS (SELECT id, depth, unnest(ids) AS ancestor, unnest(range(length(ids))) AS pos FROM walk)
SELECT ancestor AS object_id, id AS descendant_id, depth - pos AS steps FROM pairs WHERE depth > pos
"""

SQL["p6_found"] = f"""
WITH pid AS (SELECT ifc_id AS k, bool_or(deleted_at IS NULL) AS live, min(added_at) AS first_ FROM id_map GROUP BY 1),
pdoc AS (SELECT {_GUID.format('guid')} AS k, bool_or(deleted_at IS NULL) AS live, min(added_at) AS first_ FROM bcf_documents GROUP BY 1),
refs AS (SELECT DISTINCT 'psets' AS tab, prop_id AS ref_id, ifc_id AS k, recorded_at AS ts FROM psets WHERE ifc_id IS NOT NULL
    UNION SELECT 'quantities', qty_id, ifc_id, recorded_at FROM quantities WHERE ifc_id IS NOT NULL),
dref AS (SELECT DISTINCT 'bcf_references' AS tab, ref_id, {_GUID.format('document_guid')} AS k, created_at AS ts FROM bcf_references WHERE trim(document_guid) <> ''),
all_ AS (SELECT r.*, p.k AS found, live, first_ FROM refs r LEFT JOIN pid p ON p.k = r.k
    UNION ALL SELECT r.tab, r.ref_id, 0, r.ts, CASE WHEN p.k IS NULL THEN NULL ELSE 0 END, live, first_ FROM dref r LEFT JOIN pdoc p ON p.k = r.k)
SELECT tab, ref_id, CASE WHEN found IS NULL THEN 'missing' WHEN NOT live THEN 'deleted' ELSE 'late' END AS reason, strftime(ts, '%Y-%m') AS month_key
FROM all_ WHERE found IS NULL OR NOT live OR first_ > ts
"""

SQL["p6_report"] = f"SELECT tab, month_key, reason, count(*) AS n FROM ({SQL['p6_found']}) GROUP BY ALL"


def _unit_values() -> str:
    return ", ".join(f"('{kind}', '{k.replace(chr(39), chr(39) * 2)}', {f!r})" for kind, u in units.UNITS.items() for f, keys in u.items() for k in keys)


_UNIT_KEY = "regexp_replace(replace(replace(lower({0}), '²', '2'), '³', '3'), '[ ._^' || chr(160) || ']', '', 'g')"
_NUM = "[+-]?(\\d{1,3}([ '']\\d{3})+([.,]\\d+)?|\\d{1,3}(,\\d{3})+\\.\\d+|\\d{1,3}(\\.\\d{3})+,\\d+|\\d+([.,]\\d+)?)([eE][+-]?\\d+)?"

SQL["p3_found"] = f"""
WITH u(kind, k, f) AS (VALUES {_unit_values()}),
names(name, kind, unit_type, scale) AS (VALUES {", ".join(f"('{n}', '{k}', '{t}', {s!r})" for n, (k, t, s) in units.QUANTITIES.items())}),
fu AS (SELECT file_id, unit_type, max(coalesce(u.f, CASE WHEN unit_name IS NULL THEN unit_scale END)) AS f FROM file_units x
    LEFT JOIN (SELECT DISTINCT unit_type AS t, kind FROM names) k ON k.t = x.unit_type LEFT JOIN u ON u.kind = k.kind AND u.k = {_UNIT_KEY.format('x.unit_name')} GROUP BY ALL),
q AS (SELECT DISTINCT qty_id, file_id, n.name, kind, n.unit_type, scale, unit, unit_scale,
    regexp_replace(trim(replace(value, chr(160), ' ')), '^(max|approx|ca)\\.? *|^~ *', '') AS t FROM quantities JOIN names n USING (name)),
s AS (SELECT *, regexp_extract(t, '^(\\d+) *(''|ft) *-? *(\\d+)( (\\d+)/(\\d+))? *("|in)$', ['ft', 'a', 'inch', 'b', 'num', 'den', 'c']) AS fi, regexp_extract(t, '^{_NUM}') AS num FROM q),
w AS (SELECT *, fi.ft <> '' AS feet, CASE WHEN fi.ft <> '' THEN CAST(fi.ft AS DOUBLE) * 12 + CAST(fi.inch AS DOUBLE) + coalesce(TRY_CAST(fi.num AS DOUBLE) / TRY_CAST(fi.den AS DOUBLE), 0)
    ELSE TRY_CAST(replace(CASE WHEN regexp_matches(num, '\\..*,') THEN replace(num, '.', '') WHEN regexp_matches(num, ',.*\\.') THEN replace(num, ',', '') ELSE regexp_replace(num, '[ '']', '', 'g') END, ',', '.') AS DOUBLE) END AS x,
    CASE WHEN fi.ft <> '' THEN 'in' ELSE {_UNIT_KEY.format("substr(t, length(num) + 1)")} END AS tu, {_UNIT_KEY.format("unit")} AS cu FROM s),
r AS (SELECT qty_id, x, scale, CASE WHEN tu <> '' THEN a.f WHEN coalesce(cu, '') <> '' THEN b.f WHEN w.kind = 'length' AND unit_scale IS NOT NULL THEN unit_scale ELSE fu.f END AS f
    FROM w LEFT JOIN u a ON a.kind = w.kind AND a.k = tu LEFT JOIN u b ON b.kind = w.kind AND b.k = cu LEFT JOIN fu ON fu.file_id = w.file_id AND fu.unit_type = w.unit_type)
SELECT qty_id, CAST(round(x * f * scale) AS BIGINT) AS canon FROM r WHERE x IS NOT NULL AND f IS NOT NULL AND abs(f - 1) > 1e-12
"""

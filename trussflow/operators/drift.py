"""Schemas that drift between files.

Rows are loaded as maps from path to raw value with its JSON type, path-type statistics are aggregated by file, the files
of a series are compared with their predecessor, and typed columns are projected with a report of failed casts.

Defined results: a payload that is null, empty, unreadable or no JSON object counts for nothing; a JSON null is no value;
exact repeats of a record count once; equal export times are ordered by file id; a file without readable records has no
fields; records without global id take part in the statistics but in no comparison of values. Very long payloads are
handled like short ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trussflow.operators.graph import components
from trussflow.session import lookup_join, materialize

#: Columns wanted in the consistent table and the names any export may start from (fixed values of the data model).
TARGETS = {
    "ifc_id": ("bigint", ["ifc_id"]),
    "ifc_class": ("string", ["ifc_class"]),
    "name": ("string", ["name"]),
    "storey": ("string", ["storey"]),
    "tag": ("string", ["tag"]),
    "volume": ("double", ["volume"]),
    "load_bearing": ("boolean", ["load_bearing"]),
}


def _kind(v: Column) -> Column:
    s = F.schema_of_variant(v)
    return (
        F.when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .when(s.startswith("OBJECT"), "object")
        .when(s.startswith("ARRAY"), "array")
        .when(s != "VOID", "number")
    )


def path_maps(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds ``paths``: map from field to struct(kind, raw); null for payloads that do not parse to an object."""
    v = F.try_parse_json(F.col(payload))
    entries = F.map_entries(F.col("_doc").try_cast("map<string,variant>"))
    values = F.filter(F.transform(entries, lambda e: F.struct(e["key"].alias("path"), _kind(e["value"]).alias("kind"), F.to_json(e["value"]).alias("raw"))), lambda e: e["kind"].isNotNull())
    doc = df.withColumn("_doc", v).where(F.schema_of_variant("_doc").startswith("OBJECT"))
    return doc.withColumn("paths", values).drop("_doc")


def path_rows(records: DataFrame) -> DataFrame:
    """One row for each record and non-null field: file_id, global_id, path, kind, raw."""
    return path_maps(records).select("file_id", "global_id", F.inline("paths"))


def path_statistics(rows: DataFrame) -> DataFrame:
    """Per file and path: number of values and the type most of them have (the first by name among equals)."""
    by_kind = rows.groupBy("file_id", "path", "kind").agg(F.count("*").alias("n"))
    return by_kind.groupBy("file_id", "path").agg(
        F.sum("n").alias("values"), F.max_by("kind", F.struct("n", F.col("kind"))).alias("kind"), F.count("*").cast("int").alias("kinds")
    )


def file_order(metadata: DataFrame) -> DataFrame:
    """file_id, prev_id and both reduced schemas, for the files of each series in order of export."""
    files = metadata.select("file_id", "series_id", "exported_at", F.coalesce(F.regexp_replace(F.upper("schema"), "[^A-Z0-9]", ""), F.lit("")).alias("schema_key"))
    files = files.groupBy("file_id").agg(F.max(F.struct("exported_at", "series_id", "schema_key")).alias("f")).select("file_id", "f.*")
    w = Window.partitionBy("series_id").orderBy("exported_at", "file_id")
    return files.withColumns({"prev_id": F.lag("file_id").over(w), "prev_schema": F.lag("schema_key").over(w)}).where(F.col("series_id").isNotNull())


def changes(exports: DataFrame, metadata: DataFrame) -> DataFrame:
    """file_id, change_kind, old_name, new_name, matches: every change of a file against the one before it.

    ``matches`` is the number of records that support a renaming, null for other changes. Values are compared on
    aggregates (least and greatest raw value per record and field), so copies of a record never multiply.
    """
    rows = materialize(path_rows(exports.select("file_id", "global_id", "payload")), "paths")
    pairs = file_order(metadata)
    pairs = pairs.where("prev_id is not null").select("file_id", "prev_id", "schema_key", "prev_schema")
    stats = path_statistics(rows).select("file_id", "path", "kind")

    new = pairs.select("file_id", "prev_id").join(stats, "file_id")
    old = pairs.select("file_id", "prev_id").join(stats.select(F.col("file_id").alias("prev_id"), "path", F.col("kind").alias("old_kind")), "prev_id")
    both = materialize(new.join(old, ["file_id", "prev_id", "path"], "full_outer"), "fields")
    began = both.where("old_kind is null").select("file_id", "prev_id", F.col("path").alias("new_name"))
    ended = both.where("kind is null").select("file_id", "prev_id", F.col("path").alias("old_name"))

    # Only fields that stop or begin have their values compared. Equal values of one record are found by a hash join on the
    # value; a pair is a renaming if as many records agree as hold both fields.
    cells = rows.where("global_id is not null").groupBy("file_id", "global_id", "path").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))
    after = began.join(cells.withColumnRenamed("path", "new_name"), ["file_id", "new_name"])
    before = ended.join(cells.select(F.col("file_id").alias("prev_id"), F.col("path").alias("old_name"), "global_id", F.col("lo").alias("old_lo"), F.col("hi").alias("old_hi")), ["prev_id", "old_name"])
    one = after.where("lo = hi").select("file_id", "prev_id", "global_id", "new_name", F.col("lo").alias("raw"))
    two = before.where("old_lo = old_hi").select("file_id", "prev_id", "global_id", "old_name", F.col("old_lo").alias("raw"))
    agree = materialize(one.join(two, ["file_id", "prev_id", "global_id", "raw"]).groupBy("file_id", "prev_id", "old_name", "new_name").agg(F.count("*").alias("matches")), "agree")
    # Records that hold both fields, for the pairs that agree somewhere only.
    held = after.select("file_id", "global_id", "new_name").join(agree, ["file_id", "new_name"]).join(before.select("file_id", "prev_id", "global_id", "old_name"), ["file_id", "prev_id", "global_id", "old_name"])
    held = held.groupBy("file_id", "old_name", "new_name", "matches").agg(F.count("*").alias("both"))
    renamed = held.where("both = matches").select("file_id", F.lit("renamed").alias("change_kind"), "old_name", "new_name", "matches")
    renamed = materialize(renamed, "renamed")
    none = F.lit(None).cast("bigint").alias("matches")
    added = began.join(renamed, ["file_id", "new_name"], "left_anti").select("file_id", F.lit("added").alias("change_kind"), F.lit("").alias("old_name"), "new_name", none)
    removed = ended.join(renamed, ["file_id", "old_name"], "left_anti").select("file_id", F.lit("removed").alias("change_kind"), "old_name", F.lit("").alias("new_name"), none)
    retyped = both.where("kind <> old_kind").select("file_id", F.lit("retyped").alias("change_kind"), F.col("path").alias("old_name"), F.col("path").alias("new_name"), none)
    schema = pairs.where("schema_key <> prev_schema").select("file_id", F.lit("schema").alias("change_kind"), F.col("prev_schema").alias("old_name"), F.col("schema_key").alias("new_name"), none)
    out = renamed
    for part in (added, removed, retyped, schema):
        out = out.unionByName(part)
    return out


def _regardless_of_case(grouped: DataFrame, side: DataFrame) -> DataFrame:
    """path, component: the components of ``grouped`` that hold names alike but for case are one, unless a file (``side``) has both."""
    alike = grouped.select(F.lower("path").alias("low"), "component").distinct()
    edges = alike.withColumnRenamed("component", "a").join(alike.withColumnRenamed("component", "b"), "low").where("a < b").select("a", "b").distinct()
    held = side.join(grouped, "path").select("file_id", "component").distinct()
    together = held.withColumnRenamed("component", "a").join(edges, "a").join(held.withColumnRenamed("component", "b"), ["file_id", "b"]).select("a", "b").distinct()
    merged = components(edges.join(together, ["a", "b"], "left_anti")).select(F.col("node").alias("component"), F.col("component").alias("_to"))
    return grouped.join(merged, "component", "left").select("path", F.coalesce("_to", "component").alias("component"))


def field_names(change_rows: DataFrame, stats: DataFrame) -> DataFrame:
    """path, target, type: the column of the consistent table that every path goes to.

    Names tied by renamings in any series form one field (connected components of names); every renaming that is reported
    counts, for the file and the field it was found in. A field takes the name in TARGETS that it holds, else the one of its
    names with the most values. Its type is the one most of its values have over all files: numbers are double (bigint for
    those of TARGETS), truth values boolean, all others text. Names that differ in letter case only form one field too, as
    columns know no case. A name that some file renames and another keeps beside its new name would tie two fields of one
    record; such ties, which the statistics show, are left out, so two fields may still have targets that differ in case only.
    """
    spark = change_rows.sparkSession
    edges = change_rows.where("change_kind = 'renamed'").select(F.col("old_name").alias("a"), F.col("new_name").alias("b"), "matches").groupBy("a", "b").agg(F.sum("matches").alias("n"))
    side = stats.select("file_id", "path")
    together = side.withColumnRenamed("path", "a").join(edges.select("a", "b"), "a").join(side.withColumnRenamed("path", "b"), ["file_id", "b"]).select("a", "b").distinct()
    edges = edges.join(together, ["a", "b"], "left_anti").select("a", "b")
    groups = components(edges).select(F.col("node").alias("path"), "component")
    known = spark.createDataFrame([(p, t, kind) for t, (kind, names) in TARGETS.items() for p in names], "path string, target string, fixed string")
    grouped = side.select("path").union(known.select("path")).distinct().join(groups, "path", "left").withColumn("component", F.coalesce("component", "path"))
    grouped = materialize(grouped, "grouped")
    groups = materialize(_regardless_of_case(grouped, side), "groups")
    named = stats.groupBy("path", "kind").agg(F.sum("values").alias("n")).join(groups, "path")
    wanted = known.join(groups, "path").groupBy("component").agg(F.min_by("target", "path").alias("target"), F.min_by("fixed", "path").alias("fixed"))
    per = named.groupBy("component", "path").agg(F.sum("n").alias("n"))
    field = per.groupBy("component").agg(F.max_by("path", F.struct("n", "path")).alias("most")).join(wanted, "component", "left").select("component", F.coalesce("target", "most").alias("target"), "fixed")
    main = named.groupBy("component", "kind").agg(F.sum("n").alias("n")).where("kind in ('number', 'boolean', 'string')").groupBy("component").agg(F.max_by("kind", F.struct("n", "kind")).alias("kind"))
    typed = F.coalesce("fixed", F.when(F.col("kind") == "number", "double").when(F.col("kind") == "boolean", "boolean").otherwise("string"))
    field = field.join(main, "component", "left").select("component", "target", typed.alias("type"))
    return named.select("path", "component").distinct().join(field, "component").select("path", "target", "type")


def _scalar(raw: Column, kind: Column) -> Column:
    """Text of a raw JSON value; of an object its member ``value`` or ``v``, of an array its only element; null if there is none."""
    inner = F.coalesce(F.get_json_object(raw, "$.value"), F.get_json_object(raw, "$.v"))
    only = F.when(F.json_array_length(raw) == 1, F.get_json_object(raw, "$[0]"))
    return F.when(kind == "object", inner).when(kind == "array", only).when(kind == "string", F.get_json_object(F.concat(F.lit('{"x":'), raw, F.lit("}")), "$.x")).otherwise(raw)


def _goes_to(target: str):
    return lambda c: c["target"] == target


def _columns(names: list[str], taken: list[str]) -> dict[str, str]:
    """The column of each field, unlike all others and those ``taken`` without regard to case: ``_field``, then ``_2`` and so on is added."""
    used, out = {t.lower() for t in taken}, {}
    for name in sorted(names, key=lambda n: n not in TARGETS):  # the names of TARGETS stay as they are
        base = f"{name}_field" if not name or name.lower() in taken else name
        column, n = base, 1
        while column.lower() in used:
            n += 1
            column = f"{base}_{n}"
        used.add(column.lower())
        out[name] = column
    return out


def consistent_table(exports: DataFrame, metadata: DataFrame) -> DataFrame:
    """One typed row per record of every file, whatever its layout, with the casts that failed.

    Columns: file_id, rec_no, global_id, schema_key, one typed column for each field (TARGETS first, then every other field
    met; the number of fields is that of the schema; a name already in use without regard to case gets a suffix), and failed: the fields with the raw value that their type does
    not hold (an object without value, a longer array, an unreadable text). A record repeated exactly appears once; two
    spellings of one field in one record keep the greater text, and the other is listed in ``failed`` under its own name.
    """
    records = materialize(path_maps(exports.select("file_id", "rec_no", "global_id", "payload").distinct()).withColumn("_version", F.xxhash64("payload")).drop("payload"), "records")
    stats = path_statistics(records.select("file_id", F.inline("paths")))
    names = materialize(field_names(changes(exports, metadata), stats), "names")
    # one row for each field: as many as the merged schema has
    fields = {r.target: r.type for r in names.select("target", "type").distinct().orderBy("target").collect()}
    fields = {t: kind for t, (kind, _) in TARGETS.items()} | {t: k for t, k in fields.items() if t not in TARGETS}
    cells = records.select("file_id", "rec_no", "global_id", "_version", F.inline_outer("paths"))
    cells = lookup_join(cells, names.select("path", "target"), ["path"]).withColumn("text", _scalar(F.col("raw"), F.col("kind")))
    key = ["file_id", "rec_no", "global_id", "_version"]
    wide = cells.groupBy(*key).agg(F.collect_list(F.when(F.col("path").isNotNull(), F.struct("target", "text", "raw", "path"))).alias("cells"))
    wide = wide.withColumn("_cells", F.sort_array("cells", False))
    columns = _columns(list(fields), ["file_id", "rec_no", "global_id", "schema_key", "failed"])
    exprs, failed = [], []
    for t, kind in fields.items():
        mine = F.filter("_cells", _goes_to(t))
        first = F.get(mine, F.lit(0))
        text = F.regexp_replace(first["text"], "^#", "") if kind == "bigint" else first["text"]
        value = text if kind == "string" else text.try_cast(kind)
        exprs.append(value.alias(columns[t]))
        failed.append(F.when(first["raw"].isNotNull() & value.isNull(), F.array(F.struct(F.lit(t).alias("field"), first["raw"].alias("raw")))))
        failed.append(F.transform(F.slice(mine, 2, F.greatest(F.size(mine) - 1, F.lit(0))), lambda c: F.struct(c["path"].alias("field"), c["raw"].alias("raw"))))
    lost = F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<struct<field:string,raw:string>>")) for x in failed]))
    out = wide.select("file_id", "rec_no", "global_id", *exprs, lost.alias("failed"))
    return out.join(file_order(metadata).select("file_id", "schema_key"), "file_id", "left")


def failed_casts(table: DataFrame) -> DataFrame:
    """file_id, field, n: casts that failed in the consistent table."""
    return table.select("file_id", F.explode("failed.field").alias("field")).groupBy("file_id", "field").agg(F.count("*").alias("n"))

"""Deeply nested semi-structured records as related flat tables.

Each level is one ``explode`` of the containers in the open rows: every object becomes a node that carries the surrogate key
of its parent and its place in the parent's list, and everything stays in built-in VARIANT functions. Levels are exploded
until no row is open, so there is no bound on the depth but that of the JSON reader. The merged schema is inferred level by
level (``schema_of_variant_agg`` for each kind of object), as one aggregate over whole payloads hides what stands in JSON
text inside strings and under fields whose layouts contradict each other.

Wrapper objects (containers without values of their own) carry no node; a lone object counts as a list of one; spellings of
field names (case, underscores, ``@``) are merged. A plain value in a list is a child row of its own with the field
``value``. Flat tables are the nodes of one name under one parent, with every field of the merged schema as a typed column;
fields met with several types are columns of JSON text.

Defined results: null, empty, truncated or non-object payloads give no nodes; so does an object that names a field twice,
and one nested deeper than the JSON reader goes (1,000 levels). Null list entries hold their place in the ordinal but give no
node; of two spellings of one field the last value is kept; very long payloads are read whole.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from trussflow.session import materialize

NODE_SCHEMA = "row_id bigint, root_key string, node_no string, parent_no string, name string, parent_name string, path string, ord bigint, node_key string, parent_key string, attrs map<string,variant>"


def name_of(c: Column) -> Column:
    """A field name without case, underscores and other signs."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def _opened(v: Column) -> Column:
    """struct(v, o, a, t): a value with its reading as object, as array, or else as text."""
    return F.struct(v.alias("v"), v.try_cast("map<string,variant>").alias("o"), v.try_cast("array<variant>").alias("a"))


def _read(values: Column) -> Column:
    """Values of array<struct(name, v)> as struct(name, v, o, a); JSON text inside a string is read as JSON."""
    once = F.transform(values, lambda x: F.struct(x["name"].alias("name"), _opened(x["v"]).alias("r")))
    text = F.transform(once, lambda x: F.struct(x["name"].alias("name"), x["r"].alias("r"), F.when(x["r"]["o"].isNull() & x["r"]["a"].isNull(), x["r"]["v"].try_cast("string")).alias("t")))

    def reread(x: Column) -> Column:
        inner = F.when(x["t"].startswith("{") | x["t"].startswith("["), _opened(F.try_parse_json(x["t"])))
        return F.struct(x["name"].alias("name"), F.when(inner["o"].isNotNull() | inner["a"].isNotNull(), inner).otherwise(x["r"]).alias("r"))

    return F.transform(F.transform(text, reread), lambda x: F.struct(x["name"].alias("name"), x["r"]["v"].alias("v"), x["r"]["o"].alias("o"), x["r"]["a"].alias("a")))


def _is_container(x: Column) -> Column:
    return x["o"].isNotNull() | x["a"].isNotNull()


_FIELDS = "array<struct<name:string,v:variant>>"


@lru_cache(maxsize=8)
def _steps(key_field: str, hoist: str, jvm: int) -> Callable[[DataFrame], DataFrame]:
    """Function that explodes one level: an open row becomes its node (or nothing) and its containers' rows.

    Rows: the columns of NODE_SCHEMA but ``ord``, ``seq`` (places from the root), ``open`` (variant), ``extra`` (fields
    handed down), ``held`` (a null list entry, which only holds its place). The expressions are built once in a driver.
    """
    none = F.lit(None)
    entries = F.transform(F.map_entries(F.col("open").try_cast("map<string,variant>")), lambda e: F.struct(name_of(e["key"]).alias("name"), e["value"].alias("v")))
    read = {"_a": F.col("open").try_cast("array<variant>"), "_f": _read(F.concat(entries, F.coalesce("extra", F.array().cast(_FIELDS))))}
    # An object that holds a child of the hoisted name hands its other fields to that child.
    main = F.filter("_f", lambda x: (x["name"] == hoist) & x["o"].isNotNull())
    others = F.transform(F.filter("_f", lambda x: x["name"] != hoist), lambda x: F.struct(F.when(_is_container(x), x["name"]).otherwise(F.concat(F.lit("outer"), x["name"])).alias("name"), x["v"].alias("v")))
    hand = {"_p": main, "_h": F.when((F.size(main) > 0) & F.col("owner").isNotNull(), others)}
    kept = F.when(F.col("_h").isNotNull(), F.col("_p")).otherwise(F.col("_f"))
    split = {"_v": F.filter(kept, lambda x: ~_is_container(x)), "_k": F.filter(kept, _is_container)}
    wrapper = F.col("owner").isNotNull() & (F.size("_v") == 0) & (F.size("_k") > 0)
    own = {"_w": F.coalesce(wrapper, F.lit(False)), "_m": _last_of_each("_v"), "_no": F.array_join(F.transform("seq", lambda i: i.cast("string")), ".")}
    key = {"_key": F.when(F.col("owner").isNull(), F.col("root_key")).otherwise(F.try_element_at("_m", F.lit(key_field)).try_cast("string"))}

    def row(name, path, seq, opened=none, extra=none, held=F.lit(False), owner=("owner", "parent_name", "parent_key"), no=none, key=none, attrs=none):
        return F.struct(
            *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in zip(("owner", "parent_name", "parent_key"), owner)], name.alias("name"), path.alias("path"), seq.alias("seq"),
            no.cast("string").alias("node_no"), key.cast("string").alias("node_key"), attrs.cast("map<string,variant>").alias("attrs"), opened.cast("variant").alias("open"), extra.cast(_FIELDS).alias("extra"), held.alias("held"),
        )

    name, path, seq = F.col("name"), F.col("path"), F.col("seq")
    # A wrapper's children belong to its own owner, others to the object.
    below = [F.when(F.col("_w"), F.col(a)).otherwise(F.col(b)) for a, b in (("owner", "_no"), ("parent_name", "name"), ("parent_key", "_key"))]
    node = row(name, path, seq, no=F.col("_no"), key=F.col("_key"), attrs=F.col("_m"))
    down = F.transform("_k", lambda x, i: row(x["name"], F.concat_ws(".", path, x["name"]), F.concat(seq, F.array(i + 1)), x["v"], F.col("_h"), owner=below))
    # Elements of a list keep its name and owner; plain values become nodes, nulls hold their place.
    listed = _read(F.transform("_a", lambda v: F.struct(name.alias("name"), v.alias("v"))))
    listed = F.transform(listed, lambda x: F.struct(x["v"].alias("v"), _is_container(x).alias("c"), F.coalesce(F.to_json(x["v"]) != "null", F.lit(False)).alias("given")))

    def element(x: Column, i: Column) -> Column:
        plain, at = ~x["c"] & x["given"], F.concat(seq, F.array(i + 1))
        number = F.concat_ws(".", F.col("_no"), (i + 1).cast("string"))
        return row(name, path, at, F.when(x["c"], x["v"]), held=~x["c"] & ~x["given"], no=F.when(plain, number), attrs=F.when(plain, F.create_map(F.lit("value"), x["v"])))

    out = F.when(F.col("_a").isNotNull(), F.transform(listed, element)).when(F.col("_w"), down).otherwise(F.concat(F.array(node), down))
    steps = [c.alias(n) for step in (read, hand, split, own, key) for n, c in step.items()]

    def level(rows: DataFrame) -> DataFrame:
        return rows.select("*", *steps).select("row_id", "root_key", F.inline(out))

    return level


def _last_of_each(fields: str) -> Column:
    """Map of struct(name, v) entries; of one name given twice the last counts."""
    names = F.transform(fields, lambda x: x["name"])
    kept = F.filter(fields, lambda x, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), x["name"]))
    return F.map_from_entries(F.transform(kept, lambda x: F.struct(x["name"], x["v"])))


def shred(df: DataFrame, row_id: str, root_key: str, payload: str, key_field: str = "guid", hoist: str = "topic") -> DataFrame:
    """Nodes of every payload (NODE_SCHEMA). (row_id, node_no) is the surrogate key, (row_id, parent_no) the link.

    ``node_no`` is the node's place: the positions on the way from the root. ``hoist``: an object that holds a child of this
    name hands its other fields to that child (plain ones under ``outer`` + name). Every level is written to the shared folder.
    """
    none = F.lit(None)
    src = df.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(root_key).cast("string").alias("root_key"), F.try_parse_json(F.col(payload)).alias("open"))
    open_ = src.where(F.col("open").try_cast("map<string,variant>").isNotNull()).select(
        "row_id", "root_key", *[none.cast("string").alias(c) for c in ("owner", "parent_name", "parent_key")], F.lit("root").alias("name"), F.lit("root").alias("path"),
        F.array().cast("array<int>").alias("seq"), "open", none.cast(_FIELDS).alias("extra"),
    )
    level, rows = _steps(key_field, hoist, id(SparkContext._gateway)), None
    while True:
        seen = Observation()
        step = materialize(level(open_).observe(seen, F.count("open").alias("open")), "level")
        done = step.where("open is null").drop("open", "extra")
        rows = done if rows is None else rows.unionByName(done)
        if not seen.get["open"]:
            break
        open_ = step.where("open is not null").drop("node_no", "node_key", "attrs", "held")
    # Places of one owner's children of one name; a window over one payload's rows, whatever the number of payloads.
    place = F.row_number().over(Window.partitionBy("row_id", "owner", "name").orderBy("seq"))
    nodes = rows.withColumn("ord", place.cast("bigint")).where("not held")
    return nodes.select("row_id", "root_key", "node_no", F.col("owner").alias("parent_no"), "name", "parent_name", "path", "ord", "node_key", "parent_key", "attrs")


def merged_schema(nodes: DataFrame) -> DataFrame:
    """path, name, parent_name, field, type, n, filled: every field met at every path, over all layouts, and its merged type."""
    cells = nodes.select("path", "name", "parent_name", F.explode("attrs").alias("field", "value"))
    return cells.groupBy("path", "name", "parent_name", "field").agg(F.expr("schema_of_variant_agg(value)").alias("type"), F.count("*").alias("n"), F.count_if(F.to_json("value") != "null").alias("filled"))


#: Types of the merged schema that have a column type of their own; all others are columns of JSON text.
COLUMN_TYPES = {"STRING": "string", "BOOLEAN": "boolean", "BIGINT": "bigint", "DOUBLE": "double", "FLOAT": "double"}


def child_table(nodes: DataFrame, schema: list, names: list[str], parents: list[str] | None = None) -> DataFrame:
    """The flat table of one kind of object, with the link to its parent row and a column for every field of the merged schema.

    ``schema``: rows of ``merged_schema``. A field whose name is one of the link columns gets the suffix ``_field``.
    """
    t = nodes.where(F.col("name").isin(names))
    if parents:
        t = t.where(F.col("parent_name").isin(parents))
    links = ["row_id", "node_no", "parent_no", "root_key", "parent_key", "node_key", "ord"]
    types: dict[str, set[str]] = {}
    for r in schema:
        if r.name in names and (not parents or r.parent_name in parents):
            types.setdefault(r.field, set()).add(r.type)
    columns = []
    for f, kinds in sorted(types.items()):
        kinds = {k for k in kinds if k != "VOID"}
        kind = kinds.pop() if len(kinds) == 1 else "VARIANT" if kinds else "STRING"
        kind = "double" if kind.startswith("DECIMAL") else COLUMN_TYPES.get(kind)
        v = F.try_element_at("attrs", F.lit(f))
        taken = f in [c.replace("_", "") for c in links] or f in links
        columns.append((v.try_cast(kind) if kind else F.when(F.to_json(v) != "null", F.to_json(v))).alias(f"{f}_field" if taken else f))
    return t.select(*links, *columns)


#: Link kind -> (object names, name of the parent object).
BCF_LINKS = {
    "document": (["document"], "root"),
    "topic": (["topic"], "root"),
    "header_file": (["file"], "topic"),
    "viewpoint": (["viewpoint", "viewpoints"], "topic"),
    "comment": (["comment"], "topic"),
    "document_reference": (["documentreference"], "topic"),
    "comment_viewpoint": (["viewpoint"], "comment"),
}

#: Flat table -> (object names, name of the parent object).
BCF_TABLES = {
    "documents": BCF_LINKS["document"], "topics": BCF_LINKS["topic"], "files": BCF_LINKS["header_file"], "comments": BCF_LINKS["comment"],
    "viewpoints": BCF_LINKS["viewpoint"], "references": BCF_LINKS["document_reference"], "comment_viewpoints": BCF_LINKS["comment_viewpoint"],
    "labels": (["labels", "label"], "topic"),
}


def bcf_links(archives: DataFrame) -> DataFrame:
    """kind, parent_key, child_key, ord of every link in any readable archive, each once.

    A file without project has the child key ''; other entries without a guid are no links.
    """
    nodes = shred(archives, "raw_id", "archive_guid", "payload")
    kind = F.coalesce(*[F.when(F.col("name").isin(names) & (F.col("parent_name") == parent), F.lit(k)) for k, (names, parent) in BCF_LINKS.items()])
    child = F.when(F.col("name") == "file", F.coalesce(F.try_element_at("attrs", F.lit("ifcproject")).try_cast("string"), F.lit(""))).otherwise(F.col("node_key"))
    links = nodes.select(kind.alias("kind"), "parent_key", child.alias("child_key"), "ord")
    return links.where("kind is not null and child_key is not null and parent_key is not null").distinct()


def bcf_tables(archives: DataFrame) -> dict[str, DataFrame]:
    """The flat tables of the archives, by name; the payloads are read once for all of them."""
    nodes = materialize(shred(archives, "raw_id", "archive_guid", "payload"), "nodes")
    schema = merged_schema(nodes).collect()  # one row for each path and field: as long as the schema, not the data
    return {name: child_table(nodes, schema, names, [parent]) for name, (names, parent) in BCF_TABLES.items()}

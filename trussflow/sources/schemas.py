"""Schema and rule documents read on the driver (they are the size of a schema): EXPRESS declarations, IDS audits, SQLite."""

from __future__ import annotations

import re
import sqlite3
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trussflow.operators.audit import AttributeFacet, Restriction, Specification


def read_express(text: str) -> dict[str, dict]:
    """entity -> {supertype, attributes {name: (type, optional)}, rules {label: text}, unique {label: [attributes]}}."""
    text = re.sub(r"\(\*.*?\*\)|--[^\n]*", " ", text, flags=re.S)
    out = {}
    for name, body in re.findall(r"\bENTITY\s+(\w+)(.*?)\bEND_ENTITY\s*;", text, re.S | re.I):
        sup = re.search(r"\bSUBTYPE\s+OF\s*\(\s*(\w+)", body, re.I)
        head, *rest = re.split(r"\b(?=INVERSE\b|DERIVE\b|UNIQUE\b|WHERE\b)", body.split(";", 1)[1] if ";" in body else "", flags=re.I)
        attributes = {n: (t.strip(), bool(o)) for n, o, t in re.findall(r"(\w+)\s*:\s*(OPTIONAL\s+)?([^;:]+);", head, re.I)}
        part = {p.split(None, 1)[0].upper(): p.split(None, 1)[1] for p in rest if len(p.split(None, 1)) == 2}
        rules = {n: " ".join(t.split()) for n, t in re.findall(r"(\w+)\s*:\s*([^;]+);", part.get("WHERE", ""))}
        unique = {n: [x.strip() for x in t.split(",")] for n, t in re.findall(r"(\w+)\s*:\s*([^;]+);", part.get("UNIQUE", ""))}
        out[name] = {"supertype": sup and sup[1], "attributes": attributes, "rules": rules, "unique": unique}
    return out


def taxonomy_rows(schema: dict[str, dict]) -> list[tuple[str, str, int]]:
    """(class, ancestor, depth) closure of a schema."""
    rows = []
    for name in schema:
        at, depth = name, 0
        while at and depth < 1000:
            rows.append((name, at, depth))
            at, depth = schema.get(at, {}).get("supertype"), depth + 1
    return rows


def _text(node) -> str | None:
    v = node.find(".//{*}simpleValue") if node is not None else None
    return v.text if v is not None else None


def _restriction(node) -> Restriction | str | None:
    if node is None:
        return None
    simple = _text(node)
    if simple is not None:
        return simple
    r = node.find(".//{*}restriction")
    if r is None:
        return None
    of = lambda tag: [x.get("value") for x in r.findall(f"{{*}}{tag}")]
    one = lambda tag, kind: next((kind(x) for x in of(tag)), None)
    return Restriction(
        enumeration=tuple(of("enumeration")), pattern=one("pattern", str), length=one("length", int), min_length=one("minLength", int), max_length=one("maxLength", int),
        min_inclusive=one("minInclusive", float), max_inclusive=one("maxInclusive", float), min_exclusive=one("minExclusive", float), max_exclusive=one("maxExclusive", float),
    )


def read_ids(text: str, class_column: str = "class", columns: dict[str, str] | None = None) -> list[Specification]:
    """Specifications of an IDS document with entity and attribute facets; ``columns`` maps attribute names to columns."""
    columns = columns or {}
    specs = []
    for s in ET.fromstring(text).iter():
        if not s.tag.endswith("}specification") and s.tag != "specification":
            continue
        app, req = s.find("{*}applicability"), s.find("{*}requirements")
        applies = F.lit(True)
        for part, known in ((app, {"entity", "attribute"}), (req, {"attribute"})):
            other = {x.tag.rsplit("}", 1)[-1] for x in (part if part is not None else ())} - known
            if other:  # an audit must not pass what it does not check
                raise ValueError(f"facets not read: {', '.join(sorted(other))}")
        for e in app.findall("{*}entity"):
            applies = applies & (F.upper(class_column) == (_text(e.find("{*}name")) or "").upper())
        for a in app.findall("{*}attribute"):
            name = _text(a.find("{*}name"))
            applies = applies & AttributeFacet(columns.get(name, name), _restriction(a.find("{*}value"))).passes()
        facets = []
        for a in req.findall("{*}attribute") if req is not None else []:
            name = _text(a.find("{*}name"))
            facets.append(AttributeFacet(columns.get(name, name), _restriction(a.find("{*}value")), a.get("cardinality", "required")))
        most = app.get("maxOccurs", "unbounded")
        specs.append(Specification(s.get("name", ""), applies, tuple(facets), int(app.get("minOccurs", 0)), None if most == "unbounded" else int(most)))
    return specs


def read_sqlite(spark: SparkSession, path: str, name: str, slices: int = 8) -> DataFrame:
    """A table of a SQLite file that every executor can reach, read in ranges of rowid."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        fields = [(r[1], (r[2] or "").upper()) for r in con.execute(f'PRAGMA table_info("{name}")')]
        lo, hi = con.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{name}"').fetchone()
    kind = lambda t: "bigint" if "INT" in t else "double" if any(x in t for x in ("REAL", "FLOA", "DOUB")) else "binary" if "BLOB" in t else "string"
    schema = ", ".join(f"`{n}` {kind(t)}" for n, t in fields)
    step = max(1, -(-(hi - lo + 1) // slices))
    ranges = spark.createDataFrame([(a, min(hi, a + step - 1)) for a in range(lo, hi + 1, step)], "a long, b long")
    names = [n for n, _ in fields]

    def run(batches):
        import pandas as pd

        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
            for pdf in batches:
                for a, b in zip(pdf["a"], pdf["b"]):
                    rows = con.execute(f'SELECT * FROM "{name}" WHERE rowid BETWEEN ? AND ?', (int(a), int(b))).fetchall()
                    yield pd.DataFrame(rows, columns=names, dtype=object)

    return ranges.repartition(max(1, slices)).mapInPandas(run, schema)

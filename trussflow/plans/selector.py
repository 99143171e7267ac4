"""The facet filter language and the path language, compiled to joins and predicates.

Grammar, in words: groups are joined by ``+`` (union); a group is a list of facets joined by ``,`` applied from left to
right. A facet is ``Class``, ``! Class``, a quoted or plain instance ``#id``, or ``key comparison value`` with the keys
type, material, classification, location, group, parent, query:"path", ``Set.Property`` and attribute names. Comparisons are
``= != > >= < <= *= !*=``. Values are words, numbers, "quoted text", /regular expressions/, NULL, TRUE and FALSE.

Semantics kept: a missing value makes the inner test false, and only then is it negated; NULL, TRUE and FALSE are identity
tests; numbers compare as numbers and, on text, order comparisons become equality; ``*=`` is substring on text and equality
on numbers; a regular expression is anchored at its start; a leading ``! Class`` subtracts from nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trussflow.model import Model

_TOKENS = re.compile(
    r"""\s*(?:(?P<comment>/\*.*?\*/)|(?P<prop>(?:/(?:\\.|[^/\\])+/|"[^"]*"|\w+)\.(?:/(?:\\.|[^/\\])+/|"[^"]*"|\w+)(?=\s*(?:!|=|\*|<|>)))|(?P<quoted>"(?:\\.|[^"\\])*")|(?P<regex>/(?:\\.|[^/\\])+/)|(?P<op>!\*=|\*=|!=|>=|<=|=|>|<)|(?P<mark>[!,+])|(?P<id>\#\d+)|(?P<word>[^\s,+!=<>*"/]+))""",
    re.S,
)


_PROPERTY = re.compile(r"""^(/(?:\\.|[^/\\])+/|"[^"]*"|[^./"]+)\.(.+)$""")


@dataclass(frozen=True)
class Value:
    kind: str  # text, regex, null, bool
    text: str

    def test(self, c: Column, op: str, dtype: str) -> Column:
        """Two-valued comparison of a column of a known type."""
        negated = op.startswith("!")
        op = op.lstrip("!") or "="
        if self.kind == "null":
            p = c.isNull()
        elif self.kind == "bool":
            p = c == F.lit(self.text == "TRUE") if dtype == "boolean" else F.lit(False)
        elif self.kind == "regex":
            p = c.cast("string").rlike(f"^(?:{self.text})")
        elif dtype == "string":
            p = F.contains(c, F.lit(self.text)) if op == "*=" else c == self.text
        else:
            try:
                v = F.lit(int(self.text) if dtype in ("int", "bigint") else float(self.text))
                p = {"=": c == v, "*=": c == v, ">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[op]
            except ValueError:
                p = F.lit(False)
        # A plain comparison reaches the scan as a pushed filter; unknown counts as false in a filter anyway.
        return not_(p) if negated else p


def not_(p: Column) -> Column:
    """Two-valued negation: unknown counts as false before it is negated."""
    return ~F.coalesce(p, F.lit(False))


@dataclass(frozen=True)
class Facet:
    kind: str  # class, instance, key
    name: str
    op: str = "="
    value: Value | None = None
    negated: bool = False


def _lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKENS.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"cannot read the selector at {text[at:at + 20]!r}")
        at = m.end()
        if m.lastgroup != "comment":
            out.append((m.lastgroup, m.group(m.lastgroup)))
    return out


def _value(kind: str, text: str) -> Value:
    if kind == "quoted":
        return Value("text", re.sub(r"\\(.)", r"\1", text[1:-1]))
    if kind == "regex":
        return Value("regex", text[1:-1])
    if text == "NULL":
        return Value("null", text)
    return Value("bool", text) if text in ("TRUE", "FALSE") else Value("text", text)


def parse(text: str, classes: set[str]) -> list[list[Facet]]:
    """Groups of facets. Unknown class names are passed over, as an empty class."""
    groups: list[list[Facet]] = [[]]
    tokens, i = _lex(text), 0
    while i < len(tokens):
        kind, t = tokens[i]
        if (kind, t) == ("mark", "+"):
            groups.append([])
        elif (kind, t) == ("mark", ","):
            pass
        else:
            negated = (kind, t) == ("mark", "!")
            if negated:
                i += 1
                kind, t = tokens[i]
            if kind == "id":
                groups[-1].append(Facet("instance", t[1:], negated=negated))
            elif i + 1 < len(tokens) and tokens[i + 1][0] == "op":
                op = tokens[i + 1][1]
                groups[-1].append(Facet("key", t if kind == "prop" else t.strip('"'), op, _value(*tokens[i + 2])))
                i += 2
            elif kind == "word" and t == "query:" and tokens[i + 1][0] == "quoted":
                groups[-1].append(Facet("query", tokens[i + 1][1][1:-1], tokens[i + 2][1], _value(*tokens[i + 3])))
                i += 3
            elif t in classes or kind == "word":
                groups[-1].append(Facet("class", t, negated=negated))
            else:
                raise ValueError(f"unexpected {t!r} in the selector")
        i += 1
    return [g for g in groups if g]


class Selector:
    def __init__(self, model: Model):
        self.model = model

    def select(self, text: str) -> DataFrame:
        """class, id, name of the selected elements."""
        m = self.model
        parts = []
        for group in parse(text, set(m.classes) | set(m.taxonomy)):
            for cls, rows in self._group(group).items():
                parts.append(rows.select(F.lit(cls).alias("class"), "id", "name"))
        if not parts:
            return m.spark.createDataFrame([], "class string, id bigint, name string")
        out = reduce(DataFrame.unionByName, parts)
        return out.distinct() if len(parts) > 1 else out

    def _group(self, facets: list[Facet]) -> dict[str, DataFrame]:
        m = self.model
        named = any(f.kind in ("class", "instance") for f in facets)
        current: dict[str, DataFrame] = {} if named else {c: m.rows(c) for c in m.classes}
        for f in facets:
            if f.kind == "class":
                try:
                    classes = m.subtypes(f.name)
                except ValueError:
                    continue
                for c in classes:
                    if f.negated:
                        current.pop(c, None)
                    else:
                        current[c] = m.rows(c)
            elif f.kind == "instance":
                for c in m.classes:
                    one = F.col("id") == int(f.name)
                    if f.negated and c in current:
                        current[c] = current[c].where(~one)
                    elif not f.negated and not any(x.kind == "class" for x in facets):
                        current[c] = m.rows(c).where(one)
            else:
                current = {c: self._filter(c, rows, f) for c, rows in current.items()}
        return current

    def _filter(self, cls: str, rows: DataFrame, f: Facet) -> DataFrame:
        m, c = self.model, self.model.classes[cls]
        columns = rows.columns
        if f.kind == "query":
            found = self.path(cls, f.name).withColumnRenamed("id", "_pid")
            dtype = dict(found.dtypes)["value"]
            if dtype.startswith("array"):
                test = F.exists("value", lambda x: f.value.test(x, f.op.lstrip("!") or "=", dtype[6:-1]))
                test = not_(test) if f.op.startswith("!") else test
            else:
                test = f.value.test(F.col("value"), f.op, dtype)
            return rows.join(found, F.col("id") == F.col("_pid"), "left").where(test).select(*columns)
        key = f.name
        if key == "type":
            if not c.type:
                return rows.where(F.lit(f.op.startswith("!")))
            t, fk = c.type
            types = m.rows(t)
            types = types.where(f.value.test(F.col("name"), f.op.lstrip("!") or "=", "string")).select(F.col("id").alias("_t"))
            return rows.join(types, F.col(fk).cast("bigint") == F.col("_t"), "left_anti" if f.op.startswith("!") else "left_semi")
        if key in ("material", "group"):
            link = next((x for x in m.links if x.kind == key and x.source == cls), None)
            if not link:
                return rows.where(F.lit(f.op.startswith("!")))
            target = m.rows(link.target)
            test = f.value.test(F.col("name"), f.op.lstrip("!") or "=", "string") | (F.col("id").cast("string") == f.value.text)
            near = target.where(F.coalesce(test, F.lit(False))).select("id")
            pairs = m._load(link.table).select(F.col(link.source_key).cast("bigint").alias("_s"), F.col(link.target_key).cast("bigint").alias("id")).join(near, "id", "left_semi").select("_s")
            return rows.join(pairs, F.col("id") == F.col("_s"), "left_anti" if f.op.startswith("!") else "left_semi")
        if key == "classification":
            test = reduce(lambda a, b: a | b, [f.value.test(F.col(x), f.op.lstrip("!") or "=", "string") for x in c.classification], F.lit(False))
            return rows.where(not_(test) if f.op.startswith("!") else test)
        if key in ("location", "parent"):
            joined, up = m.ancestor_join(rows, cls)
            if not up and not (key == "parent" and m.children(cls)):
                return rows.where(F.lit(f.op.startswith("!")))
            tests = [f.value.test(F.col(n), f.op.lstrip("!") or "=", "string") for _, _, n in up]
            if key == "parent":  # a parent that matches counts with what is below it
                own = rows.where(F.coalesce(f.value.test(F.col("name"), f.op.lstrip("!") or "=", "string"), F.lit(False))).select("id")
                kids = [m.rows(n).select(F.col(column).cast("bigint").alias("id")) for n, column in m.children(cls)]
                if kids:
                    matched = own.join(reduce(DataFrame.unionByName, kids), "id", "left_semi").select(F.col("id").alias("_self"))
                    joined = joined.join(matched, F.col("id") == F.col("_self"), "left")
                    tests.append(F.col("_self").isNotNull())
            test = reduce(lambda a, b: a | b, tests, F.lit(False))
            return joined.where(not_(test) if f.op.startswith("!") else test).select(*columns)
        if _PROPERTY.match(key):
            pset, prop = _PROPERTY.match(key).groups()
            as_regex = lambda p: p[1:-1] if p.startswith("/") and p.endswith("/") else re.escape(p.strip('"')) + "$"
            hits = [e for s, props in c.psets.items() if re.match(as_regex(pset), s) for p, e in props.items() if re.match(as_regex(prop), p)]
            if not hits:
                return rows.where(F.lit(f.op.startswith("!") or f.value.kind == "null"))
            probe = rows.withColumn("_p", F.expr(hits[0]))  # the first match decides
            return probe.where(f.value.test(F.col("_p"), f.op, dict(probe.dtypes)["_p"])).select(*columns)
        column = c.attrs.get(key)
        if column is None:
            return rows.where(f.value.test(F.lit(None).cast("string"), f.op, "string"))
        return rows.where(f.value.test(F.col(column), f.op, dict(rows.dtypes)[column]))

    def path(self, cls: str, text: str) -> DataFrame:
        """id, value of a path such as ``nation.region.Name``, ``lines.count`` or ``lines.part.Brand``.

        Steps: reference attributes, ``parent``, ``type``, ``children`` or the plural of a contained class, attribute
        names, ``class``, ``id`` and ``count``. Lists are flattened and sorted; ``count`` of a single value is 1.
        """
        m = self.model
        steps = text.split(".")
        here, many = cls, False
        cur = m.rows(cls).withColumn("_root", F.col("id"))
        for k, step in enumerate(steps):
            c = m.classes[here]
            refs = m.references(here)
            kids = {f"{n.lower()}s": (n, col) for n, col in m.children(here)} | ({"lines": ("Lineitem", "l_orderkey")} if here == "Order" else {})
            if step in refs:
                target, column = refs[step]
                cur = cur.select("_root", F.col(column).cast("bigint").alias("_k")).join(m.rows(target), F.col("_k") == F.col("id")).drop("_k")
                here = target
            elif step in kids or step == "children" and kids:
                target, column = kids[step] if step in kids else next(iter(kids.values()))
                cur = cur.select("_root", F.col("id").alias("_k")).join(m.rows(target), F.col("_k") == F.col(column).cast("bigint")).drop("_k")
                here, many = target, True
            elif step == "count":
                counted = cur.groupBy(F.col("_root").alias("id")).agg(F.count("*").alias("value"))
                return m.rows(cls).select("id").join(counted, "id", "left").select("id", F.coalesce("value", F.lit(0)).alias("value"))
            else:
                value = {"class": F.lit(here), "id": F.col("id")}.get(step)
                if value is None:
                    column = c.attrs.get(step)
                    props = {p: e for s in c.psets.values() for p, e in s.items()}
                    value = F.col(column) if column else F.expr(props[step]) if step in props else F.lit(None).cast("string")
                cur = cur.select("_root", value.alias("value"))
                rest = steps[k + 1 :]
                if not many:
                    return cur.select(F.col("_root").alias("id"), (F.when(F.col("value").isNotNull(), 1).otherwise(0) if rest == ["count"] else F.col("value")).alias("value"))
                grouped = cur.groupBy(F.col("_root").alias("id"))
                return grouped.agg(F.count_distinct("value").alias("value") if rest == ["count"] else F.array_sort(F.collect_set("value")).alias("value"))
        return cur.select(F.col("_root").alias("id"), F.col("id").alias("value"))

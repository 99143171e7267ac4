"""The rule expression language compiled to Columns: WHERE rules of a schema become violation queries.

Understood: literals, attribute names and paths (struct fields), ``SELF``, arithmetic, ``||`` on text, comparisons, ``IN``,
``LIKE``, intervals ``{a <= x < b}``, NOT, AND, OR, XOR, one-based indexes, aggregate literals, ``QUERY(x <* a | test)``, and the
functions SIZEOF, HIINDEX, LOINDEX, EXISTS, NVL, TYPEOF, ABS, SQRT, LENGTH, BLENGTH, VALUE. Unknown (null) is three-valued
inside an expression and counts as not fulfilled at its end. As in the language, comparisons bind loosest: combined ones need
parentheses. ``+`` and ``*`` on arrays are union and intersection.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trussflow.operators.rules import violations

_LEX = re.compile(r"""\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?)|('(?:[^']|'')*')|(:<>:|:=:|<\*|<=|>=|<>|\|\||\*\*|[-+*/=<>(){}\[\],.|?\\])|([A-Za-z_]\w*))""")
_WORDS = {"AND", "OR", "XOR", "NOT", "IN", "LIKE", "DIV", "MOD", "QUERY", "TRUE", "FALSE", "UNKNOWN", "SELF", "PI"}


class _Parser:
    def __init__(self, text: str, resolve: Callable[[str], Column], arrays: set[str]):
        self.tokens, at = [], 0
        text = text.strip().rstrip(";")
        while at < len(text):
            m = _LEX.match(text, at)
            if not m or m.end() == at:
                raise ValueError(f"cannot read the rule at {text[at:at + 20]!r}")
            kind = m.lastindex
            value = m.group(kind)
            self.tokens.append((kind, value.upper() if kind == 4 and value.upper() in _WORDS else value))
            at = m.end()
        self.at, self.resolve, self.arrays, self.text, self.scope = 0, resolve, arrays, text, {}

    def peek(self, k: int = 0) -> str | None:
        return self.tokens[self.at + k][1] if self.at + k < len(self.tokens) else None

    def take(self, expected: str | None = None) -> tuple[int, str]:
        if self.at >= len(self.tokens) or expected is not None and self.peek() != expected:
            raise ValueError(f"expected {expected!r} in the rule {self.text!r}")
        self.at += 1
        return self.tokens[self.at - 1]

    # each level returns (column, is_array)
    def expression(self):
        a = self.simple()
        op = self.peek()
        if op in ("=", ":=:", "<>", ":<>:", "<", ">", "<=", ">="):
            self.take()
            return self.compare(a[0], op, self.simple()[0]), False
        if op == "IN":
            self.take()
            return F.array_contains(self.simple()[0], a[0]), False
        if op == "LIKE":
            self.take()
            pattern = self.take()[1][1:-1]
            table = {"@": "\\p{L}", "^": "\\p{Lu}", "?": ".", "&": ".*", "#": "\\d", "$": "\\S*", "*": ".*"}
            return a[0].rlike("^" + "".join(table.get(c) or re.escape(c) for c in pattern) + "$"), False
        return a

    @staticmethod
    def compare(a: Column, op: str, b: Column) -> Column:
        return {"=": a == b, ":=:": a.eqNullSafe(b), "<>": a != b, ":<>:": ~a.eqNullSafe(b), "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]

    def simple(self):
        a = self.term()
        while self.peek() in ("+", "-", "OR", "XOR", "||"):
            op = self.take()[1]
            b = self.term()
            if op == "+":
                a = (F.array_union(a[0], b[0]), True) if a[1] and b[1] else (a[0] + b[0], False)
            elif op == "-":
                a = (F.array_except(a[0], b[0]), True) if a[1] and b[1] else (a[0] - b[0], False)
            elif op == "||":
                a = F.concat(a[0], b[0]), False
            else:
                a = (a[0] | b[0] if op == "OR" else (a[0] | b[0]) & ~(a[0] & b[0])), False
        return a

    def term(self):
        a = self.factor()
        while self.peek() in ("*", "/", "DIV", "MOD", "AND"):
            op = self.take()[1]
            b = self.factor()
            if op == "*":
                a = (F.array_intersect(a[0], b[0]), True) if a[1] and b[1] else (a[0] * b[0], False)
            else:
                a = {"/": lambda x, y: F.try_divide(x, y), "DIV": lambda x, y: F.floor(F.try_divide(x, y)), "MOD": lambda x, y: x % y, "AND": lambda x, y: x & y}[op](a[0], b[0]), False
        return a

    def factor(self):
        t = self.peek()
        if t == "NOT":
            self.take()
            return ~self.factor()[0], False
        if t in ("-", "+"):
            self.take()
            a = self.factor()[0]
            return (-a if t == "-" else a), False
        a = self.primary()
        if self.peek() == "**":
            self.take()
            return F.pow(a[0], self.factor()[0]), False
        return a

    def primary(self):
        kind, t = self.take()
        if kind == 1:
            return F.lit(float(t) if re.search("[.eE]", t) else int(t)), False
        if kind == 2:
            return F.lit(t[1:-1].replace("''", "'")), False
        if t == "?":
            return F.lit(None), False
        if t in ("TRUE", "FALSE", "UNKNOWN"):
            return F.lit({"TRUE": True, "FALSE": False}.get(t)).cast("boolean"), False
        if t == "PI":
            return F.pi(), False
        if t == "(":
            a = self.expression()
            self.take(")")
            return self.suffix(a)
        if t == "[":
            items = []
            while self.peek() != "]":
                items.append(self.expression()[0])
                if self.peek() == ",":
                    self.take()
            self.take("]")
            return F.array(*items), True
        if t == "{":
            low, op1, x, op2, high = self.simple()[0], self.take()[1], self.simple()[0], self.take()[1], self.simple()[0]
            self.take("}")
            return self.compare(low, op1, x) & self.compare(x, op2, high), False
        if t == "QUERY":
            self.take("(")
            name = self.take()[1]
            self.take("<*")
            items = self.simple()[0]
            self.take("|")
            start = self.at

            def test(x: Column) -> Column:
                self.at, before = start, self.scope
                self.scope = {**before, name.lower(): x}
                result = self.expression()[0]
                self.scope = before
                return F.coalesce(result, F.lit(False))

            out = F.filter(items, test)
            self.take(")")
            return out, True
        if kind == 4 and self.peek() == "(":
            return self.suffix(self.function(t.upper()))
        if t == "SELF":
            if self.peek() in ("\\", "."):
                while self.peek() == "\\":  # a group reference names a supertype; its attributes are columns here
                    self.take()
                    self.take()
                self.take(".")
                return self.suffix(self.name(self.take()[1]))
            return self.name("self")
        if kind == 4:
            return self.suffix(self.name(t))
        raise ValueError(f"unexpected {t!r} in the rule {self.text!r}")

    def name(self, t: str):
        if t.lower() in self.scope:
            return self.scope[t.lower()], False
        return self.resolve(t), t.lower() in self.arrays

    def suffix(self, a):
        while self.peek() in (".", "["):
            if self.take()[1] == ".":
                a = a[0].getField(self.take()[1]), False
            else:
                a = F.get(a[0], (self.expression()[0] - 1).cast("int")), False
                self.take("]")
        return a

    def function(self, f: str):
        self.take("(")
        if f == "TYPEOF" and self.peek() == "SELF":
            self.take()
            self.take(")")
            return self.resolve("types"), True
        args = []
        while self.peek() != ")":
            args.append(self.expression())
            if self.peek() == ",":
                self.take()
        self.take(")")
        x = args[0][0] if args else None
        if f in ("SIZEOF", "HIINDEX"):
            return F.when(x.isNull(), 0).otherwise(F.size(x)), False
        if f == "LOINDEX":
            return F.lit(1), False
        if f == "EXISTS":
            return x.isNotNull(), False
        if f == "NVL":
            return F.coalesce(x, args[1][0]), args[0][1]
        simple = {"ABS": F.abs, "SQRT": F.sqrt, "LENGTH": F.length, "BLENGTH": F.octet_length, "SIN": F.sin, "COS": F.cos, "TAN": F.tan, "EXP": F.exp, "LOG": F.log}
        if f in simple:
            return simple[f](x), False
        if f == "VALUE":
            return x.try_cast("double"), False
        if f == "ODD":
            return x % 2 != 0, False
        raise ValueError(f"unknown function {f} in the rule {self.text!r}")


def compile_rule(text: str, df: DataFrame, columns: dict[str, str] | None = None) -> Column:
    """Column of a rule text over a table; names compare without case, ``columns`` maps attribute names to columns."""
    known = {c.lower(): c for c in df.columns} | {k.lower(): v for k, v in (columns or {}).items()}
    arrays = {k for k, c in known.items() if dict(df.dtypes).get(c, "").startswith("array")}

    def resolve(name: str) -> Column:
        if name.lower() not in known:
            raise ValueError(f"unknown attribute {name} in the rule {text!r}")
        return F.col(known[name.lower()])

    p = _Parser(text, resolve, arrays)
    out = p.expression()[0]
    if p.at != len(p.tokens):
        raise ValueError(f"text after the end of the rule {text!r}")
    return out


def check_rules(df: DataFrame, key: str, rules: dict[str, str], columns: dict[str, str] | None = None) -> DataFrame:
    """rule, id: instances that do not fulfil a rule text, all rules in one pass."""
    return violations(df, key, {n: compile_rule(t, df, columns) for n, t in rules.items()})

"""SPARQL expressions as columns. Every error is null; three-valued logic then is SQL's.

Where both operands have native kinds an operator is one native Spark expression, which reaches Parquet filters and code generation;
terms of unknown kind are compared and computed by their datatypes at run time.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.algebra import IRI, RDF, XSD, Literal
from ..terms import DECIMAL, NUMERIC, SEP, Value, constant, from_numeric, is_numeric_tag, lexical, null, rank, tag, term_decimal, term_double, term_lex, term_tag, to_term, xsd_double
from . import registry

KNOWN = ["xsd:string", "xsd:boolean", "xsd:dateTime", "xsd:date"]


def _no() -> Column:
    return F.lit(None).cast("boolean")


def boolean(c: Column) -> Value:
    return Value(c, "boolean")


def string(c: Column) -> Value:
    return Value(c, "string")


class Compiler:
    """Compiles expressions over named values. ``refs`` gives a class its IRI prefix; ``exists`` lowers EXISTS, if the caller can."""

    def __init__(self, scope: dict[str, Value], refs: dict[str, str], base: str = "", exists=None):
        self.scope, self.refs, self.base, self.exists = scope, refs, base, exists

    def plain(self, v: Value) -> Value:
        """A row reference as the IRI it stands for."""
        if v.kind.startswith("ref:"):
            return Value(F.concat(F.lit(self.refs[v.kind[4:]]), v.col.cast("string")), "iri")
        return v

    def __call__(self, e: Any) -> Value:
        kind = e[0]
        if kind == "var":
            return self.scope.get(e[1], null())
        if kind == "iri":
            return constant(IRI(e[1]))
        if kind == "lit":
            return constant(Literal(*e[1:]))
        if kind == "exists":
            return boolean(self.exists(e))
        if kind == "in":
            return self.member(*e[1:])
        if kind == "call":
            return self.call(e[1], list(e[2:]))
        return self.operator(e[1], list(e[2:]))

    # truth
    def ebv(self, v: Value) -> Column:
        if v.kind == "boolean":
            return v.col
        if v.kind in ("string", "lang"):
            return F.length(v.col) > 0
        if v.kind in ("integer", "decimal"):
            return v.col != 0
        if v.kind in ("float", "double"):
            return (v.col != 0) & ~F.isnan(v.col)
        if v.kind == "term":
            t, lex = term_tag(v.col), term_lex(v.col)
            n = term_double(v.col)
            return F.when(t == "xsd:boolean", F.lower(lex).isin("true", "1")).when((t == "xsd:string") | t.startswith("@"), F.length(lex) > 0).when(is_numeric_tag(t), F.coalesce((n != 0) & ~F.isnan(n), F.lit(False)))
        return _no()

    def truth(self, e: Any) -> Column:
        return self.ebv(self(e))

    def member(self, e: Any, items: list, negated: bool) -> Value:
        v = self(e)
        values = [self(i) for i in items]
        if values and v.kind in ("string", "integer") and all(x.kind == v.kind and x.constant is not None for x in values):
            found = v.col.isin([x.constant.lex if v.kind == "string" else int(x.constant.lex) for x in values])
        else:
            found = reduce(lambda a, b: a | b, (self.compare("=", v, x) for x in values), F.lit(False))
        return boolean(~found if negated else found)

    # comparison
    def compare(self, op: str, a: Value, b: Value) -> Column:
        if a.kind.startswith("ref:") or b.kind.startswith("ref:"):
            if a.kind == b.kind:
                return self._plain_compare(op, a.col, b.col) if op in ("=", "!=") else _no()
            for x, y in ((a, b), (b, a)):
                if x.kind.startswith("ref:") and isinstance(y.constant, IRI):
                    prefix = self.refs[x.kind[4:]]
                    if not y.constant.value.startswith(prefix):
                        return (F.lit(op == "!=") if op in ("=", "!=") else _no())
                    rest = y.constant.value[len(prefix) :]
                    if op in ("=", "!=") and rest.lstrip("-").isdigit():
                        return self._plain_compare(op, x.col, F.lit(int(rest)))
            a, b = self.plain(a), self.plain(b)
        if a.kind in NUMERIC and b.kind in NUMERIC:
            return self._numbers(op, a, b)
        if a.kind == b.kind and a.kind in ("string", "boolean", "dateTime", "date"):
            return self._plain_compare(op, a.col, b.col)
        if a.kind == b.kind == "lang":
            same = (a.col == b.col) & (F.lower(a.lang) == F.lower(b.lang))
            return {"=": same, "!=": ~same}.get(op, _no())
        if a.kind == b.kind and a.kind in ("iri", "bnode"):
            return self._plain_compare(op, a.col, b.col) if op in ("=", "!=") else _no()
        if "term" not in (a.kind, b.kind):
            resources = ("iri", "bnode")
            if op in ("=", "!=") and (a.kind in resources or b.kind in resources or "lang" in (a.kind, b.kind)):
                return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(op == "!="))
            return _no()
        return self._terms(op, a, b)

    @staticmethod
    def _plain_compare(op: str, a: Column, b: Column) -> Column:
        return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]

    def _numbers(self, op: str, a: Value, b: Value) -> Column:
        out = self._plain_compare(op, a.col, b.col)
        # Spark holds NaN equal to itself and above all numbers; SPARQL holds it unequal and unordered
        for x, ops in ((a, ("=", ">", ">=")), (b, ("=", "<", "<="))):
            if x.kind in ("float", "double") and x.constant is None:
                if op in ops:
                    out = out & ~F.isnan(x.col)
                elif op == "!=":
                    out = out | F.isnan(x.col)
        return out

    def _terms(self, op: str, a: Value, b: Value) -> Column:
        x, y = to_term(a), to_term(b)
        tx, ty = term_tag(x), term_tag(y)
        numeric = rank(tx).isNotNull() & rank(ty).isNotNull()
        exact = (rank(tx) <= 2) & (rank(ty) <= 2)
        dx, dy = term_double(x), term_double(y)
        by_number = F.when(exact, self._plain_compare(op, term_decimal(x), term_decimal(y))).otherwise(F.when(F.isnan(dx) | F.isnan(dy), F.lit(op == "!=")).otherwise(self._plain_compare(op, dx, dy)))
        both = lambda t: (tx == t) & (ty == t)
        lx, ly = term_lex(x), term_lex(y)
        truth = lambda lex: F.when(lex.isin("true", "1"), True).when(lex.isin("false", "0"), False)
        out = F.when(numeric, by_number).when(both("xsd:string"), self._plain_compare(op, lx, ly)).when(both("xsd:boolean"), self._plain_compare(op, truth(lx), truth(ly)))
        out = out.when(both("xsd:dateTime"), self._plain_compare(op, F.try_to_timestamp(lx), F.try_to_timestamp(ly))).when(both("xsd:date"), self._compare_dates(op, lx, ly))
        if op in ("=", "!="):
            eq = op == "="
            comparable = F.coalesce(tx.isin(KNOWN) | is_numeric_tag(tx) | tx.startswith("@"), F.lit(True)) & F.coalesce(ty.isin(KNOWN) | is_numeric_tag(ty) | ty.startswith("@"), F.lit(True))
            # a resource or a language-tagged literal differs from anything else; literals of unknown or different datatypes are an error
            out = out.when(x == y, F.lit(eq)).when(tx.isNull() | ty.isNull() | tx.startswith("@") | ty.startswith("@"), F.when(x.isNotNull() & y.isNotNull(), F.lit(not eq))).when(comparable & (tx == ty), F.lit(not eq))
        return out

    def same_term(self, a: Value, b: Value) -> Column:
        if a.kind == b.kind and a.kind != "lang":
            return a.col == b.col
        return to_term(self.plain(a)) == to_term(self.plain(b))

    # arithmetic
    def _compare_dates(self, op: str, lx: Column, ly: Column) -> Column:
        """Dates by the instants they begin at. With a zone on one side only, they are ordered when 14 hours or more can't make a difference."""
        form = r"^\d{4}-\d\d-\d\d(Z|[+-]\d\d:\d\d)?$"
        zones = [F.regexp_extract(x, form, 1) for x in (lx, ly)]
        a, b = (F.when(F.regexp_like(x, F.lit(form)), F.try_to_timestamp(F.concat(F.substring(x, 1, 10), F.lit("T00:00:00"), F.when(z == "", "Z").otherwise(z)))) for x, z in zip((lx, ly), zones))
        apart = F.abs(F.unix_seconds(a) - F.unix_seconds(b)) > 14 * 3600
        return F.when(((zones[0] == "") == (zones[1] == "")) | apart, self._plain_compare(op, a, b))

    def arithmetic(self, op: str, a: Value, b: Value) -> Value:
        if a.kind in NUMERIC and b.kind in NUMERIC:
            kind = max(a.kind, b.kind, key=NUMERIC.index)
            if op == "/" and kind == "integer":
                kind = "decimal"
            x, y = (v.col.cast({"integer": "bigint", "decimal": DECIMAL, "float": "float", "double": "double"}[kind]) for v in (a, b))
            if op == "/":
                # XSD: a decimal divided by zero is an error, a double is infinite
                out = F.try_divide(x, y) if kind == "decimal" else F.when(y == 0, F.when(x == 0, F.lit(float("nan"))).when(F.isnan(x), F.lit(float("nan"))).otherwise(F.signum(x) * F.lit(float("inf")))).otherwise(F.try_divide(x, y))
            else:
                out = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)
            return Value(out.try_cast({"decimal": DECIMAL, "float": "float"}[kind]) if kind in ("decimal", "float") else out, kind)
        if "term" not in (a.kind, b.kind):
            return null("double")
        x, y = to_term(self.plain(a)), to_term(self.plain(b))
        best = F.greatest(rank(term_tag(x)), rank(term_tag(y)))
        best = F.when(rank(term_tag(x)).isNotNull() & rank(term_tag(y)).isNotNull(), best)
        if op == "/":
            best = F.when(best == 1, 2).otherwise(best)
        f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[op]
        return Value(from_numeric(best, f(term_decimal(x), term_decimal(y)).try_cast(DECIMAL), f(term_double(x), term_double(y))), "term")

    def numeric(self, v: Value, native, dec=None) -> Value:
        """A one-argument numeric function; ``native`` works on any numeric column."""
        if v.kind in NUMERIC:
            return Value(native(v.col, v.kind), v.kind)
        if v.kind != "term":
            return null("double")
        x = v.col
        return Value(from_numeric(rank(term_tag(x)), native(term_decimal(x), "decimal"), native(term_double(x), "double")), "term")

    # strings
    def text(self, v: Value) -> tuple[Column, Column | None]:
        """(lexical form, language or empty) of a string argument; nulls for anything else."""
        if v.kind == "string":
            return v.col, F.lit("")
        if v.kind == "lang":
            return v.col, F.lower(v.lang)
        if v.kind == "term":
            t = term_tag(v.col)
            ok = (t == "xsd:string") | t.startswith("@")
            return F.when(ok, term_lex(v.col)), F.when(ok, F.when(t.startswith("@"), F.substring(t, 2, 1 << 30)).otherwise(F.lit("")))
        return F.lit(None).cast("string"), F.lit(None).cast("string")

    def like(self, v: Value, out: Column) -> Value:
        """A string result that keeps the language of ``v``."""
        if v.kind == "lang":
            return Value(out, "lang", v.lang)
        if v.kind == "term":
            return Value(F.concat(F.lit("L"), term_tag(v.col), F.lit(SEP), out), "term")
        return string(out)

    def compatible(self, a: Value, b: Value) -> Column:
        """Whether a string and a second argument fit: the second is plain, or has the first one's language."""
        if b.kind == "string":
            return F.lit(True)
        return (self.text(b)[1] == "") | (self.text(a)[1] == self.text(b)[1])

    def operator(self, name: str, args: list) -> Value:
        if name == "&&":
            return boolean(self.truth(args[0]) & self.truth(args[1]))
        if name == "||":
            return boolean(self.truth(args[0]) | self.truth(args[1]))
        if name == "!":
            return boolean(~self.truth(args[0]))
        if name in ("=", "!=", "<", "<=", ">", ">="):
            return boolean(self.compare(name, self(args[0]), self(args[1])))
        if name in ("+", "-", "*", "/"):
            return self.arithmetic(name, self(args[0]), self(args[1]))
        if name in ("neg", "pos"):
            return self.numeric(self(args[0]), (lambda c, k: F.negate(c)) if name == "neg" else (lambda c, k: c))
        from .builtins import BUILTINS

        return BUILTINS[name](self, *args)

    def unify(self, values: list[Value]) -> tuple[list[Value], str]:
        """Values in one common kind: their own if equal, promoted numbers, or terms."""
        kinds = {v.kind for v in values}
        if len(kinds) == 1:
            return values, kinds.pop()
        if kinds <= set(NUMERIC) and not any(k == "decimal" for k in kinds):
            kind = max(kinds, key=NUMERIC.index)
            return [Value(v.col.cast({"integer": "bigint", "float": "float", "double": "double"}[kind]), kind) for v in values], kind
        return [Value(to_term(self.plain(v)), "term") for v in values], "term"

    def choose(self, pick, values: list[Value]) -> Value:
        """Combines values of possibly different kinds by ``pick`` over their columns."""
        values, kind = self.unify(values)
        if kind == "lang":
            return Value(pick([v.col for v in values]), "lang", pick([v.lang for v in values]))
        return Value(pick([v.col for v in values]), kind)

    def call(self, iri: str, args: list) -> Value:
        if iri.startswith(XSD):
            return self.cast(iri[len(XSD) :], self(args[0]))
        if iri not in registry.SCALAR:
            return null()
        return registry.SCALAR[iri](self, *map(self, args))

    def cast(self, kind: str, v: Value) -> Value:
        if v.kind == kind:
            return Value(v.col, kind)
        if kind == "string":
            return string(lexical(self.plain(v)))
        v = self.plain(v)
        if v.kind in ("iri", "bnode", "lang"):
            return null(kind)
        lex = F.trim(lexical(v))
        if v.kind == "term":
            lex = F.when(v.col.startswith("L") & ~term_tag(v.col).startswith("@"), lex)
        number = v.kind in NUMERIC
        if kind == "boolean":
            if number:
                return boolean(v.col != 0)
            by_number = F.when(is_numeric_tag(term_tag(v.col)), term_double(v.col) != 0) if v.kind == "term" else _no()
            return boolean(F.coalesce(by_number, F.when(lex.isin("true", "1"), True).when(lex.isin("false", "0"), False)))
        if kind in NUMERIC:
            if v.kind == "boolean":
                n = F.when(v.col, 1).when(~v.col, 0)
                return Value(n.cast({"integer": "bigint", "decimal": DECIMAL}.get(kind, kind)), kind)
            if v.kind == "term":
                lex = F.when(term_tag(v.col) == "xsd:boolean", F.when(lex.isin("true", "1"), "1").when(lex.isin("false", "0"), "0")).otherwise(lex)
            if kind == "double":
                return Value(v.col.cast("double") if number else xsd_double(lex), kind)
            if kind == "float":
                return Value(v.col.cast("float") if number else xsd_double(lex).cast("float"), kind)
            if number:
                return Value(v.col.try_cast("bigint" if kind == "integer" else DECIMAL), kind)
            if kind == "integer":
                digits = F.when(F.regexp_like(lex, F.lit(r"^[+-]?[0-9]+$")), lex.try_cast("bigint"))
                if v.kind == "term":
                    digits = F.coalesce(digits, F.when(rank(term_tag(v.col)) >= 2, term_double(v.col).try_cast("bigint")))
                return Value(digits, kind)
            return Value(F.when(F.regexp_like(lex, F.lit(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$")), lex.try_cast(DECIMAL)), kind)
        if kind == "dateTime":
            return Value(v.col.cast("timestamp") if v.kind == "date" else F.when(F.regexp_like(lex, F.lit(r"^-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d")), F.try_to_timestamp(lex)), kind)
        if kind == "date":
            return Value(v.col.cast("date") if v.kind == "dateTime" else F.substring(lex, 1, 10).try_cast("date"), kind)
        return null()


def typed(lex: Column, datatype: Column | str) -> Value:
    return Value(F.concat(F.lit("L"), F.lit(tag(datatype)) if isinstance(datatype, str) else datatype, F.lit(SEP), lex), "term")


LANG_STRING = RDF + "langString"

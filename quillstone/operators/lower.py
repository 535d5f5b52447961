"""Algebra to DataFrames, bottom-up. Nothing runs here but path closures and what names graphs."""

from __future__ import annotations

import itertools
from functools import reduce
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import builtins, extensions, labels, registry  # noqa: F401  (imported ones register functions)
from ..functions.expressions import Compiler
from ..plans import algebra as A
from ..plans.algebra import BGP, IRI, Path, Triple, Var
from ..sources.graphs import EachGraph, QuadGraph
from ..terms import DECIMAL, NUMERIC, SQL_TYPES, Value, constant, encode, from_numeric, lexical, order_key, rank, term_decimal, term_double, term_tag, to_term
from .materialize import materialized
from .relation import Algebra, Relation, build, columns, empty, q

SEARCH = "urn:quillstone:search:"


class Lowering:
    def __init__(self, spark: SparkSession, source, base: str = "", default_graphs: list[str] | None = None, named_graphs: list[str] | None = None, options: dict | None = None):
        self.spark, self.source, self.base = spark, source, base
        self.default, self.named = default_graphs or None, named_graphs
        self.algebra = Algebra(source.refs)
        self.options = options or {}
        self.fresh = itertools.count()

    # helpers
    def new(self, prefix: str = "_h") -> str:
        return f"{prefix}{next(self.fresh)}"

    def unit(self) -> Relation:
        return Relation(self.spark.range(1).select(F.lit(1).alias("__one")), {}, set(), True)

    def none(self, names: set[str]) -> Relation:
        return empty(self.spark, dict.fromkeys(sorted(names), "term"))

    def compiler(self, scope: dict[str, Value]) -> Compiler:
        return Compiler(scope, self.source.refs, self.base)

    def __call__(self, node: Any, graph: Any = "default") -> Relation:
        if graph == "default":
            graph = self.default
        return getattr(self, type(node).__name__.lower())(node, graph)

    # patterns
    def bgp(self, node: BGP, graph: Any) -> Relation:
        plain, paths, search = [], [], []
        for t in self.expand(node.triples):
            if isinstance(t, Triple) and isinstance(t.p, IRI) and t.p.value.startswith(SEARCH):
                search.append(t)
            elif isinstance(t, Triple) and not isinstance(t.p, Path):
                plain.append(t)
            else:
                paths.append(t)
        # patterns that only a path links stay apart until it comes: joined before it they would be every pair of their rows
        parts = [self.source.bgp(g, graph) for g in linked(plain)] if plain or not (paths or search) else []
        if search:
            from .fulltext import search_relation

            parts += search_relation(self, search, graph)
        unions = [t for t in paths if not isinstance(t, Triple)]
        parts += [self(t, graph) for t in unions]
        repeats = [t for t in paths if isinstance(t, Triple)]
        everywhere = {graph.variable} if isinstance(graph, EachGraph) else set()  # shared by all, so no link
        out = parts.pop(0) if parts else None
        while parts or repeats:
            known = out.kinds.keys() if out is not None else set()
            k = next((i for i, p in enumerate(parts) if known & p.kinds.keys() - everywhere), None)
            if k is None and repeats:
                # a path comes when one of its ends is bound, if one ever is: it then starts from those bindings
                k = next((i for i, t in enumerate(repeats) if {x.name for x in (t.s, t.o) if isinstance(x, Var)} & known), None if parts else 0)
                if k is not None:
                    t = repeats.pop(k)
                    r = self.path(t.s, t.p, t.o, graph, [out, *parts] if out is not None else [])
                    out = r if out is None else self.algebra.join(out, r)
                    continue
            out = self.algebra.join(out, parts.pop(k or 0))
        return out

    def expand(self, triples: list[Triple]) -> list:
        """Sequences, inverses and plain steps of paths as triples over hidden variables; other paths as they are or as unions."""
        out: list = []
        for t in triples:
            if not isinstance(t.p, Path):
                out.append(t)
            elif t.p.kind == "iri":
                out.append(Triple(t.s, IRI(t.p.args[0]), t.o))
            elif t.p.kind == "inverse":
                out += self.expand([Triple(t.o, t.p.args[0], t.s)])
            elif t.p.kind == "sequence":
                at = t.s
                for i, step in enumerate(t.p.args):
                    to = t.o if i == len(t.p.args) - 1 else Var(self.new())
                    out += self.expand([Triple(at, step, to)])
                    at = to
            elif t.p.kind == "alternative":
                out.append(reduce(A.Union, (BGP([Triple(t.s, p, t.o)]) for p in t.p.args)))
            else:
                out.append(t)
        return out

    def path(self, s: Any, p: Path, o: Any, graph: Any, known: list[Relation] | None = None) -> Relation:
        """``known``: what other patterns of the same group bind; a closure needs to start only there."""
        from .paths import repeat

        if p.kind == "negated":
            forward, backward = p.args
            parts = []
            for names, a, b in ((forward, s, o), (backward, o, s)):
                if names or (not backward and names is forward):
                    v = self.new()
                    hint = []  # the class of what is bound already says which table to look in
                    kind = next((r.kinds[a.name] for r in known or [] if a.name in r.sure), "") if isinstance(a, Var) else ""
                    if kind.startswith("ref:"):
                        hint = [Triple(a, IRI(A.RDF + "type"), IRI(self.source.refs[kind[4:]].rstrip("/")))]
                    r = self.bgp(BGP([Triple(a, Var(v), b), *hint]), graph)
                    r = Relation(r.df.filter(~q(v).isin(["I" + n for n in names])) if names else r.df, r.kinds, r.sure)
                    parts.append(self.algebra.project(r, [x for x in r.kinds if x != v]))
            return reduce(self.algebra.union, parts)
        return repeat(self, s, p, o, graph, known)

    def join(self, node: A.Join, graph: Any) -> Relation:
        if isinstance(node.right, A.Service):
            return self.service(node.right, graph, self(node.left, graph))
        return self.algebra.join(self(node.left, graph), self(node.right, graph))

    def leftjoin(self, node: A.LeftJoin, graph: Any) -> Relation:
        left, right = self(node.left, graph), self(node.right, graph)
        if node.condition is None:
            return self.algebra.left_join(left, right)
        if A.has_exists(node.condition):
            # the condition sees solutions of both sides: find those first, then keep what is unmatched
            left = self.numbered(left)
            both = self.filtered(self.algebra.join(left, right), node.condition, graph)
            matched = self.algebra.semi(left, self.algebra.project(both, ["__row"]), True)
            out = self.algebra.union(both, matched)
            return self.algebra.project(out, [v for v in out.kinds if v != "__row"])
        return self.algebra.left_join(left, right, lambda scope: self.compiler(scope).truth(node.condition))

    def numbered(self, r: Relation) -> Relation:
        df = materialized(r.df.withColumn("__row", F.monotonically_increasing_id()))
        return Relation(df, r.kinds | {"__row": "integer"}, r.sure | {"__row"})

    def filter(self, node: A.Filter, graph: Any) -> Relation:
        return self.filtered(self(node.child, graph), node.condition, graph)

    def filtered(self, r: Relation, condition: Any, graph: Any) -> Relation:
        plain = []
        for e in A.conjuncts(condition):
            negated = False
            while e[:2] == ("op", "!") and len(e) == 3 and e[2][0] == "exists":
                negated, e = not negated, e[2]
            if e[0] == "exists":
                r = self.exists(r, e[1], e[2] != negated, graph)
            elif A.has_exists(e):
                r, e = self.marked(r, e, graph)
                marks = [v for v in r.kinds if v.startswith("__mark")]
                r = Relation(r.df.filter(self.compiler(r.scope()).truth(e)), r.kinds, r.sure)
                r = self.algebra.project(r, [v for v in r.kinds if v not in marks])
            else:
                plain.append(e)
        if plain:
            c = self.compiler(r.scope())
            test = reduce(lambda a, b: a & b, (c.truth(e) for e in plain))
            r = Relation(r.df.filter(test), r.kinds, r.sure, False) if not r.unit else Relation(r.df.filter(test), {}, set())
        return r

    def lifted(self, pattern: Any, outer: set[str]) -> tuple[Any, list]:
        """Filters at the end of a group that see variables of the outer solution only, and the rest of the group."""
        lift = []
        while isinstance(pattern, A.Filter):
            here = []
            inner = A.variables(pattern.child)
            for e in A.conjuncts(pattern.condition):
                (lift if (A.expression_variables(e) - inner) & outer and not A.has_exists(e) else here).append(e)
            if here:
                rest = reduce(lambda a, b: ("op", "&&", a, b), here)
                child, more = self.lifted(pattern.child, outer)
                return A.Filter(rest, child), lift + more
            pattern = pattern.child
        return pattern, lift

    def exists(self, r: Relation, pattern: Any, negated: bool, graph: Any) -> Relation:
        pattern, lift = self.lifted(pattern, set(r.kinds))
        inner = self(pattern, graph)
        condition = None
        if lift:
            condition = lambda scope: reduce(lambda a, b: a & b, (self.compiler(scope).truth(e) for e in lift))
        return self.algebra.semi(r, inner, negated, condition)

    def marked(self, r: Relation, e: Any, graph: Any) -> tuple[Relation, Any]:
        """EXISTS inside an expression becomes a column that says whether there is a match."""
        if isinstance(e, tuple) and e and e[0] == "exists":
            mark = self.new("__mark")
            pattern, lift = self.lifted(e[1], set(r.kinds))
            inner = self(pattern, graph)
            shared = sorted(r.kinds.keys() & inner.kinds.keys())
            if lift or not all(v in r.sure and v in inner.sure for v in shared) or not shared:
                numbered = self.numbered(r)
                hit = self.exists(numbered, e[1], False, graph)
                flags = Relation(hit.df.select("__row", F.lit(True).alias(mark)), {"__row": "integer", mark: "boolean"}, {"__row", mark})
                out = self.algebra.left_join(numbered, flags)
                out = self.algebra.project(out, [v for v in out.kinds if v != "__row"])
            else:
                keys = self.algebra.distinct(self.algebra.project(inner, shared))
                flags = Relation(keys.df.withColumn(mark, F.lit(True)), keys.kinds | {mark: "boolean"}, keys.sure | {mark})
                out = self.algebra.left_join(r, flags)
            found = ("op", "COALESCE", ("var", mark), ("lit", "false", A.XSD + "boolean", None))
            return out, ("op", "!", found) if e[2] else found
        if isinstance(e, (tuple, list)):
            parts = []
            for x in e:
                r, x = self.marked(r, x, graph) if isinstance(x, (tuple, list)) else (r, x)
                parts.append(x)
            return r, type(e)(parts)
        return r, e

    def extend(self, node: A.Extend, graph: Any) -> Relation:
        r, expr = self(node.child, graph), node.expr
        hidden: set[str] = set()
        if A.has_exists(expr):
            known = set(r.kinds)
            r, expr = self.marked(r, expr, graph)
            hidden = set(r.kinds) - known
        if expr[0] == "call" and expr[1] in registry.TUPLE:
            c = self.compiler(r.scope())
            rows = registry.TUPLE[expr[1]](c, *(c(a) for a in expr[2:]))
            return build(r.df.withColumn(node.var, F.explode(rows)), r.scope() | {node.var: Value(q(node.var), "string")}, r.sure | {node.var})
        v = self.compiler(r.scope())(expr)
        sure = r.sure | ({node.var} if v.constant is not None or expr[0] == "var" and expr[1] in r.sure else set())
        return build(r.df, {k: x for k, x in r.scope().items() if k not in hidden} | {node.var: v}, sure - hidden)

    def union(self, node: A.Union, graph: Any) -> Relation:
        return self.algebra.union(self(node.left, graph), self(node.right, graph))

    def minus(self, node: A.Minus, graph: Any) -> Relation:
        return self.algebra.minus(self(node.left, graph), self(node.right, graph))

    def graph(self, node: A.Graph, graph: Any) -> Relation:
        allowed = self.named
        if isinstance(node.name, IRI):
            if allowed is not None and node.name.value not in allowed and (self.default or allowed):
                return self.none(A.variables(node.child))
            return self(node.child, node.name.value)
        known = (allowed or []) if self.default or allowed else None
        if isinstance(self.source, QuadGraph) and spreads(node.child):
            # the graph is a column that all patterns share: one plan for any number of graphs
            hidden, name = self.new("_g"), node.name.name
            r = self(node.child, EachGraph(hidden, known))
            scope = r.scope()
            if name in scope:  # inside, the variable is bound by a pattern only; outside it is the graph's name
                r = Relation(r.df.filter(q(name).isNull() | self.algebra.same(scope[name], scope[hidden])), r.kinds, r.sure)
            return build(r.df, {v: x for v, x in scope.items() if v not in (hidden, name)} | {name: scope[hidden]}, (r.sure - {hidden}) | {name})
        out = None
        for name in self.source.graph_names() if not (self.default or allowed) else allowed or []:
            r = self.algebra.join(self(node.child, name), self.bind(node.name.name, IRI(name)))
            out = r if out is None else self.algebra.union(out, r)
        return out if out is not None else self.none(A.variables(node))

    def bind(self, name: str, t: Any) -> Relation:
        return build(self.spark.range(1), {name: constant(t)}, {name})

    def values(self, node: A.Values, graph: Any) -> Relation:
        kinds = []
        for i in range(len(node.vars)):
            found = {constant(row[i]).kind for row in node.rows if row[i] is not None}
            kinds.append(found.pop() if len(found) == 1 and found <= {"iri", "string", "integer", "double", "boolean"} else "term")

        def native(t: Any, kind: str) -> Any:
            if t is None:
                return None
            if kind == "term":
                return encode(t)
            if kind == "iri":
                return t.value
            return {"integer": int, "double": float, "boolean": lambda x: x in ("true", "1")}.get(kind, str)(t.lex)

        rows = [tuple(native(t, k) for t, k in zip(row, kinds)) + (1,) for row in node.rows]
        schema = ", ".join([f"`{v}` {SQL_TYPES[k]}" for v, k in zip(node.vars, kinds)] + ["__one int"])
        sure = {v for i, v in enumerate(node.vars) if all(row[i] is not None for row in node.rows)}
        return Relation(self.spark.createDataFrame(rows, schema), dict(zip(node.vars, kinds)), sure)

    def service(self, node: A.Service, graph: Any, left: Relation | None = None) -> Relation:
        left = left or self.unit()
        iri = node.name.value if isinstance(node.name, IRI) else None
        if iri in registry.SERVICE:
            return registry.SERVICE[iri](self, node, left, graph)
        remote = self.options.get("endpoints", {}).get(iri)
        if remote is None:
            if node.silent:
                return left
            raise LookupError(f"no endpoint {iri}")
        inner = Lowering(self.spark, remote, self.base, options=self.options)
        r = inner(node.child)
        # references into another source's tables leave as IRIs
        r = build(r.df, {v: inner.algebra.plain(x) for v, x in r.scope().items()}, r.sure)
        return self.algebra.join(left, r)

    # modifiers
    def project(self, node: A.Project, graph: Any) -> Relation:
        return self.algebra.project(self(node.child, graph), node.vars)

    def distinct(self, node: A.Distinct, graph: Any) -> Relation:
        return self.algebra.distinct(self(node.child, graph))

    def orderby(self, node: A.OrderBy, graph: Any) -> Relation:
        r = self(node.child, graph)
        c = self.compiler(r.scope())
        keys = [order_key(c.plain(c(e)) if not c(e).kind.startswith("ref:") else c(e)) for e, _ in node.keys]
        return Relation(r.df.orderBy(*(k.asc_nulls_first() if up else k.desc_nulls_last() for k, (_, up) in zip(keys, node.keys))), r.kinds, r.sure)

    def slice(self, node: A.Slice, graph: Any) -> Relation:
        child = node.child
        if isinstance(child, A.Project) and isinstance(child.child, A.OrderBy):
            # the sort stays next to the limit, so that Spark takes the first rows without sorting all
            r = self(child.child, graph)
            df = r.df.offset(node.offset) if node.offset else r.df
            r = Relation(df.limit(node.limit) if node.limit is not None else df, r.kinds, r.sure)
            return self.algebra.project(r, child.vars)
        r = self(child, graph)
        df = r.df.offset(node.offset) if node.offset else r.df
        return Relation(df.limit(node.limit) if node.limit is not None else df, r.kinds, r.sure)

    # aggregation
    def group(self, node: A.Group, graph: Any) -> Relation:
        r = self(node.child, graph)
        c = self.compiler(r.scope())
        keys = {}
        for name, e in node.keys:
            v = c(e)
            keys[name] = Value(to_term(v), "term") if v.kind == "lang" else v
        results: dict[str, tuple] = {}
        aggs = []
        for name, (_, f, e, distinct, separator) in node.aggs:
            if f in registry.AGGREGATE:
                v = registry.AGGREGATE[f](c, c(e), distinct)
                aggs.append(v.col.alias(name))
                results[name] = v.kind
                continue
            col, kind = aggregate(c, f, None if e is None else c(e), distinct, separator, [x for v in r.kinds for x in columns(v, r.value(v))])
            aggs.append(col.alias(name))
            results[name] = kind
        if not aggs:
            df = r.df.select(*(v.col.alias(k) for k, v in keys.items())).distinct()
        else:
            df = r.df.groupBy(*(v.col.alias(k) for k, v in keys.items())).agg(*aggs)
        kinds = {k: v.kind for k, v in keys.items()} | results
        sure = {k for k, e in node.keys if e[0] == "var" and e[1] in r.sure}
        return Relation(df, kinds, sure)


def linked(triples: list[Triple]) -> list[list[Triple]]:
    """Triple patterns in groups that share no variable and no subject; one empty group if there are none."""
    groups: list[tuple[set, list[Triple]]] = []
    for t in triples:
        names = {t.s, *(x for x in (t.p, t.o) if isinstance(x, Var))}
        near = [g for g in groups if g[0] & names]
        at = groups.index(near[0]) if near else len(groups)
        groups = [g for g in groups if g not in near]
        groups.insert(at, (names.union(*(n for n, _ in near)), [x for _, members in near for x in members] + [t]))
    return [members for _, members in groups] or [[]]


def spreads(x: Any) -> bool:
    """Whether a pattern means the same in each graph apart and over all with the graph as a shared column."""
    if isinstance(x, BGP):
        steps = [t.p for t in x.triples]
        while any(isinstance(p, Path) and p.kind in ("inverse", "sequence", "alternative") for p in steps):
            steps = [y for p in steps for y in (p.args if isinstance(p, Path) and p.kind in ("inverse", "sequence", "alternative") else [p])]
        return bool(steps) and all(isinstance(p, Var) or isinstance(p, IRI) and not p.value.startswith(SEARCH) or isinstance(p, Path) and p.kind == "iri" for p in steps)
    if isinstance(x, (A.Join, A.Union)):
        return spreads(x.left) and spreads(x.right)
    if isinstance(x, A.LeftJoin):
        return spreads(x.left) and spreads(x.right) and not A.has_exists(x.condition)
    if isinstance(x, A.Filter):
        return spreads(x.child) and not A.has_exists(x.condition)
    return isinstance(x, A.Extend) and spreads(x.child) and not A.has_exists(x.expr)


def aggregate(c: Compiler, f: str, v: Value | None, distinct: bool, separator: str, every: list):
    """(column, kind) of an aggregate. A bound member that isn't a number makes SUM and AVG unbound; unbound members are skipped."""
    if f == "COUNT":
        if v is None:
            return (F.count_distinct(F.struct(*every)) if distinct else F.count(F.lit(1))), "integer"
        col = to_term(v) if v.kind == "lang" else v.col
        return (F.count_distinct(col) if distinct else F.count(col)), "integer"
    if f in ("SUM", "AVG"):
        v = c.plain(v)
        if v.kind in NUMERIC:
            if f == "SUM":
                total = F.sum_distinct(v.col) if distinct else F.try_sum(v.col) if v.kind == "integer" else F.sum(v.col)
                if v.kind == "decimal":
                    total = (F.sum_distinct(v.col) if distinct else F.try_sum(v.col)).try_cast(DECIMAL)
                return F.coalesce(total, F.when(F.count(v.col) == 0, F.lit(0).cast(SQL_TYPES[v.kind]))), v.kind
            col = v.col.cast(DECIMAL) if v.kind == "integer" else v.col
            kind = "decimal" if v.kind == "integer" else v.kind
            total = (F.sum_distinct(col) if distinct else F.try_sum(col)) / F.count_distinct(col) if distinct else F.try_avg(col)
            return F.coalesce(total.try_cast(SQL_TYPES[kind]), F.when(F.count(v.col) == 0, F.lit(0).cast(SQL_TYPES[kind]))), kind
        t = to_term(v)
        number = rank(term_tag(t))
        good = F.count_if(t.isNotNull() & number.isNull()) == 0
        if distinct:
            values = F.collect_set(t)
            dec = F.aggregate(values, F.lit(0).cast(DECIMAL), lambda acc, x: F.try_add(acc, term_decimal(x)).try_cast(DECIMAL))
            dbl = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + term_double(x))
            n = F.size(values)
        else:
            dec, dbl, n = F.coalesce(F.try_sum(term_decimal(t)), F.lit(0).cast(DECIMAL)).try_cast(DECIMAL), F.coalesce(F.sum(term_double(t)), F.lit(0.0)), F.count(t)
        best = F.coalesce(F.max(number), F.lit(1))
        if f == "AVG":
            best = F.when(n == 0, 1).otherwise(F.greatest(best, F.lit(2)))
            dec, dbl = F.coalesce(F.try_divide(dec, n), F.lit(0)).try_cast(DECIMAL), F.coalesce(F.try_divide(dbl, n), F.lit(0.0))
        return F.when(good, from_numeric(best, dec, dbl)), "term"
    if f in ("MIN", "MAX"):
        v = c.plain(v)
        if v.kind == "lang":
            v = Value(to_term(v), "term")
        if v.kind == "term":
            key = order_key(v)
            return (F.min_by(v.col, key) if f == "MIN" else F.max_by(v.col, key)), "term"
        return (F.min(v.col) if f == "MIN" else F.max(v.col)), v.kind
    if f == "SAMPLE":
        col, kind = (to_term(v), "term") if v.kind == "lang" else (v.col, v.kind)
        return F.any_value(col, F.lit(True)), kind
    texts = lexical(c.plain(v))
    return F.array_join(F.array_sort(F.collect_set(texts) if distinct else F.collect_list(texts)), separator), "string"



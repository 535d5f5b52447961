"""Repeated paths: closures by semi-naive rounds. A search from given ends joins the newest pairs with the edges; without given ends they are
joined with all pairs found, which doubles the length of paths in each round."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.algebra import BGP, IRI, Literal, Path, Triple, Var
from ..terms import Value, constant
from .materialize import discard, materialized
from .relation import Relation, build, empty, q

COMPACT = 8  # rounds after which the pairs found are rewritten as one table


def domain(known: list[Relation] | None, x: Any) -> tuple[DataFrame, Value] | None:
    """Where an open end is bound already, and its bindings there."""
    if not isinstance(x, Var):
        return None
    return next(((r.df, r.value(x.name)) for r in known or [] if x.name in r.sure and r.kinds[x.name] != "lang"), None)


def repeat(low: Any, s: Any, p: Path, o: Any, graph: Any, known: list[Relation] | None = None) -> Relation:
    """``s p{least,most} o``; most is None for closures. Zero steps, ``?``, ``*`` and ``+`` give distinct pairs, other bounds keep duplicates."""
    inner, least, most = p.args
    a, b = low.new(), low.new()
    if most is not None:
        parts = []
        for n in range(max(least, 1), most + 1):
            parts.append(low.bgp(BGP([Triple(Var(a), Path("sequence", (inner,) * n) if n > 1 else inner, Var(b))]), graph))
        r = None
        for x in parts:
            x = low.algebra.project(x, [a, b])
            r = x if r is None else low.algebra.union(r, x)
        if least == 0:
            zero = identity(low, s, o, a, b, graph, known)
            r = zero if r is None else low.algebra.union(r, zero)
            r = low.algebra.distinct(r)
    else:
        r = closure(low, s, inner, o, a, b, graph, known if least <= 1 else None)
        for _ in range(least - 1):  # {n,} with n > 1: n - 1 steps before the closure
            c = low.new()
            step = low.algebra.project(low.bgp(BGP([Triple(Var(c), inner, Var(a))]), graph), [c, a])
            r = low.algebra.project(low.algebra.join(step, r), [c, b])
            a = c
        if least == 0:
            r = low.algebra.union(r, identity(low, s, o, a, b, graph, known))
        r = low.algebra.distinct(r)
    return bind_ends(low, r, a, b, s, o)


def bind_ends(low: Any, r: Relation, a: str, b: str, s: Any, o: Any) -> Relation:
    values: dict[str, Value] = {}
    df = r.df
    c = low.compiler(r.scope())
    for end, x in ((a, s), (b, o)):
        v = r.value(end)
        if isinstance(x, (IRI, Literal)):
            df = df.filter(c.compare("=", v, constant(x)) if v.kind.startswith("ref:") else low.algebra.same(v, constant(x)))
        elif x.name in values:
            df = df.filter(low.algebra.same(values[x.name], v))
        else:
            values[x.name] = v
    if not values:
        return Relation(df.select(F.lit(1).alias("__one")), {}, set())
    return build(df, values, set(values))


def identity(low: Any, s: Any, o: Any, a: str, b: str, graph: Any, known: list[Relation] | None = None) -> Relation:
    """Zero steps: a constant end is linked to itself, in the data or not; two open ends range over all nodes, or over what one of them is
    bound to already."""
    fixed = s if not isinstance(s, Var) else o if not isinstance(o, Var) else None
    if fixed is not None:
        return build(low.spark.range(1), {a: constant(fixed), b: constant(fixed)}, {a, b})
    for end in (s, o):
        found = domain(known, end)
        if found:
            df, v = found
            nodes = df.select(v.col.alias("n")).distinct()
            return build(nodes, {a: Value(q("n"), v.kind), b: Value(q("n"), v.kind)}, {a, b})
    t = low.source.triples(graph)
    nodes = t.select(F.col("s").alias("n")).union(t.select("o")).distinct()
    return build(nodes, {a: Value(q("n"), "term"), b: Value(q("n"), "term")}, {a, b})


def edges(low: Any, inner: Path, graph: Any) -> tuple[DataFrame, str, str]:
    """Distinct (x, y) pairs of one step, both ends in one kind, and that kind."""
    x, y = low.new(), low.new()
    r = low.bgp(BGP([Triple(Var(x), inner, Var(y))]), graph)
    u, v = low.algebra.common(r.value(x), r.value(y))
    if u.kind == "lang":
        u, v = Value(low.algebra.term(r.value(x)), "term"), Value(low.algebra.term(r.value(y)), "term")
    return r.df.select(u.col.alias("x"), v.col.alias("y")).distinct(), u.kind, x


def closure(low: Any, s: Any, inner: Path, o: Any, a: str, b: str, graph: Any, known: list[Relation] | None = None) -> Relation:
    """Pairs linked by one or more steps. A constant end, or one that the group has bound to a minor part of the nodes, makes it a search from
    there. Rounds end when nothing is new; every round's pairs are written to the shared folder, so plans stay small and a lost executor
    costs one round."""
    df, kind, _ = edges(low, inner, graph)
    if not df.columns:
        return empty(low.spark, {a: kind, b: kind})
    df = materialized(df)
    start, end = "x", "y"
    fixed = s if not isinstance(s, Var) else None
    bound = None
    if fixed is None and not isinstance(o, Var):
        fixed, start, end = o, "y", "x"
    elif fixed is None:
        bound = domain(known, s)
        if bound is None and domain(known, o) is not None:
            bound, start, end = domain(known, o), "y", "x"
    pairs = df.select(F.col(start).alias("x"), F.col(end).alias("y"))
    seen, search = pairs, True
    if fixed is not None:
        c = low.compiler({})
        u, k = Value(F.col("x"), kind), constant(fixed)
        seen = materialized(pairs.filter(c.compare("=", u, k) if kind.startswith("ref:") else low.algebra.same(u, k)))
    elif bound is not None:
        at, v = bound
        only = at.select(v.col.alias("__from")).distinct()
        seen = materialized(pairs.join(only, low.algebra.same(Value(F.col("x"), kind), Value(F.col("__from"), v.kind)), "left_semi"))
        search = 2 * seen.count() < pairs.count()
        if not search:  # most nodes are starts
            discard(seen)
            seen = pairs
    else:
        search = False
    newest, written = seen, []
    while True:
        step = (pairs if search else seen).select(F.col("x").alias("via"), F.col("y").alias("to"))
        reached = newest.select("x", F.col("y").alias("via")).join(step, "via").select("x", F.col("to").alias("y")).distinct()
        newest = materialized(reached.join(seen, ["x", "y"], "left_anti"))
        if newest.isEmpty():
            discard(newest)
            break
        seen = seen.unionByName(newest)
        written.append(newest)
        if len(written) > COMPACT:
            seen = materialized(seen)
            for old in written[:-1]:
                discard(old)
            written = [seen, newest]
    out = {a: Value(F.col(start), kind), b: Value(F.col(end), kind)}
    return build(seen, out, {a, b})

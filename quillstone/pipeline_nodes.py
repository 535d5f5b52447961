"""Filtering pipelines over triples, from Python or from a configuration graph.

A pipeline routes triples: those that a filter lets through go to its yes branch, the others to its no branch; branches end in nodes such as
a full-text index. Filters are predicates on columns, or semi joins with the types of subjects, so a pipeline is one DataFrame plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.expressions import Compiler
from .functions.extensions import GEOF
from .functions.registry import SCALAR
from .operators.fulltext import build_index, condition
from .plans.algebra import RDF
from .terms import Value, term_lex, term_tag

CONFIG = "urn:quillstone:pipe:"
#: kind of a configured node -> (values, data) to its route; more may be put in.
KINDS: dict[str, Callable[[list[str], DataFrame], Route]] = {
    "predicate": lambda found, data: predicate_filter(*found),
    "language": lambda found, data: language_filter(*found, accept_none="" in found),
    "type": lambda found, data: type_filter(data, *found),
    "text": lambda found, data: either(*map(text_filter, found)),
    "geo": lambda found, data: either(*map(geo_filter, found)),
}


@dataclass
class Route:
    """``test``: triples to (let through, others)."""

    test: Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def where(condition: Column) -> Route:
    truth = F.coalesce(condition, F.lit(False))
    return Route(lambda t: (t.filter(truth), t.filter(~truth)))


def predicate_filter(*predicates: str) -> Route:
    return where(F.col("p").isin(["I" + p for p in predicates]))


def language_filter(*languages: str, accept_none: bool = False) -> Route:
    tag = term_tag(F.col("o"))
    ok = tag.isin(["@" + x.lower() for x in languages])
    return where(ok | (F.coalesce(tag == "xsd:string", F.lit(False)) if accept_none else F.lit(False)))


def text_filter(query: str) -> Route:
    """Triples whose literal matches a full-text query."""
    return where(condition(F.when(F.col("o").startswith("L"), term_lex(F.col("o"))), query))


def geo_filter(polygon: str) -> Route:
    """Triples whose literal is a point inside a polygon (well-known text)."""
    c = Compiler({}, {})
    return where(SCALAR[GEOF + "sfWithin"](c, Value(F.when(F.col("o").startswith("L"), term_lex(F.col("o"))), "string"), Value(F.lit(polygon), "string")).col)


def type_filter(types: DataFrame, *classes: str, predicate: str = RDF + "type") -> Route:
    """Triples of subjects that ``types`` (triples) gives one of the classes."""
    known = types.filter((F.col("p") == F.lit("I" + predicate)) & F.col("o").isin(["I" + c for c in classes])).select("s").distinct()
    return Route(lambda t: (t.join(known, "s", "left_semi"), t.join(known, "s", "left_anti")))


def both(*routes: Route) -> Route:
    def test(t: DataFrame) -> tuple[DataFrame, DataFrame]:
        no = []
        for r in routes:
            t, rest = r.test(t)
            no.append(rest)
        return t, reduce(lambda a, b: a.unionByName(b), no)

    return Route(test)


def either(*routes: Route) -> Route:
    def test(t: DataFrame) -> tuple[DataFrame, DataFrame]:
        yes = []
        for r in routes:
            hit, t = r.test(t)
            yes.append(hit)
        return reduce(lambda a, b: a.unionByName(b), yes), t

    return Route(test)


@dataclass
class Node:
    """A step: a filter with branches, or a named end."""

    name: str = ""
    route: Route | None = None
    yes: list[Node] = field(default_factory=list)
    no: list[Node] = field(default_factory=list)
    languages: list[str] | None = None

    def run(self, triples: DataFrame, out: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
        """Triples that reach each named end."""
        out = {} if out is None else out
        if self.route is None:
            out[self.name] = out[self.name].unionByName(triples) if self.name in out else triples
            return out
        hit, rest = self.route.test(triples)
        for branch, rows in ((self.yes, hit), (self.no, rest)):
            for n in branch:
                n.run(rows, out)
        return out


def chain(*nodes: Node) -> Node:
    """Nodes one after the other: each one's yes branch leads to the next."""
    for a, b in zip(nodes, nodes[1:]):
        a.yes.append(b)
    return nodes[0]


def multi_type(types: DataFrame, branches: dict[str, Node], predicate: str = RDF + "type") -> Node:
    """Sends the triples of each class to its own branch."""
    out = Node()
    at = out
    for i, (c, n) in enumerate(branches.items()):
        at.route, at.yes = type_filter(types, c, predicate=predicate), [n]
        if i < len(branches) - 1:
            at.no = [Node()]
            at = at.no[0]
    return out


def indexes(root: Node, triples: DataFrame) -> dict[str, DataFrame]:
    """Full-text indexes of what reaches each end."""
    return {name: build_index(rows) for name, rows in root.run(triples).items()}


def compile_config(config: DataFrame, data: DataFrame, root: str, values: dict[str, str] | None = None) -> Node:
    """A pipeline from a configuration graph (triples): nodes have pipe:kind ("index" or one of ``KINDS``), pipe:value (repeated),
    pipe:yes and pipe:no. ``${key}`` in values is replaced. The configuration is small and read by the driver."""
    facts: dict[tuple[str, str], list[str]] = {}
    for r in config.filter(F.col("p").startswith("I" + CONFIG)).select("s", "p", "o").collect():
        text = r.o.partition("\x1f")[2] if r.o.startswith("L") else r.o[1:]
        for k, v in (values or {}).items():
            text = text.replace("${" + k + "}", v)
        facts.setdefault((r.s[1:], r.p[1 + len(CONFIG) :]), []).append(text)

    def node(s: str) -> Node:
        kind = (facts.get((s, "kind")) or ["index"])[0]
        found = facts.get((s, "value"), [])
        if kind == "index":
            return Node((facts.get((s, "name")) or [s])[0])
        return Node(route=KINDS[kind](found, data), yes=[node(x) for x in facts.get((s, "yes"), [])], no=[node(x) for x in facts.get((s, "no"), [])])

    return node(root)

"""Algebra of graph-pattern queries. Patterns are dataclasses, expressions nested tuples whose first item names the kind:

("var", name), ("iri", text), ("lit", lexical, datatype, language), ("op", name, *args), ("call", iri, *args), ("in", expr, [exprs], negated),
("exists", pattern, negated), ("agg", name, expr or None, distinct, separator).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class IRI:
    value: str


@dataclass(frozen=True)
class Literal:
    lex: str
    datatype: str = XSD + "string"
    lang: str | None = None


@dataclass(frozen=True)
class Path:
    """kind: iri, inverse, sequence, alternative, repeat (low, high or None), negated (forward, backward lists)."""

    kind: str
    args: tuple


@dataclass(frozen=True)
class Triple:
    s: Any
    p: Any
    o: Any


@dataclass
class BGP:
    triples: list[Triple] = field(default_factory=list)


@dataclass
class Join:
    left: Any
    right: Any


@dataclass
class LeftJoin:
    left: Any
    right: Any
    condition: Any = None


@dataclass
class Filter:
    condition: Any
    child: Any


@dataclass
class Extend:
    child: Any
    var: str
    expr: Any


@dataclass
class Union:
    left: Any
    right: Any


@dataclass
class Minus:
    left: Any
    right: Any


@dataclass
class Graph:
    name: Any
    child: Any


@dataclass
class Service:
    name: Any
    child: Any
    silent: bool


@dataclass
class Values:
    vars: list[str]
    rows: list[list[Any]]


@dataclass
class Group:
    child: Any
    keys: list[tuple[str, Any]]
    aggs: list[tuple[str, tuple]]


@dataclass
class Project:
    child: Any
    vars: list[str]


@dataclass
class Distinct:
    child: Any


@dataclass
class OrderBy:
    child: Any
    keys: list[tuple[Any, bool]]


@dataclass
class Slice:
    child: Any
    offset: int
    limit: int | None


@dataclass
class Query:
    form: str
    pattern: Any
    template: list[Triple] = field(default_factory=list)
    describe: list[Any] = field(default_factory=list)
    default_graphs: list[str] = field(default_factory=list)
    named_graphs: list[str] = field(default_factory=list)


@dataclass
class Update:
    kind: str
    args: dict[str, Any]


def variables(node: Any) -> set[str]:
    """Variables in scope after a pattern."""
    if isinstance(node, BGP):
        return {t.name for x in node.triples for t in (x.s, x.p, x.o) if isinstance(t, Var)}
    if isinstance(node, Values):
        return set(node.vars)
    if isinstance(node, Project):
        return set(node.vars)
    if isinstance(node, Group):
        return {k for k, _ in node.keys} | {a for a, _ in node.aggs}
    if isinstance(node, Minus):
        return variables(node.left)
    out: set[str] = set()
    for name in ("left", "right", "child"):
        if hasattr(node, name):
            out |= variables(getattr(node, name))
    if isinstance(node, Extend):
        out.add(node.var)
    if isinstance(node, (Graph, Service)) and isinstance(node.name, Var):
        out.add(node.name.name)
    return out


def expression_variables(e: Any) -> set[str]:
    if not isinstance(e, (tuple, list)):
        return set()
    if isinstance(e, tuple) and e:
        if e[0] == "var":
            return {e[1]}
        if e[0] == "exists":
            return set()
        if e[0] in ("iri", "lit"):
            return set()
    return set().union(*(expression_variables(x) for x in e)) if e else set()


def conjuncts(e: Any) -> list:
    return conjuncts(e[2]) + conjuncts(e[3]) if isinstance(e, tuple) and e[:2] == ("op", "&&") else [e]


def has_exists(e: Any) -> bool:
    return isinstance(e, (tuple, list)) and (isinstance(e, tuple) and bool(e) and e[0] == "exists" or any(has_exists(x) for x in e))
